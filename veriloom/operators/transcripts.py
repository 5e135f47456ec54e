"""Checks of run transcripts by windows over their logs; tools are never called.

A log has ``run_id, seq, kind, payload`` (JSON).  Each check returns
``run_id, seq, rule, message``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.functions.guards import compile_guard
from veriloom.operators import logs
from veriloom.operators.prefixes import running_merge
from veriloom.streaming.machine import KINDS


def by_seq():
    return W.partitionBy("run_id").orderBy("seq")


def _out(df: DataFrame, rule: str, message: Column) -> DataFrame:
    return df.select("run_id", F.col("seq").cast("bigint").alias("seq"), F.lit(rule).alias("rule"), message.alias("message"))


def _step() -> Column:
    return F.get_json_object("payload", "$.step_seq").cast("bigint")


def shape(log: DataFrame) -> DataFrame:
    """Gaps in sequence numbers and unknown kinds."""
    gap = _out(logs.gaps(log, ["run_id"], "seq"), "shape", F.format_string("seq gap at index %s: got %s", F.col("expected").cast("string"), F.col("seq").cast("string")))
    return gap.unionByName(_out(log.where(~F.col("kind").isin(*KINDS)), "shape", F.format_string("unknown event kind %s", "kind")))


def consequences(log: DataFrame, policies: DataFrame) -> DataFrame:
    """I-28: each failure is followed by what its policy asks; a trailing one may still wait.

    ``policies``: ``run_id, policy`` (abort, skip or retry:n).
    """
    rows = log.withColumn("step", _step()).withColumn("next_kind", F.lead("kind").over(by_seq())).withColumn("next_step", F.lead(_step()).over(by_seq())).withColumn("next_seq", F.lead("seq").over(by_seq()))
    by_step = W.partitionBy("run_id", "step").orderBy("seq")
    rows = rows.where("step IS NOT NULL").withColumn("island", F.sum(F.col("kind").isin("step_completed", "step_skipped").cast("int")).over(by_step))
    rows = rows.where("kind = 'step_failed'").withColumn("k", F.row_number().over(W.partitionBy("run_id", "step", "island").orderBy("seq"))).join(policies, "run_id")
    times = F.regexp_extract("policy", r"^retry:\s*\+?(\d+)", 1)
    want = F.when(F.col("policy").isin("abort", "skip"), F.col("policy")).when(F.col("k") < F.when(times != "", times.cast("int")), "retry").otherwise("abort")
    same = F.col("next_step").eqNullSafe(F.col("step"))
    good = ((F.col("want") == "abort") & (F.col("next_kind") == "run_aborted")) | ((F.col("want") == "skip") & (F.col("next_kind") == "step_skipped") & same) | ((F.col("want") == "retry") & (F.col("next_kind") == "step_started") & same)
    bad = rows.withColumn("want", want).where(F.col("next_kind").isNotNull() & ~good)
    text = F.format_string("I-28: step_failed for step %s (failure #%s) not followed by its %s consequence (next: %s at seq %s)", F.col("step").cast("string"), F.col("k").cast("string"), "want", "next_kind", F.col("next_seq").cast("string"))
    return _out(bad, "I-28", text)


def stickiness(log: DataFrame) -> DataFrame:
    """I-29: after an end or a park only new input may follow."""
    ends = F.col("kind").isin("run_completed", "run_aborted", "step_parked")
    bad = logs.not_followed(log, ["run_id"], ["seq"], ends, "kind", ["event_injected"])
    return _out(bad, "I-29", F.format_string("I-29: %s at seq %s followed by %s with no intervening input", "kind", F.col("seq").cast("string"), "next"))


def aborts(log: DataFrame) -> DataFrame:
    """An abort must follow a failure."""
    bad = log.withColumn("before", F.lag("kind").over(by_seq())).where("kind = 'run_aborted' AND before <> 'step_failed'")
    return _out(bad, "abort", F.format_string("run_aborted at seq %s not via the abort policy (previous: %s)", F.col("seq").cast("string"), "before"))


def starts(log: DataFrame, steps: dict[int, str]) -> DataFrame:
    """Starts of unknown steps, and starts whose guard was false on what came before.

    The context before an event is what the run's inputs and results come to, whatever
    their keys (``running_merge``); the run's creation sets it anew.
    """
    source = F.when(F.col("kind") == "run_created", F.get_json_object("payload", "$.ctx")).when(F.col("kind") == "event_injected", F.get_json_object("payload", "$.payload")).when(F.col("kind") == "step_completed", F.get_json_object("payload", "$.ctx_delta"))
    values = log.withColumn("step", _step()).withColumn("given", source)
    before = running_merge(values, ["run_id"], ["seq"], "given", into="ctx", resets=F.col("kind") == "run_created", inclusive=False)
    started = before.where("kind = 'step_started'")
    holds = F.lit(None).cast("boolean")
    for seq, expr in steps.items():
        holds = F.when(F.col("step") == seq, compile_guard(expr, {"ctx": F.col("ctx")})).otherwise(holds)
    known = F.col("step").isin(*steps) if steps else F.lit(False)
    lost = _out(started.where(F.coalesce(~known, F.lit(True))), "start", F.format_string("step_started for unknown step %s at seq %s", F.col("step").cast("string"), F.col("seq").cast("string")))
    return lost.unionByName(_out(started.where(known & ~holds), "start", F.format_string("step %s started with guard false at seq %s", F.col("step").cast("string"), F.col("seq").cast("string"))))


def completions(log: DataFrame, steps: list[int]) -> DataFrame:
    """Completions without a start before them, and runs completed with steps pending."""
    rows = log.withColumn("step", _step())
    first = lambda kinds: rows.where(F.col("kind").isin(*kinds) & F.col("step").isNotNull()).groupBy("run_id", "step").agg(F.min("seq").alias("first"))
    orphan = rows.where("kind = 'step_completed' AND step IS NOT NULL").join(first(["step_started"]), ["run_id", "step"], "left").where("NOT coalesce(first < seq, false)")
    done = first(["step_completed", "step_skipped"]).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("step", "first"))).alias("done"))
    wanted = F.array(*(F.lit(s).cast("bigint") for s in sorted(steps))) if steps else F.array().cast("array<bigint>")
    left = F.filter(wanted, lambda s: ~F.coalesce(F.try_element_at("done", s) < F.col("seq"), F.lit(False)))
    pending = rows.where("kind = 'run_completed'").join(done, "run_id", "left").withColumn("pending", left).where(F.size("pending") > 0)
    return _out(orphan, "complete", F.format_string("step_completed for step %s with no step_started at seq %s", F.col("step").cast("string"), F.col("seq").cast("string"))).unionByName(
        _out(pending, "complete", F.format_string("run_completed at seq %s with steps pending: %s", F.col("seq").cast("string"), F.concat(F.lit("["), F.array_join(F.transform("pending", lambda x: x.cast("string")), ", "), F.lit("]")))))


def revalidate(log: DataFrame, policies: DataFrame, steps: dict[int, str]) -> DataFrame:
    """All checks; a run whose shape is wrong gets only the shape's messages."""
    bad = shape(log)
    sound = log.join(bad.select("run_id").distinct(), "run_id", "left_anti")
    out = bad
    for part in (starts(sound, steps), completions(sound, list(steps)), consequences(sound, policies), stickiness(sound), aborts(sound)):
        out = out.unionByName(part)
    return out


def one_open_run(runs: DataFrame) -> DataFrame:
    """I-30: later open runs of an idempotency key; I-state: states outside the set.  ``runs``: run_id, kind, state, idempotency_key."""
    from veriloom.operators.integrity import outside_set, second_open

    later = second_open(runs.where("kind = 'run'"), ["idempotency_key"], ["run_id"], "run_id", F.col("state") == "open")
    twice = later.select("run_id", F.lit(None).cast("bigint").alias("seq"), F.lit("I-30").alias("rule"), F.format_string("I-30: idempotency key '%s' carried by two open runs (%s and %s)", "idempotency_key", "first_holder", "run_id").alias("message"))
    odd = outside_set(runs, "state", ["open", "completed", "aborted"]).select("run_id", F.lit(None).cast("bigint").alias("seq"), F.lit("state").alias("rule"), F.format_string("AutomatonRun.state '%s' not in open|completed|aborted (run %s)", "state", "run_id").alias("message"))
    return twice.unionByName(odd)
