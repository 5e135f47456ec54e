"""Operators over append-only event logs: folds, adjacency, replay, transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.functions.guards import any_of, bound, let
from veriloom.operators.digests import ordered_digest
from veriloom.operators.prefixes import running_merge


def fold_last(log: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The last non-null value of each key: ``keys, value`` (last writer wins, no sort)."""
    return log.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def streaks(log: DataFrame, run: Sequence[str], order: Sequence[str], failure: Column, reset: Column) -> DataFrame:
    """Failing rows with ``k``: the how-many-th failure since the last reset."""
    w = W.partitionBy(*run).orderBy(*order)
    marked = log.withColumn("island", F.sum(reset.cast("int")).over(w))
    inner = W.partitionBy(*run, "island").orderBy(*order)
    return marked.where(failure).withColumn("k", F.row_number().over(inner).cast("bigint")).drop("island")


def not_followed(log: DataFrame, run: Sequence[str], order: Sequence[str], event: Column, field: str, expected: Sequence[str], *, trailing_ok: bool = True) -> DataFrame:
    """Rows of ``event`` whose next row is none of ``expected``: with that row's ``next``."""
    w = W.partitionBy(*run).orderBy(*order)
    after = log.withColumn("next", F.lead(field).over(w))
    bad = F.coalesce(~F.col("next").isin(*expected), F.lit(not trailing_ok))
    return after.where(event & bad)


def discontinuities(log: DataFrame, run: Sequence[str], order: Sequence[str], start: str, end: str) -> DataFrame:
    """Rows that don't start where the row before them in the run ended."""
    w = W.partitionBy(*run).orderBy(*order)
    return log.withColumn("expected", F.lag(end).over(w)).where(F.col("expected").isNotNull() & ~F.col(start).eqNullSafe(F.col("expected")))


def gaps(log: DataFrame, run: Sequence[str], seq: str, first: int = 0) -> DataFrame:
    """Rows whose sequence number isn't the one expected at their place: ``expected``."""
    w = W.partitionBy(*run).orderBy(seq)
    return log.withColumn("expected", F.row_number().over(w) - 1 + first).where(F.col(seq) != F.col("expected"))


def prefix_last(log: DataFrame, run: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each row with ``<value>_before``: the merged value of the rows before it."""
    w = W.partitionBy(*run).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return log.select("*", *(F.last(v, ignorenulls=True).over(w).alias(f"{v}_before") for v in values))


def path_hash(log: DataFrame, run: Sequence[str], order: Sequence[str], step: str) -> DataFrame:
    """``run, n, path_sha256``: SHA-256 of a run's steps in order, joined by line feeds."""
    return ordered_digest(log, run, [*order, step], step, name="path_sha256")


def transition_pairs(log: DataFrame, run: Sequence[str], order: Sequence[str], step: str) -> DataFrame:
    """Distinct ``from_step, to_step`` of successive rows."""
    w = W.partitionBy(*run).orderBy(*order)
    return log.select(F.col(step).alias("from_step"), F.lead(step).over(w).alias("to_step")).where("to_step IS NOT NULL").distinct()


def pick_transition(events: DataFrame, transitions: DataFrame, *, event_id: str, holds: Column, dialect: str = "fallback") -> DataFrame:
    """``event_id, outcome, transition_id`` for events joined on (from_state, trigger).

    ``transitions``: ``transition_id, from_state, trigger, guarded`` and what
    ``holds`` needs, a boolean expression over the joined rows (null: the guard
    raised, so it doesn't win).
    Dialect ``fallback``: exactly one true guard wins; without any, a single
    guardless transition does.  Dialect ``always``: guardless counts as true, and
    exactly one must be true.  Outcomes: taken, ambiguous, unhandled.
    """
    true = F.count_if(F.col("guarded") & F.coalesce(holds, F.lit(False)))
    open_ = F.count_if(~F.col("guarded"))
    first = lambda c: F.min(F.when(c, F.col("transition_id")))
    grouped = events.join(transitions, ["from_state", "trigger"], "left").groupBy(event_id).agg(
        true.alias("t"), F.when(F.count("transition_id") > 0, open_).otherwise(0).alias("o"),
        first(F.col("guarded") & F.coalesce(holds, F.lit(False))).alias("won"), first(~F.col("guarded")).alias("default"),
    )
    if dialect == "fallback":
        taken = F.when(F.col("t") == 1, F.col("won")).when((F.col("t") == 0) & (F.col("o") == 1), F.col("default"))
        several = (F.col("t") > 1) | ((F.col("t") == 0) & (F.col("o") > 1))
    else:
        taken = F.when(F.col("t") + F.col("o") == 1, F.coalesce("won", "default"))
        several = F.col("t") + F.col("o") > 1
    return grouped.select(event_id, F.when(taken.isNotNull(), "taken").when(several, "ambiguous").otherwise("unhandled").alias("outcome"), taken.alias("transition_id"))


def replay(
    events: DataFrame, transitions: DataFrame, run: Sequence[str], seq: str, *, initial: str, guards: Sequence[str], root: str = "payload", parts: int | None = None
) -> DataFrame:
    """``events`` with what each should have been: ``expected_state, winners, transition_id, fault``.

    ``events``: a run, its ``seq``, ``from_state, to_state, trigger, payload``;
    ``transitions``: ``transition_id, from_state, trigger, guard, to_state``, their
    guards (null: always true) among ``guards``.  A guard sees the payloads of the
    run up to its event, merged under the name ``root`` (``prefixes.running_merge``).
    An event must start where the one before it ended (the first at ``initial``), and
    of the transitions from there on its trigger exactly one must be true, which leads
    where the event did.  ``fault`` (fixed texts) says which of these fails;
    ``transition_id`` is the one true transition.
    """
    merged = running_merge(events, run, [seq], "payload", previous=["to_state"], parts=parts)
    merged = merged.withColumn("expected_state", F.coalesce("to_state_before", F.lit(initial))).drop("to_state_before")
    # One row a state and trigger: definitions, so an event meets its candidates without a shuffle of its own.
    known = transitions.groupBy(F.col("from_state").alias("expected_state"), "trigger").agg(F.array_sort(F.collect_list(F.struct("transition_id", "guard", "to_state"))).alias("__known"))
    candidates = F.coalesce("__known", F.array().cast(known.schema["__known"].dataType))
    text = lambda c: F.col(c).cast("string")

    def judge(won: Column) -> Column:
        ids = F.transform(won, lambda t: t["transition_id"])
        shown = F.concat(F.lit("["), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("'"), i.cast("string"), F.lit("'"))), ", "), F.lit("]"))
        only = F.size(won) == 1
        fault = F.when(~F.col("from_state").eqNullSafe(F.col("expected_state")), F.format_string("replay: event %s starts at %s, expected %s", text(seq), "from_state", "expected_state")).when(
            ~only | ~F.get(won, F.lit(0))["to_state"].eqNullSafe(F.col("to_state")), F.format_string("replay: event %s does not re-derive (winners=%s)", text(seq), shown)
        )
        return F.struct(ids.alias("winners"), F.when(only, F.get(won, F.lit(0))["transition_id"]).alias("transition_id"), fault.alias("fault"))

    # All that a row is told comes out of one expression, so that its payload is parsed, and its guards judged, once.
    won = bound(guards, {root: F.col("merged")}, lambda values: F.filter(candidates, lambda t: F.coalesce(any_of(t["guard"], guards, values), F.lit(False))))
    judged = merged.join(known, ["expected_state", "trigger"], "left").withColumn("__told", let(won, judge))
    return judged.select(*(F.col(f"`{c}`") for c in events.columns), "merged", "expected_state", *(F.col(f"__told.{c}") for c in ("winners", "transition_id", "fault")))


def first_faults(replayed: DataFrame, run: Sequence[str], seq: str) -> DataFrame:
    """``run, seq, fault``: where the replay of each run stops.

    Faults are chosen in the aggregate: a filter of its own would judge each event twice.
    """
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct(F.col(seq).alias("seq"), "fault"))).alias("__first")
    return replayed.groupBy(*run).agg(first).where("__first IS NOT NULL").select(*run, F.col("__first.seq").alias(seq), F.col("__first.fault").alias("fault"))


def uncommitted(log: DataFrame, commits: DataFrame, run: Sequence[str], seq: str, last: str) -> DataFrame:
    """``run, n, first_seq, last_seq, gapless``: what lies past each run's last commit."""
    mark = commits.groupBy(*run).agg(F.max(last).alias("mark"))
    new = log.join(mark, list(run), "left").where(F.col(seq) > F.coalesce("mark", F.lit(-1)))
    out = new.groupBy(*run).agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.max(F.coalesce("mark", F.lit(-1))).alias("mark"))
    return out.select(*run, "n", "first_seq", "last_seq", ((F.col("first_seq") == F.col("mark") + 1) & (F.col("last_seq") - F.col("first_seq") + 1 == F.col("n"))).alias("gapless"))


def overlaps(ranges: DataFrame, run: Sequence[str], first: str, last: str) -> DataFrame:
    """Ranges that begin at or before the end of an earlier one: with ``previous_last``."""
    w = W.partitionBy(*run).orderBy(first, last).rowsBetween(W.unboundedPreceding, -1)
    return ranges.withColumn("previous_last", F.max(last).over(w)).where(F.col("previous_last") >= F.col(first))
