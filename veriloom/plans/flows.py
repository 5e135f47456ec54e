"""Machine definitions compiled into entities, checks of the result, component status."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.functions.guards import refused
from veriloom.functions.text import slug_letters
from veriloom.plans.rules import TRIGGERS, union


def compile_machine(states: DataFrame, transitions: DataFrame, steps: DataFrame, *, prefix: str, version: str) -> dict[str, DataFrame]:
    """Entities of one machine.

    ``states``: name, kind, runbook, step_policy, outcome, ord; ``transitions``:
    from_state, trigger, guard, to_state, ord; ``steps``: runbook, tool, expr,
    ord.  Ids are the prefix and the slug of the name, ordinals in two digits;
    of equal tools the first stays.
    """
    ident = lambda kind, c: F.concat(F.lit(f"{prefix}{kind}-"), slug_letters(F.col(c)))
    flow = F.lit(f"{prefix}flow")
    number = lambda part: F.lpad(F.row_number().over(W.partitionBy(*part).orderBy("ord")).cast("string"), 2, "0")
    runbooks = steps.select("runbook").distinct()
    first = W.partitionBy("tool").orderBy("ord")
    return {
        "flow_states": states.select(ident("state", "name").alias("_key"), flow.alias("flow_id"), "name", "kind", F.when(F.col("runbook").isNotNull(), ident("rb", "runbook")).alias("runbook_id"), "outcome", "step_policy"),
        "flow_transitions": transitions.withColumn("n", number([F.lit(0)])).select(F.concat(F.lit(f"{prefix}tr-"), "n").alias("_key"), flow.alias("flow_id"), ident("state", "from_state").alias("from_state_id"), "trigger", "guard", ident("state", "to_state").alias("to_state_id")),
        "runbooks": runbooks.select(ident("rb", "runbook").alias("_key"), F.lit(version).alias("release_version"), F.col("runbook").alias("name")),
        "steps": steps.withColumn("n", number(["runbook"])).select(F.concat(ident("step", "runbook"), F.lit("-"), "n").alias("_key"), ident("rb", "runbook").alias("runbook_id"), F.col("n").cast("bigint").alias("seq"), "expr", ident("tool", "tool").alias("tool_id")),
        "tools": steps.withColumn("at", F.row_number().over(first)).where("at = 1").select(ident("tool", "tool").alias("_key"), F.col("tool").alias("name")),
    }


def check_machine(t: Mapping[str, DataFrame], expected: Mapping[str, int]) -> DataFrame:
    """``rule, message``: entity counts other than expected, duplicate ids, unknown words, dangling ends."""
    out = []
    spark = t["flow_states"].sparkSession
    want = spark.createDataFrame(list(expected.items()), "collection string, want bigint")
    have = union(*(df.agg(F.count("*").alias("n")).select(F.lit(c).alias("collection"), "n") for c, df in t.items()))
    out.append(want.join(have, "collection", "left").where("NOT n <=> want").select(F.lit("B-1").alias("rule"), F.format_string("%s: %s entities for %s source elements", "collection", F.coalesce(F.col("n").cast("string"), F.lit("0")), F.col("want").cast("string")).alias("message")))
    for c, df in t.items():
        out.append(df.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("B-1").alias("rule"), F.format_string(f"{c}: id %s is emitted %s times", "_key", F.col("n").cast("string")).alias("message")))
    out.append(t["flow_transitions"].where(~F.col("trigger").isin(*TRIGGERS)).select(F.lit("B-3").alias("rule"), F.format_string("transition %s: unknown trigger %s", "_key", "trigger").alias("message")))
    for c, field, target in (("flow_transitions", "from_state_id", "flow_states"), ("flow_transitions", "to_state_id", "flow_states"), ("steps", "tool_id", "tools"), ("steps", "runbook_id", "runbooks"), ("flow_states", "runbook_id", "runbooks")):
        lost = t[c].where(F.col(field).isNotNull()).join(t[target].select(F.col("_key").alias(field)), field, "left_anti")
        out.append(lost.select(F.lit("B-3").alias("rule"), F.format_string(f"{c} %s: {field} %s is dangling", "_key", field).alias("message")))
    return union(*out)


def check_guards(transitions: DataFrame, steps: DataFrame) -> DataFrame:
    """``rule, message``: guards of source transitions and run-book steps outside the language (texts fixed).

    ``transitions``: from_state, to_state, guard; ``steps``: runbook, seq, expr.
    """
    text = lambda head: F.concat(F.lit("B-3: "), head, F.lit(": "), F.col("bad"))
    found = transitions.withColumn("bad", refused(F.col("guard"))).where("bad IS NOT NULL").select(text(F.concat(F.lit("transition "), "from_state", F.lit("->"), "to_state")).alias("message"))
    more = steps.withColumn("bad", refused(F.col("expr"))).where("bad IS NOT NULL").select(text(F.concat(F.lit("run-book '"), "runbook", F.lit("' step "), F.col("seq").cast("string"))).alias("message"))
    return found.union(more).select(F.lit("B-3").alias("rule"), "message")


def check_ids(t: Mapping[str, DataFrame], expected: Mapping[str, DataFrame]) -> DataFrame:
    """B-2 ``rule, message``: ids that the same source gives (``compile_machine`` again) and that weren't emitted."""
    kinds = {"flow_states": "state", "flow_transitions": "trans", "runbooks": "runbook", "steps": "step"}
    lost = (df.select("_key").join(t[c].select("_key"), "_key", "left_anti").select(F.lit(kinds[c]).alias("kind"), "_key") for c, df in expected.items() if c in kinds)
    return union(*lost).select(F.lit("B-2").alias("rule"), F.format_string("B-2: expected id '%s' (%s) not emitted", "_key", "kind").alias("message"))


def component_status(components: DataFrame, files: DataFrame, manifest: DataFrame, profile: str | None = None) -> DataFrame:
    """``component, status, detail, fault`` of each component.

    ``components``: component, artifacts (paths; one ending in ``/`` stands for all
    that the manifest has below it), and maybe kind and profiles; ``files``,
    ``manifest``: path, sha256.  In this order: ``specified-only`` by its kind (without
    kinds: no artifacts); ``absent`` if its profiles lack ``profile``; ``absent`` and a
    fault if an artifact isn't there; ``mutated`` if one differs from the manifest;
    ``instantiated``.
    """
    have = lambda c, other: F.col(c) if c in components.columns else other
    only = F.coalesce(have("kind", F.when(F.size("artifacts") == 0, "specified-only")) == "specified-only", F.lit(False))
    profiles = F.coalesce(have("profiles", F.array(F.lit(profile))), F.array().cast("array<string>"))
    listed = components.select("component", F.explode("artifacts").alias("artifact"))
    ends = F.endswith(F.col("artifact"), F.lit("/"))
    # A prefix meets the folders above each file of the manifest, so this stays an equal join.
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    below = listed.where(ends).join(manifest.select("path", F.explode(above).alias("artifact")), "artifact").select("component", "path")
    wanted = listed.where(~ends).select("component", F.col("artifact").alias("path")).union(below).distinct()
    both = wanted.join(files.select("path", F.col("sha256").alias("__have")), "path", "left").join(manifest.select("path", F.col("sha256").alias("__want")), "path", "left")
    gone, differs = F.col("__have").isNull(), F.col("__want") != F.col("__have")
    per = both.groupBy("component").agg(*(F.array_sort(F.collect_list(F.when(c, F.col("path")))).alias(n) for c, n in ((gone, "__gone"), (differs, "__differs"))))
    rows, some = components.join(per, "component", "left"), lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    unshipped = ~F.array_contains(profiles, profile) if profile is not None else F.lit(False)
    status = F.when(only, "specified-only").when(unshipped | some("__gone"), "absent").when(some("__differs"), "mutated").otherwise("instantiated")
    detail = F.when(only, "specified, not implemented").when(unshipped, F.concat(F.lit(f"not shipped in the {profile} profile (ships in: "), F.array_join(profiles, ", "), F.lit(")")))
    detail = detail.when(some("__gone"), F.concat(F.lit("missing artifacts: "), F.array_join("__gone", ", "))).when(some("__differs"), F.concat(F.lit("diverged from manifest: "), F.array_join("__differs", ", ")))
    return rows.select("component", status.alias("status"), detail.otherwise("present and pristine").alias("detail"), (~only & ~unshipped & some("__gone")).alias("fault"))


def roll_up(findings: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``group, n, failed, healthy``: health of each group of findings ``ok`` (one row without groups; of none: healthy)."""
    bad = ~F.coalesce(F.col("ok"), F.lit(False))
    return findings.groupBy(*(group or [])).agg(F.count("*").alias("n"), F.count_if(bad).alias("failed"), ~F.coalesce(F.bool_or(bad), F.lit(False)).alias("healthy"))


def verify_writers(entries: DataFrame) -> DataFrame:
    """Specified only, never built elsewhere: ``writer_id, seq, problem`` of hash-chained entries.

    ``entries``: writer_id, seq, prev_hash, body, entry_hash.  Hashes must chain,
    numbers run from 0 without gaps, and each hash be that of its parts.
    """
    w = W.partitionBy("writer_id").orderBy("seq")
    rows = entries.withColumn("before", F.lag("entry_hash").over(w)).withColumn("at", F.row_number().over(w) - 1)
    own = F.sha2(F.concat_ws("\0", "writer_id", F.col("seq").cast("string"), F.coalesce("prev_hash", F.lit("")), "body"), 256)
    problem = F.when(F.col("seq") != F.col("at"), "gap").when(~F.col("prev_hash").eqNullSafe(F.col("before")), "broken link").when(F.col("entry_hash") != own, "hash mismatch")
    return rows.withColumn("problem", problem).where("problem IS NOT NULL").select("writer_id", "seq", "problem")
