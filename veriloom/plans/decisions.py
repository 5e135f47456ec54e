"""May an operation happen, and if not, why: for every id at once.

Each function returns ``id, ok, reason``; the first test that fails gives the
reason.  Reasons are fixed values.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.text import blank
from veriloom.plans.rules import DECIDED, keyed

Tables = Mapping[str, DataFrame]

#: What silence means in each mode.
SILENCE = {"ratify": "no_decision", "authorize": "no_action", "triage": "outcome_refused", "set_standing": "sustain_must_be_recorded", "overrule": "sustain_must_be_recorded"}


def decided(df: DataFrame, key: str, *tests: tuple[Column, Column | str]) -> DataFrame:
    reason = None
    for failed, why in tests:
        why = F.lit(why) if isinstance(why, str) else why
        reason = F.when(failed, why) if reason is None else reason.when(failed, why)
    reason = reason.otherwise("ok")
    return df.select(F.col(key).alias("id"), (reason == "ok").alias("ok"), reason.alias("reason"))


def apply_directives(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """May each directive (or each ``id`` of ``ids``) be applied?  The last gate check and the first policy count."""
    asked = t["directives"].select("_key") if ids is None else ids.select(F.col("id").alias("_key"))
    last = t["gate_checks"].groupBy("directive_id").agg(F.max_by("verdict", "_ord").alias("verdict"))
    first = t["authority_policies"].agg(F.min_by("on_conflict", "_ord").alias("on_conflict"))
    upheld = t["local_vetoes"].where("status = 'upheld'").groupBy("directive_id").agg(F.min_by("id", "_ord").alias("veto"))
    rows = (
        asked.join(t["directives"].select("_key", F.lit(True).alias("known")), "_key", "left")
        .join(last.withColumnRenamed("directive_id", "_key"), "_key", "left").join(upheld.withColumnRenamed("directive_id", "_key"), "_key", "left").join(first, F.lit(True), "left")
    )
    local = F.coalesce(F.col("on_conflict"), F.lit("local_wins")) == "local_wins"
    return decided(
        rows, "_key",
        (F.col("known").isNull(), "directive missing"),
        (~F.col("verdict").eqNullSafe("passed"), "no passed gate check — directive rejected, never converted"),
        (F.col("veto").isNotNull() & local, F.format_string("local veto %s upheld — directive rejected", "veto")),
    )


def close_runs(t: Tables) -> DataFrame:
    """May each run close as completed?"""
    bad = t["conditions"].where("required AND NOT satisfied").groupBy(F.col("run_id").alias("_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "id"))), lambda x: x["id"]).alias("bad"))
    quoted = F.concat(F.lit("['"), F.array_join("bad", "', '"), F.lit("']"))
    return decided(t["harness_runs"].join(bad, "_key", "left"), "_key", (F.col("bad").isNotNull(), F.format_string("required conditions unsatisfied: %s", quoted)))


def promote(t: Tables, asked: DataFrame) -> DataFrame:
    """May each ``id, artifact_id, version, disposition_id`` be promoted?"""
    known = t["releases"].select("version", F.lit(True).alias("exists")).distinct()
    domains = t["playbooks"].select("domain", F.lit(True).alias("covered")).distinct()
    rows = (
        asked.join(known, "version", "left").join(keyed(t["artifacts"], "artifact_id", domain="domain", content_hash="content_hash"), "artifact_id", "left")
        .join(domains, "domain", "left").join(keyed(t["dispositions"], "disposition_id", proposer="proposer_id", disposer="disposer_id", mode="mode", status="status", state_ref="state_ref"), "disposition_id", "left")
    )
    return decided(
        rows, "id",
        (F.col("exists").isNotNull(), F.format_string("release version %s already exists", "version")),
        (F.col("artifact_id_found").isNull(), "artifact missing"),
        (F.col("covered").isNull(), F.format_string("domain '%s' has no dyad playbook (playbook before automation)", "domain")),
        (F.col("disposition_id_found").isNull() | F.col("proposer").eqNullSafe(F.col("disposer")), "irreversible publish needs an Operator disposition (N6)"),
        (F.col("mode") != "authorize", "irreversible publish needs an AUTHORIZE-mode disposition (N6)"),
        (~F.col("status").isin(*DECIDED), "irreversible publish needs an approved AUTHORIZE-mode disposition (N6)"),
        ((F.coalesce("state_ref", F.lit("")) == "") | (F.col("state_ref") != F.col("content_hash")), "authorization is stale: artifact changed since disposition (N6)"),
    )


def materialize(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """May each claim (or each ``id`` of ``ids``) be materialized?  The claim's own state doesn't count."""
    asked = t["claims"].select("_key") if ids is None else ids.select(F.col("id").alias("_key"))
    good = t["falsification_records"].where((F.col("outcome") == "survived") & ~blank(F.col("external_separator"))).select(F.col("claim_id").alias("_key"), F.lit(True).alias("recorded")).distinct()
    rows = asked.join(t["claims"].select("_key", F.lit(True).alias("known")), "_key", "left").join(good, "_key", "left")
    return decided(rows, "_key", (F.col("known").isNull(), "claim missing"), (F.col("recorded").isNull(), "no surviving falsification record with external separator (IFF1/IFF2)"))


def silence(mode: Column) -> Column:
    """What silence on a disposition of this mode means."""
    return F.create_map(*(F.lit(x) for pair in SILENCE.items() for x in pair))[mode]
