"""The entity graph projected into eight kinds of acts and their approvals.

Every projected table has ``id`` and its own columns; ``source`` and ``source_id``
name the entity that a row comes from.  Order of a table is by ``natural_key`` of
the id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import documents
from veriloom.functions.text import natural_key, slug
from veriloom.operators.integrity import positions
from veriloom.plans.rules import keyed, union
from veriloom.sources.tables import settled

Tables = Mapping[str, DataFrame]
EXECUTOR = "party-executor"


def ident(prefix: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(f"{prefix}-"), slug(key))


def _party(parties: DataFrame, df: DataFrame, field: str, name: str) -> DataFrame:
    """``df`` with the party of an entity id; an unresolved one stays visible."""
    known = parties.select(F.col("source_id").alias(field), F.col("id").alias("__party"))
    return df.join(known, field, "left").withColumn(name, F.coalesce("__party", ident("party-unresolved", F.coalesce(F.nullif(F.col(field), F.lit("")), F.lit("none"))))).drop("__party")


def answers(t: Tables) -> DataFrame:
    """Dispositions with ``answer`` and ``answer_source``: the response, else the status."""
    by_response = F.when(F.col("response") == "yes", "yes").when(F.col("response") == "no", "no").when(F.col("response") == "counter", "amend")
    by_status = F.when(F.col("status").isin("approved", "acted"), "yes").when(F.col("status") == "rejected", "no")
    has = F.col("response").isNotNull()
    return t["dispositions"].withColumn("answer", F.when(has, by_response).otherwise(by_status)).withColumn("answer_source", F.when(has, "response").when(by_status.isNotNull(), "status"))


def project(t: Tables, system: str = "local") -> dict[str, DataFrame]:
    """parties, acts, proposals, countersignatures, mandates, releases, events, escalations."""
    source = lambda name: (F.lit(name).alias("source"), F.col("_key").alias("source_id"))
    people = union(*(t[c].select(ident("party", "_key").alias("id"), F.lit(k).alias("kind"), *source(c)) for c, k in (("humans", "human"), ("agents", "agent"))))
    runs = t["automaton_runs"].select("_key").union(t["flow_runs"].select("_key")).limit(1)
    parties = people.unionByName(runs.select(F.lit(EXECUTOR).alias("id"), F.lit("executor").alias("kind"), F.lit("executor").alias("source"), F.lit(None).cast("string").alias("source_id")))
    agent = lambda df: _party(people, df.join(keyed(t["dyads"], "dyad_id", agent_id="agent_id"), "dyad_id", "left"), "agent_id", "processor")
    d = answers(t)

    def acts(df: DataFrame, prefix: str, name: str, title: Column, mode: Column, state: str, refs: Column) -> DataFrame:
        return df.select(ident(prefix, "_key").alias("id"), title.alias("title"), mode.alias("mode"), "processor", F.col(state).alias("state"), F.filter(refs, lambda x: F.coalesce(x, F.lit("")) != "").alias("refs"), (F.col("standing") if "standing" in df.columns else F.array().cast("array<string>")).alias("standing"), *source(name))

    lit, key = F.lit, F.col("_key")
    records = _party(people, t["decision_records"], "proposer_id", "processor")
    standing = d.where("mode = 'set_standing' AND answer = 'yes'").select(F.col("_key").alias("disposition_id"))
    in_force = t["directives"].join(standing, "disposition_id", "left_semi").groupBy(F.col("target_run_id").alias("_key")).agg(F.array_sort(F.collect_set("disposition_id")).alias("standing"))
    harness = agent(t["harness_runs"].join(in_force, "_key", "left").withColumn("standing", F.coalesce("standing", F.array().cast("array<string>"))))
    ratified = t["ratifications"].groupBy(F.col("proposal_id").alias("_key")).agg(F.max_by("verdict", "_ord").alias("verdict"))
    offers = agent(t["proposals"].join(ratified, "_key", "left").withColumn("verdict", F.coalesce("verdict", lit("draft"))))
    automatic = lambda c: t[c].withColumn("processor", lit(EXECUTOR))
    base = union(
        acts(records, "act-dr", "decision_records", F.coalesce(F.nullif(F.col("matter"), lit("")), F.concat(lit("decision record "), key)), lit("explicit"), "verdict", F.concat(F.array_sort("premises"), F.array("disposition_id"))),
        acts(harness, "act-hr", "harness_runs", F.format_string("harness run %s (%s)", key, "authority_scope"), F.when(F.size("standing") > 0, "implicit").otherwise("explicit"), "state", F.array("principal_id", "session_id")),
        acts(automatic("automaton_runs"), "act-ar", "automaton_runs", F.concat(lit("automaton run "), key), lit("automatic"), "state", F.array("runbook_id", "parent_flow_run_id", "flow_state_id")),
        acts(automatic("flow_runs"), "act-fr", "flow_runs", F.concat(lit("flow run "), key), lit("automatic"), "state", F.array("flow_id", "current_state_id")),
        acts(offers, "act-proposal", "proposals", F.col("text"), lit("explicit"), "verdict", F.array().cast("array<string>")),
    )

    # The act that a disposition belongs to: a record's, else a run's, else its own.
    first = lambda df, by, order, value: df.groupBy(by).agg(F.min_by(value, order).alias("pick"))
    record = first(t["decision_records"].where("disposition_id IS NOT NULL"), "disposition_id", natural_key(key), "_key").select(F.col("disposition_id").alias("_key"), F.col("pick").alias("record"))
    directive = first(t["directives"].where("disposition_id IS NOT NULL"), "disposition_id", "_key", "target_run_id").select(F.col("disposition_id").alias("_key"), F.col("pick").alias("run1"))
    veto = keyed(t["local_vetoes"], "veto_id", directive_id="directive_id").join(keyed(t["directives"], "directive_id", run2="target_run_id"), "directive_id").select("veto_id", "run2")
    promo = first(t["promotions"].join(keyed(t["artifacts"], "artifact_id", run_id="run_id"), "artifact_id"), "disposition_id", "_key", "run_id").select(F.col("disposition_id").alias("_key"), F.col("pick").alias("run3"))
    real = t["harness_runs"].select(F.col("_key").alias("target"), lit(True).alias("real"))
    placed = (
        d.join(record, "_key", "left").join(directive, "_key", "left").join(veto, "veto_id", "left").join(promo, "_key", "left")
        .withColumn("target", F.coalesce("run1", "run2", "run3")).join(real, "target", "left")
    )
    placed = _party(people, _party(people, placed, "proposer_id", "processor"), "disposer_id", "signer")
    alone = F.col("record").isNull() & F.col("real").isNull()
    placed = placed.withColumn("act", F.when(F.col("record").isNotNull(), ident("act-dr", "record")).when(F.col("real"), ident("act-hr", "target")).otherwise(ident("act-disp", "_key")))
    own = acts(placed.where(alone), "act-disp", "dispositions", F.col("text"), lit("explicit"), "status", F.array().cast("array<string>"))
    subject = F.when(F.col("mode") == "triage", ident("escalation-dis", F.coalesce(F.nullif(F.col("disclosure_ref"), lit("")), lit("none")))).when(F.col("record").isNotNull(), ident("proposal-dr", "record")).otherwise(ident("proposal-disp", "_key"))
    released = t["promotions"].select(F.col("disposition_id").alias("_key"), lit(True).alias("released")).distinct()
    placed = placed.withColumn("subject", subject).join(released, "_key", "left")

    none = lit(None).cast("string")
    body = lambda c: F.concat(lit(f"{system}:{c}/"), key).alias("body_ref")
    proposals = union(
        records.select(ident("proposal-dr", "_key").alias("id"), ident("act-dr", "_key").alias("act"), F.col("processor").alias("author"), body("decision_records"), none.alias("artifact_hash"), *source("decision_records")),
        offers.select(ident("proposal-pr", "_key").alias("id"), ident("act-proposal", "_key").alias("act"), F.col("processor").alias("author"), body("proposals"), none.alias("artifact_hash"), *source("proposals")),
        placed.where((F.col("mode") != "triage") & F.col("record").isNull()).select(F.col("subject").alias("id"), "act", F.col("processor").alias("author"), F.col("action_ref").alias("body_ref"), F.col("state_ref").alias("artifact_hash"), *source("dispositions")),
    )
    basis = F.when((F.col("mode") == "authorize") & F.col("released"), "release").when(F.col("mode") == "set_standing", "mandate").otherwise("per-act")
    signatures = placed.where("answer IS NOT NULL").select(
        ident("countersignature", "_key").alias("id"), "subject", "signer", "answer", basis.alias("basis"), "text", F.col("state_ref").alias("bound_hash"), "answer_source", *source("dispositions"))

    heirs = d.where("supersedes_disposition_id IS NOT NULL").select(F.col("supersedes_disposition_id").alias("old"), F.col("_key").alias("heir"))
    heirs = heirs.groupBy("old").agg(F.array_sort(F.collect_list("heir")).alias("superseded_by")).withColumnRenamed("old", "_key")
    mandates = d.where("mode = 'set_standing' AND answer = 'yes'").join(heirs, "_key", "left").select(
        ident("mandate", "_key").alias("id"), F.coalesce("standing_domain", lit("")).alias("event_class"), ident("countersignature", "_key").alias("countersignature"),
        F.coalesce("superseded_by", F.array().cast("array<string>")).alias("superseded_by"), F.col("supersedes_disposition_id").alias("supersedes"), *source("dispositions"))

    hashes = t["releases"].select("_key", F.posexplode_outer(F.array_sort("artifact_ids")).alias("i", "artifact_id")).join(keyed(t["artifacts"], "artifact_id", content_hash="content_hash"), "artifact_id", "left")
    hashes = hashes.groupBy("_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("content_hash", lit("")).alias("h")))), lambda x: x["h"]), ",").alias("hash"))
    promotion = t["promotions"].groupBy(F.col("release_version").alias("version")).agg(F.min(F.struct("_key", "disposition_id")).alias("p"))
    signed = signatures.select(F.col("source_id").alias("disposition"), F.col("id").alias("countersignature"))
    releases = (
        t["releases"].join(hashes, "_key", "left").join(promotion, "version", "left").withColumn("disposition", F.col("p.disposition_id")).join(signed, "disposition", "left")
        .select(ident("release", "_key").alias("id"), F.concat(lit(f"{system}:artifacts/"), F.array_join(F.array_sort("artifact_ids"), ",")).alias("definition_ref"), "version", F.coalesce("hash", lit("")).alias("hash"), "countersignature", *source("releases"))
    )
    at = F.concat(lit("seq:"), F.col("seq").cast("string")).alias("at")
    events = union(
        t["automaton_events"].select(ident("event-ae", "_key").alias("id"), ident("act-ar", "run_id").alias("act"), "seq", F.to_json(F.struct("kind", "payload")).alias("payload"), at, *source("automaton_events")),
        t["flow_transition_events"].select(ident("event-fte", "_key").alias("id"), ident("act-fr", "flow_run_id").alias("act"), "seq", F.to_json(F.struct("from_state_id", "to_state_id", "trigger", "payload")).alias("payload"), at, *source("flow_transition_events")),
    )
    opened = placed.where("mode = 'triage'").groupBy(F.col("disclosure_ref").alias("ref")).agg(F.min_by("act", "_key").alias("opens"))
    escalations = t["disclosures"].join(opened, F.col("_key") == F.col("ref"), "left").select(ident("escalation-dis", "_key").alias("id"), F.concat(lit(f"ext:{system}-disclosure-"), "_key").alias("from"), F.format_string("%s: %s", "kind", "text").alias("reason"), "opens", *source("disclosures"))
    return {"parties": parties, "acts": base.unionByName(own), "proposals": proposals, "countersignatures": signatures, "mandates": mandates, "releases": releases, "events": events, "escalations": escalations}


def check(p: Mapping[str, DataFrame], schema: Mapping[str, Mapping] | None = None) -> DataFrame:
    """``kind, id, message`` of what is wrong with the projected tables (message texts fixed).

    ``schema``: a JSON schema for the rows of some tables.  Rows that break it are told
    alone and first; only sound tables are checked against one another.
    """
    if schema:
        parts = [p[k].select(F.lit(k).alias("kind"), "id", F.explode(documents.errors(F.to_json(F.struct(*(F.col(f"`{c}`") for c in p[k].columns)), {"ignoreNullFields": "false"}), s)).alias("message")) for k, s in schema.items()]
        broken = settled(union(*parts))
        if not broken.isEmpty():
            return broken
    out = []

    def bad(df: DataFrame, kind: str, message: Column) -> None:
        out.append(df.select(F.lit(kind).alias("kind"), F.col("id"), message.alias("message")))

    def known(names: Sequence[str], field: str) -> DataFrame:
        return union(*(p[x].select(F.col("id").alias(field)) for x in names)).distinct()

    every = union(*(df.select(F.lit(k).alias("kind"), "id") for k, df in p.items()))
    twice = every.groupBy("id").agg(F.min("kind").alias("kind"), F.count("*").alias("n")).where("n > 1")
    out.append(twice.select("kind", "id", F.format_string("duplicate ids: ['%s']", "id").alias("message")))
    kinds = p["parties"].groupBy(F.col("id").alias("party")).agg(F.max("kind").alias("party_kind"))
    acts = p["acts"].join(kinds, F.col("processor") == F.col("party"), "left").withColumn("wanted", F.when(F.col("mode") == "automatic", "executor").otherwise("agent"))
    bad(acts.where(~F.col("party_kind").eqNullSafe(F.col("wanted"))), "acts", F.format_string("%s: processor %s (%s) is not the %s a %s act requires", "id", "processor", F.coalesce("party_kind", F.lit("None")), "wanted", "mode"))
    for kind, field, allowed, text in (("proposals", "author", "agent", "author %s is not an agent"), ("countersignatures", "signer", "human", "signer %s is not human")):
        rows = p[kind].join(kinds, F.col(field) == F.col("party"), "left").where(~F.col("party_kind").eqNullSafe(allowed))
        bad(rows, kind, F.format_string(f"%s: {text}", "id", field))
    for kind, field, targets, may_be_null in (
        ("proposals", "act", ("acts",), False), ("countersignatures", "subject", ("proposals", "escalations"), False), ("events", "act", ("acts",), False),
        ("mandates", "countersignature", ("countersignatures",), True), ("releases", "countersignature", ("countersignatures",), True),
    ):
        rows = p[kind].where(F.col(field).isNotNull()) if may_be_null else p[kind]
        bad(rows.join(known(targets, field), field, "left_anti"), kind, F.format_string(f"%s: {field} %s unresolved", "id", F.coalesce(field, F.lit("None"))))
    bad(p["escalations"].where(~F.coalesce(F.startswith("from", F.lit("ext:")), F.lit(False))).join(known(("acts",), "from"), "from", "left_anti"), "escalations", F.format_string("%s: from %s unresolved", "id", F.coalesce("from", F.lit("None"))))
    explicit = p["acts"].where("mode = 'explicit'").select(F.col("id").alias("opens")).distinct()
    bad(p["escalations"].where("opens IS NOT NULL").join(explicit, "opens", "left_anti"), "escalations", F.format_string("%s: opens %s, not an explicit act", "id", "opens"))
    return union(*out)


def counts(p: Mapping[str, DataFrame]) -> DataFrame:
    return union(*(df.agg(F.count("*").alias("n")).select(F.lit(k).alias("entity"), "n") for k, df in p.items()))


def ordered(df: DataFrame) -> DataFrame:
    """With ``pos``: the row's place in natural order of ids."""
    placed = positions(df.withColumn("__key", natural_key(F.col("id"))), ["__key", "id"])
    return placed.withColumn("pos", F.col("pos") - 1).drop("__key")
