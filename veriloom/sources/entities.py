"""The entity graph: fifty keyed collections of one JSON document, as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The collections, and the type of each of their fields.
COLLECTIONS = {
    "humans": {"name": "string"},
    "agents": {"name": "string"},
    "dyads": {"name": "string", "human_id": "string", "agent_id": "string", "birth_id": "string", "constitution_ref": "string"},
    "bonds": {"dyad_id": "string", "state": "string", "belief": "string"},
    "covenant_gates": {"name": "string", "test": "string"},
    "intents": {"dyad_id": "string", "text": "string", "state": "string"},
    "claims": {"dyad_id": "string", "intent_id": "string", "text": "string", "state": "string", "canonical_home": "string"},
    "falsifiers": {"claim_id": "string", "kind": "string", "description": "string"},
    "falsification_records": {"claim_id": "string", "falsifier_id": "string", "method": "string", "outcome": "string", "external_separator": "string", "ts": "string"},
    "evidence": {"record_id": "string", "kind": "string", "ref": "string"},
    "knowledge_units": {"claim_id": "string", "refutation": "string", "ledger_id": "string", "evidence_ids": "array<string>", "canonical_home": "string", "stage": "string"},
    "materializations": {"claim_id": "string", "gate_results": "map<string,boolean>", "verdict": "string"},
    "playbooks": {"dyad_id": "string", "domain": "string", "play_start": "string", "play_stop": "string", "play_keep": "string", "origin": "string"},
    "commons_playbooks": {"name": "string", "steps": "array<string>"},
    "hats": {"dyad_id": "string", "name": "string", "seat": "string"},
    "dispositions": {"dyad_id": "string", "session_id": "string", "text": "string", "hat_id": "string", "proposer_id": "string", "disposer_id": "string", "cta": "string", "status": "string", "mode": "string", "action_ref": "string", "standing_domain": "string", "veto_id": "string", "disclosure_ref": "string", "supersedes_disposition_id": "string", "state_ref": "string", "absorbed_into_directive_id": "string", "response": "string", "counter_text": "string", "reentry_ref": "string"},
    "disclosures": {"dyad_id": "string", "kind": "string", "text": "string", "status": "string", "seq": "bigint"},
    "decision_records": {"playbook": "string", "matter": "string", "options": "array<string>", "gate_trails": "array<string>", "selected": "string", "selector_id": "string", "proposer_id": "string", "verdict": "string", "consequences": "string", "uncertainties": "string", "premises": "array<string>", "dialectic": "boolean", "separator_id": "string", "thesis": "string", "antithesis": "string", "synthesis": "string", "rehearsal": "boolean", "disposition_id": "string", "rung": "string", "touches_trust_boundary": "boolean", "voided_guarantees": "array<string>", "reason": "string", "reason_status": "string"},
    "sessions": {"dyad_id": "string", "kind": "string", "state": "string", "owner_id": "string", "boundary": "string", "falsifiable_claim": "string"},
    "transactions": {"session_id": "string", "state": "string", "ops": "array<string>"},
    "ledgers": {"dyad_id": "string"},
    "ledger_entries": {"ledger_id": "string", "ts": "string", "kind": "string", "payload": "string", "session_id": "string", "txn_id": "string"},
    "subagents": {"dyad_id": "string", "name": "string", "mandate": "string", "mode": "string"},
    "briefings": {"dyad_id": "string", "session_id": "string", "artifact_ref": "string"},
    "proposals": {"dyad_id": "string", "text": "string", "criteria": "array<string>"},
    "ratifications": {"proposal_id": "string", "verdict": "string", "failure": "string"},
    "principals": {"name": "string"},
    "harness_runs": {"principal_id": "string", "dyad_id": "string", "session_id": "string", "state": "string", "closure_reason": "string", "authority_scope": "string", "open_seq": "bigint"},
    "conditions": {"run_id": "string", "expr": "string", "required": "boolean", "satisfied": "boolean"},
    "threads": {"run_id": "string", "state": "string"},
    "interaction_prefs": {"run_id": "string", "challenge_claims": "boolean", "clarify_intent": "boolean", "invoked_preference": "string"},
    "artifacts": {"run_id": "string", "domain": "string", "schema_name": "string", "instance_ref": "string", "surface_ref": "string", "content_hash": "string"},
    "strap_gates": {"run_id": "string", "required_condition_ids": "array<string>", "verdict": "string"},
    "authority_policies": {"scope": "string", "on_conflict": "string"},
    "local_vetoes": {"principal_id": "string", "directive_id": "string", "status": "string"},
    "directives": {"source_run_id": "string", "target_run_id": "string", "action": "string", "supersedes_directive_id": "string", "disposition_id": "string"},
    "gate_checks": {"directive_id": "string", "target_run_id": "string", "per_gate": "map<string,boolean>", "verdict": "string"},
    "applications": {"directive_id": "string", "gate_check_id": "string", "target_event_ref": "string"},
    "promotions": {"artifact_id": "string", "release_version": "string", "directive_id": "string", "disposition_id": "string", "preconditions_ok": "boolean"},
    "releases": {"version": "string", "artifact_ids": "array<string>"},
    "runbooks": {"release_version": "string", "name": "string"},
    "steps": {"runbook_id": "string", "seq": "bigint", "expr": "string", "tool_id": "string"},
    "tools": {"name": "string"},
    "automaton_runs": {"runbook_id": "string", "state": "string", "idempotency_key": "string", "parent_flow_run_id": "string", "flow_state_id": "string"},
    "automaton_events": {"run_id": "string", "seq": "bigint", "kind": "string", "payload": "string"},
    "automaton_flows": {"name": "string", "release_version": "string", "initial_state_id": "string"},
    "flow_states": {"flow_id": "string", "name": "string", "kind": "string", "runbook_id": "string", "outcome": "string", "step_policy": "string"},
    "flow_transitions": {"flow_id": "string", "from_state_id": "string", "trigger": "string", "guard": "string", "to_state_id": "string"},
    "flow_runs": {"flow_id": "string", "current_state_id": "string", "state": "string"},
    "flow_transition_events": {"flow_run_id": "string", "seq": "bigint", "from_state_id": "string", "to_state_id": "string", "trigger": "string", "payload": "string"},
}

#: What a field holds that a document leaves out; booleans are then false, others null.
DEFAULTS = {
    "intents": {"state": "stated"},
    "claims": {"state": "draft"},
    "knowledge_units": {"stage": "dialectic"},
    "dispositions": {"status": "proposed", "mode": "ratify"},
    "disclosures": {"status": "open", "seq": 0},
    "decision_records": {"playbook": "decision-making", "matter": "", "selector_id": "", "proposer_id": "", "verdict": "draft", "consequences": "", "uncertainties": "", "reason": ""},
    "sessions": {"state": "planned"},
    "transactions": {"state": "begun"},
    "harness_runs": {"state": "open", "authority_scope": "execution", "open_seq": 0},
    "threads": {"state": "settled"},
    "interaction_prefs": {"invoked_preference": ""},
    "artifacts": {"content_hash": ""},
    "strap_gates": {"verdict": "pending"},
    "authority_policies": {"on_conflict": "fleet_wins"},
}


def fields(collection: str) -> list[tuple[str, str, object]]:
    """(name, Spark type, default) of a collection's fields."""
    given = DEFAULTS.get(collection, {})
    return [(name, kind, given.get(name, False if kind == "boolean" else None)) for name, kind in COLLECTIONS[collection].items()]


def document_schema() -> str:
    """The DDL of the whole document: maps from key to struct."""
    return ", ".join(f"{c} map<string, struct<id:string, {', '.join(f'{n}:{k}' for n, k, _ in fields(c))}>>" for c in COLLECTIONS)


def collections(document: DataFrame) -> dict[str, DataFrame]:
    """Each collection of a one-row document as ``_key, _ord, id, fields``; defaults filled in."""
    out = {}
    for name in COLLECTIONS:
        rows = document.select(F.posexplode(F.coalesce(name, F.create_map().cast(document.schema[name].dataType))).alias("_ord", "_key", "e"))
        cols = []
        for field, kind, default in fields(name):
            value = F.col(f"e.{field}")
            if kind.startswith("array"):
                value = F.coalesce(value, F.array().cast(kind))
            elif kind.startswith("map"):
                value = F.coalesce(value, F.create_map().cast(kind))
            elif default is not None:
                value = F.coalesce(value, F.lit(default))
            cols.append(value.alias(field))
        out[name] = rows.select("_key", "_ord", F.coalesce("e.id", "_key").alias("id"), *cols)
    return out


def read_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A JSON document file as collections; keys keep the file's order."""
    return collections(spark.read.schema(document_schema()).option("multiLine", True).option("mode", "FAILFAST").json(path))


def from_dict(spark: SparkSession, state: Mapping[str, Mapping[str, Mapping]]) -> dict[str, DataFrame]:
    """Collections of a document held in memory (fixtures)."""
    unknown = set(state) - set(COLLECTIONS)
    if unknown:
        raise ValueError(f"unknown collections: {', '.join(sorted(unknown))}")
    text = spark.createDataFrame([(json.dumps(state),)], "doc string")
    return collections(text.select(F.from_json("doc", document_schema(), {"mode": "FAILFAST"}).alias("d")).select("d.*"))


def lookup(tables: Mapping[str, DataFrame], collection: str, key: str) -> DataFrame:
    """The row of a key; an unknown collection or key is an error."""
    if collection not in tables:
        raise KeyError(f"unknown collection {collection}")
    row = tables[collection].where(F.col("_key") == key)
    if row.isEmpty():
        raise KeyError(f"{collection} has no {key}")
    return row


def write_document(tables: Mapping[str, DataFrame], path: str) -> None:
    """The collections as one JSON document, in key order ``_ord``; one partition of a collection is held at a time."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
        some = False
        for name, df in tables.items():
            n = 0
            for n, row in enumerate(df.orderBy("_ord").toJSON().toLocalIterator(), 1):
                entity = json.loads(row)
                key = entity.pop("_key")
                entity.pop("_ord", None)
                if n == 1:
                    f.write(f"{',' if some else ''}\n  {json.dumps(name)}: {{")
                    some = True
                f.write(f"{',' if n > 1 else ''}\n    {json.dumps(key)}: {json.dumps(entity)}")
            if n:
                f.write("\n  }")
        f.write("\n}\n")
