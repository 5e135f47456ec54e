"""A small clean entity document, and a way to change it."""

import copy


def clean() -> dict:
    return copy.deepcopy({
        "humans": {"h1": {"name": "Ada"}},
        "agents": {"a1": {"name": "Bot"}},
        "dyads": {"d1": {"name": "pair", "human_id": "h1", "agent_id": "a1", "birth_id": "b", "constitution_ref": "c"}},
        "intents": {"i1": {"dyad_id": "d1", "text": "t"}},
        "claims": {"c1": {"dyad_id": "d1", "intent_id": "i1", "text": "t", "state": "survived", "canonical_home": "home/1"}},
        "falsifiers": {"f1": {"claim_id": "c1", "kind": "audit", "description": "d"}},
        "falsification_records": {"fr1": {"claim_id": "c1", "falsifier_id": "f1", "method": "m", "outcome": "survived", "external_separator": "other", "ts": "t"}},
        "evidence": {"e1": {"record_id": "fr1", "kind": "k", "ref": "r"}},
        "ledgers": {"l1": {"dyad_id": "d1"}},
        "knowledge_units": {"k1": {"claim_id": "c1", "ledger_id": "l1", "evidence_ids": ["e1"], "canonical_home": "home/1", "stage": "kb"}},
        "materializations": {"m1": {"claim_id": "c1", "gate_results": {"g": True}, "verdict": "materialized"}},
        "playbooks": {"p1": {"dyad_id": "d1", "domain": "docs", "play_start": "a", "play_stop": "b", "play_keep": "c", "origin": "dyad"}},
        "hats": {"hat1": {"dyad_id": "d1", "name": "n", "seat": "s"}},
        "sessions": {"s1": {"dyad_id": "d1", "kind": "workstream", "owner_id": "h1", "boundary": "b", "falsifiable_claim": "c"}},
        "transactions": {"t1": {"session_id": "s1", "state": "committed", "ops": ["o"]}},
        "ledger_entries": {"le1": {"ledger_id": "l1", "ts": "t", "kind": "commit", "payload": "p", "session_id": "s1", "txn_id": "t1"}},
        "principals": {"pr1": {"name": "n"}},
        "harness_runs": {
            "r1": {"principal_id": "pr1", "dyad_id": "d1", "session_id": "s1"},
            "r2": {"principal_id": "pr1", "dyad_id": "d1", "authority_scope": "governance", "open_seq": 10},
        },
        "conditions": {"co1": {"run_id": "r1", "expr": "x", "required": True, "satisfied": True}},
        "artifacts": {"ar1": {"run_id": "r1", "domain": "docs", "schema_name": "s", "instance_ref": "i", "surface_ref": "u", "content_hash": "h"}},
        "briefings": {"br1": {"dyad_id": "d1", "session_id": "s1", "artifact_ref": "ar1"}},
        "proposals": {"po1": {"dyad_id": "d1", "text": "t", "criteria": ["c"]}},
        "ratifications": {"ra1": {"proposal_id": "po1", "verdict": "ratified"}},
        "dispositions": {
            "x1": {"dyad_id": "d1", "text": "t", "hat_id": "hat1", "proposer_id": "a1", "disposer_id": "h1", "cta": "Y/N", "status": "approved", "mode": "authorize", "action_ref": "promote", "state_ref": "h"},
            "x2": {"dyad_id": "d1", "text": "t", "hat_id": "hat1", "proposer_id": "a1", "disposer_id": "h1", "status": "approved", "mode": "set_standing", "standing_domain": "docs"},
        },
        "directives": {"di1": {"source_run_id": "r2", "target_run_id": "r1", "action": "close_completed", "disposition_id": "x1"}},
        "gate_checks": {"gc1": {"directive_id": "di1", "target_run_id": "r1", "per_gate": {"g": True}, "verdict": "passed"}},
        "applications": {"ap1": {"directive_id": "di1", "gate_check_id": "gc1", "target_event_ref": "e"}},
        "releases": {"re1": {"version": "1.0.0", "artifact_ids": ["ar1"]}},
        "promotions": {"pm1": {"artifact_id": "ar1", "release_version": "1.0.0", "directive_id": "di1", "disposition_id": "x1", "preconditions_ok": True}},
        "tools": {"to1": {"name": "n"}},
        "runbooks": {"rb1": {"release_version": "1.0.0", "name": "n"}},
        "steps": {"st1": {"runbook_id": "rb1", "seq": 1, "expr": "True", "tool_id": "to1"}},
        "automaton_flows": {"fl1": {"name": "n", "release_version": "1.0.0", "initial_state_id": "w"}},
        "flow_states": {
            "w": {"flow_id": "fl1", "name": "w", "kind": "wait"},
            "k": {"flow_id": "fl1", "name": "k", "kind": "task", "runbook_id": "rb1", "step_policy": "retry:2"},
            "z": {"flow_id": "fl1", "name": "z", "kind": "end", "outcome": "completed"},
        },
        "flow_transitions": {
            "tr1": {"flow_id": "fl1", "from_state_id": "w", "trigger": "timer", "to_state_id": "k"},
            "tr2": {"flow_id": "fl1", "from_state_id": "k", "trigger": "run_completed", "to_state_id": "z"},
            "tr3": {"flow_id": "fl1", "from_state_id": "k", "trigger": "run_aborted", "to_state_id": "z"},
        },
        "flow_runs": {"fr": {"flow_id": "fl1", "current_state_id": "z", "state": "done"}},
        "flow_transition_events": {"ev1": {"flow_run_id": "fr", "seq": 1, "from_state_id": "w", "to_state_id": "k", "trigger": "timer", "payload": "{}"}},
        "decision_records": {"dr1": {"proposer_id": "a1", "verdict": "adopted", "premises": ["x1"], "dialectic": True, "separator_id": "h1"}},
    })


def changed(path: str, value=None, **fields) -> dict:
    """The clean document with ``collection/key[/field]`` set; fields are merged into the entity."""
    doc = clean()
    parts = path.split("/")
    if len(parts) == 3:
        doc[parts[0]][parts[1]][parts[2]] = value
    else:
        doc.setdefault(parts[0], {}).setdefault(parts[1], {}).update(fields)
    return doc
