import pytest
from world import changed, clean

from veriloom.plans import rules
from veriloom.sources import entities

#: rule, change, part of the message
CASES = [
    ("RI", changed("claims/c1/intent_id", "gone"), "RI: claims.c1.intent_id -> intents 'gone' missing"),
    ("RI", changed("knowledge_units/k1/evidence_ids", ["e1", "e9"]), "knowledge_units.k1.evidence_ids -> evidence 'e9' missing"),
    ("RI", changed("runbooks/rb1/release_version", "2.0"), "runbooks.rb1.release_version -> releases '2.0' missing"),
    ("I-1", changed("falsification_records/fr1/external_separator", "  "), "no surviving record with external separator (IFF1/IFF2)"),
    ("I-1", changed("materializations/m1/gate_results", {"g": True, "b": False}), "covenant gate failed"),
    ("I-1", changed("claims/c1/state", "refuted"), "claim not in survived state"),
    ("I-2 ratify", changed("dispositions/x1/proposer_id", "h1"), "proposer == disposer"),
    ("I-2 ratify", changed("dyads/d1/human_id", "h2"), "terminal authority"),
    ("I-2 ratify", changed("dispositions/x1/cta", "A/B"), "more than one CTA"),
    ("I-2 modes", changed("dispositions/x1/action_ref", ""), "authorize mode without named action_ref"),
    ("I-2 modes", changed("dispositions/x2/standing_domain", None), "without standing_domain"),
    ("I-2 modes", changed("dispositions/x2", mode="overrule", veto_id="v9"), "overrule cites unknown veto v9"),
    ("I-2 modes", changed("dispositions/x2", mode="triage"), "triage mode without disclosure_ref"),
    ("I-2 modes", changed("dispositions/x1/state_ref", None), "without state binding (E2)"),
    ("I-2 modes", changed("dispositions/x1", response="counter"), "counter response without counter text"),
    ("I-2 modes", changed("dispositions/x1", response="counter", counter_text="c"), "cannot be approved (E3)"),
    ("I-2 modes", changed("dispositions/x1", response="yes", status="proposed"), "affirmed disposition left proposed"),
    ("I-2 modes", changed("dispositions/x1", absorbed_into_directive_id="di1"), "absorption is an overrule pattern"),
    ("I-2 triage", changed("disclosures/q1", dyad_id="d1", kind="error", text="t", status="dismissed"), "status dismissed without its triage disposition"),
    ("I-2 overrule", changed("local_vetoes/v1", principal_id="pr1", directive_id="di1", status="overruled"), "veto v1: status overruled without a backing"),
    ("I-2 null option", {**changed("decision_records/dr1", selected="decide nothing", options=["decide nothing"], disposition_id="x2"), "dispositions": changed("dispositions/x2", mode="triage")["dispositions"]}, "silence is not an outcome"),
    ("I-3", changed("knowledge_units/k2", claim_id="c1", ledger_id="l1", canonical_home="home/1"), "knowledge unit k2: canonical_home 'home/1' already held by k1"),
    ("I-4", changed("playbooks/p1/play_keep", " "), "exactly three plays"),
    ("I-5", changed("briefings/br1/artifact_ref", ""), "no checkable artifact"),
    ("I-5", changed("ratifications/ra1/verdict", "returned_to_draft"), "without its failure attached"),
    ("I-6", changed("ledger_entries/le1/kind", "note"), "committed without an atomic ledger commit entry"),
    ("I-6", changed("sessions/s1/falsifiable_claim", ""), "no falsifiable claim"),
    ("I-7", changed("conditions/co1/satisfied", False), "unsatisfied required conditions"),
    ("I-7", changed("gate_checks/gc1/verdict", "rejected"), "gate check not passed (no bypass)"),
    ("I-8", changed("releases/re2", version="1.0.0"), "duplicate AutomatonRelease version"),
    ("I-8", changed("artifacts/ar1/content_hash", "new"), "authorization stale or unbound"),
    ("I-8", changed("playbooks/p1/domain", "other"), "domain 'docs' has no dyad playbook"),
    ("I-9", changed("harness_runs/r3", principal_id="pr1"), "more than one non-closed execution run (r1, r3)"),
    ("I-10", changed("steps/st2", runbook_id="rb1", seq=1, expr="True", tool_id="to1"), "duplicate step seq 1"),
    ("I-11", changed("decision_records/dr1/premises", ["nowhere"]), "premise cites missing record nowhere"),
    ("I-11", changed("dispositions/x1/status", "proposed"), "premise cites undecided disposition x1"),
    ("I-12", changed("decision_records/dr1/separator_id", ""), "dialectic without designated separator"),
    ("I-12", changed("decision_records/dr1/separator_id", "a1"), "self-separation must be labeled rehearsal"),
    ("I-13 bar", {**changed("harness_runs/r2/state", "closed"), "disclosures": {"q1": {"dyad_id": "d1", "kind": "error", "text": "t", "seq": 4}}}, "closed with undisposed backlog disclosure q1 (seq 4 < open_seq 10)"),
    ("I-13 orphan", {**changed("harness_runs/r2/state", "closed"), "disclosures": {"q1": {"dyad_id": "d1", "kind": "error", "text": "t", "seq": 12}, "q2": {"dyad_id": "d1", "kind": "conflict", "text": "t", "seq": 13}}}, "2 open disclosure(s) with no non-closed governance run draining (q2, q1)"),
    ("I-14", changed("flow_transitions/tr3/trigger", "external"), "no run_aborted transition"),
    ("I-14", changed("flow_states/w/runbook_id", "rb1"), "wait state w: runbook_id must be None"),
    ("I-14", changed("flow_states/z/outcome", "odd"), "got 'odd'"),
    ("I-15", changed("flow_transitions/tr4", flow_id="fl1", from_state_id="w", trigger="timer", to_state_id="z"), "2 guardless transitions"),
    ("I-16", changed("flow_runs/fr/current_state_id", "k"), "closed as done outside an end state (in k)"),
    ("I-17", changed("decision_records/dr1", playbook="own-mutation-playbook", rung="odd"), "unknown rung 'odd'"),
    ("I-17", changed("decision_records/dr1", playbook="own-mutation-playbook", rung="fork", touches_trust_boundary=True), "no voided_guarantees declared"),
    ("STEP-POLICY", changed("flow_states/k/step_policy", "retry:0"), "malformed step_policy 'retry:0'"),
    ("STEP-POLICY", changed("flow_states/k/step_policy", None), "step_policy required"),
    ("I-2 supersession", changed("dispositions/x2/supersedes_disposition_id", "x2"), "supersession cycle at x2"),
    ("I-2 supersession", changed("dispositions/x3", dyad_id="d1", text="t", hat_id="hat1", proposer_id="a1", disposer_id="h1", status="approved", mode="set_standing", standing_domain="docs"), "2 supersession roots"),
]


def messages(spark, doc, only=()):
    return [r.message for r in rules.validate(entities.from_dict(spark, doc), only, mutation_playbook="own-mutation-playbook").orderBy("rule_ord", "sub").collect()]


def test_clean_document_has_no_violation(spark):
    assert messages(spark, clean()) == []


@pytest.mark.parametrize("rule,doc,part", CASES)
def test_violation(spark, rule, doc, part):
    assert any(part in m for m in messages(spark, doc, [rule]))


def test_good_policies(spark):
    for good in ("retry: 3", "retry:+3", "retry:1_0", "skip", "abort"):
        assert messages(spark, changed("flow_states/k/step_policy", good), ["STEP-POLICY"]) == []


def test_longer_chain_is_clean(spark):
    base = dict(dyad_id="d1", text="t", hat_id="hat1", proposer_id="a1", disposer_id="h1", status="approved", mode="set_standing", standing_domain="docs")
    doc = changed("dispositions/x3", **base, supersedes_disposition_id="x2")
    doc["dispositions"]["x4"] = {**base, "supersedes_disposition_id": "x3"}
    assert messages(spark, doc, ["I-2 supersession"]) == []


def test_unknown_collection_and_key(spark):
    with pytest.raises(ValueError):
        entities.from_dict(spark, {"nothing": {}})
    with pytest.raises(KeyError):
        entities.lookup(entities.from_dict(spark, clean()), "humans", "nobody")


def test_references_are_one_join_of_as_many_tasks_as_they_need(spark, monkeypatch):
    from veriloom.plans import entity_queries
    from veriloom.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 20, raising=False)
    claims = entity_queries.made(spark.range(300), "claims", "concat('c', id)", "id", dyad_id="concat('d', id % 100)")
    dyads = entity_queries.made(spark.range(50), "dyads", "concat('d', id)", "id")
    found = rules.validate(entity_queries.world(spark, claims=claims, dyads=dyads), ["RI"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert found.rdd.getNumPartitions() > 40
    assert sorted(r.subject for r in found.collect()) == sorted(f"c{i}" for i in range(300) if i % 100 >= 50)
