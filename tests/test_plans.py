import pytest
from pyspark.sql import functions as F
from world import changed, clean

from veriloom.plans import decisions, project, rules
from veriloom.sources import entities


def rows(df):
    return {r.id: (r.ok, r.reason) for r in df.collect()}


def test_apply_directives(spark):
    t = entities.from_dict(spark, clean())
    assert rows(decisions.apply_directives(t)) == {"di1": (True, "ok")}
    assert rows(decisions.apply_directives(t, spark.createDataFrame([("zz",)], "id string"))) == {"zz": (False, "directive missing")}
    doc = changed("gate_checks/gc2", directive_id="di1", target_run_id="r1", verdict="rejected")
    assert "no passed gate check" in rows(decisions.apply_directives(entities.from_dict(spark, doc)))["di1"][1]
    veto = changed("local_vetoes/v1", principal_id="pr1", directive_id="di1", status="upheld")
    assert rows(decisions.apply_directives(entities.from_dict(spark, veto)))["di1"] == (False, "local veto v1 upheld — directive rejected")
    veto["authority_policies"] = {"p": {"scope": "s", "on_conflict": "fleet_wins"}}
    assert rows(decisions.apply_directives(entities.from_dict(spark, veto)))["di1"][0]


def test_close_and_materialize(spark):
    t = entities.from_dict(spark, changed("conditions/co1/satisfied", False))
    assert rows(decisions.close_runs(t)) == {"r1": (False, "required conditions unsatisfied: ['co1']"), "r2": (True, "ok")}
    t = entities.from_dict(spark, changed("falsification_records/fr1/outcome", "refuted"))
    assert not rows(decisions.materialize(t))["c1"][0]
    assert rows(decisions.materialize(t, spark.createDataFrame([("q",)], "id string")))["q"] == (False, "claim missing")


@pytest.mark.parametrize("doc,ask,part", [
    (clean(), ("ar1", "1.0.0", "x1"), "already exists"), (clean(), ("none", "2", "x1"), "artifact missing"), (clean(), ("ar1", "2", "none"), "Operator disposition"),
    (clean(), ("ar1", "2", "x2"), "needs an AUTHORIZE-mode"), (changed("dispositions/x1/status", "proposed"), ("ar1", "2", "x1"), "approved AUTHORIZE"),
    (changed("artifacts/ar1/content_hash", "z"), ("ar1", "2", "x1"), "stale"), (changed("playbooks/p1/domain", "z"), ("ar1", "2", "x1"), "playbook before automation"), (clean(), ("ar1", "2", "x1"), "ok"),
])
def test_promote(spark, doc, ask, part):
    asked = spark.createDataFrame([("q", *ask)], "id string, artifact_id string, version string, disposition_id string")
    assert part in rows(decisions.promote(entities.from_dict(spark, doc), asked))["q"][1]


def test_silence(spark):
    assert spark.range(1).select(decisions.silence(F.lit("triage")).alias("x")).first().x == "outcome_refused"


def test_queue_view(spark):
    doc = clean()
    doc["disclosures"] = {k: {"dyad_id": "d1", "kind": kind, "text": "t", "seq": s} for k, kind, s in (("q1", "uncertainty", 9), ("q2", "error", 3), ("q3", "conflict", 5))}
    doc["dispositions"]["x9"] = {**doc["dispositions"]["x2"], "mode": "triage", "status": "proposed", "disclosure_ref": "q2"}
    view = rules.open_queue(entities.from_dict(spark, doc)).orderBy("pos").collect()
    assert [(r.id, r.triage_in_flight) for r in view] == [("q3", False), ("q2", True), ("q1", False)]


def test_projection(spark):
    p = project.project(entities.from_dict(spark, clean()))
    assert project.check(p).collect() == []
    n = {r.entity: r.n for r in project.counts(p).collect()}
    assert n == {"parties": 3, "acts": 6, "proposals": 4, "countersignatures": 2, "mandates": 1, "releases": 1, "events": 1, "escalations": 0}
    by = {r.id: r for r in p["countersignatures"].collect()}
    assert by["countersignature-x1"].basis == "release" and by["countersignature-x2"].basis == "mandate"
    assert p["releases"].first().hash == "h" and p["acts"].where("id = 'act-hr-r1'").first().mode == "explicit"
    broken = project.project(entities.from_dict(spark, changed("dispositions/x2/disposer_id", "nobody")))
    assert any("signer" in r.message for r in project.check(broken).collect())
    assert [r.id for r in project.ordered(p["acts"]).orderBy("pos").collect()][0].startswith("act-d")


def test_document_round_trip(spark, tmp_path):
    t = entities.from_dict(spark, clean())
    entities.write_document(t, str(tmp_path / "doc.json"))
    again = entities.read_document(spark, str(tmp_path / "doc.json"))
    assert rules.validate(again, ["RI", "I-8"]).collect() == []
    assert [r._key for r in again["flow_states"].orderBy("_ord").collect()] == ["w", "k", "z"]


def test_standing_dispositions_of_runs(spark):
    doc = changed("directives/di9", source_run_id="r1", target_run_id="r1", action="steer", disposition_id="x2")
    doc["directives"]["di8"] = {**doc["directives"]["di9"]}
    acts = {r.id: r for r in project.project(entities.from_dict(spark, doc))["acts"].collect()}
    assert (acts["act-hr-r1"].mode, acts["act-hr-r1"].standing) == ("implicit", ["x2"]) and acts["act-hr-r2"].standing == []


def test_projection_checks(spark):
    p = project.project(entities.from_dict(spark, changed("disclosures/q1", dyad_id="d1", kind="error", text="t", seq=4)))
    assert p["escalations"].first()["from"] == "ext:local-disclosure-q1"
    put = lambda table, **values: {**p, table: p[table].withColumns({c: F.lit(v) for c, v in values.items()})}
    found = lambda q, schema=None: {r.message for r in project.check(q, schema).collect()}
    assert found(p) == set()
    human = p["parties"].where("kind = 'human'").first().id
    assert any(m.endswith(f"processor {human} (human) is not the agent a explicit act requires") for m in found(put("acts", processor=human)))
    assert any(m.endswith(f"author {human} is not an agent") for m in found(put("proposals", author=human)))
    assert any(m.endswith("from act-none unresolved") for m in found(put("escalations", **{"from": "act-none"})))
    run = p["acts"].where("mode = 'automatic'").first().id
    assert found(put("escalations", opens=run)) == {f"escalation-dis-q1: opens {run}, not an explicit act"}
    assert any("duplicate ids" in m for m in found({**p, "acts": p["acts"].union(p["acts"])}))
    schema = {"parties": {"type": "object", "properties": {"kind": {"enum": ["agent", "executor"]}}}}
    assert found(put("proposals", author=human), schema) == {"/kind: not in enum"} and found(p, {"acts": {"type": "object"}}) == set()
