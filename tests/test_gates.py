import json
import random

import pytest
from pyspark.sql import functions as F

from veriloom.operators import gates


@pytest.mark.parametrize("parts", [None, 7])
def test_as_of(spark, parts):
    rng = random.Random(4)
    left = [(i, rng.choice(["a", "b", None]), rng.randint(0, 60)) for i in range(80)]
    right = [(rng.choice(["a", "b", "c", None]), rng.randint(0, 60), rng.choice([None, "x", "é\""]), i) for i in range(40)]
    a, b = spark.createDataFrame(left, "id int, k string, at bigint"), spark.createDataFrame(right, "k string, since int, v string, w int")
    got = {r.id: (r.v, r.w) for r in gates.as_of(a, b, ["k"], "at", ["w", "v"], since="since", parts=parts).collect()}
    row = lambda r: json.dumps({"w": r[3], "v": r[2]}, separators=(",", ":"), ensure_ascii=False)
    for i, k, at in left:
        best = max((r for r in right if r[0] == k and r[1] <= at), key=lambda r: (r[1], row(r)), default=(None,) * 4)
        assert got[i] == (best[2], best[3]), (i, k, at)


REQUEST = ("q", "assess", '{"subject": "s"}', ["verdict"], "judge", "h", list(gates.REQUEST_FIELDS))


def requested(spark, **change):
    names = [*gates.REQUEST_FIELDS, "fields"]
    row = [change.get(n, v) for n, v in zip(names, REQUEST)]
    return spark.createDataFrame([tuple(row)], "request_id string, request_type string, input string, output_contract array<string>, role string, role_hash string, fields array<string>")


SHAPE = {"assess": {"type": "object", "required": ["subject"], "properties": {"subject": {"type": "string"}}, "additionalProperties": False}}


@pytest.mark.parametrize("change,rule", [
    ({}, None), ({"output_contract": []}, None), ({"request_type": "evaluate"}, "R1"), ({"input": "{}"}, "R2"), ({"input": '{"subject": "s", "also": 1}'}, "R2"), ({"output_contract": ["verdict", "code"]}, "R3"),
    ({"role": "nobody"}, "R4"), ({"role_hash": "z"}, "R4"), ({"fields": [*gates.REQUEST_FIELDS, "instruction"]}, "R5"), ({"request_type": "goal", "output_contract": []}, None), ({"request_type": "goal"}, "R3"),
])
def test_issuance(spark, change, rule):
    kinds = spark.createDataFrame([("assess", "verdict"), ("assess", "note"), ("goal", None)], "request_type string, kind string")
    roles = spark.createDataFrame([("judge", "h")], "role string, role_hash string")
    got = gates.issuance(requested(spark, **change), kinds, roles, SHAPE).collect()
    assert [(r.id, r.rule) for r in got] == ([("q", rule)] if rule else [])


@pytest.mark.parametrize("artifact,response,rules", [
    ({}, {}, []), ({"kind": "code"}, {}, ["I1"]), ({"request_ref": "p"}, {}, ["I2"]), ({"disposition_ref": "no"}, {}, ["I2"]), ({}, {"cites": None}, ["I3"]), ({}, {"disposition_ref": None}, ["I3"]),
    ({}, {"result": "[]"}, ["I3"]), ({}, {"refusal": True, "disposition_ref": None, "result": None}, []),
])
def test_ingest(spark, artifact, response, rules):
    a = {"request_id": "q", "name": "v.json", "kind": "verdict", "request_ref": "q", "disposition_ref": "d"} | artifact
    r = {"request_id": "q", "cites": "q", "disposition_ref": "d", "refusal": False, "result": '{"ok": true}'} | response
    arts = spark.createDataFrame([tuple(a.values())], "request_id string, name string, kind string, request_ref string, disposition_ref string")
    told = spark.createDataFrame([tuple(r.values())], "request_id string, cites string, disposition_ref string, refusal boolean, result string")
    got = gates.ingest(requested(spark), arts, told, spark.createDataFrame([("d",)], "disposition_id string"), {"assess": {"type": "object"}})
    assert [x.rule for x in got.collect()] == rules
    assert gates.exit_codes(told, got).first().code == (4 if r["refusal"] else 1 if rules else 0)


CLEAN = {
    "drafts": ("draft_id string, turn_id string, reason_status string, touches_trust_boundary boolean, machinery string, verifier_version string", [("d", "t", "accepted", False, None, None)]),
    "verifications": ("verification_id string, draft_id string, build_id string, passed boolean, abstained boolean", [("v", "d", "b", True, False)]),
    "builds": ("build_id string, first_hash string, second_hash string, inference boolean, hermetic boolean", [("b", "h", "h", False, True)]),
    "contents": ("build_id string, draft_id string", [("b", "d")]),
    "states": ("build_id string, seq bigint, hash string", [("b", 1, "g"), ("b", 3, "h")]),
    "dispositions": ("disposition_id string, subject string, kind string, mode string, hash string, verification_id string, acknowledges array<string>, impact string", [("x", "d", "buildability", "ratify", None, None, None, None), ("y", "b", "authorize", "authorize", "h", "v", None, None)]),
    "promotions": ("build_id string, disposition_id string, seq bigint", [("b", "y", 5)]),
    "attempts": ("build_id string, seq bigint, failed boolean, environment_fault boolean", [("b", 1, True, True), ("b", 2, False, False)]),
    "amendments": ("machinery string, version string, seq bigint", [("m", "1", 1), ("m", "2", 10)]),
    "matters": ("matter_id string, machinery string, seq bigint, version string", [("q", "m", 9, "1"), ("r", "m", 10, "2")]),
}


@pytest.mark.parametrize("table,rows,rules", [
    ("drafts", CLEAN["drafts"][1], []), ("verifications", [("v", "d", "b", False, False)], ["I-F1"]), ("dispositions", CLEAN["dispositions"][1][1:], ["I-F1"]), ("builds", [("b", "h", "i", False, True)], ["I-F2"]),
    ("builds", [("b", "h", "h", True, None)], ["I-F2", "I-F2"]), ("states", [("b", 1, "h"), ("b", 4, "changed")], ["I-F3"]), ("states", [("b", 1, "h"), ("b", 6, "later")], []), ("promotions", [("b", "x", 5)], ["I-F3", "I-F3"]),
    ("drafts", [("d", "t", "pending", False, None, None)], ["I-F4"]), ("drafts", [("d", " ", "accepted", False, None, None), ("e", None, "accepted", False, None, None)], ["I-F5"]), ("contents", [("b", "d"), ("b", "gone")], ["I-F1", "I-F1", "I-F5"]),
    ("verifications", [("v", "d", "b", True, False), ("w", "z", "b", True, True)], ["I-F6"]), ("drafts", [("d", "t", "accepted", True, "m", None)], ["I-F7", "I-F7"]), ("matters", [("q", "m", 9, "2"), ("s", "m", 0, None)], ["I-F8"]),
    ("attempts", [("b", 1, True, False), ("b", 4, False, None)], ["I-F9"]),
])
def test_factory_gates(spark, table, rows, rules):
    t = {k: spark.createDataFrame(rows if k == table else r, s) for k, (s, r) in CLEAN.items()}
    assert sorted(r.rule for r in gates.factory(t).collect()) == rules


def test_overrule_acknowledges(spark):
    rows = [CLEAN["dispositions"][1][0], ("y", "b", "authorize", "overrule", "h", "v", ["pending", "abstention"], "voids nothing")]
    more = {"dispositions": rows, "drafts": [("d", "t", "pending", True, "m", "1")], "verifications": [("v", "d", "b", True, False), ("w", "z", "b", True, True)]}
    t = {k: spark.createDataFrame(more.get(k, r), s) for k, (s, r) in CLEAN.items()}
    assert gates.factory(t).collect() == [] and gates.factory({k: df.where(F.lit(False)) for k, df in t.items()}).collect() == []
