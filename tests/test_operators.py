import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veriloom.functions import documents
from veriloom.operators import derive, hashing, integrity, logs, stats, transcripts
from veriloom.streaming import machine

STEPS = {0: "ctx.go", 1: "True"}


def transcript(*inputs, policy="retry:2", tools=None):
    book = machine.RunBook(((0, "set", "ctx.go"), (1, "bad", "True")), policy)
    run = machine.Run(book, tools or {"set": lambda c: {"ok": True, "ctx_delta": {"x": 1}}, "bad": lambda c: {"ok": False}})
    return list(machine._drive(run, "r", inputs))


def problems(spark, events, policy="retry:2"):
    log = spark.createDataFrame([(e["run_id"], e["seq"], e["kind"], e["payload"]) for e in events], machine.EVENTS)
    pol = spark.createDataFrame([("r", policy)], "run_id string, policy string")
    return [r.message for r in transcripts.revalidate(log, pol, STEPS).collect()]


def test_good_transcripts(spark):
    for policy in ("retry:2", "abort", "skip"):
        events = transcript(("x", "{}"), ("x", '{"go": 1}'), policy=policy)
        assert problems(spark, events, policy) == []
        assert problems(spark, events[:-1], policy) == []  # cut off: pending


def test_bad_transcripts(spark):
    events = transcript(("x", "{}"), ("x", '{"go": 1}'))
    assert any("seq gap" in m for m in problems(spark, events[:2] + events[3:]))
    assert any("unknown event kind" in m for m in problems(spark, [*events, {**events[-1], "seq": len(events), "kind": "odd"}]))
    assert any("I-28" in m for m in problems(spark, events, "skip"))
    false = [{**e, "payload": e["payload"].replace('"go": 1', '"go": 0')} for e in events]
    assert any("guard false" in m for m in problems(spark, false))
    sticky = [e for e in events if e["kind"] != "event_injected"]
    sticky = [{**e, "seq": i} for i, e in enumerate(sticky)]
    assert any("I-29" in m for m in problems(spark, sticky))
    done = [{"run_id": "r", "seq": 0, "kind": "run_created", "payload": '{"ctx": {}}'}, {"run_id": "r", "seq": 1, "kind": "run_completed", "payload": "{}"}]
    assert any("steps pending: [0, 1]" in m for m in problems(spark, done))
    lost = [done[0], {"run_id": "r", "seq": 1, "kind": "step_completed", "payload": '{"step_seq": 1}'}, {"run_id": "r", "seq": 2, "kind": "run_aborted", "payload": "{}"}]
    got = problems(spark, lost)
    assert any("no step_started" in m for m in got) and any("not via the abort policy" in m for m in got)


def test_open_runs(spark):
    runs = spark.createDataFrame([("a", "run", "open", "k"), ("b", "run", "open", "k"), ("c", "flow", "open", "k"), ("d", "run", "odd", "z")], "run_id string, kind string, state string, idempotency_key string")
    assert sorted(r.message for r in transcripts.one_open_run(runs).collect()) == ["AutomatonRun.state 'odd' not in open|completed|aborted (run d)", "I-30: idempotency key 'k' carried by two open runs (a and b)"]


def test_chains_with_cycles(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("t", "x"), ("o", "gone"), *[(f"n{i}", f"n{i - 1}" if i else None) for i in range(200)]]
    got = {r.k: (r.root, r.depth, r.cycle) for r in integrity.chains(spark.createDataFrame(rows, "k string, up string"), "k", "up", limit=1000).collect()}
    assert got["c"] == ("a", 2, False) and got["o"] == ("o", 0, False) and got["n199"] == ("n0", 199, False)
    assert all(got[k] == (None, None, True) for k in "xyt")


def test_unattended_and_queue(spark):
    q = spark.createDataFrame([("a", 2), ("b", 1)], "id string, seq int")
    assert integrity.unattended(q, q.limit(0), "id", ["seq"]).first()["items"] == ["b", "a"]
    assert integrity.unattended(q, q, "id", ["seq"]).count() == 0 and integrity.unattended(q.limit(0), q.limit(0), "id", ["seq"]).count() == 0


def test_derivation(spark):
    inputs = spark.createDataFrame([("m1", 1, "b", b"B", None), ("m1", 0, "a", b"A", hashlib.sha256(b"A").hexdigest()), ("m2", 0, "a", b"A", "0"), ("m2", 1, "z", None, None)], "manifest_id string, pos int, path string, content binary, pin string")
    manifests = spark.createDataFrame([("m1", "identity", "t"), ("m2", "identity", "t"), ("m3", "odd", "t")], "manifest_id string, derivation string, toolchain string")
    got = {r.manifest_id: r for r in derive.derive(manifests, inputs).collect()}
    assert got["m1"].ok and got["m1"].output_hash == hashlib.sha256(b"AB").hexdigest() and not got["m1"].pinned
    assert got["m2"].failures == ["pin mismatch a", "missing input z"] and got["m3"].failures == ["unknown derivation odd"]
    assert derive.reproducible(derive.derive(manifests, inputs), derive.derive(manifests, inputs), "manifest_id", "output_hash").count() == 0


def test_directory_bytes_and_canonical_json(spark):
    files = spark.createDataFrame([("d", "b", b"22"), ("d", "a", b"1")], "d string, p string, c binary")
    want = b"".join(p.encode() + b"\0f" + len(c).to_bytes(8, "big") + c for p, c in (("a", b"1"), ("b", b"22")))
    assert derive.directory_bytes(files, ["d"], "p", "c").first().sha256 == hashlib.sha256(want).hexdigest()
    row = spark.createDataFrame([(1, None, 'q"x', [1, 2])], "n int, z string, a string, l array<int>")
    assert row.select(derive.canonical_json({c: F.col(c) for c in row.columns}).alias("j")).first().j == json.dumps({"n": 1, "z": None, "a": 'q"x', "l": [1, 2]}, sort_keys=True, separators=(",", ":"))


def test_drift_and_triage(spark):
    s = "path string, h string"
    have, want = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", "9")], s), spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], s)
    assert {r.path: r.status for r in hashing.drift(have, want, "path", "h").collect()} == {"b": "diverged", "n": "diverged", "c": "missing"}
    assert {r.path: r.verdict for r in hashing.triage(have, want.where("path = 'c'"), want, "path", "h").collect()} == {"a": "delete", "b": "mutated", "n": "unknown"}


def test_coverage(spark):
    ev = spark.createDataFrame([(1, "a", "b", "t"), (2, "a", "c", "t")], "seq int, from_state_id string, to_state_id string, trigger string")
    tr = spark.createDataFrame([("t1", "a", "b", "t", None, 0), ("t2", "a", "b", "t", "g", 1)], "transition_id string, from_state_id string, to_state_id string, trigger string, guard string, ord int")
    assert [(r.transition_id, r.guard_outcome) for r in derive.event_pairs(ev, tr).orderBy("seq").collect()] == [("t2", "true"), (None, None)]
    c = spark.createDataFrame([("a", 1, False, "run_aborted", None), ("b", 0, False, None, "x"), ("c", 0, True, "timer", None), ("d", 2, None, "timer", "x")], "scenario_id string, n_new int, found_bug boolean, terminal_trigger string, disposition_ref string")
    assert {r.scenario_id: r.reason for r in derive.harden(c).collect()} == {"a": "ok", "b": "no new coverage", "c": "no standing", "d": "ok"}
    runs = spark.createDataFrame([("s1", "b1"), ("s2", "b1"), ("s3", "zz")], "scenario_id string, brief_id string")
    briefs = spark.createDataFrame([("b1", 3, 2, False)], "brief_id string, budget int, authored int, retired boolean")
    assert {r.scenario_id: r.accepted for r in derive.within_budget(runs, briefs).collect()} == {"s1": True, "s2": False, "s3": False}
    a = spark.createDataFrame([("z", "z", ["a"], None, [1, 2], [1]), ("z", "y", ["a"], ["a"], [1], [1]), ("z", "z", ["a"], ["b"], [1], None)], "e string, we string, p array<string>, wp array<string>, c array<int>, w array<int>")
    assert [r.passed for r in hashing.adjudicate(a, end="e", want_end="we", path="p", want_path="wp", covered="c", wanted="w").collect()] == [True, False, False]


def test_budgets_take_more_tasks_for_more_scenarios(spark, monkeypatch):
    from veriloom.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 50, raising=False)
    runs = spark.range(1000).selectExpr("id AS scenario_id", "if(id = 0, null, id % 200) AS brief_id")
    briefs = spark.range(150).selectExpr("id AS brief_id", "4 AS budget", "id % 3 AS authored", "id % 2 = 0 AS retired")
    got = derive.within_budget(runs, briefs.hint("merge"))
    assert got.rdd.getNumPartitions() == 20
    assert sorted(r.scenario_id for r in got.where("accepted").collect()) == [i for i in range(1000) if i and i % 200 < 150 and i % 2 and i % 200 % 3 + i // 200 + 1 <= 4]


def test_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", None)], "g string, v double")
    got = {r.g: tuple(r)[1:] for r in stats.summary(df, ["g"], "v").collect()}
    assert got == {"a": (2, 1.5, 0.7071, 1.0, 2.0), "b": (1, 5.0, 0.0, 5.0, 5.0), "c": (0, 0.0, 0.0, 0.0, 0.0)}
    sums = stats.summary(df, ["g"], "v")
    assert stats.deltas(sums, "g", ["mean"], "b", "a").first().mean == "+3.50"
    ties = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 9)], "g string, it int, s int")
    assert stats.best(ties, ["g"], "s", "it").first().it == 2


SCHEMA = {"type": "object", "required": ["id", "list"], "additionalProperties": False, "$defs": {"n": {"type": ["integer", "null"], "minimum": 1}}, "properties": {"id": {"type": "string", "pattern": "^x"}, "kind": {"enum": ["a", "b"]}, "n": {"$ref": "#/$defs/n"}, "list": {"type": "array", "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "boolean"}}}}}}


def test_schema(spark):
    docs = [{"id": "x1", "list": []}, {"id": "y", "list": [{"k": 1}, {}], "kind": "c", "n": 0, "more": 1}, {"id": 3}, [1], {"id": "x", "list": [], "n": None}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, d string")
    got = [sorted(r.e) for r in df.orderBy("i").select(documents.errors(F.col("d"), SCHEMA).alias("e")).collect()]
    assert got == [[], sorted(["/id: pattern", "/kind: not in enum", "/n: below minimum", "/more: unknown property", "/list/0/k: not boolean", "/list/1/k: required"]), ["/id: not string", "/list: required"], ["/: not object"], []]
    with pytest.raises(ValueError):
        documents.errors(F.lit("{}"), {"oneOf": []})
    assert documents.exploded(df.where("i = 1"), ["i"], "d", "$.list", SCHEMA["properties"]["list"]["items"]).count() == 2


def test_streaks_and_frontier(spark):
    log = spark.createDataFrame([("r", i, k) for i, k in enumerate("ffofff")], "run string, seq int, k string")
    assert [r.k2 for r in logs.streaks(log, ["run"], ["seq"], F.col("k") == "f", F.col("k") == "o").withColumnRenamed("k", "k2").orderBy("seq").collect()] == [1, 2, 1, 2, 3]


def test_ordered_digests(spark):
    from veriloom.operators.digests import ordered_digest

    rows = [(g, i, None if i % 11 == 0 else f"x{i * 7 % 13}") for i, g in enumerate(["a", "b", None, "a"] * 50)]
    df = spark.createDataFrame(rows, "g string, o int, t string").repartition(5)
    want = {g: (sum(r[0] == g for r in rows), hashlib.sha256(("h" + "\n".join(r[2] for r in sorted(rows, key=lambda r: -r[1]) if r[0] == g and r[2] is not None)).encode()).hexdigest()) for g in ("a", "b", None)}
    assert {r.g: (r.n, r.sha256) for r in ordered_digest(df, ["g"], [-F.col("o")], "t", head=F.lit("h")).collect()} == want
    every = hashlib.sha256("".join(r[2] or "" for r in rows).encode()).hexdigest()
    assert [tuple(r) for r in ordered_digest(df, [], ["o"], "t", sep="").collect()] == [(200, every)]
    assert [tuple(r) for r in ordered_digest(df.limit(0), [], ["o"], "t").collect()] == [(0, hashlib.sha256(b"").hexdigest())]
    assert ordered_digest(df.limit(0), ["g"], ["o"], "t").count() == 0
    long = spark.range(300_000).select(F.lit(1).alias("g"), "id")
    assert ordered_digest(long, ["g"], ["id"], F.col("id").cast("string")).first().sha256 == hashlib.sha256("\n".join(map(str, range(300_000))).encode()).hexdigest()


def test_directories_with_links(spark):
    files = spark.createDataFrame([("d", "b", b"target", "l"), ("d", "a", b"xy", "f"), ("d", "c", None, "o")], "d string, p string, c binary, k string")
    want = b"a\0f" + (2).to_bytes(8, "big") + b"xy" + b"b\0ltarget" + b"c\0o"
    assert derive.directory_bytes(files, ["d"], "p", "c", kind="k").first().sha256 == hashlib.sha256(want).hexdigest()


def test_closings_of_long_tails_take_few_rounds(spark, monkeypatch):
    n = 60
    rows = [*((f"t{i:02d}", f"t{i + 1:02d}" if i < n - 1 else "c0") for i in range(n)), ("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("s", "s"), ("u", "c2")]
    made = []
    monkeypatch.setattr(integrity, "settled", lambda df, real=integrity.settled: made.append(1) or real(df))
    got = {r.k: r.closing for r in integrity.closings(spark.createDataFrame(rows, "k string, up string"), "k", "up").collect()}
    assert got == {k: "s" if k == "s" else "c2" if k == "u" else k if k[0] == "c" else "c0" for k, _ in rows}
    assert len(made) < 22


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_holdout_is_the_least_hashes(spark, digits):
    rows = [(i, "a" if i % 3 else None, "x") for i in range(200)] + [(900, "b", "x"), (901, "c", "x"), (902, "c", "x")]
    got = stats.holdout(spark.createDataFrame(rows, "k int, s string, __hash2 string"), ["s"], "k", 0.2, digits=digits).collect()
    want = set()
    for s in ("a", "b", "c", None):
        keys = sorted((k for k, t, _ in rows if t == s), key=lambda k: hashlib.sha256(f"42:{k}".encode()).hexdigest())
        want |= set(keys[: max(1, int(len(keys) * 0.2))])
    assert {r.k for r in got if r.part == "test"} == want and len(got) == len(rows)


def test_rendered_rows(spark):
    row = spark.sql("SELECT named_struct('z', 1, 'a', array(named_struct('y', cast(null as string), 'b', map('k2', 1, 'k1', 2)))) AS s, cast(null as struct<q:int>) AS n, 'ü' AS a")
    got = row.select(derive.rendered(row).alias("j")).first().j
    assert got == '{"a":"ü","n":null,"s":{"a":[{"b":{"k1":2,"k2":1},"y":null}],"z":1}}'
