import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veriloom.plans import flows
from veriloom.sources import files


def test_run_records(spark, tmp_path):
    good = {"run_id": "r", "kind": "run", "state": "open", "idempotency_key": "k", "policy": "abort", "events": [{"seq": 0, "kind": "run_created", "payload": {"ctx": {"a": 1}}}]}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text("[1, 2]")
    (tmp_path / "d.txt").write_text("x")
    rows = files.run_records(spark, str(tmp_path))
    assert [(r.run_id, r.name) for r in rows.collect()] == [("r", "a.json")]
    assert json.loads(files.events_of(rows).first().payload) == {"ctx": {"a": 1}}


def test_tree_and_front_matter(spark, tmp_path):
    (tmp_path / "x/skip").mkdir(parents=True)
    for name, text in (("a.md", "---\nname: good-one\ndescription: >\n  two\n  lines\n---\nbody\n"), ("x/b.md", "no block"), ("x/skip/c.md", "---\nname: Bad Name\ndescription: d\n---\n")):
        (tmp_path / name).write_text(text)
    got = {r.path: r.sha256 for r in files.tree(spark, str(tmp_path), skip=["skip"]).collect()}
    assert got == {p: hashlib.sha256((tmp_path / p).read_bytes()).hexdigest() for p in ("a.md", "x/b.md")}
    rows = {r.path.rpartition("/")[2]: r for r in files.front_matter(spark, str(tmp_path)).collect()}
    assert (rows["a.md"].name, rows["a.md"].description, rows["a.md"].error, rows["a.md"].body) == ("good-one", "two lines", None, "body\n")
    assert rows["b.md"].error == "no front matter" and rows["c.md"].error == "bad name"


def test_eval_runs(spark, tmp_path):
    d = tmp_path / "eval-1/with/run-2"
    d.mkdir(parents=True)
    (d / "grading.json").write_text(json.dumps({"summary": {"pass_rate": 0.5, "passed": 1, "failed": 1, "total": 2}, "execution_metrics": {"output_chars": 9, "total_tokens": 0}}))
    bad = tmp_path / "eval-1/with/run-3"
    bad.mkdir()
    (bad / "grading.json").write_text("{")
    r = files.eval_runs(spark, str(tmp_path)).collect()
    assert len(r) == 1 and (r[0].eval_id, r[0].configuration, r[0].run_number, r[0].tokens, r[0].pass_rate) == ("eval-1", "with", 2, 9, 0.5)


def test_settings_and_globs(spark):
    parsed = files.parse_settings("a: 1\nb: 'x'  # note\nc:\n  d: 2\n")
    assert parsed == {"a": 1, "b": "x", "c": {"d": 2}}
    assert files.settle({"a": None, "b": "f"}, {"a": 5}, {"a": 1, "b": 2, "z": 3}) == {"a": (5, "file"), "b": ("f", "flag"), "z": (3, "default")}
    for bad in ("nonsense", "  a: 1"):
        with pytest.raises(ValueError):
            files.parse_settings(bad)
    df = spark.createDataFrame([("a/node_modules/x",), ("b.pyc",), ("c.py",)], "p string")
    assert [r[0] for r in df.select(files.excluded(F.col("p"), ["node_modules"], ["*.pyc"])).collect()] == [True, True, False]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "p")], "k int, payload string")
    files.write_sorted_json(df, str(tmp_path / "j"), ["k"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    for _ in range(2):
        files.append_commits(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).where("payload_hash IS NOT NULL").count() == 2
    assert [(r.k, r.seq) for r in files.mint(df, 7, ["k"]).collect()] == [(1, 8), (2, 9)]
    pick = files.definitions(df, df.withColumn("payload", F.lit("z")).unionByName(spark.createDataFrame([(9, "n")], "k int, payload string")), "k")
    assert {r.k: r.payload for r in pick.collect()} == {1: "p", 2: None, 9: "n"}


def machine(spark):
    states = spark.createDataFrame([("idle", "wait", None, None, None, 0), ("beat it", "task", "beat", "abort", None, 1), ("done", "end", None, None, "completed", 2)], "name string, kind string, runbook string, step_policy string, outcome string, ord int")
    moves = spark.createDataFrame([("idle", "timer", None, "beat it", 0), ("beat it", "run_completed", "payload.more", "beat it", 1), ("beat it", "run_aborted", None, "done", 2)], "from_state string, trigger string, guard string, to_state string, ord int")
    steps = spark.createDataFrame([("beat", "echo", "True", 0), ("beat", "echo", "ctx.a", 1)], "runbook string, tool string, expr string, ord int")
    return flows.compile_machine(states, moves, steps, prefix="hb-", version="1")


def test_compile(spark):
    t = machine(spark)
    assert sorted(r._key for r in t["steps"].collect()) == ["hb-step-beat-01", "hb-step-beat-02"] and t["tools"].count() == 1
    expected = {"flow_states": 3, "flow_transitions": 3, "runbooks": 1, "steps": 2, "tools": 1}
    assert flows.check_machine(t, expected).collect() == []
    broken = {**t, "tools": t["tools"].limit(0), "flow_transitions": t["flow_transitions"].withColumn("trigger", F.lit("odd"))}
    got = [r.message for r in flows.check_machine(broken, expected).collect()]
    assert any("0 entities for 1" in m for m in got) and any("unknown trigger odd" in m for m in got) and any("tool_id hb-tool-echo is dangling" in m for m in got)


def test_component_status(spark):
    s = "path string, sha256 string"
    comps = spark.createDataFrame([("spec", []), ("gone", ["none"]), ("ok", ["lib/", "a"]), ("bad", ["b"])], "component string, artifacts array<string>")
    have, want = spark.createDataFrame([("lib/x/y", "1"), ("a", "2"), ("b", "3")], s), spark.createDataFrame([("lib/x/y", "1"), ("a", "2"), ("b", "4")], s)
    assert {r.component: r.status for r in flows.component_status(comps, have, want).collect()} == {"spec": "specified-only", "gone": "absent", "ok": "instantiated", "bad": "mutated"}


def test_verify_writers(spark):
    rows, before = [], None
    for i in range(3):
        body = f"b{i}"
        h = hashlib.sha256("\0".join(["w", str(i), before or "", body]).encode()).hexdigest()
        rows.append(("w", i, before, body, h))
        before = h
    s = "writer_id string, seq int, prev_hash string, body string, entry_hash string"
    assert flows.verify_writers(spark.createDataFrame(rows, s)).count() == 0
    rows[1] = (*rows[1][:3], "changed", rows[1][4])
    assert [r.problem for r in flows.verify_writers(spark.createDataFrame(rows, s)).collect()] == ["hash mismatch"]
    assert [r.problem for r in flows.verify_writers(spark.createDataFrame(rows[:1] + rows[2:], s)).collect()] == ["gap"]


def test_books_from_entities(spark):
    books = spark.createDataFrame([("a", "1"), ("b", "1")], "_key string, release_version string")
    steps = spark.createDataFrame([("a", 2, "t2", "ctx.x"), ("a", 1, "t1", "True")], "runbook_id string, seq bigint, tool_id string, expr string")
    made = files.books_of(books, steps)
    assert {r.runbook_id: [tuple(x) for x in r.steps] for r in made.collect()} == {"a": [(0, "t1", "True"), (1, "t2", "ctx.x")], "b": []}
    shipped = made.where("runbook_id = 'a'").withColumn("release_version", F.lit("9"))
    assert {r.runbook_id: r.release_version for r in files.definitions(shipped, made, "runbook_id").collect()} == {"a": "9", "b": "1"}
