import pytest
from pyspark.sql import functions as F

from veriloom.plans import flows
from veriloom.sources import versions


def test_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    with pytest.raises(LookupError):
        versions.read(spark, folder)
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert versions.latest(spark, folder) == 0 and versions.replace(df, folder, seen=0) == 1
    # Two writers that both know version 1: one of them is refused, and leaves nothing.
    assert versions.replace(df.withColumn("n", F.lit(7)), folder, seen=1) == 2
    before = sorted(x.name for x in (tmp_path / "t").iterdir())
    with pytest.raises(versions.StaleVersion):
        versions.replace(df, folder, seen=1)
    assert sorted(x.name for x in (tmp_path / "t").iterdir()) == before
    assert not versions.publish(spark, f"{folder}/versions/2", "other") and not [x for x in (tmp_path / "t/versions").iterdir() if "draft" in x.name]
    assert {r.n for r in versions.read(spark, folder).collect()} == {7} and {r.n for r in versions.read(spark, folder, 1).collect()} == {1, 2}
    assert versions.put_records(spark.createDataFrame([("b", 9), ("c", 3)], "id string, n int"), folder, "id") == 3
    assert {tuple(r) for r in versions.read(spark, folder).collect()} == {("a", 7), ("b", 9), ("c", 3)}


def test_store_by_content(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    rows = lambda *k: spark.createDataFrame([(x, x) for x in k], "manifest_hash string, output string")
    assert [versions.put_missing(rows(*k), folder, "manifest_hash") for k in ("a", "ab", "bba", "c")] == [1, 2, 2, 3]
    assert sorted(r.output for r in versions.read(spark, folder).collect()) == ["a", "b", "c"]


def test_a_failing_task_leaves_no_version(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    with pytest.raises(Exception, match="boom"):
        versions.replace(spark.range(4).select(F.raise_error(F.lit("boom")).alias("x")), folder, seen=0)
    assert versions.latest(spark, folder) == 0


def test_another_writer_in_between(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    versions.replace(spark.range(1), folder, seen=0)
    met = []

    def change(df):
        if not met:
            met.append(versions.replace(spark.range(5), folder, seen=1))
        return df.union(df)

    assert versions.update(spark, folder, change) == 3
    assert versions.read(spark, folder).count() == 10


def test_outbox_over_restarts(spark, tmp_path):
    box = versions.Outbox(f"file://{tmp_path}/box")
    batch = lambda *runs: spark.createDataFrame([("f", r, "s", "timer") for r in runs], "flow_id string, flow_run_id string, state_id string, trigger string")
    box(batch("r2", "r1", "r1"), 0)
    box(batch(), 1)
    box(batch("r9"), 2)
    box(batch("r9"), 2)  # the batch again, as after a restart
    versions.Outbox(f"file://{tmp_path}/box")(batch("r5", "r4"), 3)
    rows = box.messages(spark).orderBy("seq").collect()
    assert [(r.id, r.seq, r.flow_run_id) for r in rows] == [("dl-000001", 1, "r1"), ("dl-000002", 2, "r1"), ("dl-000003", 3, "r2"), ("dl-000004", 4, "r9"), ("dl-000005", 5, "r4"), ("dl-000006", 6, "r5")]
    assert rows[0].text == "flow_id: f\nflow_run_id: r1\nstate_id: s\ntrigger: timer\n" and {(r.kind, r.status) for r in rows} == {("automaton-exception", "open")}
    assert box.numbered(batch("x"), 1_234_567).first().id == "dl-1234567"


def test_outbox_of_a_stream(spark, tmp_path):
    source, box = str(tmp_path / "in"), versions.Outbox(f"file://{tmp_path}/box")
    rows = lambda *runs: spark.createDataFrame([("f", r, "s", "external") for r in runs], "flow_id string, flow_run_id string, state_id string, trigger string")
    for runs in (("a", "b"), ("c",)):
        rows(*runs).write.mode("append").json(source)
        query = spark.readStream.schema(rows().schema).json(source).writeStream.foreachBatch(box).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert [(r.seq, r.flow_run_id) for r in box.messages(spark).orderBy("seq").collect()] == [(1, "a"), (2, "b"), (3, "c")]


def test_guard_findings(spark):
    moves = spark.createDataFrame([("a", "b", "payload.x == 1"), ("a", "c", None), ("a", "d", "payload.x < 1"), ("b", "c", "ctx.x"), ("c", "d", "f(payload)"), ("d", "e", "payload.x ==")], "from_state string, to_state string, guard string")
    steps = spark.createDataFrame([("rb", 1, "True"), ("rb", 2, "payload['x']")], "runbook string, seq int, expr string")
    got = sorted(r.message for r in flows.check_guards(moves, steps).collect())
    assert [m.partition(": ")[2].partition(" (")[0] for m in got] == [
        "run-book 'rb' step 2: guard uses non-allowlisted syntax: Subscript", "transition a->d: guard uses non-allowlisted syntax: Lt", "transition b->c: guard may only reference payload, got 'ctx'",
        "transition c->d: guard uses non-allowlisted syntax: Call", "transition d->e: guard is not parseable: invalid syntax",
    ]


def test_component_precedence(spark):
    comps = spark.createDataFrame(
        [("spec", "specified-only", ["p"], ["none"]), ("other", "shipped", ["q"], ["a"]), ("gone", "shipped", ["p", "q"], ["lib/", "b"]), ("bad", "shipped", ["p"], ["b"]), ("ok", None, ["p"], ["a", "loose"]), ("empty", "shipped", None, ["a"])],
        "component string, kind string, profiles array<string>, artifacts array<string>")
    s = "path string, sha256 string"
    have, want = spark.createDataFrame([("a", "1"), ("b", "2"), ("loose", "9"), ("lib/new", "5")], s), spark.createDataFrame([("a", "1"), ("b", "3"), ("lib/x", "4")], s)
    assert {r.component: (r.status, r.detail, r.fault) for r in flows.component_status(comps, have, want, "p").collect()} == {
        "spec": ("specified-only", "specified, not implemented", False), "other": ("absent", "not shipped in the p profile (ships in: q)", False), "gone": ("absent", "missing artifacts: lib/x", True),
        "bad": ("mutated", "diverged from manifest: b", False), "ok": ("instantiated", "present and pristine", False), "empty": ("absent", "not shipped in the p profile (ships in: )", False),
    }


def test_roll_up(spark):
    rows = spark.createDataFrame([("a", True), ("a", None), ("b", True)], "g string, ok boolean")
    assert {tuple(r) for r in flows.roll_up(rows, ["g"]).collect()} == {("a", 2, 1, False), ("b", 1, 0, True)}
    assert tuple(flows.roll_up(rows.limit(0)).first()) == (0, 0, True)
