import hashlib

from pyspark.sql import functions as F

from veriloom.operators import records, stats


def found(df):
    return sorted(r.finding for r in df.collect())


def test_commits(spark):
    log = spark.createDataFrame([("f", i, f"e{i}") for i in range(1, 6)], "flow_run_id string, seq bigint, event string")
    s = "flow_run_id string, first_seq bigint, last_seq bigint, events array<string>"
    good = spark.createDataFrame([("f", 1, 2, ["e1", "e2"]), ("f", 3, 5, ["e3", "e4", "e5"])], s)
    assert found(records.commit_completeness(good, log)) == []
    bad = spark.createDataFrame([("f", 1, 2, ["e1"]), ("f", 4, 9, ["e4", "e5"])], s)
    assert len(found(records.commit_completeness(bad, log))) == 4
    h = hashlib.sha256(b"p").hexdigest()
    rows = spark.createDataFrame([("f", 0, 1, 2, "p", h), ("f", 1, 2, 4, "p", "x"), ("f", 2, 5, 6, "q", hashlib.sha256(b"q").hexdigest())], "flow_run_id string, ord int, first_seq bigint, last_seq bigint, payload string, payload_hash string")
    got = found(records.commit_integrity(rows, F.lit("p")))
    assert [m[:4] for m in got] == ["I-19", "I-20", "I-20"]


def test_records(spark):
    s = "k int, kind string, destination string"
    assert len(found(records.separation(spark.createDataFrame([(1, "simulation", "disclosure"), (2, "simulation", "x"), (3, "real", "disclosure")], s), ["k"]))) == 1
    s = "k int, manifest_identity string, repo_identity string, git_available boolean"
    assert found(records.identity_binding(spark.createDataFrame([(1, "a", "a", True)], s), ["k"])) == []
    assert len(found(records.identity_binding(spark.createDataFrame([(1, "a", "b", False), (2, None, None, True)], s), ["k"]))) == 4
    s = "k int, initiator string, origin string, principal string, harness_strapped boolean"
    assert found(records.initiation(spark.createDataFrame([(1, "operator", "operator-direct", "dyad-or-human", True)], s), ["k"])) == []
    assert len(found(records.initiation(spark.createDataFrame([(1, None, "ambient", "agent", None), (2, "operator", "odd", "dyad-or-human", True)], s), ["k"]))) == 5
    s = "k int, path_source string, path string, at_initiation boolean, manifest_identity string, repo_identity string, git_available boolean"
    assert len(found(records.acquisition(spark.createDataFrame([(1, "flag", "/p", True, "a", "a", True), (2, "env", "", False, "a", "a", True)], s), ["k"]))) == 3


def test_seal_and_scores(spark):
    files = spark.createDataFrame([("b", "y", "2"), ("b", "x", "1")], "bundle string, path string, sha256 string")
    seal = hashlib.sha256(b"x:1\ny:2").hexdigest()
    assert [r.intact for r in records.sealed(spark.createDataFrame([("b", seal), ("c", seal)], "bundle string, seal string"), files).orderBy("bundle").collect()] == [True, False]
    df = spark.createDataFrame([("a", True)] * 4 + [("a", False), ("b", True), ("b", False), ("c", False)], "g string, ok boolean")
    assert {r.g: r.band for r in stats.retry_score(df, ["g"], F.col("ok")).collect()} == {"a": "good", "b": "fair", "c": "poor"}
    t = spark.createDataFrame([(True, False), (False, False), (True, True)], "should boolean, passed boolean")
    assert sorted(r.problem for r in stats.wrong_triggers(t).collect()) == ["failed", "false"]
