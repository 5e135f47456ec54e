import json
import random

import pytest
from pyspark.sql import functions as F

from veriloom.operators import logs, prefixes


def plain(rows, inclusive=True):
    """(id, merged, to_state of the row before) of rows (id, run, seq, payload, reset, to_state)."""
    state, before, out = {}, {}, []
    for i, run, seq, payload, reset, to in sorted(rows, key=lambda r: (str(r[1]), r[2])):
        prior = dict(state.get(run, {}))
        now = {} if reset else dict(prior)
        try:
            found = json.loads(payload or "{}")
        except ValueError:
            found = {}
        now |= found if isinstance(found, dict) else {}
        state[run] = now
        out.append((i, now if inclusive else prior, before.get(run)))
        before[run] = to
    return sorted(out, key=lambda r: r[0])


def log(n, seed, runs=4):
    rng = random.Random(seed)
    payloads = lambda: rng.choice([None, "", "[1]", "no json", "{}", *(json.dumps({rng.choice("abcdé"): rng.choice([None, 1, 2.5, "x", [1], {"a": 1}])}) for _ in range(15))])
    # Half of all rows are of one run; one run is null.
    return [(i, rng.choice(["big"] * runs + [None, *(f"r{k}" for k in range(runs))]), i * 3, payloads(), rng.random() < 0.03, rng.choice(["s", "t", None])) for i in range(n)]


SCHEMA = "id bigint, run string, seq bigint, payload string, reset boolean, to_state string"


@pytest.mark.parametrize("parts,inclusive", [(None, True), (1, False), (7, True), (60, False), (60, True)])
def test_running_merge_over_several_ranges(spark, parts, inclusive):
    rows = log(300, 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("__extra", F.lit(1))
    got = prefixes.running_merge(df, ["run"], ["seq"], "payload", resets=F.col("reset"), previous=["to_state"], inclusive=inclusive, parts=parts)
    assert got.columns == [*df.columns, "merged", "to_state_before"]
    assert sorted((r.id, json.loads(r.merged), r.to_state_before) for r in got.collect()) == plain(rows, inclusive)


def test_running_merge_of_nothing(spark):
    assert prefixes.running_merge(spark.createDataFrame([], SCHEMA), ["run"], ["seq"], "payload").count() == 0


TRANSITIONS = [("t1", "s0", "go", "payload.a == 1", "s1"), ("t2", "s0", "go", "payload.a != 1", "s2"), ("t3", "s1", "go", None, "s0"), ("t4", "s2", "go", "payload.b", "s0"), ("t5", "s2", "go", "payload.c", "s2")]


@pytest.mark.parametrize("parts", [None, 6])
def test_replay(spark, parts):
    events = [
        ("good", 1, "s0", "s1", "go", '{"a": 1}'), ("good", 2, "s1", "s0", "go", "{}"), ("good", 3, "s0", "s1", "go", "{}"),
        ("start", 1, "s1", "s0", "go", "{}"),
        ("lost", 1, "s0", "s1", "go", "{}"), ("lost", 2, "s1", "s0", "go", "{}"),
        ("two", 1, "s0", "s2", "go", '{"b": true, "c": "y"}'), ("two", 2, "s2", "s0", "go", None),
        ("none", 1, "s0", "s0", "stop", "{}"), ("none", 5, "s1", "s1", "go", "{}"),
    ]
    df = spark.createDataFrame(events, "run string, seq bigint, from_state string, to_state string, trigger string, payload string")
    known = spark.createDataFrame(TRANSITIONS, "transition_id string, from_state string, trigger string, guard string, to_state string")
    got = logs.replay(df, known, ["run"], "seq", initial="s0", guards=[t[3] for t in TRANSITIONS if t[3]], parts=parts)
    rows = {(r.run, r.seq): r for r in got.collect()}
    assert {k: r.transition_id for k, r in rows.items()} == {
        ("good", 1): "t1", ("good", 2): "t3", ("good", 3): "t1", ("start", 1): "t2", ("lost", 1): "t2", ("lost", 2): "t3",
        ("two", 1): "t2", ("two", 2): None, ("none", 1): None, ("none", 5): "t2",
    }
    assert {(r.run, r.seq, r.fault) for r in logs.first_faults(got, ["run"], "seq").collect()} == {
        ("start", 1, "replay: event 1 starts at s1, expected s0"), ("lost", 1, "replay: event 1 does not re-derive (winners=['t2'])"),
        ("two", 2, "replay: event 2 does not re-derive (winners=['t4', 't5'])"), ("none", 1, "replay: event 1 does not re-derive (winners=[])"),
    }


def test_replay_parses_a_payload_once(spark):
    """However many guards and candidates there are, and whatever is asked of the faults."""
    df = spark.createDataFrame([("r", 1, "s0", "s1", "go", "{}")], "run string, seq bigint, from_state string, to_state string, trigger string, payload string")
    known = spark.createDataFrame(TRANSITIONS, "transition_id string, from_state string, trigger string, guard string, to_state string")
    got = logs.replay(df, known, ["run"], "seq", initial="s0", guards=[t[3] for t in TRANSITIONS if t[3]])
    for asked in (got, logs.first_faults(got, ["run"], "seq")):
        assert asked._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") + asked._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
