import json

import pytest

from veriloom.streaming import machine
from veriloom.streaming.machine import Flow, FlowRun, Policy, Run, RunBook

TOOLS = {
    "set": lambda ctx: {"ok": True, "result": 1, "ctx_delta": {"done": True}},
    "bad": lambda ctx: {"ok": False, "error": "no"},
    "odd": lambda ctx: "text",
}


def kinds(book, *inputs):
    run = Run(book, TOOLS)
    return [json.loads(json.dumps(e))["kind"] for e in machine._drive(run, "r", inputs)], run


def test_run_completes():
    got, run = kinds(RunBook(((0, "set", "ctx.go"), (1, "set", "True"))), ("x", '{"go": 1}'))
    assert got == ["run_created", "step_started", "step_completed", "step_started", "step_completed", "run_completed"] and run.ctx["done"]


def test_run_parks_once_and_wakes():
    book = RunBook(((0, "set", "ctx.go"),))
    got, run = kinds(book, ("x", "{}"), ("x", '{"other": 1}'), ("x", '{"go": true}'), ("x", "{}"))
    assert got == ["run_created", "step_parked", "event_injected", "event_injected", "step_started", "step_completed", "run_completed"]
    assert run.advance() == []


@pytest.mark.parametrize("policy,want", [
    ("abort", ["run_created", "step_started", "step_failed", "run_aborted"]),
    ("skip", ["run_created", "step_started", "step_failed", "step_skipped", "run_completed"]),
    ("retry:2", ["run_created", "step_started", "step_failed", "step_started", "step_failed", "run_aborted"]),
])
def test_policies(policy, want):
    for tool in ("bad", "odd", "unknown"):
        assert kinds(RunBook(((0, tool, "True"),), policy), ("x", "{}"))[0] == want


def test_no_steps_complete_at_once_and_bad_policies():
    assert kinds(RunBook(()), ("x", "not json"))[0] == ["run_created", "run_completed"]
    for bad in ("retry:0", "retry:x", "never"):
        with pytest.raises(ValueError):
            Policy.parse(bad)


FLOW = Flow("s0", {"s0": {"kind": "wait"}, "s1": {"kind": "task", "book": "b"}, "s2": {"kind": "end", "outcome": "completed"}, "s3": {"kind": "end", "outcome": "aborted"}}, (
    {"from": "s0", "trigger": "timer", "guard": "payload.go", "to": "s1"},
    {"from": "s1", "trigger": "run_completed", "guard": "run.status == 'completed'", "to": "s2"},
    {"from": "s1", "trigger": "run_aborted", "to": "s3"},
), {"b": RunBook(((0, "set", "True"),))})


def test_flow():
    run = FlowRun(FLOW, TOOLS, "f")
    assert run.advance() == [] and run.state == "running"
    steps = run.advance("timer", {"go": 1})
    assert [(e[1], e[2]) for e in steps] == [("s0", "s1"), ("s1", "s2")] and run.state == "done" and steps[1][4] == {"done": True}
    lost = FlowRun(FLOW, TOOLS, "g")
    assert lost.advance("timer", {}) == [] and lost.state == "aborted"


def test_batch_and_stream_agree(spark, tmp_path):
    book = RunBook(((0, "set", "ctx.go"), (1, "bad", "ctx.done")), "retry:2")
    rows = [(f"r{i % 7}", i, "tick", json.dumps({"go": i > 10} if i % 3 else {"n": i})) for i in range(40)]
    cols = "run_id string, seq bigint, kind string, payload string"
    batch = machine.advance_batch(spark.createDataFrame(rows, cols), book, TOOLS)
    want = sorted(tuple(r) for r in batch.collect())
    # Timestamps of files order the stream: two files, earlier rows first.
    for k, part in enumerate((rows[:20], rows[20:])):
        spark.createDataFrame(part, cols).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = machine.advance_stream(stream, book, TOOLS).writeStream.format("memory").queryName("events_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert sorted(tuple(r) for r in spark.table("events_out").collect()) == want
