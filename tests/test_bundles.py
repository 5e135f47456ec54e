import json

import pytest

from veriloom.sources import bundles


def put(root, path, data):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(data if isinstance(data, bytes) else (data if isinstance(data, str) else json.dumps(data)).encode())


@pytest.mark.parametrize("layout", ["", "runs/"])
def test_graded_runs_in_both_layouts(spark, tmp_path, layout):
    grade = {"summary": {"pass_rate": 0.5, "passed": 1, "failed": 1, "total": 2}, "timing": {"total_duration_seconds": 3}, "execution_metrics": {"total_tool_calls": 4, "errors_encountered": 1, "output_chars": 9, "total_tokens": 7}}
    put(tmp_path, f"{layout}eval-1/with_x/run-2/grading.json", grade | {"expectations": [{"text": "t", "passed": True, "evidence": "e"}, {"text": "no verdict"}], "user_notes_summary": {"needs_review": ["b"], "uncertainties": ["a"]}})
    put(tmp_path, f"{layout}eval-1/with_x/run-3/grading.json", "{broken")
    put(tmp_path, f"{layout}eval-1/with_x/run-4/notes.txt", "x")
    put(tmp_path, f"{layout}eval-1/inputs/file.txt", "x")
    put(tmp_path, f"{layout}eval-a/eval_metadata.json", {"eval_id": 17})
    put(tmp_path, f"{layout}eval-a/base/run-1/grading.json", {"summary": {"pass_rate": 1}})
    put(tmp_path, f"{layout}eval-a/base/run-1/timing.json", {"total_duration_seconds": 1.5, "total_tokens": 70})
    put(tmp_path, f"{layout}eval-b/eval_metadata.json", "[]")
    put(tmp_path, f"{layout}eval-b/base/run-1/grading.json", [1])
    rows = {(r.eval_id, r.configuration, r.run_number): r for r in bundles.graded_runs(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [("1", "with_x", 2), ("1", "with_x", 3), ("1", "with_x", 4), ("17", "base", 1), ("2", "base", 1)]
    good = rows["1", "with_x", 2]
    assert (good.place, good.pass_rate, good.passed, good.total, good.time_seconds, good.tokens, good.tool_calls, good.errors, good.notes) == (0, 0.5, 1, 2, 3.0, 9, 4, 1, ["a", "b"])
    assert [tuple(e) for e in good.expectations] == [("t", True, "e"), ("no verdict", None, None)] and good.warning == "1 expectations without text or passed"
    assert "Invalid JSON" in rows["1", "with_x", 3].warning and "not found" in rows["1", "with_x", 4].warning and "not an object" in rows["2", "base", 1].warning
    assert (rows["17", "base", 1].time_seconds, rows["17", "base", 1].tokens, rows["17", "base", 1].warning) == (1.5, 70, None)
    runs = bundles.graded_runs(spark, str(tmp_path))
    assert [r.eval_id for r in bundles.eval_ids(runs).orderBy("pos").collect()] == ["1", "17"]
    assert [tuple(r) for r in bundles.first_two(runs).collect()] == [("-0.50", "+1.5", "-61")]


def test_no_runs(spark, tmp_path):
    runs = bundles.graded_runs(spark, str(tmp_path))
    assert runs.count() == 0 and [tuple(r) for r in bundles.first_two(runs).collect()] == [("+0.00", "+0.0", "+0")]
    assert bundles.review_runs(spark, str(tmp_path)).count() == 0


def test_review_runs(spark, tmp_path):
    put(tmp_path, "b/deep/eval_metadata.json", {"prompt": "say", "eval_id": 2})
    put(tmp_path, "b/deep/r1/outputs/plot.PNG", b"\x89\x00")
    put(tmp_path, "b/deep/r1/outputs/a.py", "print(é)".encode())
    put(tmp_path, "b/deep/r1/outputs/metrics.json", {})
    put(tmp_path, "b/deep/r1/outputs/more/x.txt", "below outputs nothing is listed")
    put(tmp_path, "b/deep/grading.json", {"summary": 1})
    put(tmp_path, "a/outputs/t.tar", b"x")
    put(tmp_path, "a/transcript.md", "# T\n\n## Eval Prompt\n\n do it \n\n## More\n")
    put(tmp_path, "a/grading.json", "{")
    put(tmp_path, "c/outputs/s.svg", b"<svg/>")
    put(tmp_path, "c/eval_metadata.json", {"eval_id": 10})
    put(tmp_path, "node_modules/x/outputs/no", "x")
    put(tmp_path, "d/inputs/outputs/no", "x")
    rows = bundles.review_runs(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.id, r.eval_id, r.prompt) for r in rows] == [("b-deep-r1", 2, "say"), ("c", 10, bundles.NO_PROMPT), ("a", None, "do it")]
    assert [(o.name, o.kind, o.mime, o.text, o.data and bytes(o.data)) for o in rows[0].outputs] == [("a.py", "text", "text/x-python", "print(é)", None), ("plot.PNG", "image", "image/png", None, b"\x89\x00")]
    assert json.loads(rows[0].grading) == {"summary": 1} and rows[1].outputs[0].mime == "image/svg+xml"
    assert rows[2].grading is None and rows[2].warning == "Invalid JSON in grading.json" and rows[2].outputs[0].kind == "binary"
    put(tmp_path, "outputs/only.txt", "x")
    assert [r.id for r in bundles.review_runs(spark, str(tmp_path)).collect()] == ["."]
