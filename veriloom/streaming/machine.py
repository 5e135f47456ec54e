"""Run-books and flows as event-sourced machines, in batches and in streams.

A machine's state is what its events have made of it: ``apply`` folds one event
in (once, never the whole log again), ``decide`` names the next event, or None
when nothing can happen without new input.  The same machine runs on grouped
batches and as the state of a stream, so both give the same events.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from veriloom.functions import guards

#: The kinds of events of a run.
KINDS = ("run_created", "step_started", "step_completed", "step_failed", "step_skipped", "step_parked", "event_injected", "run_completed", "run_aborted")
EVENTS = StructType([StructField("run_id", StringType()), StructField("seq", LongType()), StructField("kind", StringType()), StructField("payload", StringType())])

Tool = Callable[[dict], dict]


@dataclass(frozen=True)
class Policy:
    """What follows the k-th failure of a step: abort, skip, or retry while k < times, then abort."""

    kind: str
    times: int = 0

    @classmethod
    def parse(cls, text: str) -> Policy:
        if text in ("abort", "skip"):
            return cls(text)
        found = re.fullmatch(r"retry:\s*\+?(\d+(?:_\d+)*)\s*", text)
        if not found or int(found[1]) < 1:
            raise ValueError(f"bad policy {text!r}")
        return cls("retry", int(found[1]))

    def after(self, failures: int) -> str:
        return self.kind if self.kind != "retry" else "retry" if failures < self.times else "abort"


@dataclass(frozen=True)
class RunBook:
    """Steps ``(seq, tool, expr)`` under a policy."""

    steps: tuple[tuple[int, str, str], ...]
    policy: str = "abort"

    def ordered(self) -> list[tuple[int, str, str]]:
        return sorted(self.steps)


def invoke(tool: Tool | None, name: str, ctx: dict) -> tuple[bool, dict]:
    """(ok, event fields) of a tool; a result of another shape is a malformed failure."""
    if tool is None:
        return False, {"error": f"unknown tool {name!r}", "malformed": False}
    try:
        out = tool(dict(ctx))
    except Exception as e:  # a tool's failure is data
        return False, {"error": str(e), "malformed": False}
    if not isinstance(out, dict) or not isinstance(out.get("ok"), bool) or not isinstance(out.get("ctx_delta", {}), dict):
        return False, {"error": "malformed tool result", "malformed": True}
    try:
        json.dumps(out)
    except (TypeError, ValueError):
        return False, {"error": "tool result is no JSON", "malformed": True}
    return (True, {"result": out.get("result"), "ctx_delta": out.get("ctx_delta", {})}) if out["ok"] else (False, {"error": str(out.get("error", "failed")), "malformed": False})


@dataclass
class Run:
    """One run of a run-book."""

    book: RunBook
    tools: Mapping[str, Tool]
    ctx: dict = field(default_factory=dict)
    status: dict = field(default_factory=dict)
    failures: dict = field(default_factory=dict)
    last: str = ""
    state: str = "open"
    seq: int = 0

    def apply(self, kind: str, payload: dict) -> tuple[int, str, dict]:
        """Folds an event in; returns it with its sequence number."""
        step = payload.get("step_seq")
        if kind == "run_created":
            self.ctx = dict(payload.get("ctx", {}))
        elif kind == "event_injected":
            self.ctx |= payload["payload"] if isinstance(payload.get("payload"), dict) else {}
        elif kind == "step_completed":
            self.ctx |= payload.get("ctx_delta") or {}
        elif kind == "step_failed":
            self.failures[step] = self.failures.get(step, 0) + 1
        if kind.startswith("step_"):
            self.status[step] = kind.removeprefix("step_")
        if kind in ("run_completed", "run_aborted"):
            self.state = kind.removeprefix("run_")
        self.last, self.seq = kind, self.seq + 1
        return self.seq - 1, kind, payload

    def decide(self) -> Iterator[tuple[str, dict]]:
        """The events of the next step (a started step and its outcome), none at rest."""
        if self.state != "open" or self.last == "step_parked":
            return
        for step, name, expr in self.book.ordered():
            status = self.status.get(step)
            if status in ("completed", "skipped"):
                continue
            if status == "failed":
                outcome = Policy.parse(self.book.policy).after(self.failures[step])
                if outcome == "abort":
                    yield "run_aborted", {"reason": f"policy {self.book.policy}: {self.failures[step]} failed attempt(s) on step {step}"}
                    return
                if outcome == "skip":
                    yield "step_skipped", {"step_seq": step, "reason": f"policy {self.book.policy}"}
                    return
            try:
                go = guards.evaluate(expr, {"ctx": self.ctx})
            except Exception as e:
                yield "step_failed", {"step_seq": step, "tool": name, "error": f"guard error: {e}", "malformed": False}
                return
            if not go:
                if status != "parked":
                    yield "step_parked", {"step_seq": step}
                return
            yield "step_started", {"step_seq": step, "tool": name}
            ok, fields = invoke(self.tools.get(name), name, self.ctx)
            yield ("step_completed" if ok else "step_failed"), {"step_seq": step, "tool": name, **fields}
            return
        yield "run_completed", {}

    def advance(self, limit: int = 1000) -> list[tuple[int, str, dict]]:
        """Steps until nothing more can happen, at most ``limit`` steps."""
        out = []
        for _ in range(limit):
            new = [self.apply(*e) for e in self.decide()]
            if not new:
                break
            out += new
        return out

    def inject(self, kind: str, payload: dict) -> tuple[int, str, dict]:
        if self.last == "step_parked":
            self.last = ""
        return self.apply("event_injected", {"kind": kind, "payload": payload})

    def dump(self) -> str:
        return json.dumps([self.ctx, sorted(self.status.items()), sorted(self.failures.items()), self.last, self.state, self.seq])

    def load(self, text: str) -> Run:
        self.ctx, status, failures, self.last, self.state, self.seq = json.loads(text)
        self.status, self.failures = dict(map(tuple, status)), dict(map(tuple, failures))
        return self


class Unhandled(Exception):
    """No transition, or more than one, takes a trigger."""


def choose(transitions: list[dict], state: str, trigger: str, roots: dict) -> dict:
    """The transition that takes a trigger: the one whose guard holds, else the one without a guard."""
    here = [t for t in transitions if t["from"] == state and t["trigger"] == trigger]

    def holds(t: dict) -> bool:
        try:
            return guards.evaluate(t["guard"], roots)
        except Exception:
            return False

    winners = [t for t in here if t.get("guard") and holds(t)] or [t for t in here if not t.get("guard")]
    if len(winners) != 1:
        raise Unhandled(f"{len(winners)} transitions from {state} on {trigger}")
    return winners[0]


@dataclass(frozen=True)
class Flow:
    """States ``{id: {kind, book?, outcome?}}`` and transitions ``{from, trigger, guard?, to}``."""

    initial: str
    states: Mapping[str, dict]
    transitions: tuple[dict, ...]
    books: Mapping[str, RunBook] = field(default_factory=dict)


@dataclass
class FlowRun:
    """One run of a flow: waits take triggers from outside, tasks run their book as a child."""

    flow: Flow
    tools: Mapping[str, Tool]
    run_id: str
    at: str = ""
    state: str = "running"
    seq: int = 0
    child: Run | None = None

    def __post_init__(self) -> None:
        self.at = self.at or self.flow.initial

    def child_id(self) -> str:
        return hashlib.sha256(f"{self.run_id}\0{self.at}\0{self.seq}#0".encode()).hexdigest()[:16]

    def _move(self, trigger: str, payload: dict, status: str | None) -> tuple | None:
        try:
            to = choose(list(self.flow.transitions), self.at, trigger, {"payload": payload, "run": {"status": status}})["to"]
        except Unhandled:
            self.state = "aborted"
            return None
        event = (self.seq + 1, self.at, to, trigger, payload)
        self.at, self.seq, self.child = to, self.seq + 1, None
        return event

    def advance(self, trigger: str | None = None, payload: dict | None = None, limit: int = 1000) -> list[tuple]:
        """(seq, from, to, trigger, payload) of the transitions taken, until the flow is at rest."""
        out, pending = [], (trigger, payload or {}) if trigger else None
        for _ in range(limit):
            if self.state != "running":
                break
            here = self.flow.states[self.at]
            if here["kind"] == "end":
                self.state = "done" if here.get("outcome") == "completed" else "aborted"
                break
            if here["kind"] == "wait":
                if pending is None:
                    break
                event, pending = self._move(*pending, None), None
            else:
                if self.child is None:
                    self.child = Run(self.flow.books[here["book"]], self.tools)
                    self.child.apply("run_created", {"ctx": {}})
                self.child.advance(limit)
                if self.child.state == "open":
                    break
                event = self._move("run_completed" if self.child.state == "completed" else "run_aborted", dict(self.child.ctx), self.child.state)
            if event:
                out.append(event)
        return out


def _drive(run: Run, run_id: str, inputs) -> Iterator[dict]:
    for kind, payload in inputs:
        try:
            value = json.loads(payload) if payload else {}
        except ValueError:
            value = {}
        value = value if isinstance(value, dict) else {}
        if run.state != "open":
            continue  # a closed run takes nothing more
        first = run.apply("run_created", {"ctx": value}) if run.seq == 0 else run.inject(kind, value)
        for seq, event, fields in [first, *run.advance()]:
            yield {"run_id": run_id, "seq": seq, "kind": event, "payload": json.dumps(fields, sort_keys=True)}


def advance_batch(inputs: DataFrame, book: RunBook, tools: Mapping[str, Tool]) -> DataFrame:
    """Events of all runs from their inputs ``run_id, seq, kind, payload`` (JSON), in order of ``seq``.

    Each run's inputs are one sequential history, so a run is one group.
    """

    def one(key, pdf):
        import pandas as pd

        rows = pdf.sort_values("seq", kind="stable")
        return pd.DataFrame(list(_drive(Run(book, tools), key[0], zip(rows["kind"], rows["payload"]))), columns=EVENTS.names)

    return inputs.groupBy("run_id").applyInPandas(one, EVENTS)


def advance_stream(inputs: DataFrame, book: RunBook, tools: Mapping[str, Tool]) -> DataFrame:
    """The same for a stream: each run's state is kept, each micro-batch advances it.

    Needs the RocksDB state store provider.  Delivery is at least once, so tools
    must be idempotent.
    """
    import sys

    from pyspark import cloudpickle
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    # Spark sets a processor up in a process of its own that doesn't get files sent
    # to executors, so the machine's code travels with the processor.
    for module in (sys.modules[__name__], guards):
        cloudpickle.register_pickle_by_value(module)

    class Stepper(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.kept = handle.getValueState("run", StructType([StructField("dump", StringType())]))

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            run = Run(book, tools)
            if self.kept.exists():
                run.load(self.kept.get()[0])
            pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
            events = list(_drive(run, key[0], zip(pdf["kind"], pdf["payload"])))
            self.kept.update((run.dump(),))
            yield pd.DataFrame(events, columns=EVENTS.names)

        def close(self) -> None:
            pass

    return inputs.groupBy("run_id").transformWithStateInPandas(Stepper(), EVENTS, "Append", "None")
