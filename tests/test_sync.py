import random
from collections import Counter, defaultdict

import pytest

from veriloom.operators import sync


def test_sync(spark):
    rows = [("w", 0, "e1", "x"), ("w", 1, "e2", "x"), ("v", 0, "e3", "x"), ("v", 1, "e4", "y")]
    entries = spark.createDataFrame(rows, "writer_id string, seq int, entry_hash string, entity_ref string")
    edges = spark.createDataFrame([("e1", "e2"), ("e1", "e3"), ("e3", "e4"), ("e1", "e4")], "before string, after string")
    assert {r.writer_id: r.entry_hash for r in sync.tips(entries).collect()} == {"w": "e2", "v": "e4"}
    assert {r.entry_hash: r.depth for r in sync.causal_depth(entries, edges).collect()} == {"e1": 0, "e2": 1, "e3": 1, "e4": 2}
    assert [r.entry_hash for r in sync.converged(entries, edges).orderBy("pos").collect()] == ["e1", "e3", "e2", "e4"]
    assert [(r.entity_ref, r.a, r.b) for r in sync.divergent(entries, edges).collect()] == [("x", "e2", "e3")]
    labels = spark.createDataFrame([("l", "a"), ("l", "b"), ("m", "a")], "label string, entity_ref string")
    assert [list(r.refs) for r in sync.ambiguous_labels(labels).collect()] == [["a", "b"]]
    receipts = spark.createDataFrame([("m", "r1", "o"), ("m", "r2", "p"), ("n", "r1", "o"), ("n", "r2", "o")], "manifest_hash string, runner string, output_hash string")
    assert [(r.manifest_hash, r.outputs) for r in sync.disagreeing_receipts(receipts).collect()] == [("m", 2)]


def history(n, seed, writers=7, entities=25):
    """Entries and edges of ``n`` writes that each observe some tips of others, possibly stale."""
    rng = random.Random(seed)
    entries, edges, by_writer = [], [], {}
    for i in range(n):
        w = rng.choice(["big"] * writers + [f"w{k}" for k in range(writers)])
        own = by_writer.setdefault(w, [])
        entries.append((w, len(own), f"e{i:05d}", rng.choice([None, *(f"x{k}" for k in range(entities))])))
        for other in rng.sample(sorted(by_writer), min(len(by_writer), rng.choice([0, 0, 0, 1, 2]))):
            if other != w and by_writer[other]:
                edges.append((rng.choice(by_writer[other][-3:]), f"e{i:05d}"))
        own.append(f"e{i:05d}")
    return entries, edges


def pasts(entries, edges):
    """Every entry's whole past by brute force."""
    before, last = {}, {}
    for w, _, h, _ in entries:
        before[h] = {last[w]} if w in last else set()
        last[w] = h
    for a, b in edges:
        before[b].add(a)
    past = {}
    for _, _, h, _ in entries:
        past[h] = set().union(*({a} | past[a] for a in before[h]))
    return past


@pytest.mark.parametrize("n,parts", [(2000, None), (200, 9)])
def test_clocks_against_brute_force(spark, n, parts):
    entries, edges = history(n, n)
    past = pasts(entries, edges)
    rows = spark.createDataFrame(entries, "writer_id string, seq int, entry_hash string, entity_ref string").repartition(3)
    links = spark.createDataFrame([*edges, ("gone", "e00001"), ("e00001", "e00001")], "before string, after string")
    clock = sync.clocks(rows, links, parts=parts)
    place = {h: (w, s) for w, s, h, _ in entries}
    want = {(place[h], w, max(s for x in {h} | past[h] for ww, s in [place[x]] if ww == w)) for h in past for w in {place[x][0] for x in {h} | past[h]}}
    assert {((r.writer_id, r.seq), r.known_writer, r.known_seq) for r in clock.collect()} == want
    on = defaultdict(list)
    for _, _, h, e in entries:
        if e is not None:
            on[e].append(h)
    pairs = {(e, a, b) for e, hs in on.items() for a in hs for b in hs if a < b and a not in past[b] and b not in past[a]}
    got = sync.divergent(rows, links, clock=clock).collect()
    assert {tuple(r) for r in got} == pairs and len(got) == len(pairs) > 50
    count = Counter(x for _, a, b in pairs for x in (a, b))
    assert {(r.writer_id, r.seq): r.n for r in sync.conflicts(rows, links, clock=clock).collect()} == {place[h]: k for h, k in count.items()}
    order = [r.entry_hash for r in sync.converged(rows, links, clock=clock).orderBy("pos").collect()]
    at = {h: i for i, h in enumerate(order)}
    assert len(at) == n and all(at[a] < at[h] for h in past for a in past[h])


def test_cycles_are_left_out(spark):
    entries = spark.createDataFrame([("a", 0, "a0", "x"), ("a", 1, "a1", "x"), ("b", 0, "b0", "x"), ("c", 0, "c0", "x"), ("c", 1, "c1", "x")], "writer_id string, seq int, entry_hash string, entity_ref string")
    edges = spark.createDataFrame([("a0", "b0"), ("b0", "a0"), ("c1", "c0")], "before string, after string")
    assert {tuple(r) for r in sync.on_cycles(sync.clocks(entries, edges)).collect()} == {("a", 0), ("b", 0)}
    assert [r.entry_hash for r in sync.converged(entries, edges).orderBy("pos").collect()] == ["c0", "c1", "a1"]


def test_rounds_leave_entries_out_that_observe_nothing(spark, monkeypatch):
    """A round of the clocks writes what entries know of others, not every entry's own number again."""
    sizes, settled = [], sync.settled

    def counting(df):
        out = settled(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(sync, "settled", counting)
    rows = [("quiet", i, f"q{i}", "x") for i in range(400)] + [(f"w{i}", 0, f"e{i}", "x") for i in range(9)]
    entries = spark.createDataFrame(rows, "writer_id string, seq int, entry_hash string, entity_ref string")
    edges = spark.createDataFrame([(f"e{i}", f"e{i + 1}") for i in range(8)], "before string, after string")
    assert sync.clocks(entries, edges).count() == 400 + 9 * 10 // 2
    assert sum(sizes) < 1100


def test_rivals_and_clocks_take_more_tasks_for_more_rows(spark, monkeypatch):
    from veriloom.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    entries, edges = history(300, 5)
    rows = spark.createDataFrame(entries, "writer_id string, seq int, entry_hash string, entity_ref string")
    links = spark.createDataFrame(edges, "before string, after string")
    clock = sync.clocks(rows, links)
    found = sync.rivals(rows, links, clock=clock)
    assert found.rdd.getNumPartitions() > 8
    monkeypatch.setattr(tables, "TASK_ROWS", 500_000)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, sync.rivals(rows, links, clock=sync.clocks(rows, links)).collect()))
