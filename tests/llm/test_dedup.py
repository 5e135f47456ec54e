import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from veriloom.llm import fingerprints, line_dedup, minhash_dedup
from veriloom.llm.graph import components


def shingles(text, width):
    words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def groups(sets, percent):
    up = {d: d for d in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    inverted = defaultdict(set)
    for d in ids:
        for s in sets[d]:
            inverted[s].add(d)
    for d in ids:
        for e in {e for s in sets[d] for e in inverted[s] if e < d}:
            if 100 * len(sets[d] & sets[e]) >= percent * len(sets[d] | sets[e]):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, docs, width, percent):
    sets = {r.doc_id: shingles(r.text, width) for r in docs.collect()}
    want = groups(sets, percent)
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs, width=width, percent=percent).collect()}
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), want[d], want[d] == d) for d in sets}


def test_groups_of_edited_copies(spark):
    """Copies of one text with a few to many words changed, and chains of copies of copies."""
    rng = np.random.default_rng(4)
    word = lambda: "w%d" % rng.integers(10**6)
    base = [word() for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        text = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 14)):
            text[at] = word()
        rows.append((i, " ".join(text)))
    chain = [word() for _ in range(120)]
    for i in range(120, 150):
        chain[(7 * i) % 120] = word()
        rows.append((i, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = groups({d: shingles(t, 3) for d, t in rows}, 85)
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df, width=3, percent=85).collect()} == want


def test_near_duplicates_edges(spark, edge, none):
    rows = minhash_dedup.near_duplicates(edge, width=3, percent=85).collect()
    assert len(rows) == edge.count() and minhash_dedup.near_duplicates(none).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[0].n_shingles == 0 and by[0].kept and by[7].component_id == 6 and not by[7].kept and by[None].kept


def test_links_through_a_null_id(spark):
    """Of near copies the middle one has no id; it links the others, and is a copy itself."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(8):
        base = ["w%d" % x for x in rng.integers(0, 10**6, 120)]
        copies = [(None, base)] + [(10 * k + i, [*base[: 20 * i], "new%d" % i, *base[20 * i + 1 :]]) for i in range(1, 5)]
        rows += [(d, " ".join(t)) for d, t in copies]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minhash_dedup.near_duplicates(df).collect()
    assert all(r.component_id == r.doc_id // 10 * 10 + 1 for r in got if r.doc_id is not None)
    assert sorted(r.component_id for r in got if r.doc_id is None) == [10 * k + 1 for k in range(8)] and sum(r.kept for r in got) == 8


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (None, 1)] + [(100, i) for i in range(101, 140)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 6, 8: 6, 7: 6, 6: 6, **dict.fromkeys(range(100, 140), 100)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_line_dedup(spark, docs, edge, none):
    passage = "Alpha beta gamma delta one. Epsilon zeta eta theta two. Iota kappa lambda mu three. Nu xi omicron pi four.\nRho sigma tau upsilon five. Phi chi psi omega six. Last of the long passage seven. And one more line eight.\n"
    rows = [(i, f"Own start number {i} of a text here.\n{passage}Own end number {i} of the text there.\n") for i in range(6)] + [(10, "A clean text.\nWith lines of its own.\n"), (11, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("id", __import__("pyspark").sql.functions.lit("clash"))
    out = {r.doc_id: r for r in line_dedup.remove_repeats(df, counts=("n", "c")).collect()}
    assert out[0].text == rows[0][1] and out[10].text == rows[6][1] and out[11].text is None and out[0].id == "clash"
    for i in range(1, 6):
        assert "Own start number" in out[i].text and "Own end number" in out[i].text
        assert len(out[i].text) < len(rows[i][1]) - len(passage) / 2 and out[i].c == len(rows[i][1]) - len(out[i].text)
    got = line_dedup.remove_repeats(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert line_dedup.remove_repeats(edge).count() == edge.count() and line_dedup.remove_repeats(none).count() == 0
    # What is left is made of whole units of the text; what went stands in a document of smaller id, or earlier in this one.
    src = {r.doc_id: r.text for r in docs.collect()}
    cut = lambda t: [u for u in re.split(line_dedup.UNIT_END, t) if u]
    first = {}
    for d in sorted(src):
        for u in cut(src[d]):
            first.setdefault(u.rstrip(" \n\r\t"), d)
    for r in got.collect():
        if r.text != src[r.doc_id]:
            left = cut(r.text)
            it = iter(cut(src[r.doc_id]))
            gone = []
            for u in left:
                for v in it:
                    if v == u:
                        break
                    gone.append(v)
            gone += list(it)
            stays = {u.rstrip(" \n\r\t") for u in left}
            assert gone and all(first[u.rstrip(" \n\r\t")] < r.doc_id or u.rstrip(" \n\r\t") in stays for u in gone)


def left_by_hand(spark, rows, min_chars=50, long_chars=250, long_words=50):
    """Texts after line dedup by plain Python, with the operator's chunk boundaries alone: what must go, and only that."""
    from pyspark.sql import functions as F

    texts = sorted({(i, t) for i, t in rows if t is not None}, key=str)
    df = spark.createDataFrame(texts, "id bigint, text string")
    cut = df.select("id", "text", F.xxhash64("text").alias("th"), line_dedup.units(F.col("text")).alias("u"), line_dedup.chunks(F.col("text"), short=20, sparse=16).alias("c")).collect()
    bare = lambda us: "\n".join(u.rstrip(" \n\r\t") for u in us)
    first, found = {}, []
    for r in cut:
        for c in r.c:
            if c.n > 0:
                found.append(((r.id is None, r.id or 0, r.th, c.s), bare(r.u[c.s - 1 : c.e]), r, c))
    for place, body, *_ in found:
        first[body] = min(first.get(body, place), place)
    out = {}
    for r in cut:
        gone = sorted((c.s, c.e, c.n, body) for place, body, q, c in found if q is r and place != first[body])
        runs = []
        for s, e, n, body in gone:
            if runs and runs[-1][1] + 1 == s:
                runs[-1][1:3] = e, runs[-1][2] + n
            else:
                runs.append([s, e, n, len(body.split())])
        drop = {i for s, e, n, w in runs if n >= min_chars and (e > s or n >= long_chars or w >= long_words) for i in range(s, e + 1)}
        out[r.id, r.text] = "".join(u for i, u in enumerate(r.u, 1) if i not in drop), len(drop)
    return out


def test_line_dedup_by_hand(spark, docs, edge):
    """Every text against plain Python; rows given twice, ids given twice and ids that are null among them."""
    rows = [(r.doc_id, r.text) for df in (docs, edge) for r in df.select("doc_id", "text").collect()]
    some = [t for _, t in rows if t and 300 < len(t) < 3000][:20]
    rows += rows[:40] + [(None, t) for t in some[:8]] + [(None, some[0]), (3, some[3]), (3, some[4])] + [(5000 + i, t + t) for i, t in enumerate(some)]
    want = left_by_hand(spark, rows)
    got = line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("was", __import__("pyspark").sql.functions.col("text")), counts=("n", "c")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.was is None:
            assert r.text is None and r.n == 0
        else:
            assert (r.text, r.n) == want[r.doc_id, r.was] and r.c == len(r.was) - len(r.text)
    assert sum(r.n > 0 for r in got) > 60


def test_whole_runs_go(spark):
    """A shared passage of three short units goes whole, also where its rows are given twice."""
    passage = "Alpha beta gamma delta.\nEpsilon zeta eta theta.\nIota kappa lambda muses.\n"
    rows = [(i, f"Some start that only number {i} has at all.\n{passage}The end of number {i} is its own too.\n") for i in range(30)]
    one, two = (
        {r.doc_id: (r.text, r.n) for r in line_dedup.remove_repeats(spark.createDataFrame(rows * k, "doc_id bigint, text string"), counts=("n", "c")).collect()} for k in (1, 2)
    )
    assert one == two and one[0] == (rows[0][1], 0)


def test_repeats_of_short_units(spark):
    """Passages of short lines and table cells, and of one sentence, between lines that differ."""
    rng = np.random.default_rng(3)
    words = lambda n: " ".join("%03x" % rng.integers(4096) for _ in range(n))
    verse = ["".join(words(3) + "\n" for _ in range(20)) for _ in range(12)]
    table = ["".join(f"| {words(2)} | {words(1)} |\n" for _ in range(20)) for _ in range(4)]
    once = [words(52) + ".\n" for _ in range(4)]
    assert all(len(x) < 250 and len(x.split()) > 50 for x in once)
    passages = verse + table + once
    rows = [(100 * c + k, f"Here is the start of copy {c} of text {k} alone.\n{p}And the end of copy {c} of text {k} here.\n") for k, p in enumerate(passages) for c in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    gone = {r.doc_id: r.c for r in line_dedup.remove_repeats(df, counts=("n", "c")).collect()}
    share = lambda ks: np.mean([gone[100 * c + k] / len(passages[k]) for k in ks for c in (1, 2, 3)])
    assert all(gone[k] == 0 for k in range(20))
    assert share(range(12)) > 0.7 and share(range(12, 16)) > 0.7 and share(range(16, 20)) > 0.7
    assert all(gone[100 * c + k] > 0 for k in range(16) for c in (1, 2, 3))


def by_hand(text):
    parts = [p.rstrip(" \n\r\t") for p in re.split(r"(?<=[ \n])" if len(text) < 200 else fingerprints.PARAGRAPH_END, text)]
    return {p for p in parts if p}


def test_fingerprints(spark, docs, edge, none):
    src = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs, rows=37).collect()}
    order = sorted(src, reverse=True)
    for i, d in enumerate(order):
        text, after = src[d], src[order[(i + 1) % len(order)]]
        k = len(text) // 2
        edited = text[: len(text) - k] + after[:k]
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((got[d].near_edited, edited), (got[d].near_next, after)):
            assert 0 <= near <= 1
            if max(len(text), len(other)) < 2000:
                a, b = by_hand(text), by_hand(other)
                assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
    same = defaultdict(set)
    for d, t in src.items():
        same[t].add(got[d].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9
    assert fingerprints.edited_fingerprints(edge).count() == edge.count() and fingerprints.edited_fingerprints(none).count() == 0


def test_likeness_across_text_sizes(spark):
    """Long texts are compared by the sets of their units, pairs across a border by one rule."""
    units = [f"Unit number {i} of a text stands here. " for i in range(200)]
    a, b, c = "".join(units[:55]), "".join(units[:50]), "".join(units[:150])
    short, more = "".join(units[:5]), "".join(units[:6])
    assert len(b) < 2000 < len(a) and len(short) < 200 < len(more)
    texts = [a, b, c, a, more, short, more, c, "A text."]
    df = spark.createDataFrame(list(enumerate(reversed(texts))), "doc_id bigint, text string")
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(df).collect()}
    units_of = lambda t, words: {p.rstrip() for p in re.split(" " if words else fingerprints.PARAGRAPH_END, t)} - {""}
    for i, (text, after) in enumerate(zip(texts, texts[1:])):
        k, row = len(text) // 2, got[len(texts) - 1 - i]
        for near, other in ((row.near_next, after), (row.near_edited, text[: len(text) - k] + after[:k])):
            x, y = (units_of(t, max(len(text), len(other)) < 200) for t in (text, other))
            assert near == pytest.approx(len(x & y) / len(x | y))


def test_peel_recovers_differences(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1, 2, 3, 5 << 40], [2, 3, 4 << 20])], "a array<bigint>, b array<bigint>")
    r = df.select(fingerprints.peel(fingerprints.subtract(fingerprints.sketch(F.col("a"), F.lit(8)), fingerprints.sketch(F.col("b"), F.lit(8))), F.lit(8)).alias("p")).first().p
    assert r.ok and sorted(r.a) == [1, 5 << 40] and list(r.b) == [4 << 20]


def test_larger_sketches(spark):
    """Pairs of many groups are recovered from rows of cells; groups that aren't are counted all the same."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    pairs = []
    for i, (n, m, both) in enumerate([(0, 0, 0), (5, 0, 0), (0, 7, 0), (40, 40, 40), (30, 45, 0), (2500, 2300, 500), (3000, 3000, 2990), (64, 1, 1)] * 3):
        a, b = (rng.integers(-(2**62), 2**62, k).tolist() for k in (n, m))
        b[:both] = a[:both]
        pairs.append((i, a, b, len(set(a) ^ set(b))))
    df = spark.createDataFrame(pairs, "i int, a array<bigint>, b array<bigint>, want int").repartition(3, "i")
    small = lambda a, b: fingerprints.small_cells(*(fingerprints.sketch(F.col(c), F.lit(8)) for c in (a, b)), 8)
    asked = df.select("i", F.array(F.struct("a", "b", F.lit(None).cast(df.select(small("a", "b")).schema[0].dataType).alias("small")), F.struct("a", "b", small("a", "b").alias("small"))).alias("sides"))
    for rounds in (0, 2, 6):
        got = fingerprints.recovered(asked, ["i"], rounds=rounds)
        rows = {(r.i, r.pair): r for r in got.collect()}
        assert len(rows) == 2 * len(pairs)
        if rounds == 6:
            assert sum(len(r.stuck) for r in rows.values()) < 30
        for k in (0, 1):
            one = df.join(got.where(F.col("pair") == k), "i").select("i", "want", (F.col("n") + fingerprints.in_groups(F.col("a"), F.col("b"), F.col("stuck"))).alias("n"))
            assert {r.i: r.n for r in one.collect()} == {i: want for i, *_, want in pairs}


def test_ranges_of_ids(spark):
    """Successors where one id, or one row, is a third of all, ids are null or text, and ranges are small."""
    from pyspark.sql import functions as F

    rows = [(i, f"text {i}") for i in range(40)] + [(7, f"seven {i}") for i in range(20)] + [(9, "nine")] * 25 + [(None, f"none {i}") for i in range(15)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    for cast in ("bigint", "string"):
        got = fingerprints.with_next(df.withColumn("id", F.col("id").cast(cast)), rows=8).collect()
        want = sorted(((str(r.id) if cast == "string" and r.id is not None else r.id, r.text, r.th) for r in df.withColumn("th", F.xxhash64("text")).collect()), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0 if cast == "bigint" else "", r[2]), reverse=True)
        assert len({r.part for r in got}) > 8 and max(r.at for r in got) < 30
        from collections import Counter

        assert Counter((r.id, r.text, r.next_text) for r in got) == Counter((a[0], a[1], b[1]) for a, b in zip(want, want[1:] + want[:1]))


@pytest.mark.parametrize("rows", [8, 1024])
def test_texts_are_shuffled_once(spark, docs, rows):
    """Ranges are read as they were written: nothing is dealt by range again, but for one row of each."""
    plan = fingerprints.edited_fingerprints(docs, rows=rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(part" not in plan and "Exchange hashpartitioning(to" in plan


def test_null_ids_link_others(spark):
    """A row without an id between two others brings them into one component; many far copies of one text are told apart."""
    words = [f"w{i}" for i in range(300)]
    near = lambda *swaps: " ".join(f"x{s}" if i in swaps else w for i, w in enumerate(words) for s in [i])
    chain = [(1, near(*range(0, 12))), (None, near(*range(0, 12), *range(40, 52))), (3, near(*range(0, 12), *range(40, 52), *range(80, 92)))]
    df = spark.createDataFrame(chain, "doc_id bigint, text string")
    sets = {i: shingles(t, 3) for i, (_, t) in enumerate(chain)}
    assert len(sets[0] & sets[2]) * 100 < 85 * len(sets[0] | sets[2])
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df, width=3, percent=85).collect()}
    assert got == {1: 1, None: 1, 3: 1}
    rng = np.random.default_rng(5)
    many = [(i, near(*rng.choice(300, int(rng.integers(2, 14)), replace=False).tolist())) for i in range(700)] + [(1000, near())]
    far = {i: shingles(t, 3) for i, t in many}
    want = groups(far, 85)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(many, "doc_id bigint, text string"), width=3, percent=85).collect()}
    assert got == want and len(set(want.values())) > 20


def test_pipeline(spark, docs, none, tmp_path):
    sf = "/root/testdata/sf0.001"
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, sf)
        assert stage(spark, none, sf).count() == 0, name
        if name != "packing":
            assert after.columns == docs.columns, name
            after.write.mode("overwrite").parquet(str(tmp_path / name))
            now = spark.read.parquet(str(tmp_path / name))
    assert 0 < now.count() < docs.count()
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in now.select("doc_id").collect()}
    total = corpus_pipeline.run(spark, sf)
    assert total.agg({"length": "sum"}).first()[0] == after.agg({"length": "sum"}).first()[0]


def test_no_link_is_missed_at_size(spark):
    """Every id divisible by 50 against all of 10,000 documents: linked texts are in one component."""
    import re
    from collections import Counter, defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    root = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, width=3, percent=85).collect()}
    low, sets, post = {i: i + 32 for i in range(65, 91)}, {}, defaultdict(list)
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(low))
        sets[r.doc_id] = set(zip(words, words[1:], words[2:])) if len(words) > 2 else {tuple(words)} if words else set()
    for k, s in sets.items():
        for x in s:
            post[x].append(k)
    links = 0
    for k in (k for k in sets if k % 50 == 0):
        shared = Counter(o for x in sets[k] for o in post[x] if o != k)
        near = [o for o, n in shared.items() if 100 * n >= 85 * (len(sets[k]) + len(sets[o]) - n)]
        assert {root[o] for o in near} <= {root[k]}
        links += len(near)
    assert links > 50
