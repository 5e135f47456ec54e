"""Spelling variants, token-id files and resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from veriloom.llm import id_files, queries, resampling, spelling
from veriloom.llm.columns import drop_folder, shared_uri

JSON = P.path("byte_bpe_50k.json")
LOWER = {i: i + 32 for i in range(65, 91)}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def plain_variants(rows, every=None, least=5, times=3):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= times}
    near = defaultdict(list)
    shorter = defaultdict(set)  # candidates: words that share a string with one code point less, or are it
    for w in n:
        for s in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            shorter[s].add(w)
    for group in shorter.values():
        for a in group:
            near[a] += [b for b in group if one_edit(a, b)]
    form = {}
    for w in n:
        best = min(((-n[b], b) for b in set(near[w])), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(set(near[w])), n.get(form[w])) for w in n}


def got_variants(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_neighbourhoods_are_whole_and_distinct():
    rng = random.Random(2)
    letters = "abcé"
    alphabet = np.array(sorted(map(ord, letters)), np.uint32)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(40)] + ["aaaa", "aabb"]
    key = dict(zip(words, spelling.word_keys(words).tolist()))
    for at_once in (1, 30, 1 << 20):
        for at, codes in spelling.by_length(words):
            made = defaultdict(list)
            for row, keys, _ in spelling.neighbourhoods(codes, alphabet, at_once):
                for r, k in zip(row.tolist(), keys.tolist()):
                    made[words[at[r]]].append(k)
            for w, keys in made.items():
                want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
                want = sorted(want - {w} - {""}) + ([""] if len(w) == 1 else [])
                n = codes[[words[i] for i in at].index(w)].size
                assert n == len(w)
                assert sorted(keys) == sorted([k for x in want for k in spelling.word_keys([x] if x else []).tolist() or [0]] * [words[i] for i in at].count(w))
    assert len(set(key.values())) == len(set(words))


def test_variants_on_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = plain_variants(rows, 97)
    assert len(want) > 1000 and sum(r[1] is not None for r in want) > 50 and any(r[1] != r[2] and r[1] for r in want)
    assert got_variants(queries.op11_spelling_variants(spark, "/root/testdata/sf0.001")) == want


@pytest.mark.parametrize("bits", [3, 12, 27])
def test_variants_on_edges(spark, edge, none, bits):
    rng = random.Random(5)
    words = ["grosse", "große", "großen", "Grosse", "grossee", "aaaaa", "aaaaaa", "aaaab", "straße", "x" * 3000, "x" * 2999, "x" * 2998 + "é", "÷×÷×÷", "÷×÷××"]
    rows = [(i if i % 7 else None, " ".join(rng.choices(words, k=12)) + "-Aaaaa") for i in range(40)]
    df = edge.select("doc_id", "text", "score").union(spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id bigint, text string, score double"))
    every = [(r.doc_id, r.text) for r in df.collect()]
    assert got_variants(spelling.variants(df, bitmap_bits=bits)) == plain_variants(every)
    assert spelling.variants(none).count() == 0


def test_portions_cut_between_words():
    rng = random.Random(1)
    text = "".join(rng.choice("ab é.") for _ in range(5000))
    for size in (1, 10, 10_000):
        parts = list(spelling.portions(text, size))
        assert "".join(parts) == text
        assert [w for x in parts for w in spelling.WORD.findall(x)] == spelling.WORD.findall(text)


@pytest.mark.parametrize("gap", [1, 2, 70, 5000, 1 << 33])
def test_elias_fano(gap):
    rng = np.random.default_rng(gap % 1000)
    for n in (1, 2, 255, 256, 257, 3000):
        values = np.cumsum(rng.integers(0 if gap > 1 else 1, gap + 1, n))
        made = id_files.EliasFano.encode(values)
        assert [made.select(i) for i in range(n)] == values.tolist()
        for _ in range(10):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert made.between(a, b).tolist() == values[a:b].tolist()
        # Near-minimal: two bits and the low bits a number, and a sample in 256.
        bits = 64 * (len(made.low) + len(made.high) + len(made.samples))
        assert bits <= n * (3 + max(0, math.log2(max(1, values[-1] / n)))) + 64 * n / 256 + 400
    with pytest.raises(IndexError):
        made.select(n)


@pytest.mark.parametrize("width", [2, 4])
def test_shard(width, tmp_path):
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 1 << 15, k).astype(f"<u{width}") for k in (1, 5, 1, 700, 3)]
    data = id_files.shard_bytes(pa.array([None, "a", "a", "b", ""]), [len(x) for x in lists], b"".join(x.tobytes() for x in lists), width)
    (tmp_path / "x.ids").write_bytes(data)
    shard = id_files.Shard(np.memmap(tmp_path / "x.ids", np.uint8, "r"))
    assert shard.keys().to_pylist() == [None, "a", "a", "b", ""]
    assert all((shard.ids(i) == x).all() for i, x in enumerate(lists))
    with pytest.raises(ValueError):
        id_files.Shard(bytes(64))


def plain_ids(rows, end):
    library = Tokenizer.from_file(JSON)
    return [[*library.encode(t or "", add_special_tokens=False).ids, end] for _, t in rows]


def test_id_files_on_documents(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want, start = set(), 0
    for (key, _), ids in zip(rows, plain_ids(rows, 2)):
        want.add((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {tuple(r) for r in queries.op12_id_files(spark, "/root/testdata/sf0.001").collect()} == want


@pytest.mark.parametrize("shard_ids,width", [(50, 2), (1 << 20, 4)])
def test_id_files_on_edges(spark, edge, none, shard_ids, width):
    folder = shared_uri(spark, "ids")
    shards = id_files.write(edge.repartition(3), JSON, folder, end_id=2, shard_ids=shard_ids, width=width)
    assert shards.count() > (2 if shard_ids == 50 else 0)
    back = sorted(id_files.read(spark, folder, edge.schema["doc_id"].dataType).collect(), key=lambda r: r.start)
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert [r.doc_id for r in back] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    at = 0
    for r in back:
        assert r.start == at
        at += len(r.ids) // 4
    made = Counter((r.doc_id, bytes(r.ids)) for r in back)
    assert made == Counter((k, np.array(x, "<u4").tobytes()) for (k, _), x in zip(rows, plain_ids(rows, 2)))
    drop_folder(spark, folder)
    empty = shared_uri(spark, "ids")
    id_files.write(none, JSON, empty, end_id=2)
    assert id_files.offsets(spark, empty, none.schema["doc_id"].dataType).count() == 0
    drop_folder(spark, empty)


def test_attempts_that_were_lost_are_not_read(spark, docs):
    folder = shared_uri(spark, "ids")
    id_files.write(docs, JSON, folder, end_id=2, shard_ids=1000)
    files, top = id_files._file_system(folder)
    with files.open_output_stream(f"{top}/left-over.ids") as out:
        out.write(b"half a shard")
    assert id_files.offsets(spark, folder, docs.schema["doc_id"].dataType).count() == docs.count()
    drop_folder(spark, folder)


def plain_resampling(rows, target, buckets=10_000, percent=25, least=20, seed=7, grams=2):
    def feats(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, grams + 1) for i in range(len(words) - n + 1)]

    made = [(key, *feats(text)) for key, text in rows]
    s, t = Counter(b for *_, f in made for b in f), Counter(b for x in target for b in feats(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for key, n, f in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([n, key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((x for x in out if x[0] >= least), key=lambda x: (-x[4], x[1] is None, x[1] or 0))
    drawn = {id(x): i + 1 for i, x in enumerate(fit[: len(fit) * percent // 100])}
    return Counter((*x[1:], drawn.get(id(x))) for x in out)


def test_resampling_on_documents(spark, docs):
    target = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in queries.op13_resampling(spark, "/root/testdata/sf0.001").collect())
    assert got == plain_resampling(rows, target) and sum(k[4] is not None for k in got) > 40


def test_posting_lists_of_any_width():
    rng = np.random.default_rng(4)
    for n_docs, top in ((1, 3), (40, 2), (3000, 300), (30_000, 5)):
        keys = np.unique(rng.integers(0, 9 * n_docs, 4000))
        bucket, at, counts = keys // n_docs, keys % n_docs, rng.integers(1, top + 1, len(keys))
        firsts, totals, wide, ats, packed = resampling.lists_of(bucket, at, counts)
        gains = rng.integers(-20_000, 20_000, len(firsts))
        want = np.zeros(n_docs, np.int64)
        np.add.at(want, at, counts * gains[np.searchsorted(bucket[firsts], bucket)])
        assert (resampling.added_up(n_docs, wide, ats, packed, gains.tolist()) == want).all() and sum(totals) == counts.sum()


@pytest.mark.parametrize("percent,least,grams,buckets,lists", [(25, 20, 2, 10_000, 1024), (60, 1, 3, 50, 1), (100, 0, 1, 7, 2), (0, 1, 2, 100, 1)])
def test_resampling_on_edges(spark, edge, none, monkeypatch, percent, least, grams, buckets, lists):
    monkeypatch.setattr(resampling, "PART_LISTS", lists)
    df = edge.repartition(5)
    target = ["same words here", "wort lang word", None, "é日 x"]
    goal = spark.createDataFrame([(x,) for x in target], "said string")
    got = resampling.resample(df, goal, percent=percent, min_words=least, grams=grams, buckets=buckets, target_text="said").collect()
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert Counter(tuple(r) for r in got) == plain_resampling(rows, target, buckets, percent, least, grams=grams)
    assert resampling.resample(none, goal, target_text="said").count() == 0
    assert resampling.resample(edge, goal.limit(0), target_text="said").count() == edge.count()
