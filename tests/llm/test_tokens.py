import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veriloom.llm import bpe, packing, token_counts

PIECES, JSON, RANKS = (P.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
PARTS = [*"ab the,.\n   \t▁é日😀'12", "▁▁", "  ", "word", "\r\n", "ing", "\x00", "ﬁ", "<s>", " the", "<|endoftext|>", "\x85", ".\n", "The", " a"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [3, 7, 20, 1 << 16])
def test_transducer_counts_as_the_library(chunk):
    sp, t = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.Transducer(PIECES)
    t.chunk_chars = chunk
    for x in texts(2000):
        assert t.count(x) == len(sp.encode(x)), repr(x)


def test_state_maps_compose_associatively():
    t, rng = token_counts.Transducer(PIECES), random.Random(3)
    for x in (x.replace("▁", " ") for x in texts(300, 5)):
        cuts = sorted(rng.sample(range(len(x) + 1), min(3, len(x))))
        parts = [t.chunk_map(c) for c in (" " + x[: cuts[0]], x[cuts[0] : cuts[1]], x[cuts[1] :])] if len(cuts) > 1 and x else []
        if len(parts) == 3:
            ends = [t.compose(t.compose(*parts[:2]), parts[2]), t.compose(parts[0], t.compose(*parts[1:]))]
            total = [t._run(m.head) if m.count is None else t._run(m.head) + m.count + t._run(m.tail) for m in ends]
            assert total[0] == total[1] == t.count(x)


def test_counts_query(spark, edge, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = token_counts.token_counts(edge, PIECES).collect()
    texts_ = [r.text or "" for r in edge.select("text").collect()]
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted((len(x.encode()), n := len(sp.encode(x)), n > 4096) for x in texts_)
    assert token_counts.token_counts(none, PIECES).count() == 0


def test_round_trip(spark, edge, none):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.round_trip(edge, RANKS, P.PATTERN).collect()
    want = []
    for r in edge.select("text").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    assert bpe.round_trip(none, RANKS, P.PATTERN).count() == 0
    decoded = bpe.decode(bpe.encode(edge, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in decoded) == sorted((r.text or "").encode() for r in edge.select("text").collect())


def test_safe_blocks_keep_ids():
    c = bpe.codec(RANKS, P.PATTERN)
    text = " ".join(texts(400, 9))
    assert "".join(bpe.safe_blocks(text, 50)) == text
    assert [i for piece in bpe.safe_blocks(text, 50) for i in c._library.encode_ordinary(piece)] == c._library.encode_ordinary(text)


def test_byte_ids_as_the_library():
    library, ids = Tokenizer.from_file(JSON), packing.ByteIds(JSON)
    for x in texts(3000, 11):
        assert ids(x) == np.asarray(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x)


def test_fill_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        room = rng.randint(1, 60)
        counts = {n: items.count(n) for n in items}
        taken = packing.fill(room, counts, sorted(counts, reverse=True))
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums}
        assert sum(n * k for n, k in taken) == max(s for s in sums if s <= room) and all(k <= counts[n] for n, k in taken)


@pytest.mark.parametrize("lengths", [[700] * 500, [1025, 900, 3] * 300, list(range(1, 2048))])
def test_windows_cover_everything(lengths):
    seen = defaultdict(list)
    out = packing.windows(np.array(lengths), 2048)
    for window in out:
        assert sum(b - a for _, a, b in window) <= 2048
        for i, a, b in window:
            seen[i].append((a, b))
    for i, n in enumerate(lengths):
        spans = sorted(seen[i])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))
    assert len(out) * 2048 <= 1.04 * sum(lengths) + 2048


def test_packing(spark, docs, edge, none):
    library = Tokenizer.from_file(JSON)
    for df in (docs.select("doc_id", "text"), edge.where("doc_id is not null").dropDuplicates(["doc_id"])):
        ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in df.select("doc_id", "text").collect()}
        docs_, sequences = defaultdict(list), defaultdict(list)
        for r in packing.pack(df, JSON, pool_rows=64).collect():
            assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
            assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
            docs_[r.doc_id].append((r.start, r.start + r.length))
            sequences[r.sequence_id].append((r.offset, r.offset + r.length))
        for spans in (*docs_.values(), *sequences.values()):
            spans.sort()
            assert spans[0][0] == 0 and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))
        assert set(docs_) == set(ids) and all(docs_[d][-1][1] == len(ids[d]) for d in ids)
        assert all(s[-1][1] <= 2048 for s in sequences.values())
        assert sum(1 for _ in sequences) <= sum(map(len, ids.values())) / 2048 * 1.03 + 5
    assert packing.pack(none, JSON).count() == 0
    assert packing.pack(edge, JSON).where("doc_id is null").count() == 1
