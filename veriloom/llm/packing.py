"""Packing of tokenised documents into sequences by minimum bin slack.

A document longer than a sequence is cut into whole sequences and a remainder.
Remainders go to pools of about ``pool_rows`` rows (dealt by a hash, so no key
can fill one).  In a pool each window takes the longest remainder left, and a
bitset dynamic program over the counts of the other lengths finds the multiset
whose sum comes closest to the room left; the counts are backtracked from the
bitsets.  Where even the best multiset leaves ``grain`` ids of room or more (many
pieces of one length), the longest piece left is cut; checksums of its prefixes
give the checksums of its parts.  A sequence is padded to capacity unless its length is a power of two.

Defined results: a null or empty text has the end id alone; repeated rows are
packed each; a null id stays null; an empty table gives an empty result; other
columns are neither read nor returned.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from veriloom.llm.bpe import BLOCK, id_bytes, safe_blocks
from veriloom.llm.columns import BLOCK_CHARS, blocks

SPECIAL = "<|endoftext|>"


class ByteIds:
    """Ids of whole texts by a tokenizers file, as little-endian unsigned 32-bit bytes.

    The file's vocabulary and merges also drive a faster encoder, which gives the
    same ids (its merges rank by id; the constructor proves that of the file).
    Texts that hold the special token's string go through the library itself.
    """

    def __init__(self, path: str) -> None:
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        vocab, merges = model["vocab"], model["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ids = [vocab[a + b] for a, b in pairs]
        if ids != sorted(ids):
            raise ValueError("merges that don't rank by id")
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token != SPECIAL}
        self._fast = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:
            return id_bytes(self._library.encode(text, add_special_tokens=False).ids)
        if len(text) <= BLOCK:
            return id_bytes(self._fast.encode_ordinary(text))
        return b"".join(id_bytes(self._fast.encode_ordinary(piece)) for piece in safe_blocks(text))


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_encoders: dict[str, ByteIds] = {}


def encoder(path: str) -> ByteIds:
    """The encoder of a tokenizers file, loaded once a process."""
    if path not in _encoders:
        _encoders[path] = ByteIds(path)
    return _encoders[path]


def fill(room: int, counts: dict[int, int], lengths: list[int]) -> list[tuple[int, int]]:
    """(length, count) pairs whose sum is the largest that ``room`` holds.

    ``lengths``: the keys of ``counts`` in falling order.  Bit s of a bitset says
    that some multiset of the lengths so far sums to s; it stops once ``room``
    itself is reached.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in lengths:
        if length > room:
            continue
        left, part, after = min(counts[length], room // length), 1, reach
        while left > 0:
            take = min(part, left)
            after |= (after << (take * length)) & mask
            left -= take
            part *= 2
        if after != reach:
            steps.append((length, counts[length], reach))
            reach = after
            if reach >> room & 1:
                break
    target, taken = reach.bit_length() - 1, []
    for length, most, before in reversed(steps):
        n = 0
        while not before >> target & 1:
            target -= length
            n += 1
        if n:
            taken.append((length, n))
    return taken


def windows(lengths: np.ndarray, capacity: int, grain: int = 64) -> list[list[tuple[int, int, int]]]:
    """(index, from, to) ranges of ``lengths`` (each under ``capacity``) by window.

    If the best multiset leaves room for ``grain`` ids or more, the longest piece
    left is cut at a multiple of ``grain``; its rest goes back to the stock.
    """
    stock: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, n in enumerate(lengths.tolist()):
        stock[n].append((i, 0))
    counts = {n: len(v) for n, v in stock.items()}
    order = sorted(counts)  # rising, so that the longest is at the end
    out = []

    def take(length: int) -> tuple[int, int, int]:
        i, start = stock[length].pop()
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
            del order[bisect_left(order, length)]
        return i, start, start + length

    while order:
        room = capacity - order[-1]
        window = [take(order[-1])]
        if room in counts:
            window.append(take(room))
            room = 0
        elif room:
            for length, n in fill(room, counts, order[::-1]):
                window += [take(length) for _ in range(n)]
                room -= length * n
        if room >= grain and order:
            i, start, end = take(order[-1])
            cut = start + room // grain * grain
            window.append((i, start, cut))
            if end - cut not in counts:
                counts[end - cut] = 0
                insort(order, end - cut)
            counts[end - cut] += 1
            stock[end - cut].append((i, cut))
        out.append(window)
    return out


def range_crc(to_end: int, to_start: int, n_bytes: int) -> int:
    """The checksum of the last ``n_bytes`` of a prefix from the checksums of the longer and the shorter prefix."""
    zeros = bytes(n_bytes)
    return to_end ^ zlib.crc32(zeros, to_start) ^ zlib.crc32(zeros)


def pieces(df: DataFrame, tokenizer_path: str, *, capacity: int, end_id: int, grain: int, id_col: str, text_col: str) -> DataFrame:
    """``id_col, start, length, doc_tokens, row, crcs``: full sequences and remainders.

    ``crcs``: checksums of the piece's prefixes at the multiples of ``grain``
    below its length, then of all of it; of a full sequence only the last.
    """
    names = ("start", "length", "doc_tokens", "row")
    out = StructType([StructField(id_col, df.schema[id_col].dataType), *(StructField(c, LongType()) for c in names), StructField("crcs", ArrayType(LongType()))])

    def run(batches):
        import pyarrow as pa

        encode, end, row = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts, BLOCK_CHARS):
                at, columns = [], [[] for _ in range(5)]
                for i in range(a, b):
                    ids = encode(texts[i]) + end
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        part = ids[4 * start : 4 * (start + capacity)]
                        crc, crcs = 0, []
                        if len(part) < 4 * capacity:
                            for k in range(0, len(part), 4 * grain):
                                crc = zlib.crc32(part[k : k + 4 * grain], crc)
                                crcs.append(crc)
                        else:
                            crcs.append(zlib.crc32(part))
                        at.append(i)
                        for column, value in zip(columns, (start, len(part) // 4, total, row, crcs)):
                            column.append(value)
                        row += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.list_(pa.int64()))],
                    names=out.names,
                )

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, out)


def pack(
    df: DataFrame,
    tokenizer_path: str,
    *,
    capacity: int = 2048,
    end_id: int = 1,
    pool_rows: int = 8192,
    grain: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece."""
    pools = max(1, -(-df.count() // pool_rows))
    cut = pieces(df, tokenizer_path, capacity=capacity, end_id=end_id, grain=grain, id_col=id_col, text_col=text_col)
    pooled = cut.withColumn("pool", F.pmod(F.xxhash64(id_col, "row", "crcs"), F.lit(pools)))
    names = (id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    out = StructType([cut.schema[id_col], *(StructField(c, LongType()) for c in names[1:])])

    def one(table):
        import pyarrow as pa

        starts, lengths, totals = (table.column(c).to_pylist() for c in ("start", "length", "doc_tokens"))
        crcs = table.column("crcs").to_pylist()
        order = sorted(range(len(lengths)), key=lambda i: (crcs[i][-1], lengths[i], starts[i]))
        ranges = [[(i, 0, capacity)] for i in order if lengths[i] == capacity]
        rest = [i for i in order if lengths[i] < capacity]
        ranges += [[(rest[i], a, b) for i, a, b in w] for w in windows(np.array([lengths[i] for i in rest], np.int64), capacity, grain)]
        base = table.column("pool")[0].as_py() << 32
        at, columns = [], [[] for _ in names[1:]]
        for k, window in enumerate(ranges):
            offset = 0
            for i, a, b in window:
                crc = crcs[i][-1] if b == lengths[i] else crcs[i][b // grain - 1]
                if a:
                    crc = range_crc(crc, crcs[i][a // grain - 1], 4 * (b - a))
                at.append(i)
                for column, value in zip(columns, (starts[i] + a, b - a, crc, totals[i], base + k, offset)):
                    column.append(value)
                offset += b - a
        return pa.Table.from_arrays([table.column(id_col).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    return pooled.groupBy("pool").applyInArrow(one, out)
