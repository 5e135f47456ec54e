"""Byte-level BPE encoding and decoding.

Texts go through the tiktoken library with a local rank file.  A long text is
cut first, at boundaries that no match of the splitting pattern spans (a single
space between two ASCII letters: the space always begins the right match), so
that the library never holds more than about a block; pieces' ids concatenate to
the whole text's.  Ids decode to raw bytes.

Defined results: a null or empty text has no ids; repeated rows each give a row;
an empty table gives an empty result; other columns are neither read nor
returned; a null id stays null.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame

from veriloom.llm.columns import map_texts

BLOCK = 1 << 15
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_codecs: dict[tuple[str, str], "Codec"] = {}


def safe_blocks(text: str, block: int = BLOCK) -> Iterator[str]:
    """``text`` cut at safe boundaries into pieces of about ``block`` characters."""
    start = 0
    while len(text) - start > block:
        cut = _SAFE.search(text, start + block)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def id_bytes(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit integers, little-endian."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Codec:
    """An encoder and decoder over a local rank file, without special tokens."""

    def __init__(self, rank_path: str, pattern: str) -> None:
        import tiktoken

        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= BLOCK:
            return self._library.encode_ordinary(text)
        return [i for piece in safe_blocks(text) for i in self._library.encode_ordinary(piece)]

    def decode(self, ids: list[int]) -> bytes:
        return self._library.decode_bytes(ids)


def codec(rank_path: str, pattern: str) -> Codec:
    """The codec of a rank file, loaded once a process."""
    if (rank_path, pattern) not in _codecs:
        _codecs[rank_path, pattern] = Codec(rank_path, pattern)
    return _codecs[rank_path, pattern]


def encode(df: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<bigint>`` of every row."""

    def make():
        c = codec(rank_path, pattern)
        return lambda texts: [[c.encode(t) for t in texts]]

    return map_texts(df, make, "ids array<bigint>", id_col, text_col)


def decode(df: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, bytes binary`` of every row's ids (null: no bytes)."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import BinaryType, StructField, StructType

    out = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("bytes", BinaryType())])

    def run(batches):
        import pyarrow as pa

        c = codec(rank_path, pattern)
        for batch in batches:
            raw = [c.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[id_col, "bytes"])

    return df.select(F.col(id_col), F.col(ids_col).cast("array<bigint>").alias("__ids")).mapInArrow(run, out)


def round_trip(df: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: encodes, decodes, keeps digests."""

    def make():
        c = codec(rank_path, pattern)

        def apply(texts):
            n, ids_hash, decoded_hash = [], [], []
            for text in texts:
                ids = c.encode(text)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(id_bytes(ids)).hexdigest())
                decoded_hash.append(hashlib.sha256(c.decode(ids)).hexdigest())
            return [n, ids_hash, decoded_hash]

        return apply

    return map_texts(df, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", id_col, text_col)
