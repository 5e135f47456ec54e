"""Token ids as binary files with Elias-Fano encoded document boundaries.

Documents are dealt to ranges of ascending ids, and each task writes the documents
of its range, in order, to shards of about ``shard_ids`` ids.  A shard holds the ids
of its documents one after another (two bytes each if the vocabulary allows, else
four) and the documents' boundaries as an Elias-Fano sequence: each boundary's low
bits packed, its high bits in unary, and the place of every 256th one as a sample.  So
``n`` boundaries below ``u`` take about ``n * (2 + log2(u / n))`` bits, and the start
of any document is found from one sample and the bits after it, without a table of
64-bit offsets.

Layout, little-endian, each section from a multiple of eight bytes on: a header of
eight unsigned 64-bit numbers (magic, documents, ids, bytes an id, low bits, words of
high bits, samples, bytes of keys); low bits; high bits (both in 64-bit words);
samples (unsigned 64-bit numbers, one in 256 documents); the document keys as an
Arrow stream, so that they may be null or of any type; ids.

A task names its files anew each time and hands on a row for each; the table of
those rows (the manifest, in the same folder) is what a reader goes by, so files of
lost or repeated attempts are never read.  The folder is any that pyarrow's file
systems reach and all executors share.

Defined results: a null or empty text has the end id alone; documents of one id are
in order of their texts' hashes, repeated rows stand each; null ids come first; a
very long text is one document of one shard; an empty table gives no shards and an
empty result; other columns are neither read nor written.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from veriloom.llm.columns import BLOCK_CHARS, blocks
from veriloom.llm.packing import encoder

MAGIC = int.from_bytes(b"ids-ef-1", "little")
SAMPLE = 256
_HEADER = 8


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


class EliasFano:
    """A rising sequence of numbers in near-minimal space, with ``select``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        """``values``: at least one number, none below the one before it."""
        n, last = len(values), int(values[-1])
        bits = max(0, (last // n).bit_length() - 1)
        values = values.astype(np.uint64)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(ones[-1] // 64 + 1, np.uint64)
        np.bitwise_or.at(high, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits:
            at = np.arange(n) * bits
            part, shift = values & np.uint64((1 << bits) - 1), (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, part << shift)
            over = np.flatnonzero((at & 63) + bits > 64)
            np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (np.uint64(64) - shift[over]))
        return cls(n, bits, low, high, ones[::SAMPLE].astype(np.uint64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        part = np.asarray(self.low[word]) >> shift
        over = np.flatnonzero((at & 63) + self.low_bits > 64)
        part[over] |= np.asarray(self.low[word[over] + 1]) << (np.uint64(64) - shift[over])
        return part & np.uint64((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The ``i``-th number, from the sample before it and the words of high bits after that."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        word, left = start >> 6, i % SAMPLE
        bits = int(self.high[word]) >> (start & 63) << (start & 63)
        while (ones := bits.bit_count()) <= left:
            left, word = left - ones, word + 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        place = 64 * word + (bits & -bits).bit_length() - 1
        return (place - i) << self.low_bits | int(self._low(np.array([i]))[0])

    def between(self, first: int, last: int) -> np.ndarray:
        """The numbers from the ``first``-th to before the ``last``-th: one pass over their high bits."""
        if last <= first:
            return np.zeros(0, np.int64)
        start = int(self.samples[first // SAMPLE])
        end = int(self.samples[-(-last // SAMPLE)]) if -(-last // SAMPLE) < len(self.samples) else 64 * len(self.high)
        words = np.asarray(self.high[start >> 6 : -(-end // 64)])
        ones = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")) + (start >> 6 << 6)
        skip = int(np.searchsorted(ones, start)) + first % SAMPLE
        i = np.arange(first, last)
        places = ones[skip : skip + last - first]
        return (((places - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)).astype(np.int64)


def shard_bytes(keys, lengths: list[int], ids: bytes, width: int) -> bytes:
    """A shard: ``keys`` (an Arrow array) of documents of ``lengths`` ids each, and their ``ids`` of ``width`` bytes."""
    import pyarrow as pa

    bounds = EliasFano.encode(np.cumsum([0, *lengths]))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("key", keys.type)])) as out:
        out.write_batch(pa.record_batch([keys], names=["key"]))
    stream = sink.getvalue().to_pybytes()
    header = [MAGIC, len(lengths), len(ids) // width, width, bounds.low_bits, len(bounds.high), len(bounds.samples), len(stream)]
    low, high, samples = (x.astype("<u8").tobytes() for x in (bounds.low, bounds.high, bounds.samples))
    return b"".join((np.array(header, "<u8").tobytes(), low, high, samples, _padded(stream), ids))


class Shard:
    """A shard over any buffer, such as a mapped file; nothing is read before it is asked for."""

    def __init__(self, data) -> None:
        head = [int(x) for x in np.frombuffer(data, "<u8", _HEADER)]
        if head[0] != MAGIC:
            raise ValueError("no file of token ids")
        self.n, self.n_ids, self.width, low_bits, n_high, n_samples, key_bytes = head[1:]
        at, parts = 8 * _HEADER, []
        for count in (((self.n + 1) * low_bits + 63) // 64 + 1, n_high, n_samples):
            parts.append(np.frombuffer(data, "<u8", count, at))
            at += 8 * count
        self.bounds = EliasFano(self.n + 1, low_bits, *parts)
        self._keys = memoryview(data)[at : at + key_bytes]
        self._ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at + key_bytes + -key_bytes % 8)

    def keys(self):
        """The documents' keys, an Arrow array."""
        import pyarrow as pa

        return pa.ipc.open_stream(self._keys).read_all().column("key").combine_chunks()

    def ids(self, i: int) -> np.ndarray:
        """The ids of the ``i``-th document."""
        return self._ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def slice(self, first: int, last: int) -> np.ndarray:
        """The ids from one place to another."""
        return self._ids[first:last]


def _file_system(folder: str):
    """(file system, path) of a folder's URI."""
    from pyarrow import fs

    scheme, _, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }://{rest}" if rest else folder)


def write(
    df: DataFrame, tokenizer_path: str, folder: str, *, end_id: int, shard_ids: int = 1 << 23, width: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes shards and their manifest to ``folder``; the manifest: ``shard, path, n_docs, n_ids, start``.

    ``start``: the ids of all shards before.  ``width``: bytes of an id, 2 or 4.
    """
    dealt = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    # Copies of one id are told apart by their places, so that they can be dealt to several ranges.
    order = [F.col("key").asc_nulls_first(), F.col("tie"), F.col("row")]
    ranged = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        files, top = _file_system(folder)
        encode, end = encoder(tokenizer_path), np.array([end_id], f"<u{width}").tobytes()
        keys, lengths, ids, k, n = [], [], [], 0, 0

        def flush():
            nonlocal keys, lengths, ids, k, n
            data = shard_bytes(pa.concat_arrays(keys), lengths, b"".join(ids), width)
            shard, path = TaskContext.get().partitionId() << 32 | k, f"{uuid.uuid4().hex}.ids"
            with files.open_output_stream(f"{top}/{path}") as out:
                out.write(data)
            row = pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_docs": len(lengths), "n_ids": n}])
            keys, lengths, ids, k, n = [], [], [], k + 1, 0
            return row

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts, min(BLOCK_CHARS, 4 * shard_ids)):
                keys.append(batch.column(0).slice(a, b - a))
                for text in texts[a:b]:
                    one = np.frombuffer(encode(text), "<u4")
                    if width == 2 and len(one) and int(one.max()) >> 16:
                        raise ValueError("ids of two bytes are too narrow for this vocabulary")
                    ids += (one.astype(f"<u{width}").tobytes(), end)
                    lengths.append(len(one) + 1)
                    n += len(one) + 1
                if n >= shard_ids:
                    yield flush()
        if n:
            yield flush()

    files, top = _file_system(folder)
    files.create_dir(f"{top}/manifest", recursive=True)
    made = ranged.mapInArrow(run, "shard bigint, path string, n_docs bigint, n_ids bigint")
    made.write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(df.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``shard, path, n_docs, n_ids, start`` of a folder's shards.

    Sums of the shards before are taken in blocks of 1024 and over the blocks, so
    that no task orders all shards.
    """
    rows = spark.read.schema("shard bigint, path string, n_docs bigint, n_ids bigint").parquet(f"{folder}/manifest")
    numbered = rows.withColumn("block", F.shiftright("shard", 42))
    before = W.rowsBetween(W.unboundedPreceding, -1)
    sums = numbered.groupBy("block").agg(F.sum("n_ids").alias("all"))
    sums = sums.select("block", F.coalesce(F.sum("all").over(before.orderBy("block")), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n_ids").over(before.partitionBy("block").orderBy("shard")), F.lit(0))
    return numbered.withColumn("within", within).join(sums, "block").select("shard", "path", "n_docs", "n_ids", (F.col("base") + F.col("within")).alias("start"))


def _reading(spark: SparkSession, folder: str, schema: StructType, id_col: str, columns: Callable[[Shard, np.ndarray, int, int, int], list]) -> DataFrame:
    """``id_col`` and ``columns`` of every document of a folder's shards, a few thousand documents at once."""
    shards = manifest(spark, folder)
    tasks = max(1, spark.read.parquet(f"{folder}/manifest").count())

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, (files, top) = to_arrow_schema(schema), _file_system(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                from pyarrow import fs

                shard = Shard(files.open_input_file(f"{top}/{path}").read_buffer() if not isinstance(files, fs.LocalFileSystem) else pa.memory_map(f"{top}/{path}").read_buffer())
                keys = shard.keys()
                for a in range(0, shard.n, 4096):
                    b = min(shard.n, a + 4096)
                    bounds = shard.bounds.between(a, b + 1)
                    made = columns(shard, bounds, start, a, b)
                    yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), *(pa.array(c, f.type) for c, f in zip(made, list(arrow)[1:], strict=True))], schema=arrow)

    return shards.select("path", "start").repartition(tasks).mapInArrow(run, schema)


def offsets(spark: SparkSession, folder: str, id_type, *, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` of every document, read back from the files.

    ``start``: the ids of all documents before it; the checksum is of the ids as
    little-endian unsigned 32-bit numbers.
    """
    schema = StructType([StructField(id_col, id_type), *(StructField(c, LongType()) for c in ("start", "n_tokens", "ids_crc32"))])

    def columns(shard: Shard, bounds: np.ndarray, start: int, a: int, b: int) -> list:
        crcs = [zlib.crc32(shard.slice(i, j).astype("<u4").tobytes()) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return [start + bounds[:-1], np.diff(bounds), crcs]

    return _reading(spark, folder, schema, id_col, columns)


def read(spark: SparkSession, folder: str, id_type, *, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, ids`` of every document; ``ids`` are little-endian unsigned 32-bit numbers."""
    schema = StructType([StructField(id_col, id_type), StructField("start", LongType()), StructField("ids", BinaryType())])

    def columns(shard: Shard, bounds: np.ndarray, start: int, a: int, b: int) -> list:
        return [start + bounds[:-1], [shard.slice(i, j).astype("<u4").tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]]

    return _reading(spark, folder, schema, id_col, columns)
