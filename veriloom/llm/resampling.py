"""Importance resampling towards a target corpus, over bucket-partitioned inverted postings.

A document's features are its runs of one to ``grams`` words, each hashed to one of
``buckets`` buckets.  Tasks invert blocks of documents: for each bucket one posting
list, the documents of the block that have it and their counts.  Lists are shuffled
by bucket.  There they meet the bucket's counts in both corpora (co-grouped, combined
before the shuffle: at most one row a bucket and task), from which the bucket's gain
is worked out; the list takes the gain with it to its documents' block, where
contributions are added up by document.

A list keeps the steps from one place in its block to the next in a byte each, and
counts as a bit each and a byte for those above one (wider where that isn't enough).
So the shuffles carry one to two bytes a feature, and a document's contributions
never become rows of their own.

Hot groups: a bucket that all documents have is one list a block; lists of a bucket
are dealt to as many parts as there are thousands of blocks, each with the bucket's
counts beside it.  A block has bounded text (or is one text), and at most one list a
bucket.

A document's weight is the floored mean of the gains of its features.  Scores add
Gumbel noise from a hash of the id; the highest scores among documents of at least
``min_words`` words are drawn.  The cut is found from a histogram of scores (whole
numbers, so its size is bounded by their range), and only what lies above it is
ranked, by ranges.

Defined results: a null or empty text has no features and weight 0; repeated rows
count each and may be drawn each; a null id is hashed as nothing, and comes after
all others of its score; a very long text is a block of its own; an empty table
gives an empty result, an empty target counts nothing; other columns are neither
read nor returned.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from veriloom.llm.columns import blocks, scratch, shared_table
from veriloom.operators.integrity import positions

#: Words before lower-casing: letters and digits of ASCII, and all else above it.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
#: Characters of text and documents of one block.
BLOCK_TEXT, BLOCK_DOCS = 1 << 22, 1 << 15
#: The bucket of the row that lists a block's documents.
HEAD = -1
#: Lists of a bucket that one part holds, about.
PART_LISTS = 1024


def features(texts: list[str], buckets: int, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, and of every feature that a text has: its bucket, the text's place, its count), by bucket, then place."""
    raw, codes, checks, spelt = {}, {}, [], []
    n_words, coded = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        words = WORD.findall(text)
        n_words[i] = len(words)
        for word in words:
            code = raw.get(word)
            if code is None:
                low = word.translate(_LOWER)
                code = codes.get(low)
                if code is None:
                    code = codes[low] = len(spelt)
                    spelt.append(low.encode())
                    checks.append(zlib.crc32(spelt[-1]))
                raw[word] = code
            coded.append(code)
    code = np.array(coded, np.int64)
    place = np.repeat(np.arange(len(texts)), n_words)
    size = max(1, len(texts))
    check = np.array(checks, np.int64)
    of_run, run = check, code  # for each distinct run its checksum, and which one starts at each word
    found = [(check[code] % buckets) * size + place] if len(code) else []
    for n in range(2, grams + 1):
        starts = np.flatnonzero(place[n - 1 :] == place[: -(n - 1)]) if len(code) >= n else np.zeros(0, np.int64)
        if not len(starts):
            break
        pairs, at = np.unique(run[starts] * len(spelt) + code[starts + n - 1], return_inverse=True)
        heads, tails = pairs // len(spelt), pairs % len(spelt)
        of_run = np.fromiter((zlib.crc32(b" " + spelt[t], h) for h, t in zip(of_run[heads].tolist(), tails.tolist())), np.int64, len(pairs))
        found.append((of_run[at] % buckets) * size + place[starts])
        run = np.full(len(code), -1, np.int64)
        run[starts] = at
    keys, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    return n_words, keys // size, keys % size, counts


def n_features(n_words: np.ndarray, grams: int) -> np.ndarray:
    return sum(np.maximum(n_words - n + 1, 0) for n in range(1, grams + 1))


def lists_of(bucket: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[int], list[bool], list[bytes], list[bytes]]:
    """The posting lists of sorted (bucket, place, count): (first index, total, whether wide, steps, counts) of each.

    Narrow: steps in a byte each; a bit for each count above one, then those in a
    byte each.  Wide: steps in two bytes, counts in four.
    """
    if not len(bucket):
        return np.zeros(0, np.int64), [], [], [], []
    firsts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
    ends = np.append(firsts[1:], len(bucket))
    steps = np.diff(at, prepend=0)
    steps[firsts] = at[firsts]
    wide = np.maximum(np.maximum.reduceat(steps, firsts), np.maximum.reduceat(counts, firsts)) > 255
    one, two, four, more = steps.astype("u1"), steps.astype("<u2"), counts.astype("<u4"), counts > 1
    above, before = counts[more].astype("u1"), np.concatenate([[0], np.cumsum(more)])
    ats, packed = [], []
    for i, j, w in zip(firsts.tolist(), ends.tolist(), wide.tolist()):
        ats.append((two if w else one)[i:j].tobytes())
        packed.append(four[i:j].tobytes() if w else np.packbits(more[i:j]).tobytes() + above[before[i] : before[j]].tobytes())
    return firsts, np.add.reduceat(counts, firsts).tolist(), wide.tolist(), ats, packed


def added_up(n_docs: int, wide: list[bool], ats: list[bytes], packed: list[bytes], gains: list[int]) -> np.ndarray:
    """For each document of a block the sum of its features' gains, over the block's lists."""
    total = np.zeros(n_docs, np.int64)
    narrow = []
    for k, w in enumerate(wide):
        if w:
            total[np.cumsum(np.frombuffer(ats[k], "<u2"), dtype=np.int64)] += np.frombuffer(packed[k], "<u4").astype(np.int64) * gains[k]
        else:
            narrow.append(k)
    if narrow:
        n = np.array([len(ats[k]) for k in narrow])
        start = np.cumsum(n) - n
        steps = np.frombuffer(b"".join(ats[k] for k in narrow), "u1").astype(np.int64)
        sums = np.cumsum(steps)
        place = sums - np.repeat(sums[start] - steps[start], n)
        size = np.array([len(packed[k]) for k in narrow])
        data = np.frombuffer(b"".join(packed[k] for k in narrow), "u1")
        first = np.cumsum(size) - size
        more = np.unpackbits(data)[np.arange(len(steps)) + np.repeat(8 * first - start, n)].view(bool)
        within = np.arange(len(data)) - np.repeat(first, size)
        count = np.ones(len(steps), np.int64)
        count[more] = data[within >= np.repeat((n + 7) // 8, size)]
        # Whole numbers far below 2 to the 53: sums of doubles are exact.
        total += np.bincount(place, count * np.repeat(np.array([gains[k] for k in narrow], np.int64), n), n_docs).astype(np.int64)
    return total


def postings(df: DataFrame, buckets: int, grams: int, id_col: str, text_col: str) -> DataFrame:
    """``block, bucket, total, wide, at, counts`` of every block's lists, and one row a block (``HEAD``) with ``ids, words``."""
    id_type = df.schema[id_col].dataType
    schema = StructType([
        StructField("block", LongType()), StructField("bucket", IntegerType()), StructField("total", LongType()), StructField("wide", BooleanType()), StructField("at", BinaryType()),
        StructField("counts", BinaryType()), StructField("ids", ArrayType(id_type)), StructField("words", ArrayType(LongType())),
    ])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, block = to_arrow_schema(schema), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, end in blocks(texts, BLOCK_TEXT):
                for a in range(start, end, BLOCK_DOCS):
                    b = min(end, a + BLOCK_DOCS)
                    n_words, bucket, at, counts = features(texts[a:b], buckets, grams)
                    firsts, totals, wide, ats, packed = lists_of(bucket, at, counts)
                    n = len(firsts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block] * (n + 1), pa.int64()), pa.array([HEAD, *bucket[firsts].tolist()], pa.int32()), pa.array([None, *totals], pa.int64()),
                            pa.array([None, *wide], pa.bool_()), pa.array([None, *ats], pa.binary()), pa.array([None, *packed], pa.binary()),
                            pa.array([batch.column(0).slice(a, b - a).to_pylist(), *[None] * n], arrow.field("ids").type),
                            pa.array([n_words.tolist(), *[None] * n], pa.list_(pa.int64())),
                        ],
                        schema=arrow,
                    )
                    block += 1

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def bucket_counts(lists: DataFrame, target: DataFrame, buckets: int, grams: int, text_col: str) -> DataFrame:
    """``bucket, s, t, all_s, all_t``: counts of the buckets that ``lists`` has, in both corpora."""
    aimed = target.select(F.lit(0).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    other = postings(aimed, buckets, grams, "id", "text").where(F.col("bucket") >= 0)
    none = F.lit(0).cast("bigint")
    both = lists.select("bucket", F.col("total").alias("s"), none.alias("t")).union(other.select("bucket", none, "total"))
    sums = shared_table(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    of_all = sums.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).first()
    return sums.where("s > 0").withColumns({c: F.lit(n or 0).cast("bigint") for c, n in of_all.asDict().items()})


def gain(buckets: int) -> F.Column:
    """What a feature of a bucket tells for the target: a whole number of thousandths."""
    d = lambda c: F.col(c).cast("double")
    ratio = ((d("t") + 1) * (d("all_s") + buckets)) / ((d("s") + 1) * (d("all_t") + buckets))
    return F.floor(1000 * F.log(ratio)).cast("bigint")


def weights(df: DataFrame, target: DataFrame, *, buckets: int = 10_000, grams: int = 2, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """``id_col, n_words, n_features, weight`` of every document."""
    made = shared_table(postings(df, buckets, grams, id_col, text_col))
    lists = made.where(F.col("bucket") >= 0).select("block", "bucket", "total", "wide", "at", "counts")
    heads = made.where(F.col("bucket") == HEAD).select("block", "ids", "words")
    parts = heads.count() // PART_LISTS + 1
    part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")
    counts = bucket_counts(lists, target, buckets, grams, target_text).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # A side as small as the counts would else be sent to every task, and no list be shuffled by its bucket.
    met = lists.withColumn("part", part).join(counts.hint("shuffle_hash"), ["bucket", "part"])
    gained = met.select("block", "wide", "at", "counts", gain(buckets).alias("gain"))
    both = gained.withColumns({c: F.lit(None).cast(heads.schema[c].dataType) for c in ("ids", "words")}).unionByName(
        heads.withColumns({c: F.lit(None).cast(kind) for c, kind in (("wide", "boolean"), ("at", "binary"), ("counts", "binary"), ("gain", "bigint"))})
    )
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight"))])

    def add_up(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        head = table.filter(pc.is_valid(table.column("words")))
        rest = table.filter(pc.is_valid(table.column("gain")))
        ids = head.column("ids").combine_chunks().flatten()
        n_words = head.column("words").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        total = added_up(len(n_words), *(rest.column(c).to_pylist() for c in ("wide", "at", "counts", "gain")))
        n = n_features(n_words, grams)
        return pa.Table.from_arrays([ids, pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=schema.names)

    return both.groupBy("block").applyInArrow(add_up, schema)


def noise(id_col: str, seed: int) -> F.Column:
    """Gumbel noise in whole thousandths, from a hash of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(
    df: DataFrame, target: DataFrame, *, percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = 10_000, grams: int = 2,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """``id_col, n_features, weight, score, rank``: every document, with a rank if it was drawn."""
    kept: list[DataFrame] = []
    with scratch(lambda: kept):
        weighed = weights(df, target, buckets=buckets, grams=grams, id_col=id_col, text_col=text_col, target_text=target_text)
        scored = shared_table(weighed.withColumn("score", F.col("weight") + noise(id_col, seed)))
        kept.append(ranked(scored, percent=percent, min_words=min_words, id_col=id_col))
    return kept[0]


def ranked(scored: DataFrame, *, percent: int, min_words: int, id_col: str) -> DataFrame:
    """The documents with the ranks of those drawn, in the shared folder."""
    fit = F.col("n_words") >= min_words
    by_score = sorted(((r.score, r.n) for r in scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = sum(n for _, n in by_score) * percent // 100
    cut, above = None, 0
    for score, n in by_score:
        if above >= drawn:
            break
        cut, above = score, above + n
    columns = [F.col(id_col), "n_features", "weight", "score"]
    none = F.lit(None).cast("bigint").alias("rank")
    if cut is None:
        return shared_table(scored.select(*columns, none))
    near = fit & (F.col("score") >= cut)
    # Equal rows are told apart by their places, so that they can be dealt to several ranges.
    ordered = scored.where(near).withColumns({"less": -F.col("score"), "nameless": F.col(id_col).isNull(), "row": F.monotonically_increasing_id()})
    placed = positions(ordered, ["less", "nameless", id_col, "row"], "place")
    rank = F.when(F.col("place") <= drawn, F.col("place")).alias("rank")
    return shared_table(placed.select(*columns, rank).unionByName(scored.where(~F.coalesce(near, F.lit(False))).select(*columns, none)))
