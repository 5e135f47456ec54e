"""Spelling variants: words grouped by full neighbourhood generation.

Words are counted over all texts.  Every word then generates its whole
neighbourhood over the observed alphabet: each distinct string that one deletion,
replacement or insertion of a code point makes of it.  The strings are hash-joined
to the vocabulary; what is found is a neighbour by construction, so no distance is
ever computed.

A generated string is a 64-bit polynomial key (worked out from the word's prefix
sums, so a long run costs no more a string than a short one), the word's number and
the edit.  Strings that can't be words are dropped where they are made, by a bitmap
of the vocabulary's keys of fixed size (``bitmap_bits``; the only thing sent to all
tasks): it only ever lets too many through.  A key that meets a word counts if the
edit does make that word, so colliding keys change nothing.

A word's form is its most frequent neighbour (ties: the smallest in code-point
order) if that is ``factor`` times as frequent; its root is where its forms end.
Counts at least double along forms, so pointer doubling ends after a few rounds.

Hot groups: counts are combined within tasks and before the shuffle; keys are
distinct strings, of which a word has as many as its length and the alphabet give.

Defined results: a null or empty text has no words; repeated rows count each; a
null id is written as nothing where ids are hashed; a very long text is taken in
portions between words; an empty table gives an empty result; other columns are
neither read nor returned.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.columns import scratch, shared_table

WORD = re.compile("[A-Za-zÀ-ÿ]+")
_NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {i: i + 32 for i in range(65, 91)}
#: Characters of a text that are searched for words at once.
PORTION = 1 << 20
#: Strings of a neighbourhood that exist at once.
AT_ONCE = 1 << 20
#: Words whose neighbourhoods one task makes, about.
TASK_WORDS = 25_000
#: Base of the polynomial keys, any odd number.
BASE = 0x9E3779B97F4A7C15
DELETE, REPLACE, INSERT = 0, 1, 2


def portions(text: str, size: int = PORTION) -> Iterator[str]:
    """``text`` cut between words into portions of about ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = _NO_LETTER.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def misprinted(word: str, start: int, every: int) -> str:
    """``word`` without one code point if ``every`` divides the checksum of the text's id and the word."""
    h = zlib.crc32(word.encode(), start)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(df: DataFrame, *, min_length: int = 5, min_count: int = 3, misprint: int | None = None, held: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: words of at least ``min_length`` code points that occur ``min_count`` times, A-Z lower-cased.

    ``misprint`` takes a code point out of one in so many (text, word) pairs, by a
    checksum.  A task holds about ``held`` distinct words before it hands them on.
    """

    def run(batches):
        import pyarrow as pa

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return made

        total: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(f"{key or ''}:".encode())
                for part in portions(text or ""):
                    for word, n in Counter(WORD.findall(part)).items():
                        if not word.islower():
                            word = word.lower() if word.isascii() else word.translate(_LOWER)
                        if misprint:
                            word = misprinted(word, start, misprint)
                        if len(word) >= min_length:
                            total[word] += n
                    if len(total) >= held:
                        yield out()
        if total:
            yield out()

    counted = df.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letter_values(codes: np.ndarray) -> np.ndarray:
    """A scattered 64-bit number for each code point."""
    x = codes.astype(np.uint64) + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def powers(n: int) -> np.ndarray:
    out = np.full(n + 1, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """For words of one length (a row of code points each), the keys of all their prefixes."""
    n, length = codes.shape
    out = np.zeros((n, length + 1), np.uint64)
    np.cumsum(letter_values(codes) * powers(length)[:length], axis=1, out=out[:, 1:])
    return out


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, code points) of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        joined = "".join(words[i] for i in at)
        yield at, np.frombuffer(joined.encode("utf-32-le"), "<u4").reshape(len(at), int(length))


def word_keys(words: list[str]) -> np.ndarray:
    """The 64-bit key of each word."""
    out = np.zeros(len(words), np.uint64)
    for at, codes in by_length(words):
        out[at] = prefix_sums(codes)[:, -1]
    return out


def neighbourhoods(codes: np.ndarray, alphabet: np.ndarray, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, key, edit) of every distinct string one edit away from each word.

    Of equal strings one edit stands: a run of one letter loses its first, and a
    letter is inserted before another one or at the end.  An edit packs its place,
    its letter and its kind.
    """
    n, length = codes.shape
    inverse = np.uint64(pow(BASE, -1, 1 << 64))
    base, power, values = np.uint64(BASE), powers(length), letter_values(alphabet)
    rows = max(1, at_once // (len(alphabet) * (2 * length + 1)))
    step = max(1, at_once // (2 * len(alphabet)))
    for a in range(0, n, rows):
        part = codes[a : a + rows]
        before = prefix_sums(part)
        after = before[:, -1:] - before
        for p in range(0, length + 1, step):
            places = np.arange(p, min(length + 1, p + step))
            inner = places[places < length]
            letters = part[:, inner]
            new = np.concatenate([letters, np.zeros((len(part), len(places) - len(inner)), letters.dtype)], axis=1)
            first = np.ones(letters.shape, bool)
            first[:, 1:] = letters[:, 1:] != letters[:, :-1]
            if p and len(inner):
                first[:, 0] = letters[:, 0] != part[:, p - 1]
            placed = values[None, None, :] * power[places][None, :, None]
            grown = before[:, places, None] + placed
            for kind, keys, keep, where in (
                (DELETE, (before[:, inner] + after[:, inner + 1] * inverse)[:, :, None], first[:, :, None], inner),
                (REPLACE, grown[:, : len(inner)] + after[:, inner + 1, None], letters[:, :, None] != alphabet, inner),
                (INSERT, grown + after[:, places, None] * base, new[:, :, None] != alphabet, places),
            ):
                i, j, k = np.nonzero(keep)
                letter = np.zeros(len(k), np.int64) if kind == DELETE else alphabet[k].astype(np.int64)
                yield a + i, keys[i, j, k], (where[j] << 10) | (letter << 2) | kind


def bit_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The place of each key in a bitmap of 2 to the ``bits`` bits."""
    return ((keys ^ (keys >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def vocabulary(words: DataFrame, bits: int) -> DataFrame:
    """``words`` with ``wid``, ``key`` and the key's ``place`` in the bitmap, in the shared folder."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = word_keys(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys.view(np.int64)), pa.array(bit_places(keys, bits).astype(np.int64))], names=["word", "n", "key", "place"])

    keyed = words.mapInArrow(run, "word string, n bigint, key bigint, place bigint")
    return shared_table(keyed.withColumn("wid", F.monotonically_increasing_id()))


def bitmap(vocab: DataFrame, bits: int) -> bytes:
    """Which places of the bitmap some word has: 2 to the ``bits`` bits, combined before the shuffle."""
    number = F.col("place") + 1  # Spark's bitmaps count from 1
    parts = vocab.groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.toLocalIterator():
        part = np.frombuffer(row.bitmap, np.uint8)
        start = (row.bucket - 1) * len(part)
        out[start : start + len(part)] = part[: len(out) - start]
    return out.tobytes()


def candidates(vocab: DataFrame, alphabet: str, bits: int) -> DataFrame:
    """``key, wid, edit``: the neighbourhoods of all words, less what the bitmap rules out."""
    letters = np.array(sorted(map(ord, alphabet)), np.uint32)
    # A word makes hundreds of strings, so the small table is dealt to many tasks.
    tasks = vocab.count() // TASK_WORDS + 1
    sent = vocab.sparkSession.sparkContext.broadcast(bitmap(vocab, bits))

    def run(batches):
        import pyarrow as pa

        there = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, codes in by_length(batch.column(1).to_pylist()):
                for row, keys, edits in neighbourhoods(codes, letters):
                    places = bit_places(keys, bits)
                    may = np.flatnonzero(there[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1)
                    if len(may):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[may].view(np.int64)), pa.array(ids[at[row[may]]]), pa.array(edits[may])], names=["key", "wid", "edit"])

    return vocab.select("wid", "word").repartition(tasks).mapInArrow(run, "key bigint, wid bigint, edit bigint")


def edited(word, edit):
    """The string that an edit makes of a word (columns)."""
    place, kind = F.shiftright(edit, 10).cast("int"), edit.bitwiseAND(F.lit(3))
    letter = F.when(kind == DELETE, "").otherwise(F.char(F.shiftright(edit, 2).bitwiseAND(F.lit(255))))
    rest = place + F.when(kind == INSERT, 1).otherwise(2)
    return F.concat(F.substring(word, F.lit(1), place), letter, F.substring(word, rest, F.length(word)))


def neighbours(vocab: DataFrame, bits: int) -> DataFrame:
    """``wid, near, near_n``: every pair of words one edit apart, from both sides."""
    letters = "".join(r.c for r in vocab.select(F.explode(F.split("word", "")).alias("c")).distinct().collect())
    if not letters:
        return vocab.select("wid", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    met = candidates(vocab, letters, bits).join(vocab.select("key", F.col("word").alias("near"), F.col("n").alias("near_n")), "key")
    return met.join(vocab.select("wid", "word"), "wid").where(edited(F.col("word"), F.col("edit")) == F.col("near")).select("wid", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words that have a form: where forms end, by pointer doubling."""
    now = shared_table(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = shared_table(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(
    df: DataFrame, *, min_length: int = 5, min_count: int = 3, factor: int = 2, misprint: int | None = None, bitmap_bits: int = 27, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``df``'s texts."""
    kept: list[DataFrame] = []
    with scratch(lambda: kept):
        vocab = vocabulary(word_counts(df, min_length=min_length, min_count=min_count, misprint=misprint, id_col=id_col, text_col=text_col), bitmap_bits)
        # Of the most frequent neighbours the smallest: counts are compared first, then strings.
        best = neighbours(vocab, bitmap_bits).groupBy("wid").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
        form = F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best.near"))
        judged = shared_table(
            vocab.join(best, "wid", "left").select(
                "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n"))
        )
        ends = roots(judged.where("form IS NOT NULL"))
        out = shared_table(judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word")))
        kept.append(out)
    return out
