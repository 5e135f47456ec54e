"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A text is cut into lines, and lines after the ends of sentences (so a passage
set into the middle of a line still has whole units of its own).  A rolling hash
over the hashes of two successive units chooses chunk boundaries, after one in three
very short units and most others; the choice depends on nearby units alone, so a passage
is cut alike wherever it stands, whatever stands before it.

A chunk that occurs several times stays where it is first: in the document of least
id, and in it at its first place.  Elsewhere, also further on in that document, it is removed if it is
byte for byte the same (white space at units' ends aside) and belongs to a run of
repeated chunks with at least two units (or one of ``long_chars`` characters or
``long_words`` words) and ``min_chars`` characters.

The chunks' hashes and places are written to the shared folder once, then those
that repeat, then the bytes of those that stay, so texts are cut once.  Shuffles:
chunk hashes twice (8-byte keys; texts stay where they are), texts once and the
repeated chunks' bytes once.  A hash that a third of all documents hold is
aggregated before the shuffle, and its rows are joined to tables that no
aggregation in the same stage holds back, so that adaptive execution splits them.

Defined results: a null text stays null, an empty one empty; rows of one id and
text are one document and get one result each; texts of one id that differ are
documents in order of their hashes; rows with a null id come after all others, in
order of their texts' hashes; an empty table gives an empty result; all other
columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.columns import drop_table, shared_table

#: A unit ends after a line feed, or after the space behind the end of a sentence or a table cell.
UNIT_ENDS = ("\n", ". ", "! ", "? ", "| ")
UNIT_END = r"(?<=\n)|(?<=[.!?|] )"
#: Set behind units' ends so that a text is split at one character; a text that holds it is split by the pattern.
MARK = "\x1d"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def units(text: Column) -> Column:
    marked = text
    for end in UNIT_ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, UNIT_END, -1)).otherwise(F.split(marked, MARK, -1))


def bare(unit: Column) -> Column:
    """A unit without the white space at its end, which differs where a passage was set in."""
    return F.rtrim(unit, F.lit(" \n\r\t"))


def chunks(text: Column, *, short: int, sparse: int, dense: int = 3) -> Column:
    """Array of ``s, e`` (first and last unit, from 1), ``n`` (characters) and ``h`` (hash).

    A unit of at least ``short`` characters ends a chunk unless the rolling hash
    is 0 modulo ``sparse``, a shorter one only if it is 0 modulo ``dense``; an
    empty one goes with the next.
    """

    def cut(k: Column) -> Column:
        def ends(i: Column) -> Column:
            rolled = F.xxhash64(F.when(i > 1, F.get(k, i - 2)["h"]).otherwise(F.lit(0).cast("bigint")), F.get(k, i - 1)["h"])
            n = F.get(k, i - 1)["n"]
            return (i == F.size(k)) | F.when(n >= short, F.pmod(rolled, F.lit(sparse)) != 0).otherwise((n > 0) & (F.pmod(rolled, F.lit(dense)) == 0))

        def chunk(e: Column) -> Callable[[Column, Column], Column]:
            def one(end: Column, i: Column) -> Column:
                start = F.when(i == 0, F.lit(1)).otherwise(F.get(e, i - 1) + 1)
                only, part = F.get(k, end - 1), lambda: F.slice(k, start, end - start + 1)
                return F.struct(
                    start.alias("s"), end.alias("e"),
                    F.when(start == end, only["n"]).otherwise(F.aggregate(part(), F.lit(0), lambda n, u: n + u["n"])).alias("n"),
                    F.when(start == end, only["h"]).otherwise(F.xxhash64(part())).alias("h"),
                )

            return one

        return let(F.filter(F.sequence(F.lit(1), F.size(k)), ends), lambda e: F.transform(e, chunk(e)))

    hashed = F.transform(F.transform(units(text), bare), lambda b: F.struct(F.xxhash64(b).alias("h"), F.length(b).alias("n")))
    return let(hashed, cut)


def span_bytes(u: Column, start: Column, end: Column) -> Column:
    """The bytes of units ``start`` to ``end`` that copies must share."""
    return F.array_join(F.transform(F.slice(u, start, end - start + 1), bare), "\n")


def remove_repeats(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 50, long_chars: int = 250, long_words: int = 50, short: int = 20, sparse: int = 16, counts: tuple[str, str] | None = None
) -> DataFrame:
    """``df`` with repeated chunks taken out of ``text_col``.

    ``counts`` names two further columns for the numbers of units and characters removed.
    """
    rest = [F.col(f"`{c}`").alias(c) for c in df.columns if c not in (id_col, text_col)]
    base = df.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *([F.struct(*rest).alias("row")] if rest else [])
    ).withColumn("th", F.xxhash64("text"))
    found = shared_table(base.where("text IS NOT NULL").select("id", "th", F.explode(chunks(F.col("text"), short=short, sparse=sparse)).alias("c")).where("c.n > 0").select("id", "th", "c.*"))
    place = F.struct(F.col("id").isNull().alias("nameless"), "id", "th", "s")
    shared = found.groupBy("h").agg(F.min(place).alias("home"), F.max(place).alias("last")).where("home <> last").select("h", "home")
    held = shared_table(found.join(shared, "h").select("id", "th", "s", "e", "n", "h", (place == F.col("home")).alias("stays")))
    drop_table(found)

    # The bytes of each repeated chunk, from the place where it stays.
    # (Both joins of texts have the same keys, so that one exchange can serve both.)
    at = lambda id_, th: F.col("id").eqNullSafe(F.col(id_)) & (F.col("th") == F.col(th))
    homes = held.where("stays").groupBy(F.col("id").alias("hid"), F.col("th").alias("hth")).agg(F.collect_set(F.struct("h", "s", "e")).alias("own"))
    kept = shared_table(
        base.join(homes, at("hid", "hth"))
        .select(F.explode(let(units(F.col("text")), lambda u: F.transform("own", lambda x: F.struct(x["h"].alias("h"), span_bytes(u, x["s"], x["e"]).alias("bytes"))))).alias("k"))
        .groupBy("k.h").agg(F.min("k.bytes").alias("bytes"))
    )
    repeats = (
        held.where("NOT stays").join(kept, "h")
        .groupBy(F.col("id").alias("rid"), F.col("th").alias("rth")).agg(F.array_sort(F.collect_set(F.struct("s", "e", "n", "bytes"))).alias("found"))
    )
    joined = base.join(repeats, at("rid", "rth"), "left")

    def runs(m: Column) -> Column:
        """The repeated chunks that follow one another, joined, where they are large enough."""
        number = lambda: F.sequence(F.lit(1), F.size(m))
        opens = lambda i: (i == 1) | (F.get(m, i - 2)["e"] + 1 != F.get(m, i - 1)["s"])
        closes = lambda i: (i == F.size(m)) | (F.get(m, i - 1)["e"] + 1 != F.get(m, i)["s"])

        def joined_at(ends: Column) -> Callable[[Column, Column], Column]:
            def one(i: Column, k: Column) -> Column:
                end = F.get(ends, k)
                n = F.aggregate(F.slice(m, i, end - i + 1), F.lit(0), lambda total, x: total + x["n"])
                return F.struct(F.get(m, i - 1)["s"].alias("s"), F.get(m, end - 1)["e"].alias("e"), n.alias("n"), F.get(m, i - 1)["bytes"].alias("bytes"))

            return one

        made = let(F.filter(number(), closes), lambda ends: F.transform(F.filter(number(), opens), joined_at(ends)))
        # Only a run of one unit asks for its words, so its first chunk's bytes are all of it.
        large = lambda r: (r["n"] >= min_chars) & ((r["e"] > r["s"]) | (r["n"] >= long_chars) | (F.size(F.split(r["bytes"], r"\s+")) >= long_words))
        return F.when(F.size(m) == 0, F.array().cast("array<struct<s:int,e:int>>")).otherwise(
            F.transform(F.filter(made, large), lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e")))
        )

    def cleaned(u: Column) -> Column:
        """The units between the removed runs; runs rise and don't overlap, so each unit is taken up once."""
        same = F.filter("found", lambda x: span_bytes(u, x["s"], x["e"]) == x["bytes"])

        def between(r: Column) -> Column:
            def part(i: Column) -> Column:
                first = F.when(i == 0, F.lit(1)).otherwise(F.get(r, i - 1)["e"] + 1)
                last = F.when(i == F.size(r), F.size(u)).otherwise(F.get(r, i)["s"] - 1)
                return F.array_join(F.slice(u, first, F.greatest(last - first + 1, F.lit(0))), "")

            gone = F.aggregate(r, F.lit(0), lambda n, x: n + x["e"] - x["s"] + 1)
            return F.struct(F.array_join(F.transform(F.sequence(F.lit(0), F.size(r)), part), "").alias("text"), gone.alias("n"))

        return let(let(same, runs), between)

    out = joined.withColumn("clean", F.when(F.col("found").isNotNull(), let(units(F.col("text")), cleaned)))
    text = F.coalesce("clean.text", "text")
    fields = [text.alias(c) if c == text_col else F.col("id").alias(c) if c == id_col else F.col("row")[c].alias(c) for c in df.columns]
    if counts:
        fields += [
            F.coalesce("clean.n", F.lit(0)).cast("bigint").alias(counts[0]),
            F.coalesce(F.length("text") - F.length("clean.text"), F.lit(0)).cast("bigint").alias(counts[1]),
        ]
    return out.select(*fields)
