"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (lines, and lines after the ends of sentences; words in very
short texts) are digested to 64 bits.  Two texts are compared by words if both are
very short, else both by lines and sentences, so that both sides of a pair are
always digested by one rule.  Each digest is added to one cell in each of three parts of a sketch;
a cell holds a count, the digests' XOR and their checks' XOR.  Two sketches subtract cell by cell: what
they share cancels, and peeling cells that hold one digest recovers the digests
that differ.  If the small sketch that is the fingerprint can't be peeled, both
texts are sketched again, larger and by groups of digests.  Sketches are peeled as
rows: a cell that anything is in is one row, adding and subtracting is an aggregate
by cell, and a round of peeling replaces each cell that holds one digest by what
takes that digest out of its other cells (``recovered``).  A group of the larger
sketch that isn't peeled is compared digest by digest.  With d differing digests of
a and b, likeness is (a + b - d) / (a + b + d), the share that the texts have in
common.

Everything is DataFrame functions: no Python runs on executors.  Texts are shuffled
once, into ranges of ids, which are written in buckets (``placed``); a bucket is read
by one task, where all aggregates stay.  The number of ranges grows with the rows.

Defined results: a null or empty text has no digests, an all-zero fingerprint,
and likeness 1 to another such text, 0 to others; equal texts have equal
fingerprints; repeated rows each give a row; an empty table gives an empty
result; other columns are neither read nor returned.  Rows of one id are ordered
by their texts' hashes, rows with a null id come last; the only row of a table is
its own next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.llm.columns import shared_buckets
from veriloom.llm.line_dedup import bare, let

#: Where a paragraph ends: after a line feed, or the space behind the end of a sentence or a table cell.
PARAGRAPH_END = r"(?<=\n)|(?<=[.!?|] )"
_PARTS = 3
#: Most buckets of a table (Spark's limit); beyond it several ranges share one.
BUCKETS = 100_000


def digests(text: Column, words: Column) -> Column:
    """Sorted distinct 64-bit digests of the words of a text, or of its lines and sentences (null: none).

    Ends are turned into line feeds first, as white space at a unit's end doesn't
    count: splitting at one character is many times as fast as at a pattern.
    """
    ended = F.coalesce(text, F.lit(""))
    spaced = F.replace(ended, F.lit(" "), F.lit("\n"))
    for mark in ".!?|":
        ended = F.replace(ended, F.lit(f"{mark} "), F.lit(f"{mark}\n"))
    parts = F.filter(F.transform(F.split(F.when(words, spaced).otherwise(ended), "\n", -1), bare), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p))))


def _places(key: Column, width: Column, salt: int) -> Column:
    """The cells (from 1) of a digest in each part: three runs of 21 bits of the digest itself, or for another salt of a hash of both."""

    def of(bits: Column) -> Column:
        return F.struct(*((F.pmod(F.shiftrightunsigned(bits, 21 * p).bitwiseAND(0x1FFFFF).cast("int"), width) + 1).alias(f"p{p}") for p in range(_PARTS)))

    return let(F.xxhash64(key, F.lit(salt)) if salt else key, of)


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(-1))


def _items(keys: Column, count: int, width: Column, salt: int) -> Column:
    """Of each digest its count and itself, its check, and its cell in each part."""
    return F.transform(keys, lambda key: F.struct(F.lit(count).alias("c"), key.alias("k"), _check(key).alias("x"), _places(key, width, salt).alias("at")))


def _add(cells: Column, items: Column, part: int) -> Column:
    """The cells of a part with the items added."""

    def put(cell: Column, i: Column) -> Column:
        own = F.filter(items, lambda t: t["at"][f"p{part}"] == i + 1)
        return F.aggregate(own, cell, lambda c, t: F.struct(
            (c["c"] + t["c"]).alias("c"), c["k"].bitwiseXOR(t["k"]).alias("k"), c["x"].bitwiseXOR(t["x"]).alias("x")))

    return F.transform(cells, put)


def sketch(keys: Column, width: Column, salt: int = 0) -> Column:
    """The sketch of an array of digests: a struct of three parts of ``width`` cells."""
    empty = F.struct(F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("x"))
    cells = F.array_repeat(empty, width.cast("int"))
    return let(_items(keys, 1, width, salt), lambda items: F.struct(*(_add(cells, items, p).alias(f"p{p}") for p in range(_PARTS))))


def subtract(a: Column, b: Column) -> Column:
    def less(x: Column, y: Column) -> Column:
        return F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["x"].bitwiseXOR(y["x"]).alias("x"))

    return F.struct(*(F.zip_with(a[f"p{p}"], b[f"p{p}"], less).alias(f"p{p}") for p in range(_PARTS)))


def flat(cells: Column) -> Column:
    """All cells of a sketch."""
    return F.concat(*(cells[f"p{p}"] for p in range(_PARTS)))


def peel(cells: Column, width: Column, salt: int = 0, *, rounds: int = 48) -> Column:
    """``struct<ok, a, b>``: whether all cells came to zero, and the digests that only one side has.

    A round finds the digests that are alone in a cell and takes all of them out
    of all parts; rounds end once none is alone.
    """
    none = F.array().cast("array<bigint>")

    def walk(s: Column, _: Column) -> Column:
        alone = F.filter(flat(s["cells"]), lambda c: (F.abs(c["c"]) == 1) & (c["x"] == _check(c["k"])))

        def found(alone: Column) -> Column:
            side = lambda sign: F.array_distinct(F.transform(F.filter(alone, lambda c: c["c"] == sign), lambda c: c["k"]))
            return F.struct(side(1).alias("a"), side(-1).alias("b"))

        def out(one: Column) -> Column:
            items = F.concat(_items(one["a"], -1, width, salt), _items(one["b"], 1, width, salt))
            return let(items, lambda items: F.struct(
                F.struct(*(_add(s["cells"][f"p{p}"], items, p).alias(f"p{p}") for p in range(_PARTS))).alias("cells"),
                F.concat(s["a"], one["a"]).alias("a"), F.concat(s["b"], one["b"]).alias("b"), (F.size(items) > 0).alias("more"),
            ))

        return F.when(s["more"], let(let(alone, found), out)).otherwise(s)

    start = F.struct(cells.alias("cells"), none.alias("a"), none.alias("b"), F.lit(True).alias("more"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), start, walk,
        lambda end: F.struct(
            F.forall(flat(end["cells"]), lambda c: (c["c"] == 0) & (c["k"] == 0) & (c["x"] == 0)).alias("ok"),
            end["a"].alias("a"), end["b"].alias("b"),
        ),
    )


def text_of(cells: Column) -> Column:
    """A sketch as a string: count, digests' XOR and checks' XOR of each cell, in hexadecimal."""
    return F.array_join(F.transform(flat(cells), lambda c: F.concat_ws(".", F.lower(F.hex(c["c"])), F.lower(F.hex(c["k"])), F.lower(F.hex(c["x"])))), ",")


#: Digests in a group of a larger sketch (about), cells of one of its parts, and bits that number its cells.
GROUP, CELLS, BITS = 32, 64, 8
_TALLY = (1 << BITS) - 1


def group_of(key: Column, groups: Column) -> Column:
    """The group of a digest among a pair's groups."""
    return F.pmod(F.shiftrightunsigned(key, 1), groups)


def groups_of(a: Column, b: Column) -> Column:
    return F.floor((F.size(a) + F.size(b)) / GROUP).cast("bigint") + 1


def _slots(base: Column, key: Column, width: int, salt: int) -> list[Column]:
    """The cells of a digest, numbered from ``base``; a part's cells are together."""
    bits = F.xxhash64(key, F.lit(salt)) if salt else key
    return [base + p * CELLS + F.pmod(F.shiftrightunsigned(bits, 21 * p).bitwiseAND(0x1FFFFF), F.lit(width)) for p in range(_PARTS)]


def small_cells(cells_a: Column, cells_b: Column, width: int) -> Column:
    """What is in the cells of one small sketch less another, with the cells' numbers; null where that can't be peeled.

    What the counts of a part add up to can't be more than differs, so a sketch
    that holds more than its cells can tell isn't tried.
    """
    numbered = lambda p: F.transform(
        F.zip_with(cells_a[f"p{p}"], cells_b[f"p{p}"], lambda x, y: F.struct((x["c"] - y["c"]).cast("bigint").alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["x"].bitwiseXOR(y["x"]).alias("x"))),
        lambda c, i: F.struct((i + p * CELLS).cast("bigint").alias("slot"), c["c"].alias("c"), c["k"].alias("k"), c["x"].alias("x")))
    held = lambda cells: F.aggregate(cells, F.lit(0).cast("bigint"), lambda n, c: n + F.when(c["slot"] < CELLS, F.abs(c["c"])).otherwise(0))
    some = F.filter(F.concat(*(numbered(p) for p in range(_PARTS))), lambda c: (c["c"] != 0) | (c["k"] != 0) | (c["x"] != 0))
    return let(some, lambda cells: F.when(held(cells) <= _PARTS * width, cells))


def recovered(pairs: DataFrame, by: list[str], *, width: int = 8, rounds: int = 6) -> DataFrame:
    """``by, pair, n, stuck``: how many differing digests peeling recovers, and the groups that it can't empty.

    ``pairs``: ``by``, and ``sides``, an array of structs ``a, b, small``: the digests of
    both sides of a pair, and the ``small_cells`` of their sketches of ``width`` (or
    null).  A larger sketch is the sum of the cells of ``a``'s digests and of the
    negative ones of ``b``'s, in groups; it counts where the small one isn't
    emptied.  A cell without anything is no row.  Rounds go through the parts in
    turn, and a digest is in one cell of a part, so nothing is taken out twice.
    ``pairs`` must be partitioned by one of ``by``: then all aggregates stay in
    their tasks.
    """
    long = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("bigint")
    row = lambda slot, c, k, x: F.struct(long(slot).alias("slot"), long(c).alias("c"), long(k).alias("k"), long(x).alias("x"))
    signed = lambda keys, sign: F.transform(keys, lambda k: row(-1, sign, k, _check(k)))
    # Numbers: group, then pair, then 1 for the larger sketch, then the cell.  Every sketch has a tally from the start.
    # (An outer explode: from another one Spark infers a filter, which would make all sketches twice.)
    one = pairs.select(*by, F.posexplode_outer("sides").alias("pair", "side"))
    small = F.transform("side.small", lambda c: row(c["slot"] + F.col("pair") * (2 << BITS), c["c"], c["k"], c["x"]))
    tallies = F.when(F.col("side.small").isNull(), F.array(row(F.col("pair") * (2 << BITS) + (1 << BITS) + _TALLY, 0, 0, 0))).otherwise(
        F.concat(small, F.array(*(row(F.col("pair") * (2 << BITS) + level * (1 << BITS) + _TALLY, 0, 0, 0) for level in (0, 1)))))
    each = one.select(*by, "pair", groups_of(F.col("side.a"), F.col("side.b")).alias("groups"), F.explode(F.concat(tallies, signed(F.col("side.a"), 1), signed(F.col("side.b"), -1))).alias("r"))
    base = ((group_of(F.col("r.k"), F.col("groups")) * 2 + F.col("pair")) * 2 + 1) * (1 << BITS)
    own = F.array(*(row(slot, F.col("r.c"), F.col("r.k"), F.col("r.x")) for slot in _slots(base, F.col("r.k"), CELLS, 1)))
    rows = each.select(*by, F.explode(F.when(F.col("r.slot") >= 0, F.array("r")).otherwise(own)).alias("r")).select(*by, "r.*")

    def summed(df: DataFrame) -> DataFrame:
        """Cells by their numbers; those that nothing is left in go."""
        out = df.groupBy(*by, "slot").agg(F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("x").alias("x"))
        return out.where((F.col("slot").bitwiseAND(_TALLY) == _TALLY) | (F.col("c") != 0) | (F.col("k") != 0) | (F.col("x") != 0))

    cells = summed(rows)
    at, large = F.col("slot").bitwiseAND(_TALLY), F.col("slot").bitwiseAND(1 << BITS) != 0
    for part in (r % _PARTS for r in range(rounds)):
        alone = (at >= part * CELLS) & (at < (part + 1) * CELLS) & (F.abs("c") == 1) & (F.col("x") == _check(F.col("k")))
        base = F.col("slot") - at
        slots = zip(_slots(base, F.col("k"), CELLS, 1), _slots(base, F.col("k"), width, 0))
        others = [row(F.when(large, a).otherwise(b), -F.col("c"), F.col("k"), F.col("x")) for p, (a, b) in enumerate(slots) if p != part]
        after = F.when(alone, F.array(*others, row(base + _TALLY, 1, 0, 0))).otherwise(F.array(row(F.col("slot"), F.col("c"), F.col("k"), F.col("x"))))
        cells = summed(cells.select(*by, F.explode(after).alias("r")).select(*by, "r.*"))
    groups = cells.groupBy(*by, F.shiftright("slot", BITS).alias("group")).agg(F.sum(F.when(at == _TALLY, F.col("c")).otherwise(0)).alias("n"), F.max(at != _TALLY).alias("left"))
    is_large, pair = F.pmod("group", F.lit(2)) == 1, F.pmod(F.shiftright("group", 1), F.lit(2)).cast("int")
    told = groups.groupBy(*by, pair.alias("pair")).agg(
        F.max(F.when(~is_large & ~F.col("left"), F.col("n"))).alias("first"), F.sum(F.when(is_large & ~F.col("left"), F.col("n")).otherwise(0)).alias("second"),
        F.collect_set(F.when(is_large & F.col("left"), F.shiftright("group", 2))).alias("stuck"))
    return told.select(*by, "pair", F.coalesce("first", "second").alias("n"), F.when(F.col("first").isNull(), F.col("stuck")).otherwise(F.array().cast("array<bigint>")).alias("stuck"))


def in_groups(a: Column, b: Column, stuck: Column) -> Column:
    """How many digests of these groups differ, by comparing them."""
    own = lambda keys: F.filter(keys, lambda x: F.array_contains(stuck, group_of(x, groups_of(a, b))))
    return let(F.struct(own(a).alias("a"), own(b).alias("b")), lambda o: F.size(F.array_except(o["a"], o["b"])) + F.size(F.array_except(o["b"], o["a"])))


def likeness(n_a: Column, n_b: Column, differ: Column) -> Column:
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((n_a + n_b - differ) / (n_a + n_b + differ))


def falling() -> list[Column]:
    """Falling ids; nulls are least."""
    return [F.col(c).desc_nulls_last() for c in ("id", "th", "tie")]


def placed(df: DataFrame, *, rows: int) -> tuple[DataFrame, int]:
    """``df`` (``id, text``) in ranges of about ``rows`` rows of falling id, written to the shared folder: ``part``, ``th`` and ``tie`` beside it.

    Rows of one id go by their texts' hashes, equal rows in any order, so a range
    ends wherever it is full; rows with a null id come last.  The table is bucketed by
    range, so what is read of it needn't be shuffled by ``part`` again (as many buckets
    as Spark has shuffle partitions at least: with fewer, Spark's joins would shuffle it).
    Returns the number of ranges as well.
    """
    spark = df.sparkSession
    parts = max(1, -(-df.count() // rows))
    keyed = df.withColumn("th", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(parts, *falling()).withColumn("part", F.spark_partition_id())
    return shared_buckets(dealt, "part", min(BUCKETS, max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))), parts


def with_next(df: DataFrame, *, rows: int) -> DataFrame:
    """``part, at, id, text, next_text``: each row's successor in falling order of ids; the last one's is the first.

    A range's first row is sent to the range before it (the first range's to the
    last), where it meets the last row.  Only one row of keys a range is gathered for
    that; it is broadcast up to a number of ranges that keeps it small.
    """
    table, parts = placed(df, rows=rows)
    key = F.struct("id", "th", "tie")
    over = W.orderBy("part")
    heads = table.groupBy("part").agg(F.max(key).alias("head"))
    heads = heads.select(F.col("part").alias("from"), "head", F.coalesce(F.lag("part").over(over), F.max("part").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("to"))
    small = F.broadcast(heads) if parts <= 100_000 else heads
    ghosts = table.join(small, (F.col("part") == F.col("from")) & (F.col("tie") == F.col("head.tie"))).select("to", F.col("text").alias("ghost"))
    by = W.partitionBy("part").orderBy(*falling())
    own = table.select("part", F.row_number().over(by).alias("at"), "id", "text", F.lead("text").over(by).alias("after"))
    met = own.join(ghosts.hint("shuffle_hash"), (F.col("part") == F.col("to")) & F.col("after").isNull(), "left")
    return met.select("part", "at", "id", "text", F.coalesce("after", "ghost").alias("next_text"))


def edited_fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 8, word_chars: int = 200, rows: int = 1024) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.  The edited text has its second half replaced by
    the start of the next document's text.  A fingerprint is made of a text's own
    words if it has under ``word_chars`` characters.  Ids may be of any type that
    has an order.
    """
    base = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    texts = with_next(base, rows=rows).withColumn("n_chars", F.length("text")).withColumn(
        "edited_text", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half)))

    # Of each text its own digests, and those of its lines and sentences if it is short.
    sides = ("text", "edited_text", "next_text")
    short = lambda c: F.length(c) < word_chars
    digested = texts.select(
        "part", "at", "id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), *(short(c).alias(f"{c}_short") for c in sides),
        *(digests(F.col(c), short(c)).alias(f"{c}_keys") for c in sides), *(F.when(short(c), digests(F.col(c), F.lit(False))).alias(f"{c}_lines") for c in sides),
    )

    def pair(other: str) -> Column:
        """Digests of both sides: by lines and sentences if only one of them is short."""
        apart = F.col("text_short") != F.col(f"{other}_short")
        by = lambda c: F.when(apart, F.coalesce(f"{c}_lines", f"{c}_keys")).otherwise(F.col(f"{c}_keys"))
        return F.struct(by("text").alias("a"), by(other).alias("b"))

    others = ("edited_text", "next_text")
    paired = digested.select("part", "at", "id", "n_chars", "edited_sha256", "text_keys", "edited_text_keys", *(pair(c).alias(c[:4]) for c in others))
    w = F.lit(width)
    sketched = paired.select("part", "at", *(F.col(c) for c in ("edit", "next")), *(sketch(F.col(f"{c}.{side}"), w).alias(f"{c}_{side}") for c in ("edit", "next") for side in "ab"))
    asked = sketched.select("part", "at", F.array(*(F.struct(F.col(f"{c}.a").alias("a"), F.col(f"{c}.b").alias("b"), small_cells(F.col(f"{c}_a"), F.col(f"{c}_b"), width).alias("small")) for c in ("edit", "next"))).alias("sides"))
    found = recovered(asked, ["part", "at"], width=width)
    # One row for each range, in order of its rows, meets the range's rows where they are, by a hash join: those rows needn't be sorted.
    each = found.groupBy("part", "at").agg(*(F.max(F.when(F.col("pair") == i, F.struct("n", "stuck"))).alias(f"pair{i}") for i in (0, 1)))
    listed = each.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("at", "pair0", "pair1"))).alias("found"))
    told = paired.join(listed.hint("shuffle_hash"), "part").withColumn("told", F.get("found", F.col("at") - 1))

    def near(i: int, c: str) -> Column:
        a, b = F.col(f"{c}.a"), F.col(f"{c}.b")
        stuck = F.col(f"told.pair{i}.stuck")
        return likeness(F.size(a), F.size(b), F.col(f"told.pair{i}.n") + F.when(F.size(stuck) > 0, in_groups(a, b, stuck)).otherwise(0))

    return told.select(
        F.col("id").alias(id_col), F.col("n_chars").cast("bigint").alias("n_chars"), "edited_sha256",
        text_of(sketch(F.col("text_keys"), w)).alias("fingerprint"), text_of(sketch(F.col("edited_text_keys"), w)).alias("edited_fingerprint"),
        near(0, "edit").alias("near_edited"), near(1, "next").alias("near_next"),
    )
