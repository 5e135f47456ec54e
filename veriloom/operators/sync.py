"""Operators that the surveyed documents only specify; nothing was ever built to compare with.

Causal order is that of the observed edges (``before, after`` entry hashes) together
with each writer's own entries in order of ``seq``.  It is kept as vector clocks:
for each entry the highest ``seq`` of every writer that it can have known of, itself
included.  One entry precedes another if the other's clock has its writer's ``seq`` or
a higher one, so no closure of the order is ever made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.sources.tables import settled, spread, tasks_for


def tips(entries: DataFrame) -> DataFrame:
    """``writer_id, seq, entry_hash`` of each writer's last entry."""
    return entries.groupBy("writer_id").agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("entry_hash"))


def ambiguous_labels(entities: DataFrame) -> DataFrame:
    """``label, refs``: labels that several entities carry."""
    return entities.groupBy("label").agg(F.array_sort(F.collect_set("entity_ref")).alias("refs")).where(F.size("refs") > 1)


def disagreeing_receipts(receipts: DataFrame) -> DataFrame:
    """Manifests whose independent runners gave different outputs: ``manifest_hash, runners, outputs``."""
    return receipts.groupBy("manifest_hash").agg(F.countDistinct("runner").alias("runners"), F.countDistinct("output_hash").alias("outputs")).where("outputs > 1")


def causal_depth(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """``entry_hash, depth``: the longest causal path to each entry (edges ``before, after``).

    Each round moves depths one edge on; a graph of n levels takes n rounds, each
    written and read again.  Entries on a cycle are left out.
    """
    left = edges.join(entries.select(F.col("entry_hash").alias("before")), "before").join(entries.select(F.col("entry_hash").alias("after")), "after").select("before", "after").distinct()
    todo, done, depth = entries.select("entry_hash"), None, 0
    while True:
        ready = settled(todo.join(left.select(F.col("after").alias("entry_hash")).distinct(), "entry_hash", "left_anti").withColumn("depth", F.lit(depth)))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        todo = settled(todo.join(ready.select("entry_hash"), "entry_hash", "left_anti"))
        left = settled(left.join(ready.select(F.col("entry_hash").alias("before")), "before", "left_anti"))
        depth += 1
    return done if done is not None else todo.withColumn("depth", F.lit(0))


def clocks(entries: DataFrame, edges: DataFrame, *, parts: int | None = None) -> DataFrame:
    """``writer_id, seq, known_writer, known_seq``: each entry's vector clock, a row a writer, in the shared folder.

    Along a writer's entries clocks only grow, so the direct observations are first
    carried on along writers (``_carried``: a writer's entries may lie in many tasks).
    Each round then takes up the clocks of the latest entries known of each writer: it
    doubles the number of changes of writer that a path may have, so there are as many
    rounds as the logarithm of the most changes.  What an entry knows of its own writer
    is its own ``seq``, which no round needs; only on cycles does a later one come back
    to it.  Writers are strings; entries of one writer and ``seq`` share a clock; edges
    to unknown entries are left out, and so are those within one writer, whose order is
    that of ``seq``.
    """
    known = entries.select("writer_id", F.col("seq").cast("bigint").alias("seq"), "entry_hash")
    links = edges.where("before <> after").join(known.withColumnsRenamed({"entry_hash": "before", "writer_id": "w", "seq": "s"}), "before").join(known.withColumnRenamed("entry_hash", "after"), "after").where("w <> writer_id")
    seen = settled(links.groupBy("writer_id", "seq", F.col("w").alias("known_writer")).agg(F.max("s").alias("known_seq")))
    rows = settled(known.select("writer_id", "seq").distinct())
    others = settled(_carried(rows, seen, parts))
    size = None
    while size != (size := others.agg(F.count("*"), F.sum(F.col("known_seq").cast("decimal(38,0)"))).first()):
        theirs = others.select(F.col("writer_id").alias("w"), F.col("seq").alias("s"), "known_writer", "known_seq")
        mine = others.select("writer_id", "seq", F.col("known_writer").alias("w"), F.col("known_seq").alias("s"))
        further = mine.join(theirs, ["w", "s"]).where("known_writer <> writer_id OR known_seq > seq").select("writer_id", "seq", "known_writer", "known_seq")
        others = settled(others.unionByName(further).groupBy("writer_id", "seq", "known_writer").agg(F.max("known_seq").alias("known_seq")))
    later = others.where("known_writer = writer_id").select("writer_id", "seq", F.col("known_seq").alias("later"))
    own = settled(rows.join(later, ["writer_id", "seq"], "left").select("writer_id", "seq", F.col("writer_id").alias("known_writer"), F.coalesce("later", "seq").alias("known_seq")))
    return own.unionByName(others.where("known_writer <> writer_id"))


def _carried(rows: DataFrame, seen: DataFrame, parts: int | None) -> DataFrame:
    """Direct observations carried on along writers: for each entry and each writer observed up to it, the highest ``known_seq``.

    Rows are dealt to ranges of (writer, observed writer, seq); a range starts from the
    highest of the ranges before it, so a writer's entries are never one task's.
    """
    pair = ["writer_id", "known_writer"]
    since = seen.groupBy(*pair).agg(F.min("seq").alias("since"))
    places = rows.join(since, "writer_id").where("seq >= since").select("writer_id", "known_writer", "seq", F.lit(None).cast("bigint").alias("known_seq"))
    both = places.unionByName(seen.select(*places.columns))
    n = both.count()
    dealt = settled(both.repartitionByRange(parts or tasks_for(rows.sparkSession, n), *pair, "seq").withColumn("part", F.spark_partition_id()))
    before = W.partitionBy(*pair).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    start = dealt.groupBy("part", *pair).agg(F.max("known_seq").alias("highest")).withColumn("start", F.max("highest").over(before)).where("start IS NOT NULL").drop("highest")
    # An entry's own observations come before its place, which is the row without one.
    up_to = W.partitionBy("part", *pair).orderBy("seq", F.col("known_seq").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    run = spread(dealt, "part", *pair, rows=n).withColumn("highest", F.max("known_seq").over(up_to)).where("known_seq IS NULL").drop("known_seq")
    return run.join(start, ["part", *pair], "left").select("writer_id", "seq", "known_writer", F.greatest("highest", "start").alias("known_seq"))


def on_cycles(clock: DataFrame) -> DataFrame:
    """``writer_id, seq`` of entries that some entry precedes which they precede: no order holds them."""
    others = clock.where("known_writer <> writer_id")
    theirs = others.select(F.col("writer_id").alias("known_writer"), F.col("seq").alias("known_seq"), F.col("known_writer").alias("writer_id"), F.col("known_seq").alias("back"))
    seen = others.join(theirs, ["known_writer", "known_seq", "writer_id"])
    return seen.where("back >= seq").select("writer_id", "seq").distinct()


def converged(entries: DataFrame, edges: DataFrame, *, clock: DataFrame | None = None) -> DataFrame:
    """Entries with ``past`` and their place ``pos`` in a linear extension of the causal order.

    ``past``, the sum over the clock of ``seq`` + 1 (numbers count from 0; the size of
    the past where they have no gaps), rises along every edge, so (past, writer_id,
    seq, entry_hash) is such an extension; which one is meant beyond its ties is not
    specified.  Entries on a cycle are left out.
    """
    from veriloom.operators.integrity import positions

    clock = clocks(entries, edges) if clock is None else clock
    past = clock.groupBy("writer_id", "seq").agg(F.sum(F.col("known_seq") + 1).alias("past")).join(on_cycles(clock), ["writer_id", "seq"], "left_anti")
    return positions(entries.join(past, ["writer_id", "seq"]), ["past", "writer_id", "seq", "entry_hash"])


def rivals(entries: DataFrame, edges: DataFrame, *, clock: DataFrame | None = None) -> DataFrame:
    """``entity_ref, writer_id, seq, other, first, past_last``: for each entry and each other writer of its entity, that writer's entries (by their number on the entity, from 0) of which neither precedes the other.

    Of another writer, the entries that this one knows come first, and those that know
    this one come last; both borders are found by counting in order of ``seq``, so no
    two entries of an entity are ever compared.  Each (entry, other writer) is dealt
    once as what asks and once, seen from the other writer, as what is counted; both
    countings are windows over that one shuffle, of as many tasks as its rows need.
    Rows with an empty range are left out.
    """
    clock = clocks(entries, edges) if clock is None else clock
    rows = entries.where("entity_ref IS NOT NULL").select("entity_ref", "writer_id", F.col("seq").cast("bigint").alias("seq")).distinct()
    writers = rows.select("entity_ref", F.col("writer_id").alias("other")).distinct()
    known = clock.where("known_writer <> writer_id").groupBy("writer_id", "seq").agg(F.map_from_entries(F.collect_list(F.struct("known_writer", "known_seq"))).alias("known"))
    pairs = rows.join(known, ["writer_id", "seq"], "left").join(writers, "entity_ref").where("other <> writer_id")
    pairs = settled(pairs.select("entity_ref", "writer_id", "seq", "other", F.coalesce(F.try_element_at("known", "other"), F.lit(-1)).alias("known_seq")))
    # ``by_seq``: marks are the other writer's entries; ``by_known``: how much of this writer they know.
    asks = pairs.select("entity_ref", "writer_id", "other", "seq", F.lit(0).alias("mark"), F.col("known_seq").alias("by_seq"), (F.col("seq") - 1).alias("by_known"))
    marks = pairs.select("entity_ref", F.col("other").alias("writer_id"), F.col("writer_id").alias("other"), "seq", F.lit(1).alias("mark"), F.col("seq").alias("by_seq"), F.col("known_seq").alias("by_known"))
    key = ["entity_ref", "writer_id", "other"]
    dealt = spread(asks.unionByName(marks), *key, rows=2 * pairs.count())
    up_to = lambda at: W.partitionBy(*key).orderBy(at, F.desc("mark")).rowsBetween(W.unboundedPreceding, 0)
    counted = dealt.withColumn("first", F.sum("mark").over(up_to("by_seq"))).withColumn("past_last", F.sum("mark").over(up_to("by_known")))
    return counted.where("mark = 0 AND first < past_last").select("entity_ref", "writer_id", "seq", "other", "first", "past_last")


def divergent(entries: DataFrame, edges: DataFrame, *, clock: DataFrame | None = None) -> DataFrame:
    """``entity_ref, a, b``: pairs of entries on one entity of which neither precedes the other."""
    ranges = rivals(entries, edges, clock=clock).where("writer_id < other")
    rows = entries.select("entity_ref", "writer_id", F.col("seq").cast("bigint").alias("seq"), "entry_hash")
    # Entries that share a writer and a number share their place.
    number = F.dense_rank().over(W.partitionBy("entity_ref", "writer_id").orderBy("seq")) - 1
    numbered = rows.where("entity_ref IS NOT NULL").withColumn("number", number)
    pairs = ranges.withColumn("number", F.explode(F.sequence(F.col("first"), F.col("past_last") - 1))).select("entity_ref", "writer_id", "seq", "other", "number")
    mine = pairs.join(rows.withColumnRenamed("entry_hash", "x"), ["entity_ref", "writer_id", "seq"])
    met = mine.join(numbered.select("entity_ref", F.col("writer_id").alias("other"), "number", F.col("entry_hash").alias("y")), ["entity_ref", "other", "number"])
    return met.select("entity_ref", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def conflicts(entries: DataFrame, edges: DataFrame, *, clock: DataFrame | None = None) -> DataFrame:
    """``entity_ref, writer_id, seq, n``: entries that diverge from ``n`` others on their entity; pairs are counted, not made."""
    found = rivals(entries, edges, clock=clock)
    return found.groupBy("entity_ref", "writer_id", "seq").agg(F.sum(F.col("past_last") - F.col("first")).cast("bigint").alias("n"))
