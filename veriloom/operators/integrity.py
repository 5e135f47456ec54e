"""Integrity operators: each returns the rows that break a rule.

All take DataFrames and column names.  Nothing is collected; joins carry no
broadcast hints, so Spark broadcasts a side only where its size allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.sources.tables import settled


def missing_refs(child: DataFrame, field: str, parent: DataFrame, key: str, *, is_list: bool = False) -> DataFrame:
    """Rows of ``child`` with a ``ref`` that no row of ``parent`` has as its key; null refs are skipped."""
    refs = child.withColumn("ref", F.explode(field) if is_list else F.col(field)).where("ref IS NOT NULL")
    return refs.join(parent.select(F.col(key).alias("ref")).distinct(), "ref", "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows have, with the number ``n`` of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def later_holders(df: DataFrame, value: Sequence[str], order: Sequence[str], holder: str) -> DataFrame:
    """Rows whose value an earlier row holds already, with that row as ``first_holder``.

    The first holder is an aggregate (combined before the shuffle) that is joined
    back, so a value that very many rows hold is no one task's.  ``order`` tells all
    rows of a value apart.
    """
    names = [f"__v{i}" for i in range(len(value))]
    first = df.groupBy(*(F.col(c).alias(n) for c, n in zip(value, names))).agg(F.min(F.struct(*order, F.col(holder).alias("__holder"))).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    rows = df.join(first, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(value, names)])
    later = F.struct(*order) > F.struct(*(F.col(f"__first.{c}") for c in order))
    return rows.where(later).withColumn("first_holder", F.col("__first.__holder")).drop(*names, "__first", "__n")


def second_open(df: DataFrame, group: Sequence[str], order: Sequence[str], holder: str, is_open: Column) -> DataFrame:
    """Open rows of a group that already has an open one."""
    return later_holders(df.where(is_open), group, order, holder)


def without_child(parent: DataFrame, key: str, child: DataFrame, field: str) -> DataFrame:
    """Rows of ``parent`` that no row of ``child`` refers to."""
    return parent.join(child.select(F.col(field).alias(key)).distinct(), key, "left_anti")


def citer_counts(parent: DataFrame, key: str, child: DataFrame, field: str, cited_by: str) -> DataFrame:
    """``key, n, citers``: how many rows cite each parent, and their ids in order."""
    by = child.groupBy(F.col(field).alias(key)).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(cited_by)).alias("citers"))
    return parent.select(key).join(by, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("citers", F.array().cast(by.schema["citers"].dataType)).alias("citers"))


def barred(left: DataFrame, right: DataFrame, on: Sequence[str], below: Column) -> DataFrame:
    """Pairs of rows that share ``on`` for which ``below`` holds (a theta join inside equal keys)."""
    return left.join(right, list(on)).where(below)


def outside_set(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose value is no member of a closed set (null is none)."""
    return df.where(F.coalesce(~F.col(column).isin(*allowed), F.lit(True)))


def lacking(df: DataFrame, group: Sequence[str], column: str, required: Sequence[str]) -> DataFrame:
    """Groups that lack values of a required set: ``missing``, in the set's order."""
    have = df.groupBy(*group).agg(F.collect_set(F.when(F.col(column).isin(*required), F.col(column))).alias("have"))
    return have.select(*group, F.array_except(F.array(*map(F.lit, required)), "have").alias("missing")).where(F.size("missing") > 0)


def ambiguous(df: DataFrame, keys: Sequence[str], when: Column) -> DataFrame:
    """Keys with several rows for which ``when`` holds."""
    return duplicate_keys(df.where(when), keys)


def unattended(queue: DataFrame, attendants: DataFrame, item: str, order: Sequence[str]) -> DataFrame:
    """One row with the queue's ids in order if it isn't empty and nobody attends; else none.

    Only the two existence facts meet; the queue's ids are aggregated once.
    """
    listed = queue.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*order, item))).alias("q")).where("n > 0")
    some = attendants.agg(F.count("*").alias("attending"))
    return listed.join(some, F.col("attending") == 0).select("n", F.transform("q", lambda x: x[item]).alias("items"))


def unattended_rows(queue: DataFrame, attendants: DataFrame, order: Sequence[str]) -> DataFrame:
    """The queue's rows with their position ``pos`` if nobody attends; else none."""
    return positions(queue if attendants.isEmpty() else queue.limit(0), order)


def findings(df: DataFrame, keys: Sequence[str], tests: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row ``keys, finding`` for each test that a row fails; tests in order, all in one pass."""
    found = F.array(*(F.when(failed, F.lit(name)) for name, failed in tests))
    return df.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("finding"))


def first_reason(tests: Sequence[tuple[str, Column]], passed: str = "ok") -> Column:
    """The name of the first test that fails, as one ordered conditional."""
    out = None
    for name, failed in tests:
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return F.lit(passed) if out is None else out.otherwise(passed)


def resolve_first(ids: DataFrame, field: str, sources: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """``ids`` with ``found_in``: the first source that has the id, else ``missing``."""
    out = ids
    for i, (_, df, key) in enumerate(sources):
        out = out.join(df.select(F.col(key).alias(field), F.lit(True).alias(f"__in{i}")).distinct(), field, "left")
    return out.withColumn("found_in", F.coalesce(*(F.when(F.col(f"__in{i}"), F.lit(name)) for i, (name, _, _) in enumerate(sources)), F.lit("missing"))).drop(*(f"__in{i}" for i in range(len(sources))))


def chains(df: DataFrame, key: str, parent: str, *, limit: int | None = None) -> DataFrame:
    """``key, root, depth, cycle``: each row's walk up its single parent.

    Pointer doubling: every round joins each row with the row it points to, so a
    chain of n links takes log2(n) rounds, each written and read again.  ``cycle``
    marks walks that never end: once as many rows go on after 2n links as after n, no
    walk ends in between, so none ends later (or those longer than ``limit``).  A parent that is no row ends the walk above it.  Each key is one
    row.
    """
    base = df.select(F.col(key).alias("key"), F.col(parent).alias("up"))
    known = base.select(F.col("key").alias("up"), F.lit(True).alias("known"))
    now = base.join(known, "up", "left").select("key", F.when(F.col("known"), F.col("up")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("bigint").alias("depth"), F.coalesce(F.when(F.col("known"), F.col("up")), "key").alias("root"))
    reach, left = 1, -1
    while (limit is None or reach <= limit) and (n := now.where("up IS NOT NULL").count()) not in (0, left):
        left = n
        step = now.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("root").alias("r2"))
        now = settled(now.join(step, "up", "left").select("key", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.coalesce("r2", "root").alias("root")))
        reach *= 2
    return now.select(F.col("key").alias(key), F.when(F.col("up").isNull(), F.col("root")).alias("root"), F.when(F.col("up").isNull(), F.col("depth")).alias("depth"), F.col("up").isNotNull().alias("cycle"))


def closings(df: DataFrame, key: str, parent: str) -> DataFrame:
    """``key, closing``: for walks that all end in a cycle, the first member of the cycle that each walk meets.

    ``df`` holds every row of those walks.  Where a walk of 2, 4, 8 links ends is found
    by doubling.  Once that is longer than every tail, the places where walks end are
    exactly the members of cycles, and another doubling leaves their number as it is
    (before, it falls).  Rows of tails then take the answer of the row they point to,
    by doubling too, so there are as many rounds as the logarithm of the longest tail.
    """
    rows = df.select(F.col(key).alias("key"), F.col(parent).alias("up"))
    now, before = settled(rows.select("key", F.col("up").alias("at"))), -1
    while (n := now.select("at").distinct().count()) != before:
        before = n
        now = settled(now.join(now.select(F.col("key").alias("at"), F.col("at").alias("at2")), "at").select("key", F.col("at2").alias("at")))
    ring = settled(now.select(F.col("at").alias("key")).distinct())
    stays = ring.select("key", F.lit(True).alias("ring"))
    now = rows.join(stays, "key", "left").select("key", F.when(F.col("ring"), F.col("key")).otherwise(F.col("up")).alias("at"), F.col("ring"))
    known = stays.select(F.col("key").alias("at"), F.lit(True).alias("there"))
    while True:
        now = settled(now)
        if now.join(known, "at", "left_anti").isEmpty():
            break
        now = now.join(now.select(F.col("key").alias("at"), F.col("at").alias("at2")), "at", "left").select("key", F.coalesce("at2", "at").alias("at"))
    return now.select(F.col("key").alias(key), F.col("at").alias("closing"))


def positions(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """``df`` with each row's position (from 1) in the given order, without a global sort.

    Rows are dealt to ranges, sorted there and written with their range; a range's
    rows are then numbered, and a position is that number after the sizes of the
    ranges before.  Spark samples the boundaries itself; what the driver gets is one
    count for each range.
    """
    dealt = settled(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    within = dealt.withColumn("__at", F.row_number().over(W.partitionBy("__part").orderBy(*order)))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("size"))
    before = sizes.select("__part", F.coalesce(F.sum("size").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return within.join(before, "__part").withColumn(name, (F.col("__before") + F.col("__at")).cast("bigint")).drop("__part", "__at", "__before")


def queue_view(df: DataFrame, kind: str, ranks: dict[str, int], order: Sequence[str]) -> DataFrame:
    """Rows of the ranked kinds in order of rank, then ``order``, with their position ``pos``."""
    rank = F.create_map(*(x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))))
    return positions(df.withColumn("rank", rank[F.col(kind)]).where("rank IS NOT NULL"), ["rank", *order])
