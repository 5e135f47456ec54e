"""Digests of groups of rows in order, in constant memory.

Rows are dealt by their group and sorted within partitions (Spark spills what a task
can't hold); the hash takes them up one after another and is all that a task keeps of
a group.  A digest of a sequence is itself sequential, so a group is one task's, but
its size only costs that task time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def ordered_digest(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], data: str | Column, *, sep: str = "\n", head: str | Column | None = None, name: str = "sha256", count: str = "n"
) -> DataFrame:
    """``group, count, name``: rows of each group, and the SHA-256 of their ``data`` in order, joined by ``sep``.

    ``head`` (equal in a group's rows) comes before all, without a separator.  A null
    ``data`` is counted but not hashed, nor separated.  Without groups there is one
    digest, also of an empty table.  Groups may be null.
    """
    column = lambda c: F.col(c) if isinstance(c, str) else c
    keys = [f"__g{i}" for i in range(len(group))]
    orders = [f"__o{i}" for i in range(len(order))]
    rows = df.select(
        *(F.col(f"`{g}`").alias(k) for g, k in zip(group, keys)), (F.lit(None) if head is None else column(head)).cast("binary").alias("__head"),
        column(data).cast("binary").alias("__data"), *(column(o).alias(n) for o, n in zip(order, orders)),
    )
    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    out = StructType([*(StructField(g, df.schema[g].dataType) for g in group), StructField(count, LongType()), StructField(name, StringType())])
    n_keys, between = len(keys), sep.encode()

    def fold(batches):
        import hashlib

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, made = to_arrow_schema(out), []
        now, n, state, some = (None if n_keys else ()), 0, hashlib.sha256(), False

        def batch_of() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)
            made.clear()
            return batch

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *key, first, data in zip(*columns):
                key = tuple(key)
                if key != now:
                    if now is not None:
                        made.append((*now, n, state.hexdigest()))
                    now, n, state, some = key, 0, hashlib.sha256(first or b""), False
                elif not n and first:
                    state = hashlib.sha256(first)
                n += 1
                if data is not None:
                    if some:
                        state.update(between)
                    state.update(data)
                    some = True
            if made:
                yield batch_of()
        if now is not None:
            made.append((*now, n, state.hexdigest()))
            yield batch_of()

    folded = dealt.sortWithinPartitions(*keys, *orders).select(*keys, "__head", "__data").mapInArrow(fold, out)
    if keys:
        return folded
    # Of an empty table Spark may run no task at all.
    none = df.sparkSession.createDataFrame([(0, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")], out)
    both = folded.withColumn("__none", F.lit(False)).union(none.withColumn("__none", F.lit(True)))
    return both.groupBy().agg(F.min_by(F.struct(count, name), F.struct("__none", (-F.col(count)).alias("__less"))).alias("d")).select("d.*")
