"""Connected components of an edge table, without gathering any group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.columns import drop_table, shared_table


def components(edges: DataFrame, *, task_edges: int = 200_000) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``); root: the least node reachable.

    Each task first replaces every ``task_edges`` edges that it holds by stars
    around the least nodes of their components (``contracted``).  Edges that fit
    in one such portion are thereby done.  More of them go through large-star and
    small-star steps (each an aggregate and a join, so a hub's edges may be split
    over tasks) and are contracted again until they no longer change.  Every round
    is written to the shared folder, which cuts lineage; so is the result.  Null
    ends are ignored; an empty table gives an empty result.
    """
    now = shared_table(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    n = now.count()
    if n <= task_edges:
        now = _after(now, contracted(now.coalesce(1), task_edges))
    else:
        mark = None
        while mark != (mark := _mark(now)):
            part = contracted(now, task_edges)
            both = part.union(part.select("b", "a"))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).distinct()
            now = _after(now, small)
    return _after(now, now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct()))


def contracted(edges: DataFrame, portion: int) -> DataFrame:
    """``a, b``: for every ``portion`` edges of a partition, each node beside the least node that it reaches by them."""
    schema = edges.schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def stars(ends: list[tuple]) -> pa.RecordBatch:
            names = sorted({x for pair in ends for x in pair})
            code = {x: i for i, x in enumerate(names)}
            a, b = (np.array([code[pair[side]] for pair in ends], np.int64) for side in (0, 1))
            label, before = np.arange(len(names)), None
            while before is None or (label != before).any():
                before = label.copy()
                low = np.minimum(label[a], label[b])
                for end in (a, b):
                    np.minimum.at(label, end, low)
                    np.minimum.at(label, before[end], low)
                label = label[label]
            away = np.flatnonzero(label != np.arange(len(names)))
            columns = [names[i] for i in away], [names[i] for i in label[away]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        held: list[tuple] = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            while len(held) >= portion:
                yield stars(held[:portion])
                held = held[portion:]
        if held:
            yield stars(held)

    return edges.mapInArrow(run, schema)


def _after(before: DataFrame, df: DataFrame) -> DataFrame:
    out = shared_table(df)
    drop_table(before)
    return out


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)
