"""Summary statistics of evaluation runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def summary(df: DataFrame, group: Sequence[str], value: str, digits: int = 4) -> DataFrame:
    """``group, n, mean, stddev, min, max``: sample deviation, 0 for one row; all 0 where every value is null."""
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), digits)
    v = F.col(value).cast("double")
    return df.groupBy(*group).agg(F.count(v).alias("n"), r(F.avg(v)).alias("mean"), r(F.stddev_samp(v)).alias("stddev"), r(F.min(v)).alias("min"), r(F.max(v)).alias("max"))


def deltas(summaries: DataFrame, config: str, values: Sequence[str], first: str, second: str) -> DataFrame:
    """One row: the signed difference of each value between two configurations, as text."""
    pick = lambda name, v: F.max(F.when(F.col(config) == name, F.col(v)))
    return summaries.agg(*(F.format_string("%+.2f", F.coalesce(pick(first, v), F.lit(0.0)) - F.coalesce(pick(second, v), F.lit(0.0))).alias(v) for v in values))


def trigger_rate(df: DataFrame, group: Sequence[str], hit: Column, should: Column, threshold: float = 0.5) -> DataFrame:
    """``group, n, hits, rate, passed``: at least the threshold where it should trigger, below it where not."""
    out = df.groupBy(*group).agg(F.count("*").alias("n"), F.sum(hit.cast("bigint")).alias("hits"), F.max(should).alias("should"))
    rate = F.col("hits") / F.col("n")
    return out.select(*group, "n", "hits", F.round(rate, 6).alias("rate"), F.when(F.col("should"), rate >= threshold).otherwise(rate < threshold).alias("passed"))


def confusion(df: DataFrame, group: Sequence[str], predicted: Column, actual: Column) -> DataFrame:
    """Confusion counts with precision, recall (1 without cases) and accuracy (0 without rows)."""
    n = lambda c: F.count_if(c)
    out = df.groupBy(*group).agg(n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"), n(~predicted & actual).alias("fn"), n(~predicted & ~actual).alias("tn"))
    ratio = lambda a, b, default: F.round(F.when(b > 0, a / b).otherwise(default), 6)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return out.select(*group, "tp", "fp", "fn", "tn", ratio(tp, tp + fp, 1.0).alias("precision"), ratio(tp, tp + fn, 1.0).alias("recall"), ratio(tp + tn, tp + fp + fn + tn, 0.0).alias("accuracy"))


def holdout(df: DataFrame, strata: Sequence[str], key: str, share: float, seed: int = 42, *, digits: int = 4) -> DataFrame:
    """``df`` with ``part``: at least one row of each stratum is ``test``, the least by a hash of the key.

    Distributed selection: a histogram of each stratum's hashes by their first
    ``digits`` hexadecimal digits (combined before the shuffle) tells the bin in which
    the last chosen row lies; rows of bins before it are chosen, and only that bin's
    rows are ranked.  No stratum is ever sorted.
    """
    names = [f"__s{i}" for i in range(len(strata))]
    hashed = df.withColumn("__hash", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)).withColumn("__bin", F.substring("__hash", 1, digits))
    bins = hashed.groupBy(*(F.col(c).alias(n) for c, n in zip(strata, names)), "__bin").agg(F.count("*").alias("__n"))
    of_stratum = W.partitionBy(*names)
    upto = F.sum("__n").over(of_stratum.orderBy("__bin").rowsBetween(W.unboundedPreceding, 0))
    take = F.greatest(F.lit(1), F.floor(F.sum("__n").over(of_stratum) * share))
    edges = bins.withColumn("__upto", upto).withColumn("__take", take).where("__upto >= __take").groupBy(*names).agg(
        F.min("__bin").alias("__edge"), F.min_by(F.col("__take") - F.col("__upto") + F.col("__n"), "__bin").alias("__left"))
    judged = hashed.join(edges, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(strata, names)])
    on_edge = judged.where("__bin = __edge").withColumn("__rank", F.row_number().over(W.partitionBy(*strata).orderBy("__hash")))
    chosen = on_edge.select(*(F.col(f"`{c}`") for c in df.columns), F.when(F.col("__rank") <= F.col("__left"), "test").otherwise("train").alias("part"))
    rest = judged.where("__bin <> __edge").select(*(F.col(f"`{c}`") for c in df.columns), F.when(F.col("__bin") < F.col("__edge"), "test").otherwise("train").alias("part"))
    return chosen.unionByName(rest)


def best(df: DataFrame, group: Sequence[str], score: str, order: str) -> DataFrame:
    """The row of each group with the highest score; the first by ``order`` of equals."""
    key = F.struct(F.col(score), -F.col(order))
    return df.groupBy(*group).agg(F.max_by(F.struct(*[c for c in df.columns if c not in group]), key).alias("__top")).select(*group, "__top.*")


def matrix(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Counts by row and value, a column for each value (0 where there are none)."""
    return df.groupBy(*rows).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``collection, n`` of every table that isn't empty."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


def merge_feedback(runs: DataFrame, before: DataFrame, key: str, feedback: str) -> DataFrame:
    """``key, feedback, previous``: this and the previous iteration's feedback, blank dropped."""
    clean = lambda c: F.when(F.trim(c) != "", c)
    a, b = runs.select(key, clean(F.col(feedback)).alias("feedback")), before.select(key, clean(F.col(feedback)).alias("previous"))
    return a.join(b, key, "full_outer").where("feedback IS NOT NULL OR previous IS NOT NULL")


def retry_score(df: DataFrame, group: Sequence[str], correct: Column) -> DataFrame:
    """``group, correct, total, band``: right answers across retries; good from 0.8 on, fair from 0.5 on, else poor."""
    out = df.groupBy(*group).agg(F.count_if(correct).alias("correct"), F.count("*").alias("total"))
    share = F.col("correct") / F.col("total")
    return out.withColumn("band", F.when(share >= 0.8, "good").when(share >= 0.5, "fair").otherwise("poor"))


def wrong_triggers(results: DataFrame) -> DataFrame:
    """Rows of ``should, passed`` that failed: ``failed`` (should trigger) or ``false`` (should not)."""
    return results.where(~F.col("passed")).withColumn("problem", F.when(F.col("should"), "failed").otherwise("false"))
