"""Content hashes, drift and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.operators.digests import ordered_digest


def listing_hash(df: DataFrame, group: Sequence[str], path: str, digest: str) -> DataFrame:
    """``group, n, listing_sha256``: SHA-256 of the sorted ``path:digest`` lines."""
    line = F.concat_ws(":", F.col(path).cast("string"), F.col(digest))
    return ordered_digest(df, group, [line], line, name="listing_sha256")


def key_hash(*parts: Column, size: int = 16) -> Column:
    """The first ``size`` hexadecimal digits of the SHA-256 of the parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, size)


def drift(have: DataFrame, want: DataFrame, key: str, value: str) -> DataFrame:
    """``key, status``: ``diverged`` (differs, or isn't in ``want``) or ``missing`` (isn't in ``have``)."""
    a, b = have.select(key, F.col(value).alias("__have"), F.lit(True).alias("__h")), want.select(key, F.col(value).alias("__want"), F.lit(True).alias("__w"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("__h").isNull(), "missing").when(F.col("__w").isNull() | ~F.col("__have").eqNullSafe(F.col("__want")), "diverged")
    return both.select(key, status.alias("status")).where("status IS NOT NULL")


def triage(found: DataFrame, owned: DataFrame, pristine: DataFrame, key: str, value: str) -> DataFrame:
    """``key, verdict`` of files that nobody owns: ``delete`` (as shipped), ``mutated`` or ``unknown``."""
    loose = found.join(owned.select(key).distinct(), key, "left_anti").join(pristine.select(key, F.col(value).alias("__was")), key, "left")
    return loose.select(key, F.when(F.col("__was").isNull(), "unknown").when(F.col("__was") == F.col(value), "delete").otherwise("mutated").alias("verdict"))


def new_pairs(candidate: DataFrame, suite: DataFrame) -> DataFrame:
    """Distinct rows of ``candidate`` that ``suite`` doesn't have (both have the same columns)."""
    return candidate.distinct().join(suite.distinct(), [candidate[c].eqNullSafe(suite[c]) for c in candidate.columns], "left_anti")


def adjudicate(df: DataFrame, *, end: str, want_end: str, path: str, want_path: str, covered: str, wanted: str) -> DataFrame:
    """``df`` with ``passed``: the end is right, the path is (if one is wanted), and all wanted pairs are covered."""
    whole = F.col(want_path).isNull() | F.col(path).eqNullSafe(F.col(want_path))
    return df.withColumn("passed", F.col(end).eqNullSafe(F.col(want_end)) & whole & (F.size(F.array_except(F.coalesce(wanted, F.array().cast(df.schema[wanted].dataType)), covered)) <= 0))
