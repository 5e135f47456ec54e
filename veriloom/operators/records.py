"""Checks of commits over logs and of the records around them: one row for each finding.

Texts begin with the surveyed rule's name; their wording is this library's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.operators.integrity import findings

ORIGINS = ("operator-direct", "operator-instructed", "ambient")
PRODUCTION = ("accretion-writer", "disclosure", "replay-corpus")


def commit_completeness(commits: DataFrame, log: DataFrame, run: str = "flow_run_id") -> DataFrame:
    """I-18: a commit starts after the one before it and embeds exactly the events of its range.

    ``commits``: run, first_seq, last_seq, events (array of the log's ``event``
    strings in order); ``log``: run, seq, event.
    """
    w = W.partitionBy(run).orderBy("first_seq", "last_seq")
    c = commits.withColumn("expected", F.coalesce(F.lag("last_seq").over(w), F.lit(0)) + 1)
    ends = log.groupBy(run).agg(F.max("seq").alias("log_end"))
    inside = (
        c.select(run, "first_seq", "last_seq", "expected").join(log, run).where((F.col("seq") >= F.col("expected")) & (F.col("seq") <= F.col("last_seq")))
        .groupBy(run, "first_seq", "last_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "event"))), lambda x: x["event"]).alias("actual"))
    )
    rows = c.join(ends, run, "left").join(inside, [run, "first_seq", "last_seq"], "left")
    claimed, actual = F.coalesce("events", F.array().cast("array<string>")), F.coalesce("actual", F.array().cast("array<string>"))
    return findings(rows, [run, "first_seq", "last_seq"], [
        ("I-18: commit doesn't start at the watermark", F.col("first_seq") != F.col("expected")),
        ("I-18: committed payload does not embed exactly the events in its claimed range", claimed != actual),
        ("I-18: commit claims events beyond the flow log", F.col("last_seq") > F.coalesce("log_end", F.lit(0))),
    ])


def commit_integrity(commits: DataFrame, canonical: Column, run: str = "flow_run_id") -> DataFrame:
    """I-19 and I-20: payloads canonical and named by their hashes, ranges apart."""
    w = W.partitionBy(run).orderBy("ord")
    rows = commits.withColumn("before", F.lag("last_seq").over(w)).withColumn("canonical", canonical)
    return findings(rows, [run, "ord"], [
        ("I-19: committed payload is not the canonical serialization of its claimed inputs", ~F.col("payload").eqNullSafe(F.col("canonical"))),
        ("I-20: payload mutated (hash mismatch) — history was rewritten", ~F.col("payload_hash").eqNullSafe(F.sha2("payload", 256))),
        ("I-20: overlapping commit ranges", F.col("first_seq") <= F.col("before")),
    ])


def separation(presented: DataFrame, keys: Sequence[str]) -> DataFrame:
    """I-22: simulated content presented to a production destination."""
    return findings(presented, keys, [("I-22: kind=simulation presented to production", (F.col("kind") == "simulation") & F.col("destination").isin(*PRODUCTION))])


def _identity(rule: str) -> list[tuple[str, Column]]:
    mine, theirs = F.col("manifest_identity"), F.col("repo_identity")
    return [
        (f"{rule}: the handle is not a git repo", ~F.col("git_available")),
        (f"{rule}: the manifest records no identity", mine.isNull()),
        (f"{rule}: the handle has no identity", theirs.isNull()),
        (f"{rule}: the handle identity does not match the manifest-recorded identity", mine.isNotNull() & theirs.isNotNull() & (mine != theirs)),
    ]


def identity_binding(handles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """I-25 over ``manifest_identity, repo_identity, git_available``."""
    return findings(handles, keys, _identity("I-25"))


def initiation(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """I-26 over ``initiator, origin, principal, harness_strapped``."""
    return findings(records, keys, [
        ("I-26: initiator is not the operator principal", ~F.col("initiator").eqNullSafe("operator")),
        ("I-26: ambient-originated initiation", F.col("origin").eqNullSafe("ambient")),
        ("I-26: unknown initiation origin", F.coalesce(~F.col("origin").isin(*ORIGINS), F.lit(True))),
        ("I-26: principal is not dyad-or-human (agents excluded)", ~F.col("principal").eqNullSafe("dyad-or-human")),
        ("I-26: drive not invoked through a strapped Harness", ~F.coalesce("harness_strapped", F.lit(False))),
    ])


def acquisition(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """I-27 over ``path_source, path, at_initiation`` and the identity columns."""
    return findings(records, keys, [
        ("I-27: unknown path source", F.coalesce(~F.col("path_source").isin("flag", "config", "default"), F.lit(True))),
        ("I-27: no path resolvable under the config contract", F.coalesce("path", F.lit("")) == ""),
        *_identity("I-27"),
        ("I-27: resolution did not happen at initiation", ~F.coalesce("at_initiation", F.lit(False))),
    ])


def sealed(bundles: DataFrame, files: DataFrame, key: str = "bundle") -> DataFrame:
    """``key, intact``: whether a bundle's seal is the digest of its sorted ``path:hash`` lines."""
    from veriloom.operators.hashing import listing_hash

    found = listing_hash(files, [key], "path", "sha256").select(key, "listing_sha256")
    return bundles.join(found, key, "left").select(key, F.col("seal").eqNullSafe(F.col("listing_sha256")).alias("intact"))
