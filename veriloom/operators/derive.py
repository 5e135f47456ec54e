"""Content-addressed derivations, coverage of simulated runs, and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from veriloom.operators.digests import ordered_digest
from veriloom.sources.tables import spread


def directory_bytes(files: DataFrame, group: Sequence[str], path: str, content: str, *, kind: str | None = None) -> DataFrame:
    """``group, n, sha256``: the digest of a tree's canonical bytes.

    Entries in order of path; a file as path, NUL, ``f``, the content's length in eight
    bytes (big-endian), content.  ``kind`` names a column of ``f``, ``l`` (a symbolic link:
    path, NUL, ``l``, its target as content) or ``o`` (anything else: nothing after it);
    without it all are files.
    """
    length = F.unhex(F.lpad(F.hex(F.length(content)), 16, "0"))
    which = F.lit("f") if kind is None else F.col(kind)
    rest = F.when(which == "f", F.concat(length, F.col(content))).when(which == "l", F.col(content)).otherwise(F.lit(b""))
    entry = F.concat(F.col(path).cast("binary"), F.lit(b"\0"), which.cast("binary"), rest)
    return ordered_digest(files, group, [path], entry, sep="")


def canonical_json(columns: dict[str, Column]) -> Column:
    """A JSON object with sorted keys and compact separators; null values are written.

    Keys of structs inside a value are in the order of their type (``sorted_fields``
    sorts them).
    """
    one = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"^\{\"v\":(.*)\}$", 1), F.lit("null"))
    value = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(one(c))
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), value(c)) for k, c in sorted(columns.items()))), F.lit("}"))


def sorted_fields(value: Column, kind: DataType) -> Column:
    """A value whose structs, however deep, have their fields in order of name."""
    if isinstance(kind, StructType):
        made = F.struct(*(sorted_fields(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
        return F.when(value.isNotNull(), made)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: sorted_fields(x, kind.elementType))
    if isinstance(kind, MapType):
        entries = F.array_sort(F.map_entries(F.transform_values(value, lambda _, x: sorted_fields(x, kind.valueType))))
        return F.map_from_entries(entries)
    return value


def rendered(df: DataFrame) -> Column:
    """A row as JSON with sorted keys at every depth, nulls written: the same bytes for the same row."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return F.to_json(sorted_fields(row, df.schema), {"ignoreNullFields": "false"})


def entity_set_hash(collections: dict[str, DataFrame]) -> DataFrame:
    """``collection, sha256``: each collection's entities as canonical JSON in key order, hashed."""
    out = None
    for name, df in sorted(collections.items()):
        fields = {c: F.col(c) for c in df.columns if c not in ("_key", "_ord")}
        # A row without data stands for the collection, so that an empty one has a digest too.
        line = df.select(F.lit(name).alias("collection"), "_key", canonical_json(fields).alias("line"))
        none = df.sparkSession.createDataFrame([(name, None, None)], line.schema)
        out = line.union(none) if out is None else out.union(line).union(none)
    return ordered_digest(out, ["collection"], ["_key"], "line").select("collection", "sha256")


def derive(manifests: DataFrame, inputs: DataFrame, known: Sequence[str] = ("identity",)) -> DataFrame:
    """Receipts ``manifest_id, manifest_hash, ok, failures, output_hash``.

    ``manifests``: manifest_id, derivation, toolchain; ``inputs``: manifest_id,
    pos, path, content (null: missing), pin (null: not pinned).  Inputs are joined
    in order; a pinned one must have the digest it is pinned to.
    """
    digest = F.sha2("content", 256)
    failure = F.when(F.col("content").isNull(), F.concat(F.lit("missing input "), F.col("path"))).when(F.col("pin").isNotNull() & (F.col("pin") != digest), F.concat(F.lit("pin mismatch "), F.col("path")))
    rows = inputs.withColumn("failure", failure)
    # Contents and lines go through a running hash; only a manifest's failures are kept together.
    each = rows.groupBy("manifest_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("failure").isNotNull(), F.struct("pos", "failure")))).alias("failed"),
        F.min(F.col("pin").isNotNull()).alias("pinned"),
    )
    both = manifests.join(each, "manifest_id", "left")
    outputs = ordered_digest(rows, ["manifest_id"], ["pos"], F.coalesce("content", F.lit(b"")), sep="", name="output").select("manifest_id", "output")
    head = F.concat(F.concat_ws("\0", "derivation", "toolchain"), F.lit("\0"))
    lines = manifests.join(inputs.select("manifest_id", "pos", F.concat_ws("\0", "path", F.coalesce("pin", F.lit(""))).alias("line")), "manifest_id", "left")
    hashes = ordered_digest(lines, ["manifest_id"], ["pos"], "line", head=head, name="manifest_hash").select("manifest_id", "manifest_hash")
    problems = F.array_distinct(F.concat(
        F.when(~F.col("derivation").isin(*known), F.array(F.concat(F.lit("unknown derivation "), F.col("derivation")))).otherwise(F.array().cast("array<string>")),
        F.coalesce(F.transform("failed", lambda x: x["failure"]), F.array().cast("array<string>")),
    ))
    empty = F.sha2(F.lit(b""), 256)
    return both.join(hashes, "manifest_id").join(outputs, "manifest_id", "left").select(
        "manifest_id", "manifest_hash",
        (F.size(problems) == 0).alias("ok"), problems.alias("failures"), F.when(F.size(problems) == 0, F.coalesce("output", empty)).alias("output_hash"), F.coalesce("pinned", F.lit(True)).alias("pinned"),
    )


def from_cache(receipts: DataFrame, cache: DataFrame) -> DataFrame:
    """Receipts with ``cached``: the stored output of the same manifest, only where all inputs are pinned and it is sound."""
    store = cache.where(F.sha2("output", 256) == F.col("output_hash")).select("manifest_hash", F.col("output_hash").alias("cached"))
    return receipts.join(store, "manifest_hash", "left").withColumn("cached", F.when(F.col("pinned"), F.col("cached")))


def reproducible(first: DataFrame, second: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose two evaluations differ."""
    a, b = first.select(key, F.col(digest).alias("a")), second.select(key, F.col(digest).alias("b"))
    return a.join(b, key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def event_pairs(events: DataFrame, transitions: DataFrame) -> DataFrame:
    """Events with ``transition_id, guard_outcome`` by (from, to, trigger); the last definition of equals wins; none: null."""
    last = transitions.groupBy("from_state_id", "to_state_id", "trigger").agg(F.max_by(F.struct("transition_id", F.col("guard").isNotNull().alias("guarded")), "ord").alias("t"))
    return events.join(last, ["from_state_id", "to_state_id", "trigger"], "left").select(*events.columns, F.col("t.transition_id").alias("transition_id"), F.when(F.col("t.guarded"), "true").when(F.col("t.guarded").isNotNull(), "default").alias("guard_outcome"))


def harden(candidates: DataFrame) -> DataFrame:
    """``scenario_id, admitted, reason``: new coverage (or a bug) first, then standing.

    ``candidates``: scenario_id, n_new, found_bug, terminal_trigger, disposition_ref.
    """
    covers = (F.col("n_new") > 0) | F.coalesce("found_bug", F.lit(False))
    stands = (F.col("terminal_trigger") == "run_aborted") | (F.coalesce("disposition_ref", F.lit("")) != "")
    reason = F.when(~covers, "no new coverage").when(~F.coalesce(stands, F.lit(False)), "no standing").otherwise("ok")
    return candidates.select("scenario_id", (reason == "ok").alias("admitted"), reason.alias("reason"))


def within_budget(scenarios: DataFrame, briefs: DataFrame) -> DataFrame:
    """Scenarios with ``accepted``: known brief, not retired, and within its budget in order.

    Scenarios are dealt by their brief to as many tasks as their number needs, which
    join and place them there.
    """
    b = briefs.select("brief_id", "budget", "authored", "retired", F.lit(True).alias("known"))
    place = F.row_number().over(W.partitionBy("brief_id").orderBy("scenario_id"))
    dealt = spread(scenarios, "brief_id", rows=scenarios.count())
    return dealt.join(b, "brief_id", "left").withColumn("accepted", F.coalesce(F.col("known") & ~F.col("retired") & (F.col("authored") + place <= F.col("budget")), F.lit(False))).drop("known", "budget", "authored", "retired")
