"""Files as tables: run records, trees, evaluation runs, front matter; and their sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The schema of a run record.
RUN_RECORD = "run_id string, kind string, state string, idempotency_key string, policy string, events array<struct<seq:bigint,kind:string,payload:string>>"


def run_records(spark: SparkSession, folder: str) -> DataFrame:
    """Run records of a folder with their file ``name``; unreadable files and non-objects are left out."""
    rows = spark.read.schema(RUN_RECORD + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)).where("_bad IS NULL AND run_id IS NOT NULL").drop("_bad")


def events_of(records: DataFrame) -> DataFrame:
    """The logs of run records as rows ``run_id, seq, kind, payload``."""
    return records.select("run_id", F.explode("events").alias("e")).select("run_id", "e.seq", "e.kind", "e.payload")


def definitions(preferred: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Definitions by id, the preferred source's first."""
    both = preferred.withColumn("__rank", F.lit(0)).unionByName(fallback.withColumn("__rank", F.lit(1)))
    return both.withColumn("__at", F.row_number().over(W.partitionBy(key).orderBy("__rank"))).where("__at = 1").drop("__rank", "__at")


def books_of(runbooks: DataFrame, steps: DataFrame) -> DataFrame:
    """Run-book definitions ``runbook_id, release_version, steps`` from entities, steps numbered from 0 in order of ``seq``; the fallback of ``definitions``."""
    step = F.struct((F.col("seq") - 1).alias("seq"), F.col("tool_id").alias("tool"), "expr")
    held = steps.groupBy("runbook_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    books = runbooks.select(F.col("_key").alias("runbook_id"), "release_version").join(held, "runbook_id", "left")
    return books.withColumn("steps", F.coalesce("steps", F.array().cast(held.schema["steps"].dataType)))


def tree(spark: SparkSession, root: str, *, glob: str = "*", skip: Sequence[str] = ()) -> DataFrame:
    """``path, sha256, length`` of every file below a root, by path relative to it; ``skip``: directories left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.removeprefix("file:").rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in base), "")
    out = files.select(rel.alias("path"), F.sha2("content", 256).alias("sha256"), "length")
    for part in skip:
        out = out.where(~F.col("path").rlike(rf"(^|/){part}(/|$)"))
    return out


def excluded(path: Column, directories: Sequence[str], patterns: Sequence[str]) -> Column:
    """Whether a path lies in one of the directories or its name matches one of the globs."""
    out = F.lit(False)
    for d in directories:
        out = out | path.rlike(rf"(^|/){d}(/|$)")
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    for p in patterns:
        rx = "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() else "\\" + c for c in p)
        out = out | name.rlike(f"^{rx}$")
    return out


EVAL_RUN = "summary struct<pass_rate:double,passed:bigint,failed:bigint,total:bigint>, timing struct<total_duration_seconds:double>, execution_metrics struct<total_tool_calls:bigint,errors_encountered:bigint,output_chars:bigint,total_tokens:bigint>"


def eval_runs(spark: SparkSession, root: str) -> DataFrame:
    """Graded runs under ``<eval>/<configuration>/run-<n>/grading.json``: ids from paths, time and tokens by fallback."""
    rows = spark.read.schema(EVAL_RUN + ", _bad string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "grading.json").option("columnNameOfCorruptRecord", "_bad").json(root)
    parts = F.split(F.input_file_name(), "/")
    part = lambda i: F.element_at(parts, i)
    m = F.col("execution_metrics")
    return rows.select(
        part(-4).alias("eval_id"), part(-3).alias("configuration"), F.regexp_extract(part(-2), r"(\d+)$", 1).cast("int").alias("run_number"),
        *(F.coalesce(f"summary.{c}", F.lit(0)).cast(t).alias(c) for c, t in (("pass_rate", "double"), ("passed", "bigint"), ("failed", "bigint"), ("total", "bigint"))),
        F.coalesce("timing.total_duration_seconds", F.lit(0.0)).alias("time_seconds"),
        F.coalesce(F.nullif(m["total_tokens"], F.lit(0)), m["output_chars"], F.lit(0)).cast("bigint").alias("tokens"),
        F.coalesce(m["total_tool_calls"], F.lit(0)).alias("tool_calls"), F.coalesce(m["errors_encountered"], F.lit(0)).alias("errors"), "_bad",
    ).where("_bad IS NULL").drop("_bad")


def front_matter(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """``path, name, description, body`` of Markdown files with a front matter block; errors in ``error``."""
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).withColumn("path", F.input_file_name())
    block, body = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n?", "")
    value = lambda k: F.trim(F.regexp_replace(F.regexp_extract(block, rf"(?m)^{k}:[ \t]*(.*)$", 1), "^[\"']|[\"']$", ""))
    folded = F.trim(F.regexp_replace(F.regexp_extract(block, r"(?m)^description:[ \t]*[>|]-?\n((?:[ \t]+.*\n?)*)", 1), r"\s+", " "))
    out = texts.select("path", value("name").alias("name"), F.when(folded != "", folded).otherwise(value("description")).alias("description"), body.alias("body"), (block == "").alias("none"))
    error = F.when(F.col("none"), "no front matter").when(F.col("name") == "", "no name").when(~F.col("name").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "bad name").when(F.length("name") > 64, "name too long").when(F.col("description") == "", "no description").when(F.length("description") > 1024, "description too long")
    return out.withColumn("error", error).drop("none")


def settle(flags: dict, file: dict, defaults: dict) -> dict[str, tuple]:
    """Each setting's ``(value, source)``: flag, else file, else default."""
    out = {}
    for key, default in defaults.items():
        source = "flag" if flags.get(key) is not None else "file" if file.get(key) is not None else "default"
        out[key] = ({"flag": flags, "file": file}.get(source, defaults)[key] if source != "default" else default, source)
    return out


def parse_settings(text: str) -> dict:
    """Settings of a small YAML subset: integers and strings, one nested level."""
    out: dict = {}
    inner: dict | None = None
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, colon, value = line.strip().partition(":")
        if not colon or "\t" in raw:
            raise ValueError(f"line {n}: not a setting")
        value = value.strip().strip("\"'")
        typed = int(value) if value.lstrip("-").isdigit() else value
        if line[0] == " ":
            if inner is None:
                raise ValueError(f"line {n}: nothing to nest in")
            inner[key] = typed
        elif value:
            out[key], inner = typed, None
        else:
            out[key] = inner = {}
    return out


def write_sorted_json(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Rows as JSON lines in order, within files of ranges of the order columns."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_commits(new: DataFrame, path: str) -> None:
    """Appends commits with the SHA-256 of their payload (an append-only table)."""
    new.withColumn("payload_hash", F.sha2("payload", 256)).write.mode("append").parquet(path)


def mint(rows: DataFrame, last: int, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``seq`` counting on from ``last`` in order (a batch of new messages, bounded by its source)."""
    return rows.withColumn("seq", F.row_number().over(W.orderBy(*order)) + F.lit(last))
