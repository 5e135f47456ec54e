"""Tables in versions, and an outbox of numbered messages: sinks that two writers can't both win.

A version is written in two steps.  Spark writes the data to a folder of its own (a
failing task leaves nothing that anybody reads); then a small file that names the
folder is moved to the version's number, which only succeeds if nobody else has taken
it.  So a writer that doesn't know the latest version is refused, and readers see a
version whole or not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.operators.integrity import positions
from veriloom.sources.tables import settled


class StaleVersion(RuntimeError):
    """Somebody else has written the version in the meantime."""


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop.fs


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whole; false, and nothing done, if the path is taken."""
    from py4j.protocol import Py4JJavaError

    fs, conf = _hadoop(spark), spark.sparkContext._jsc.hadoopConfiguration()
    target, draft = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    system = target.getFileSystem(conf)
    out = system.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = fs.FileContext.getFileContext(system.makeQualified(target).toUri(), conf)
    plain = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(target), plain)
    except Py4JJavaError as e:
        system.delete(draft, False)
        if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
            return False
        raise
    return True


def published(spark: SparkSession, folder: str) -> dict[int, str]:
    """The small files of a folder by their numbers."""
    fs, conf = _hadoop(spark), spark.sparkContext._jsc.hadoopConfiguration()
    top = fs.Path(folder)
    system, out = top.getFileSystem(conf), {}
    if not system.exists(top):
        return out
    for status in system.listStatus(top):
        name = status.getPath().getName()
        if name.isdecimal():
            stream = system.open(status.getPath())
            out[int(name)] = bytes(stream.readAllBytes()).decode()
            stream.close()
    return out


def latest(spark: SparkSession, folder: str) -> int:
    """The number of a table's latest version; 0 if there is none."""
    return max(published(spark, f"{folder}/versions"), default=0)


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of a table (default: the latest)."""
    known = published(spark, f"{folder}/versions")
    if not known or version not in (None, *known):
        raise LookupError(f"no version {version or ''} of {folder}".replace("  ", " "))
    return spark.read.parquet(f"{folder}/{known[version or max(known)]}")


def replace(df: DataFrame, folder: str, *, seen: int) -> int:
    """Writes ``df`` as the version after ``seen``, the latest that the writer knows; its number.

    Raises ``StaleVersion`` if another writer has written that one.
    """
    spark, data = df.sparkSession, f"data-{uuid.uuid4().hex}"
    if latest(spark, folder) != seen:
        raise StaleVersion(f"{folder}: version {seen} isn't the latest")
    df.write.parquet(f"{folder}/{data}")
    if not publish(spark, f"{folder}/versions/{seen + 1}", data):
        gone = _hadoop(spark).Path(f"{folder}/{data}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
        raise StaleVersion(f"{folder}: version {seen + 1} was written meanwhile")
    return seen + 1


def update(spark: SparkSession, folder: str, change: Callable[[DataFrame], DataFrame], *, tries: int = 5) -> int:
    """Reads the latest version, changes it and writes the next; starts over where another writer was first."""
    for _ in range(tries):
        seen = latest(spark, folder)
        try:
            return replace(change(read(spark, folder, seen)), folder, seen=seen)
        except StaleVersion:
            continue
    raise StaleVersion(f"{folder}: {tries} times another writer was first")


def put_records(records: DataFrame, folder: str, key: str, *, seen: int | None = None) -> int:
    """A version in which ``records`` stand in place of those with their keys; others stay."""
    spark = records.sparkSession
    seen = latest(spark, folder) if seen is None else seen
    old = read(spark, folder, seen).join(records.select(key), key, "left_anti") if seen else records.limit(0)
    return replace(old.unionByName(records, allowMissingColumns=True), folder, seen=seen)


def put_missing(rows: DataFrame, folder: str, key: str) -> int:
    """A version with those of ``rows`` whose content key isn't there yet (a store of derivations' outputs); the latest if none is new."""
    spark = rows.sparkSession
    seen = latest(spark, folder)
    old = read(spark, folder, seen) if seen else rows.limit(0)
    new = settled(rows.dropDuplicates([key]).join(old.select(key), key, "left_anti"))
    return replace(old.unionByName(new), folder, seen=seen) if not seen or not new.isEmpty() else seen


#: The text of a message, its kind and its first state.
TEMPLATE = ("flow_id", "flow_run_id", "state_id", "trigger")
KIND, OPEN = "automaton-exception", "open"


class Outbox:
    """Messages of faulted flow runs, numbered from 1 without gaps, also over restarts.

    A batch first takes a range of numbers under its own id; if it comes again (a stream
    that starts over repeats its last batch), it finds its range and writes the same
    numbers to the same place.  One stream writes to a folder; a second one that takes
    the same batch id at the same time is refused.
    """

    def __init__(self, folder: str, order: Sequence[str] = TEMPLATE) -> None:
        self.folder, self.order = folder.rstrip("/"), list(order)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """For ``writeStream.foreachBatch``; ``batch`` has the columns of the template."""
        spark = batch.sparkSession
        rows = settled(batch)
        known = {k: tuple(map(int, v.split())) for k, v in published(spark, f"{self.folder}/ranges").items()}
        if batch_id in known:
            first, _ = known[batch_id]
        else:
            first, n = sum(count for _, count in known.values()) + 1, rows.count()
            if not publish(spark, f"{self.folder}/ranges/{batch_id}", f"{first} {n}"):
                raise StaleVersion(f"{self.folder}: batch {batch_id} is written by somebody else")
        self.numbered(rows, first).write.mode("overwrite").parquet(f"{self.folder}/messages/batch={batch_id}")

    def numbered(self, rows: DataFrame, first: int) -> DataFrame:
        text = F.concat(*(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c), F.lit("")), F.lit("\n")) for c in TEMPLATE))
        seq = (F.col("pos") + F.lit(first - 1)).cast("bigint")
        return positions(rows, self.order).select(
            F.concat(F.lit("dl-"), F.lpad(seq.cast("string"), F.greatest(F.lit(6), F.length(seq.cast("string"))), F.lit("0"))).alias("id"), seq.alias("seq"), F.lit(KIND).alias("kind"), text.alias("text"), F.lit(OPEN).alias("status"), *TEMPLATE
        )

    def messages(self, spark: SparkSession) -> DataFrame:
        """All messages; of batches whose range is taken but not yet written none."""
        return spark.read.parquet(f"{self.folder}/messages").drop("batch")
