"""Columnar tables of a data folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; filters and column choices reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors share.

    Where the session names none, a temporary folder is set in its place on one
    machine (tests); on a cluster that is an error, as its executors would not find it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="veriloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: About how many rows a task of ``spread`` sorts or joins.
TASK_ROWS = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for a shuffle of ``rows`` rows: Spark's number of shuffle partitions, or more where each would get over ``TASK_ROWS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def spread(df: DataFrame, *keys: str, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, shuffled by its keys to more tasks where Spark's own number would be too few.

    That number is a setting, so a task's share would grow with the input; here the
    number of tasks does.
    """
    tasks = tasks_for(df.sparkSession, rows)
    return df.repartition(tasks, *keys) if tasks > tasks_for(df.sparkSession, 0) else df


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage for good."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
