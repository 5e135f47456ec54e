"""Shared plumbing: text columns through Arrow batches, and shared-folder tables.

Every operator reads only the id and text column it is told about, so further
columns, whatever their names, can neither clash nor travel.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.sources.tables import shared_folder

#: Characters of text that a Python function gets at once, at least one row.
BLOCK_CHARS = 1 << 23


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of the data folder, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blocks(texts: Sequence[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` that hold about ``limit`` characters each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Applies ``make()`` (built once a task) to whole texts in Arrow batches.

    ``schema`` names the id column's successor columns; the built function gets
    a list of texts (null: empty) and returns a list of columns.
    """
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    out = StructType([StructField(id_col, df.schema[id_col].dataType), *fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        apply = make()
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                columns = apply(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))],
                    schema=arrow,
                )

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, out)


def shared_uri(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the driver and all executors share (``shared_folder``)."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written to the folder all executors share, and read again.

    Cuts lineage so that a lost executor never restarts the work before it.
    """
    spark, path = df.sparkSession, shared_uri(df.sparkSession, "veriloom")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    for made in _open:
        made.append(out)
    return out


def shared_buckets(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """``shared_table``, in buckets of the values of ``by``: plans that need its rows together read them so, without a shuffle."""
    spark, path = df.sparkSession, shared_uri(df.sparkSession, "veriloom")
    name = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(buckets, by).option("path", path).option("compression", "zstd").saveAsTable(name, format="parquet")
    out = spark.table(name)
    out.shared_path = path
    spark.sql(f"DROP TABLE {name}")  # only its name: the files lie outside the warehouse, and ``out`` keeps on reading them
    for made in _open:
        made.append(out)
    return out


#: The tables of each ``scratch`` block that has not ended.
_open: list[list[DataFrame]] = []


@contextmanager
def scratch(keep: Callable[[], list[DataFrame]] = list) -> Iterator[None]:
    """Drops, at its end, the tables that ``shared_table`` wrote in the block, but for those that ``keep()`` names."""
    _open.append([])
    try:
        yield
    finally:
        made = _open.pop()
        kept = {df.shared_path for df in keep()}
        for df in made:
            if df.shared_path not in kept:
                drop_table(df)


def drop_table(df: DataFrame) -> None:
    """Deletes what ``shared_table`` wrote, once nothing reads it any more."""
    drop_folder(df.sparkSession, df.shared_path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reaches."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
