"""The corpus pipeline: five stages, each an operator of ``veriloom.llm``.

``run`` applies the stages to the table of documents.  Each stage gets what its
predecessor kept, written as Parquet and read again; all but the last return the
columns of documents.

Defined results, for every stage: documents with a null or empty text are judged
like any other (quality rules reject them: they have too few words), and a stage
that gets them all the same keeps them as they are; very long texts are taken
whole; repeated rows are rejected or kept alike by the quality rules, cleaned alike
by line dedup, and are copies of one another to near-dedup, which keeps one row; of
ties the least id stays, a null id last; a null id stays null; an empty
table gives an empty result; further columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import line_dedup, minhash_dedup, packing, quality_rules, secret_scans
from veriloom.llm.columns import documents, drop_table, scratch, shared_table
from veriloom.shipping import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the base rule and the learned decision list (operator 7)."""
    return quality_rules.keep(docs, quality_rules.learn_from(docs, documents(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated multi-line chunks out of texts (operator 10)."""
    return _counted(line_dedup.remove_repeats(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (operator 2): of one id and text one row."""
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    judged = minhash_dedup.near_duplicates(docs.select(place.alias("place"), "text"), id_col="place")
    name = next(n for n in map("place{}".format, range(len(docs.columns) + 1)) if n not in docs.columns)
    stays = judged.where("kept").groupBy(F.col("place").alias(name)).agg(F.count("*").alias("n"))
    rows = docs.withColumn(name, place)
    once = rows.join(stays.where("n = 1"), name, "left_semi")
    again = rows.join(stays.where("n > 1"), name, "left_semi").dropDuplicates([name])
    return once.union(again).select(*(F.col(f"`{c}`") for c in docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in texts (operator 9)."""
    return _counted(secret_scans.redacted(docs, words=secret_scans.ranked_words(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences (operator 4)."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, where the table has such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near), ("secret scans", secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's tables but its result are dropped when the next one has read it."""
    ship(spark)
    docs, now = documents(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        with scratch(lambda: now):
            after = shared_table(stage(spark, docs, sf_dir))
            before, now = now, [after]
        for table in before:
            drop_table(table)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn, hash and tokenize; the tests hold them against plain versions.
ORACLE_SQL = None
