"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents, whatever these are.

Cases: texts that are null, empty or without a letter go at the latest with the language stage; a
null lang or source is kept (null sources are mixed as a source of their own); rows without a doc_id, or
with a repeated one, are documents of their own, told apart by their texts; of rows equal in everything
one stays; copies are not told from their first, but by doc_id; very long texts are read to their
end; an empty table, and one without labels of quality (which all score 0.5), goes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import language_id, mixing, packing, quality, simhash
from fieldloom.llm.common import discard, materialise
from fieldloom.sources.package import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality model scores below quality.ACCEPT."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those about as near to a second language."""
    return language_id.keep_known(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that share about 0.8 of their 5-word shingles, that of the smallest doc_id."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their target weights."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts and packs into sequences; returns their pieces."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_dup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL: the models, the token ids and the packing have none.
ORACLE_SQL = None


#: Rows that go to Python at a time: whole texts are held on both sides, once for each task of an executor.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    before_run = spark.conf.get(BATCH[0])
    spark.conf.set(*BATCH)
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES[:-1]:
            before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            discard(before)  # a table of an earlier stage; the documents themselves stay
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.set(BATCH[0], before_run)
