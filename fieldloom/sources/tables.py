"""Where tables come from and where results go: Parquet folders or files, read with a known schema where it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stream(spark: SparkSession, folder: str, pattern: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """The files of a folder that match, or those of its folders that do, as they arrive.

    The schema is given, as a stream can't look ahead for it. A pattern is used even for one
    name, since Spark takes a plain path of a stream to be a folder.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder.rstrip('/')}/{pattern}")


def save(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)
