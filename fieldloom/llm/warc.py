"""WARC archives: writing one record a page, and reading them back by boundary-chain verification.

Reading splits files anywhere. Each occurrence of the record magic is a candidate; its header
gives the offset of its successor. Pointer jumping from the start of each file keeps the
candidates that the chain of successors reaches, so magic inside a payload is no record. A record
with magic inside is put together from its pieces, which a second read finds by their content, so
that it doesn't matter how either read was split.

Limits: the candidates of one file (a few numbers each) meet in one task, so files should not hold
more than some ten million records; write() begins a new file every FILE_RECORDS records.

Cases: null html is an empty payload; a null url is an empty target; a null page_id is written
and read as null; equal rows that share the smallest page_id are all responses; payloads of
under 100 bytes are never revisits; an empty table gives archives without records. A record that
its file ends before is read as not intact; a piece that the second read lacks is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import materialise
from fieldloom.sources.shared import shared_path

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
LEAST_BYTES = 100
#: Records a file, at most.
FILE_RECORDS = 1_000_000
DATE = "2024-01-01T00:00:00Z"


def classify(pages: DataFrame) -> DataFrame:
    """pages to (page_id, url, payload, payload_bytes, payload_digest, refers_to)."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    same = rows.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # Only payloads that occur twice; as a table its size is known, and Spark broadcasts it or not by that.
    same = materialise(same.where("n > 1").select(F.col("payload_digest").alias("same_digest"), "first"), "warc-same")
    joined = rows.join(same, rows.payload_digest == same.same_digest, "left")
    return joined.select(*rows.columns, F.when(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.col("first")).alias("refers_to"))


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write(pages: DataFrame, path: str) -> None:
    """Write classify()'s rows as WARC files, through Spark's own writer, into any store it knows."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise("response")),
        line("WARC-Record-ID", _uri(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(revisit, line("WARC-Refers-To", _uri(F.col("refers_to")))).otherwise(""),
        line("Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    pages.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What lies between one magic and the next: (file, block, seq, value), in order of seq within a block."""
    text = spark.read.schema("value string").option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def _header(name: str) -> Column:
    return F.regexp_extract("header", f"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)


def _candidates(chunks: DataFrame) -> DataFrame:
    """A row for each chunk: its bytes, what its header says, and the digest of its body if that is whole."""
    cut = F.instr("value", END)
    parts = chunks.withColumn("header", F.when(cut > 0, F.concat(F.substring("value", F.lit(1), cut + 1)))).withColumn("nbytes", F.octet_length("value").cast("long"))
    length = F.when(F.col("header").isNotNull(), F.expr("try_cast(nullif(regexp_extract(header, '(?:^|\r\n)Content-Length: ([0-9]+)\r\n', 1), '') AS long)"))
    parts = parts.withColumn("body_bytes", length)
    total = F.octet_length("header") + 2 + F.col("body_bytes") + len(END)
    whole = total == F.col("nbytes")
    body = F.expr("substring(value, length(header) + 3, length(value) - length(header) - 6)")
    return parts.select(
        "file", "block", "seq", "nbytes", F.xxhash64("value").alias("content"), "header", "body_bytes",
        (total + len(MAGIC)).alias("total"), whole.alias("whole"), F.when(whole, F.sha2(body, 256)).alias("digest"),
    )


def _with_offsets(rows: DataFrame) -> DataFrame:
    """Add the offset of each chunk's magic in its file: bytes of earlier blocks, then of earlier chunks."""
    size = F.col("nbytes") + len(MAGIC)
    blocks = rows.groupBy("file", "block").agg(F.sum(size).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum(size).over(within), F.lit(0)))
    # The first chunk of a file lies before its first magic, so what follows is a magic further back.
    return inside.join(blocks, ["file", "block"]).withColumn("off", F.col("base") + F.col("inside") - len(MAGIC)).drop("base", "inside")


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, off, next) to the (file, off) that the chain from offset 0 reaches, by pointer jumping.

    A file's candidates meet in one task as two numbers each; a file of 1 GB has few hundred thousand.
    """
    def jump(found: pd.DataFrame) -> pd.DataFrame:
        off = np.sort(found["off"].to_numpy())
        follow = found.set_index("off")["next"].reindex(off).fillna(-1).to_numpy(np.int64)
        n = len(off)
        at = np.searchsorted(off, follow).clip(max=n - 1)
        to = np.append(np.where(off[at] == follow, at, n), n)  # n: the end, or no record
        seen = np.append(off == 0, False)
        for _ in range(n.bit_length() + 1):
            seen[to[seen]] = True
            to = to[to]
        return pd.DataFrame({"file": found["file"].iloc[0], "off": off[seen[:n]]})

    return candidates.select("file", "off", "next").groupBy("file").applyInPandas(jump, "file string, off long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path: (page_id, payload_bytes, payload_digest, record_type, refers_to, intact)."""
    rows = materialise(_with_offsets(_candidates(_chunks(spark, path))).where("off >= 0"), "warc-candidates")
    chain = reachable(rows.withColumn("next", F.col("off") + F.col("total")))
    starts = materialise(rows.join(chain, ["file", "off"]), "warc-records")
    broken = starts.where("NOT whole").select("file", "off", "total", "header")
    if not broken.isEmpty():  # a payload with magic inside lies in several chunks, which are put together
        starts = starts.where("whole").unionByName(_mended(spark, path, rows, broken, starts.columns))
    number = lambda name: F.expr(f"try_cast(regexp_extract({name}, 'urn:page:(-?[0-9]+)', 1) AS long)")
    parsed = starts.withColumns({"id": _header("WARC-Record-ID"), "ref": _header("WARC-Refers-To"), "type": _header("WARC-Type"), "said": F.substring_index(_header("WARC-Payload-Digest"), ":", -1)})
    revisit = F.col("type") == "revisit"
    return parsed.select(
        number("id").alias("page_id"),
        F.when(revisit, _header("Payload-Length").cast("long")).otherwise(F.col("body_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("said")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, number("ref")).alias("refers_to"),
        F.coalesce(revisit | (F.col("said") == F.col("digest")), F.lit(False)).alias("intact"),
    )


def _mended(spark: SparkSession, path: str, rows: DataFrame, broken: DataFrame, columns: list[str]) -> DataFrame:
    """Records that were cut at magic inside them, from a second read of their pieces only, found by size and hash."""
    first = broken.select(F.col("file").alias("f"), F.col("off").alias("start"), (F.col("off") + F.col("total")).alias("stop"), F.col("header").alias("head"))
    # Ranges of a file don't overlap, so the range a piece lies in is that of the last start at or before it.
    none = [F.lit(None).cast(t).alias(n) for n, t in (("start", "long"), ("stop", "long"), ("head", "string"))]
    marks = rows.select("file", "off", "nbytes", "content", *none)
    order = Window.partitionBy("file").orderBy("off", F.col("start").isNull())
    marks = marks.union(first.select("f", F.col("start").alias("off"), F.lit(None).cast("long"), F.lit(None).cast("long"), "start", "stop", "head"))
    last = marks.withColumns({c: F.last(c, ignorenulls=True).over(order) for c in ("start", "stop", "head")})
    needed = materialise(last.where("nbytes IS NOT NULL AND off >= start AND off < stop").select("file", "off", "nbytes", "content", "start", "head"), "warc-needed")
    wanted = needed.select("nbytes", "content").distinct()
    again = _chunks(spark, path).select(F.octet_length("value").cast("long").alias("nbytes"), F.xxhash64("value").alias("content"), "value")
    found = again.join(wanted, ["nbytes", "content"], "left_semi").groupBy("nbytes", "content").agg(F.first("value").alias("value"))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("off", "value"))), lambda x: x["value"])  # of one record
    joined = F.when(F.count("value") == F.count(F.lit(1)), F.array_join(pieces, MAGIC)).otherwise(F.raise_error(F.lit("an archive changed while it was read")).cast("string"))
    whole = needed.join(found, ["nbytes", "content"], "left").groupBy("file", "start", "head").agg(joined.alias("value"))
    nought = F.lit(0).cast("long")
    return materialise(_candidates(whole.select("file", nought.alias("block"), nought.alias("seq"), "value")).withColumn("off", nought).select(*columns), "warc-mended")


OP3_SQL = """
WITH sized AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
    SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, TRUE AS intact
FROM sized LEFT JOIN firsts USING (payload_digest)
"""


def op3_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = shared_path(spark, "warc")
    write(classify(pages), path)
    return read(spark, path)
