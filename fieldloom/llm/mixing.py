"""Mixing sources to target weights: repeat documents so that each source's words come near its share.

Cases: a null text has no words; a null source is a source of its own, sorted last; rows that
repeat a doc_id draw by their texts, and alike if these are equal too; an empty table gives an empty mix; sources without words get target 0.
Columns of other names, whatever they are, are carried by mix() and not read otherwise. Sources are
ranked in one task, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: The mix asks for this part of all words, and of a source at most so many times its own.
SHARE, MOST = 1.5, 2
#: Draws are told apart to 1 in so many, per source.
BINS = 4096
#: Source tables up to so many rows are broadcast; longer ones are joined by shuffling.
BROADCAST_ROWS = 100_000


def size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def draw() -> Column:
    """The document's draw, seeded by a hash of doc_id and text: one of BINS equal parts of the unit interval."""
    seed = F.md5(F.concat(F.lit("mix-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("-"), F.md5(F.coalesce("text", F.lit("")))).cast("binary"))
    return (F.conv(F.substring(seed, 1, 8), 16, 10).cast("long") % BINS).cast("int")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight, levelled at MOST times the size.

    In order of size by weight, a source is levelled off if what is left, shared by the weights that
    are left, gives it more than it can take. The window runs over one row per source.
    """
    by_name, by_cap, all_ = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "rank"), Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sources.withColumn("rank", F.row_number().over(by_name))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") - 1) % len(WEIGHTS) + 1).cast("double"))
    left = (
        weighed.withColumn("ratio", F.col("source_size") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(all_) * SHARE - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("over", MOST * F.col("source_size") * F.col("weights") <= F.col("weight") * F.col("left"))
    )
    level = F.min(F.when(~F.col("over"), F.struct("ratio", "rank", "left", "weights"))).over(all_)
    free = (F.col("level").isNotNull()) & (F.struct("ratio", "rank") >= F.struct("level.ratio", "level.rank"))
    return left.withColumn("level", level).select(
        "source", "source_size",
        F.when(free, F.col("weight") * F.col("level.left") / F.col("level.weights")).otherwise(MOST * F.col("source_size").cast("double")).alias("target"),
    )


def shares(sized: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw) to (source, source_size, target, base, below).

    A document is taken base = floor(target / source_size) times, and once more if its draw is
    below the threshold. That threshold is the fraction of the rate, moved to where the words
    drawn, counted over all documents by draw, lie nearest to the fraction of the source's words.
    """
    drawn = sized.groupBy("source", "draw").agg(F.sum("size").alias("words"))
    drawn = materialise(drawn, "mix-draws")  # at most BINS rows a source, whatever it holds
    goal = targets(drawn.groupBy("source").agg(F.sum("words").alias("source_size")))
    goal = goal.withColumn("base", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("long"))
    named = goal.withColumnRenamed("source", "name")
    upto = Window.partitionBy("source").orderBy("draw")
    cuts = drawn.select("source", (F.col("draw") + 1).alias("draw"), "words").union(
        goal.select("source", F.lit(0).alias("draw"), F.lit(0).cast("long").alias("words"))
    )
    cuts = cuts.withColumn("words", F.sum("words").over(upto)).join(named, F.col("source").eqNullSafe(F.col("name")))
    miss = F.abs(F.col("words") - (F.col("target") - F.col("base") * F.col("source_size")))
    below = cuts.groupBy("source", "source_size", "target", "base").agg(F.min(F.struct(miss.alias("miss"), "draw")).alias("best"))
    return below.select("source", "source_size", "target", "base", F.col("best.draw").alias("below"))


def _with_shares(docs: DataFrame, sized: DataFrame) -> DataFrame:
    """docs (with source, and no column of a share's) and their source's share."""
    share = materialise(shares(sized).withColumnRenamed("source", "name"), "mix-shares")
    share = F.broadcast(share) if share.count() <= BROADCAST_ROWS else share
    return docs.join(share, F.col("source").eqNullSafe(F.col("name")), "left").withColumn("copies", F.col("base") + (F.col("draw") < F.col("below")).cast("long"))


def mix_report(docs: DataFrame) -> DataFrame:
    """documents to (doc_id, size, source_size, target, taken, base, fraction, threshold).

    Each document is taken base times, and once more if its draw is below the threshold, which is the fraction or near it.
    """
    sized = materialise(docs.select("doc_id", "source", size().alias("size"), draw().alias("draw")), "mix-sizes")
    fraction = (F.col("target") - F.col("base") * F.col("source_size")) / F.nullif("source_size", F.lit(0))
    return _with_shares(sized, sized).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "base", fraction.alias("fraction"), (F.col("below") / BINS).alias("threshold")
    )


def mix(docs: DataFrame) -> DataFrame:
    """documents, each as often as the mix takes it. Texts are not shuffled."""
    sized = docs.select("doc_id", "source", size().alias("size"), draw().alias("draw"))
    rows = _with_shares(docs.select(F.struct("*").alias("row"), "source", draw().alias("draw")), sized)
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           (('0x' || substr(md5('mix-' || coalesce(doc_id::VARCHAR, '') || '-' || md5(coalesce(text, ''))), 1, 8))::BIGINT % 4096)::INT AS draw
    FROM documents
), ranked AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sized GROUP BY source
), weighed AS (
    SELECT *, ([3, 1, 2])[(rank - 1) % 3 + 1]::DOUBLE AS weight FROM ranked
), lefts AS (
    SELECT *, source_size / weight AS ratio,
           sum(source_size) OVER () * 1.5::DOUBLE - 2 * coalesce(sum(source_size) OVER before, 0) AS lft,
           sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights
    FROM weighed WINDOW before AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
    SELECT ratio, rank, lft, weights FROM lefts WHERE 2 * source_size * weights > weight * lft ORDER BY ratio, rank LIMIT 1
), goals AS (
    SELECT l.source, l.source_size,
           CASE WHEN v.rank IS NOT NULL AND (l.ratio > v.ratio OR l.ratio = v.ratio AND l.rank >= v.rank)
                THEN l.weight * v.lft / v.weights ELSE 2 * l.source_size::DOUBLE END AS target
    FROM lefts l LEFT JOIN level v ON true
), based AS (
    SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS base FROM goals
), cuts AS (
    SELECT source, draw + 1 AS draw, sum(size) AS words FROM sized GROUP BY ALL
    UNION ALL SELECT source, 0, 0 FROM based
), summed AS (
    SELECT c.source, c.draw, sum(words) OVER (PARTITION BY c.source ORDER BY c.draw) AS words FROM cuts c
), shares AS (
    SELECT b.source, b.source_size, b.target, b.base,
           arg_min(s.draw, (abs(s.words - (b.target - b.base * b.source_size)), s.draw)) AS below
    FROM summed s JOIN based b ON s.source IS NOT DISTINCT FROM b.source GROUP BY ALL
)
SELECT d.doc_id, d.size, s.source_size, s.target, (s.base + (d.draw < s.below)::BIGINT) * d.size AS taken,
       s.base, (s.target - s.base * s.source_size) / nullif(s.source_size, 0) AS fraction, s.below / 4096 AS threshold
FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source
"""
