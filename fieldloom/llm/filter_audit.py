"""Filter interaction audit: what each of five filters removes, in every order they can be applied in.

The documents are read as a stream of files, all that are there in a few micro-batches. A document's
failures are a mask of bits; counters by source, mask and labels tell all orders of the filters at once.
Whether a text repeats one of a smaller doc_id is known only in the end, so the state of the stream
holds each text's smallest doc_id so far, with what was counted for it: when a smaller one arrives, that is
retracted from its counter and counted again with the repeat's bit. Batches add such changes to the
counters, and their sums are those of the whole table, whatever the order of files.

A state of its own for each text would be a call of Python for each; texts are held by buckets of
their hashes, of about TEXTS each. Before rows are dealt to buckets, each task joins those of a text: what
isn't the task's smallest doc_id of its text repeats another and goes to the counters at once, so that a
text held by a third of the table sends a row a task.

Cases: null texts are empty, and equal to these; null sources are an empty name; rows that share the
smallest doc_id of a text repeat none; rows without a doc_id repeat none and are repeated by none; a
document is good (or toxic) if any row of labels of its doc_id says so; a doc_id of very many rows gets
its labels by broadcast; very long texts are read whole; an empty table has no parts; columns of other
names are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import materialise
from fieldloom.sources.shared import shared_path
from fieldloom.sources.tables import stream

FILTERS = "ABCDE"
#: The bit of the filter for repeated texts.
REPEATED = 16
WORD = r"[^\x20\x09-\x0D]+"
#: Texts that a bucket of the state holds, about.
TEXTS = 256
#: Micro-batches that the files of a folder are read in, about.
BATCHES = 4
#: A doc_id of more rows than this, and than one in so many of the table's, gets its labels by broadcast: those ids are as few.
HOT_ROWS, HOT_IDS = 10_000, 10_000
#: Texts that a task joins at a time.
JOINED = 1 << 18
#: Keeps the stream's state on the executors' disks, without space set aside for each of many small stores; batches commit their changes to the shared folder.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
COUNTER = ["part", "mask", "good", "toxic"]


def failures() -> Column:
    """The bits of the filters that the column text fails by itself: too short, of few distinct words, of many capitals, with signs."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    fails = [F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words), 100 * capitals > 5 * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).cast("int")


def _labels(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic) of the doc_ids that are either."""
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    return materialise(said.where("good OR toxic"), "audit-labels")


def _labelled(rows: DataFrame, docs: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """rows with good and toxic; the doc_ids of very many rows of docs, and rows without one, are no keys of the shuffle."""
    many = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HOT_ROWS, n // HOT_IDS))
    many = materialise(many.select("doc_id"), "audit-hot-ids")
    apart = F.col("doc_id").isNull()
    if not many.isEmpty():
        found = many.join(labels, "doc_id", "left").select(F.col("doc_id").alias("hot_id"), F.col("good").alias("hot_good"), F.col("toxic").alias("hot_toxic"))
        rows = rows.join(F.broadcast(found), F.col("doc_id") == F.col("hot_id"), "left")
        apart = apart | F.col("hot_id").isNotNull()
    else:
        rows = rows.withColumns({"hot_good": F.lit(None).cast("boolean"), "hot_toxic": F.lit(None).cast("boolean")})
    rows = rows.withColumns({"apart": apart, "key": F.when(apart, F.spark_partition_id().cast("long")).otherwise(F.col("doc_id"))})
    named = labels.select(F.lit(False).alias("apart"), F.col("doc_id").alias("key"), "good", "toxic")
    joined = rows.join(named, ["apart", "key"], "left")
    return joined.withColumns({c: F.coalesce(c, f"hot_{c}", F.lit(False)) for c in ("good", "toxic")})


def _join_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents to (bucket, text, id, part, mask, good, toxic, n): those of each text's smallest id, and counts of all others without a text."""
    own = -1 - TaskContext.get().partitionId()  # a bucket without state, for what needs none
    least: dict[bytes, tuple] = {}  # of each text: bucket, id, mask, counts by (part, good, toxic)
    counts: dict[tuple, int] = {}

    def add(to: dict, key: tuple, n: int = 1) -> None:
        to[key] = to.get(key, 0) + n

    def flush() -> pd.DataFrame:
        rows = [(b, t, i, part, mask, good, toxic, n) for t, (b, i, mask, held) in least.items() for (part, good, toxic), n in held.items()]
        rows += [(own, None, 0, *key, n) for key, n in counts.items()]
        least.clear()
        counts.clear()
        return pd.DataFrame(rows, columns=["bucket", "text", "id", *COUNTER, "n"])

    for batch in batches:
        ids = batch["doc_id"].astype("object").where(batch["doc_id"].notna(), None)
        for bucket, text, named, i, part, mask, good, toxic in zip(batch["bucket"], batch["text"], batch["doc_id"].notna(), ids, batch["part"], batch["mask"], batch["good"], batch["toxic"], strict=True):
            if not named:
                add(counts, (part, mask, good, toxic))
                continue
            i, text = int(i), bytes(text)
            seen = least.get(text)
            if seen and i > seen[1]:
                add(counts, (part, mask | REPEATED, good, toxic))
                continue
            if not seen or i < seen[1]:
                for (p, g, t), n in seen[3].items() if seen else ():
                    add(counts, (p, mask | REPEATED, g, t), n)
                seen = least[text] = (bucket, i, mask, {})
            add(seen[3], (part, good, toxic))
        if len(least) > JOINED:
            yield flush()
    yield flush()


STATE = "text array<binary>, id array<long>, part array<string>, good array<boolean>, toxic array<boolean>, n array<long>"


def _count(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A bucket's rows to changes of the counters. State: for each text what is counted as its smallest id's, in rows of equal text and id."""
    changes: dict[tuple, int] = {}
    held: dict[bytes, list] = {}  # text: smallest id, counts by (part, good, toxic)
    if key[0] >= 0 and state.exists:
        for text, i, *counter, n in zip(*state.get, strict=True):
            held.setdefault(bytes(text), [i, {}])[1][tuple(counter)] = n

    def change(part, mask, good, toxic, n) -> None:
        changes[part, mask, good, toxic] = changes.get((part, mask, good, toxic), 0) + n

    for batch in batches:
        for text, i, part, mask, good, toxic, n in zip(*(batch[c].tolist() for c in ("text", "id", *COUNTER, "n")), strict=True):
            if key[0] < 0:
                change(part, mask, good, toxic, n)
                continue
            known = held.get(bytes(text))
            if known and i > known[0]:
                change(part, mask | REPEATED, good, toxic, n)
                continue
            if known and i < known[0]:  # what was counted as the first of its text is a repeat now
                for (p, g, t), before in known[1].items():
                    change(p, mask, g, t, -before)
                    change(p, mask | REPEATED, g, t, before)
            if not known or i < known[0]:
                known = held[bytes(text)] = [i, {}]
            change(part, mask, good, toxic, n)
            known[1][part, good, toxic] = known[1].get((part, good, toxic), 0) + n
    if key[0] >= 0:
        rows = [(text, i, *counter, n) for text, (i, counters) in held.items() for counter, n in counters.items()]
        state.update(tuple(map(list, zip(*rows, strict=True))))
    yield pd.DataFrame([(*k, n) for k, n in changes.items() if n], columns=[*COUNTER, "n"])


def count_masks(spark: SparkSession, folder: str, labels: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """(part, mask, good, toxic, n) of the documents of a folder, by a stream over its files.

    Each batch's changes are a table of their own in the shared folder, written over if the batch is run again.
    """
    docs = spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")
    n = docs.count()
    files_per_batch = files_per_batch or max(1, -(-len(docs.inputFiles()) // BATCHES))
    columns = {"doc_id": "long", "text": "string", "source": "string"}
    arriving = stream(spark, folder, "documents.parque[t]", docs.select(*columns).schema, files_per_batch)
    rows = arriving.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("part"))
    rows = rows.select("doc_id", "part", failures().alias("mask"), F.unhex(F.sha2("text", 256)).alias("text"))
    rows = _labelled(rows, docs.select(F.col("doc_id").cast("long")), _labels(labels), n)
    bucket = F.pmod(F.xxhash64("text"), F.lit(max(1, n // TEXTS)))
    kinds = "part string, mask int, good boolean, toxic boolean, n long"
    joined = rows.select(bucket.alias("bucket"), "text", "doc_id", *COUNTER).mapInPandas(_join_texts, f"bucket long, text binary, id long, {kinds}")
    changes = joined.groupBy("bucket").applyInPandasWithState(_count, kinds, STATE, "append", "NoTimeout")
    at = shared_path(spark, "audit")

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*COUNTER).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{at}/changes/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        run = changes.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    if not n:
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).parquet(f"{at}/changes").groupBy(*COUNTER).agg(F.sum("n").alias("n"))


def interactions(counts: DataFrame) -> DataFrame:
    """Counts by mask to a row for each part, order of the filters and step, zeros included."""
    n, bits = F.col("n"), {f: 1 << k for k, f in enumerate(FILTERS)}
    by_mask = counts.groupBy("part", "mask").agg(F.sum(n).alias("n"), *[F.coalesce(F.sum(F.when(F.col(c), n)), F.lit(0)).alias(c) for c in ("good", "toxic")])
    parts = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    orders = [("".join(p), k + 1, bits[f], sum(bits[x] for x in p[:k])) for p in permutations(FILTERS) for k, f in enumerate(p)]
    names = ["filter_order", "step", "own", "earlier"]
    table = F.from_json(F.lit(json.dumps([dict(zip(names, o, strict=True)) for o in orders])), "array<struct<filter_order: string, step: int, own: int, earlier: int>>")
    rows = parts.select("part", "cells", F.inline(table))

    def total(which, of: str = "n", times=lambda mask: F.lit(1)) -> Column:
        chosen = F.filter("cells", lambda c: which(c["mask"]))
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda all_, c: all_ + c[of] * times(c["mask"]))

    def fails(mask: Column) -> Column:
        return mask.bitwiseAND(F.col("own")) != 0

    def before(mask: Column) -> Column:
        return mask.bitwiseAND(F.col("earlier")) != 0

    def first_in(mask: Column) -> Column:
        """Orders in which the filter comes before all others that a document fails."""
        return (F.lit(120) / F.bit_count(mask)).cast("long")

    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & ~before(m)).alias("kept"),
        total(lambda m: fails(m) & ~before(m)).alias("removed"),
        total(lambda m: fails(m) & before(m)).alias("redundant"),
        total(lambda m: m == F.col("own")).alias("unique_fails"),
        total(lambda m: fails(m) & ~before(m), "good").alias("good_lost"),
        total(lambda m: fails(m) & ~before(m), "toxic").alias("toxic_lost"),
        total(fails, "n", first_in).alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return interactions(count_masks(spark, sf_dir, spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP12_SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), masks AS (
    SELECT doc_id, part,
           (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
           + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
           + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE)::INT AS mask
    FROM docs
), said AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), counts AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM masks LEFT JOIN said USING (doc_id) GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest([a.bit, b.bit, c.bit, d.bit, e.bit]) AS own,
           unnest([0, a.bit, a.bit + b.bit, a.bit + b.bit + c.bit, a.bit + b.bit + c.bit + d.bit]) AS earlier
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
    SELECT part, filter_order, step, own,
           coalesce(sum(n) FILTER (WHERE mask & (own | earlier) = 0), 0) AS kept,
           coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0) AS removed,
           coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier <> 0), 0) AS redundant,
           coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
           coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0) AS toxic_lost
    FROM counts, orders GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM steps
"""
