"""Pieces that several corpus operators share: tables in the shared folder, samples, components."""

from __future__ import annotations

from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.shared import shared_path


#: Nodes of more neighbours than LEAST_HUB may count as hubs, up to HUBS of them; bounds what is broadcast.
LEAST_HUB, HUBS = 1000, 50_000


#: Edges that a task makes stars of at a time.
EDGES_HELD = 1 << 19
#: Where materialise() put its tables.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Spark's settings: files of a query's shuffles go as it ends, not whenever the driver collects its garbage; bytes in a batch that goes to Python.
CLEANUP, BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"


def materialise(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    Of what it shuffled nothing is read again once the table is there, so these files go. With a number
    of bytes, batches that go to Python hold about as much, as both sides hold one for each task.
    """
    path = shared_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    settings = {CLEANUP: "true"} | ({BATCH: str(batch)} if batch else {})
    before = {k: conf.get(k, None) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote, once nothing is left to be read from them; others stay as they are."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def hash_below(key: Column, rate: Column | float) -> Column:
    """True for about a rate's share of the keys, the same ones in every run."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < rate * 1_000_000


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace edges by (node, smallest node of its component), without the smallest ones."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(ids))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def _to_lowest(edges: DataFrame, low: DataFrame, limit: int) -> DataFrame:
    """(u, v) edges to (v, w), w being u's lowest neighbour by low (u, w, n).

    Nodes of more than limit neighbours are at most HUBS: those are broadcast, so that the edges of
    a hub stay where they are; the others meet by a shuffle, of which no key has more rows than the limit.
    """
    hubs = F.broadcast(low.where(F.col("n") > limit).select(F.col("u").alias("hub"), F.col("w").alias("hub_w")))
    marked = edges.join(hubs, F.col("u") == F.col("hub"), "left")
    rest = marked.where("hub IS NULL").select("u", "v").join(low.where(F.col("n") <= limit), "u")
    return marked.where("hub IS NOT NULL").select("v", F.col("hub_w").alias("w")).union(rest.select("v", "w"))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v), some at a time, to stars that connect the same nodes."""
    parts, held = [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return star_edges(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    for batch in batches:
        parts.append(tuple(batch.column(k).to_numpy() for k in range(2)))
        held += batch.num_rows
        if held > EDGES_HELD:
            parts = [joined()]
            held = len(parts[0][0])
            if held > EDGES_HELD // 2:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, parts[0])), ["u", "v"])
                parts, held = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, joined())), ["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of longs to (node, component): component is the smallest node that can be reached.

    Alternating large-star and small-star rounds, behind each of which tasks make stars of the edges they
    hold. Neighbourhoods are never collected: each round takes minima by key, which combine before the shuffle, and joins
    them back. Every round is
    a table in the shared folder, deleted once the next one is there; rounds grow with the logarithm
    of the nodes. Edges that one task held at once are done with its stars, and need no round: the driver plans each
    round as a query of a dozen exchanges, so that rounds cost it memory. Nodes without an edge to another node are not in the result.
    """
    def table(df: DataFrame) -> tuple[DataFrame, tuple]:
        out = materialise(df.distinct().mapInArrow(_stars, "u long, v long"), "components")
        mark = out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return out, tuple(mark)

    def whole(stars: DataFrame, n: int) -> bool:
        """One task wrote them, and all at its end: what it sends before is more than half of EDGES_HELD."""
        return n <= EDGES_HELD // 2 and len(stars.inputFiles()) <= 1

    now, mark = table(edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u > v"))
    while not whole(now, mark[0]):
        limit = max(LEAST_HUB, 2 * mark[0] // HUBS)
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("w"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "w").alias("w"), "n")
        large = _to_lowest(both.where("v > u"), low, limit).distinct().toDF("u", "v")
        low = large.groupBy("u").agg(F.min("v").alias("w"), F.count(F.lit(1)).alias("n"))
        small = _to_lowest(large, low, limit).where("v > w").toDF("u", "v").union(low.select("u", "w"))
        before, old = mark, now
        now, mark = table(small)
        discard(old)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
