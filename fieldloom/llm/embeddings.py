"""Embedding near-dedup: a subspace pigeonhole join of rotated unit vectors.

Two unit vectors of cosine c lie 2 - 2c apart, squared. Cut into blocks of a few dimensions, some
block holds no more than its proportional share of that. Each block is joined by range. Where a label
holds many vectors, a block's space is cut in two along some dimensions, at the label's mean; a
vector lives in one cell and visits the others that its budget reaches. Pairs within a block's budget
are verified over the whole vectors, in double precision, and counted once: the union of all blocks'
candidates where they meet in one task, else the first block that holds them within its budget.

Cases: vectors that are null, zero, or hold null or non-finite components, and those with null
label or vec_id, link with nothing and are kept; vectors of different lengths never link; equal vectors of a label
collapse before anything is compared; rows that repeat a vec_id are vectors of their own; an
empty table has no rows; columns of other names are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import connected_components, materialise, star_edges

COSINE = 0.93
#: Dimensions of a block, and of the wider ones that labels with very many vectors take: the more cuts a block
#: has, the smaller the part of its cells that a budget reaches.
BLOCK_DIMS, WIDE_DIMS = 8, 16
#: Vectors a cell holds at most, about: a label of as many is one cell; the blocks of a larger one are cut along so many
#: dimensions as that takes. Sending a vector to another cell costs as much as over ten thousand comparisons inside one.
CELL = 16_384
#: Cells with more rows than this are compared in pieces, each pair of pieces in a task of its own.
PIECE = 4096
CELL_KEY = ["label", "dims", "width", "block", "cell"]
#: Rows by rows compared at a time, and pairs verified at a time.
TILE, VERIFIED = 1024, 1 << 15
#: What the first look, in single precision, may be wrong by; what rounding in double precision may.
ROUGH, ROUNDING = 8e-6, 1e-9
SLACK = 1e-6


@cache
def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(20240229 + dims).standard_normal((dims, dims)))[0]


def rotate(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return unit @ rotation(vectors.shape[1])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def blocks_of(dims: int, width: int) -> list[slice]:
    return [slice(i, min(i + width, dims)) for i in range(0, dims, width)]


def budget(block: slice, dims: int, cosine: float) -> float:
    """The block's share of the squared distance, by its dimensions."""
    return (2 - 2 * cosine) * (block.stop - block.start) / dims * (1 + SLACK) + 1e-12


def _fixed(vectors: np.ndarray, block: slice) -> np.ndarray:
    """rotate() of some vectors along a block, summed in one fixed order: equal in every task, whatever else it holds."""
    norm, turn = np.zeros(len(vectors)), rotation(vectors.shape[1])
    out = np.zeros((len(vectors), block.stop - block.start))
    for k in range(vectors.shape[1]):
        norm += vectors[:, k] * vectors[:, k]
        out += vectors[:, k, None] * turn[k, block]
    return out / np.sqrt(norm)[:, None]


def within(x: np.ndarray, turned: np.ndarray, p: np.ndarray, q: np.ndarray, block: slice, limit: float) -> np.ndarray:
    """Which pairs lie within the block's limit; every task that has a pair finds the same."""
    square = ((turned[p, block] - turned[q, block]) ** 2).sum(1)
    inside, close = square <= limit, np.abs(square - limit) < ROUNDING
    if close.any():  # rounding might decide, and rounds by what else a task holds
        apart = (_fixed(x[p[close]], block) - _fixed(x[q[close]], block)) ** 2
        inside[close] = sum(apart[:, k] for k in range(apart.shape[1])) <= limit
    return inside


def reached(x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, home, cell) of all cells that lie within the limit of each row; a cell is a bit for the side of each cut at 0.

    How far a cell is adds up over the cuts between, so cells are found cut by cut.
    """
    home = ((x > 0) << np.arange(x.shape[1])).sum(1)
    row, cell, far = np.arange(len(x)), home.copy(), np.zeros(len(x))
    for k in range(x.shape[1]):
        across = far + x[row, k] ** 2
        go = across <= limit
        row, cell, far = np.r_[row, row[go]], np.r_[cell, cell[go] ^ (1 << k)], np.r_[far, across[go]]
    return row, home[row], cell


def _cells(cosine: float):
    """Rows of (label, dims, cid, mult, embedding, cuts, centre) to one for each block and cell that a vector lives in or visits."""
    def run(batches):
        for batch in batches:
            lengths, cuts = batch.column("dims").to_numpy(), batch.column("cuts").to_numpy()
            for dims, k in sorted(set(zip(lengths.tolist(), cuts.tolist(), strict=True))):
                part = batch.filter(pa.array((lengths == dims) & (cuts == k)))
                turned, width = rotate(_matrix(part.column("embedding"))) - _matrix(part.column("centre")), BLOCK_DIMS if k <= BLOCK_DIMS else WIDE_DIMS
                for number, block in enumerate(blocks_of(dims, width)):
                    for i in range(0, part.num_rows, 1000):
                        x = turned[i : i + 1000, block.start : min(block.start + k, block.stop)]
                        row, home, cell = reached(x, budget(block, dims, cosine) + ROUNDING)
                        first = cell >= home  # of two cells that see each other, the first one's vectors visit
                        row, home, cell = row[first], home[first], cell[first]
                        out, n = part.slice(i, 1000).take(pa.array(row)), len(row)
                        yield pa.RecordBatch.from_arrays(
                            [out.column("label"), out.column("dims"), pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, number, np.int32)),
                             pa.array(cell.astype(np.int32)), pa.array(cell == home), out.column("cid"), out.column("mult"), out.column("embedding")],
                            ["label", "dims", "width", "block", "cell", "home", "cid", "mult", "embedding"],
                        )

    return run


def _compare(cosine: float):
    """One cell (or two pieces of it): verified links as counts by vector and a star of edges.

    A cell of block -1 is a whole label, in which all blocks are joined; the union of their
    candidates is verified. In any other cell, candidates of its one block are verified that no
    earlier block holds.
    """
    def run(table: pa.Table) -> pa.Table:
        dims, width, number = (table[c][0].as_py() for c in ("dims", "width", "block"))
        cid, mult = table["cid"].to_numpy(), table["mult"].to_numpy()
        home, side = table["home"].to_numpy(zero_copy_only=False), table["side"].to_numpy()
        x = _matrix(table["embedding"])
        turned, blocks, n = rotate(x), blocks_of(dims, width or BLOCK_DIMS), len(cid)
        limits = [budget(b, dims, cosine) for b in blocks]
        unit = x / np.sqrt((x * x).sum(1, keepdims=True))
        joined = range(len(blocks)) if number < 0 else [number]
        # A row of ends times one of starts is the squared distance along the block.
        starts, ends = {}, {}
        for k in joined:
            mine = turned[:, blocks[k]]
            square, one = (mine * mine).sum(1, keepdims=True), np.ones((n, 1))
            starts[k] = np.concatenate([-2 * mine, square, one], 1).astype(np.float32)
            ends[k] = np.concatenate([mine, one, square], 1).astype(np.float32)
        count, links = np.zeros(n, np.int64), ([], [])

        def verify(p: np.ndarray, q: np.ndarray) -> None:
            if number >= 0:
                for k in range(number + 1):  # pairs within the limit of an earlier block are counted there
                    near = within(x, turned, p, q, blocks[k], limits[k])
                    p, q = (p[near], q[near]) if k == number else (p[~near], q[~near])
            linked = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
            p, q = p[linked], q[linked]
            if len(p):
                count[:] += np.bincount(p, mult[q], n).astype(np.int64) + np.bincount(q, mult[p], n).astype(np.int64)
                links[0].append(cid[p])
                links[1].append(cid[q])
                if len(links[0]) > 16:
                    for k, part in enumerate(star_edges(np.concatenate(links[0]), np.concatenate(links[1]))):
                        links[k][:] = [part]

        def join(left: np.ndarray, right: np.ndarray) -> None:
            """All pairs of two lists of rows; each pair once if they are the same list."""
            for i in range(0, len(left), TILE):
                a = left[i : i + TILE]
                for j in range(i if left is right else 0, len(right), TILE):
                    b = right[j : j + TILE]
                    close = np.zeros((len(a), len(b)), bool)
                    for k in joined:
                        close |= starts[k][a] @ ends[k][b].T <= limits[k] + ROUGH
                    if left is right and i == j:
                        close = np.triu(close, 1)
                    u, v = close.nonzero()
                    for c in range(0, len(u), VERIFIED):
                        verify(a[u[c : c + VERIFIED]], b[v[c : c + VERIFIED]])

        rows = np.arange(n)
        if (side == 2).all():
            here = rows[home]
            join(here, here)
            join(here, rows[~home])
        else:
            join(rows[(side == 0) & home], rows[side == 1])
            join(rows[(side == 0) & ~home], rows[(side == 1) & home])
        node, root = star_edges(np.concatenate(links[0]), np.concatenate(links[1])) if links[0] else (np.array([], np.int64),) * 2
        some = count > 0
        return pa.table({
            "cid": pa.array(np.concatenate([cid[some], node])),
            "n": pa.array(np.concatenate([count[some], np.zeros(len(node), np.int64)])),
            "root": pa.array(np.concatenate([cid[some], root])),
        })

    return run


def _centres(classes: DataFrame) -> DataFrame:
    """(label, dims, centre): the mean of each label's rotated vectors, where its blocks are cut."""
    def sums(batches):
        for batch in batches:
            totals: dict[tuple, list] = {}
            for dims in set(batch.column("dims").to_pylist()):
                part = batch.filter(pa.array(batch.column("dims").to_numpy() == dims))
                turned, labels = rotate(_matrix(part.column("embedding"))), np.array(part.column("label").to_pylist(), object)
                for label in set(labels.tolist()):
                    mine = turned[labels == label]
                    totals[label, dims] = [mine.sum(0), len(mine)]
            rows = [(label, dims, at, s, n) for (label, dims), (total, n) in totals.items() for at, s in enumerate(total.tolist())]
            kinds = [batch.schema.field("label").type, pa.int32(), pa.int32(), pa.float64(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["label", "dims", "at", "s", "n"])

    kind = classes.schema["label"].dataType.simpleString()
    parts = classes.mapInArrow(sums, f"label {kind}, dims int, at int, s double, n long").groupBy("label", "dims", "at").agg((F.sum("s") / F.sum("n")).alias("mean"))
    centre = F.transform(F.sort_array(F.collect_list(F.struct("at", "mean"))), lambda v: v["mean"])  # as many as dimensions
    return parts.groupBy("label", "dims").agg(centre.alias("centre"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Cells in pieces: each unordered pair of them, and each with itself, is a group (i, j)."""
    mine = F.pmod(F.xxhash64("cid"), F.col("pieces")).cast("int")
    dealt = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    dealt = dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other"), "side": side.cast("int")})
    return dealt.select(*CELL_KEY, "i", "j", "home", "side", "cid", "mult", "embedding")


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Distinct vectors (cid, label, dims, mult, embedding) to (cid, n, root): counts of links, and edges with n = 0.

    A label of up to CELL vectors is one cell, and a vector is sent to it once (or once for each
    piece). Larger labels are cut, block by block, and a vector is sent to each cell it reaches.
    """
    by = ["label", "dims"]
    kind, kind_label = (classes.schema[c].dataType.simpleString() for c in ("embedding", "label"))
    pieces = F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")
    sizes = materialise(classes.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "embedding-sizes")
    whole = classes.join(sizes.where(F.col("n") <= CELL).select(*by, pieces), by)
    whole = whole.withColumns({"width": F.lit(0), "block": F.lit(-1), "cell": F.lit(0), "home": F.lit(True)})
    dealt, large = _dealt(whole), sizes.where(F.col("n") > CELL)
    if not large.isEmpty():
        cuts = F.least(F.ceil(F.log2(F.col("n") / CELL)), F.lit(WIDE_DIMS)).cast("int").alias("cuts")
        mine = classes.join(large.select(*by, cuts), by)
        centres = materialise(_centres(mine), "embedding-centres")
        sized = mine.join(centres, by).select(*by, "cid", "mult", "cuts", "centre", "embedding")
        rows = sized.mapInArrow(_cells(cosine), f"label {kind_label}, dims int, width int, block int, cell int, home boolean, cid long, mult long, embedding {kind}")
        held = materialise(rows.groupBy(*CELL_KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIECE).select(*CELL_KEY, pieces), "embedding-cells")
        dealt = dealt.union(_dealt(rows.join(held, CELL_KEY, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))))
    return dealt.groupBy(*CELL_KEY, "i", "j").applyInArrow(_compare(cosine), "cid long, n long, root long")


def near_dups(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, embedding, label) to (vec_id, n_links, component_id, kept)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    alive = F.exists("embedding", lambda x: x != 0) & finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(alive, F.lit(False)).alias("usable"))
    usable = rows.where("usable")
    classes = usable.groupBy("label", "embedding").agg(F.min("vec_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("mult"))
    # Numbers of classes are fixed once the table is written; a repeated vec_id may stand for several classes.
    classes = materialise(classes.withColumns({"cid": F.monotonically_increasing_id(), "dims": F.size("embedding")}), "embedding-classes")
    found = materialise(links(classes.drop("rep"), cosine), "embedding-links")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    info = classes.join(counts, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("group", F.coalesce("component", "cid"))
    names = info.groupBy("group").agg(F.min("rep").alias("comp"))
    info = info.join(names, "group").select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), "comp")
    joined = rows.join(info, F.col("usable") & (rows["label"] == info["_label"]) & (rows["embedding"] == info["_embedding"]), "left")
    component = F.coalesce("comp", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


OP2_SQL = """
WITH RECURSIVE wide AS (
    SELECT row_number() OVER () AS row, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), usable AS (
    SELECT row, vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM wide
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.row AS a, b.row AS b FROM usable a JOIN usable b ON a.label = b.label AND a.row <> b.row AND len(a.v) = len(b.v)
    WHERE CASE WHEN len(a.v) = len(b.v) THEN list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.93 END
), reach AS (
    SELECT row, row AS other FROM wide
    UNION SELECT r.row, l.b FROM reach r JOIN links l ON r.other = l.a
), found AS (
    SELECT r.row, min(w.vec_id) AS component_id FROM reach r JOIN wide w ON w.row = r.other GROUP BY r.row
), counted AS (
    SELECT a AS row, count(*) AS n_links FROM links GROUP BY a
)
SELECT w.vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(w.vec_id = component_id, TRUE) AS kept
FROM wide w JOIN found USING (row) LEFT JOIN counted USING (row)
"""


def op2_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_dups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
