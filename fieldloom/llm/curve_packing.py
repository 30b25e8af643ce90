"""Packing along a space-filling curve: neighbours on the curve fill a sequence, and nothing is padded.

A document's tokens are hashed into a vector, and a fixed random projection takes it to few
dimensions. Its place on the Hilbert curve through these is its key. Keys are range-sorted, the lengths
added up along the curve, and the one long row of tokens this gives is cut at each multiple of
CAPACITY; what is left behind the last is cut at powers of two, whose sequences need no padding either.

Sorted are numbers only; tokens meet their places by one shuffle on the row's number.

Cases: null and empty texts are the end id alone, in the middle of the space; repeated rows, and copies, are
documents each, side by side on the curve; a null doc_id is carried; a key that very many documents share is
split by row number; very long documents run over many sequences; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import materialise
from fieldloom.llm.packing import CAPACITY, default_vocabulary, slices, words_of

END_ID = 1
#: Buckets that tokens are hashed to, dimensions of the curve's space, and bits of each coordinate.
FEATURES, DIMS, BITS = 4096, 4, 15
#: Coordinates of unit vectors under the projection have deviation 1; the space reaches so far on either side.
REACH = 4.0
#: Tokens of output to hold before a batch is sent on.
FLUSH = 1 << 20


@cache
def projection() -> np.ndarray:
    return np.random.default_rng(13).standard_normal((FEATURES, DIMS))


def coordinates(ids: np.ndarray) -> np.ndarray:
    """The document's place in the space: damped counts of hashed tokens, to length 1, projected."""
    bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
    seen = np.log1p(np.bincount(bucket.astype(np.int64), minlength=FEATURES))
    return seen @ projection() / max(1e-12, np.sqrt(seen @ seen))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Rows of whole coordinates of so many bits to their numbers along the Hilbert curve.

    By the transposed form of the number: undo the curve's turns from the highest bit down, then
    Gray-code across the dimensions, and interleave.
    """
    x = [points[:, k].astype(np.int64) for k in range(points.shape[1])]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for k in range(len(x)):
            turned = (x[k] >> b & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros(len(points), np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    number = np.zeros(len(points), np.int64)
    for b in range(bits - 1, -1, -1):
        for one in x:
            number = number << 1 | (one ^ flip) >> b & 1
    return number


def keys(found: np.ndarray) -> np.ndarray:
    """Places in the space to numbers along the curve."""
    steps = np.floor((found / REACH + 1) / 2 * (1 << BITS)).astype(np.int64)
    return hilbert(steps.clip(0, (1 << BITS) - 1))


def tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """documents to (uid, doc_id, key, n, ids), as a table; uid tells rows apart, of repeated documents too."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, uid = words_of(vocabulary), TaskContext.get().partitionId() << 36
        for batch in batches:
            for few in slices(batch):
                ids = list(words.encode(few.column("text"), END_ID))
                place = np.array([coordinates(x[:-1]) for x in ids])
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                columns = [pa.array(np.arange(uid, uid + len(ids))), few.column("doc_id"), pa.array(keys(place)), pa.array(np.diff(ends)), lists]
                uid += len(ids)
                yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "key", "n", "ids"])

    schema = "uid long, doc_id long, key long, n long, ids array<int>"
    return materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema), "curve-tokens")


def places(cut: DataFrame) -> DataFrame:
    """(uid, key, n) to (uid, at): the tokens before each row along the curve."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            upto = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), batch.column("uid"), pa.array(n), pa.array(upto - n)], ["part", "uid", "n", "within"])
            at = int(upto[-1]) if len(n) else at

    ordered = cut.select("uid", "key", "n").repartitionByRange("key", "uid").sortWithinPartitions("key", "uid")
    ordered = materialise(ordered.mapInArrow(add_up, "part int, uid long, n long, within long"), "curve-order")
    sums = ordered.groupBy("part").agg(F.sum("n").alias("sum"))  # a row a partition
    before = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("before"))
    return ordered.join(F.broadcast(before), "part").select("uid", (F.col("before") + F.col("within")).alias("at"))


def sequence_starts(total: int) -> list[int]:
    """Where the sequences behind the last full one start, and where the last of them ends: their lengths are powers of two."""
    starts = [total // CAPACITY * CAPACITY]
    while left := total - starts[-1]:
        starts.append(starts[-1] + (1 << left.bit_length() - 1))
    return starts


def pack_along_curve(docs: DataFrame, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """documents to (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and ids if asked for.

    Sequences are numbered along the curve.
    """
    held = tokens(docs, vocabulary)
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    full, rest = total // CAPACITY, np.array(sequence_starts(total))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + keep_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)

        for batch in batches:
            ids, offsets = batch.column("ids").flatten().to_numpy(), batch.column("ids").offsets.to_numpy()
            offsets = offsets - offsets[0]
            for doc_id, at, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("at").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                end, here = at + b - a, at
                while here < end:
                    if here < full * CAPACITY:
                        number, first = here // CAPACITY, here // CAPACITY * CAPACITY
                        last = first + CAPACITY
                    else:
                        k = int(np.searchsorted(rest, here, "right")) - 1
                        number, first, last = full + k, int(rest[k]), int(rest[k + 1])
                    stop = min(end, last)
                    part = ids[a + here - at : a + stop - at]
                    rows.append((doc_id, here - at, stop - here, zlib.crc32(part.astype("<u4").tobytes()), b - a, number, here - first, *([part.tolist()] if keep_ids else [])))
                    here = stop
                size += b - a
                if size > FLUSH:
                    yield batch_of()
                    rows, size = [], 0
        if rows:
            yield batch_of()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return held.select("uid", "doc_id", "ids").join(places(held), "uid").select("doc_id", "at", "ids").mapInArrow(cut, schema)


def op13_curve_packing(spark, sf_dir: str) -> DataFrame:
    return pack_along_curve(spark.read.parquet(f"{sf_dir}/documents.parquet"))
