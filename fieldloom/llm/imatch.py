"""Document fingerprints by I-Match over randomised subsets of a lexicon.

The lexicon holds the terms whose inverse document frequency lies in a band. For each of several
random subsets of it, a document's distinct terms in the subset are sorted (by their hashes) and hashed. Subsets
come in sizes that go on halving until one holds none of a document's terms, so that short and
long documents alike have some that hold few of them.

The same parts are kept of all the document's terms, for texts of which the lexicon holds little:
terms of a text that fills much of the table are too common for it. Two texts are always compared
by the same kind of parts; where either has little in the lexicon, all terms count accordingly.

Cases: null and empty texts have the fingerprint of no terms; a text without a term in the lexicon
is compared over all its terms; equal texts have equal fingerprints; rows with equal doc_id follow
by a hash of the text; rows with null doc_id come first, and the last row's next is the first that has
one (the first of all if none has); a table of one row is its own next document; other columns are not read. A
doc_id of very many rows, and the rows without one, are dealt to several tasks by that hash, and equal rows
of a batch go as one with their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The band: terms in at least 1 of 10,000 documents and at most 1 of 20. The rarest bound the lexicon: it holds
#: at most a document's mean number of distinct terms, times 10,000, whatever the corpus (8 bytes each).
RAREST, COMMONEST = 1e-4, 0.05
#: Subsets of one size, and sizes at least: each half as large as the one before, the first an eighth of the lexicon.
CELLS, LEVELS = 8, 8
#: Sizes at most, as 32 bits of a term's hash choose its subset; the last holds one term in 2 ** 32 a subset.
DEEPEST = 30
#: Levels of which more cells than this hold terms say little about texts that are partly alike.
CROWDED = 6
#: The share of a text's terms in the lexicon from which on the lexicon alone counts, and the steps of its weight below.
ENOUGH, STEPS = 0.25, 255
#: Terms to count before a batch of counts is sent on; characters of text, and texts, to hold before one of results is; rows in such a batch.
COUNTED, FLUSH, TEXTS, ROWS = 1 << 22, 1 << 20, 1 << 10, 1 << 12
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def word_hashes(words: Iterable[str]) -> np.ndarray:
    """The hashes of 64 bits of the words, as they come."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64)


def edited_hashes(text: str, mine: np.ndarray, after: str, its: np.ndarray) -> tuple[str, np.ndarray]:
    """The edited text and the hashes of its words, in any order: those of both texts' words, but for the words at the cuts."""
    half = len(text) // 2
    head, tail = text[: len(text) - half], after[:half]
    one, two = head.split(), tail.split()
    if one and two and not head[-1].isspace() and not tail[0].isspace():
        cut = [one[-1] + two[0], *two[1:][-1:]]
    else:
        cut = [*one[-1:], *two[:1], *two[-1:]]
    hashes = mine[: max(0, len(one) - 1)], its[1 : max(1, len(two) - 1)], word_hashes(x.lower() for x in cut)
    return head + tail, np.concatenate(hashes)


class Lexicon:
    """The hashes of 64 bits of the terms in the band, in order; all terms if none are given."""

    def __init__(self, terms: np.ndarray | None = None):
        self.terms = terms

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        if self.terms is None or not len(self.terms):
            return np.full(len(hashes), self.terms is None)
        return self.terms[np.searchsorted(self.terms, hashes).clip(max=len(self.terms) - 1)] == hashes


def _parts(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes, in order by the number of their text (of n), to a hash of 24 bits for each text, level and cell, -1 where it holds no term.

    Levels without any behind the first LEVELS are left out.
    """
    key = hashes >> np.uint64(32)
    group = text * CELLS + (key & np.uint64(CELLS - 1)).astype(np.int64)
    # Of the cells of a level only the first CELLS are subsets in use, so a term is held up to the level of its lowest bit above the cell's.
    above = key // np.uint64(CELLS)
    depth = np.bitwise_count(~above & (above - np.uint64(1)))
    order = np.argsort(group.astype(np.min_scalar_type(max(1, n * CELLS))), kind="stable")
    hashes, group, depth = hashes[order], group[order], depth[order]
    digest, levels = xxhash.xxh32_intdigest, []
    while len(levels) < DEEPEST and len(hashes):
        data, level = hashes.tobytes(), len(levels)
        first = np.nonzero(np.r_[True, group[1:] != group[:-1]])[0]
        cut = (8 * np.r_[first, len(hashes)]).tolist()
        found = np.full(n * CELLS, -1, np.int32)
        found[group[first]] = np.fromiter((digest(data[a:b], level) for a, b in zip(cut, cut[1:])), np.uint32, len(first)) >> 8
        levels.append(found.reshape(n, CELLS))
        held = depth > level
        hashes, group, depth = hashes[held], group[held], depth[held]
    levels += [np.full((n, CELLS), -1, np.int32)] * (LEVELS - len(levels))
    return np.stack(levels, 1)


class Prints(NamedTuple):
    """Fingerprints of some texts: parts of the terms in the lexicon, the lexicon's weights, parts of all terms."""

    inside: np.ndarray
    weight: np.ndarray
    every: np.ndarray

    @classmethod
    def of(cls, words: list[np.ndarray], lexicon: Lexicon) -> Prints:
        """words: the hashes of each text's words."""
        n, ends = len(words), np.cumsum([len(x) for x in words])
        hashes = np.concatenate([np.zeros(0, np.uint64), *words])
        for a, b in zip([0, *ends.tolist()], ends.tolist()):
            hashes[a:b].sort()
        text = np.repeat(np.arange(n), [len(x) for x in words])
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])][: len(hashes)]
        hashes, text = hashes[new], text[new]
        held = lexicon.holds(hashes)
        some, terms = np.bincount(text[held], minlength=n), np.bincount(text, minlength=n)
        weight = np.where(terms > 0, np.minimum(STEPS, STEPS * some / np.maximum(terms, 1) / ENOUGH), STEPS).astype(np.int64)
        return cls(_parts(hashes[held], text[held], n), weight, _parts(hashes, text, n))

    def take(self, at: np.ndarray) -> Prints:
        return Prints(*(x[at] for x in self))

    def strings(self) -> pa.StringArray:
        """The parts in hex, "-" for none, with "/" and the weight in hex between the two kinds."""
        kinds = []
        for parts in (self.inside, self.every):
            n, levels = parts.shape[:2]
            used = (parts >= 0).any(2)
            mine = np.maximum(LEVELS, (used * np.arange(1, levels + 1)).max(1))
            parts = parts.reshape(n, -1, 1)
            digits = np.where(parts >= 0, _HEX[parts >> np.arange(20, -4, -4) & 15], ord("-")).astype(np.uint8)
            kept = (parts >= 0) | (np.arange(6) == 0)
            kinds.append((digits.reshape(n, -1), (kept & (np.arange(levels * CELLS) < mine[:, None] * CELLS)[:, :, None]).reshape(n, -1)))
        weight = np.stack([np.full(len(self.weight), ord("/"), np.uint8), _HEX[self.weight >> 4], _HEX[self.weight & 15]], 1)
        kinds.insert(1, (weight, np.ones(weight.shape, bool)))
        kept = np.concatenate([k for _, k in kinds], 1)
        offsets = np.r_[0, np.cumsum(kept.sum(1))].astype(np.int32)
        return pa.StringArray.from_buffers(len(kept), pa.py_buffer(offsets), pa.py_buffer(np.concatenate([d for d, _ in kinds], 1)[kept]))


def fingerprint(text: str, lexicon: Lexicon) -> list[str]:
    """The parts of the text's terms in the lexicon, "/" and the lexicon's weight in hex, the parts of all terms."""
    return re.findall("/..|-|.{6}", Prints.of([word_hashes(text.lower().split())], lexicon).strings()[0].as_py())


def _read(parts: list[str]) -> Prints:
    at = next((k for k in range(0, len(parts), CELLS) if parts[k][0] == "/"), None)
    inside, weight, every = (parts, STEPS, parts) if at is None else (parts[:at], int(parts[at][1:], 16), parts[at + 1 :])
    return Prints(*(np.array([-1 if x == "-" else int(x, 16) for x in kind], np.int32).reshape(1, -1, CELLS) if kind is not weight else np.array([weight]) for kind in (inside, weight, every)))


def likeness(a: list[str], b: list[str]) -> float:
    """See likenesses()."""
    return float(likenesses(_read(a), _read(b))[0])


def likenesses(a: Prints, b: Prints) -> np.ndarray:
    """The likeness of each two by the lexicon's parts; so far as it holds too little of either text, by those of all terms."""
    weight = np.minimum(a.weight, b.weight) / STEPS
    return np.where(weight > 0, weight * _alike(a.inside, b.inside), 0) + np.where(weight < 1, (1 - weight) * _alike(a.every, b.every), 0)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal parts among those that either has, over the levels that aren't crowded; 1 if neither has any."""
    levels = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, levels - x.shape[1]), (0, 0)), constant_values=-1) for x in (a, b))
    some = (a >= 0) | (b >= 0)
    n, same = some.sum(2), (some & (a == b)).sum(2)
    equal, either = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k in range(levels - 1, -1, -1):  # a level holds the terms of all deeper ones
        counts = (n[:, k] <= CROWDED) | (either == 0)  # the deepest with terms counts in any case
        equal, either = equal + counts * same[:, k], either + counts * n[:, k]
    return np.where(either > 0, equal / np.maximum(either, 1), 1.0)


def lexicon(docs: DataFrame) -> Lexicon:
    """The terms whose document frequency, counted over all documents, lies in the band."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counts() -> pa.RecordBatch:
            terms, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(times)], ["term", "n"])

        for batch in batches:
            for text in pc.fill_null(batch.column("text"), "").to_pylist():
                held.append(word_hashes(set(text.lower().split())))
                n += len(held[-1])
                if n > COUNTED:
                    yield counts()
                    held, n = [], 0
        if n:
            yield counts()

    n = docs.count()
    counts = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = counts.where((F.col("n") >= RAREST * n) & (F.col("n") <= max(1, COMMONEST * n))).select("term").toArrow()
    return Lexicon(np.sort(kept["term"].to_numpy().view(np.uint64)))


class Ranges:
    """Which part a row belongs to: parts are ranges of (doc_id is null first, doc_id, hash of the text).

    cuts are doc_ids between parts, in order; a doc_id that is m cuts fills as many parts of its own, by even
    ranges of the hash, and so do the rows without a doc_id.
    """

    def __init__(self, cuts: np.ndarray, unnamed: int):
        self.cuts, self.unnamed = cuts, unnamed
        self.hot = bool(unnamed) or len(np.unique(cuts)) < len(cuts)

    def part(self, named: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """hashes: 0 to 2 ** 63 - 1; not looked at where nothing is hot."""
        low, high = np.searchsorted(self.cuts, ids, "left"), np.searchsorted(self.cuts, ids, "right")
        share = hashes / 2.0**63
        own = np.where(high > low, low + 1 + np.minimum(share * (high - low), high - low - 1).astype(np.int64), low)
        return np.where(named, self.unnamed + own, np.minimum(share * self.unnamed, self.unnamed - 1).astype(np.int64)).astype(np.int32)


def _rows(docs: DataFrame, hashed: bool = True) -> DataFrame:
    """(named, id, hash, text) without nulls."""
    text = F.coalesce("text", F.lit(""))
    order = F.shiftrightunsigned(F.xxhash64(text), 1) if hashed else F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("id"), order.alias("hash"), text.alias("text"))
    return rows if hashed else rows.drop("text")


def _dealt(docs: DataFrame) -> DataFrame:
    """(part, guest, named, id, hash, text, n) in order, n equal rows as one: each part ends with the next part's first row as a guest."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    known = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    cuts = docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts) or []
    ranges = Ranges(np.array([min(max(int(c), least), most) for c in cuts], np.int64), -(-(known[0] - known[1]) * parts // max(1, known[0])))

    def place(named: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(ranges.part(named.to_numpy(bool), ids.to_numpy(np.int64), hashes.to_numpy(np.int64)))

    placed = _rows(docs, ranges.hot).withColumn("part", F.pandas_udf(place, "int")("named", "id", "hash"))
    found = placed.groupBy("part").agg(F.min(F.struct("named", "id", "hash")).alias("first")).collect()  # a row a part
    firsts = sorted((r["part"], tuple(r["first"])) for r in found)
    guests: dict[tuple, list[int]] = {}  # the first row of a part is a guest of the part before; the first of all with a doc_id is one of the last part
    for (before, _), (_, first) in zip(firsts, firsts[1:]):
        guests.setdefault(first, []).append(before)
    if firsts:
        guests.setdefault(next((first for _, first in firsts if first[0]), firsts[0][1]), []).append(firsts[-1][0])
    ids_of_guests = np.array(sorted({i for _, i, _ in guests}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("named", "id", "hash"))
            order = np.lexsort((hashes, ids, named))
            new = np.r_[True, (np.diff(named[order].astype(np.int8)) != 0) | (np.diff(ids[order]) != 0) | (np.diff(hashes[order]) != 0)][: len(order)]
            at, n = order[new], np.diff(np.r_[np.nonzero(new)[0], len(order)])
            named, ids, hashes = named[at], ids[at], hashes[at]
            part, row, guest = ranges.part(named, ids, hashes), np.arange(len(at)), np.zeros(len(at), np.int32)
            for k in np.nonzero(np.isin(ids, ids_of_guests))[0].tolist():
                for to in guests.get((bool(named[k]), int(ids[k]), int(hashes[k]) if ranges.hot else 0), ()):
                    part, row, guest = np.append(part, np.int32(to)), np.append(row, k), np.append(guest, np.int32(1))
            columns = [pa.array(part), pa.array(guest), *(pa.array(x[row]) for x in (named, ids, hashes)), batch.column("text").take(pa.array(at[row])), pa.array(n[row])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "guest", "named", "id", "hash", "text", "n"])

    schema = "part int, guest int, named boolean, id long, hash long, text string, n long"
    rows = _rows(docs).mapInArrow(deal, schema)
    return rows.repartitionById(ranges.unnamed + len(ranges.cuts) + 1, F.col("part")).sortWithinPartitions("part", "guest", "named", "id", "hash", "text")


@dataclass
class Row:
    """Equal rows, n of them; words: the hashes of their text's words, once they are needed."""

    key: tuple
    guest: bool
    doc_id: int | None
    text: str
    n: int
    words: np.ndarray | None = None


def fingerprints(docs: DataFrame) -> DataFrame:
    """documents to (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon(docs))  # see RAREST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[Row] = []  # in order; each one's next follows it, but for guests, which end a part

        def results() -> Iterator[pa.RecordBatch]:
            """Of all rows that wait but the last one."""
            for row in waiting:
                if row.words is None:
                    row.words = word_hashes(row.text.lower().split())
            own = [k for k, row in enumerate(waiting[:-1]) if not row.guest]
            pairs = [(k, k) for k in own if waiting[k].n > 1] + [(k, k + 1) for k in own]  # of equal rows all but the last are followed by one
            if not pairs:
                return
            times = [waiting[i].n - 1 if i == j else 1 for i, j in pairs]
            one, two = np.array(pairs).T
            edits = [edited_hashes(waiting[i].text, waiting[i].words, waiting[j].text, waiting[j].words) for i, j in pairs]
            prints = Prints.of([row.words for row in waiting] + [words for _, words in edits], shared.value)
            mine, changed = prints.take(one), prints.take(np.arange(len(waiting), len(waiting) + len(pairs)))
            columns = {
                "doc_id": pa.array([waiting[i].doc_id for i in one], pa.int64()),
                "n_chars": pa.array([len(waiting[i].text) for i in one], pa.int64()),
                "edited_sha256": pa.array([sha256(text.encode()).hexdigest() for text, _ in edits], pa.string()),
                "fingerprint": mine.strings(),
                "edited_fingerprint": changed.strings(),
                "near_edited": pa.array(likenesses(mine, changed)),
                "near_next": pa.array(likenesses(mine, prints.take(two))),
            }
            found, starts = pa.RecordBatch.from_pydict(columns), np.r_[0, np.cumsum(times)]
            for i in range(0, int(starts[-1]), ROWS):  # equal rows may be very many
                yield found.take(pa.array(np.searchsorted(starts, np.arange(i, min(i + ROWS, int(starts[-1]))), "right") - 1))

        held = 0
        for batch in batches:
            for part, guest, named, i, digest, text, n in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                last, key = waiting[-1] if waiting else None, (part, named, i, digest, text)
                if last and last.key == key and not guest and not last.guest:
                    last.n += n
                    continue
                if held > FLUSH or len(waiting) > TEXTS:
                    yield from results()
                    waiting, held = waiting[-1:], 0
                waiting.append(Row(key, bool(guest), i if named else None, text, n))
                held += len(text)
        if waiting:
            yield from results()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _dealt(docs).mapInArrow(run, schema)


def op7_imatch(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
