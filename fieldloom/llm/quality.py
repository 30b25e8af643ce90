"""Quality classifier: a generalised additive model with pairwise interactions, boosted in cycles.

Shallow trees, fitted to one feature after the other (then to one pair after the other), add up
to a lookup table per feature and pair; a score is the sum of the bins that a text falls into.

Cases: null and empty texts are scored as texts without words; without labelled rows every score
is 0.5, with one class alone it is near that class; labels with null quality or doc_id don't train;
repeated rows score alike; of labels that repeat a doc_id the highest counts, and of documents that
repeat one, one; other columns are not read.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import hash_below
from fieldloom.llm.language_id import held_out

#: Labelled documents to learn from, about: drawn by hash of doc_id, whole texts.
TRAIN_DOCS = 12_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, RATE = 80, 0.2
ACCEPT = 0.3

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_STOPS, _MARKS = list(b".,;:'\"?-()"), list(b"!#$%&*+/<=>@[]^_`{|}~\\")
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "stops", "marks", "pipe", "bang", "line_words",
    "words_marked", "distinct", "repeated", "non_ascii", "upper_words", "period_words", "white",
)


def features(text: str | None) -> tuple[float, ...]:
    """Shares and lengths that tell prose from junk, over the whole text."""
    data = (text or "").encode()
    words = data.split()
    n, hist = max(1, len(words)), np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, len(data))
    letters = hist[_UPPER].sum() + hist[_LOWER].sum() + hist[128:].sum()
    return (
        np.log1p(len(data)), np.log1p(len(words)), min(30.0, (size - hist[9:14].sum() - hist[32]) / n),
        hist[_UPPER].sum() / max(1, letters), hist[_DIGIT].sum() / size, hist[_STOPS].sum() / n, hist[_MARKS].sum() / n,
        hist[124] / n, hist[33] / n, np.log1p(len(words) / (hist[10] + 1)),
        hist[_MARKS].sum() / size, len(set(words)) / n, sum(map(eq, words, words[1:])) / n, hist[128:].sum() / size,
        hist[_UPPER].sum() / n, hist[46] / n, (hist[9:14].sum() + hist[32]) / size,
    )


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray | float:
    return g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best place to cut a run of bins in two: (gain, first bin of the right part)."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a * _leaf(a, b) + (g.sum() - a) * _leaf(g.sum() - a, h.sum() - b) - g.sum() * _leaf(g.sum(), h.sum())
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 1)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to three leaves over a feature's bins, as a table."""
    out = np.empty(len(g))
    cut = _cut(g, h)[1]
    parts = [slice(0, cut), slice(cut, len(g))]
    gains = [_cut(g[p], h[p]) for p in parts]
    k = int(gains[1][0] > gains[0][0])
    mid = parts[k].start + gains[k][1]
    for p in (parts[1 - k], slice(parts[k].start, mid), slice(mid, parts[k].stop)):
        out[p] = _leaf(g[p].sum(), h[p].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of four leaves over a pair's grid of bins: the cut along one that is best with one in each half along the other."""
    best, out = -np.inf, np.zeros(g.shape)
    for cut in range(1, len(g)):
        table = np.empty(g.shape)
        for rows in (slice(0, cut), slice(cut, len(g))):
            mid = _cut(g[rows].sum(0), h[rows].sum(0))[1]
            for cols in (slice(0, mid), slice(mid, None)):
                table[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
        if (gain := float((table * g).sum())) > best:
            best, out = gain, table
    return out


class Gam:
    """Bin edges, a table for each feature and one for each pair of features; starts as a constant 0."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n_features = len(FEATURES)
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.array([]) for k in range(n_features)]
        self.coarse = [np.unique(e[:: BINS // PAIR_BINS]) for e in self.edges]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        if 0 < y.sum() < len(y):
            self._fit(x, y)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        bins, f = self._bins(x, self.edges), np.full(len(y), self.base)

        def slopes(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-f))
            return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

        for _ in range(ROUNDS):
            for k, table in enumerate(self.tables):
                if len(table) > 1:
                    step = RATE * _tree(*slopes(bins[k], len(table)))
                    table += step
                    f += step[bins[k]]
        grid, gains = self._bins(x, self.coarse), {}
        for i in range(len(FEATURES)):
            for j in range(i + 1, len(FEATURES)):
                shape = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
                if min(shape) > 1:
                    g, h = (s.reshape(shape) for s in slopes(grid[i] * shape[1] + grid[j], shape[0] * shape[1]))
                    gains[i, j] = float((_pair_tree(g, h) * g).sum())
        chosen = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
        self.pairs = {(i, j): np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for i, j in chosen}
        for _ in range(ROUNDS // 2):
            for (i, j), table in self.pairs.items():
                at = grid[i] * table.shape[1] + grid[j]
                step = RATE * _pair_tree(*(s.reshape(table.shape) for s in slopes(at, table.size)))
                table += step
                f += step.ravel()[at]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        bins, grid = self._bins(x, self.edges), self._bins(x, self.coarse)
        f = self.base + sum(t[b] for t, b in zip(self.tables, bins, strict=True)) + sum(t[grid[i], grid[j]] for (i, j), t in self.pairs.items())
        return 1 / (1 + np.exp(-f))


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([features(x) for x in texts], float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame) -> Gam:
    """Fit to about TRAIN_DOCS labelled documents; only their features come to the driver, a row for each doc_id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rate = min(1.0, TRAIN_DOCS / max(1, usable.count()))
    drawn = usable.where(hash_below(F.col("doc_id"), F.lit(rate)))
    sample = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * TRAIN_DOCS)  # a bound on what is broadcast

    def measure(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": list(_matrix(batch["text"])), "quality": batch["quality"]})

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")
    measured = rows.mapInPandas(measure, "doc_id long, x array<double>, quality int")
    found = measured.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("one")).select("doc_id", "one.*").toPandas().sort_values("doc_id")  # one of repeated rows
    return Gam(np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES)), (found["quality"].to_numpy() > 0).astype(float))


def scored(docs: DataFrame, model: Gam, name: str = "score") -> DataFrame:
    """docs with the score of each whole text under the given name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of bins, however large the corpus

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(_matrix(texts)))

    return docs.withColumn(name, F.pandas_udf(run, "double")("text"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of ACCEPT or more, with their own columns."""
    found = scored(docs.select(F.struct("*").alias("row"), "text"), train(docs, labels))
    return found.where(F.col("score") >= ACCEPT).select("row.*")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs.select("doc_id", "text"), train(docs, labels.where(~held_out(5, 0))))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
