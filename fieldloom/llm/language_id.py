"""Language ID by error-correcting output codes over character n-grams.

Each bit of the languages' codewords has a binary n-gram classifier; decoding takes the
codeword whose bits lose least, a bit's loss being weighted by the evidence for it.

Cases: a null text and one without letters are `und` with score 0, as is everything when no
row is labelled; rows with null lang don't train; one language alone has score 1; a null doc_id
counts as an empty one; repeated rows are predicted alike; other columns are not read. Labels of less than
one in 100,000 labelled documents are not learned (RAREST), so there are at most as many; codewords grow with their
logarithm, and weights are added up a block of languages at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import hash_below, materialise

#: n-grams of 2 and 3 characters are hashed to so many features; bounds the model, whatever the corpus.
FEATURES = 1 << 15
#: The least share of the labelled documents that a label to learn is on; bounds the model where labels are dirty.
RAREST = 1e-5
#: Languages whose counts are held at a time.
BLOCK_LANGUAGES = 128
#: Labelled documents a language to learn from, about: drawn by hash of doc_id, whole texts.
TRAIN_DOCS = 1500
#: Characters looked at a time.
BLOCK = 1 << 20
#: n-grams beyond which more text adds no evidence.
EVIDENCE = 48
AMBIGUOUS = 0.5


@cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of the text's n-grams, a block of characters at a time; runs of other characters, and either end, count as one space."""
    text, seen = text.lower(), np.array([32], np.uint32)
    for i in range(0, len(text), BLOCK):
        points = np.frombuffer(text[i : i + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters()[points]
        points = np.where(letter, points, np.uint32(32))[letter | np.r_[seen[-1] != 32, letter[:-1]]]
        if i + BLOCK >= len(text) and (points[-1] if len(points) else seen[-1]) != 32:
            points = np.append(points, np.uint32(32))
        both = np.concatenate([seen, points])
        two = both[:-1] * np.uint32(0x9E3779B1) + both[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0x27D4EB2F) + both[2:] * np.uint32(0xC2B2AE35)
        yield np.concatenate([two[len(seen) - 1 :], three]) >> np.uint32(17)
        seen = both[-2:]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(modulus: int, remainder: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n distinct rows of bits, far apart: all splits in two for up to 5 languages, else the best of random drafts (fewer for very many languages, which are far apart by their length)."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 5:
        splits = [[(s >> k) & 1 for k in range(n)] for s in range(1, 1 << (n - 1))]
        return np.array(splits, np.int8).reshape(-1, n).T
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(max(2, min(200, 20_000_000 // n**2))):
        draft = rng.integers(0, 2, (n, math.ceil(10 * math.log2(n)))).astype(np.int8)
        draft = draft[:, (draft.min(0) == 0) & (draft.max(0) == 1)]
        apart = _least_distance(draft)
        if apart > most:
            best, most = draft, apart
    return best


def _least_distance(code: np.ndarray) -> int:
    """Of any two rows, a block of rows at a time."""
    signs, least = 2 * code.astype(np.float32) - 1, code.shape[1]
    for i in range(0, len(code), 1000):
        apart = (code.shape[1] - signs[i : i + 1000] @ signs.T) / 2
        apart[np.arange(len(apart)), np.arange(i, i + len(apart))] = np.inf
        least = min(least, int(apart.min()))
    return least


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[str, np.ndarray] = {}

    def counted() -> Iterator[pd.DataFrame]:
        for lang, counts in totals.items():
            at = counts.nonzero()[0]
            yield pd.DataFrame({"lang": lang, "feature": at.astype(np.int32), "n": counts[at]})

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            if lang not in totals and len(totals) >= BLOCK_LANGUAGES:
                yield from counted()
                totals.clear()
            mine = totals.setdefault(lang, np.zeros(FEATURES, np.int64))
            for grams in ngrams(text):
                mine += np.bincount(grams, minlength=FEATURES)
    yield from counted()


class Model:
    """languages, their codewords (languages x bits) and the bits' n-gram weights (FEATURES x bits)."""

    def __init__(self, languages: list[str], blocks: Iterable[np.ndarray]):
        """blocks: counts (languages x FEATURES) of the languages in order, some of them at a time."""
        self.languages, self.code = languages, codewords(len(languages))
        ones, all_, at = np.zeros((FEATURES, self.code.shape[1])), np.zeros(FEATURES), 0
        for counts in blocks:
            share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)  # each language weighs the same
            ones += share.T @ self.code[at : at + len(share)]
            all_ += share.sum(0)
            at += len(share)
        with_one = self.code.sum(0)
        zeros = all_[:, None] - ones
        self.weights = np.log((ones / np.maximum(1, with_one)) / (zeros / np.maximum(1, len(languages) - with_one))).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, the score of its codeword among all, and whether another one is about as near."""
        if not self.languages or text is None or not has_letter(text):
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        total, n = np.zeros(self.weights.shape[1]), 0
        for grams in ngrams(text):
            total += self.weights[grams].sum(0, dtype=np.float64)
            n += len(grams)
        evidence = total / max(1, n) * min(n, EVIDENCE)
        # A bit that is 1 loses log(1 + exp(-evidence)), one that is 0 as much more as the evidence.
        loss = np.logaddexp(0, evidence).sum() - self.code @ evidence
        odds = np.exp(loss.min() - loss)
        best = int(loss.argmin())
        score = float(odds[best] / odds.sum())
        return self.languages[best], score, score < AMBIGUOUS


def train(docs: DataFrame) -> Model:
    """Learn from labelled documents: a sample of about TRAIN_DOCS a language, counted where the texts are."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = materialise(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    least = RAREST * (sizes.agg(F.sum("n")).first()[0] or 0)
    learned = sizes.where(F.col("n") >= least)  # at most 1 / RAREST rows
    rates = F.broadcast(learned.select("lang", F.least(F.lit(1.0), F.lit(TRAIN_DOCS) / F.col("n")).alias("rate")))
    sample = labelled.select("doc_id", "lang", "text").join(rates, "lang").where(F.coalesce(hash_below(F.col("doc_id"), F.col("rate")), F.lit(False)))
    counts = sample.select("lang", "text").mapInPandas(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "language-counts")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())

    def blocks() -> Iterator[np.ndarray]:
        for i in range(0, len(languages), BLOCK_LANGUAGES):
            few = languages[i : i + BLOCK_LANGUAGES]
            table = (counts.where(F.col("lang").isin(few)) if len(languages) > len(few) else counts).toPandas()  # a block's, FEATURES each at most
            matrix, row = np.zeros((len(few), FEATURES)), {lang: k for k, lang in enumerate(few)}
            matrix[[row[x] for x in table["lang"]], table["feature"]] = table["n"]
            yield matrix

    return Model(languages, blocks())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and ambiguous added (in place of columns of these names)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x bits floats, however large the corpus

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(x) for x in texts], columns=["lang_pred", "score", "ambiguous"])

    found = F.pandas_udf(run, "lang_pred string, score double, ambiguous boolean")("text")
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), found.alias("found")).select("row.*", "found.*")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is found and not ambiguous, with their own columns."""
    found = identify(docs.select(F.struct("*").alias("row"), "text"), train(docs))
    return found.where("lang_pred <> 'und' AND NOT ambiguous").select("row.*")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs.where(~held_out(4, 2)))).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
