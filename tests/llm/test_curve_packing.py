"""Packing along the Hilbert curve: round trip against the plain tokenizer, no padding, neighbours alike."""

import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from tokenizers import Tokenizer

from fieldloom.llm import curve_packing, packing

SCHEMA = "doc_id long, text string, source string, uid long, key string, n string, ids int"


@pytest.mark.parametrize("dims,bits", [(1, 5), (2, 1), (2, 5), (3, 3), (4, 3), (5, 2)])
def test_hilbert_numbers_walk_through_neighbours(dims, bits):
    points = np.array(list(product(range(1 << bits), repeat=dims)))
    numbers = curve_packing.hilbert(points, bits)
    order = np.argsort(numbers)
    assert (numbers[order] == np.arange(len(points))).all()
    assert (np.abs(np.diff(points[order], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("total", [0, 1, 2047, 2048, 2049, 4096 + 700, 10**12 + 3])
def test_sequences_behind_the_last_full_one(total):
    starts = curve_packing.sequence_starts(total)
    assert starts[0] % 2048 == 0 and starts[-1] == total and total - starts[0] < 2048
    assert all(n & (n - 1) == 0 and n < 2048 for n in np.diff(starts).tolist())


def check(rows, docs):
    """Each document's ids in pieces, in gapless sequences; all but the last few are full, those powers of two."""
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    ids = {t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in {t for _, t in docs}}
    want = Counter()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for i, t in docs:
        want[i] += len(ids[t])
    assert {i: sum(r["length"] for r in rs) for i, rs in by_doc.items()} == dict(want)
    one = {i: t for i, t in docs}
    for i, n in Counter(i for i, _ in docs).items():
        if n == 1:
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r["start"]):
                part = np.array(ids[one[i]][at : at + r["length"]], "<u4")
                assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids[one[i]]), zlib.crc32(part.tobytes()))
                at += r["length"]
    lengths = []
    for k in sorted(by_seq):
        at = 0
        for offset, length in sorted(by_seq[k]):
            assert offset == at
            at += length
        lengths.append(at)
    total = sum(want.values())
    assert lengths[: total // 2048] == [2048] * (total // 2048) and sum(lengths) == total
    assert all(n & (n - 1) == 0 for n in lengths)


def test_whole_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(curve_packing.op13_curve_packing(spark, sf).collect(), docs)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " a b \n"), (4, "word, " * 9000), (5, "☃ " * 10), (6, "<|endoftext|> it's")] + [(7, "one two")] * 3 + [(None, "x y")] + [(k, "the same words") for k in range(100, 400)]
    df = spark.createDataFrame([(i, t, "s", 1, "k", "n", 2) for i, t in docs], SCHEMA)
    rows = curve_packing.pack_along_curve(df, keep_ids=True).collect()
    check(rows, docs)
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert curve_packing.pack_along_curve(df.limit(0)).count() == 0
    near = sorted((r["sequence_id"], r["offset"]) for r in rows if 100 <= (r["doc_id"] or 0) < 400)
    assert len({s for s, _ in near}) <= 2  # copies stand side by side


def test_neighbours_on_the_curve_are_alike(spark, sf):
    """Cosine of word counts with the next document on the curve, against that in the order of the table."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = curve_packing.op13_curve_packing(spark, sf).where("start = 0").orderBy("sequence_id", "offset").collect()

    def alike(order):
        counts = [Counter(texts[i].lower().split()) for i in order]
        return np.mean([sum(a[w] * b[w] for w in a) / max(1, sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5 for a, b in zip(counts, counts[1:])])

    along = [r["doc_id"] for r in rows]
    assert sorted(along) == sorted(texts)
    assert alike(along) > 1.5 * alike(np.random.default_rng(1).permutation(along).tolist())
