"""The source divergence audit against brute force and its SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, slot long, p long, vector int"


def plain(docs, least):
    """Dense, group by group, in whole numbers."""
    df, counts, totals, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
        totals[lang].update(terms)
    rows = []

    def shares(count, kept):
        n = sum(count[t] for t in kept) + 5 * len(kept)
        return {t: 1 + 1_000_000_000 * (count[t] + 5) // n for t in kept}

    def ranked(lang, source, part, items):
        items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
        return [(lang, source, part, item, value, k) for k, (item, value) in enumerate(items, 1)]

    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        p, q = {s: shares(counts[lang, s], kept) for s in sources}, shares(totals[lang], kept)
        for s in sources:
            rows += ranked(lang, s, "pair", [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s])
            rows += ranked(lang, s, "term", [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]])[:50]
    return sorted(rows)


def made(rng):
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "Y", "é", "ÄZ", "漢")]
    docs = []
    for lang, least in (("en", 0), ("fr", 10), (None, 20), ("en fr", 5)):
        for source in ("s1", "s2", "S 3", None, "é", "s1 "):
            mine = rng.permutation(words)[: 10 + least]
            docs += [(" ".join(rng.choice(mine, rng.integers(0, 20))) + rng.choice([" ", "1", "\n.", "É"]), lang, source) for _ in range(rng.integers(0, 9))]
    return [*docs, (None, "en", "none"), ("", "xx", "alone"), ("12 -", "xx", "b"), ("rare words", "yy", "s1"), ("aB " * 20_000, "en", "s1"), *docs[:3], *docs[:3]]


def check(spark, docs, folder=None):
    df = spark.createDataFrame([(1, t, k, s, 0, "x", 5, 6, 7) for t, k, s in docs], SCHEMA)
    if folder:
        df.write.parquet(f"{folder}/documents.parquet")
    return df


@pytest.mark.parametrize("shard,tile,block,rows", [(10**6, 128, 2048, 10**5), (3, 2, 5, 10**5), (10**6, 1, 3, 0)])
def test_against_brute_force(spark, monkeypatch, shard, tile, block, rows):
    for name, value in (("SHARD", shard), ("COUNTED", 1 if shard < 10 else 64), ("TILE", tile), ("BLOCK", block), ("BROADCAST_ROWS", rows), ("MIN_DF", 3)):
        monkeypatch.setattr(divergence, name, value)
    docs = made(np.random.default_rng(tile))
    df = check(spark, docs)
    if shard < 10:
        assert divergence.shards_of(divergence.named(df)) > 3
    assert sorted(map(tuple, divergence.divergences(df).collect())) == plain(docs, 3)


def test_shares_of_very_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    n, total, terms = 4 * 10**18, 9 * 10**18, 7
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms).cast("long"))).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 5) // (total + 35)


def test_equals_sql(spark, tmp_path):
    docs = made(np.random.default_rng(5)) * 8
    check(spark, docs, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel, got = con.sql(divergence.OP11_SQL), divergence.op11_divergence(spark, str(tmp_path))
    rows = sorted(map(tuple, got.collect()))
    assert got.columns == rel.columns and rows == sorted(rel.fetchall()) == plain(docs, 30)


def test_without_rows_or_kept_terms(spark):
    assert divergence.divergences(check(spark, [("x", "en", "s")]).limit(0)).count() == 0
    got = sorted(map(tuple, divergence.divergences(check(spark, [("a b", "en", "s"), (None, "en", "t"), (None, None, None)])).collect()))
    assert got == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_counts_leave_tasks_by_binary_digit(spark, monkeypatch):
    """What is made vectors of grows with the distinct terms of a task's sources, not with their occurrences."""
    texts = [("a", "x", "one two " * 500 + "three"), ("a", "x", "one four"), ("a", "y", "ONE"), ("b", None, "one " * 6), (None, "y", None)]
    df = spark.createDataFrame([(k, t, lang, source) for k, (lang, source, t) in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1)
    rows = divergence.named(df).collect()
    assert sorted(sorted(r["terms"]) for r in rows if not r["weight"]) == [[], ["a four", "a one"], ["a one"], ["a one", "a three", "a two"], ["b one"]]
    sums, sent = {}, 0
    for r in rows:
        if r["weight"]:
            sent += len(r["terms"])
            for t in r["terms"]:
                sums[r["source"], t] = sums.get((r["source"], t), 0) + r["weight"]
    assert sums == {("x", "a one"): 501, ("x", "a two"): 500, ("x", "a three"): 1, ("x", "a four"): 1, ("y", "a one"): 1, ("", "b one"): 6}
    assert sent < 30
    monkeypatch.setattr(divergence, "ROW", 2)
    counts = pa.table({"lang": ["a"] * 5, "source": ["x"] * 3 + ["y"] * 2, "term": list("pqrpq"), "n": pa.array([1, 5, 4, 4, 1], pa.int64())})
    got = [(r["source"], r["terms"], r["weight"]) for b in divergence._digits(counts) for r in b.to_pylist()]
    assert got == [("x", ["p", "q"], 1), ("y", ["q"], 1), ("x", ["q", "r"], 4), ("y", ["p"], 4)]


def test_documents_send_no_term_that_their_task_has_sent_often(spark, monkeypatch):
    """The vocabulary is the same, and the fit reads a term MIN_DF times a task and a step's documents at most, not once a document."""
    monkeypatch.setattr(divergence, "CHARACTERS", 1000)
    texts = [("a", f"s{k % 3}", f"Common Word {'often ' * (k % 2)} w{chr(97 + k % 26)} {'y' * (k % 40 + 1)}") for k in range(2000)]
    df = spark.createDataFrame([(k, t, lang, source) for k, (lang, source, t) in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1)
    rows = divergence.named(df)
    sent = Counter(t for r in rows.where("weight = 0").collect() for t in r["terms"])
    found = Counter(t for _, _, x in texts for t in {f"a {w}" for w in x.lower().split()})
    assert set(sent) == set(found) and all(sent[t] >= min(30, n) for t, n in found.items())
    assert sent["a common"] < 100 and sum(sent.values()) < sum(found.values()) / 2
    assert sorted(map(tuple, divergence.divergences(df).collect())) == plain([(x, lang, source) for lang, source, x in texts], 30)


def test_parts_of_terms_are_even():
    terms = pa.array([f"en w{k}" for k in range(64_000)] + ["é", "x" * 10_000])
    n = np.bincount((divergence._hashes(terms) % np.uint64(64)).astype(int), minlength=64)
    assert 700 < n.min() and n.max() < 1300
    assert divergence._hashes(terms.slice(5, 9)).tolist() == divergence._hashes(terms)[5:14].tolist() and not len(divergence._hashes(terms[:0]))


def test_texts_go_to_python_in_batches_of_bounded_bytes(spark, monkeypatch):
    """An executor and its worker hold a batch for each task, so texts are cut by their bytes, whatever a batch's number of rows."""
    asked = []
    plain_table = divergence.materialise
    monkeypatch.setattr(divergence, "materialise", lambda df, name, batch=None: asked.append(batch) or plain_table(df, name, batch))
    texts = spark.range(2000, numPartitions=1).selectExpr("repeat('ab ', 200) text", "'en' lang", "'s' source")
    divergence.named(texts)
    assert asked[0] and asked[0] <= 1 << 22

    def told(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    sizes = [r["n"] for r in plain_table(texts.mapInArrow(told, "n long"), "test-batches", 1 << 16).collect()]
    assert len(sizes) > 10 and max(sizes) < 1 << 17
