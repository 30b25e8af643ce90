"""The filter interaction audit against brute force and its SQL."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from fieldloom.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, good boolean, key long"


def plain_masks(docs, labels):
    """(part, mask, good, toxic) of each document, text by text."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > least[text]]
        out.append((source or "", sum(1 << k for k, f in enumerate(fails) if f), *(i is not None and any(d == i and x[k] == 1 for d, *x in labels) for k in (0, 1))))
    return out


def plain_audit(docs, labels):
    """Each document through each order of the filters."""
    masks, rows = plain_masks(docs, labels), {}
    for part in {m[0] for m in masks}:
        removed_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [m for m in masks if m[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                out = [m for m in left if m[1] & bit]
                left = [m for m in left if not m[1] & bit]
                rows[part, order, step] = [len(left), len(out), sum(bool(m[1] & bit) for m in gone), sum(m[0] == part and m[1] == bit for m in masks), sum(m[2] for m in out), sum(m[3] for m in out)]
                removed_by[f] += len(out)
                gone += out
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                rows[part, order, step].append(removed_by[f])
    return sorted((*k, *v) for k, v in rows.items())


def made(rng):
    """Texts that fail by every filter, repeated with smaller ids in later rows."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words, 80)), "word " * 70, " ".join(rng.choice(words, 60)).upper(), " ".join(rng.choice(words, 60)) + " 5%", "", "a | b", None, "é" * 30 + " " + " ".join(words), "LONG x " * 30_000]
    docs = [(int(i), texts[rng.integers(len(texts))], (None, "", "s", "t")[rng.integers(4)]) for i in rng.permutation(300)]
    docs += [docs[0], docs[0], (docs[1][0], docs[2][1], "t"), (None, docs[0][1], "s"), (None, None, "u"), (-5, texts[0], None)]
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 200)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (7, None, None), (999, 1, 1)]
    return docs, labels


def write(spark, docs, labels, folder, files):
    for k in range(files):
        rows = [(i, t, "en", s, 0, "x", 1, True, 2) for i, t, s in docs[k::files]]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


@pytest.mark.parametrize("files,per_batch,texts,hot", [(5, 1, 2, 10_000), (4, 2, 256, 1), (1, 1, 1, 10_000)])
def test_audit_against_brute_force(spark, tmp_path, monkeypatch, files, per_batch, texts, hot):
    monkeypatch.setattr(filter_audit, "TEXTS", texts)
    monkeypatch.setattr(filter_audit, "HOT_ROWS", hot)
    monkeypatch.setattr(filter_audit, "HOT_IDS", 1000)
    docs, labels = made(np.random.default_rng(files))
    write(spark, docs, labels, tmp_path, files)
    counts = filter_audit.count_masks(spark, str(tmp_path), spark.read.parquet(f"{tmp_path}/labels.parquet"), per_batch)
    assert {tuple(r)[:4]: r["n"] for r in counts.collect() if r["n"]} == Counter(plain_masks(docs, labels))
    assert sorted(map(tuple, filter_audit.interactions(counts).collect())) == plain_audit(docs, labels)


def test_smaller_ids_that_arrive_later_retract_what_was_counted(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(60))
    for part, i in (("a", 9), ("b", 5), ("c", 7), ("d", 1)):  # one file, and one batch, each
        write(spark, [(i, text, part)], [], tmp_path / part, 1)
        spark.read.parquet(f"{tmp_path}/{part}/documents.parquet").coalesce(1).write.mode("append").parquet(f"{tmp_path}/all/documents.parquet")
    counts = filter_audit.count_masks(spark, f"{tmp_path}/all", spark.createDataFrame([], "doc_id long, quality int, toxic int"), 1)
    assert {(r["part"], r["mask"]): r["n"] for r in counts.collect() if r["n"]} == {("a", 16): 1, ("b", 16): 1, ("c", 16): 1, ("d", 0): 1}


def test_one_text_sends_a_row_a_task():
    import pandas as pd

    batch = pd.DataFrame({"bucket": 3, "text": [b"t"] * 500, "doc_id": list(range(500, 0, -1)), "part": "s", "mask": 1, "good": False, "toxic": False})

    class Context:
        def partitionId(self):
            return 4

    class Fake:
        get = staticmethod(Context)

    whole, filter_audit.TaskContext = filter_audit.TaskContext, Fake
    try:
        rows = pd.concat(filter_audit._join_texts(iter([batch, batch.assign(doc_id=float("nan"))])))
    finally:
        filter_audit.TaskContext = whole
    assert sorted(rows[["bucket", "id", "mask", "n"]].itertuples(index=False, name=None)) == [(-5, 0, 1, 500), (-5, 0, 17, 499), (3, 1, 1, 1)]


def test_audit_equals_sql(spark, sf, tmp_path):
    docs, labels = made(np.random.default_rng(8))
    write(spark, docs, labels, tmp_path, 3)
    for folder in (sf, str(tmp_path)):
        con = duckdb.connect()
        for name in ("documents", "labels"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet{'' if folder == sf else '/*.parquet'}'")
        rel = con.sql(filter_audit.OP12_SQL)
        got = filter_audit.op12_filter_audit(spark, folder)
        assert got.columns == rel.columns and sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


def test_audit_of_an_empty_table(spark, tmp_path):
    write(spark, [], [], tmp_path, 1)
    assert filter_audit.op12_filter_audit(spark, str(tmp_path)).count() == 0
