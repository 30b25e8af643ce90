from hashlib import sha256
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import warc
from fieldloom.sources.shared import shared_path

SCHEMA = "page_id long, url string, html string, payload string, first int"


def expected(pages):
    first = {}
    for i, _, h in sorted(p for p in pages if p[0] is not None):
        first.setdefault(h or "", i)
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        again = len(data) >= 100 and first.get(h or "", i) != i
        out.append((i, len(data), sha256(data).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


def round_trip(spark, pages):
    path = shared_path(spark, "warc-test")
    warc.write(warc.classify(spark.createDataFrame([(*p, "x", 1) for p in pages], SCHEMA)), path)
    rows = warc.read(spark, path).collect()
    assert all(r["intact"] for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=str)


PAGES = [
    (1, "http://a/", "<p>" + "x" * 200), (2, "http://b/", "<p>" + "x" * 200), (3, None, None), (4, "http://c/", ""), (5, "u\r\nWARC-Type: evil", "short"),
    (6, "u", "short"), (7, "u", "before" + warc.MAGIC + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nafter"),
    (8, "u", warc.MAGIC), (9, "u", warc.MAGIC * 3 + "é"), (10, "u", "\r\n\r\n"), (0, "u", "ü" * 50), (11, "u", "ü" * 50), (12, "u", "ü" * 49 + "x"), (13, "u", "ü" * 49 + "x"),
    (14, "u", "ends with\r\n\r\nWARC/1.1"), (15, "u", "\nplain\rtext\n"), (16, "u", warc.MAGIC + "WARC-Record-ID: <urn:page:1>\r\nContent-Length: 99999\r\n\r\n"),
]


def test_round_trip_with_magic_inside(spark):
    assert round_trip(spark, PAGES) == expected(PAGES)


def test_round_trip_split_anywhere(spark):
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for n in (64, 257):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
            assert round_trip(spark, PAGES) == expected(PAGES)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_second_read_may_be_split_otherwise(spark, monkeypatch):
    pages = [(i, "u", (f"page {i} " * 9) + (warc.MAGIC + "inside" if i % 2 else "")) for i in range(40)]
    size, mended = spark.conf.get("spark.sql.files.maxPartitionBytes"), warc._mended

    def other_splits(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "333")
        return mended(*args)

    monkeypatch.setattr(warc, "_mended", other_splits)
    try:
        assert round_trip(spark, pages) == expected(pages)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_a_piece_that_is_gone_is_an_error_and_a_cut_file_is_not_intact(spark, monkeypatch, tmp_path):
    path = shared_path(spark, "warc-test")
    pages = spark.createDataFrame([(1, "u", "a" + warc.MAGIC + "b" * 50, "x", 1)], SCHEMA)
    warc.write(warc.classify(pages.coalesce(1)), path)
    file = next(Path(path.removeprefix("file://")).glob("part-*"))
    whole = file.read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "part-0.txt").write_bytes(whole[:-20])
    assert [r["intact"] for r in warc.read(spark, f"file://{tmp_path}/cut").collect()] == [False]
    chunks, reads = warc._chunks, []

    def changed(spark, path):
        reads.append(1)
        return chunks(spark, path).where(F.lit(len(reads) == 1) | ~F.col("value").contains("b" * 50))

    monkeypatch.setattr(warc, "_chunks", changed)
    with pytest.raises(Exception, match="archive changed"):
        warc.read(spark, path).collect()


def test_very_long_page(spark):
    pages = [(1, "u", "x" * 5_000_000), (2, "u", "é" * 1_000_000 + warc.MAGIC + "y" * 1_000_000), (3, "u", "é" * 1_000_000 + warc.MAGIC + "y" * 1_000_000)]
    assert round_trip(spark, pages) == expected(pages)


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    rel = con.sql(warc.OP3_SQL)
    assert sorted(map(tuple, warc.op3_warc(spark, sf).select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_nulls_repeats_and_empty(spark):
    long = "y" * 100
    pages = [(2, "u", long), (2, "u", long), (5, "u", long)]
    assert round_trip(spark, pages) == sorted([(2, 100, sha256(long.encode()).hexdigest(), "response", None)] * 2 + [(5, 100, sha256(long.encode()).hexdigest(), "revisit", 2)], key=str)
    assert round_trip(spark, [(None, "u", "q")]) == [(None, 1, sha256(b"q").hexdigest(), "response", None)]
    assert round_trip(spark, []) == []


def test_chain_ends_at_what_is_no_record(spark):
    rows = [("f", 0, 10), ("f", 10, 30), ("f", 20, 25), ("f", 25, 40), ("f", 30, None), ("g", 5, 9), ("g", 9, 12), ("h", 0, 0)]
    got = warc.reachable(spark.createDataFrame(rows, "file string, off long, next long")).collect()
    assert sorted(map(tuple, got)) == [("f", 0), ("f", 10), ("f", 30), ("h", 0)]


def test_whole_table(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r)[:5] for r in warc.op3_warc(spark, sf).collect()), key=str) == expected(pages)
