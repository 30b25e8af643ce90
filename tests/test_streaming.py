from pyspark.sql import functions as F

from fieldloom.operators import extract
from fieldloom.sources.tables import TEXT_SCHEMA, save, stream, table
from fieldloom.streaming import extract as streaming


def test_windows_of_a_stream_are_those_of_the_table_up_to_the_watermark(spark, sf, tmp_path):
    events = table(spark, sf, "events")
    live = streaming.windowed(stream(spark, sf, "events*.parquet", events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")), "1 hour", "0 seconds")
    out = str(tmp_path / "out")
    streaming.run_available(live, out, str(tmp_path / "state"))
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    batch = {tuple(r) for r in streaming.windowed(events).collect()}
    assert got and got <= batch
    last = max(r[0] for r in got)
    assert {r for r in batch if r[0] <= last} == got


def test_windows_of_odd_values(spark):
    rows = [("2024-01-01 00:10:00", "a", 1.5), ("2024-01-01 00:20:00", "a", float("inf")), ("2024-01-01 00:30:00", "a", 1e40), ("2024-01-01 00:40:00", "a", None), (None, "a", 2.0)]
    events = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = [tuple(r)[1:] for r in streaming.windowed(events).collect()]
    assert got == [("a", 4, 1.5)]


def test_records_of_a_document_that_comes_in_several_batches(spark, tmp_path):
    rows = [
        [(1, "call +1 (555) 123-4567 now"), (2, "mail b@x.org"), (None, "10.0.0.2")],
        [(1, "mail me a@x.org, a0@x.org; +1 (555) 000-0000"), (3, "nothing"), (2, "mail a@x.org")],
        [(2, "10.0.0.1"), (None, "c@x.org 10.0.0.1"), (1, "")],
    ]  # each a file, and a batch
    for k, part in enumerate(rows):
        spark.createDataFrame([(i, t, "en", "s", 0) for i, t in part], TEXT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    got = streaming.records_stream(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "state"), 1)
    whole = table(spark, str(tmp_path), "documents")
    want = extract.record(extract.resolve(extract.candidates(whole)))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r["doc_id"]: (r["email"], r["phone"], r["ip"]) for r in got.collect()} == {1: ("a@x.org", "+1 (555) 000-0000", None), 2: ("a@x.org", None, "10.0.0.1"), None: ("c@x.org", None, "10.0.0.1")}


def test_upserted_records_end_as_those_of_the_table(spark, sf, tmp_path):
    seen = {}

    def write(records, number):
        seen.update({r["doc_id"]: r for r in records.collect()})

    found = extract.candidates(stream(spark, sf, "documents*.parquet", TEXT_SCHEMA))
    streaming.upsert_records(found, write, str(tmp_path / "state")).awaitTermination()
    batch = extract.record(extract.resolve(extract.candidates(table(spark, sf, "documents")))).collect()
    assert sorted(map(tuple, seen.values()), key=str) == sorted(map(tuple, batch), key=str)


def test_segments_of_a_stream(spark, sf, tmp_path):
    got = streaming.segments_stream(spark, sf, str(tmp_path / "out"), str(tmp_path / "state"))
    assert got.count() == extract.segment(table(spark, sf, "documents")).count()


def test_save_by_partition(spark, sf, tmp_path):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    save(docs, str(tmp_path / "out"), by=["lang"])
    assert spark.read.parquet(str(tmp_path / "out")).where("lang = 'en'").count() == docs.where("lang = 'en'").count()
