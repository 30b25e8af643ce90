import time

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldloom.functions.patterns import FIELDS, LINEAR
from fieldloom.operators import extract
from fieldloom.plans import registry
from fieldloom.streaming import extract as streaming

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), "s", 0) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.queries()[name](spark, sf)
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    mine = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in sorted(df.columns)]
    theirs = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    assert mine == theirs
    assert mine


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fields_present_repeated_absent_and_conflicting(spark):
    d = docs(spark, ["a b@c.de x b@c.de", "x y@z.org, then b@c.de", "none", "", None, "call +1 (555) 123-4567 or 10.0.0.1"])
    found = extract.candidates(d)
    assert rows(found.where("doc_id = 0")) == [(0, "email", 1, "b@c.de"), (0, "email", 2, "b@c.de")]
    assert rows(extract.resolve(found)) == [(0, "email", "b@c.de"), (1, "email", "y@z.org"), (5, "ip", "10.0.0.1"), (5, "phone", "+1 (555) 123-4567")]
    assert rows(extract.record(extract.resolve(found)))[2] == (5, None, "+1 (555) 123-4567", "10.0.0.1", None, None)
    assert rows(extract.gaps(d, found)) == [(2,), (3,), (4,)]
    assert rows(extract.conflicts(found)) == [(1, "email", 2, 2)]
    assert rows(extract.shared_values(found)) == [("email", "b@c.de", 2, 0)]
    assert rows(extract.resolve_all(found, 1).where("doc_id = 1")) == [(1, "email", 1, "y@z.org")]


def test_the_first_value_is_that_of_the_first_match(spark):
    d = docs(spark, ["10.0.0.12 then 10.0.0.1", "b@c.dex and b@c.de"])
    assert rows(extract.resolve(extract.candidates(d))) == [(0, "ip", "10.0.0.12"), (1, "email", "b@c.dex")]
    assert rows(extract.resolve_all(extract.candidates(d), 2)) == [(0, "ip", 1, "10.0.0.12"), (0, "ip", 2, "10.0.0.1"), (1, "email", 1, "b@c.dex"), (1, "email", 2, "b@c.de")]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab0@.-+_ é"), max_size=30), min_size=1, max_size=20))
def test_linear_patterns_equal_the_plain_ones(spark, texts):
    plain, linear = FIELDS["email"], LINEAR[FIELDS["email"]]
    df = docs(spark, texts).select(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (plain, linear)])
    assert all(a == b for a, b in df.collect())


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 1_000_000, "a@" * 500_000, "a@b." * 250_000, "a@" + "b" * 1_000_000, "0" * 1_000_000, "1." * 500_000, "a b@c.de " * 100_000]
    began = time.time()
    found = extract.candidates(docs(spark, texts)).groupBy("doc_id", "field").count()
    assert (6, "email", 100_000) in rows(found)
    assert time.time() - began < 30


def test_segments_keep_empty_lines(spark):
    assert rows(extract.segment(docs(spark, ["a\n\nb", ""]))) == [(0, 1, "a"), (0, 2, ""), (0, 3, "b"), (1, 1, "")]


def test_rules_on_procurement_text(spark):
    d = docs(spark, ["The vendor shall deliver.\nBids close 2024-05-01.", "Offre à remettre\nou non, éou", "shall\nshall not"])
    rules = {"must": "(^|[^a-z])shall([^a-z]|$)", "date": "[0-9]{4}-[0-9]{2}-[0-9]{2}", "ou": r"(^|[^\p{L}])ou([^\p{L}]|$)", "never": "zzz"}
    stored = spark.createDataFrame(list(rules.items()), "rule_id string, pat string")
    assert extract.rules_of(stored) == rules
    assert rows(extract.match_rules(extract.segment(d), rules)) == [("date", 1, 1), ("must", 3, 2), ("ou", 1, 1)]


def test_coverage_levels_tell_null_languages(spark):
    d = docs(spark, ["b@c.de", "b@c.de", "none"], {0: None})
    got = rows(extract.coverage(d, extract.candidates(d)))
    assert (None, "email", 1, 0) in got and (None, "email", 2, 2) in got and (None, None, 2, 3) in got


def test_page_parts_of_broken_pages(spark):
    pages = spark.createDataFrame([(1, "http://h.example/x", "<title>T</title><a href=\"/u\">u</a><p>one<p>two"), (2, None, None)], "page_id long, url string, html string")
    assert rows(extract.page_parts(pages)) == [(1, "link", "/u"), (1, "paragraph", "one"), (1, "paragraph", "two"), (1, "title", "T")]


def test_stream_reads_each_file_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    read = lambda: streaming.candidates_stream(spark, src, out, state).count()
    docs(spark, ["b@c.de", "x"]).coalesce(1).write.parquet(src + "/documents1.parquet")
    assert [read(), read()] == [1, 1]
    docs(spark, ["y@c.de z@c.de"]).coalesce(1).write.parquet(src + "/documents2.parquet")
    assert read() == 3


def test_empty_tables(spark):
    d = spark.createDataFrame([], SCHEMA)
    found = extract.candidates(d)
    for df in (extract.segment(d), found, extract.resolve(found), extract.record(extract.resolve(found)), extract.gaps(d, found)):
        assert df.count() == 0


def test_fuzzy_matches_are_all_within_the_edits(spark):
    import random

    from fieldloom.operators import fuzzy

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(150)})
    terms = ["abcabc", "", "a", "bbbb", "caba", "abcabc", None]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *following(row, i, x, b)]
        return row[-1]

    def following(row, i, x, b):
        out, left = [], i
        for j, y in enumerate(b, 1):
            left = min(row[j] + 1, left + 1, row[j - 1] + (x != y))
            out.append(left)
        return out

    found = spark.createDataFrame([(w, k, "x") for k, w in enumerate(words)], "word string, n_docs long, common string")
    table = spark.createDataFrame([(t, "y") for t in terms], "term string, common string")
    for k in (0, 1, 2):
        got = sorted(map(tuple, fuzzy.fuzzy_matches(found, table, k).collect()))
        assert got == sorted((t, w, edits(t, w), n) for t in set(terms) - {None} for n, w in enumerate(words) if edits(t, w) <= k)
    assert fuzzy.fuzzy_matches(found.limit(0), table).count() == fuzzy.fuzzy_matches(found, table.limit(0)).count() == 0
    rows = fuzzy.words(spark.createDataFrame([(None,), ("",), ("Letters LETTERS letters, short KurzK",), ("letters",)], "text string"))
    assert {tuple(r) for r in rows.collect()} == {("letters", 2)}


def test_rules_of_a_table_take_marks_as_they_are(spark):
    items = spark.createDataFrame([(1, "one (two) three. four [5] six* seven"), (2, "too short"), (3, None), (4, "a b c d e f")], "item_id long, text string")
    rules = extract.rules_of(extract.passage_rules(items))
    assert set(rules) == {"1", "4"}
    segments = spark.createDataFrame([(1, "x one (two) three. four [5] six* y"), (1, "one (two) three! four [5] six*"), (2, "a b c d e f")], "doc_id long, seg string")
    assert {tuple(r) for r in extract.match_rules(segments, rules).collect()} == {("1", 1, 1), ("4", 1, 1)}


def test_procurement_rules_on_hand_written_documents(spark):
    from fieldloom.functions.patterns import PROCUREMENT

    lines = [
        "The Contractor shall deliver all reports.", "Bidders must sign.", "A marshal and a mustard seed.", "Proposals are due by noon, no later than 2025-03-31.",
        "The ceiling is USD 1,250,000.00 in total.", "It costs $5 a day.", "Order 2025-13-41 is no date.", "Submit two sealed bids.", "Award criteria are weighted.", "",
    ]
    docs = spark.createDataFrame([(1, "\n".join(lines[:5])), (2, "\n".join(lines[5:])), (3, None)], "doc_id long, text string")
    got = {r["rule_id"]: (r["n_segs"], r["n_docs"]) for r in extract.match_rules(extract.segment(docs), PROCUREMENT).collect()}
    assert got == {"obligation": (2, 1), "deadline": (1, 1), "date": (1, 1), "amount": (2, 2), "submission": (1, 1), "evaluation": (1, 1)}


def test_rules_table_of_any_size(spark, tmp_path):
    starts = [f"a{k % 7} b{k} c.{k} (d e{k % 3} f{k % 5}" for k in range(1500)]
    texts = [f"x{s}z\n{s} {s}\nnone" if k % 3 else s.replace(" e", "  e") for k, s in enumerate(starts)] + [None, "", starts[1]]
    spark.createDataFrame([(k, f"{s} more") for k, s in enumerate(starts)] + [(2000, "too short"), (2001, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None if k == 4 else k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["match_rules_table"](spark, str(tmp_path)).collect()
    want = {}
    for k, t in enumerate(texts):
        for seg in (t or "").split("\n"):
            for r, s in enumerate(starts):
                if s in seg:
                    want.setdefault(str(r), []).append(None if k == 4 else k // 2)
    assert {(r["rule_id"], r["n_segs"], r["n_docs"]) for r in got} == {(r, len(d), len(set(d) - {None})) for r, d in want.items()}


def test_phrases_short_and_overlapping(spark):
    segments = spark.createDataFrame([(1, 1, "one two three four"), (1, 2, "xone two threex"), (2, 1, "two  three"), (3, 1, None)], "doc_id long, seg_no long, seg string")
    phrases = spark.createDataFrame([("a", "one two three"), ("b", "e two"), ("c", "o"), ("d", ""), ("e", "two  three"), ("f", None), ("g", "two three four")], "rule_id string, phrase string")
    got = {tuple(r) for r in extract.match_phrases(segments, phrases).collect()}
    assert got == {("a", 2, 1), ("b", 2, 1), ("c", 3, 2), ("e", 1, 1), ("g", 1, 1)}
