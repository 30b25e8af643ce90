"""Queries by name over a folder of tables, and the equal SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.patterns import FIELDS, PARTS, RULES
from fieldloom.operators import extract, fuzzy
from fieldloom.sources.shared import shared_path
from fieldloom.sources.tables import table
from fieldloom.streaming import extract as streaming


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return extract.candidates(_docs(spark, folder))


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    at = shared_path(spark, "stream")
    return streaming.candidates_stream(spark, folder, f"{at}/out", f"{at}/state")


def _records_stream(spark: SparkSession, folder: str) -> DataFrame:
    at = shared_path(spark, "records")
    return streaming.records_stream(spark, folder, f"{at}/out", f"{at}/state")


def _fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzy.fuzzy_matches(fuzzy.words(_docs(spark, folder)), fuzzy.words(table(spark, folder, "benchmark")).select(F.col("word").alias("term")))


def queries() -> dict:
    e = extract
    return {
        "segment": lambda s, d: e.segment(_docs(s, d)),
        "candidates": lambda s, d: _found(s, d),
        "match_rules": lambda s, d: e.match_rules(e.segment(_docs(s, d)), RULES),
        "match_rules_table": lambda s, d: e.match_phrases(e.segment(_docs(s, d)), e.passage_starts(table(s, d, "benchmark"))),
        "fuzzy_terms": _fuzzy,
        "resolve": lambda s, d: e.resolve(_found(s, d)),
        "resolve_all": lambda s, d: e.resolve_all(_found(s, d), 3),
        "record": lambda s, d: e.record(e.resolve(_found(s, d))),
        "coverage": lambda s, d: e.coverage(_docs(s, d), _found(s, d)),
        "gaps": lambda s, d: e.gaps(_docs(s, d), _found(s, d)),
        "conflicts": lambda s, d: e.conflicts(_found(s, d)),
        "shared_values": lambda s, d: e.shared_values(_found(s, d)),
        "page_parts": lambda s, d: e.page_parts(table(s, d, "pages")),
        "links": lambda s, d: e.links(table(s, d, "pages")),
        "candidates_stream": _stream,
        "records_stream": _records_stream,
        "windowed_events": lambda s, d: streaming.windowed(table(s, d, "events")),
    }


def _union(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


def _found_sql(field: str, pattern: str) -> str:
    return f"SELECT doc_id, '{field}' AS field, unnest(v) AS value, generate_subscripts(v, 1)::BIGINT AS n FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS v FROM documents)"


_FOUND = f"WITH found AS ({_union([_found_sql(f, p) for f, p in FIELDS.items()])})"
_RESOLVED = f"{_FOUND}, resolved AS (SELECT doc_id, field, arg_min(value, (n, value)) AS value FROM found GROUP BY ALL)"
_WORDS = "SELECT unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{6,}'), lambda w: lower(w)))) AS word FROM"
_FUZZY = f"""
SELECT term, word, levenshtein(word, term)::INT AS distance, n_docs
FROM (SELECT word, count(*) AS n_docs FROM ({_WORDS} documents) GROUP BY word) JOIN (SELECT DISTINCT word AS term FROM ({_WORDS} benchmark))
ON abs(length(word) - length(term)) <= 2 AND levenshtein(word, term) <= 2
"""
_LINKS = PARTS["link"]


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{r}', '{p}')" for r, p in RULES.items())
    columns = ", ".join(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}" for f in FIELDS)
    segments = "SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS seg, generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1)::BIGINT AS seg_no FROM documents"
    return {
        "segment": segments,
        "candidates": f"{_FOUND} SELECT * FROM found",
        "match_rules": f"SELECT rule_id, count(*) AS n_segs, count(DISTINCT doc_id) AS n_docs FROM ({segments}) JOIN (VALUES {rules}) r(rule_id, pat) ON regexp_matches(seg, pat) GROUP BY rule_id",
        "match_rules_table": f"SELECT item_id::VARCHAR AS rule_id, count(*) AS n_segs, count(DISTINCT doc_id) AS n_docs FROM ({segments}) JOIN (SELECT item_id, regexp_extract(text, '^[^ ]+( [^ ]+){{5}}') AS start FROM benchmark) ON start <> '' AND contains(seg, start) GROUP BY item_id",
        "fuzzy_terms": _FUZZY,
        "resolve": f"{_RESOLVED} SELECT * FROM resolved",
        "resolve_all": f"{_FOUND}, ranked AS (SELECT doc_id, field, value, row_number() OVER (PARTITION BY doc_id, field ORDER BY min(n), value) AS rank FROM found GROUP BY doc_id, field, value) SELECT doc_id, field, rank, value FROM ranked WHERE rank <= 3",
        "record": f"{_RESOLVED} SELECT doc_id, {columns} FROM resolved GROUP BY doc_id",
        "coverage": f"{_FOUND} SELECT lang, field, count(DISTINCT doc_id) AS n_docs, (grouping(lang) * 2 + grouping(field))::INT AS level FROM found JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang, field), (field), ())",
        "gaps": f"{_FOUND} SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = d.doc_id)",
        "conflicts": f"{_FOUND} SELECT doc_id, field, count(DISTINCT value) AS n_values, count(*) AS n_matches FROM found GROUP BY ALL HAVING count(DISTINCT value) > 1",
        "shared_values": f"{_FOUND} SELECT field, value, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM found GROUP BY ALL HAVING count(DISTINCT doc_id) > 1",
        "page_parts": _union([f"SELECT page_id, '{n}' AS part, unnest(regexp_extract_all(html, '{p}', 1)) AS value FROM pages" for n, p in PARTS.items()]),
        "links": f"SELECT host, count(DISTINCT page_id) AS n_pages, count(target) AS n_links, count(DISTINCT target) AS n_targets FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, unnest(CASE WHEN len(t) > 0 THEN t ELSE [NULL] END) AS target FROM (SELECT *, regexp_extract_all(html, '{_LINKS}', 1) AS t FROM pages)) GROUP BY host",
        "candidates_stream": f"{_FOUND} SELECT * FROM found",
        "records_stream": f"{_RESOLVED} SELECT doc_id, {columns} FROM resolved GROUP BY doc_id",
        "windowed_events": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(try_cast(value AS DECIMAL(28,4)))::DOUBLE AS total FROM events GROUP BY ALL",
    }
