"""From documents to segments, candidate values, and one record a document.

Every operator is a DataFrame of built-in functions. Null texts count as empty and have no
candidates, empty ones have one empty segment; very long texts take time linear in their length;
rows that repeat a doc_id count as one document, whose candidates are all of theirs; those without
one are carried, but none counts as a document of coverage or gaps' other side; empty tables give empty
results; columns of other names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.patterns import FIELDS, LINEAR, NEEDED, PARTS, RULES

#: A table of rules holds at most so many: they become part of the plan.
RULE_ROWS = 1000


def segment(docs: DataFrame) -> DataFrame:
    """(doc_id, seg_no, seg): a row a line, numbered from 1; empty lines stay."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "seg"))
    return lines.select("doc_id", (F.col("at") + 1).cast("long").alias("seg_no"), "seg")


def candidates(docs: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, field, n, value): all matches of each field's pattern, numbered from 1 in order of the text.

    All patterns are matched in one pass over the texts.
    """
    fields = FIELDS if fields is None else fields

    def values_of(pattern: str) -> Column:
        values = F.regexp_extract_all("text", F.lit(LINEAR.get(pattern, pattern)), F.lit(0))
        return F.when(F.contains(F.col("text"), F.lit(NEEDED[pattern])), values) if pattern in NEEDED else values

    found = [F.struct(F.lit(name).alias("field"), values_of(p).alias("values")) for name, p in fields.items()]
    by_field = docs.select("doc_id", F.explode(F.array(*found)).alias("f")).where(F.size("f.values") > 0)
    values = by_field.select("doc_id", F.col("f.field").alias("field"), F.posexplode("f.values").alias("at", "value"))
    return values.select("doc_id", "field", (F.col("at") + 1).cast("long").alias("n"), "value")


def rules_of(table: DataFrame) -> dict[str, str]:
    """A table (rule_id, pat) of at most RULE_ROWS rules, to give to match_rules()."""
    rows = table.select("rule_id", "pat").limit(RULE_ROWS + 1).collect()
    if len(rows) > RULE_ROWS:
        raise ValueError(f"more than {RULE_ROWS} rules")
    return {r["rule_id"]: r["pat"] for r in rows}


def passage_starts(items: DataFrame, words: int = 6) -> DataFrame:
    """(item_id, text) to phrases (rule_id, phrase): the first words of each text, as they stand; shorter texts give none."""
    start = F.regexp_extract("text", "^[^ ]+" + "( [^ ]+)" * (words - 1), 0)
    return items.where(start != "").select(F.col("item_id").cast("string").alias("rule_id"), start.alias("phrase"))


def passage_rules(items: DataFrame, words: int = 6) -> DataFrame:
    """passage_starts() as a table of rules (rule_id, pat): marks of regular expressions are taken literally."""
    return passage_starts(items, words).select("rule_id", F.regexp_replace("phrase", r"([\\.\[\]{}()*+?^$|])", r"\\$1").alias("pat"))


def match_rules(segments: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(rule_id, n_segs, n_docs): the segments each rule matches and the documents they are of; rules without one are left out.

    Patterns are literals, compiled once; a segment is read once for all of them.
    """
    rules = RULES if rules is None else rules
    tried = F.array(*[F.when(F.col("seg").rlike(pattern), F.lit(rule)) for rule, pattern in rules.items()]).cast("array<string>")
    hits = segments.select("doc_id", F.explode(F.array_compact(tried)).alias("rule_id"))
    by_doc = hits.groupBy("rule_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))  # spreads a rule that matches everywhere
    return by_doc.groupBy("rule_id").agg(F.sum("n").alias("n_segs"), F.count("doc_id").alias("n_docs"))


def match_phrases(segments: DataFrame, phrases: DataFrame) -> DataFrame:
    """match_rules() for a table (rule_id, phrase) of any size: the segments that hold each phrase, as it stands; empty ones are left out.

    A phrase of three or more words has its inner ones whole wherever it occurs, so only segments that hold the longest
    of these are searched for it: each word of a segment is looked up once, however many phrases there are. Shorter
    phrases are searched for in every segment.
    """
    words = F.split("phrase", " ", -1)
    inner = F.when(F.size(words) > 2, F.slice(words, 2, F.size(words) - 2))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    known = phrases.where("phrase <> ''").select("rule_id", "phrase", longest.alias("word"))
    rows = segments.select("doc_id", "seg", F.explode(F.array_distinct(F.split("seg", " ", -1))).alias("word"))
    found = rows.join(known, "word").where(F.contains("seg", "phrase")).select("doc_id", "rule_id")
    short = segments.join(F.broadcast(known.where("word IS NULL")), F.contains("seg", "phrase")).select("doc_id", "rule_id")
    by_doc = found.union(short).groupBy("rule_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("rule_id").agg(F.sum("n").alias("n_segs"), F.count("doc_id").alias("n_docs"))


def resolve(found: DataFrame) -> DataFrame:
    """(doc_id, field, value): for each document and field the value that comes first, the smaller one at a tie of repeated documents."""
    best = found.groupBy("doc_id", "field").agg(F.min(F.struct("n", "value")).alias("best"))
    return best.select("doc_id", "field", F.col("best.value").alias("value"))


def resolve_all(found: DataFrame, keep: int) -> DataFrame:
    """(doc_id, field, rank, value): the first distinct values of each document and field, up to keep of them."""
    distinct = found.groupBy("doc_id", "field", "value").agg(F.min("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "field").orderBy("n", "value"))
    return distinct.select("doc_id", "field", rank.cast("long").alias("rank"), "value").where(F.col("rank") <= keep)


def record(resolved: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row a document that has any field, one column a field; the names are fixed, so no pass looks for them."""
    return resolved.groupBy("doc_id").pivot("field", list(FIELDS) if fields is None else fields).agg(F.min("value"))


def coverage(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, field, n_docs, level): documents that have the field, by language and field, by field, and overall.

    level tells subtotals (2: by field, 3: overall) from null languages.
    """
    pairs = found.select("doc_id", "field").distinct().join(docs.select("doc_id", "lang"), "doc_id")
    sets = pairs.groupingSets([["lang", "field"], ["field"], []], "lang", "field")
    level = (F.grouping("lang") * 2 + F.grouping("field")).cast("int")
    return sets.agg(F.countDistinct("doc_id").alias("n_docs"), level.alias("level"))


def gaps(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id): documents without any candidate."""
    return docs.select("doc_id").join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def conflicts(found: DataFrame) -> DataFrame:
    """(doc_id, field, n_values, n_matches): documents in which a field has more than one distinct value."""
    values = found.groupBy("doc_id", "field").agg(F.countDistinct("value").alias("n_values"), F.count(F.lit(1)).alias("n_matches"))
    return values.where("n_values > 1")


def shared_values(found: DataFrame) -> DataFrame:
    """(field, value, n_docs, first_doc): values that occur in more than one document."""
    once = found.select("field", "value", "doc_id").distinct()
    return once.groupBy("field", "value").agg(F.count("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


def page_parts(pages: DataFrame, parts: dict[str, str] | None = None) -> DataFrame:
    """(page_id, part, value): what each part's pattern captures in the page, all parts in one pass."""
    parts = PARTS if parts is None else parts
    found = [F.struct(F.lit(name).alias("part"), F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("values")) for name, pattern in parts.items()]
    rows = pages.select("page_id", F.explode(F.array(*found)).alias("p"))
    return rows.select("page_id", F.col("p.part").alias("part"), F.explode("p.values").alias("value"))


def links(pages: DataFrame) -> DataFrame:
    """(host, n_pages, n_links, n_targets): what the pages of each host link to."""
    targets = pages.select("page_id", F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"), F.regexp_extract_all("html", F.lit(PARTS["link"]), F.lit(1)).alias("targets"))
    rows = targets.select("host", "page_id", F.explode_outer("targets").alias("target"))
    return rows.groupBy("host").agg(F.countDistinct("page_id").alias("n_pages"), F.count("target").alias("n_links"), F.countDistinct("target").alias("n_targets"))
