"""Terms of a dictionary in documents, spelt with a few edits.

Words within k edits of each other have a string in common that either becomes by deleting up to k
characters. Each distinct word and each term goes out once for every such string; equal ones meet by
a join, and what meets is verified by its edit distance. Words that no edit relates hardly ever meet, so the cost
follows the number of distinct words, not their product with the terms; texts are read once, to count words.

Cases: null and empty texts have no words; repeated rows count as documents each; a word is one row however often it occurs;
null terms match nothing; repeated terms count once; empty tables give no rows; columns of other names are not read. A
term shorter than the edits would match any word as short, and is joined like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of ASCII letters that count as words, lower-cased.
WORD = "[A-Za-z]{6,}"


def words(docs: DataFrame, pattern: str = WORD) -> DataFrame:
    """(word, n_docs) of the column text."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.lower))
    return docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))


def deletions(word: Column, edits: int) -> Column:
    """All distinct strings that the word becomes by deleting up to so many characters."""
    def one_less(w: Column) -> Column:
        at = F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    levels = [F.array(word)]
    for _ in range(edits):
        levels.append(F.array_distinct(F.flatten(F.transform(levels[-1], one_less))))
    return F.array_distinct(F.concat(*levels))


def fuzzy_matches(found: DataFrame, terms: DataFrame, edits: int = 2) -> DataFrame:
    """(word, n_docs) and (term) to (term, word, distance, n_docs): each word within so many edits of a term."""
    ours = found.select("word", "n_docs", F.explode(deletions(F.col("word"), edits)).alias("common"))
    theirs = terms.where("term IS NOT NULL").select("term").distinct()
    theirs = theirs.select("term", F.explode(deletions(F.col("term"), edits)).alias("common"))
    met = ours.join(theirs, "common").select("term", "word", "n_docs").distinct()
    distance = F.levenshtein("word", "term", edits)
    return met.select("term", "word", distance.cast("int").alias("distance"), "n_docs").where(F.col("distance") >= 0)
