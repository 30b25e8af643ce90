"""Source divergence audit: how far the sources of a language lie apart in the words they use.

A CountVectorizer over terms with their language in front keeps each language's terms of at least MIN_DF of its documents
(a term with another language in front is another term, so one fit is one for each language) and makes
exact sparse vectors. A vector is linear in its counts, so what it is made of are not single documents but the terms that a task
has counted for a source, once for each binary digit of their counts, weighed by the digit. Their sums by language and source are
added up as sparse rows, a smoothed share of a whole billion is derived for each, and all pairs of a language's sources are
compared term by term, block by block of the terms.

A CountVectorizer holds its vocabulary whole, in the driver and in each executor. So that this is
bounded whatever the corpus, terms are dealt by hash into shards of about SHARD kept terms (one for
most corpora), each with a fit of its own; results don't depend on their number. The pairs of sources are compared
in tiles of TILE by TILE sources and BLOCK terms, of bounded memory, each in a task of its own.

Cases: null texts, languages and sources are empty strings; texts without a term count as documents; a group without a
kept term has shares all alike, and a language without one pairs of value 0; repeated rows are documents each, doc_id
is not read; very long texts are read whole; an empty table gives no rows; columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import materialise

#: Bytes of UTF-8 to those of terms: A-Z to a-z, other ASCII but a-z to a space.
IN_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MIN_DF, LARGEST = 30, 2**31 - 1
#: Shares are of so many parts, and each term counts so much more than it occurs.
WHOLE, MORE = 1_000_000_000, 5
#: Terms listed of a group.
TOP = 50
#: Kept terms that one vocabulary holds, about, and the part of all terms that is counted to estimate how many there are.
SHARD, COUNTED = 1_000_000, 64
#: Entries of sparse vectors that a task holds, and numbers of terms whose sums are sent together.
ENTRIES, STRETCH_BITS = 1 << 22, 12
STRETCH = 1 << STRETCH_BITS
#: Sources, and terms, that a task compares at a time.
TILE, BLOCK = 128, 2048
#: Tables of up to so many groups are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of text looked at a time, and of a batch that goes to Python (the executor and its worker hold one each, for every task).
CHARACTERS, BATCH = 1 << 20, 1 << 22
#: Counts of terms by source that a task holds, about, and terms in a row of them.
HELD, ROW = 1 << 19, 1 << 16
#: Odd numbers, one for each byte of a term (over again in longer ones), that make a hash of it.
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, 1 << 12, np.uint64) * np.uint64(2) + np.uint64(1)


def _plain(text: pa.Array) -> pa.Array:
    """The texts, without nulls, with IN_TERMS in place of their bytes: none changes its length."""
    text = text.cast(pa.string())
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    held = text.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if ends[-1] > ends[0] else b""
    return pa.StringArray.from_buffers(len(text), pa.py_buffer(ends - ends[0]), pa.py_buffer(held.translate(IN_TERMS)))


def _lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), values)


def _hashes(terms: pa.Array) -> np.ndarray:
    """A hash of 32 bits of each term, none of which is empty."""
    if not len(terms):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    held, ends = np.frombuffer(terms.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    at = np.arange(len(held)) - np.repeat(ends[:-1], np.diff(ends))
    return np.add.reduceat(held * FACTORS[at % len(FACTORS)], ends[:-1]) >> np.uint64(32)


def _digits(counts: pa.Table) -> Iterator[pa.RecordBatch]:
    """Counts (lang, source, term, n) to rows of named() for each source and binary digit, of at most ROW terms."""
    counts = counts.sort_by([("lang", "ascending"), ("source", "ascending")]).combine_chunks()
    n = counts.column("n").to_numpy()
    for digit in range(int(n.max()).bit_length() if len(n) else 0):
        mine = counts.filter(pa.array((n >> digit & 1).astype(bool)))
        if not len(mine):
            continue
        lang, source, term = (pa.concat_arrays(mine.column(c).chunks) for c in ("lang", "source", "term"))
        new = [pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False) for x in (lang, source)]
        starts = np.nonzero(np.r_[True, new[0] | new[1]])[0]
        sizes = np.diff(np.r_[starts, len(term)])
        parts = -(-sizes // ROW)
        starts = np.repeat(starts, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * ROW
        at = pa.array(starts)
        none = _lists(pa.array([], pa.string()), np.zeros(len(starts), np.int64))
        columns = [lang.take(at), source.take(at), _lists(term, np.r_[starts[1:], len(term)]), none, pa.array(np.full(len(starts), 1 << digit, np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "terms", "counted", "weight"])


def named(docs: DataFrame) -> DataFrame:
    """(lang, source, terms, counted, weight), as a table: distinct terms lower-cased in A-Z only, with their language in front, and those of them in one of COUNTED parts.

    Rows of weight 0 are the documents, but for terms that the same task has sent in MIN_DF documents before: those are kept for certain,
    and need not be sent again. The others hold the counts of many: a term occurs in a source as often as the weights of
    its rows add up to. No term holds a space, so the last one parts a term from its language.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        often: dict[str, int] = {}  # terms and in how many documents they have been sent, at least
        sure: list[str] = []

        def total() -> pa.Table:
            found = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum")])
            return found.rename_columns([c.removesuffix("_sum") for c in found.column_names])

        for batch in batches:
            size = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            step = max(1, batch.num_rows * CHARACTERS // max(CHARACTERS, size))
            for i in range(0, batch.num_rows, step):
                lang, source, text = (batch.slice(i, step).column(c) for c in ("lang", "source", "text"))
                found = pc.ascii_split_whitespace(_plain(text))
                offsets, terms = found.offsets.to_numpy().astype(np.int64) - found.offsets[0].as_py(), found.flatten()
                full = pc.not_equal(pc.binary_length(terms), 0).to_numpy(zero_copy_only=False)  # texts may begin or end between terms
                offsets = np.r_[0, np.cumsum(full)][offsets]
                langs = lang.take(pa.array(np.repeat(np.arange(len(lang)), np.diff(offsets))))
                terms = pc.binary_join_element_wise(langs, terms.filter(pa.array(full)), " ")
                coded = terms.dictionary_encode()
                known, size = coded.dictionary, max(1, len(coded.dictionary))
                chosen = _hashes(known) % np.uint64(COUNTED) == 0
                pair, n = np.unique(np.repeat(np.arange(len(lang)), np.diff(offsets)) * size + coded.indices.to_numpy(), return_counts=True)
                row, code = pair // size, pair % size
                sent = ~pc.is_in(known, pa.array(sure, pa.string())).to_numpy(zero_copy_only=False)
                several = np.nonzero(sent & (np.bincount(code, minlength=len(known))[: len(known)] > 1))[0]
                for term, more in zip(known.take(pa.array(several)).to_pylist(), np.bincount(code, minlength=size)[several].tolist(), strict=True):
                    often[term] = often.get(term, 0) + more
                    if often[term] >= MIN_DF:
                        sure.append(term)
                        del often[term]
                if len(often) + len(sure) > HELD:
                    often, sure = {}, []
                lists = [_lists(known.take(pa.array(code[x])), np.cumsum(np.bincount(row[x], minlength=len(lang)))) for x in (sent[code], (sent & chosen)[code])]
                yield pa.RecordBatch.from_arrays([lang, source, *lists, pa.array(np.zeros(len(lang), np.int64))], ["lang", "source", "terms", "counted", "weight"])
                # a language has its own terms, so a source and a term tell the group
                names = source.dictionary_encode()
                both, at = np.unique(names.indices.to_numpy()[row] * size + code, return_inverse=True)
                first = np.zeros(len(both), np.int64)
                first[at] = row
                n = np.bincount(at, n, len(both)).astype(np.int64)
                held.append(pa.table({"lang": lang.take(pa.array(first)), "source": source.take(pa.array(first)), "term": known.take(pa.array(both % size)), "n": n}))
                if sum(map(len, held)) > HELD:
                    held = [total()]
                    if len(held[0]) > HELD // 2:
                        yield from _digits(held.pop())
                    pa.default_memory_pool().release_unused()
        if held:
            yield from _digits(total())

    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return materialise(rows.mapInArrow(run, "lang string, source string, terms array<string>, counted array<string>, weight long"), "divergence-terms", BATCH)


def shards_of(rows: DataFrame) -> int:
    """How many vocabularies the kept terms take, from the exact number of those in one of COUNTED parts of all terms."""
    kept = rows.select(F.explode("counted").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DF)
    return max(1, -(-kept.count() * COUNTED // SHARD))


def group_sums(vectors: DataFrame) -> DataFrame:
    """Sparse vectors (source, at, n) and their weights to their sums by source, a row (source, at, n) for each entry.

    A task adds up what it reads and sends, for each source, its entries in stretches of STRETCH numbers.
    """
    def add(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
        return key[first], np.add.reduceat(n, first)

    def sent(names: list[str], key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        group = key // STRETCH
        first = np.nonzero(np.r_[True, group[1:] != group[:-1]])[0]
        offsets = pa.array(np.r_[first, len(key)], pa.int32())
        source = pa.array(names, pa.string()).take(pa.array(group[first] // (1 << 32 - STRETCH_BITS)))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((key % (1 << 32)).astype(np.int32), n)]
        return pa.RecordBatch.from_arrays([source, pa.array((group[first] % (1 << 32 - STRETCH_BITS)).astype(np.int32)), *lists], ["source", "stretch", "at", "n"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        keys, counts, held = [], [], 0
        for batch in batches:
            found, times = batch.column("at"), batch.column("n").flatten().to_numpy()
            mine = np.array([numbers.setdefault(x, len(numbers)) for x in batch.column("source").to_pylist()], np.int64)
            sizes = np.diff(found.offsets.to_numpy())
            keys.append(np.repeat(mine << 32, sizes) + found.flatten().to_numpy())
            counts.append(times.astype(np.int64) * np.repeat(batch.column("weight").to_numpy(), sizes))
            held += len(times)
            if held > ENTRIES:
                key, n = add(keys, counts)
                keys, counts, held = [key], [n], len(key)
                if held > ENTRIES // 2:
                    yield sent(list(numbers), key, n)
                    keys, counts, held = [], [], 0
        if held:
            yield sent(list(numbers), *add(keys, counts))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of source and stretch; of a stretch one sum at a time is held."""
        open_: tuple | None = None
        held, done, size = np.zeros(STRETCH, np.int64), [], 0

        def close() -> None:
            at = held.nonzero()[0]
            done.append((open_[0], at + open_[1] * STRETCH, held[at]))
            held[:] = 0

        def batch_of() -> pa.RecordBatch:
            source = pa.array([s for s, _, _ in done], pa.string()).take(pa.array(np.repeat(np.arange(len(done)), [len(at) for _, at, _ in done])))
            return pa.RecordBatch.from_arrays([source, pa.array(np.concatenate([at for _, at, _ in done]).astype(np.int32)), pa.array(np.concatenate([n for _, _, n in done]))], ["source", "at", "n"])

        for batch in batches:
            at, n = batch.column("at"), batch.column("n")
            offsets = (at.offsets.to_numpy() - at.offsets[0].as_py()).tolist()
            at, n = at.flatten().to_numpy(), n.flatten().to_numpy()
            for source, stretch, a, b in zip(batch.column("source").to_pylist(), batch.column("stretch").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                if open_ != (source, stretch):
                    if open_:
                        close()
                    open_ = source, stretch
                held[at[a:b] - stretch * STRETCH] += n[a:b]  # a row has each number once
                size += b - a
            if size > ENTRIES and done:
                yield batch_of()
                done, size = [], 0
        if open_:
            close()
            yield batch_of()

    parts = vectors.where(F.size("at") > 0).mapInArrow(partial, "source string, stretch int, at array<int>, n array<long>")
    ordered = parts.repartition("source", "stretch").sortWithinPartitions("source", "stretch")
    return ordered.mapInArrow(total, "source string, at int, n long")


def group_counts(rows: DataFrame, shards: int) -> DataFrame:
    """(lang, source, term, n): the occurrences of each kept term in each group that has any, as a table."""
    found = None
    for k in range(shards):
        mine = rows if shards == 1 else rows.withColumn("terms", F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(shards)) == k))  # noqa: B023
        # a vocabulary depends on documents only, not on how often they repeat a term
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=MIN_DF, vocabSize=LARGEST).fit(mine.where("weight = 0").select("terms"))
        spark, vocabulary = rows.sparkSession, model.vocabulary
        if not vocabulary:
            continue
        words = spark.createDataFrame(pd.DataFrame({"at": np.arange(len(vocabulary), dtype=np.int32), "named": vocabulary}))
        vector = F.unwrap_udt("vector")
        vectors = model.transform(mine.where("weight > 0")).select("source", vector["indices"].alias("at"), vector["values"].alias("n"), "weight")
        sums = group_sums(vectors)  # a term's number tells its language
        last = F.length("named") - F.instr(F.reverse("named"), " ") + 1
        words = words.select("at", F.substring("named", F.lit(1), last - 1).alias("lang"), F.substring("named", last + 1, F.length("named")).alias("term"))
        part = materialise(sums.join(words, "at").select("lang", "source", "term", "n"), "divergence-counts")
        found = part if found is None else found.union(part)
    return found if found is not None else rows.select("lang", "source", F.lit("").alias("term"), F.lit(0).cast("long").alias("n")).limit(0)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE (n + MORE) / (total + MORE terms)), in whole numbers that can't overflow."""
    count = F.lit(WHOLE).cast("decimal(10,0)") * (n.cast("decimal(20,0)") + MORE)
    return (F.call_function("div", count, (total + MORE * terms).cast("decimal(25,0)")) + 1).cast("long")


def _pairs(tile: pd.DataFrame) -> pd.DataFrame:
    """One tile: what each two of its sources differ in over the block's terms; with the first block, as if they had none of all others."""
    marks, terms = tile.loc[tile["slot"] < 0].sort_values("name"), tile.loc[tile["slot"] >= 0]
    block, low, high = (tile[c].iloc[0] for c in ("block", "low", "high"))
    slots, column = np.unique(terms["slot"].to_numpy(np.int64), return_inverse=True)
    names, none, shares = {}, {}, {}
    for side in {low, high}:
        mine, held = marks.loc[marks["tile"] == side], (terms["tile"] == side).to_numpy()
        names[side], none[side] = mine["name"].to_numpy(object), mine["p"].to_numpy(np.int64)
        shares[side] = np.repeat(none[side][:, None], len(slots), 1)
        shares[side][np.searchsorted(names[side], terms["name"].to_numpy(object)[held]), column[held]] = terms["p"].to_numpy(np.int64)[held]
    others = (int(marks["n_terms"].iloc[0]) if block == 0 else 0) - len(slots)
    found: list[tuple[np.ndarray, ...]] = [(names[low][:0], names[high][:0], none[low][:0])]
    for k in range(len(names[low])):
        rest = slice(k + 1 if low == high else 0, None)  # a pair once
        apart = np.abs(shares[high][rest] - shares[low][k]).sum(1) + others * np.abs(none[high][rest] - none[low][k])
        found.append((np.repeat(names[low][k : k + 1], len(apart)), names[high][rest], apart))
    one, two, value = map(np.concatenate, zip(*found, strict=True))
    return pd.DataFrame({"lang": np.full(len(value), tile["lang"].iloc[0], object), "one": one, "two": two, "value": value})


def pair_values(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """groups (lang, source, none, n_terms) and shares (lang, source, slot, p) to (lang, one, two, value), each two sources of a language once.

    Two sources differ alike in all terms that neither has, so only terms that a tile's sources have are looked at.
    """
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_terms") / BLOCK)).cast("int")
    placed = groups.join(tiles, "lang").select("*", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile"), blocks.alias("blocks"))
    marks = placed.select("lang", "source", "tiles", "tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(-1).cast("long").alias("slot"), F.col("none").alias("p"), "n_terms")
    block = F.pmod(F.xxhash64("slot"), F.col("blocks")).cast("int")
    terms = _with_groups(shares.select("lang", "source", "slot", "p"), placed).select("lang", "source", "tiles", "tile", block.alias("block"), "slot", "p", "n_terms")
    rows = marks.union(terms).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    ends = F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")
    dealt = rows.select("lang", "block", *ends, "tile", F.col("source").alias("name"), "slot", "p", "n_terms")
    sums = dealt.groupBy("lang", "block", "low", "high").applyInPandas(_pairs, "lang string, one string, two string, value long")
    return sums.select("lang", F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two"), "value").groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows and what groups says of their lang and source; a table (see materialise) of up to BROADCAST_ROWS groups is broadcast, as a group may have very many rows."""
    few = groups.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(groups) if few else groups, ["lang", "source"])


def divergences(docs: DataFrame) -> DataFrame:
    """documents to (lang, source, part, item, value, rank)."""
    rows = named(docs)
    counts = group_counts(rows, shards_of(rows))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    kept = materialise(kept.withColumn("slot", F.monotonically_increasing_id()), "divergence-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    groups = rows.select("lang", "source").distinct()
    zero, total, n_terms = F.lit(0).cast("long"), F.col("total"), F.col("n_terms")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "n_terms", "lang_total"])
    groups = materialise(groups.withColumn("none", F.when(n_terms > 0, share(zero, total, n_terms)).otherwise(zero)), "divergence-groups")

    known = _with_groups(counts.join(kept, ["lang", "term"]), groups)
    p, q = share(F.col("n"), total, n_terms), share(F.col("lang_n"), F.col("lang_total"), n_terms)
    shares = materialise(known.select("lang", "source", "term", "slot", p.alias("p"), q.alias("q")), "divergence-shares")

    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(groups, shares)
    both = pairs.select("lang", F.col("one").alias("source"), F.col("two").alias("item"), "value").union(pairs.select("lang", "two", "one", "value"))
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_rank).alias("rank"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= TOP)
    return both.union(terms)


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents
), words AS (
    SELECT row, lang, source, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 30
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), langs AS (
    SELECT lang, count(*) AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang
), groups AS (
    SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL
), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           1 + (1000000000 * (coalesce(c.n, 0)::HUGEINT + 5)) // (g.total + 5 * l.v) AS p, 1 + (1000000000 * (k.lang_n::HUGEINT + 5)) // (l.lang_total + 5 * l.v) AS q
    FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
