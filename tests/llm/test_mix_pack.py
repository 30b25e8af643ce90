"""Mixing, packing and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from fieldloom.llm import language_id, mixing, packing, quality, simhash

SCHEMA = "doc_id long, text string, source string, size string, draw string"
WORDS = packing.Words(packing.default_vocabulary())


def plain_targets(sizes):
    """Levelling, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, Fraction(3, 2) * sum(sizes.values()), set(names)
    while free:
        level = Fraction(left) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        target |= {s: Fraction(2 * sizes[s]) for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 100, "b": 1, None: 5, "B": 7, "é": 0}, {str(i): i * i for i in range(12)}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx({s: float(t) for s, t in plain_targets(sizes).items()})


def test_mix_equals_sql_and_meets_targets(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = mixing.op6_mixing(spark, sf)
    rel = con.sql(mixing.OP6_SQL)
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())
    sums = df.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"})
    for r in sums.collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"]
    assert df.where("taken > 2 * size").isEmpty()


def test_mix_rows_and_odd_cases(spark):
    rows = [(i, "w " * (i % 7), ("a", None, "b")[i % 3], "x", "y") for i in range(60)] + [(3, "w w w", "a", "x", "y"), (None, None, "c", "x", "y"), (None, None, "c", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    report = mixing.mix_report(df)
    copies = defaultdict(int)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    for r in mixed.collect():
        copies[r["doc_id"], r["text"]] += 1
    taken = defaultdict(int)
    for r in report.collect():
        taken[r["doc_id"]] += r["taken"]
    by_doc = defaultdict(int)
    for (i, t), n in copies.items():
        by_doc[i] += n * len((t or "").split())
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in by_doc.items() if n}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix_report(df.limit(0)).count() == 0


def test_sources_of_repeated_ids_and_very_long_texts_meet_their_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(7, " ".join(["w"] * int(n)) + f" {k}", "a", "x", "y") for k, n in enumerate(rng.integers(5, 15, 600))] + [(None, f"{k} " * 9, "a", "x", "y") for k in range(400)]
    rows += [(k, "some words here " * 4, "b", "x", "y") for k in range(2000)] + [(9000, "w " * 200_000, "c", "x", "y"), (9001, "w " * 90_000, "c", "x", "y")]
    report = mixing.mix_report(spark.createDataFrame(rows, SCHEMA)).collect()
    by_source = defaultdict(list)
    for r in report:
        by_source[r["source_size"]].append(r)
    for size, mine in by_source.items():
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine) + size // 1000
        assert all(r["taken"] <= 2 * r["size"] for r in mine)


def check_packing(rows, texts):
    """rows as returned for texts by doc_id; ids against the tokenizer's own."""
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        cut = [(k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
        assert sorted(set(by_doc[i])) == cut
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by_seq), -(-sum(r["length"] for r in rows) // 2048)


def test_pack_whole_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    used, least = check_packing(packing.op10_packing(spark, sf).collect(), texts)
    assert used <= least + 1


def test_pack_odd_rows(spark):
    texts = {1: None, 2: "", 3: " lead and trail \n", 4: "0 zero 00 a0b", 5: "ÀÉ İΣς ﬁ漢字 é x\x85y\x1fz", 6: "<|endoftext|> it's WE'LL don't<|endoftext|><|ENDOFTEXT|>", 7: "word, " * 9000, 8: "☃ " * 10}
    df = spark.createDataFrame([(i, t, "s", "x", "y") for i, t in texts.items()] + [(8, texts[8], "s", "x", "y")], SCHEMA)
    rows = packing.pack_documents(df, keep_ids=True).collect()
    check_packing(rows, texts)
    assert sum(r["doc_id"] == 8 for r in rows) == 2 and all(len(r["ids"]) == r["length"] for r in rows)
    assert packing.pack_documents(df.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 2047), min_size=1, max_size=60), st.integers(0, 5))
def test_evolved_packings_are_whole(sizes, seed):
    one = packing.evolve(sizes, [], seed)
    two = packing.evolve(sizes, [one, packing.evolve(sizes, [], seed + 1)], seed)
    for bins in (one, two):
        assert np.bincount(bins, sizes).max() <= 2048 and len(bins) == len(sizes) and set(bins) == set(range(bins.max() + 1))
    assert two.max() <= one.max()


def plain_best_fit(sizes):
    """Best fit by decreasing size, bin by bin."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= size]
        if fits:
            at = min(fits, key=rooms.__getitem__)
            rooms[at] -= size
        else:
            rooms.append(2048 - size)
    return rooms


@pytest.mark.parametrize("low,high", [(600, 1100), (500, 900)])
def test_the_genetic_algorithm_betters_best_fit_where_that_misses_the_bound(low, high):
    sizes = np.random.default_rng(5).integers(low, high, 1500)
    plain = plain_best_fit(sizes.tolist())
    assert packing.cost(packing.decreasing(sizes, np.random.default_rng(0), 0.0), sizes) == pytest.approx((len(plain), -sum((1 - r / 2048) ** 2 for r in plain)))
    islands = [packing.evolve(sizes, [], k) for k in range(3)]
    islands = [packing.evolve(sizes, [islands[k], islands[k - 1]], 3 + k) for k in range(3)]
    assert min(p.max() + 1 for p in islands) < len(plain)


def test_every_group_is_bred(spark, sf, monkeypatch):
    calls = []
    plain = packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: calls.append(1) or plain(*a))
    sizes = np.full(64, 512)  # best fit reaches the bound at once
    assert packing.evolve(sizes, [], 1).max() + 1 == 16 and len(calls) == packing.GENERATIONS


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>"]), st.text(st.sampled_from("aZéÉßÿ÷×'.,*|0\u0301 \n\x85漢<>İst"), max_size=30)), max_size=3).map("".join), min_size=1, max_size=4))
def test_ids_word_by_word_are_the_tokenizers(texts):
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    got = [x.tolist() for x in WORDS.encode(pa.array(texts, pa.string()))]
    assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_stages_get_texts_in_small_batches(spark, sf, monkeypatch):
    seen, name = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def stage(spark, docs, sf_dir):
        seen.append(int(spark.conf.get(name)))
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    assert corpus_pipeline.run(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert seen and max(seen) <= 1000 and spark.conf.get(name) == before


def test_packing_gets_texts_in_small_batches(spark, tmp_path, monkeypatch):
    slices = packing.slices

    def seen(batch):
        (tmp_path / f"{batch.num_rows}-{batch.column('text')[0].as_py()[:9].strip()}").write_text(str(batch.nbytes))
        return slices(batch)

    monkeypatch.setattr(packing, "slices", seen)
    docs = spark.createDataFrame([(i, f"text{i} " + "of words " * 60_000) for i in range(24)], "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert packing.pieces(docs).agg({"length": "sum"}).first()[0] == sum(len(x) for x in WORDS.encode(pa.array([r["text"] for r in docs.collect()])))
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(sizes) > 24 * 540_000 and max(sizes) <= 2 * packing.TEXTS
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_remembered_words_are_bounded():
    words = packing.Words(packing.default_vocabulary())
    for k in range(4):
        texts = [" ".join(f"w{k}x{i}y" for i in range(a, a + 1000)) for a in range(0, 120_000, 1000)]
        for text, ids in zip(texts, words.encode(pa.array(texts)), strict=True):
            last = text, ids.tolist()
        assert last[1] == [*WORDS.whole.encode(last[0], add_special_tokens=False).ids, 0]
        assert len(words.number) <= 340_000  # a worker's memory grows with them



def test_any_other_tokenizer_is_asked_for_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  World\n", "", "it's ÀÉ <|endoftext|> x", "ALL caps"]
    got = [x.tolist() for x in packing.Words(path).encode(pa.array([*texts, None]))]
    tokenizer = Tokenizer.from_file(path)
    assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in [*texts, ""]]


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(1)
    sizes = rng.integers(100, 1500, 200)
    a, b = packing.decreasing(sizes, rng, np.inf), packing.decreasing(sizes, rng, 0.0)
    for _ in range(50):
        child = packing.crossover(a, b, sizes, rng)
        fill = np.bincount(child, sizes)
        assert len(child) == 200 and child.min() == 0 and fill.min() > 0 and fill.max() <= 2048
        a, b = b, child


def plain_near_dups(texts):
    """Groups (a number for each text) of those that share 0.8 of their 5-word shingles, by all pairs."""
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and (x == sets[j] or len(x & sets[j]) / len(x | sets[j]) >= 0.8):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def test_pipeline_against_brute_force(spark, sf):
    """Each stage on its own input, then the whole run; the models are the operators', their decisions are taken text by text."""
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert [n.split()[0] for n in names] == ["quality", "language", "SimHash", "mixing", "best-fit"]
    stages = dict(corpus_pipeline.STAGES)

    def after(name, rows):
        return sorted(map(tuple, stages[name](spark, spark.createDataFrame(rows, schema), sf).collect()), key=str)

    def same(name, rows, want):
        assert after(name, [tuple(d.values()) for d in rows]) == sorted((tuple(d.values()) for d in want), key=str), name
        return want

    model = quality.train(spark.createDataFrame([tuple(d.values()) for d in docs], schema), spark.read.parquet(f"{sf}/labels.parquet"))
    good = same(names[0], docs, [d for d in docs if model.score(np.array([quality.features(d["text"])]))[0] >= 0.3])
    langs = language_id.train(spark.createDataFrame([tuple(d.values()) for d in good], schema))
    found = [langs.predict(d["text"]) for d in good]
    known = same(names[1], good, [d for d, (lang, _, ambiguous) in zip(good, found) if lang != "und" and not ambiguous])
    groups, first = plain_near_dups([d["text"] for d in known]), {}
    for g, d in zip(groups, known):
        first[g] = min(first.get(g, d), d, key=lambda x: x["doc_id"])
    alone = same(names[2], known, list(first.values()))
    assert len(docs) > len(good) >= len(known) > len(alone)

    by_source, size = defaultdict(list), {d["doc_id"]: len((d["text"] or "").split()) for d in alone}
    for d in alone:
        draw = int(hashlib.md5(f"mix-{d['doc_id']}-{hashlib.md5((d['text'] or '').encode()).hexdigest()}".encode()).hexdigest()[:8], 16) % 4096
        by_source[d["source"]].append((draw, size[d["doc_id"]], d))
    goals, mixed = plain_targets({s: sum(n for _, n, _ in rows) for s, rows in by_source.items()}), []
    for s, rows in by_source.items():
        total = sum(n for _, n, _ in rows)
        base = int(goals[s] // total) if total else 0
        cuts = {0} | {draw + 1 for draw, _, _ in rows}
        below = min(cuts, key=lambda c: (abs(sum(n for draw, n, _ in rows if draw < c) - (goals[s] - base * total)), c))
        mixed += [d for draw, _, d in rows for _ in range(base + (draw < below))]
    same(names[3], alone, mixed)

    copies = Counter(d["doc_id"] for d in mixed)
    rows = corpus_pipeline.run(spark, sf).collect()
    check_packing(rows, {d["doc_id"]: d["text"] for d in mixed})
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == copies


def test_pipeline_odd_rows(spark, sf, tmp_path):
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, words[0], "en", None, 9), (None, words[1], "en", "s", 9), (None, words[1], "en", "s", 9), (4, words[2], None, "s", 9), (4, words[3], "en", "s", 9), (5, words[0] + " z", "en", "s", 9), (6, "long " * 300_000, "en", "s", 9)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, row int, score double, base int, draw int, name string"
    df = spark.createDataFrame([(*r, 1, 0.5, 2, 3, "x") for r in rows], columns)
    labels = spark.read.parquet(f"{sf}/labels.parquet").limit(0)
    for name, table in (("rows", df), ("none", df.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            docs = function(spark, docs, f"{tmp_path}/{name}")
            assert docs.columns == df.columns, stage
            docs = spark.createDataFrame(docs.collect(), df.schema)
            if stage.startswith("language") and name == "rows":
                assert sorted(((r["doc_id"], r["text"][:4]) for r in docs.collect()), key=str) == sorted([(3, "a0 a"), (None, "b0 b"), (None, "b0 b"), (4, "c0 c"), (4, "d0 d"), (5, "a0 a"), (6, "long")], key=str)
            if stage.startswith("SimHash") and name == "rows":
                assert sorted(((r["doc_id"], r["text"][:4]) for r in docs.collect()), key=str) == sorted([(3, "a0 a"), (None, "b0 b"), (4, "c0 c"), (4, "d0 d"), (6, "long")], key=str)
        packed = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_columns_of_any_name_are_carried(spark):
    docs = spark.createDataFrame([(k, f"some words {k}", "en", "s", 1.0, 2, 3, "x") for k in range(9)], "doc_id long, text string, lang string, source string, _mix_copy double, copies int, `a.b` int, found string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for got in (mixing.mix(docs), language_id.keep_known(docs), quality.keep_good(docs, labels), simhash.keep_one(docs)):
        assert got.columns == docs.columns and got.count() > 0
