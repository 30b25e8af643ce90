"""I-Match, language ID and the quality model."""

import math
import zlib
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import imatch, language_id, quality

SCHEMA = "doc_id long, text string, lang string, score double, part int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.0, 1) for i, t, lang in rows], SCHEMA)


def edited(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def plain_parts(terms):
    """For each level the hash of the terms (in order) of each of 8 cells, by the upper half of their hashes."""
    hashes, out = [xxhash.xxh3_64_intdigest(t.encode()) for t in terms], []
    for level in range(30):
        cells = [[h for h in hashes if (h >> 32) % (8 << level) == c] for c in range(8)]
        if not any(cells):
            break
        out += [xxhash.xxh32_hexdigest(b"".join(h.to_bytes(8, "little") for h in c), level)[:6] if c else "-" for c in cells]
    return out + ["-"] * (64 - len(out))


def plain_fingerprint(text, in_band):
    terms = sorted(set(text.lower().split()), key=lambda t: xxhash.xxh3_64_intdigest(t.encode()))
    inside = [t for t in terms if t in in_band]
    weight = min(255, int(255 * (len(inside) / len(terms)) / 0.25)) if terms else 255
    return plain_parts(inside), weight, plain_parts(terms)


def plain_likeness(a, b):
    def alike(x, y):
        equal = either = 0
        for level in range(max(len(x), len(y)) // 8 - 1, -1, -1):
            cells = [((x[8 * level + c :] or ["-"])[0], (y[8 * level + c :] or ["-"])[0]) for c in range(8)]
            cells = [c for c in cells if c != ("-", "-")]
            if len(cells) <= 6 or not either:
                equal, either = equal + sum(p == q for p, q in cells), either + len(cells)
        return equal / either if either else 1.0

    weight = min(a[1], b[1]) / 255
    return weight * alike(a[0], b[0]) + (1 - weight) * alike(a[2], b[2])


def test_imatch_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in imatch.op7_imatch(spark, sf).collect()}
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    n = len(rows)
    df = Counter(term for _, t in rows for term in set(t.lower().split()))
    in_band = {t for t, c in df.items() if n / 10_000 <= c <= max(1, n / 20)}
    assert imatch.lexicon(docs).terms.tolist() == sorted(xxhash.xxh3_64_intdigest(t.encode()) for t in in_band) and len(got) == n
    prints = [plain_fingerprint(t, in_band) for _, t in rows]
    joined = lambda f: "".join([*f[0], f"/{f[1]:02x}", *f[2]])
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % n][1]
        change = edited(t, after)
        theirs = plain_fingerprint(change, in_band)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha256(change.encode()).hexdigest())
        assert r["fingerprint"] == joined(prints[k]) and r["edited_fingerprint"] == joined(theirs)
        assert r["near_edited"] == pytest.approx(plain_likeness(prints[k], theirs)) and r["near_next"] == pytest.approx(plain_likeness(prints[k], prints[(k + 1) % n]))
    near = np.array([(r["near_edited"], r["near_next"]) for r in got.values()])
    assert near[:, 0].mean() > 0.2 > 0.1 > near[:, 1].mean()


def test_imatch_next_of_large_ids_beside_nulls(spark):
    big = (1 << 53) + 1
    rows = [(big + 2 * k, f"text {k} of many words", None) for k in range(40)] + [(None, "no id here", None), (-(1 << 63), "the least id", None)]
    got = {r["doc_id"]: r["edited_sha256"] for r in imatch.fingerprints(table(spark, rows).repartition(3)).collect()}
    order = sorted(r[:2] for r in rows if r[0] is not None)
    for k, (i, t) in enumerate(order):
        assert got[i] == sha256(edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()
    assert got[None] == sha256(edited("no id here", order[0][1]).encode()).hexdigest()


def in_order(row):
    """Rows without a doc_id first, then by doc_id, those of one by a hash of the text."""
    return row[0] is not None, row[0] or 0, xxhash.xxh64_intdigest((row[1] or "").encode(), 42) >> 1


@pytest.mark.parametrize("seed", range(3))
def test_imatch_next_of_hot_ids_nulls_and_repeated_rows(spark, seed):
    rng = np.random.default_rng(seed)
    ids = [[1, None, 5, -3], [None], [7, 7, None]][seed]
    rows = [(ids[rng.integers(len(ids))], f"text {rng.integers(20)} of many words") for _ in range(150)] + [(int(k), f"other {k}") for k in range(20, 50)] * (seed < 2) + [(1, "the same")] * 60
    got = Counter((r["doc_id"], r["edited_sha256"]) for r in imatch.fingerprints(table(spark, [(*r, None) for r in rows]).repartition(4)).collect())
    order = sorted(rows, key=in_order)
    first = next((r for r in order if r[0] is not None), order[0])
    want = Counter((i, sha256(edited(t, after).encode()).hexdigest()) for (i, t), (_, after) in zip(order, [*order[1:], first], strict=True))
    assert got == want


def test_hot_ids_fill_parts_of_their_own():
    ranges = imatch.Ranges(np.array([3, 7, 7, 7, 9]), 2)
    share = np.array([(2**63 - 1) * k // 8 for k in range(9)])
    part = lambda named, i: ranges.part(np.full(9, named), np.full(9, i), share).tolist()
    assert part(False, 0) == [0] * 4 + [1] * 5 and part(True, 7) == [4] * 3 + [5] * 3 + [6] * 3
    assert part(True, 2) == [2] * 9 and part(True, 3) == part(True, 6) == [3] * 9 and part(True, 8) == [6] * 9 and part(True, 9) == [7] * 9
    assert ranges.hot and not imatch.Ranges(np.array([1, 2]), 0).hot


def test_imatch_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(300_000))
    rows = {r["doc_id"]: r for r in imatch.fingerprints(table(spark, [(1, long, None), (2, "short", None), (3, long, None)])).collect()}
    assert rows[1]["n_chars"] == len(long) and rows[1]["fingerprint"] == rows[3]["fingerprint"] != rows[2]["fingerprint"]
    assert rows[3]["near_next"] == 1.0 and rows[1]["edited_sha256"] == sha256(edited(long, "short").encode()).hexdigest()


def test_imatch_odd_rows(spark):
    rows = [(5, "b c d", None), (1, None, None), (3, "xéy \U0001f600 z", None), (3, "a", None), (None, "n", None), (9, "b c d", None)]
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in imatch.fingerprints(table(spark, rows)).collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    order = sorted([(None, "n"), (1, ""), (3, "a"), (3, "xéy \U0001f600 z"), (5, "b c d"), (9, "b c d")], key=in_order)
    want = [(i, len(t), sha256(edited(t, a).encode()).hexdigest()) for (i, t), (_, a) in zip(order, [*order[1:], order[1]], strict=True)]
    assert sorted(map(str, (g[:3] for g in got))) == sorted(map(str, want))
    assert got[4][3] == got[5][3]
    one = imatch.fingerprints(table(spark, [(1, "abcd", None)])).first()
    assert one["edited_sha256"] == sha256(b"abab").hexdigest()
    assert imatch.fingerprints(table(spark, [])).count() == 0


ODD_TEXTS = ["", " ", "a", "ab", "a b", " x", "x ", "ΑΣ ΑΣ. Σ", "İx yİ", "\x1c\x1dq", "abc def ghi", "\xa0É é", "one two  three\tfour " * 9, " ".join(f"w{k}" for k in range(3000)), "b"]


def test_imatch_of_many_texts_at_once():
    """A batch's fingerprints are those of its texts alone, and likeness too, whatever the others' lengths."""
    for lexicon in (imatch.Lexicon(), imatch.Lexicon(np.sort(imatch.word_hashes(["a", "x", "é", *(f"w{k}" for k in range(0, 3000, 7))])))):
        prints = imatch.Prints.of([imatch.word_hashes(t.lower().split()) for t in ODD_TEXTS], lexicon)
        alone = [imatch.fingerprint(t, lexicon) for t in ODD_TEXTS]
        assert prints.strings().to_pylist() == ["".join(x) for x in alone]
        at = np.arange(len(ODD_TEXTS))
        for k in at:
            both = imatch.likenesses(prints, prints.take(np.full(len(at), k)))
            assert both.tolist() == [imatch.likeness(x, alone[k]) for x in alone]


def test_imatch_edited_text_takes_the_hashes_of_both(monkeypatch):
    """Only words at the cuts are hashed anew."""
    words, hashed = imatch.word_hashes, []
    known = [words(t.lower().split()) for t in ODD_TEXTS]
    monkeypatch.setattr(imatch, "word_hashes", lambda found: words([hashed.append(w) or w for w in found]))
    for text, mine in zip(ODD_TEXTS, known):
        for after, its in zip(ODD_TEXTS, known):
            change, got = imatch.edited_hashes(text, mine, after, its)
            assert change == edited(text, after) and set(got.tolist()) == set(words(change.lower().split()).tolist())
            assert len(hashed) <= 3
            hashed.clear()


def test_likeness_bounds():
    assert imatch.likeness(["-"] * 64, ["-"] * 64) == 1.0
    assert imatch.likeness(["a"] * 64, ["a"] * 64) == 1.0
    assert imatch.likeness(["a"] * 64, ["b"] * 64) == 0.0


@pytest.mark.parametrize("n", [30, 1000, 5000, 20_000])
def test_imatch_likeness_of_texts_of_any_length(n):
    every, half, few = imatch.Lexicon(), [], []
    for seed in range(40):
        words = [f"{seed}w{k}" for k in range(n)]
        mine = imatch.fingerprint(" ".join(words), every)
        half.append(imatch.likeness(mine, imatch.fingerprint(" ".join([*words[n // 2 :], *(f"{seed}v{k}" for k in range(n // 2))]), every)))
        few.append(imatch.likeness(mine, imatch.fingerprint(" ".join([*words[n // 50 :], *(f"{seed}v{k}" for k in range(n // 50))]), every)))
        assert imatch.likeness(mine, imatch.fingerprint(f"{seed}v1", every)) == 0
    assert 0.2 < np.mean(half) < 0.4 and np.mean(few) > 0.85


def test_imatch_copies_that_fill_a_third_of_the_table(spark):
    group = [f"g{k}" for k in range(200)]
    rows = [(i, " ".join([*group, f"own{i}"] if i >= 50 and i < 100 else group), None) for i in range(100)]  # copies, then near copies
    rows += [(i, " ".join(f"{i}w{k}" for k in range(200)), None) for i in range(100, 300)]
    got = {r["doc_id"]: r for r in imatch.fingerprints(table(spark, rows)).collect()}
    assert all(got[i]["near_next"] == 1 for i in range(49))
    assert min(got[i]["near_next"] for i in range(49, 99)) > 0.5 and np.mean([got[i]["near_next"] for i in range(49, 99)]) > 0.9
    assert got[99]["near_edited"] > 0.1 > got[99]["near_next"]  # its next text is a stranger
    assert max(got[i]["near_next"] for i in range(99, 300)) == 0


def plain_ngrams(text):
    points = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
    points = [p for k, p in enumerate(points) if p != 32 or k == 0 or points[k - 1] != 32]
    two = [(a * 0x9E3779B1 + b * 0x85EBCA6B) % 2**32 for a, b in zip(points, points[1:])]
    return [h >> 17 for h in [*two, *((h * 0x27D4EB2F + c * 0xC2B2AE35) % 2**32 for h, c in zip(two, points[2:]))]]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aB é漢1. \nİΣσ"), max_size=60), st.sampled_from([1, 2, 3, 5, 7, 1 << 20]))
def test_ngrams_are_the_same_in_blocks(text, size):
    language_id.BLOCK, kept = size, language_id.BLOCK
    try:
        got = np.concatenate([*language_id.ngrams(text), np.array([], np.uint32)])
    finally:
        language_id.BLOCK = kept
    assert sorted(got.tolist()) == sorted(plain_ngrams(text) if text else [])


def test_language_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    counts = {}
    for r in docs:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None:
            counts.setdefault(r["lang"], Counter()).update(plain_ngrams(r["text"]))
    languages = sorted(counts)
    code = language_id.codewords(len(languages)).tolist()
    shares = [{f: (n + 0.5) / (sum(counts[k].values()) + 0.5 * (1 << 15)) for f, n in counts[k].items()} for k in languages]
    none = [0.5 / (sum(counts[k].values()) + 0.5 * (1 << 15)) for k in languages]
    got = {r["doc_id"]: r for r in language_id.op4_language_id(spark, sf).collect()}
    assert len(got) == len(docs)

    def weight(feature, bit):
        sides = [[s.get(feature, z) for s, z, c in zip(shares, none, code) if c[bit] == side] for side in (0, 1)]
        return math.log((sum(sides[1]) / len(sides[1])) / (sum(sides[0]) / len(sides[0])))

    weight = lru_cache(None)(weight)
    for r in docs:
        grams = plain_ngrams(r["text"] or "")
        if not any(map(str.isalpha, r["text"] or "")):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        loss = [0.0] * len(languages)
        for bit in range(len(code[0])):
            evidence = sum(weight(f, bit) * n for f, n in Counter(grams).items()) / len(grams) * min(len(grams), 48)
            for k, word in enumerate(code):
                loss[k] += math.log1p(math.exp(evidence * (1 - 2 * word[bit])))
        odds = [math.exp(min(loss) - x) for x in loss]
        mine = got[r["doc_id"]]
        assert mine["score"] == pytest.approx(max(odds) / sum(odds), abs=1e-4)
        assert mine["lang_pred"] == languages[loss.index(min(loss))] or sorted(odds)[-2] > 0.99


def test_rare_labels_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "RAREST", 0.3)
    rows = [(k, t, lang) for lang, t, n in (("en", "the cat", 3), ("fr", "été", 2), ("dirty", "zz", 1)) for k in range(n)]
    assert language_id.train(table(spark, rows)).languages == ["en", "fr"]


def test_three_hundred_languages_are_learned(spark, monkeypatch):
    """Languages of words of their own letters; each is named for its documents, whatever the blocks of languages it is learned in."""
    rng = np.random.default_rng(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:03}": ["".join(rng.choice(list(rng.permutation(list(letters))[:9]), 5)) for _ in range(12)] for k in range(300)}
    rows = [(100 * k + j, " ".join(rng.choice(words[lang], 60)), lang) for k, lang in enumerate(words) for j in range(4)]
    model = language_id.train(table(spark, rows))
    assert model.languages == sorted(words)
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 37)
    again = language_id.train(table(spark, rows))
    assert again.languages == model.languages and np.allclose(again.weights, model.weights, atol=1e-5)
    asked = [(k, " ".join(rng.choice(words[lang], 60)), None) for k, lang in enumerate(words)]
    got = {r["doc_id"]: r for r in language_id.identify(table(spark, asked), model).collect()}
    assert np.mean([got[k]["lang_pred"] == lang for k, lang in enumerate(words)]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 12, 40, 300, 3000])
def test_codewords_are_distinct_and_apart(n):
    code = language_id.codewords(n)
    signs = 2.0 * code - 1
    apart = ((code.shape[1] - signs @ signs.T) / 2)[np.triu_indices(n, 1)].min()
    assert apart >= (1 if n < 3 else 2 if n == 3 else 4 if n == 4 else 5) and code.shape[1] <= max(16, 10 * math.log2(n) + 1)


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in language_id.op4_language_id(spark, sf).collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in got if got[i]["held_out"]} == set(held)
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_odd_rows(spark):
    words = {"en": "the cat and the dog thing with", "fr": "été où les eaux qui être ça", "xx": "zuku wuka kuzu wakazu"}
    rows = [(i, w, k) for k, w in words.items() for i in range(5)]
    model = language_id.train(table(spark, [*rows, (7, None, "en"), (8, "the", None)]))
    asked = [(1, None, None), (2, "", "en"), (3, "12 !? \n", "en"), (4, "the dog", "fr"), (5, "wakazu " * 3000, None), (5, "wakazu " * 3000, None)]
    got = language_id.identify(table(spark, asked), model)
    assert set(got.columns) == {"doc_id", "text", "lang", "part", "lang_pred", "score", "ambiguous"}
    assert [r["lang_pred"] for r in got.orderBy("doc_id").collect()] == ["und", "und", "und", "en", "xx", "xx"]
    kept = language_id.keep_known(table(spark, [*rows, *asked]))
    assert kept.columns == ["doc_id", "text", "lang", "score", "part"] and kept.where("text is null").count() == 0
    none = language_id.train(table(spark, [(1, "a", None)]))
    assert [r["lang_pred"] for r in language_id.identify(table(spark, asked), none).collect()] == ["und"] * 6
    one = language_id.train(table(spark, [(1, "a", "en")]))
    assert language_id.identify(table(spark, [(1, "b", None)]), one).first()["score"] == 1.0
    assert language_id.identify(table(spark, []), one).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.op8_quality(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())


def plain_features(text):
    data = (text or "").encode()
    words, size = data.split(), max(1, len(data))
    n = max(1, len(words))
    of = lambda wanted: sum(c in wanted for c in data)
    upper, lower, digit, high, white = (of(range(*r)) for r in ((65, 91), (97, 123), (48, 58), (128, 256), (9, 14)))
    white += of(b" ")
    marks = of(b"!#$%&*+/<=>@[]^_`{|}~\\")
    return [
        math.log1p(len(data)), math.log1p(len(words)), min(30.0, (size - white) / n), upper / max(1, upper + lower + high), digit / size, of(b".,;:'\"?-()") / n, marks / n,
        of(b"|") / n, of(b"!") / n, math.log1p(len(words) / (of(b"\n") + 1)), marks / size, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, high / size,
        upper / n, of(b".") / n, white / size,
    ]


def test_quality_whole_table_against_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where(~language_id.held_out(5, 0)))
    got = {r["doc_id"]: r["score"] for r in quality.op8_quality(spark, sf).collect()}
    for r in docs.collect():
        x = plain_features(r["text"])
        assert x == pytest.approx(list(quality.features(r["text"])))
        x = quality.features(r["text"])  # equal but for rounding, which may decide a bin
        total = model.base + sum(t[bisect_right(e, v)] for t, e, v in zip(model.tables, model.edges, x))
        total += sum(t[bisect_right(model.coarse[i], x[i])][bisect_right(model.coarse[j], x[j])] for (i, j), t in model.pairs.items())
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-total)))


def test_a_tree_is_the_best_of_all_cuts():
    rng = np.random.default_rng(3)
    gain = lambda g, h: g * g / (h + 1)
    for _ in range(20):
        g, h = rng.standard_normal(12), rng.random(12)
        first = max(range(1, 12), key=lambda c: gain(g[:c].sum(), h[:c].sum()) + gain(g[c:].sum(), h[c:].sum()))
        table = quality._tree(g, h)
        cuts = [k for k in range(1, 12) if table[k] != table[k - 1]]
        assert first in cuts and len(cuts) <= 2
        for a, b in zip([0, *cuts], [*cuts, 12]):
            assert table[a:b] == pytest.approx(g[a:b].sum() / (h[a:b].sum() + 1))


def test_repeated_documents_and_labels_train_once(spark):
    docs = table(spark, [(1, "good words here", None)] * 50 + [(2, "! ! !", None), (1, "other", None)])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0)] + [(2, 0)] * 40, "doc_id long, quality int")
    seen = []
    kept, quality.Gam = quality.Gam, lambda x, y: seen.append((len(x), y.tolist())) or kept(x, y)
    try:
        quality.train(docs, labels)
    finally:
        quality.Gam = kept
    assert seen == [(2, [1.0, 0.0])]


def test_gam_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)  # no feature tells anything alone
    model = quality.Gam(x[:3000], y[:3000])
    assert (2, 5) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_quality_odd_rows(spark):
    docs = table(spark, [(1, None, None), (2, "", None), (3, "word " * 50_000, None), (3, "word " * 50_000, None), (None, "x", None)])
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (3, 1, 1)], "doc_id long, quality int, text int")
    model = quality.train(docs, labels)
    scores = [r["s"] for r in quality.scored(docs, model, "s").collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    none = quality.train(docs, labels.limit(0))
    assert {r["s"] for r in quality.scored(docs, none, "s").collect()} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.scored(docs.limit(0), none, "s").count() == 0
