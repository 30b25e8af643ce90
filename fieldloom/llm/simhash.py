"""SimHash near-dedup: fingerprints of word shingles, linked through one-wildcard segment variants.

A fingerprint is cut into few segments, so that two linked ones differ in at most one bit of some
segment, or of some segments taken together. Each goes out once for every bit of a segment, with
that bit ignored; equal variants meet by a shuffle and are verified over all bits.

Rules: EXACT is op9's (64 bits, 4-word shingles, links at 4 or fewer differing bits); its segments
miss no link. SIMILAR is for texts that share 0.8 or more of their distinct 5-word shingles (their
Jaccard similarity): 128 bits, of which such texts differ in about 19, so candidates need another kind
of segments, see Rule. They are pairs of up to 29 bits, and link if their sets of shingles, compared
whole, are that similar. Under each key a text's candidates are its nearest ones and its hub, the one that
most others there are near to: a family of copies of one text, each edited elsewhere, is similar to
that text and not to each other, and the nearest by chance are others. Hubs are compared first; what a failed comparison
leaves apart is compared with the best linked text of the other's component, a few times. What that leaves between components
is found exactly: two sets so similar share one of their rarest shingles (a prefix filter), and all pairs of
different components that do are compared, so keep_one misses no link, whatever the fingerprints missed. They are compared
first by bitmaps of their shingles, which bound from above what two sets share; whole sets move for what is left only.

Cases: null and empty texts have fingerprint zero and link like any other; repeated rows share
a fingerprint and so a component; rows with a null doc_id get a component but never name one,
and are kept like any other by keep_one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import connected_components, discard, materialise, star_edges

SEED = 42
#: Shingles that vote at a time, so that one very long text needs bounded memory.
BLOCK = 255 * 256
#: Keys of more fingerprints than about this are dealt into pieces, each pair of pieces compared on its own.
PIECE = 8192
#: One in so many fingerprints is counted to find such keys.
COUNTED = 16
#: At least so many bits in a key; from there on it grows with the number of fingerprints.
LEAST_KEY = 17


@dataclass(frozen=True)
class Rule:
    """How texts become fingerprints of 64 or 128 bits and when these link.

    Without a recall, segments are such that no link is missed. With one, a segment is a random
    choice of bits, and there are so many of them that two fingerprints differing in an expected
    share of error of their bits meet in some segment with that probability (by simulation), at every
    length of keys. With a similarity, distinct shingles vote, and what lies within so many bits is a
    candidate, which links if the sets of shingles are at least that similar.
    """

    shingle: int
    bits: int
    words: int
    recall: float | None = None
    error: float = 0.0
    longest_key: int = 36
    similarity: float | None = None
    least_key: int | None = None
    shared: int = 1

    def segments(self, n: int) -> list[tuple[int, ...]]:
        """Bits of each segment, for n fingerprints: keys are long enough that about `shared` of them share each by chance."""
        want, size = min(self.longest_key, max(self.least_key or LEAST_KEY, math.ceil(math.log2(max(2, n / self.shared))))), 64 * self.words
        if self.recall is None:
            # Of `parts` segments the best `taken` together differ in one bit at most.
            for taken in range(1, size):
                parts = self.bits // 2 + 1 if taken == 1 else self.bits + taken - 1
                cuts = np.linspace(0, size, parts + 1).round().astype(int)
                if size // parts * taken - 1 >= want or (parts + 1) * 3 > size:
                    return [tuple(b for k in chosen for b in range(cuts[k], cuts[k + 1])) for chosen in combinations(range(parts), taken)]
        rng, out, deck = np.random.default_rng(SEED), [], []
        flips = rng.random((1 << 13, size)) < self.error
        met = np.zeros(len(flips), bool)
        while met.mean() < self.recall:  # all bits in turn, so that segments have as few in common as can be
            if len(deck) < want + 1:
                deck = rng.permutation(size).tolist()
            out.append(tuple(sorted(deck[: want + 1])))
            deck = deck[want + 1 :]
            met |= flips[:, out[-1]].sum(1) <= 1
        return out

    def masks(self, n: int) -> list[tuple[int, ...]]:
        """For each bit of each segment, the segment without that bit, as signed longs, one a word."""
        out = []
        for segment in self.segments(n):
            for wild in segment:
                words = [sum(1 << (b % 64) for b in segment if b != wild and b // 64 == w) for w in range(self.words)]
                out.append(tuple(m - (1 << 64) if m >> 63 else m for m in words))
        return out


EXACT = Rule(shingle=4, bits=4, words=1)
#: Its keys are short: comparing a fingerprint with 64 others costs less than sending the rows that longer keys take.
#: Texts that share 0.8 of their shingles have cosine 0.89, an angle of 0.15 of a half turn: 19 of 128 bits, over 29 in one of 150 cases.
SIMILAR = Rule(shingle=5, bits=29, words=2, recall=0.95, error=0.1515, longest_key=20, similarity=0.8, least_key=13, shared=64)
#: Candidates that each text keeps under a key: its nearest ones, and those that most others are near to.
NEAREST, HUBS = 2, 1
#: Pairs of a batch of keys held at a time.
PAIRS_HELD = 1 << 18
#: Tables of up to so many numbers of rows are broadcast, so that texts stay where they are; longer ones are joined by shuffle.
BROADCAST_ROWS = 4_000_000
#: A set meets so many others in one task, about.
MOST_PAIRS = 1024
#: Times at most that failed candidates are compared with the leaders of components, before all that is left is.
LEADER_ROUNDS = 2
#: Shingles known to be common (most often in one of COUNTED texts) come last where rare ones are wanted; any number of them gives the same links.
COMMON = 1 << 18
#: Texts of a shingle that meet so many others in one task, about.
MET = 4096
#: Bytes of texts that go to Python at a time.
TEXTS = 1 << 22
#: Bits at least of a set's bitmap for each of its shingles (up to twice as many, as it is a power of two).
BITS = 2


def _shingles(text: str | None, size: int) -> tuple[bytes, list[int], list[int]]:
    """The joined words and where each shingle starts and ends in them."""
    words = (text or "").encode().lower().split()
    if not words:
        return b"", [], []
    n = max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    return b" ".join(words), np.concatenate([[0], ends[:-1] + 1])[:n].tolist(), last.tolist()


def _digests_64(parts: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(p, SEED) for p in parts], "<u8")


def _digests_128(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<u8")


def _hashes(text: str | None, rule: Rule) -> Iterator[np.ndarray]:
    """The hashes (XXH64 for one word) of all shingles, repeats included, a block at a time: a row of words each."""
    joined, first, last = _shingles(text, rule.shingle)
    digests = _digests_64 if rule.words == 1 else _digests_128
    for i in range(0, len(first), BLOCK):
        yield digests([joined[s:e] for s, e in zip(first[i : i + BLOCK], last[i : i + BLOCK], strict=True)]).reshape(-1, rule.words)


def distinct(text: str | None, rule: Rule) -> np.ndarray:
    """The hashes of the distinct shingles, told apart and ordered by their first word."""
    found = np.concatenate([np.empty((0, rule.words), "<u8"), *_hashes(text, rule)])
    return found[np.unique(found[:, 0], return_index=True)[1]]


def _majority(blocks: Iterator[np.ndarray], rule: Rule) -> tuple[int, ...]:
    n, votes = 0, np.zeros(64 * rule.words, np.int64)
    for h in blocks:
        bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8 * rule.words), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        votes += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        votes += bits[whole:].sum(0, dtype=np.uint8)
        n += len(h)
    return tuple(np.packbits(votes * 2 > n, bitorder="little").view("<u8").tolist())


def fingerprint(text: str | None, rule: Rule = EXACT) -> tuple[int, ...]:
    """Majority bits of the hashes of all word shingles, repeats included but for a rule of similarity; a number for each word of 64 bits."""
    if rule.similarity is None:
        return _majority(_hashes(text, rule), rule)
    found = distinct(text, rule)
    return _majority((found[i : i + BLOCK] for i in range(0, len(found), BLOCK)), rule)


def _names(rule: Rule) -> list[str]:
    return [f"w{k}" for k in range(rule.words)]


def _fingerprints(rule: Rule) -> Column:
    """A struct of the words w0 (and w1) of the fingerprint of the column text."""
    def run(texts: pd.Series) -> pd.DataFrame:
        found = np.array([fingerprint(x, rule) for x in texts], np.uint64).reshape(-1, rule.words).view(np.int64)
        return pd.DataFrame(found, columns=_names(rule))

    return F.pandas_udf(run, ", ".join(f"{c} long" for c in _names(rule)))("text")


def _described(rule: Rule) -> Column:
    """A struct of the words of the fingerprint of the column text, a hash of its set of shingles, and their number."""
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = distinct(text, rule)
            blocks = (found[i : i + BLOCK] for i in range(0, len(found), BLOCK))
            rows.append((*_majority(blocks, rule), xxhash.xxh3_64_intdigest(found[:, 0].tobytes()), len(found)))
        return pd.DataFrame(np.array(rows, np.uint64).reshape(-1, rule.words + 2).view(np.int64), columns=[*_names(rule), "terms", "size"])

    return F.pandas_udf(run, ", ".join(f"{c} long" for c in (*_names(rule), "terms", "size")))("text")


def _sets(rule: Rule) -> Column:
    """The distinct shingles of the column text, as hashes."""
    return F.pandas_udf(lambda texts: texts.map(lambda x: distinct(x, rule)[:, 0].view(np.int64)), "array<long>")("text")


def spanning_forest(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Numbers of edges that connect all that the edges connect, the nearest ones wherever there is a choice."""
    order = np.lexsort((b, a, far))
    ids, inv = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    root, left, right, kept = np.arange(len(ids)), inv[: len(a)], inv[len(a) :], [order[:0]]
    while True:
        u, v = root[left], root[right]
        open_ = u != v
        if not open_.any():
            return np.concatenate(kept)
        order, left, right, u, v = order[open_], left[open_], right[open_], u[open_], v[open_]
        first, at = np.full(len(ids), len(u)), np.arange(len(u))
        np.minimum.at(first, u, at)
        np.minimum.at(first, v, at)
        best = np.unique(first[first < len(u)])
        kept.append(order[best])
        moved, to = star_edges(u[best], v[best])
        into = np.arange(len(ids))
        into[moved] = to
        root = into[root]


def _close_pairs(group: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest (positions in fp, and the bits they differ in) that connects what lies within so many bits inside each run of equal group numbers."""
    none = np.array([], np.int64)
    found, held = [(none, none, none)], 0
    left, lag = np.nonzero(group[:-1] == group[1:])[0], 1

    def reduced() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edges = tuple(map(np.concatenate, zip(*found, strict=True)))
        kept = spanning_forest(*edges)
        return tuple(x[kept] for x in edges)

    while left.size:
        far = np.bitwise_count((fp[left] ^ fp[left + lag]).view(np.uint64)).sum(1, dtype=np.int64)
        near = far <= bits
        found.append((left[near], left[near] + lag, far[near]))
        held += int(near.sum())
        if held > 1_000_000:
            found, held = [reduced()], 0
        lag += 1
        left = left[left + lag < len(fp)]
        left = left[group[left] == group[left + lag]]
    return reduced()


def _by_key(compare: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by key, in batches, to what compare() makes of whole keys: their numbers, and so many further columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            held = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(columns)], 1)
            if rest is not None:
                key, held = np.concatenate([rest[0], key]), np.concatenate([rest[1], held])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            rest = key[cut:], held[cut:]
            if cut:
                yield compare(key[:cut], held[:cut])
        if rest is not None and len(rest[0]):
            yield compare(*rest)

    return run


def _link(rule: Rule) -> Callable[[np.ndarray, np.ndarray], pa.RecordBatch]:
    """Compare all pairs of a key; of a batch of keys keep a spanning forest of those near enough."""
    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b, far = _close_pairs(key, fp, rule.bits)
        node = fp[:, 0] if rule.words == 1 else fp[:, 0] * np.int64(-7046029288634856825) + fp[:, 1] * np.int64(-4417276706812531889)
        kept = spanning_forest(node[a], node[b], far)
        columns = [np.ascontiguousarray(fp[at[kept], k]) for at in (a, b) for k in range(rule.words)]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), [f"{e}{k}" for e in "ab" for k in range(rule.words)])

    return links


def _pairs_of_keys(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions inside each run of equal group numbers, by their distance."""
    left, lag = np.nonzero(group[:-1] == group[1:])[0], 1
    while left.size:
        yield left, left + lag
        lag += 1
        left = left[left + lag < len(group)]
        left = left[group[left] == group[left + lag]]


def _best(src: np.ndarray, order: tuple[np.ndarray, ...], most: int) -> np.ndarray:
    """Positions of the first rows, so many, of each src by the order (its first array counts most)."""
    at = np.lexsort((*order[::-1], src))
    starts = np.nonzero(np.r_[True, np.diff(src[at]) != 0])[0] if len(at) else at
    rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
    return at[rank < most]


def _candidates(rule: Rule) -> Callable[[np.ndarray, np.ndarray], pa.RecordBatch]:
    """Compare all pairs of a key by their bits and sizes; each text keeps its nearest ones, and its hub, with the number of texts near to that."""
    expected = round(rule.error * 64 * rule.words)

    def near(held: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = held[:, rule.words]
        left, right = (x[np.minimum(size[left], size[right]) >= rule.similarity * np.maximum(size[left], size[right])] for x in (left, right))
        far = np.bitwise_count((held[left, : rule.words] ^ held[right, : rule.words]).view(np.uint64)).sum(1, dtype=np.int64)
        close = far <= rule.bits
        return left[close], right[close], far[close]

    def chosen(src: np.ndarray, dst: np.ndarray, far: np.ndarray, degree: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([_best(src, (far, -degree[dst], dst), NEAREST), _best(src, (-degree[dst], far, dst), HUBS)]))

    def compare(key: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
        degree, found, n = np.zeros(len(key), np.int64), [], 0
        for left, right in _pairs_of_keys(key):  # degrees first: they choose what is kept where pairs are very many
            a, b, far = near(held, left, right)
            degree += np.bincount(np.concatenate([a[far <= expected], b[far <= expected]]), minlength=len(key))
            n += len(a)
            if n <= PAIRS_HELD:
                found.append((a, b, far))
        src = dst = apart = np.array([], np.int64)
        parts, waiting = [], 0

        def reduced() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b, far = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (src, src, src)
            both = np.concatenate([src, a, b]), np.concatenate([dst, b, a]), np.concatenate([apart, far, far])
            kept = chosen(*both, degree)
            return tuple(x[kept] for x in both)

        for part in found if n <= PAIRS_HELD else (near(held, *pair) for pair in _pairs_of_keys(key)):
            parts.append(part)
            waiting += len(part[0])
            if waiting > PAIRS_HELD:
                src, dst, apart = reduced()
                parts, waiting = [], 0
        src, dst, apart = reduced()
        columns = [np.ascontiguousarray(held[at, k]) for at in (src, dst) for k in range(rule.words)] + [apart.astype(np.int32), degree[dst].astype(np.int32)]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), [*(f"{e}{k}" for e in "ab" for k in range(rule.words)), "far", "degree"])

    return compare


def _meeting(nodes: DataFrame, rule: Rule, columns: list[str]) -> DataFrame:
    """Distinct fingerprints to rows (key, columns), sorted by key: those that share a variant share a key.

    A key is a hash of the variant and the fingerprint's bits under it; what shares a
    key by chance is told apart by verification. A key that very many fingerprints share is dealt into
    pieces, and each two pieces are compared under a key of their own, so that no task holds more than two.
    """
    names, masks = _names(rule), rule.masks(nodes.count())
    table = F.array(*[F.struct(F.lit(v).alias("v"), *[F.lit(m).cast("long").alias(f"m{k}") for k, m in enumerate(mask)]) for v, mask in enumerate(masks)])

    def variants(of: DataFrame) -> DataFrame:
        out = of.select(*columns, F.explode(table).alias("x"))
        return out.select(F.xxhash64("x.v", *[F.col(c).bitwiseAND(F.col(f"x.m{k}")) for k, c in enumerate(names)]).alias("key"), *columns)

    counted = variants(nodes.where(F.pmod(F.xxhash64(*names, F.lit("count")), F.lit(COUNTED)) == 0)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    heavy = counted.where(F.col("n") * COUNTED > PIECE).select(F.col("key").alias("heavy"), F.ceil(F.col("n") * COUNTED / PIECE).cast("int").alias("pieces"))
    heavy = materialise(heavy, "simhash-heavy")  # as a table its size is known, and Spark broadcasts it or not by that
    rows = variants(nodes)
    if not heavy.isEmpty():
        rows = rows.join(heavy, F.col("key") == F.col("heavy"), "left")
        mine = F.pmod(F.xxhash64(*names, F.lit("piece")), F.col("pieces")).cast("int")
        other = F.explode(F.when(F.col("pieces") > 1, F.array_remove(F.sequence(F.lit(0), F.col("pieces") - 1), mine)).otherwise(F.array(F.lit(0))))
        rows = rows.withColumn("mine", mine).withColumn("other", other)
        split = F.when(F.col("pieces") > 1, F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).otherwise(F.col("key"))
        rows = rows.select(split.alias("key"), *columns)
    return rows.repartition("key").sortWithinPartitions("key")


def _ends(rule: Rule) -> list[str]:
    return [f"{e}{k}" for e in "ab" for k in range(rule.words)]


def _named_ends(found: DataFrame, rule: Rule) -> DataFrame:
    """(words of a, words of b, more) to (a, b, more), nodes by name."""
    more = [c for c in found.columns if c not in _ends(rule)]
    return found.select(*[_node([F.col(f"{e}{k}") for k in range(rule.words)]).alias(e) for e in "ab"], *more)


def _edges(nodes: DataFrame, rule: Rule) -> DataFrame:
    """Distinct fingerprints (words) to edges (a, b) between the nodes of those near enough: forests that connect them all."""
    found = _meeting(nodes, rule, _names(rule)).mapInArrow(_by_key(_link(rule), rule.words), ", ".join(f"{c} long" for c in _ends(rule)))
    return _named_ends(found, rule)


def _candidate_edges(nodes: DataFrame, rule: Rule) -> DataFrame:
    """Distinct fingerprints (words, size) to (a, b, far, degree): for a node a some candidates b, and how many are near to these."""
    schema = ", ".join(f"{c} long" for c in _ends(rule)) + ", far int, degree int"
    found = _meeting(nodes, rule, [*_names(rule), "size"]).mapInArrow(_by_key(_candidates(rule), rule.words + 1), schema)
    return _named_ends(found, rule).groupBy("a", "b").agg(F.min("far").alias("far"), F.max("degree").alias("degree"))


def _node(words: list[Column]) -> Column:
    """What names a fingerprint among components: itself, or a hash of 64 bits for longer ones."""
    return words[0] if len(words) == 1 else F.xxhash64(*words)


def _components(fps: DataFrame, rule: Rule) -> DataFrame:
    """(words, doc_id) to a row for each distinct fingerprint: (words, rep, comp), rep its smallest doc_id.

    Copies collapse into one row per distinct fingerprint before anything is compared.
    """
    names = _names(rule)
    nodes = materialise(fps.groupBy(*names).agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    comp = connected_components(_edges(nodes, rule))
    named = nodes.withColumn("own", _node([F.col(c) for c in names]))
    return named.join(comp, named.own == comp.node, "left").select(*names, "rep", F.coalesce("component", "own").alias("comp"))


def components(fps: DataFrame, rule: Rule = EXACT) -> DataFrame:
    """(doc_id, words) to (doc_id, words, component_id)."""
    joined = _components(fps, rule)
    names = joined.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return fps.join(joined.join(names, "comp").select(*_names(rule), "component_id"), _names(rule))


def near_dups(docs: DataFrame, rule: Rule = EXACT) -> DataFrame:
    """documents to (doc_id, fingerprint, component_id)."""
    fps = materialise(docs.select("doc_id", _fingerprints(rule).alias("f")).select("doc_id", "f.*"), "simhash")
    digits = [F.lpad(F.lower(F.hex(c)), 16, "0") for c in reversed(_names(rule))]
    return components(fps, rule).select("doc_id", F.concat(*digits).alias("fingerprint"), "component_id")


def _compared(pairs: DataFrame, sets: DataFrame, least: float, what: str, alike: Column, name: str) -> DataFrame:
    """The pairs (a, b), a table, that are alike by sizes and what sets (node, what, size) hold, as a table. The set of a node in very many pairs goes to several tasks."""
    ends = pairs.select(F.col("a").alias("heavy")).union(pairs.select("b")).groupBy("heavy").agg(F.count(F.lit(1)).alias("n"))
    heavy = ends.where(F.col("n") > MOST_PAIRS).select("heavy", F.ceil(F.col("n") / MOST_PAIRS).cast("int").alias("pieces"))
    heavy = materialise(heavy, "simhash-heavy-ends")  # a table of known size, so that Spark broadcasts it or not by that
    pieces = F.coalesce("pieces", F.lit(1))
    dealt, both = sets.withColumn("piece", F.lit(0)), pairs.withColumns({"piece_a": F.lit(0), "piece_b": F.lit(0)})
    if not heavy.isEmpty():
        dealt = sets.join(heavy, F.col("node") == F.col("heavy"), "left").select("node", what, "size", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
        for e, other in ("ab", "ba"):
            both = both.join(heavy, F.col(e) == F.col("heavy"), "left").withColumn(f"piece_{e}", F.pmod(F.xxhash64(other), pieces).cast("int")).drop("heavy", "pieces")
    for e in "ab":
        mine = dealt.select(F.col("node").alias(e), F.col("piece").alias(f"piece_{e}"), F.col(what).alias(f"{what}_{e}"), F.col("size").alias(f"size_{e}"))
        both = both.join(mine, [e, f"piece_{e}"])
        if e == "b":
            both = both.where(F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b"))
    return materialise(both.where(alike).select("a", "b"), name, TEXTS)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b), a table, whose sets (node, terms, size) are similar, as a table."""
    shared = F.size(F.array_intersect("terms_a", "terms_b"))
    return _compared(pairs, sets, least, "terms", shared / (F.col("size_a") + F.col("size_b") - shared) >= least, "simhash-links")


def _similar(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b, far, degree) of nodes and sets (node, terms, size) to (node, component) by those whose sets are similar.

    First each node's greatest hub and its nearest candidate are verified, so that groups of near
    copies grow together by few comparisons, then every candidate that is left between two components.
    What failed is then compared with the best linked node of the other's component.
    """
    def between(left: DataFrame, comp: DataFrame) -> DataFrame:
        for e in "ab":
            named = comp.select(F.col("node").alias(e), F.col("component").alias(f"comp_{e}"))
            left = left.join(named, e, "left").withColumn(f"comp_{e}", F.coalesce(f"comp_{e}", e))
        return left.where("comp_a <> comp_b")

    def sorted_ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    hub, near = F.struct((-F.col("degree")).alias("minus"), "far", "b"), F.struct("far", (-F.col("degree")).alias("minus"), "b")
    first = edges.groupBy("a").agg(F.min(hub).alias("hub"), F.min(near).alias("near"))
    tested = materialise(sorted_ends(first.select("a", F.explode(F.array("hub.b", "near.b")).alias("b"))), "simhash-picked")
    links = _verified(tested, sets, least)
    comp = connected_components(links)
    rest = sorted_ends(edges.select("a", "b")).join(tested, ["a", "b"], "left_anti")
    for _ in range(1 + LEADER_ROUNDS):
        picked = materialise(between(rest, comp).select("a", "b"), "simhash-picked")
        new = _verified(picked, sets, least) if not picked.isEmpty() else picked
        tested = tested.union(picked)
        if not new.isEmpty():
            links = links.union(new)
            comp = connected_components(links)
        # what failed meets the leader of the other's component
        linked = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        leaders = linked.join(comp, "node").groupBy("component").agg(F.max_by("node", F.struct("n", "node")).alias("b"))
        failed = between(tested, comp)
        led = failed.select("a", "comp_b").union(failed.select("b", "comp_a")).toDF("a", "component").distinct().join(leaders, "component")
        rest = materialise(sorted_ends(led).join(tested, ["a", "b"], "left_anti"), "simhash-led")
        if rest.isEmpty():
            break
    return comp


def prefix(found: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The rarest of a set's shingles, rarest first, so many that any set as similar shares one of them; common is sorted pairs (shingle, place)."""
    if not len(found):
        return found
    at = np.minimum(np.searchsorted(common[:, 0], found), max(0, len(common) - 1))
    place = np.where(common[at, 0] == found, common[at, 1], -1) if len(common) else np.zeros(len(found), np.int64)
    return found[np.lexsort((found, place))][: len(found) - math.ceil(least * len(found) - 1e-6) + 1]


def bitmap(found: np.ndarray) -> bytes:
    """A bit for each shingle of a set; as many bits as a power of two, so that longer ones are folded to the length of shorter ones."""
    size = max(64, BITS << max(0, len(found) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[found.view(np.uint64) & np.uint64(size - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(a: bytes, b: bytes, sizes: int) -> float:
    """No more shingles than this are in both of two sets of so many together: a bit that one bitmap has alone is of a shingle that its set has alone."""
    one, other = sorted((np.frombuffer(x, np.uint64) for x in (a, b)), key=len)
    while len(other) > len(one):
        other = other[: len(other) // 2] | other[len(other) // 2 :]
    return (sizes - int(np.bitwise_count(one ^ other).sum(dtype=np.int64))) / 2


def _may_share(a: pd.Series, b: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([most_shared(*x) for x in zip(a, b, sizes.tolist(), strict=True)], dtype=float)


def _left_apart(texts: DataFrame, rule: Rule) -> DataFrame:
    """(node, comp, size, text) to all pairs (a, b) of nodes in different components that may be similar, as a table.

    Sets of sizes m and n as similar share at least least / (1 + least) (m + n) shingles, so the first of these, in an order
    that all sets have in common, has as many from it on in both. Pairs inside the component that holds most
    of a shingle's texts are never made.
    """
    least = rule.similarity
    part = texts.where(F.pmod(F.xxhash64("node", F.lit("common")), F.lit(COUNTED)) == 0).select(F.explode(_sets(rule)).alias("token"))
    often = part.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    common = np.stack([often.column("token").to_numpy(), np.arange(often.num_rows)[::-1]], 1)
    common = common[np.argsort(common[:, 0])]

    def rarest(texts: pd.Series) -> pd.DataFrame:
        found = [np.sort(distinct(t, rule)[:, 0].view(np.int64)) for t in texts]
        return pd.DataFrame({"tokens": [prefix(x, common, least) for x in found], "bits": [bitmap(x) for x in found]})

    described = F.pandas_udf(rarest, "tokens array<long>, bits binary")("text")
    sets = materialise(texts.select("node", "comp", "size", described.alias("f")).select("node", "comp", "size", "f.*"), "simhash-prefixes", TEXTS)
    rows = sets.select("node", "comp", "size", F.posexplode("tokens").alias("at", "token"))
    shared = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
    shared = materialise(shared, "simhash-shared")
    all_met = met = materialise(rows.join(_few(shared), "token"), "simhash-met")
    held = met.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"))
    heads = held.groupBy("token").agg(F.max_by("comp", F.struct("n", "comp")).alias("head"), F.ceil(F.sum("n") / MET).cast("int").alias("pieces"))
    heads = materialise(heads, "simhash-heads")
    met = met.join(heads, "token")
    piece, every = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))

    def side(e: str, other: str) -> DataFrame:
        return met.select("token", piece.alias(f"piece_{e}"), every.alias(f"piece_{other}"), *[F.col(c).alias(f"{c}_{e}") for c in ("node", "comp", "size", "at", "head")])

    both = side("a", "b").where("comp_a <> head_a").join(side("b", "a"), ["token", "piece_a", "piece_b"]).where("comp_a <> comp_b")
    enough = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= least / (1 + least) * (F.col("size_a") + F.col("size_b")) - 1e-6
    both = both.where(enough & ((F.col("comp_b") == F.col("head_b")) | (F.col("node_a") < F.col("node_b"))))
    pairs = materialise(both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), "simhash-met-pairs")
    discard(shared, all_met, heads)
    sizes = F.col("size_a") + F.col("size_b")
    may = F.pandas_udf(_may_share, "double")("bits_a", "bits_b", sizes)
    apart = _compared(pairs, sets.select("node", "bits", "size"), least, "bits", may >= least / (1 + least) * sizes - 1e-6, "simhash-apart")
    discard(sets, pairs)
    return apart


def _joined(comp: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """comp (words, terms, size, comp, k), a table, with those components made one that any similar sets link."""
    nodes = comp.where("size > 0").select(F.col("k.number").alias("number"), "comp", "size")
    texts = rows.select("number", F.col("row.text").alias("text"))
    pairs = _left_apart(texts.join(_few(nodes), "number").withColumnRenamed("number", "node"), rule)
    if pairs.isEmpty():
        return comp
    ends = materialise(pairs.select(F.col("a").alias("number")).union(pairs.select("b")).distinct().join(nodes, "number"), "simhash-chosen")
    sets = materialise(texts.join(_few(ends), "number").select(F.col("number").alias("node"), "size", _sets(rule).alias("terms")), "simhash-sets", TEXTS)
    links = _verified(pairs, sets, rule.similarity)
    discard(sets)
    for e in "ab":
        links = links.join(ends.select(F.col("number").alias(e), F.col("comp").alias(f"comp_{e}")), e)
    merged = connected_components(links.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
    joined = materialise(comp.join(merged, F.col("comp") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "comp")).drop("node", "component"), "simhash-components")
    discard(comp, ends)
    return joined


def _few(numbers: DataFrame) -> DataFrame:
    """A table of numbers of rows, to be broadcast if it is short."""
    return F.broadcast(numbers) if numbers.count() <= BROADCAST_ROWS else numbers


def keep_one(docs: DataFrame, rule: Rule = SIMILAR) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id (null last), then by hash of text and of the rest.

    Rows are numbered in a table, so that rows without a doc_id or with a repeated one are documents of their own if
    their texts are unlike; of rows equal in everything one stays. Rows of equal sets of shingles (told by
    a hash) are a node; sets that differ but share a fingerprint are candidates like any other. Numbers are
    joined, not texts: rows leave by the numbers of those that go, and the texts of one row a node are read
    again where it has candidates to be verified.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    key = {"id": F.col("doc_id"), "digest": F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), "rest": F.xxhash64(F.col("text").isNull(), *others)}
    words = _names(rule)
    described = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number"), *[c.alias(k) for k, c in key.items()], _described(rule).alias("f"))
    rows = materialise(described.select("row", "number", *key, "f.*"), "simhash-rows", TEXTS)
    first = F.struct(F.col("id").isNull().alias("unnamed"), *key, "number")
    nodes = materialise(rows.groupBy(*words, "terms", "size").agg(F.min(first).alias("k")), "simhash")
    prints = materialise(nodes.groupBy(*words).agg(F.min(F.struct("terms", "size")).alias("lead")).select(*words, F.col("lead.terms").alias("lead"), "lead.size"), "simhash-nodes")
    own, lead = _node([F.col(c) for c in words]), F.col("terms") == F.col("lead")
    named = nodes.join(prints.drop("size"), words).select("k", *words, "terms", "size", own.alias("lead_name"), F.when(lead, own).otherwise(F.xxhash64(*words, "terms")).alias("name"))
    named = materialise(named, "simhash-named")
    discard(nodes)

    twins = named.where("name <> lead_name").select(F.col("name").alias("a"), F.col("lead_name").alias("b"), F.lit(0).alias("far"), F.lit(0).alias("degree"))
    edges = materialise(_candidate_edges(prints, rule).union(twins), "simhash-candidates")
    discard(prints)
    ends = edges.select(F.col("a").alias("name")).union(edges.select("b")).distinct()
    chosen = materialise(named.join(ends, "name").select(F.col("name").alias("node"), "size", F.col("k.number").alias("number")), "simhash-chosen")
    texts = rows.select("number", F.col("row.text").alias("text")).join(_few(chosen), "number")
    sets = materialise(texts.select("node", "size", _sets(rule).alias("terms")), "simhash-sets", TEXTS)
    comp = named.join(_similar(edges, sets, rule.similarity), F.col("name") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "name"))
    comp = materialise(comp.select(*words, "terms", "size", "comp", "k"), "simhash-components")
    discard(named, edges, chosen, sets)
    comp = _joined(comp, rows, rule)
    kept = comp.groupBy("comp").agg(F.min("k").alias("k")).select("comp", F.col("k.number").alias("kept"))
    # most nodes are alone with one row; only rows of the others can go
    several = rows.groupBy(*words, "terms", "size").agg(F.count(F.lit(1)).alias("n")).join(comp, [*words, "terms", "size"]).join(kept, "comp")
    several = several.where((F.col("n") > 1) | (F.col("k.number") != F.col("kept"))).select(*words, "terms", "size", "kept")
    gone = rows.select("number", *words, "terms", "size").join(several, [*words, "terms", "size"]).where("number <> kept").select("number")
    gone = materialise(gone, "simhash-gone")
    discard(comp)
    return rows.join(_few(gone), "number", "left_anti").select("row.*")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_dups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
