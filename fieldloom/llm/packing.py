"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most CAPACITY tokens. Full pieces are sequences already; the others
are dealt at random into groups of bounded size. On each group several islands breed packings:
a crossover injects whole well-filled bins of one parent into the other, drops the bins that hold
the same pieces and best-fits what lost its place. Between epochs the best packing of each island
moves to the next island. What ends in badly filled bins is dealt and packed once more.

Cases: a null text is empty and a document of the closing id alone; repeated rows are packed
each; a null doc_id is carried; an empty table gives no sequences; other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import materialise

CAPACITY = 2048
END_ID = 0
#: Pieces in a group, about: bounds what one task packs, whatever the corpus.
GROUP = 16_384
ISLANDS, EPOCHS, GENERATIONS = 3, 2, 32
#: The orders in which an island's first parents are packed: the noise, in tokens, added to pieces' sizes.
ORDERS = (0.0, 32.0, 256.0, np.inf)
#: The part of a giver's fuller half of bins that is injected, and of a taker's bins that is dissolved for being the emptiest.
INJECTED, EMPTIEST = (0.02, 0.1), 0.02
#: The noise, in tokens, of the order in which displaced pieces are best-fitted.
NOISE = (0.0, 0.0, 64.0, 512.0)
#: Bins less full than this are opened again in the last round.
FULL = 0.97
#: Distinct parts of words that a worker remembers the ids of, about; what a worker holds grows by some 700 bytes with each.
CACHE_WORDS = 200_000
#: Characters tokenized at a time.
BLOCK = 1 << 22
#: Bytes of texts that go to Python at a time; both sides of an executor hold several times as much for each of its tasks.
TEXTS = 1 << 21


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The settings of tokenizers whose ids can be found word by word.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MODEL = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>",
    "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
}


class Words:
    """A tokenizer's ids, word by word where its settings are the known ones: tokens then never cross white space, so parts of words can be remembered.

    Any other tokenizer, and any text that holds one of its special tokens, is encoded as a whole.

    A word of plain letters and the marks behind it are parts of their own, as the tokenizer parts
    letters from marks (but for apostrophes); any other word is one part.
    """

    #: ASCII and Latin-1 letters, then ASCII marks without the apostrophe.
    PLAIN = "^(?P<letters>[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self._whole = path, None
        self.full = Tokenizer.from_file(path)
        settings = json.loads(self.full.to_str())
        model = {k: v for k, v in settings["model"].items() if k not in ("vocab", "merges")}
        added = settings["added_tokens"]
        self.special = [t["content"] for t in added]
        self.by_word = (settings["normalizer"], settings["pre_tokenizer"], model) == (NORMALIZER, PRE_TOKENIZER, MODEL) and not any(
            t["normalized"] or t["lstrip"] or t["rstrip"] or not t["special"] or not t["content"] for t in added
        )
        if not self.by_word:
            return
        # Texts that hold an added token are encoded whole; in words of all others it is ordinary text.
        self.full.encode_special_tokens = True
        self.plain = Tokenizer(self.full.model)  # the same merges, held once
        # Normalising leaves lower-case letters of Latin-1 as they are, and they are never parted.
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    @property
    def whole(self):
        """The tokenizer as it stands, loaded when the first text needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def forget(self) -> None:
        self.number = {"": 0}
        self.flat, self.start = np.zeros(1 << 20, np.uint32), np.zeros((1 << 20) + 1, np.int64)

    def _append(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        n = len(self.number)
        while n + len(words) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        size = self.start[n]
        while size + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[size : size + len(ids)] = ids
        self.start[n + 1 : n + 1 + len(words)] = size + ends
        self.number.update(zip(words, range(n, n + len(words)), strict=True))

    def _learn(self, words: list[str], plain: bool) -> None:
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            if plain:
                ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
                self._append(part, ids, np.nonzero(self.last[ids])[0] + 1)
            else:
                found = [np.array(e.ids, np.uint32) for e in self.full.encode_batch_fast(part, add_special_tokens=False)]
                self._append(part, np.concatenate(found), np.cumsum(list(map(len, found))))

    def _numbers(self, parts: pa.Array, plain: bool) -> np.ndarray:
        coded = parts.dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [w for w in known if w not in self.number]:
            self._learn(new, plain)
        return np.fromiter(map(self.number.__getitem__, known), np.int64, len(known))[coded.indices.to_numpy()]

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts in a row, and where each part's end."""
        return gather(self.flat, self.start[numbers], self.start[numbers + 1])

    def encode(self, texts: pa.Array, end: int = END_ID) -> Iterator[np.ndarray]:
        """The ids of each text, the end id last: those of the tokenizer's encode(text, add_special_tokens=False)."""
        texts = pc.fill_null(texts, "")
        whole = np.full(len(texts), not self.by_word)
        for token in self.special if self.by_word else ():
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not whole.any():
            yield from self._encode_words(texts, end)
            return
        parts = self._encode_words(texts.filter(pa.array(~whole)), end) if not whole.all() else iter(())
        for text, at_once in zip(texts, whole, strict=True):
            yield np.array([*self.whole.encode(text.as_py(), add_special_tokens=False).ids, end], np.uint32) if at_once else next(parts)

    def _encode_words(self, texts: pa.Array, end: int) -> Iterator[np.ndarray]:
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = words.flatten().dictionary_encode()
        if len(self.number) > CACHE_WORDS:
            self.forget()
        found = pc.extract_regex(coded.dictionary, self.PLAIN)
        odd = found.is_null()
        parts = np.zeros((len(found), 2), np.int64)
        at = np.nonzero(~odd.to_numpy(zero_copy_only=False))[0]
        if len(at):
            letters, marks = found.filter(pc.invert(odd)).flatten()
            parts[at, 0], parts[at, 1] = self._numbers(pc.utf8_lower(letters), True), self._numbers(marks, False)
        if len(at) < len(parts):
            parts[odd.to_numpy(zero_copy_only=False), 0] = self._numbers(coded.dictionary.filter(odd), False)
        flat, ends = self._gather(parts.ravel())
        ends = ends[1::2]
        starts = np.r_[0, ends[:-1]]
        index, offsets = coded.indices.to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()
        for s, e in zip(offsets[:-1], offsets[1:], strict=True):
            which = index[s:e]
            yield np.append(gather(flat, starts[which], ends[which])[0], np.uint32(end))


def gather(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of flat one after the other, and where each ends."""
    n = ends - starts
    upto = np.cumsum(n)
    return flat[np.arange(upto[-1] if len(n) else 0) + np.repeat(starts - (upto - n), n)], upto


_WORDS: dict[str, Words] = {}


def words_of(vocabulary: str) -> Words:
    """The vocabulary's, made once a worker."""
    return _WORDS.get(vocabulary) or _WORDS.setdefault(vocabulary, Words(vocabulary))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch (with a column text) of about BLOCK bytes of text."""
    size = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
    step = max(1, batch.num_rows * BLOCK // max(BLOCK, size))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def pieces(docs: DataFrame, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """documents to (uid, doc_id, piece, start, length, ids_crc32), and ids if asked for, as a table.

    uid tells rows apart, of repeated documents too; it is fixed once the table is written.
    """
    vocabulary = vocabulary or default_vocabulary()
    schema = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(vocabulary)
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for few in slices(batch):
                rows = []
                for doc_id, ids in zip(few.column("doc_id").to_pylist(), words.encode(few.column("text")), strict=True):
                    for k in range(0, len(ids), CAPACITY):
                        part = ids[k : k + CAPACITY]
                        rows.append((uid, doc_id, k // CAPACITY, k, len(part), zlib.crc32(part.astype("<u4").tobytes()), part.tolist() if keep_ids else None))
                        uid += 1
                columns = list(zip(*rows, strict=True))[: 6 + keep_ids]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names)
                pa.default_memory_pool().release_unused()  # else the worker keeps the most that it needed at any time
        words.forget()  # the worker goes on to other stages

    return materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema), "pieces", TEXTS)


def best_fit(order: list[int], sizes: list[int], place: list[int], rooms: list[int]) -> None:
    """Put the pieces, in this order, each into the fullest bin that takes it; opens bins as needed.

    place is the bin of each piece and rooms the free room of each bin; both are filled in.
    """
    held: list[list[int]] = [[] for _ in range(CAPACITY + 1)]  # bins by free room
    some = 0  # a bit for each room that bins have
    for b, room in enumerate(rooms):
        held[room].append(b)
        some |= 1 << room
    for item in order:
        size = sizes[item]
        if fits := some >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = held[room].pop()
            if not held[room]:
                some ^= 1 << room
        else:
            room, b = CAPACITY, len(rooms)
            rooms.append(room)
        place[item] = b
        rooms[b] = left = room - size
        held[left].append(b)
        some |= 1 << left


def decreasing(sizes: np.ndarray, rng: np.random.Generator, noise: float) -> np.ndarray:
    """A packing by best fit, largest pieces first; noise (in tokens) shuffles them, infinite noise at random."""
    key = rng.random(len(sizes)) if noise == np.inf else -(sizes + noise * rng.random(len(sizes)))
    place = [0] * len(sizes)
    best_fit(np.argsort(key, kind="stable").tolist(), sizes.tolist(), place, [])
    return np.array(place, np.int32)


def cost(place: np.ndarray, sizes: np.ndarray) -> tuple[int, float]:
    """Fewer bins first; of as many, the more unevenly filled the better, as that leaves one bin the emptiest."""
    fill = np.bincount(place, sizes) / CAPACITY
    return len(fill), -float(fill @ fill)


def crossover(giver: np.ndarray, taker: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Inject some of the giver's fullest bins whole; the taker's bins that share pieces with them, and its emptiest ones, are dissolved and best-fitted."""
    fill = np.bincount(giver, sizes)
    full = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    chosen = np.full(len(fill), -1, np.int64)
    picked = rng.choice(full, max(1, round(len(full) * rng.uniform(*INJECTED))), replace=False)
    chosen[picked] = np.arange(len(picked))
    injected = chosen[giver] >= 0
    fill = np.bincount(taker, sizes)
    open_ = np.zeros(len(fill), bool)
    open_[taker[injected]] = True
    open_[np.argsort(fill, kind="stable")[: max(1, round(len(fill) * EMPTIEST))]] = True
    kept = ~open_[taker]
    place = np.full(len(taker), -1, np.int64)
    place[injected] = chosen[giver[injected]]
    place[kept] = (np.cumsum(~open_) - 1)[taker[kept]] + len(picked)
    displaced = np.nonzero(place < 0)[0]
    key = -sizes[displaced] - rng.choice(NOISE) * rng.random(len(displaced))
    rooms = (CAPACITY - np.bincount(place[place >= 0], sizes[place >= 0], len(picked) + int((~open_).sum())).astype(np.int64)).tolist()
    place = place.tolist()
    best_fit(displaced[np.argsort(key, kind="stable")].tolist(), sizes.tolist(), place, rooms)
    return np.array(place, np.int32)


def evolve(sizes: list[int] | np.ndarray, elites: list[np.ndarray], seed: int) -> np.ndarray:
    """One island's epoch over a group: breed from elites (bin numbers by piece), or at first from packings in several orders; the best one.

    Best fit by decreasing size is one of the first parents. All generations are bred, also where
    the fewest possible bins are reached: a packing of as many bins may still fill them better.
    """
    rng, sizes = np.random.default_rng(seed), np.asarray(sizes, np.int64)
    people = [np.asarray(e, np.int32) for e in elites]
    people += [decreasing(sizes, rng, noise) for noise in ORDERS[len(people) :]]
    ranked = sorted(((cost(p, sizes), k, p) for k, p in enumerate(people)), key=lambda x: x[:2])
    for k in range(GENERATIONS):
        i, j = rng.permutation(len(ranked))[:2]
        child = crossover(ranked[i][2], ranked[j][2], sizes, rng)
        ranked = sorted([*ranked[:-1], min(ranked[-1], (cost(child, sizes), -1 - k, child), key=lambda x: x[:2])], key=lambda x: x[:2])
    return ranked[0][2]


def _pack_groups(items: DataFrame, level: int) -> DataFrame:
    """(uid, length) to (uid, length, seq, fill, offset): packed within groups of about GROUP pieces."""
    n = items.count()
    group = F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(max(1, -(-n // GROUP))))
    groups = items.groupBy(group.alias("grp")).agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items"))  # about GROUP each
    groups = materialise(groups.select("grp", F.col("items.uid").alias("uids"), F.col("items.length").alias("sizes")), "pack-groups")

    def epoch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                seed = int(row.grp) * 1009 + int(row.island) * 31 + int(row.epoch)
                best = evolve(row.sizes, list(row.elites), seed)
                out.append((row.grp, row.island, best, *cost(best, np.asarray(row.sizes))))
            yield pd.DataFrame(out, columns=["grp", "island", "elite", "n_bins", "uneven"])

    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    state = groups.select("grp", islands).withColumn("elites", F.array().cast("array<array<int>>"))
    for k in range(EPOCHS):
        work = state.join(groups.select("grp", "sizes"), "grp").withColumn("epoch", F.lit(k))
        work = work.repartition("grp", "island")
        best = materialise(work.mapInPandas(epoch, "grp long, island int, elite array<int>, n_bins int, uneven double"), "pack-epoch")
        own = F.struct("island", "elite")
        moved = best.select("grp", "island", own.alias("parent")).union(best.select("grp", (F.col("island") + 1) % ISLANDS, own))
        parents = F.sort_array(F.collect_list("parent"))  # two each, in order of the islands they are from
        state = moved.groupBy("grp", "island").agg(F.transform(parents, lambda p: p["elite"]).alias("elites"))
    chosen = best.groupBy("grp").agg(F.min_by("elite", F.struct("n_bins", "uneven", "island")).alias("elite"))

    def lay_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                uids, sizes, bins = (np.asarray(x, np.int64) for x in (row.uids, row.sizes, row.elite))
                order = np.argsort(bins, kind="stable")
                ends, starts = np.cumsum(sizes[order]), np.r_[True, np.diff(bins[order]) > 0]
                offset = ends - sizes[order]
                offset -= np.repeat(offset[starts], np.diff(np.r_[np.nonzero(starts)[0], len(order)]))
                fill = np.bincount(bins, sizes).astype(np.int64)
                seq = (np.int64(level) << 60) + (np.int64(row.grp) << 20) + bins[order]
                yield pd.DataFrame({"uid": uids[order], "length": sizes[order], "seq": seq, "fill": fill[bins[order]], "offset": offset})

    return materialise(groups.join(chosen, "grp").mapInPandas(lay_out, "uid long, length long, seq long, fill long, offset long"), "packed")


def pack(cut: DataFrame) -> DataFrame:
    """pieces() to the same rows with sequence_id and offset."""
    first = _pack_groups(cut.where(F.col("length") < CAPACITY).select("uid", "length"), 0)
    again = _pack_groups(first.where(F.col("fill") < FULL * CAPACITY).select("uid", "length"), 1)
    placed = first.where(F.col("fill") >= FULL * CAPACITY).union(again).select("uid", "seq", F.col("offset").alias("at"))
    return cut.join(placed, "uid", "left").withColumns({"sequence_id": F.coalesce("seq", -1 - F.col("uid")), "offset": F.coalesce("at", F.lit(0))}).drop("seq", "at", "uid")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """documents to (doc_id, piece, start, length, ids_crc32, sequence_id, offset), and ids if asked for."""
    return pack(pieces(docs, vocabulary, keep_ids))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
