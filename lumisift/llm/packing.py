"""Packing by the length histogram, shortest pack first.

Documents become token ids and are cut into pieces of the sequence width and a rest. The
counts of each piece length (no more lengths than the width, whatever the corpus) go to
the driver, which places them longest first, each on the shortest open packs that take it,
updating counts of packing patterns rather than single packs. The patterns then go back to the pieces:
pieces of one length are ranked, and a range of ranks fills one slot of one pattern.

A null text is empty and has the end id alone. Repeated rows are packed each for itself. Very long texts are encoded whole and cut into
pieces; very long words are encoded each time they're met. An
empty table gives an empty result. Other columns of the pieces pass through ``place``.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import lean, small_batches, stored

#: Words whose ids a worker remembers in each of two generations; those that are met again move on to the next.
CACHED_WORDS = 150_000
#: Longer words aren't remembered beyond the texts that are encoded together.
REMEMBERED = 64
#: Characters of text that are encoded together, about.
TOGETHER = 4_000_000
#: Pieces of one length that are ranked in one task, about.
RANKED = 50_000


class WordEncoder:
    """Ids of texts, word by word: a word's ids depend on nothing else, so they're looked up once.

    It splits texts as the tokenizer's own normalizer and pattern do. Texts with a special token's
    string or with characters whose class depends on the Unicode version go to the tokenizer whole.
    """

    #: The tokenizer's pattern (a fixed value of its file).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: What a text may consist of to be split here: characters of old and stable classes.
    PLAIN = r"[\t-\r -~¡-˿Ͱ-ͳͶͷͺ-Ϳ΄-ΊΌΎ-ΡΣ-ҁҊ-ԯ‐-‧‰-⁞₠-₿、-〩ぁ-ゖァ-ヿ一-龥가-힣]*"

    #: Marks that end a word as one part, but for those of contractions and special tokens.
    TAIL = ".,;:!?&*$%#()\"+=@[]^_`{}~/\\-"

    _of: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        # the same model for parts that are normalized and split already
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.find = regex.compile(self.PATTERN).findall
        self.plain = re.compile(self.PLAIN).fullmatch
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        ends = [i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]
        self.ends = np.zeros(max(ends) + 1, dtype=bool)
        self.ends[ends] = True

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """This worker's encoder."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode_parts(self, new: list[str]) -> list[bytes]:
        """All parts as one text, told apart by their last ids; one by one, where a part doesn't end in such an id."""
        ids = np.array(self.model.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = [0, *(np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1).tolist()]
        if len(cuts) != len(new) + 1 or cuts[-1] != len(ids):
            return [self.whole(p) for p in new]
        body = ids.tobytes()
        return [body[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, words: set[str]) -> list[str]:
        """Ids of these words; those of several parts get theirs from the ids of the parts. Returns the long ones among all that it has learnt."""
        if len(self.known) > CACHED_WORDS:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        words = words.difference(known)
        if before:
            met = words & before.keys()
            known.update((w, before[w]) for w in met)
            words -= met
        single = {w for w in words if w.isalpha()}
        parts = {}
        for word in words - single:
            core = word.rstrip(self.TAIL)
            parts[word] = (core, word[len(core) :]) if core.isalpha() else self.find(word)
        single.update(p for split in parts.values() for p in split)
        new = list(single.difference(known))
        for at in range(0, len(new), 20_000):
            known.update(zip(new[at : at + 20_000], self._encode_parts(new[at : at + 20_000])))
        get = known.__getitem__
        known.update([(w, b"".join(map(get, split))) for w, split in parts.items()])
        return [w for w in (*new, *parts) if len(w) > REMEMBERED]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) <= TOGETHER:
                size += len(texts[to])
                to += 1
            split = [text if "<|" in text or not self.plain(text) else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().split() for text in texts[at:to]]
            long = self._learn(set().union(*(words for words in split if not isinstance(words, str))))
            get = self.known.__getitem__
            for words in split:
                yield self.whole(words) if isinstance(words, str) else b"".join(map(get, words))
            for word in long:
                self.known.pop(word, None)
            at = to


def pieces(docs: DataFrame, tokenizer: str, width: int = 2048, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): each document's ids and end_id, cut at multiples of width.

    ids is binary: little-endian unsigned 32-bit ids. tokenizer: a path that all executors can read.
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = WordEncoder.of(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 256):
                part = texts.slice(lo, 256).to_pylist()
                ids = batch.column(0).slice(lo, 256).to_pylist()
                rows = []
                for doc, body in zip(ids, encoder.encode([t or "" for t in part])):
                    body += end
                    tokens = len(body) // 4
                    rows += [(doc, at, min(width, tokens - at), tokens, body[4 * at : 4 * (at + width)]) for at in range(0, tokens, width)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, start long, length long, doc_tokens long, ids binary")


def shortest_pack_first(histogram: dict[int, int], width: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns with their counts: (count, piece lengths) so that each length's pieces are used up."""
    free: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    full: list[tuple[int, tuple[int, ...]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # the packs of most free space first; what has just been placed there has less
        for space in sorted((s for s in free if s >= length), reverse=True):
            while left and free.get(space):
                count, pattern = free[space].pop()
                used = min(count, left)
                if count > used:
                    free[space].append((count - used, pattern))
                left -= used
                free.setdefault(space - length, []).append((used, (*pattern, length)))
            if not left:
                break
        # several pieces of one length may share a pack: deal out what is left onto new packs, as many a pack as it takes
        if left:
            each = width // length
            for count, size in ((left // each, each), (1, left % each)):
                if count and size:
                    free.setdefault(width - length * size, []).append((count, (length,) * size))
        full += free.pop(0, [])
    return full + [pack for space in sorted(free) for pack in free[space]]


def _slots(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: the ranks from there on lie in these sequences."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, rank.get(length, 0), sequence, offset))
            rank[length] = rank.get(length, 0) + count
            offset += length
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def place(cut: DataFrame, width: int = 2048, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Each piece (column ``length``, 1 to width) with its sequence_id and its offset there; other columns pass, but for those of these two names.

    order: columns that tell pieces apart, by which they're ranked. Pieces of one length are dealt out into parts of about RANKED by a
    hash of order, so that many pieces of the full width are ranked in many tasks.
    """
    names = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    cut = stored(cut.select(F.col("length").cast("long").alias("length"), F.struct(*names).alias("row")))
    key = [F.col(f"row.{c}") for c in order]
    sizes = stored(cut.groupBy("length").agg(F.count("*").alias("n")))
    histogram = {int(r["length"]): int(r["n"]) for r in sizes.collect()}  # at most width rows
    slots = _slots(shortest_pack_first(histogram, width))
    dealt = cut.join(F.broadcast(sizes), "length").select("length", F.pmod(F.xxhash64(*key), F.ceil(F.col("n") / RANKED)).cast("long").alias("part"), "row")
    before = dealt.groupBy("length", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    keys = slots[:, 0] * (1 << 48) + slots[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            sequence = slots[at, 2] + rank - slots[at, 1]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sequence), pa.array(slots[at, 3])], ["row", "sequence_id", "offset"])

    within = F.row_number().over(Window.partitionBy("length", "part").orderBy(*key)).cast("long") - 1
    ranked = dealt.withColumn("within", within).join(before, ["length", "part"]).select("length", (F.col("within") + F.col("before")).alias("rank"), "row")
    placed = ranked.mapInArrow(lean(run), f"row {cut.schema['row'].dataType.simpleString()}, sequence_id long, offset long")
    return placed.select("row.*", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, width: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces with their ids, sequence_id and offset."""
    return place(pieces(docs, tokenizer, width, end_id), width)
