"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become lower-cased words without marks. Documents meet items by shared seeds, runs of
``least`` words. For each such pair running Karp-Rabin tiling marks the longest matching
runs, none overlapping another, until none of ``least`` words is left; tiles may stand in any order, so reordered passages are
caught. The share of an item's words under tiles is its coverage; a document leaks an item if that
reaches ``threshold``. An item of fewer than ``least`` words holds no seed: it's leaked by a document that is this item and nothing else.

The benchmark is broadcast in blocks of at most BLOCK_WORDS words, whatever its size; each block
is one more pass over the documents without a shuffle. Where there are several, the rows are stored after each block and its broadcast is given up.

Null and empty texts leak nothing; null and empty items are never leaked. Repeated items
count each for itself, as do repeated rows; a block holds an item of one text once, with its number. Very long texts are read whole. Other columns than those of ``carry`` are ignored; a carried column with the name of
a result column gives way to it. An empty table gives an empty result. Where tiles are of equal length, the first in the item goes first, then the first in the text.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import lean, small_batches, stored

from . import hashing as H

#: Words of the benchmark that are broadcast at once.
BLOCK_WORDS = 2_000_000

LEAKS = "array<struct<item_id:bigint,coverage:double,tiles:int,longest:int>>"
_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32()), ("longest", pa.int32())]))
_POWERS = H._Powers(0xC2B2AE3D27D4EB4F)


def _rolling(words: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of that length."""
    up, down = _POWERS.get(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    return H.mix((sums[length:] - sums[: len(words) - length + 1]) * down[: len(words) - length + 1])


def _matches(item: np.ndarray, text: np.ndarray, free_i: np.ndarray, free_t: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Maximal unmarked matches of ``length`` words or more: (-words, place in the item, place in the text)."""
    if len(item) < length or len(text) < length:
        return []

    def open_at(free: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.convolve(free, np.ones(length, dtype=np.int64), "valid") == length)

    at_i, at_t = open_at(free_i), open_at(free_t)
    table = defaultdict(list)
    for p, h in zip(at_i.tolist(), _rolling(item, length)[at_i].tolist()):
        table[h].append(p)
    hashes = _rolling(text, length)[at_t]
    hits = np.isin(hashes, np.fromiter(table, dtype=np.uint64, count=len(table))) if table else np.zeros(0, bool)
    pairs = {(p, t) for t, h in zip(at_t[hits].tolist(), hashes[hits].tolist()) for p in table[h]}
    found = []
    for p, t in pairs:
        if (p - 1, t - 1) in pairs:
            continue  # it begins further left
        n = length
        while (p + n - length + 1, t + n - length + 1) in pairs:
            n += 1
        found.append((-n, p, t))
    return found


def tile(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in the item, place in the text, words), the longest first."""
    free_i, free_t = np.ones(len(item), dtype=np.int64), np.ones(len(text), dtype=np.int64)
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(20, len(item)))
    while True:
        queue = _matches(item, text, free_i, free_t, length)
        if queue and -min(queue)[0] > 2 * length:  # very long matches: search for those first
            length = -min(queue)[0]
            continue
        heapq.heapify(queue)
        while queue:
            n, p, t = heapq.heappop(queue)
            open_ = free_i[p : p - n] * free_t[t : t - n]
            if open_.all():
                tiles.append((p, t, -n))
                free_i[p : p - n] = 0
                free_t[t : t - n] = 0
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], open_, [0]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):  # what is left of an overlapped match
                if b - a >= length:
                    heapq.heappush(queue, (a - b, p + a, t + a))
        if length == least:
            return tiles
        length = max(least, length // 2)


class _Block:
    """Seeds and words of some benchmark items."""

    def __init__(self, ids: list[int], copies: list[int], words: list[np.ndarray], least: int):
        self.ids, self.copies, self.words, self.least = ids, copies, words, least
        self.short: dict[bytes, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            if 0 < len(w) < least:
                self.short[w.tobytes()].append(k)
        seeds = [_rolling(w, least) if len(w) >= least else np.zeros(0, np.uint64) for w in words]
        owner, hashes = np.repeat(np.arange(len(ids)), [len(s) for s in seeds]), np.concatenate([np.zeros(0, np.uint64), *seeds])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def leaks(self, words: H.Words, threshold: float) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
        if self.short:
            for doc in np.flatnonzero(np.diff(words.first) < self.least).tolist():
                text = words.hashes[words.first[doc] : words.first[doc + 1]]
                for k in self.short.get(text.tobytes(), ()):
                    out[doc] += [{"item_id": self.ids[k], "coverage": 1.0, "tiles": 1, "longest": len(text)}] * self.copies[k]
        if len(words.hashes) < self.least or not len(self.hashes):
            return out
        grams = _rolling(words.hashes, self.least)
        at = np.flatnonzero(self.sieve[(grams >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hashes, grams[at]), np.searchsorted(self.hashes, grams[at], side="right")
        met = defaultdict(set)
        for place, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            doc = int(np.searchsorted(words.first, place, side="right")) - 1
            if place + self.least <= words.first[doc + 1]:
                met[doc].update(self.owner[a:b].tolist())
        for doc, items in met.items():
            text = words.hashes[words.first[doc] : words.first[doc + 1]]
            for k in sorted(items):
                item = self.words[k]
                # words under any seed bound the coverage
                seeds = np.flatnonzero(np.isin(_rolling(item, self.least), grams[words.first[doc] : words.first[doc + 1] - self.least + 1]))
                bound = len(np.unique((seeds[:, None] + np.arange(self.least)).ravel()))
                if bound < threshold * len(item):
                    continue
                tiles = tile(item, text, self.least)
                coverage = sum(n for _, _, n in tiles) / len(item)
                if coverage >= threshold:
                    out[doc] += [{"item_id": self.ids[k], "coverage": coverage, "tiles": len(tiles), "longest": max(n for _, _, n in tiles)}] * self.copies[k]
        return out


def _words(texts: pa.Array) -> H.Words:
    return H.split(pc.utf8_lower(texts.cast(pa.large_string())), marks=True)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 4, threshold: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of carry, text and leaks (item_id, coverage, tiles, longest) of each row.

    benchmark: (item_id, text). A row without leaks has an empty list.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = stored(items.groupBy("item_id", "text").agg(F.count("*").alias("copies")))
    size = items.agg(F.sum(F.length("text"))).head()[0] or 0
    blocks = max(1, -(-size // (2 * BLOCK_WORDS)))  # a word and its separator are two characters or more
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c for c in carry if c not in ("doc_id", "text", "leaks")), F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + f", leaks {LEAKS}"
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        words = _words(pa.array([r["text"] for r in part], pa.string()))
        block = spark.sparkContext.broadcast(_Block([r["item_id"] for r in part], [r["copies"] for r in part], [words.hashes[a:b] for a, b in zip(words.first, words.first[1:])], least))

        def run(batches, block=block):
            for batch in batches:
                found = []
                for lo, hi in H.slices(batch.column("text")):
                    found += block.value.leaks(_words(batch.column("text").slice(lo, hi - lo)), threshold)
                names = [n for n in batch.schema.names if n != "leaks"]
                if "leaks" in batch.schema.names:
                    found = [a + b for a, b in zip(batch.column("leaks").to_pylist(), found)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, _LEAKS)], [*names, "leaks"])

        out = out.mapInArrow(lean(run), schema)
        if k < blocks - 1:
            out = stored(out)
            block.unpersist()
    return out
