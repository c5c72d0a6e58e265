"""Substring deduplication with suffix automata.

A window is a run of ``window`` consecutive words. Each word is removed that a window
covers whose word sequence also starts in a document with a smaller doc_id, judged on the input.

1. *Segments.* The smallest hash of an ``anchor``-word run in a window is the window's key;
   neighbouring windows with one key form a segment (about every 22nd word begins one for
   50-word windows). Equal windows have equal keys, so a window only has to be sought under its key.
2. *Copies.* Keys of one document only drop out. Under the others equal segments collapse to
   one, owned by the smallest doc_id that has it: rows of larger doc_ids lose all of it, rows of the owner
   what the owner's segment loses in the next steps. A key with one segment is done with that.
3. *Reference shards.* What is left under a key are different segments that share text. The key
   is a shard: its segments, in order of doc_id, are streamed through the suffix automaton of
   the earlier ones; its matching statistics give the maximal spans of ``window`` words or more,
   and then the segment extends the automaton. An automaton goes to the task of its shard
   rather than to all, and is bounded by HOT segments.
4. *Hot keys.* A key with more than HOT different segments is too large for one automaton.
   Its windows meet by their hashes: blocks of segments send each distinct window with its smallest doc_id once to a range of
   the hash space, which answers with those that stand in an earlier document elsewhere.

Words, segments and the windows of hot keys are compared by 64-bit hashes, not letter by letter.

Null texts have no words; a text of fewer words than the window is kept whole. Windows that repeat
within one document only are kept, so repeated rows of one doc_id are too: equal rows are looked at once, however many there are, and each gets the
spans found. A row with a
null doc_id is kept and is no reference. Equal doc_ids count as one document: its different texts keep
their own spans, by two 64-bit hashes of the text beside the doc_id. An empty table
gives an empty result. Very long texts are read whole. Only the columns named are read; a carried column with the name of a
result column gives way to it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .tables import key_runs, lean, lean_group, partitions, small_batches, stored

#: Words of the run whose smallest hash is a window's key.
ANCHOR = 8
#: Different segments under one key that one automaton takes; beyond, windows are compared by their hashes.
HOT = 256
#: Windows of hot keys in a block, about.
BLOCK_WINDOWS = 500_000
#: Windows of hot keys that one range of the hash space receives, about, if none is repeated.
RANGE_WINDOWS = 1_000_000
#: Keys of repeated rows that are broadcast at most (some 10 MB); beyond, the rows are shuffled to them.
BROADCAST_ROWS = 250_000
#: What tells a row, but for equal ones.
ROW = ("doc_id", "t1", "t2")
_ROW = "doc_id long, t1 long, t2 long"


class SuffixAutomaton:
    """Suffix automaton of several word sequences, extended online."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _state(self, size: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state for the longest string of p followed by word, apart from the longer ones of q."""
        copy = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, q, word)
                continue
            new = self._state(self.size[last] + 1, 0, {})
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, word)
            last = new

    def spans(self, words: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal spans [begin, end) of ``least`` words or more that stand in the automaton."""
        state = length = 0
        found: list[tuple[int, int]] = []
        for end, word in enumerate(words, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            if length >= least:
                if found and found[-1][0] == end - length:
                    found[-1] = (end - length, end)
                else:
                    found.append((end - length, end))
        return found


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _segments(window: int, anchor: int):
    names = ["key", "content", *ROW, "begin", "last"]

    def run(batches):
        for batch in batches:
            for lo, hi in H.slices(batch.column("text")):
                words = H.split(batch.column("text").slice(lo, hi - lo))
                total = len(words.hashes)
                count = np.maximum(np.diff(words.first) - window + 1, 0)
                starts = np.repeat(words.first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                if not len(starts):
                    continue
                least = _least(words.runs(np.arange(total - anchor + 1), anchor), window - anchor + 1)[starts]
                doc = np.repeat(np.arange(hi - lo), count)
                new = np.ones(len(starts), dtype=bool)
                new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                ends = np.append(at[1:], len(starts)) - 1
                begin, last, doc = starts[at], starts[ends], doc[at]
                content = words.runs(begin, last - begin + window)
                ids = [pa.array(batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False)[doc], pa.int64()) for c in ROW]
                yield pa.RecordBatch.from_arrays([pa.array(H.signed(least[at])), pa.array(H.signed(content)), *ids, pa.array(begin - words.first[doc], pa.int32()), pa.array(last - words.first[doc], pa.int32())], names)

    return run


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_MARKED = "key long, content long, spans array<struct<a:int,b:int>>"


def _cut(window: int):
    """Texts and the segments that they own -> the word hashes of each segment."""

    def run(batches):
        for batch in batches:
            docs, segments = batch.column("doc_id").to_pylist(), batch.column("segments").to_pylist()
            for lo, hi in H.slices(batch.column("text")):
                words = H.split(batch.column("text").slice(lo, hi - lo))
                rows = [(part["key"], part["content"], docs[i], part["hot"], words.hashes[first + part["begin"] : first + part["last"] + window].tobytes()) for i, first in zip(range(lo, hi), words.first.tolist()) for part in segments[i]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["key", "content", "doc_id", "hot", "words"])

    return run


def _stream(window: int):
    """Each key's segments, by doc_id, through the automaton of those of smaller doc_ids."""

    def run(batches):
        for table in key_runs(batches, "key"):
            docs, contents, bodies = (table.column(c).to_pylist() for c in ("doc_id", "content", "words"))
            automaton, waiting, out = SuffixAutomaton(), [], []
            for k, (doc, content, body) in enumerate(zip(docs, contents, bodies)):
                if k and doc != docs[k - 1]:
                    for earlier in waiting:
                        automaton.add(earlier)
                    waiting = []
                words = np.frombuffer(body, np.int64).tolist()
                spans = automaton.spans(words, window) if k else []
                if spans:
                    out.append((content, [{"a": a, "b": b} for a, b in spans]))
                waiting.append(words)
            if out:
                key = table.column("key")[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], _SPANS)], ["key", "content", "spans"])

    return run


def _merged(place: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows at (place, at), sorted -> the spans (place, a, b) that they cover."""
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] - at[:-1] > window)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return place[first], at[first], at[last] + window


_SENT = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("head", pa.bool_()), ("blob", pa.binary())])


def _send(window: int, ranges: int):
    """Blocks of hot segments -> for each range their distinct windows with the smallest doc_id, and one head with the block's own."""

    def flush(block, held):
        hashes = [H.rolling(words, window) for *_, words in held]
        counts = np.array([len(h) for h in hashes], dtype=np.int64)
        own = np.array([row[:3] for row in held], dtype=np.int64)
        every, docs = np.concatenate(hashes), np.repeat(own[:, 2], counts)
        order = np.lexsort((docs, every))
        first = np.flatnonzero(np.diff(every[order], prepend=~every[order[:1]]) != 0)
        h, d = every[order][first], docs[order][first]
        to = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
        rows = [(int(to[a]), block, False, h[a:b].tobytes() + d[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
        rows.append((block % ranges, block, True, np.concatenate([np.array([len(held)]), own.T.ravel(), counts, every.view(np.int64)]).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT)], schema=_SENT)

    def run(batches):
        block, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for key, content, doc, body in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "doc_id", "words"))):
                words = np.frombuffer(body, np.uint64)
                held.append((key, content, doc, words))
                size += len(words) - window + 1
                if size >= BLOCK_WINDOWS:
                    yield from flush(block, held)
                    block, held, size = block + 1, [], 0
        if held:
            yield from flush(block, held)

    return run


def _halves(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(blob, np.uint64, len(blob) // 16), np.frombuffer(blob, np.int64, offset=len(blob) // 2)


def _first_docs(table: pa.Table) -> pa.Table:
    """One range: for each block the windows that have an earlier document elsewhere, with the earliest."""
    blocks, heads, blobs = (table.column(c).to_pylist() for c in ("block", "head", "blob"))
    out = [(b, True, x) for b, h, x in zip(blocks, heads, blobs) if h]
    parts = [(b, *_halves(x)) for b, h, x in zip(blocks, heads, blobs) if not h]
    if parts:
        every, docs = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        order = np.lexsort((docs, every))
        ordered = every[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        least = np.empty(len(every), dtype=np.int64)
        least[order] = np.repeat(docs[order][first], np.diff(np.append(first, len(every))))
        at = 0
        for block, h, d in parts:
            lo = least[at : at + len(h)]
            at += len(h)
            if (lo < d).any():
                out.append((block, False, h[lo < d].tobytes() + lo[lo < d].tobytes()))
    return pa.table({"block": pa.array([r[0] for r in out], pa.int64()), "head": pa.array([r[1] for r in out], pa.bool_()), "blob": pa.array([r[2] for r in out], pa.binary())})


def _hot_spans(window: int):
    """One block: the spans of each segment whose windows stand in an earlier document."""

    def run(table: pa.Table) -> pa.Table:
        heads, blobs = table.column("head").to_pylist(), table.column("blob").to_pylist()
        head = np.frombuffer(next(x for h, x in zip(heads, blobs) if h), np.int64)
        n = int(head[0])
        (key, content, doc, counts), every = head[1 : 1 + 4 * n].reshape(4, n), head[1 + 4 * n :].view(np.uint64)
        distinct, which = np.unique(every, return_inverse=True)
        docs = np.repeat(doc, counts)
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, which, docs)
        for h, x in zip(heads, blobs):
            if not h:
                found, lo = _halves(x)
                place = np.searchsorted(distinct, found)
                least[place] = np.minimum(least[place], lo)
        gone = np.flatnonzero(least[which] < docs)
        starts = np.cumsum(counts) - counts
        place = np.repeat(np.arange(n), counts)[gone]
        place, a, b = _merged(place, gone - starts[place], window)
        rows, first = np.unique(place, return_index=True)
        spans = pa.ListArray.from_arrays(pa.array(np.append(first, len(place)), pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["a", "b"]))
        return pa.table({"key": pa.array(key[rows], pa.int64()), "content": pa.array(content[rows], pa.int64()), "spans": spans})

    return run


def _remove(batches):
    for batch in batches:
        kept, counts, removed = [], [], []
        for text, spans in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist()):
            words = (text or b"").split()  # at the six separators
            counts.append(len(words))
            if spans:
                stay, at = [], 0
                for a, b in sorted((span["a"], span["b"]) for span in spans):
                    stay += words[at:a]
                    at = max(at, b)
                words = stay + words[at:]
            kept.append(b" ".join(words))
            removed.append(counts[-1] - len(words))
        names = [name for name in batch.schema.names if name != "spans"]
        yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], [*names, "kept", "n_words", "n_removed"])


def _rows(docs: DataFrame, *carry: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").cast("string").alias("text"))
    return rows.withColumns({"t1": F.xxhash64("text", F.lit(1)), "t2": F.xxhash64("text", F.lit(2))})


def _once(rows: DataFrame) -> DataFrame:
    """One of each equal rows. Texts are shuffled of repeated rows only, one from each task."""
    repeated = stored(rows.groupBy(*ROW).agg(F.count("*").alias("c")).where("c > 1").select(*ROW))
    count = repeated.count()
    if not count:
        return rows
    known = F.broadcast(repeated) if count <= BROADCAST_ROWS else repeated
    return rows.join(known, [*ROW], "left_anti").union(rows.join(known, [*ROW], "left_semi").dropDuplicates([*ROW]))


def repeated_spans(docs: DataFrame, window: int = 50, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, t1, t2, spans): word spans to remove from the rows of this doc_id and these hashes of the text; they may overlap."""
    docs = _once(_rows(docs).where("doc_id is not null"))
    segments = stored(docs.mapInArrow(lean(_segments(window, anchor)), f"key long, content long, {_ROW}, begin int, last int"))
    common = segments.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key")
    shared = stored(segments.join(common, "key"))
    contents = stored(shared.groupBy("key", "content").agg(F.min(F.struct(*ROW, "begin", "last")).alias("own")))
    kinds = contents.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = contents.join(kinds, "key").select("key", "content", (F.col("kinds") > HOT).alias("hot"), "own.*")
    lists = several.groupBy(*ROW).agg(F.collect_list(F.struct("key", "content", "hot", "begin", "last")).alias("segments"))
    bodies = stored(docs.join(lists, [*ROW]).select("doc_id", "text", "segments").mapInArrow(lean(_cut(window)), "key long, content long, doc_id long, hot boolean, words binary"))
    parts = partitions(docs.sparkSession)
    cold = bodies.where("not hot").select("key", "doc_id", "content", "words").repartition(parts, "key").sortWithinPartitions("key", "doc_id")
    found = cold.mapInArrow(lean(_stream(window)), _MARKED)
    hot = bodies.where("hot")
    windows = hot.agg(F.sum(F.length("words") / 8 - window + 1)).head()[0]
    if windows:
        ranges = max(parts, math.ceil(windows / RANGE_WINDOWS))
        sent = hot.select("key", "content", "doc_id", "words").mapInArrow(lean(_send(window, ranges)), "range int, block long, head boolean, blob binary")
        answers = sent.groupBy("range").applyInArrow(lean_group(_first_docs), "block long, head boolean, blob binary")
        found = found.union(answers.groupBy("block").applyInArrow(lean_group(_hot_spans(window)), _MARKED))
    marks = contents.select("key", "content", F.col("own.doc_id").alias("owner")).join(stored(found), ["key", "content"], "left")
    whole = F.array(F.struct(F.col("begin").alias("a"), (F.col("last") + window).alias("b")))
    part = F.transform("spans", lambda x: F.struct((x["a"] + F.col("begin")).alias("a"), (x["b"] + F.col("begin")).alias("b")))
    lost = shared.join(marks, ["key", "content"]).select(*ROW, F.when(F.col("doc_id") > F.col("owner"), whole).otherwise(part).alias("spans"))
    return lost.where("spans is not null").groupBy(*ROW).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def substring_dedup(docs: DataFrame, window: int = 50, anchor: int = ANCHOR, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of carry, text, kept (kept words joined by one space), n_words and n_removed of each row."""
    small_batches(docs.sparkSession)
    carry = tuple(c for c in carry if c not in ("doc_id", "text", "kept", "n_words", "n_removed"))
    spans = repeated_spans(docs, window, anchor)
    rows = _rows(docs, *(F.col(c).alias(f"carried_{c}") for c in carry))
    names = ["doc_id", *(f"carried_{c}" for c in carry), "text"]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in names}
    schema = ", ".join(f"`{c}` {k}" for c, k in (kinds | {"kept": "string", "n_words": "long", "n_removed": "long"}).items())
    done = rows.join(spans, [*ROW], "left").select(*names, "spans").mapInArrow(lean(_remove), schema)
    return done.select("doc_id", *(F.col(f"carried_{c}").alias(c) for c in carry), "text", "kept", "n_words", "n_removed")
