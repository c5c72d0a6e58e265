"""N-gram Jaccard join over prefix trees.

Documents become sets of word n-grams (64-bit hashes). Two documents link when the
Jaccard similarity of their sets reaches a threshold; the result has each document's
class of equal sets, its number of n-grams and its component of links.

1. *Shared n-grams.* Blocks of documents send their n-grams to ranges of the hash
   space, packed in blobs, each n-gram once a block (one that several of the block's documents have with their number); each range counts in
   how many documents an n-gram stands and answers with the n-grams that two or more have. A document of n grams can only
   link to another if at least threshold * n of its n-grams are shared, so all others
   drop out here, however many there are. Copies collapse per block and then
   over all blocks to one set.
2. *Global order.* The rarest n-gram comes first: a token is (frequency class, hash).
3. *Prefix trees.* Sets meet under a few smallest-hash keys; in each group the ordered
   sets stand in a trie, and each set walks it, sharing the overlap of common
   paths, leaving subtrees whose remaining length can't reach the threshold, and
   those that its component already holds. A group larger than GROUP sets
   is dealt out into parts.
4. *Completion.* By the prefix principle linked sets share one of the first
   n - ceil(threshold * n) + 1 tokens. Prefix tokens which sets of several
   components share are visited again, until there is none whose sets of different
   components haven't been compared. So no link is lost.

Nulls and texts without words give an empty set: it links with nothing. A document
with fewer words than the n-gram has one gram, its whole word sequence. Repeated
rows are copies. Rows of one doc_id stay separate rows, each in the component of its own text. A null doc_id is never
the smallest; a component of null doc_ids only has a null component_id. Very long texts are read whole. Further columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .tables import components, key_runs, lean, lean_group, partitions, small_batches, stored

#: Tokens and documents in a block, at most (a longer document stands alone).
BLOCK_TOKENS, BLOCK_DOCS = 1_000_000, 50_000
#: Tokens that one range of the hash space receives, about.
RANGE_TOKENS = 1_000_000
#: Sets in one trie, at most; a larger group is dealt out into parts.
GROUP = 2048
#: Smallest-hash keys under which sets meet first.
KEYS = 3

_U = np.uint64


def gram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct n-gram hashes, of lower-cased (A-Z) words."""
    for lo, hi in H.slices(texts):
        words = H.split(texts.slice(lo, hi - lo), lower=True)
        count = np.diff(words.first)
        for i in range(hi - lo):
            a, c = int(words.first[i]), int(count[i])
            if not c:
                yield np.zeros(0, np.uint64)
            else:
                yield np.unique(words.runs(np.arange(a, a + max(1, c - n + 1)), min(c, n)))


def _signature(grams: np.ndarray) -> tuple[int, int]:
    if not len(grams):
        return 0, 0
    return int(H.mix(grams).sum(dtype=np.uint64).view(np.int64)), int(H.mix(grams ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64).view(np.int64))


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2): s1, s2 are equal where the sets are."""

    def run(batches):
        for batch in batches:
            sizes, ones, twos = [], [], []
            for grams in gram_sets(batch.column(1), n):
                s1, s2 = _signature(grams)
                sizes.append(len(grams))
                ones.append(s1)
                twos.append(s2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64())], ["doc_id", "n_shingles", "s1", "s2"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_shingles long, s1 long, s2 long")


# --- blobs: sorted hashes as differences of as few bytes as they need ---------------------------


def _pack(hashes: np.ndarray, index: np.ndarray) -> bytes:
    steps = np.diff(hashes)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return b"".join((bytes([width]), len(hashes).to_bytes(4, "little"), hashes[:1].tobytes(), steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), index.astype(np.uint16).tobytes()))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, n = blob[0], int.from_bytes(blob[1:5], "little")
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[0] = np.frombuffer(blob, np.uint8, 8, 5)
    steps[1:, :width] = np.frombuffer(blob, np.uint8, (n - 1) * width, 13).reshape(-1, width)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64), np.frombuffer(blob, np.uint16, n, 13 + (n - 1) * width)


_SENT = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
#: Kinds of blobs: n-grams of one document with its place in the block, of several with their number, and the head of a block.
ONE, SEVERAL, HEAD = 0, 1, 2
#: Stands for a place in the block where several documents have the n-gram.
_MANY = 0xFFFF


def _send(n: int, ranges: int):
    """Blocks of documents -> blobs of their n-grams for each range, and one head. The id of a block tells it by its place, too: others may hold the same rows."""

    def flush(sets, seen, place):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        grams, index = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        order = np.argsort(grams)
        grams, index = grams[order], index[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        counts = np.diff(np.append(first, len(grams)))
        alone, many = first[counts == 1], first[counts > 1]
        several = counts[counts > 1]
        signs = np.array(list(seen), dtype=np.int64).reshape(-1, 2)
        block = int(H.mix(np.array(place, dtype=np.uint64) * np.array([5, 7], dtype=np.uint64) + H.mix(signs[:, 0].view(np.uint64)).sum(dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))
        rows = []
        for kind, own, extra in ((ONE, grams[alone], index[alone]), (SEVERAL, grams[many], several)):
            to = ((own >> _U(32)) * _U(ranges)) >> _U(32)
            cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)] if len(to) else [0]
            rows += [(int(to[a]), block, kind, _pack(own[a:b], extra[a:b])) for a, b in zip(cuts, cuts[1:])]
        head = np.concatenate([np.array([len(sets), len(many)]), sizes, signs[:, 0], signs[:, 1], grams[many].view(np.int64), several])
        rows.append((abs(block) % ranges, block, HEAD, head.tobytes() + index[np.repeat(counts, counts) > 1].tobytes()))
        for at in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 256]), _SENT)], schema=_SENT)

    def run(batches):
        sets, seen, held = [], {}, 0
        place = (TaskContext.get().partitionId(), 0)
        for batch in batches:
            for grams in gram_sets(batch.column(0), n):
                sign = _signature(grams)
                if not len(grams) or sign in seen:
                    continue
                if held and (held + len(grams) > BLOCK_TOKENS or len(sets) >= BLOCK_DOCS):
                    yield from flush(sets, seen, place)
                    sets, seen, held = [], {}, 0
                    place = (place[0], place[1] + 1)
                seen[sign] = None
                sets.append(grams)
                held += len(grams)
        if held:
            yield from flush(sets, seen, place)

    return run


_ANSWER = np.dtype([("gram", "<u8"), ("doc", "<u2"), ("cls", "u1")])


def _answer(table: pa.Table) -> pa.Table:
    """One range: for each block the n-grams that two or more documents have, with their frequency class."""
    kinds, blocks, blobs = table.column("kind").to_pylist(), table.column("block").to_pylist(), table.column("blob").to_pylist()
    out = [(b, HEAD, x) for k, b, x in zip(kinds, blocks, blobs) if k == HEAD]
    parts = [(k, b, *_unpack(x)) for k, b, x in zip(kinds, blocks, blobs) if k != HEAD]
    if parts:
        grams = np.concatenate([p[2] for p in parts])
        order = np.argsort(grams)
        ordered = grams[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        weight = np.concatenate([p[3].astype(np.int64) if p[0] == SEVERAL else np.ones(len(p[2]), np.int64) for p in parts])
        often = np.empty(len(grams), dtype=np.int64)
        often[order] = np.repeat(np.add.reduceat(weight[order], first), np.diff(np.append(first, len(grams))))
        at = 0
        for kind, block, own, extra in parts:
            df = often[at : at + len(own)]
            at += len(own)
            keep = df >= 2
            if keep.any():
                rows = np.empty(int(keep.sum()), dtype=_ANSWER)
                rows["gram"], rows["doc"], rows["cls"] = own[keep], _MANY if kind == SEVERAL else extra[keep], np.minimum(255, np.log2(df[keep]) * 8)
                out.append((block, kind, rows.tobytes()))
    return pa.table({"block": pa.array([r[0] for r in out], pa.int64()), "kind": pa.array([r[1] for r in out], pa.int32()), "blob": pa.array([r[2] for r in out], pa.binary())})


_SET = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def _token_lists(lists: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)])
    flat = np.concatenate([np.zeros(0, np.uint64), *lists]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _survivors(share: float):
    """One block: documents of which enough n-grams are shared, with their tokens in global order."""

    def run(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        raw = next(x for k, x in zip(kinds, blobs) if k == HEAD)
        docs, many = np.frombuffer(raw, np.int64, 2).tolist()
        head = np.frombuffer(raw, np.int64, 3 * docs, 16).reshape(3, docs)
        own, counts = np.frombuffer(raw, np.int64, 2 * many, 16 + 24 * docs).reshape(2, many)
        rows = np.concatenate([np.zeros(0, _ANSWER), *(np.frombuffer(x, _ANSWER) for k, x in zip(kinds, blobs) if k == ONE)])
        if many:  # every n-gram that several documents of the block have is answered once
            told = np.concatenate([np.frombuffer(x, _ANSWER) for k, x in zip(kinds, blobs) if k == SEVERAL])
            more = np.empty(int(counts.sum()), dtype=_ANSWER)
            more["gram"], more["cls"] = np.repeat(own.view(np.uint64), counts), np.repeat(told["cls"][np.argsort(told["gram"])], counts)
            more["doc"] = np.frombuffer(raw, np.uint16, offset=16 + 24 * docs + 16 * many)
            rows = np.concatenate([rows, more])
        shared = np.bincount(rows["doc"], minlength=docs)
        good = shared >= np.ceil(share * head[0] - 1e-9)
        rows = rows[good[rows["doc"]]]
        tokens = (rows["cls"].astype(np.uint64) << _U(56)) | (rows["gram"] >> _U(8))
        order = np.lexsort((tokens, rows["doc"]))
        tokens, cuts = tokens[order], np.cumsum([0, *shared[good]])
        keep = np.flatnonzero(good)
        return pa.table([pa.array(head[1][keep]), pa.array(head[0][keep]), pa.array(head[1][keep]), pa.array(head[2][keep]), _token_lists([tokens[a:b] for a, b in zip(cuts, cuts[1:])])], schema=_SET)

    return run


def shared_sets(docs: DataFrame, n: int, threshold: float, total: int) -> DataFrame:
    """(sid, n, s1, s2, tokens): each set that may link with another, tokens rarest first; sid is a hash of the set."""
    ranges = max(1, math.ceil(total / RANGE_TOKENS), partitions(docs.sparkSession))
    sent = docs.select(F.col("text").cast("string")).mapInArrow(lean(_send(n, ranges)), "range int, block long, kind int, blob binary")
    answers = sent.groupBy("range").applyInArrow(lean_group(_answer), "block long, kind int, blob binary")
    found = answers.groupBy("block").applyInArrow(lean_group(_survivors(threshold)), "sid long, n long, s1 long, s2 long, tokens array<long>")
    return found.dropDuplicates(["n", "s1", "s2"])


# --- the trie ----------------------------------------------------------------------------------------


class PrefixTree:
    """A compressed trie of ordered token sets, its nodes in arrays, parents before children by level.

    Node k has the edge ``edges[edge[k]:edge[k + 1]]`` (ranks of tokens among those of the group) and
    above it the node ``parent[k]``; below it stand the sorted sets low[k] to high[k] - 1, of least[k] n-grams
    or more and with longest[k] tokens after the edge at most.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        keys = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sizes = np.asarray(sizes, dtype=np.int64)[self.order]
        self.lengths = np.array([len(sets[i]) for i in self.order], dtype=np.int64)
        self.cuts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.tokens, self.ranks = np.unique(np.concatenate([sets[i] for i in self.order]), return_inverse=True)
        common = [0]
        for a, b, c in zip(self.cuts, self.cuts[1:], self.cuts[2:]):
            m = min(b - a, c - b)
            differ = self.ranks[a : a + m] != self.ranks[b : b + m]
            at = int(differ.argmax()) if m else 0
            common.append(at if m and differ[at] else m)
        self._nodes(common)

    def _nodes(self, common: list[int]) -> None:
        """Nodes from the common prefixes of neighbouring sets, left to right."""
        root = [0, 0, 0, []]  # depth, low, high, children
        path = [root]
        for i, shared in enumerate(common):
            while path[-1][0] > shared:
                node = path.pop()
                node[2] = i
                if path[-1][0] < shared:  # split the edge
                    middle = [shared, node[1], i, [node]]
                    path[-1][3][-1] = middle
                    path.append(middle)
            if self.lengths[i] > path[-1][0]:
                leaf = [int(self.lengths[i]), i, i + 1, []]
                path[-1][3].append(leaf)
                path.append(leaf)
        for node in path:
            node[2] = len(common)
        level, flat, parent, self.levels = [root], [], [], [0]
        above = [0]
        while level:
            first = len(flat)
            flat += level
            parent += above
            self.levels.append(len(flat))
            above = [first + k for k, node in enumerate(level) for _ in node[3]]
            level = [child for node in level for child in node[3]]
        self.parent = np.array(parent)
        self.depth, self.low, self.high = (np.array([node[k] for node in flat]) for k in range(3))
        starts = self.cuts[self.low] + self.depth[self.parent]
        self.edge = np.concatenate([[0], np.cumsum(self.depth - self.depth[self.parent])])
        self.edges = self.ranks[_spread(starts, np.diff(self.edge))]
        self.least = np.minimum.reduceat(self.sizes, np.stack([self.low, np.minimum(self.high, len(self.sizes) - 1)], 1).ravel())[::2] if len(flat) else self.sizes
        self.least[self.high == len(self.sizes)] = [self.sizes[a:].min() for a in self.low[self.high == len(self.sizes)]]
        self.longest = np.array([self.lengths[a:b].max() for a, b in zip(self.low, self.high)]) - self.depth
        #: The node where each set ends.
        self.end = np.zeros(len(self.sizes), dtype=np.int64)
        for k in range(len(flat)):
            a, b = self.low[k], self.high[k]
            while a < b and self.lengths[a] == self.depth[k]:
                self.end[a] = k
                a += 1

    def walk(self, i: int, active: np.ndarray, threshold: float) -> np.ndarray:
        """Active sets whose similarity to set i reaches the threshold: down all paths at once, level by level."""
        size, length = int(self.sizes[i]), int(self.lengths[i])
        mark = np.zeros(len(self.tokens) + 1, dtype=bool)
        mark[self.ranks[self.cuts[i] : self.cuts[i + 1]]] = True
        passed = np.cumsum(mark)
        below = np.concatenate([[0], np.cumsum(active)])
        overlap = np.full(len(self.parent), -1, dtype=np.int64)
        overlap[0] = 0
        share = threshold / (1 + threshold)
        need = share * (size + np.maximum(self.least, threshold * size)) - 1e-9
        for a, b in zip(self.levels[1:], self.levels[2:]):
            node = np.arange(a, b)
            node = node[(overlap[self.parent[a:b]] >= 0) & (below[self.high[a:b]] > below[self.low[a:b]])]
            if not len(node):
                break
            lengths = self.edge[node + 1] - self.edge[node]
            edge = self.edges[_spread(self.edge[node], lengths)]
            ends = np.cumsum(lengths)
            met = np.concatenate([[0], np.cumsum(mark[edge])])
            now = overlap[self.parent[node]] + met[ends] - met[ends - lengths]
            rest = np.minimum(length - passed[edge[ends - 1]], self.longest[node])
            overlap[node] = np.where(now + rest >= need[node], now, -1)
        own = overlap[self.end]
        return np.flatnonzero(active & (own >= 0) & (own >= threshold * (size + self.sizes - own) - 1e-9))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length), one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def tree_links(sets: list[np.ndarray], sizes: np.ndarray, threshold: float, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the sets of one group into components: pairs of positions, a spanning forest at most.

    labels: sets with equal labels count as joined. Sets with few tokens of their own
    come first, as they're the likely centres. Each pair of different components is compared or
    pruned by the trie's bounds, so the components are those of all links in the group.
    """
    if labels is not None and len(set(labels.tolist())) < 2:
        return []
    tree = PrefixTree(sets, sizes)
    label = np.arange(len(sets)) if labels is None else np.unique(np.asarray(labels)[tree.order], return_inverse=True)[1]
    waiting = np.ones(len(sets), dtype=bool)
    links = []
    for i in np.argsort(tree.sizes - tree.lengths, kind="stable").tolist():
        waiting[i] = False
        active = waiting & (label != label[i])
        if not active.any():
            continue
        for j in tree.walk(i, active, threshold).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                links.append((tree.order[i], tree.order[j]))
    return links


def _join_groups(threshold: float, labelled: bool):
    def run(batches):
        for table in key_runs(batches, "key", "part"):
            if table.num_rows < 2:
                continue
            sids, sizes = table.column("sid").to_numpy(), table.column("n").to_numpy()
            lists = table.column("tokens").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            ends, flat = lists.offsets.to_numpy(), H.unsigned(lists.values.to_numpy())
            sets = [flat[a:b] for a, b in zip(ends, ends[1:])]
            links = tree_links(sets, sizes, threshold, table.column("root").to_numpy() if labelled else None)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(sids[[x[0] for x in links]]), pa.array(sids[[x[1] for x in links]])], ["a", "b"])

    return run


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows by (key, part), each run of equal keys together in one partition."""
    return rows.select("key", "part", *columns).repartition(partitions(rows.sparkSession), "key", "part").sortWithinPartitions("key", "part")


def _min_keys(batches):
    """(key, sid): the smallest token of each set under each of KEYS hash functions."""
    seeds = H.mix(np.arange(1, KEYS + 1, dtype=np.uint64))
    for batch in batches:
        sids, keys = [], []
        lists = batch.column(1)
        ends, flat = lists.offsets.to_numpy(), H.unsigned(lists.values.to_numpy())
        for sid, a, b in zip(batch.column(0).to_pylist(), ends, ends[1:]):
            grams = flat[a:b] & _U((1 << 56) - 1)
            for k in range(KEYS if b > a else 0):
                keys.append(int(H.mix(H.mix(grams ^ seeds[k]).min(keepdims=True) ^ seeds[k]).view(np.int64)[0]))
                sids.append(sid)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sids, pa.int64())], ["key", "sid"])


def _prefix(threshold: float):
    """(key, sid, root): the prefix tokens of each set that other sets have, too."""

    def run(batches):
        for batch in batches:
            keys, sids, roots = [np.zeros(0, np.int64)], [], []
            lists = batch.column("tokens")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for sid, root, n, a, b in zip(batch.column("sid").to_pylist(), batch.column("root").to_pylist(), batch.column("n").to_pylist(), ends, ends[1:]):
                own = n - (b - a)  # tokens that no other document has come first
                take = max(0, n - math.ceil(threshold * n - 1e-9) + 1 - own)
                keys.append(flat[a : min(b, a + take)])
                sids += [sid] * len(keys[-1])
                roots += [root] * len(keys[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys), pa.int64()), pa.array(sids, pa.int64()), pa.array(roots, pa.int64())], ["key", "sid", "root"])

    return run


def links(sets: DataFrame, threshold: float) -> DataFrame:
    """(node, root) for every set that links with another: components of all links of ``sets``."""
    spark = sets.sparkSession
    keys = sets.select("sid", "tokens").mapInArrow(lean(_min_keys), "key long, sid long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    meet = keys.join(sizes, "key").select("key", "sid", F.pmod(F.xxhash64("sid"), F.ceil(F.col("m") / GROUP)).alias("part"))
    found = _dealt(meet.join(sets, "sid"), "sid", "n", "tokens").mapInArrow(lean(_join_groups(threshold, False)), "a long, b long")
    edges = stored(found)
    roots = stored(components(edges))
    labelled = sets.join(roots, sets.sid == roots.node, "left").select("sid", "n", "tokens", F.coalesce("root", "sid").alias("root"))
    prefixes = labelled.mapInArrow(lean(_prefix(threshold)), "key long, sid long, root long")
    mixed = prefixes.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo < hi")
    rows = stored(prefixes.join(mixed, "key").select("key", "sid", "root", "m"))
    every = labelled.select(F.col("sid").alias("node"), "root")
    if rows.isEmpty():
        return every
    more = stored(_compare_open(rows, labelled, threshold))
    if more.isEmpty():
        return every
    # the components found so far are the nodes of the second search
    one, two = every.select(F.col("node").alias("a"), F.col("root").alias("x")), every.select(F.col("node").alias("b"), F.col("root").alias("y"))
    top = stored(components(more.join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))))
    return every.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def _compare_open(rows: DataFrame, labelled: DataFrame, threshold: float) -> DataFrame:
    """Links between sets of different components that share a prefix token.

    Sets that open keys hold together form a cluster and meet in one trie; a cluster of more than GROUP
    sets meets by key instead. Of a key of more than GROUP sets the largest component is dealt out into parts, each of
    which meets all others; where these are too many for that, each pair of parts meets once.
    """
    hubs = rows.groupBy("key").agg(F.min("sid").alias("a"))
    cluster = components(rows.join(hubs, "key").select("a", F.col("sid").alias("b"))).withColumnRenamed("node", "sid").withColumnRenamed("root", "cluster")
    cluster = stored(cluster)
    cluster = cluster.join(cluster.groupBy("cluster").agg(F.count("*").alias("size")), "cluster")
    meet = cluster.where(F.col("size") <= GROUP).select(F.col("cluster").alias("key"), "sid", F.lit(-1).cast("long").alias("part"))
    large = stored(rows.join(cluster.where(F.col("size") > GROUP).select("sid"), "sid"))
    if not large.isEmpty():
        half = GROUP // 2
        most = large.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("most")).select("key", "most.*")
        parts = large.join(most.withColumnRenamed("root", "main"), "key").withColumn("rest", F.col("m") - F.col("c"))
        # one component holds nearly all: no other pair of its parts has to meet
        pieces = F.ceil(F.col("c") / half).cast("int")
        own = F.pmod(F.xxhash64("sid"), pieces).cast("long")
        few = parts.where(F.col("rest") <= half).select("key", "sid", F.explode(F.when(F.col("root") == F.col("main"), F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), pieces.cast("long") - 1))).alias("part"))
        pairs = parts.where(F.col("rest") > half).withColumn("parts", F.ceil(F.col("m") / half).cast("int")).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
        pairs = pairs.select("key", "sid", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select("key", "sid", (F.least("own", "other") * F.lit(1 << 31).cast("long") + F.greatest("own", "other")).alias("part")).distinct()
        meet = meet.union(few).union(pairs)
    return _dealt(meet.join(labelled, "sid"), "sid", "n", "tokens", "root").mapInArrow(lean(_join_groups(threshold, True)), "a long, b long")


def ngram_join(docs: DataFrame, n: int = 5, threshold: float = 0.75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    small_batches(docs.sparkSession)
    signs = stored(signatures(docs, n))
    total = signs.agg(F.sum("n_shingles")).head()[0] or 0
    classes = signs.where("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("least"))
    sets = stored(shared_sets(docs, n, threshold, total))
    roots = stored(links(sets, threshold))
    linked = sets.select("sid", F.col("n").alias("n_shingles"), "s1", "s2").join(roots, F.col("sid") == F.col("node")).select("n_shingles", "s1", "s2", "root")
    known = stored(classes.join(linked, ["n_shingles", "s1", "s2"], "left"))
    lowest = known.where("root is not null").groupBy("root").agg(F.min("least").alias("lowest"))
    whole = known.join(lowest, "root", "left").select("n_shingles", "s1", "s2", F.coalesce("lowest", "least").alias("component"))
    return signs.join(whole, ["n_shingles", "s1", "s2"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
