"""Prefix trie of conversations.

Conversations that begin alike share the nodes of a trie: a node is a distinct sequence of first turns. What it saves is
what needn't be computed again for the conversations that share it.

1. *Sequences.* A turn is a 128-bit digest of role and text and its size in code points; a conversation is the array of
   these, so texts are read once and never shuffled. Equal sequences collapse to one with the number of
   conversations and the smallest conv_id: copies cost nothing further, however many there are.
2. *Groups.* Sequences are grouped by the digest of their first turn. A group of at most ``limit`` turns is a subtrie:
   groups are dealt by hash into buckets of about ``bucket`` turns, and a task builds the dictionary tries of its bucket's groups
   and sums them up in an iterative postorder.
3. *Oversized groups.* A group of more turns is regrouped by its next turn, again and again. What all its sequences
   have in common is passed at once: the common prefix of the smallest and the largest sequence, a chain of nodes of one
   child each. So the rounds follow the branchings of oversized groups, not their depth.
4. *Spine.* The nodes of regrouped groups get their sums from the tops of the groups below, deepest round first. The root is the first
   of them. Each round is stored.

Turns are ordered by number, null first, then by role and digest; repeated rows are turns each. Null roles and texts are empty. Rows
of a null conv_id belong to no conversation and are left out. A conversation without turns ends at the root, which exists as soon as there is a
conversation; an empty table gives an empty result. A conversation's digests are one row: 16 bytes and a number for each
turn, whatever the texts' length. Very long texts are read whole. Columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import stored

#: Turns of one group that a task takes as a whole.
LIMIT = 200_000
#: Turns that a bucket of groups has, about.
BUCKET = 100_000
#: Bits of conv_ids that stand together when the ends of a node are written one after the other.
IDS = 12


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): for each conversation the digests and the sizes of its turns, in order. turns: (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    told = _digest(F.length("role").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("role").cast("binary"), F.col("text").cast("binary"))
    turn = F.struct(F.col("turn"), F.col("role"), told.alias("id"), F.length("text").alias("size"))
    own = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))  # sort_array has nulls first
    return own.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def turn_texts(turns: DataFrame) -> DataFrame:
    """(id, role, text): what the digests of ``sequences`` stand for."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = _digest(F.length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role.cast("binary"), text.cast("binary"))
    return turns.where("conv_id is not null").select(told.alias("id"), role.alias("role"), text.alias("text")).dropDuplicates(["id"])


class Trie:
    """Dictionary trie of the groups of one bucket: nodes in lists, each with a dictionary from the next turn's digest to a node."""

    def __init__(self):
        self.children: list[dict[bytes, int]] = []
        self.depth, self.size, self.n, self.least, self.end = [], [], [], [], []
        self.tops: dict[bytes, int] = {}
        self.parent: list[int] = []

    def _node(self, parent: int, depth: int, size: int) -> int:
        self.children.append({})
        for column, value in ((self.parent, parent), (self.depth, depth), (self.size, size), (self.n, 0), (self.least, None), (self.end, None)):
            column.append(value)
        return len(self.n) - 1

    def add(self, group: bytes, depth: int, ids, sizes, n: int, least: int, seq: bytes) -> None:
        """A sequence of the group whose top node has this depth: its turns from that depth on."""
        at = self.tops.get(group)
        if at is None:
            at = self.tops[group] = self._node(-1, depth, int(sizes[depth - 1]))
        self._count(at, n, least)
        for k in range(depth, len(ids)):
            below = self.children[at].get(ids[k])
            if below is None:
                below = self.children[at][ids[k]] = self._node(at, k + 1, int(sizes[k]))
            at = below
            self._count(at, n, least)
        self.end[at] = seq

    def _count(self, at: int, n: int, least: int) -> None:
        self.n[at] += n
        self.least[at] = least if self.least[at] is None else min(least, self.least[at])

    def sums(self) -> tuple[list[int], list[int]]:
        """(leaves, saved) of each node's subtree, by an iterative postorder: a node is summed up when it's met again after its children."""
        leaves, saved = [0] * len(self.n), [0] * len(self.n)
        stack = [(top, False) for top in self.tops.values()]
        while stack:
            at, below_done = stack.pop()
            below = self.children[at]
            if below and not below_done:
                stack.append((at, True))
                stack.extend((child, False) for child in below.values())
                continue
            leaves[at] = sum(leaves[c] for c in below.values()) or 1
            saved[at] = (self.n[at] - 1) * self.size[at] + sum(saved[c] for c in below.values())
        return leaves, saved


_NODE = "conv_id long, depth long, parent_conv_id long, turn binary, n_convs long, n_children long, n_leaves long, saved_tokens long, seq binary"
_NAMES = [field.split()[0] for field in _NODE.split(", ")]


def _subtries(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket of groups -> their nodes; ``above`` is the group over the node if it's the top of its group."""
    trie, above, turn = Trie(), {}, {}
    for group, depth, over, over_least, ids, sizes, n, least, seq in zip(*(rows[c] for c in ("group", "depth", "above", "above_least", "ids", "sizes", "n", "least", "seq"))):
        trie.add(group, depth, ids, sizes, n, least, seq)
        above[group], turn[group] = (over, over_least), ids[depth - 1]
    leaves, saved = trie.sums()
    tops = {at: group for group, at in trie.tops.items()}
    own = {child: key for below in trie.children for key, child in below.items()}
    parent = [above[tops[k]][1] if p < 0 else trie.least[p] for k, p in enumerate(trie.parent)]
    return pd.DataFrame(
        {
            "above": [above[tops[k]][0] if p < 0 else None for k, p in enumerate(trie.parent)], "conv_id": trie.least, "depth": trie.depth, "parent_conv_id": parent,
            "turn": [turn[tops[k]] if k in tops else own[k] for k in range(len(trie.n))], "n_convs": trie.n, "n_children": [len(c) for c in trie.children], "n_leaves": leaves, "saved_tokens": saved, "seq": trie.end,
        }
    )


def distinct_sequences(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences (conv_id, ids, sizes) -> distinct ones (seq, ids, sizes, n, least), and members (conv_id, seq)."""
    told = stored(every.select("conv_id", "ids", "sizes", F.unhex(F.md5(F.array_join(F.transform("ids", F.hex), "").cast("binary"))).alias("seq")))
    counted = told.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    distinct = told.join(counted.select("n", "least"), F.col("conv_id") == F.col("least")).select("seq", "ids", "sizes", "n", "least")
    return stored(distinct), told.select("conv_id", "seq")


def prefix_trie(every: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Sequences (conv_id, ids, sizes), one for each conv_id -> nodes and members.

    nodes: (conv_id, depth, parent_conv_id, turn, n_convs, n_children, n_leaves, saved_tokens, seq): the smallest member, the number of turns, the
    parent's smallest member (root: null), the digest of the last turn, members, children, childless nodes in the
    subtree, what the subtree saves, and the sequence that ends here, if any. members: (conv_id, seq).
    """
    distinct, members = distinct_sequences(every)
    n, least, ends = distinct.agg(F.sum("n"), F.min("least"), F.max(F.when(F.size("ids") == 0, F.col("seq")))).head()
    spark = every.sparkSession
    root = F.lit(b"root")
    top = spark.createDataFrame([(b"root", 0, None, None, n, least, 0, [], [], None if ends is None else bytes(ends))] if n else [], _SPINE)
    now = distinct.where(F.size("ids") > 0).select(_digest(root, F.get("ids", F.lit(0))).alias("group"), F.lit(1).alias("depth"), root.alias("above"), F.lit(least).cast("long").alias("above_least"), "ids", "sizes", "n", "least", "seq")
    nodes, rounds = [], []
    while True:
        counted = now.groupBy("group").agg(F.sum(F.size("ids") - F.col("depth") + 1).alias("turns"))
        counted = stored(counted)
        total = counted.agg(F.sum("turns")).head()[0] or 0
        large = counted.where(F.col("turns") > limit).select("group")
        dealt = now.join(large, "group", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(max(1, math.ceil(total / bucket)))))
        built = stored(dealt.groupBy("bucket").applyInPandas(_subtries, "above binary, " + _NODE))
        nodes.append(built.select(*_NAMES))
        tops = built.where("above is not null").select("above", "n_leaves", "saved_tokens")
        if large.isEmpty():
            break
        spine, rest = _regrouped(now.join(large, "group"))
        rounds.append((stored(spine), tops))
        now = stored(rest)
    for spine, beside in reversed(rounds):  # deepest first
        chains = stored(_summed(spine, tops))
        nodes.append(chains.select(*_NAMES))
        tops = chains.where("top").select("above", "n_leaves", "saved_tokens").union(beside)
    found = _summed(top, tops).select(*_NAMES)
    for more in nodes:
        found = found.union(more)
    return found, members


_SPINE = "group binary, depth int, above binary, above_least long, n long, least long, last int, ids array<binary>, sizes array<int>, seq binary"


def _regrouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Oversized groups: each as a chain of nodes down to where its sequences part, and its sequences grouped by the turn after that."""
    whole = rows.groupBy("group", "depth", "above", "above_least").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.min(F.struct("ids", "sizes", "seq")).alias("lo"), F.max("ids").alias("hi"))
    parts = F.array_position(F.zip_with("lo.ids", "hi", lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
    whole = whole.withColumn("last", F.when(parts > 0, parts - 1).otherwise(F.size("hi")))
    length = F.col("last") - F.col("depth") + 1
    ends = F.when(F.size("lo.ids") == F.col("last"), F.col("lo.seq"))
    spine = whole.select("group", "depth", "above", "above_least", "n", "least", "last", F.slice("lo.ids", F.col("depth"), length).alias("ids"), F.slice("lo.sizes", F.col("depth"), length).alias("sizes"), ends.alias("seq"))
    passed = whole.select("group", "last", F.col("least").alias("group_least"))
    longer = rows.select("group", "ids", "sizes", "n", "least", "seq").join(passed, "group").where(F.size("ids") > F.col("last"))
    rest = longer.select(_digest("group", F.get("ids", F.col("last"))).alias("group"), (F.col("last") + 1).alias("depth"), F.col("group").alias("above"), F.col("group_least").alias("above_least"), "ids", "sizes", "n", "least", "seq")
    return spine, rest


def _summed(spine: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes of each chain, with the sums of the tops below its last node; ``top`` marks its first."""
    none = F.lit(0).cast("long")
    sums = below.groupBy(F.col("above").alias("group")).agg(F.count("*").alias("m"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    rows = spine.join(sums, "group", "left").select("*", F.posexplode(F.sequence("depth", "last")).alias("at", "d")).withColumn("size", F.coalesce(F.get("sizes", F.col("at")), F.lit(0)).cast("long"))
    downward = Window.partitionBy("group").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.col("d") == F.col("last")
    return rows.select(
        (F.col("at") == 0).alias("top"), "above", F.col("least").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.when(F.col("at") == 0, F.col("above_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.get("ids", F.col("at")).alias("turn"), F.col("n").alias("n_convs"), F.when(ends, F.coalesce("m", none)).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), ((F.col("n") - 1) * F.sum("size").over(downward) + F.coalesce("saved", none)).alias("saved_tokens"), F.when(ends, F.col("seq")).alias("seq"),
    )


def with_ends(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """nodes with ends_sha256 in place of seq; where no sequence ends it's the hash of nothing."""
    names = [c for c in nodes.columns if c != "seq"]
    none = nodes.where("seq is null").select(*names, F.lit(hashlib.sha256(b"").hexdigest()).alias("ends_sha256"))
    return nodes.where("seq is not null").join(written_ends(members), "seq").select(*names, "ends_sha256").union(none)


def written_ends(members: DataFrame) -> DataFrame:
    """(seq, ends_sha256): SHA-256 of the members' decimal conv_ids, numerically ascending and joined by commas.

    A sequence's ids come in blocks of neighbouring ids, sorted, and are hashed as a stream: none is held whole.
    """
    blocks = members.groupBy("seq", F.shiftright("conv_id", IDS).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches):
        last, held = None, None
        for batch in batches:
            found = []
            for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if seq != last:
                    if held is not None:
                        found.append((last, held.hexdigest()))
                    last, held = seq, hashlib.sha256(ids.encode())
                else:
                    held.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], ["seq", "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([held.hexdigest()], pa.string())], ["seq", "ends_sha256"])

    return blocks.repartition("seq").sortWithinPartitions("seq", "block").select("seq", "ids").mapInArrow(run, "seq binary, ends_sha256 string")
