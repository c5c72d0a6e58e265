"""SimHash near-duplicates by anchor points of a covering code.

1. *Fingerprints.* A bit of a document's 64-bit fingerprint is set where it's set in over half the hashes of
   its word shingles. Equal fingerprints collapse to one before anything is compared, so copies cost nothing further.
2. *Anchors.* The anchors are the words of a covering code: two binary Golay codes on 23 bits each, whose
   balls of radius 3 fill the space, and a single word for the 18 bits left. Each fingerprint has
   one home, the anchor within the covering radius in both parts.
3. *Replicas.* If two fingerprints differ in ``most`` bits at most, then in the parts of the one's home the other exceeds
   the radius by ``most`` together at most. So each fingerprint is replicated to all anchors
   within covering radius plus threshold, counted like that: some 61 of 2**24 for two bits, however many fingerprints there are.
4. *Comparison.* At each anchor those at home meet all that came; within what meets, components are found and
   sent on as one star each, never as pairs.
5. *Hot anchors.* Where more than LIMIT fingerprints meet, the 18 bits left get anchors, too (a Hamming code on
   15, each word of 3 its own), with what remains of the threshold; what is still
   too large is dealt out into cells of a grid, homes by rows and replicas by columns. So no task holds more than a few LIMITs
   and none of the links is lost.

A null text, an empty one and one of blanks have the fingerprint 0, which links like any other. Fewer words than a
shingle are one shingle; repeated shingles count as often as they stand. Repeated rows are rows each, ties of doc_id as well. A null
doc_id is never the smallest; a component of null doc_ids only has a null component_id. Very long texts are read whole, their
hashes a chunk at a time. Only doc_id and text are read, whatever further columns are named. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import components, lean, partitions, small_batches, stored

#: Fingerprints that meet at one anchor, at most.
LIMIT = 16_384
#: Pairs that are laid out at a time.
PAIRS = 1 << 22
#: Hashes of one document that are held at a time.
CHUNK = 1 << 16
#: Rows of an executor's stream that are compared at a time, about.
ROWS = 1 << 16

_U = np.uint64


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text in UTF-8: A-Z lower-cased, words as the six ASCII separators part them."""
    words = text.lower().split()
    if not words:
        return 0
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes) + np.arange(len(words))
    width = min(shingle, len(words))
    begin, end, total = (ends - sizes)[: len(words) - width + 1], ends[width - 1 :], len(words) - width + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, total, CHUNK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begin[at : at + CHUNK].tolist(), end[at : at + CHUNK].tolist())], dtype=_U)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(_U)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's text as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t or b"", shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=_U).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length), one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class PerfectCode:
    """A cyclic code whose balls of ``radius`` fill the space of ``bits`` bits: the anchors of one part of a fingerprint.

    poly generates it (1: every word is a codeword). For each syndrome the table has the differences to all codewords within
    radius + most, by how far they exceed the radius.
    """

    def __init__(self, bits: int, radius: int, poly: int, most: int):
        self.bits, self.degree = bits, poly.bit_length() - 1
        self.unit = np.zeros(bits, dtype=np.int64)
        for k in range(bits):
            rest = 1 << k
            while rest.bit_length() > self.degree and self.degree:
                rest ^= poly << (rest.bit_length() - 1 - self.degree)
            self.unit[k] = rest if self.degree else 0
        patterns, syndromes, excess = [], [], []
        for weight in range(min(bits, radius + most) + 1):
            for places in combinations(range(bits), weight):
                patterns.append(sum(1 << p for p in places))
                syndromes.append(int(np.bitwise_xor.reduce(self.unit[list(places)])) if places else 0)
                excess.append(max(0, weight - radius))
        order = np.lexsort((excess, syndromes))
        self.patterns, self.excess = np.array(patterns, dtype=np.int64)[order], np.array(excess, dtype=np.int64)[order]
        counted = np.zeros((1 << self.degree, most + 1), dtype=np.int64)
        np.add.at(counted, (np.array(syndromes), np.array(excess)), 1)
        self.upto = np.cumsum(counted, axis=1)
        self.first = np.concatenate([[0], np.cumsum(self.upto[:, -1])[:-1]])

    def near(self, words: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, spare left): all anchors that exceed the radius around words[row] by spare[row] at most."""
        syndrome = np.zeros(len(words), dtype=np.int64)
        for k, unit in enumerate(self.unit.tolist()):
            syndrome ^= ((words >> k) & 1) * unit
        counts = self.upto[syndrome, spare]
        rows, at = np.repeat(np.arange(len(words)), counts), spread(self.first[syndrome], counts)
        return rows, (words[rows] ^ self.patterns[at]) >> self.degree, spare[rows] - self.excess[at]


_codes: dict[int, tuple[PerfectCode, ...]] = {}


def codes(most: int) -> tuple[PerfectCode, ...]:
    """The parts' codes: Golay for two of 23 bits; for the 18 left Hamming on 15 and all words of 3."""
    if most not in _codes:
        golay = PerfectCode(23, 3, 0b101011100011, most)
        _codes[most] = (golay, golay, PerfectCode(15, 1, 0b10011, most), PerfectCode(3, 0, 1, most))
    return _codes[most]


def near_anchors(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, spare): the anchors that each fingerprint goes to; where spare is ``most`` it's at home."""
    one, two = codes(most)[:2]
    low, high = fps & ((1 << 23) - 1), (fps >> 23) & ((1 << 23) - 1)
    rows, a, spare = one.near(low, np.full(len(fps), most))
    again, b, spare = two.near(high[rows], spare)
    return rows[again], a[again] << 12 | b, spare


def finer_anchors(fps: np.ndarray, anchors: np.ndarray, spare: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, spare) by the 18 bits that the anchors leave free."""
    three, four = codes(most)[2:]
    tail = (fps >> 46) & ((1 << 18) - 1)
    rows, a, spare = three.near(tail & ((1 << 15) - 1), spare)
    again, b, spare = four.near(tail[rows] >> 15, spare)
    rows = rows[again]
    return rows, anchors[rows] << 14 | a[again] << 3 | b, spare


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the number of a row that stands for the component) after the links a, b."""
    while True:
        lo, hi = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        open_ = lo < hi
        if not open_.any():
            return labels
        a, b = a[open_], b[open_]
        np.minimum.at(labels, hi[open_], lo[open_])
        while (nearer := labels[labels]).tobytes() != labels.tobytes():
            labels = nearer


def group_links(keys: list[np.ndarray], fps: np.ndarray, home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars that join what is linked: of rows sorted by the keys, those at home are compared with all of equal keys."""
    new = np.ones(len(fps), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(fps)))
    run = np.cumsum(new) - 1
    homes = np.flatnonzero(home & (sizes[run] > 1))
    starts, counts = first[run[homes]], sizes[run[homes]]
    labels, before = np.arange(len(fps)), np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < len(homes):
        to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, side="right")) - 1)
        a, b = np.repeat(homes[at:to], counts[at:to]), spread(starts[at:to], counts[at:to])
        differ = fps[a] ^ fps[b]
        hit = (differ != 0) & (np.bitwise_count(differ.view(_U)) <= most)
        labels = _joined(labels, a[hit], b[hit])
        at = to
    moved = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[moved], fps[labels[moved]]


def _compare(most: int):
    names = ("anchor", "cell", "fp", "home")

    def run(batches):
        held: list[list[np.ndarray]] = [[] for _ in names]
        size = 0

        def flush(whole: bool):
            nonlocal held, size
            columns = [np.concatenate(h) for h in held]
            cut = size
            if not whole:  # the last run may go on
                same = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
                cut = int(np.argmax(same))
            anchor, cell, fp, home = (c[:cut] for c in columns)
            held, size = [[c[cut:]] for c in columns], size - cut
            if cut:
                a, b = group_links([anchor, cell], fp, home, most)
                if len(a):
                    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            return None

        for batch in batches:
            for h, name in zip(held, names):
                h.append(batch.column(name).to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size >= ROWS and (found := flush(False)) is not None:
                yield found
        if size and (found := flush(True)) is not None:
            yield found

    return run


def _replicas(most: int):
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            rows, anchor, spare = near_anchors(fps, most)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[rows]), pa.array(spare.astype(np.int32))], ["anchor", "fp", "spare"])

    return run


def _finer(most: int):
    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            rows, anchor, spare = finer_anchors(fps, batch.column("anchor").to_numpy(), batch.column("spare").to_numpy().astype(np.int64), most)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[rows]), pa.array(spare.astype(np.int32))], ["anchor", "fp", "spare"])

    return run


_AT = "anchor long, fp long, spare int"


def _meet(rows: DataFrame, most: int) -> DataFrame:
    """Links (a, b) of rows (anchor, cell, fp, home), each anchor's cell together in one task."""
    dealt = rows.repartition(partitions(rows.sparkSession), "anchor", "cell").sortWithinPartitions("anchor", "cell")
    return dealt.mapInArrow(lean(_compare(most)), "a long, b long")


def _crowded(rows: DataFrame, limit: int) -> DataFrame:
    return stored(rows.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > limit))


def near_fingerprints(classes: DataFrame, most: int = 2, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) that join all of the distinct fingerprints (fp) that differ in ``most`` bits or fewer into their components."""
    near = classes.select("fp").mapInArrow(lean(_replicas(most)), _AT)
    alone = (F.lit(0).alias("cell"), "fp", (F.col("spare") == most).alias("home"))
    crowded = _crowded(near, limit)
    if crowded.isEmpty():
        return _meet(near.select("anchor", *alone), most)
    links = _meet(near.join(crowded, "anchor", "left_anti").select("anchor", *alone), most)
    finer = stored(near.join(crowded, "anchor", "left_semi").select("anchor", "fp", "spare").mapInArrow(lean(_finer(most)), _AT))
    still = _crowded(finer, limit)
    links = links.union(_meet(finer.join(still, "anchor", "left_anti").select("anchor", *alone), most))
    if still.isEmpty():
        return links
    sides = F.ceil(F.col("m") / limit).cast("int")
    grid = finer.join(still, "anchor").withColumn("sides", sides).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("sides")).cast("int"))
    every = F.sequence(F.lit(0), F.col("sides") - 1)
    homes = grid.where(F.col("spare") == most).select("anchor", F.explode(F.transform(every, lambda k: F.col("own") * F.col("sides") + k)).alias("cell"), "fp", F.lit(True).alias("home"))
    others = grid.select("anchor", F.explode(F.transform(every, lambda k: k * F.col("sides") + F.col("own"))).alias("cell"), "fp", F.lit(False).alias("home"))
    return links.union(_meet(homes.union(others), most))


def simhash_join(docs: DataFrame, shingle: int = 3, seed: int = 42, most: int = 2, limit: int = LIMIT) -> DataFrame:
    """doc_id, fp (signed) and component_id (the smallest doc_id reachable by links) of each row.

    docs: (doc_id, text). Fingerprints link where they differ in ``most`` bits or fewer.
    """
    small_batches(docs.sparkSession)
    every = stored(fingerprints(docs, shingle, seed))
    classes = stored(every.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(stored(near_fingerprints(classes, most, limit)))
    known = stored(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "root"))
    lowest = known.where("root is not null").groupBy("root").agg(F.min("least").alias("lowest"))
    whole = known.join(lowest, "root", "left").select("fp", F.coalesce("lowest", "least").alias("component"))
    return every.join(whole, "fp").select("doc_id", "fp", F.col("component").alias("component_id"))
