"""SimHash anchors, the filter audit and the prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from itertools import combinations, permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumisift.llm import prefix_trie as P
from lumisift.llm import simhash as S
from lumisift.llm.filter_audit import filter_audit, mask_counts
from lumisift.llm.queries import rebuilt

WORD = re.compile(r"[^ \t-\r]+")


def components_of(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    return [find(k) for k in range(n)]


# --- SimHash ---------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_simhash(rows, most=2):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = components_of(len(rows), [(a, b) for a, b in combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= most])
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root[k]] = min(doc, least.get(root[k], doc))
    return sorted(((doc, fps[k], least.get(root[k])) for k, (doc, _) in enumerate(rows)), key=str)


def near_texts(seed, size=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(size):
        if texts and rng.random() < 0.5:
            base = rng.choice(texts).split()
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append("  ".join(base))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 300, 500]))).upper())
    return [(7 * k % 151, t) for k, t in enumerate(texts)]


def test_spark_s_hash_is_the_same(spark):
    texts = ["a b c", "é ß x", "", "w" * 100]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()] == [int(np.array(xxhash.xxh64_intdigest(t.encode(), 42), dtype=np.uint64).view(np.int64)) for t in texts]


@pytest.mark.parametrize("seed,limit", [(1, S.LIMIT), (2, 8)])
def test_simhash_join(spark, seed, limit):
    rows = near_texts(seed) + [(500, None), (501, ""), (502, " \n"), (503, "A b"), (504, "a B"), (505, "rep eat " * 4000), (None, "a b"), (None, None)]
    rows += [rows[3], rows[3], (3, rows[0][1])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, anchor string")
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in S.simhash_join(docs, limit=limit).collect()), key=str)
    assert got == brute_simhash(rows)


def test_simhash_of_nothing(spark):
    assert S.simhash_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = S.simhash_join(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")).collect()
    assert [r.component_id for r in alone] == [None, None]


@pytest.mark.parametrize("limit", [S.LIMIT, 64, 5])
def test_crowded_anchors_lose_no_link(spark, limit):
    """Fingerprints that crowd around few centres, by the first anchors, by finer ones and in cells."""
    rng = np.random.default_rng(7)
    fps = {0, 2**64 - 1}
    for _ in range(3):
        centre = int(rng.integers(0, 2**63))
        for _ in range(150):
            bits = rng.choice([*range(46, 64), 3, 30], rng.integers(0, 6), replace=False)
            fps.add(centre ^ sum(1 << int(b) for b in bits))
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    links = [tuple(r) for r in S.near_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, limit).collect()]
    at = {x: k for k, x in enumerate(signed)}
    assert components_of(len(fps), [(at[a], at[b]) for a, b in links]) and len(links) < 62 * len(fps)
    got, want = components_of(len(fps), [(at[a], at[b]) for a, b in links]), components_of(len(fps), [(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {frozenset(np.flatnonzero(np.array(got) == k).tolist()) for k in set(got)} == {frozenset(np.flatnonzero(np.array(want) == k).tolist()) for k in set(want)}


def test_codes_cover():
    rng = np.random.default_rng(1)
    for code in S.codes(2):
        words = rng.integers(0, 1 << code.bits, 200)
        rows, anchor, spare = code.near(words, np.full(200, 2))
        assert (np.bincount(rows[spare == 2], minlength=200) == 1).all()  # each word has one home
        if code.bits == 15:  # all anchors within radius + threshold, by trying all
            words_of = [w for w in range(1 << 15) if code.near(np.array([w]), np.array([0]))[1][0] == w >> code.degree and all(x == 0 for x in [np.bitwise_xor.reduce(code.unit[[k for k in range(15) if w >> k & 1]]) if w else 0])]
            for k in range(5):
                every = {w >> code.degree for w in words_of if int(w ^ words[k]).bit_count() <= 3}
                assert set(anchor[rows == k].tolist()) == every


# --- filter audit ----------------------------------------------------------------------------


def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for doc, text, source in docs:
        text, words = text or "", WORD.findall(text or "")
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs)
        rows.append((source or "", fails, doc in good, doc in toxic))
    found, shapley = [], {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if r[1][x]], [r for r in left if not r[1][x]]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
                only = sum(r[1][x] and sum(r[1].values()) == 1 for r in own)
                found.append([part, "".join(order), step, len(left), len(gone), sum(r[1][x] for r in own) - len(gone), only, sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in found)


def audit_rows():
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(rng.choice([20, 400]))], k=rng.choice([10, 210]))) + rng.choice(["", " ABC" * 30, " #", " A $"]) for _ in range(30)]
    docs = [(k % 70, rng.choice(texts), rng.choice(["x", "x", "y", None, ""])) for k in range(90)]
    docs += [(None, texts[0], "x"), (None, texts[0], "x"), (None, None, "z"), (95, "", "z"), (96, None, None), (97, "w　w É\x0bé", "z"), (3, texts[1], "x"), (3, texts[1], "x"), (98, "long word " * 30_000, "z")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in rng.choices(range(110), k=80)] + [(None, 1, 1)]
    return docs, labels


def test_filter_audit(spark):
    docs, labels = audit_rows()
    frame = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, source string, mask int, part string")
    marks = spark.createDataFrame([(*x, "k") for x in labels], "doc_id long, quality int, toxic int, good string")
    got = sorted(tuple(r) for r in filter_audit(frame, marks).collect())
    assert got == brute_audit(docs, labels)


def test_filter_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", None)], docs.schema)
    assert {(r.kept, r.removed) for r in filter_audit(one, labels).where("step = 5").collect()} <= {(0, 0), (0, 1)}


def test_own_filters(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    masks = mask_counts(docs, labels, filters=lambda t: [F.length(t) > 1], part="lang")
    assert {tuple(r) for r in masks.collect()} == {("en", 0, 1, 0, 0), ("en", 2, 1, 1, 0), ("en", 1, 1, 0, 0)}
    got = {(r.filter_order, r.step): (r.kept, r.removed) for r in filter_audit(docs, labels, "LR", lambda t: [F.length(t) > 1], "lang").collect()}
    assert got == {("LR", 1): (2, 1), ("LR", 2): (1, 1), ("RL", 1): (2, 1), ("RL", 2): (1, 1)}


# --- prefix trie -----------------------------------------------------------------------------


def turn_digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute_conversations(rows):
    every = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            every.setdefault(conv, []).append((turn is not None, turn or 0, role or "", turn_digest(role or "", text or ""), text or ""))
    return {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in every.items()}


def brute_rebuilt(own):
    found = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - int(np.fmod(c, 100)), [])
        found[c] = base[:h] + ts[h:]
    return found


def brute_trie(convs):
    nodes = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    leaves, saved, children = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for q, members in nodes.items():
        for d in range(len(q) + 1):
            leaves[q[:d]] += not children[q]
            saved[q[:d]] += (len(members) - 1) * len(q[-1][1]) if q else 0
    found = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        found.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def talk(seed, convs=60):
    rng = random.Random(seed)
    rows, texts = [], ["hi", "ho", "é" * 5, "", None, "a\nb"]
    for c in rng.sample([*range(0, 40), *range(100, 140), *range(-105, -95)], convs):
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn * 3 - 2, rng.choice(["user", "assistant", "user", None]), rng.choice(texts) if turn < 3 else rng.choice(texts + [f"x{rng.randrange(40)}"])))
    rows += [(200, 1, "user", "hi"), (200, 1, "user", "ho"), (200, None, "user", "é"), (200, 1, "user", "hi"), (None, 0, "user", "lost"), (300, 0, None, None)]
    rows += [(c, t, "user", f"same{t}") for c in range(400, 430) for t in range(12)] + [(c, t, "user", f"same{t}" if t < 10 else f"own{c}") for c in range(430, 450) for t in range(12)]
    rows += [(450, t, "user", f"same{t}") for t in range(150)]
    rng.shuffle(rows)
    return rows


def columns(nodes, members):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in P.with_ends(nodes, members).collect()), key=str)


@pytest.mark.parametrize("seed,limit,bucket", [(1, P.LIMIT, P.BUCKET), (2, 40, 30), (3, 1, 1000)])
def test_prefix_trie(spark, seed, limit, bucket):
    rows = talk(seed)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, depth int")
    own = brute_conversations(rows)
    seqs = P.sequences(frame)
    assert columns(*P.prefix_trie(seqs, limit, bucket)) == brute_trie(own)
    assert columns(*P.prefix_trie(rebuilt(seqs), limit, bucket)) == brute_trie(brute_rebuilt(own))


def test_prefix_trie_of_nothing(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert P.with_ends(*P.prefix_trie(P.sequences(frame))).count() == 0
    only = spark.createDataFrame([(101, [], []), (102, [], [])], "conv_id long, ids array<binary>, sizes array<int>")
    assert columns(*P.prefix_trie(only)) == [(101, 0, None, 2, 0, 1, 0, hashlib.sha256(b"101,102").hexdigest())]


def test_ends_over_many_blocks(spark):
    ids = [-5000, -1, 0, 7, 4095, 4096, 9000, 10**9]
    members = spark.createDataFrame([(i, b"s") for i in ids], "conv_id long, seq binary")
    assert [tuple(r) for r in P.written_ends(members).collect()] == [(b"s", hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]


def test_turn_texts(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, None, None)], "conv_id long, turn long, role string, text string")
    nodes, _ = P.prefix_trie(P.sequences(frame))
    told = nodes.join(P.turn_texts(frame), F.col("turn") == F.col("id"), "left").select("depth", "role", "text").collect()
    assert {tuple(r) for r in told} == {(0, None, None), (1, "user", "hi"), (2, "", "")}
