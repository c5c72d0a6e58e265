"""The operators against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows, extra columns and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumisift.llm import hashing as H
from lumisift.llm import license_scan as L
from lumisift.llm import ngram_join as N
from lumisift.llm import substring_dedup as S
from lumisift.llm.chat_format import rotate_perspectives
from lumisift.llm.decontamination import decontaminate, tile
from lumisift.llm.fingerprints import fingerprints
from lumisift.llm.license_scan import TEMPLATES, scan_licenses
from lumisift.llm.packing import pieces, place, shortest_pack_first
from lumisift.llm.queries import piece_model, word_tokenizer
from lumisift.llm.tables import components
from lumisift.llm.token_counts import LongestMatch, token_counts

WORD = re.compile(r"[^ \t-\r]+")


def documents(spark, rows):
    """doc_id, text and columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "k") for i, t in rows], "doc_id long, text string, key string, n long, part string")


def corpus(seed=1, size=60):
    """Short random texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(70)]
    texts = []
    for i in range(size):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.45:
            base = (rng.choice([t for t in texts if t]) or "a").split()
            for _ in range(rng.randrange(1, 4)):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
        elif kind < 0.6:
            texts.append("\n".join([" ".join(rng.choices(words, k=rng.randrange(30))), " ".join(passage), " ".join(rng.choices(words, k=rng.randrange(30)))]))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.randrange(1, 160))))
    rows = [(7 * i % 101, t) for i, t in enumerate(texts)]
    return rows + [(200, None), (201, ""), (202, " \n\t"), (203, "a b c"), (204, "A B C"), (205, "a b c d e"), (206, "é ß   x"), (207, "rep eat " * 3000)]


def shingles(text, n=5):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows, n=5):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {(doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)}


@given(st.lists(st.text(alphabet="aAé \t\n\x0b, ", max_size=12) | st.none(), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words(texts):
    for lower in (False, True):
        words = H.split(pa.array(texts, pa.string()), lower=lower)
        for i, text in enumerate(texts):
            own = WORD.findall(text or "")
            own = [w.translate({c: c + 32 for c in range(65, 91)}) for w in own] if lower else own
            assert [words.text(k, k + 1).decode() for k in range(words.first[i], words.first[i + 1])] == own
            again = H.split(pa.array([" ".join(own)]))
            assert (words.hashes[words.first[i] : words.first[i + 1]] == again.hashes).all()


def test_runs_don_t_depend_on_place():
    a, b = H.split(pa.array(["x y z w", "q x y z"])), H.split(pa.array(["y z"]))
    assert a.runs(np.array([1]), 2) == a.runs(np.array([6]), 2) == b.runs(np.array([0]), 2) != a.runs(np.array([0]), 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rows = corpus(seed)
    rows += [rows[3], rows[0]]  # repeated rows
    got = N.ngram_join(documents(spark, rows)).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == brute_components(rows)


def test_ngram_join_of_repeated_partitions(spark, tmp_path):
    rng = random.Random(13)
    shared = [f"s{k}" for k in range(60)]
    rows = [(i, " ".join(shared[:44] + [f"x{i}y{rng.randrange(10**6)}" for _ in range(40)])) for i in range(6)] + corpus(14, 40)
    documents(spark, rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = N.ngram_join(docs.union(docs)).collect()
    assert len(got) == 2 * len(rows) and {tuple(r) for r in got} == brute_components(rows)


def test_ngram_join_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP", 4)
    monkeypatch.setattr(N, "RANGE_TOKENS", 500)
    monkeypatch.setattr(N, "KEYS", 1)
    rows = corpus(3, 80)
    assert {tuple(r) for r in N.ngram_join(documents(spark, rows)).collect()} == brute_components(rows)


def test_tree_finds_all_links():
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = rng.choice(200, 40, replace=False)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(28, 40), replace=False), rng.choice(300, rng.integers(0, 6))])).astype(np.uint64) for _ in range(12)]
        sizes = np.array([len(s) + int(rng.integers(0, 4)) for s in sets])
        tree = N.PrefixTree(sets, sizes)
        for i in range(len(sets)):
            found = {tree.order[j] for j in tree.walk(i, np.arange(len(sets)) != i, 0.75)}
            a = tree.order[i]
            every = {b for b in range(len(sets)) if b != a and (o := len(np.intersect1d(sets[a], sets[b]))) >= 0.75 * (sizes[a] + sizes[b] - o)}
            assert found == every


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (5, 5), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 101: 100}
    assert components(edges.where("a < 0")).count() == 0


def brute_dedup(rows, window):
    words = {doc: WORD.findall(t or "") for doc, t in rows}
    first = {}
    for doc in sorted(words):
        for s in range(len(words[doc]) - window + 1):
            first.setdefault(tuple(words[doc][s : s + window]), doc)
    out = {}
    for doc, w in words.items():
        gone = {p for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < doc for p in range(s, s + window)}
        out[doc] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize("hot,window", [(256, 50), (1, 20), (256, 12)])
def test_substring_dedup(spark, monkeypatch, hot, window):
    monkeypatch.setattr(S, "HOT", hot)
    rows = corpus(4, 80)
    got = S.substring_dedup(documents(spark, rows), window=window, anchor=4, carry=("key",)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute_dedup(rows, window)
    assert {r.key for r in got} == {"x"} and sum(r.n_removed for r in got) > 0


@pytest.mark.parametrize("hot", [256, 1])
def test_substring_dedup_of_a_document_that_repeats_itself(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rng = random.Random(11)
    a, b, c, d, p, q = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (100, 100, 100, 100, 50, 70))
    unit = f"{c} {p} {d} {q} {c}"
    rows = [(1, f"{a} {p} {b}"), (2, f"{unit} {unit} {unit}"), (3, f"{b} {q} {a}"), (4, f"{d} {unit} {q}"), (0, f"{b[:300]} {q} {q}")]
    got = S.substring_dedup(documents(spark, rows), window=50).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute_dedup(rows, 50)


@pytest.mark.parametrize("hot", [256, 1])
def test_substring_dedup_of_different_texts_of_one_doc_id(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rng = random.Random(12)
    a, b, c, d, p = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (100, 100, 100, 100, 50))
    rows = [(1, f"{a} {p} {b}"), (2, f"{c} {p} {d}"), (2, "a b c"), (2, f"{d} {c} {p} {d}"), (3, f"{a} {c} {p}"), (3, f"{b} {d}"), (2, f"{c} {p} {d}"), (None, a)]
    got = S.substring_dedup(documents(spark, rows), window=50, carry=("key",)).collect()
    first = {}
    for doc, text in rows[:-1]:
        w = text.split()
        for s in range(len(w) - 49):
            first[tuple(w[s : s + 50])] = min(doc, first.get(tuple(w[s : s + 50]), doc))
    want = []
    for doc, text in rows:
        w = text.split()
        gone = {x for s in range(len(w) - 49) if doc is not None and first[tuple(w[s : s + 50])] < doc for x in range(s, s + 50)}
        want.append((str(doc), len(w), len(gone), " ".join(v for x, v in enumerate(w) if x not in gone)))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)


def test_suffix_automaton():
    rng = random.Random(6)
    for _ in range(200):
        automaton, texts = S.SuffixAutomaton(), []
        for _ in range(3):
            texts.append([rng.randrange(3) for _ in range(rng.randrange(14))])
            automaton.add(texts[-1])
        words = [rng.randrange(3) for _ in range(12)]
        inside = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a, len(t) + 1)}
        covered = {p for a in range(12) for b in range(a + 3, 13) if tuple(words[a:b]) in inside for p in range(a, b)}
        assert {p for a, b in automaton.spans(words, 3) for p in range(a, b)} == covered


def naive_tiles(p, t, least):
    free_p, free_t, out = [1] * len(p), [1] * len(t), []
    while True:
        best, most = [], least
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and free_p[i + k] and free_t[j + k]:
                    k += 1
                if k > most:
                    best, most = [(i, j)], k
                elif k == most:
                    best.append((i, j))
        if not best:
            return out
        for i, j in best:
            if all(free_p[i : i + most]) and all(free_t[j : j + most]):
                out.append((i, j, most))
                free_p[i : i + most] = free_t[j : j + most] = [0] * most


@given(st.lists(st.integers(1, 4), max_size=30), st.lists(st.integers(1, 4), max_size=40))
@settings(max_examples=150, deadline=None)
def test_tiling(p, t):
    a, b = tile(np.array(p, np.uint64), np.array(t, np.uint64), 3), naive_tiles(p, t, 3)
    assert sorted(x[2] for x in a) == sorted(x[2] for x in b)
    assert all(p[i : i + n] == t[j : j + n] for i, j, n in a)


def test_decontamination(spark, monkeypatch):
    import lumisift.llm.decontamination as D

    item = "one two three four five six seven eight nine ten eleven twelve"
    parts = item.split()
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (5, item.upper())], "item_id long, text string")
    rows = [(1, f"junk {item} junk"), (2, " ".join(parts[6:] + ["mid"] + parts[:6])), (3, "One, two; THREE four five. x"), (4, None), (5, ""), (6, "nothing of it"), (7, "one two three x five six seven x nine ten")]
    for block in (2_000_000, 10):
        monkeypatch.setattr(D, "BLOCK_WORDS", block)
        got = {r.doc_id: {(x.item_id, round(x.coverage, 3), x.tiles) for x in r.leaks} for r in decontaminate(documents(spark, rows), benchmark, least=4, threshold=0.5).collect()}
        assert got == {1: {(1, 1.0, 1), (5, 1.0, 1)}, 2: {(1, 1.0, 2), (5, 1.0, 2)}, 3: set(), 4: set(), 5: set(), 6: set(), 7: set()}
    assert decontaminate(documents(spark, rows), benchmark.where("item_id > 9")).where("size(leaks) > 0").count() == 0


def test_decontamination_of_short_and_repeated_items(spark, monkeypatch):
    import lumisift.llm.decontamination as D

    item = "one two three four five six"
    items = [(1, item)] * 3 + [(2, item), (7, "Why not?"), (7, "Why not?"), (8, "why"), (None, "why not"), (9, "..."), (10, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, item), (1, item), (2, "why NOT"), (3, "why not me"), (4, "Why"), (5, "..."), (6, ""), (None, None), (None, "why, not")]
    docs = documents(spark, rows).withColumn("leaks", F.lit("mine")).withColumn("item_id", F.lit(5))
    want = sorted(str((doc, sorted(ids, key=str))) for doc, ids in [(1, [1, 1, 1, 2])] * 2 + [(2, [7, 7, None]), (3, []), (4, [8]), (5, []), (6, []), (None, []), (None, [7, 7, None])])
    for block in (2_000_000, 3):
        monkeypatch.setattr(D, "BLOCK_WORDS", block)
        found = decontaminate(docs, benchmark, carry=("leaks", "item_id"))
        assert found.columns == ["doc_id", "item_id", "text", "leaks"]
        got = found.collect()
        assert sorted(str((r.doc_id, sorted((x.item_id for x in r.leaks), key=str))) for r in got) == want
        assert all(r.item_id == 5 for r in got) and all(x.coverage == 1.0 and x.tiles == 1 for r in got for x in r.leaks)
        assert decontaminate(documents(spark, []), benchmark).count() == 0


def test_token_counts(spark):
    vocabulary = ["▁a", "▁ab", "ab", "abc", "c", "cd", "▁", "bcde"]
    automaton = LongestMatch(vocabulary)
    singles = {c for v in vocabulary for c in v}

    def greedy(word):
        word, i, n = "▁" + word, 0, 0
        while i < len(word):
            k = next((k for k in range(5, 0, -1) if word[i : i + k] in vocabulary), 0)
            n, i = (n + 1, i + k) if k else (n + len(word[i].encode()), i + 1)
        return n

    rng = random.Random(7)
    for _ in range(3000):
        word = "".join(rng.choice("abcde€") for _ in range(rng.randrange(9)))
        assert automaton.count(word) == greedy(word), (word, singles)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(documents(spark, [(1, None), (2, ""), (3, "the the\n日x"), (3, "the the\n日x")]), piece_model()).collect()}
    assert got[1] == got[2] == (0, 0) and got[3][0] == 3


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "Straße", "x1", "naïve", "<|endoftext|>", "don't", "日本", "ΟΔΟΣ", "éa"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(90, None), (91, ""), (92, "word " * 300)]
    got = place(pieces(documents(spark, rows), word_tokenizer(), width=64), width=64).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    packed, parts = {}, {}
    for r in got:
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert own == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
        parts.setdefault(r.doc_id, []).append((r.start, r.length))
        packed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, cut in parts.items():
        assert [s for s, _ in sorted(cut)] == list(np.cumsum([0, *(n for _, n in sorted(cut))])[:-1]) and sum(n for _, n in cut) == len(ids[doc])
    for cut in packed.values():
        assert [o for o, _ in sorted(cut)] == list(np.cumsum([0, *(n for _, n in sorted(cut))])[:-1]) and sum(n for _, n in cut) <= 64
    assert sorted(packed) == list(range(len(packed)))
    assert sum(map(len, ids.values())) > 0.9 * 64 * len(packed)
    assert place(pieces(documents(spark, []), word_tokenizer())).count() == 0


@given(st.dictionaries(st.integers(1, 16), st.integers(1, 20), max_size=10))
@settings(max_examples=100, deadline=None)
def test_patterns_use_all_pieces(histogram):
    used = {}
    for count, pattern in shortest_pack_first(histogram, 16):
        assert sum(pattern) <= 16 and count > 0
        for length in pattern:
            used[length] = used.get(length, 0) + count
    assert used == histogram


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 2, None, "?"), (1, None, "ann", "first"), (None, 0, "cy", "x"), (2, 0, "system", "alone"), (1, 700, "bob", "late")]
    got = rotate_perspectives(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, block int")).collect()
    by = {}
    for r in got:
        by.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "cy")}
    for (_, speaker), turns in by.items():
        turns.sort(key=lambda r: r.position)
        text = "".join(r.segment for r in turns)
        assert [r.position for r in turns] == list(range(len(turns))) and text.count("<|end|>") == len(turns)
        for r in turns:
            assert text[r.begin : r.end] == r.segment
            assert (r.loss_begin is not None) == (r.role == speaker)
            if r.loss_begin is not None:
                assert text[r.loss_begin : r.loss_end].endswith("<|end|>") and text[: r.loss_begin].endswith("<|assistant|>\n")
    assert "<|user bob|>\n" in "".join(r.segment for r in by[1, "ann"])
    assert rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_fingerprints(spark):
    rows = corpus(9, 50) + [(5000, "far away from the others"), (5000, "same id"), (-3, "below zero"), (None, "no id")]
    got = fingerprints(documents(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in order]
    want = []
    for k, (doc, _) in enumerate(order):
        a, b = texts[k], texts[(k + 1) % len(texts)]
        half = len(a) // 2
        want.append((doc, len(a), hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted((str(a), b, c) for a, b, c in want)
    by_text = {}
    lookup = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in got}
    for (doc, n, sha), text in zip(want, texts):
        r = lookup[doc, n, sha]
        by_text.setdefault(text, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert sum(r.near_edited for r in got) > sum(r.near_next for r in got)
    assert fingerprints(documents(spark, [])).count() == 0
    single = fingerprints(documents(spark, [(1, "just one text here")])).head()
    assert single.near_next == 1.0


def test_licenses(spark):
    files = [
        ("/a/LICENSE", "Intro line\n\nReleased under the MIT License."), ("/a/x.py", "print(1)"), ("/a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"), ("/a/b/c/z.py", "code"), ("/a/b/c/d/e", None),
        ("/a/k/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("/a/k/m/n", ""), ("/q/r", "the license of nothing"), ("top", "x"), (None, "All rights reserved."), ("/a/x.py", "print(1)"),
    ]
    got = {}
    for r in scan_licenses(spark.createDataFrame([(*f, 0) for f in files], "path string, text string, term int")).collect():
        got.setdefault(r.path, []).append((r.own_license, r.license, r.inherited_from, r.levels))
    assert got["/a/LICENSE"] == [("MIT", "MIT", None, None)] and got["/a/x.py"] == [(None, "MIT", "/a", 0)] * 2
    assert got["/a/b/c/z.py"] == [(None, "Apache-2.0", "/a/b", 1)] and got["/a/b/c/d/e"] == [(None, "Apache-2.0", "/a/b", 2)]
    assert got["/a/k/m/n"] == [(None, "GPL-3.0", "/a/k", 1)] and got["/q/r"] == got["top"] == [(None, None, None, None)] and got[None] == [("All-rights-reserved", "All-rights-reserved", None, None)]
    assert scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0
    texts = spark.createDataFrame([(f"/t/{i}", "zzz\n" + t) for i, (_, t) in enumerate(TEMPLATES)], "path string, text string")
    assert {(int(r.path[3:]), r.own_license) for r in scan_licenses(texts).collect()} == {(i, k) for i, (k, _) in enumerate(TEMPLATES)}


def test_crc_of_pieces(spark):
    row = pieces(documents(spark, [(1, "hello world")]), word_tokenizer()).select("ids", F.crc32("ids").alias("c")).head()
    assert row.c == zlib.crc32(row.ids)


def test_ngram_join_of_null_and_odd_ids(spark):
    rng = random.Random(21)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(-1, a), (None, b), (5, a + " more"), (6, b + " more"), (None, c), (None, c + " more"), (7, None)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in N.ngram_join(documents(spark, rows)).collect()}
    assert got == {(-1, 56, -1), (5, 57, -1), (None, 56, 6), (6, 57, 6), (None, 56, None), (None, 57, None), (7, 0, 7)}
    assert N.ngram_join(documents(spark, [])).count() == 0


def test_ngram_join_with_n_grams_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_DOCS", 7)
    monkeypatch.setattr(N, "RANGE_TOKENS", 300)
    rng = random.Random(22)
    common = " ".join(f"c{k}" for k in range(12))
    rows = [(i, f"{common} " + " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(30)))) for i in range(60)]
    rows += [(100 + i, t + " x") for i, t in rows[:20]]
    assert {tuple(r) for r in N.ngram_join(documents(spark, rows)).collect()} == brute_components(rows)


def test_substring_dedup_of_nothing_and_clashing_names(spark):
    docs = documents(spark, [(1, "a b"), (2, None)]).withColumn("kept", F.lit("own")).withColumn("spans", F.lit(3))
    got = S.substring_dedup(docs, carry=("kept", "spans", "key")).collect()
    assert sorted((r.doc_id, r.kept, r.n_words, r.n_removed, r.spans, r.key) for r in got) == [(1, "a b", 2, 0, 3, "x"), (2, "", 0, 0, 3, "x")]
    assert S.substring_dedup(documents(spark, [])).count() == 0


def test_packing_passes_clashing_columns(spark):
    cut = spark.createDataFrame([(i, 0, 1 + i % 8, "a", i, i, 9, 9) for i in range(300)], "doc_id long, start long, length long, _part string, _rank int, row int, sequence_id int, offset int")
    got = place(cut, width=8).collect()
    assert {(r.doc_id, r.length, r._rank, r.row, r._part) for r in got} == {(i, 1 + i % 8, i, i, "a") for i in range(300)} and len(got) == 300
    slots = {(r.sequence_id, r.offset + k) for r in got for k in range(r.length)}
    assert len(slots) == sum(r.length for r in got) and max(o for _, o in slots) < 8


def brute_cosines(texts, templates):
    """Per text the best (cosine, template) over lines, sentences and leading block, by plain counts."""
    import math

    def words(text):
        return [w for w in re.split(r"[^\w.]+|_+|\.+(?=\D|$)", text.lower()) if w]

    df = {}
    for t in texts:
        for w in set(words(t)):
            df[w] = df.get(w, 0) + 1

    def vector(text):
        ws = words(text)
        v = {w: ws.count(w) * (math.log((1 + len(texts)) / (1 + df.get(w, 0))) + 1) for w in ws}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / size for w, x in v.items()}

    known = [(name, vector(t)) for name, t in templates]
    out = []
    for t in texts:
        lines = [x for x in re.split(r"\r?\n", t) if x.strip()]
        units = {*lines, *(y for x in lines for y in re.split(r"(?<=[.;!?])\s+", x)), re.split(r"\n[ \t]*\n", t.strip())[0]}
        found = []
        for u in units:
            each = {}
            for i, (name, v) in enumerate(known):
                cosine = round(sum(x * v.get(w, 0) for w, x in vector(u).items()), 6)
                if cosine >= 0.6 and fits(words(u), words(templates[i][1])):
                    each[name] = max(each.get(name, (0, 0)), (cosine, -i))
            ranked = sorted(each.values(), reverse=True)
            if ranked and (len(ranked) < 2 or ranked[0][0] - ranked[1][0] >= L.MARGIN):
                found.append(ranked[0])
        out.append(max(found) if found else None)
    return out


def fits(own, of_template):
    def telling(ws):
        return {w for w in ws if w in L.QUALIFIERS}, re.findall(L.CC_QUALIFIERS, " ".join(ws))[:1] or [""]

    versions = {w for w in of_template if re.fullmatch(r"v?[0-9]{1,2}([.][0-9]{1,2})*", w)}
    return telling(own) == telling(of_template) and versions <= set(own) and sum(w in L.DENIALS for w in own) <= sum(w in L.DENIALS for w in of_template)


def test_neighbouring_licences(spark):
    """A licence of a family isn't taken for another of it, and what is denied or can't be told is none."""
    gpl2 = next(t for k, t in TEMPLATES if k == "GPL-2.0" and "WITHOUT ANY" in t)
    bsd2 = next(t for k, t in TEMPLATES if k == "BSD-2-Clause")
    cases = [
        (gpl2, "GPL-2.0"), (gpl2.replace("version 2", "version 3").replace("program;", "program:"), "GPL-3.0"), ("GNU General Public License, version 2.", "GPL-2.0"), ("GNU General Public License, version 1.", None), (bsd2, "BSD-2-Clause"),
        (bsd2 + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"), ("Licensed under CC BY-NC 3.0.", None),
        ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("Not licensed under the MIT License.", None), ("This is not released under the MIT License.", None), ("Licensed under the MIT License.", "MIT"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3 of the License, or any later version.", "AGPL-3.0"), ("Il sa que Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Sa vie.\nReleased under the MIT License.", "MIT"),
    ]
    rows = [(f"/t/{k:02d}", "x y z\n\n" + t) for k, (t, _) in enumerate(cases)] + [(f"/u/{k}", " ".join(f"w{k * 37 % 50 + j}" for j in range(30)) + " under the license of software") for k in range(40)]
    got = {r.path: r.own_license for r in scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[f"/t/{k:02d}"] for k in range(len(cases))] == [want for _, want in cases]


def test_license_cosines(spark):
    rng = random.Random(31)
    plain = [f"word{i}" for i in range(50)] + ["the", "of", "license", "software", "under"]

    def prose(n):
        return " ".join(rng.choice(plain) for _ in range(n))

    gpl = next(t for k, t in TEMPLATES if k == "GPL-3.0" and "WITHOUT ANY" in t)
    wrapped = "\n".join("# " + gpl[k : k + 72] for k in range(0, len(gpl), 72))
    texts = [prose(60) for _ in range(30)] + [f"{prose(9)}. Released under the MIT License. {prose(9)}.", wrapped + "\n\ncode", "This file has been released under the MIT License by its author", "Copyright (c) 2019 Acme Inc. All rights reserved.", prose(5) + "\n\n\nLicensed under CC BY-NC 4.0.", "", "license of the software"]
    got = {r.path: (r.own_cosine, r.own_license) for r in scan_licenses(spark.createDataFrame([(f"/t/{i:03d}", t) for i, t in enumerate(texts)], "path string, text string"), any_header=True).collect()}
    want = brute_cosines(texts, TEMPLATES)
    for i, best in enumerate(want):
        cosine, name = got[f"/t/{i:03d}"]
        assert (best is None) == (cosine is None), (texts[i], best, cosine)
        assert best is None or (abs(cosine - best[0]) < 2e-6 and name == TEMPLATES[-best[1]][0])
    assert [got[f"/t/{i:03d}"][1] for i in (30, 31, 33, 34)] == ["MIT", "GPL-3.0", "All-rights-reserved", "CC-BY-NC-4.0"]


def test_licence_file_as_a_whole(spark):
    isc = next(t for k, t in TEMPLATES if k == "ISC" and "DISCLAIMS" in t)
    parts = isc.split(". ")
    files = [("/a/LICENSE", "ISC License\n\nCopyright 2020 X\n\n" + ".\n\n".join("\n".join(re.findall(".{1,60}(?: |$)", p)) for p in parts), "c", 1), ("/a/b/x", "code", "d", 2)]
    got = {r.path: r for r in scan_licenses(spark.createDataFrame(files, "path string, text string, license string, term int"), carry=("license", "term")).collect()}
    assert got["/a/LICENSE"].own_license == "ISC" and got["/a/b/x"].license == "ISC" and got["/a/b/x"].levels == 1 and got["/a/b/x"].term == 2


def spark_hash(value, seed=42, size=8):
    """Spark's xxhash64 of a string, a whole number of so many bytes or a list of those."""
    import xxhash

    if isinstance(value, list):
        for x in value:
            seed = spark_hash(x, seed)
        return seed
    data = value.encode() if isinstance(value, str) else value.to_bytes(size, "little", signed=True)
    h = xxhash.xxh64_intdigest(data, seed=seed % 2**64)
    return h - 2**64 if h >= 2**63 else h


def test_fingerprints_against_brute_force(spark):
    from lumisift.llm import fingerprints as P

    rng = random.Random(33)
    vocabulary = [f"t{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary[: 300 if i % 3 else 40]) for _ in range(rng.randrange(1, 60))) for i in range(80)] + ["", "only unseen here"]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints(documents(spark, rows)).collect()}

    def terms(text):
        return {spark_hash(w) for w in re.split(r"[ \t-\r]+", text.lower()) if w}

    df = {}
    for t in texts:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1
    low = max(2, -(-len(texts) // 2000))
    band = {w for w, n in df.items() if low <= n <= max(low, int(len(texts) * P.HIGH))}

    def short(h):
        return f"{h % 2**32:08x}"

    def fingerprint(text):
        own = terms(text)
        met = sorted(own & band)
        if not met:
            return [short(spark_hash(sorted(own))) if own else "-"] * len(P.SUBSETS)
        chosen = [[w for w in met if spark_hash(k, spark_hash(w), 4) % m == 0] for k, m in enumerate(P.SUBSETS)]
        return [c for c in chosen]

    for i, (doc, text) in enumerate(rows):
        after = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        mine = [fingerprint(x) for x in (text, edited, after)]
        said = [got[doc].fingerprint.split("."), got[doc].edited_fingerprint.split("."), got[rows[(i + 1) % len(rows)][0]].fingerprint.split(".")]
        for want, have in zip(mine, said):
            if want and isinstance(want[0], str):
                assert want == have
            else:
                assert [not c for c in want] == [h == "-" for h in have]
        for k, value in ((1, got[doc].near_edited), (2, got[doc].near_next)):
            either = [(a, b) for a, b in zip(said[0], said[k]) if a != "-" or b != "-"]
            assert abs(value - (sum(a == b for a, b in either) / len(either) if either else 1.0)) < 1e-12
            for a, b, x, y in zip(mine[0], mine[k], said[0], said[k]):
                if isinstance(a, list) and isinstance(b, list) and a and b:
                    assert (a == b) == (x == y)


@pytest.mark.parametrize("copies", [50, 20_000])
def test_substring_dedup_of_repeated_rows(spark, copies):
    """Equal rows of one doc_id are looked at once: the spans of each are those of one."""
    rng = random.Random(8)
    passage, other = ([f"{x}{rng.randrange(300)}" for _ in range(120)] for x in "pq")
    one, two, three = " ".join(passage), " ".join(["a"] * 5 + passage[10:90] + other), " ".join(other[20:80] + ["z"])
    few = [(1, one), (2, two), (2, two), (3, three), (3, one), (None, one), (None, one)]
    rows = few + [(2, two)] * copies
    got = S.substring_dedup(documents(spark, rows))
    assert got.count() == len(rows)
    want = {(d, t): x for d, t, *x in ((r.doc_id, r.text, r.kept, r.n_words, r.n_removed) for r in S.substring_dedup(documents(spark, few[:2] + few[3:6])).collect())}
    assert {(r.doc_id, r.text): [r.kept, r.n_words, r.n_removed] for r in got.distinct().collect()} == want and want[2, two][2] == 80


def test_substring_dedup_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 2)
    monkeypatch.setattr(S, "RANGE_WINDOWS", 50)
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(70)]
    rows = [(k, " ".join([f"l{k}{rng.randrange(9)}" for _ in range(20)] + passage + [f"r{k}{rng.randrange(9)}" for _ in range(20)])) for k in range(12)]
    got = S.substring_dedup(documents(spark, rows)).select("doc_id", "n_removed").collect()
    assert {tuple(r) for r in got} == {(0, 0)} | {(k, 70) for k in range(1, 12)}


def test_long_words_are_not_remembered():
    from lumisift.llm.packing import WordEncoder

    counts, encoder = LongestMatch.of(piece_model()), WordEncoder(word_tokenizer())
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5000)) for _ in range(20)]
    assert counts.counts(words + words[:2] + ["short"]) == sum(map(counts.count, words + words[:2] + ["short"]))
    assert [bytes(x) for x in encoder.encode([" ".join(words), words[0] + " it's", "short " + words[0] + ","])] == [encoder.whole(t) for t in (" ".join(words), words[0] + " it's", "short " + words[0] + ",")]
    assert all(len(w) <= 64 for w in counts.known) and all(len(w) <= 64 for w in (*encoder.known, *encoder.before))


def test_fingerprints_of_hot_ids(spark, monkeypatch):
    from lumisift.llm import fingerprints as P

    rng = random.Random(34)
    words = [f"t{i}" for i in range(90)]

    def text():
        return " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))

    same = text()
    rows = [(None, text()) for _ in range(30)] + [(7, text()) for _ in range(30)] + [(7, same)] * 25 + [(None, None)] * 9 + [(7, "")] * 6 + [(i * 97, text()) for i in range(-20, 20)] + [(9, same), (9, same), (10**14, same)]
    rng.shuffle(rows)

    def found():
        return sorted(map(str, fingerprints(documents(spark, rows)).collect()))

    plain = found()
    monkeypatch.setattr(P, "HOT", 4)
    monkeypatch.setattr(P, "REPEATS", 4)
    assert found() == plain
    monkeypatch.setattr(P, "BROADCAST_BUCKETS", 0)
    monkeypatch.setattr(P, "BROADCAST_TERMS", 0)
    assert found() == plain
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in ordered]
    want = []
    for k, (doc, _) in enumerate(ordered):
        a, b = texts[k], texts[(k + 1) % len(texts)]
        half = len(a) // 2
        want.append((doc, hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.edited_sha256)) for r in fingerprints(documents(spark, rows)).collect())


def test_fingerprints_of_many_rows_of_one_id(spark):
    numbered = spark.range(24_000).selectExpr("cast(null as long) AS doc_id", "concat('text number ', id, ' of no document') AS text")
    repeated = spark.range(24_000).selectExpr("5L AS doc_id", "'always the same few words' AS text")
    got = fingerprints(numbered.union(repeated)).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("edited_sha256").alias("edits"), F.countDistinct("fingerprint").alias("prints"), F.sum(F.expr("int(near_next = 1)")).alias("same")).collect()
    by = {r.doc_id: r for r in got}
    assert by[None].n == by[5].n == 24_000 and by[5].edits == 2 and by[5].prints == 1 and by[5].same >= 23_999
    assert by[None].edits > 12_000
