"""Learned operators by held-out accuracy, and the pipeline against its stages' rules."""

import random
import re
from collections import Counter
from itertools import groupby, product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from lumisift.llm import quality as Q
from lumisift.llm import toxicity as T
from lumisift.llm.queries import held_out
from lumisift.llm.quality import quality
from lumisift.llm.toxicity import Restorer, character_counts, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")}


def test_restoration(spark, tables):
    restorer = Restorer({r["gram"]: r["n"] for r in character_counts(tables["documents"]).collect()})
    for odd, word in [("1d10t", "idiot"), ("$tup1d", "stupid"), ("s t u p i d", "stupid"), ("i.d.i.o.t", "idiot"), ("stuuuupid", "stupid"), ("p@th3t1c", "pathetic"), ("s-c-u-m", "scum"), ("id1ot!", "idiot"), ("clooown", "clown"), ("a s s", "ass"), ("i - d - i - o - t", "idiot"), ("i..d..i..o..t", "idiot"), ("stu" + 200 * "u" + "pid", "stupid"), ("1d10t_" * 40, " ".join(["idiot"] * 40))]:
        assert restorer.restore(f"So {odd} said") == f"so {word} said"
    plain = "nothing odd here, 42 times (see 3.1)"
    assert restorer.restore(plain) == plain


def test_toxicity(spark, tables):
    scored = toxicity(tables["documents"], tables["labels"], learn=~held_out(), carry=("lang",))
    rows = {r.doc_id: r.score for r in scored.join(tables["labels"], "doc_id").where(held_out()).select("doc_id", "score").collect()}
    truth = {r.doc_id: r.toxic for r in tables["labels"].collect()}
    right = sum((s >= 0.5) == truth[d] for d, s in rows.items())
    assert right / len(rows) > 0.9 and scored.count() == tables["documents"].count()


def test_toxicity_catches_disguise(spark, tables):
    odd = spark.createDataFrame([(1, "well you 1d10t and st00pid cl0wn, trash"), (2, "i d i o t s c u m moron"), (3, "an ordinary text"), (4, None), (5, ""), (3, "an ordinary text")], "doc_id long, text string")
    more = odd.unionByName(tables["documents"].select("doc_id", "text").withColumn("doc_id", tables["documents"].doc_id + 1000))
    labels = tables["labels"].withColumn("doc_id", tables["labels"].doc_id + 1000)
    scores = {r.doc_id: r.score for r in toxicity(more, labels).where("doc_id < 1000").collect()}
    assert scores[1] > 0.5 and scores[2] > 0.5 and max(scores[3], scores[4], scores[5]) < 0.5


def test_nothing_to_learn_from(spark, tables):
    none = tables["labels"].where("doc_id < 0")
    assert {r.score < 0.5 for r in toxicity(tables["documents"].limit(5), none).collect()} == {True}
    assert {r.score for r in quality(tables["documents"].limit(5), none).collect()} == {0.5}
    empty = tables["documents"].where("doc_id < 0")
    assert toxicity(empty, tables["labels"]).count() == 0 and quality(empty, tables["labels"]).count() == 0


def test_quality(spark, tables):
    scored = quality(tables["documents"], tables["labels"], learn=~held_out())
    assert scored.count() == tables["documents"].count()
    rows = scored.join(tables["labels"], "doc_id").where(held_out()).collect()
    assert sum((r.score >= 0.5) == r.quality for r in rows) / len(rows) > 0.88
    odd = spark.createDataFrame([(1, None, None, None, None, 1), (2, "", "en", "s", -5, 1)], "doc_id long, text string, lang string, source string, n_chars long, x int").unionByName(tables["documents"].withColumn("doc_id", tables["documents"].doc_id + 10), allowMissingColumns=True)
    assert all(0 <= r.score <= 1 for r in quality(odd, tables["labels"].withColumn("doc_id", tables["labels"].doc_id + 10)).collect())


def local(rows):
    """Sums over rows that are all here."""
    return lambda f: f(rows)


def test_views_teach_each_other():
    rng = np.random.default_rng(3)

    def rows(n):
        y = (rng.random(n) < 0.6).astype(float)
        return y, np.hstack([y[:, None] * 1.5 + rng.normal(size=(n, 3)), np.ones((n, 1))]), np.hstack([y[:, None] * 1.5 + rng.normal(size=(n, 2)), np.ones((n, 1))])

    y, a, b = rows(75)
    hidden, pool_a, pool_b = rows(3000)
    truth, test_a, test_b = rows(3000)
    kind = np.concatenate([np.where(np.arange(75) % 5 == 0, Q.CALIBRATE, Q.LEARN), np.zeros(3000, dtype=int)])
    both = Q.Rows([np.vstack([a, pool_a]), np.vstack([b, pool_b])], kind, np.concatenate([y, np.full(3000, np.nan)]))
    share = y[kind[:75] == Q.LEARN].mean()
    models = Q.co_train(local(both), [4, 3], share, 3000)
    one, two = (slope * (x @ w) + shift for x, (w, slope, shift) in zip((test_a, test_b), models))
    right = (one + two - np.log(share / (1 - share)) > 0) == truth
    assert right.mean() > 0.9 and right.mean() >= max(((one > 0) == truth).mean(), ((two > 0) == truth).mean())
    # what each view learns from never has the rows that calibrate
    def blank(rows):
        calibrate = rows.kind == Q.CALIBRATE
        return Q.Rows([np.where(calibrate[:, None], 1e3, x) for x in rows.views], rows.kind, np.where(calibrate, 1 - rows.y, rows.y))
    for (w, *_), (v, *_) in zip(models, Q.co_train(local(blank(both)), [4, 3], share, 3000)):
        assert np.allclose(w, v)


def test_cuts_take_the_surest_rows():
    x = np.hstack([np.linspace(-3, 3, 1000)[:, None], np.ones((1000, 1))])
    rows = Q.Rows([x, x[::-1]], np.zeros(1000, dtype=int), np.full(1000, np.nan))
    w = np.array([1.0, 0.0])
    counts = Q._counts([], [w, w])(rows).reshape(2, -1)
    assert counts.sum() == 2000
    given, open_ = Q.assigned(rows, [([w, w], [(int(np.searchsorted(np.cumsum(counts[0]), 10, side="right")) - 1, Q.BINS), (-1, Q.BINS)])])
    assert set(np.flatnonzero(given[0] == 0)) <= set(range(10)) and (given[0] == 0).sum() >= 8 and np.isnan(given[1]).all() and open_.sum() == 1000 - (given[0] == 0).sum()


def test_quality_is_what_plain_numpy_gets(spark, tables):
    """All features in one place, and the gradients and Hessians of a plain fit."""
    docs = tables["documents"].limit(400).cache()
    seen = Q.features(docs, tables["labels"]).toArrow().combine_chunks().to_batches()[0]
    x = np.array(seen.column("x").to_pylist())
    mean, scale = x.mean(0), x.std(0) + 1e-6
    rows = Q._wide(seen, mean, scale)
    learn = rows.kind == Q.LEARN
    share = rows.y[learn].mean()
    fitted = Q.co_train(local(rows), [2 * Q.TEXT_FEATURES + 1, Q.LANGS + Q.SOURCES + 3], share, (rows.kind == Q.OPEN).sum())
    z = sum(slope * (v @ w) + shift for v, (w, slope, shift) in zip(rows.views, fitted)) - np.log(share / (1 - share))
    want = dict(zip(seen.column("doc_id").to_pylist(), 1 / (1 + np.exp(-np.clip(z, -30, 30)))))
    got = {r.doc_id: r.score for r in quality(docs, tables["labels"]).collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in got) < 1e-4
    # one view's fit without any exchange, by plain Newton steps
    w = [np.zeros(v.shape[1]) for v in rows.views]
    for _ in range(12):
        w = Q._step(Q._slopes([], w)(rows), w)
    v, y = rows.views[0][learn], rows.y[learn]
    slope = v.T @ (y - 1 / (1 + np.exp(-(v @ w[0])))) - np.append(np.ones(v.shape[1] - 1), 1e-3) * w[0]
    assert np.abs(slope).max() < 1e-6


def test_pipeline_stages(spark, tmp_path):
    """Planted documents: what each stage must catch goes, all clean documents stay."""
    from tests.llm.test_text_operators import brute_components, brute_dedup

    rng = random.Random(5)
    words = [f"word{i}" for i in range(3000)]
    clean = [(i, " ".join(rng.choices(words, k=rng.randrange(80, 200)))) for i in range(40)]
    passage = " ".join(rng.choices(words, k=90))
    item = " ".join(rng.choices(words, k=40))
    near = clean[0][1].replace(clean[0][1].split()[9], "changed")
    rows = clean + [(50, clean[1][1]), (51, near), (52, f"{clean[2][1][:300]} x1 {passage}"), (53, f"{passage} y1 {clean[3][1][:300]}"), (54, f"lead {item} tail " + " ".join(rng.choices(words, k=20))), (60, None), (61, "")]
    toxic = [(100 + i, "you idiot moron scum " + " ".join(rng.choices(words, k=30))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + toxic], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = [(r.doc_id, r.text) for r in kept.collect()]
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        kept = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert kept.columns == list(corpus_pipeline.COLUMNS)
        after = {r.doc_id: r.text for r in kept.collect()}
        if k == 0:
            assert set(after) == {i for i, _ in rows}
        elif k == 1:
            assert set(after) == {c for _, _, c in brute_components(before)} and not {50, 51} & set(after)
        elif k == 2:
            assert {i: " ".join((t or "").split()) for i, t in after.items()} == {i: text for i, (n, gone, text) in brute_dedup(before, 50).items() if gone < n or not n}
            assert "y1" in after[53] and passage not in after[53]
        else:
            assert set(after) == {i for i, _ in before} - {54}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_near_duplicates_leave_one_row(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[0]), (3, texts[1]), (3, texts[1] + " more"), (None, texts[2]), (None, texts[2]), (None, texts[2] + " more"), (None, texts[3]), (5, texts[3]), (6, texts[4]), (6, ""), (6, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(str(r.doc_id), r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    sure = [("1", texts[0]), ("5", texts[3]), ("6", texts[4]), ("6", ""), ("6", ""), ("None", None)]
    one = [(g, t) for g, t in got if (g, t) not in sure]
    assert sorted(x for x in map(str, got) if x in map(str, sure)) == sorted(map(str, sure))
    assert len(one) == 2 and {(g, t.removesuffix(" more")) for g, t in one} == {("3", texts[1]), ("None", texts[2])}


def model_of(texts):
    counts = Counter()
    for t in texts:
        codes = [0, 0] + [T._class(c) for c in t.lower()] + [0, 0]
        counts.update(zip(codes, codes[1:], codes[2:]))
    return T.Restorer({(a * T._SIZE + b) * T._SIZE + c: n for (a, b, c), n in counts.items()})


def test_restoration_in_every_script():
    restorer = model_of(["ты дурак и болван, какой дурак", "głupi ten człowiek jest głupi", "ο ηλίθιος άνθρωπος είναι ηλίθιος", "you stupid idiot"] * 20)
    for odd, want in [("дураааак", "дурак"), ("д.у.р.а.к", "дурак"), ("д у р а к", "дурак"), ("дур4к", "дурак"), ("głuuupi", "głupi"), ("g.ł.u.p.i", "głupi"), ("ηλίθιοοος", "ηλίθιος"), ("好好好好", "好"), ("日本4語", "日本4語"), ("م.ر.ح.ب.ا", "مرحبا"), ("stuuupid", "stupid"), ("1d1ot", "idiot")]:
        assert restorer.restore(odd) == want, odd


@given(st.text(alphabet="aдłω日.4 @é", max_size=14))
@settings(max_examples=300, deadline=None)
def test_no_letter_is_lost(text):
    """But for repeated ones: runs may become one or two."""
    restorer = model_of(["дада", "łała", "ωωωω", "日日"])
    letters = [c for c in restorer.restore(text) if c in "дłω日"]
    runs = [k for k, _ in groupby(c for c in text if c in "дłω日")]
    assert [k for k, _ in groupby(letters)] == runs


@given(st.text(alphabet="abi1l40!.д", min_size=1, max_size=7))
@settings(max_examples=200, deadline=None)
def test_viterbi_against_all_paths(odd):
    restorer = model_of(["abba bail lab ila", "дaд бабд", "alibi bilabial"] * 5)

    def score(path):
        total, x, y = 0.0, 0, 0
        for emitted, cost in path:
            total += cost
            for char in emitted:
                z = T._class(char)
                if z or y:
                    total += restorer.log.item(x, y, z)
                x, y = y, z
        return total

    cells = [*restorer._lattice(odd), [(" ", 0.0)]]
    best = max(score(p) for p in product(*cells))
    found = restorer.words(odd)
    assert any(abs(score(p) - best) < 1e-9 and "".join(e for e, _ in p).split() == found for p in product(*cells))


def test_scores_against_a_plain_scorer(spark):
    """What is restored, counted and weighed, worked out text by text."""
    rng = random.Random(12)
    clean, foul = [f"word{chr(97 + k)}{chr(97 + j)}" for k in range(8) for j in range(8)], ["stupid", "idiot", "дурак"]
    texts = [" ".join(rng.choices(clean, k=12) + ([rng.choice(foul)] if k % 3 == 0 else [])) for k in range(120)] + ["stuuupid worda", "1d1ot", "д.у.р.а.к", "", "wordaa wordab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in T.toxicity(docs, labels).collect()}
    restorer = model_of(texts)
    sets = [T._features(set(re.findall(r"[^\W\d_]+", restorer.restore(t)))) for t in texts]
    y = np.array([k % 3 == 0 for k in range(120)], dtype=float)
    n = Counter(f for s in sets[:120] for f in s)
    t = Counter(f for k, s in enumerate(sets[:120]) if y[k] for f in s)
    base = y.mean()

    def ratio(f):
        parts = [(t[f], n[f] * base), (n[f] - t[f], n[f] * (1 - base))]
        return sum(a * np.log(a / b) for a, b in parts if a)

    names = sorted((f for f in n if n[f] >= T.SUPPORT and t[f] > n[f] * base), key=lambda f: (-ratio(f), f))[: T.FEATURES]
    x = np.array([[f in s for f in names] + [True] for s in sets], dtype=float)
    w, penalty = np.zeros(len(names) + 1), np.array([1.0] * len(names) + [1e-3])
    for _ in range(12):
        p = 1 / (1 + np.exp(-x[:120] @ w))
        w += np.linalg.solve(np.diag(penalty) + (x[:120] * (p * (1 - p))[:, None]).T @ x[:120], x[:120].T @ (y - p) - penalty * w)
    want = 1 / (1 + np.exp(-x @ w))
    assert all(abs(got[k] - want[k]) < 1e-6 for k in range(len(texts)))
    assert min(got[120], got[121], got[122]) > max(got[123], got[124])
