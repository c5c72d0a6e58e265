"""Quality by co-training of a text view and a page view.

Two logistic regressions see a document apart: one its text (shares of letters, marks, digits and capitals, lengths and repetition
of words and lines), the other what is known about the page (language, source, length). Each round both label those of all
unlabelled rows that they're surest of (the SHARE of them with the lowest and highest scores), and each learns from what the other has labelled. Their
outputs are then calibrated on a fifth of the labelled rows, from which neither has learnt, and the sum of calibrated views scores every document.

The features of all documents are stored once, without the texts. Every Newton step of the fits, every histogram of scores for the cuts, and the
calibration is one pass over them that sums in the tasks and by key in Spark; only the sums come to the driver, as many for any number of
rows. Which rows are labelled isn't stored but follows from the models and cuts of earlier rounds.

Without labels of both kinds every score is the share of good labels, 0.5 without any. Null texts, languages and sources are empty, a null or negative
length counts as 0. Several labels of one doc_id count as their smallest; those of null or of doc_ids that no document has don't count. Repeated rows are
scored, and labelled or learnt from, each. Very long texts are read whole. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import lean, small_batches, stored

#: Rounds of exchange, and the share of the unlabelled rows that each view labels in a round.
ROUNDS, SHARE = 4, 0.04
#: Newton steps of the first fit, of each next one (from the weights before) and of the last.
STEPS = (8, 2, 4)
LONGEST_STEP = 2.0
#: Scores are counted in so many bins up to this size.
BINS, EDGE = 4096, 16.0
#: What a row is for: it has no label, its label is learnt from, or calibrates.
OPEN, LEARN, CALIBRATE = 0, 1, 2

_CLASSES = np.zeros(0x250, dtype=np.int64)  # 0 other, 1 small letter, 2 capital, 3 digit, 4 space, 5 line end, 6 mark
for _c in range(0x250):
    _s = chr(_c)
    _CLASSES[_c] = 5 if _s == "\n" else 4 if _s.isspace() else 3 if _s.isdigit() else 2 if _s.isupper() else 1 if _s.isalpha() else 6
#: Features of the text, and places for hashes of languages and sources.
TEXT_FEATURES, LANGS, SOURCES = 16, 16, 64


def text_features(text: str) -> list[float]:
    """What the text view sees."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = _CLASSES[np.minimum(points, 0x24F)]
    n = np.bincount(kinds, minlength=7)
    total, words = max(1, len(points)), text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    unique = set(words)
    doubled = sum(map(str.__eq__, words, words[1:]))
    marks = int((points[1:] == points[:-1])[kinds[1:] == 6].sum())
    single = sum(len(w) == 1 and not w.isalnum() for w in unique)
    count = max(1, len(words))
    return [
        n[1] / total, n[2] / total, n[3] / total, n[6] / total, n[5] / total, marks / total, np.log1p(len(words)), len(unique) / count, np.log(count) * len(unique) / count,
        doubled / count, total / count / 10, len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), np.log1p(total / max(1, len(lines))), float(single > 0), text.count("|") / count,
    ]


@dataclass
class Rows:
    """Some rows as both views see them (with a last feature of one), what they're for, and their labels."""

    views: list[np.ndarray]
    kind: np.ndarray
    y: np.ndarray


#: Weights of both views, and the bins up to and from which each labels rows.
Round = tuple[list[np.ndarray], list[tuple[int, int]]]
#: Sums a function's vectors over all rows.
Gather = Callable[[Callable[[Rows], np.ndarray]], np.ndarray]


def _bins(scores: np.ndarray) -> np.ndarray:
    return np.clip((scores + EDGE) * (BINS / 2 / EDGE), 0, BINS - 1).astype(np.int64)


def assigned(rows: Rows, rounds: list[Round]) -> tuple[list[np.ndarray], np.ndarray]:
    """The labels that each view has given (nan: none), and which rows are still open."""
    given, open_ = [np.full(len(rows.kind), np.nan) for _ in rows.views], rows.kind == OPEN
    for weights, cuts in rounds:
        taken = np.zeros(len(open_), dtype=bool)
        for label, x, w, (low, high) in zip(given, rows.views, weights, cuts):
            at = _bins(x @ w)
            for chosen, y in ((open_ & (at <= low), 0.0), (open_ & (at >= high), 1.0)):
                label[chosen] = y
                taken |= chosen
        open_ &= ~taken
    return given, open_


def _slopes(rounds: list[Round], weights: list[np.ndarray]) -> Callable[[Rows], np.ndarray]:
    """Gradient and upper half of the negated Hessian of each view's log likelihood."""

    def run(rows: Rows) -> np.ndarray:
        given, _ = assigned(rows, rounds)
        out = []
        for x, w, other in zip(rows.views, weights, given[::-1]):
            y = np.where(rows.kind == LEARN, rows.y, other)
            x, y = x[~np.isnan(y)], y[~np.isnan(y)]
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            out += [x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x)[np.triu_indices(len(w))]]
        return np.concatenate(out)

    return run


def _step(sums: np.ndarray, weights: list[np.ndarray], ridge: float = 1.0) -> list[np.ndarray]:
    """Newton's step with a ridge penalty on all but the constants; a longer one than LONGEST_STEP is cut short, for it may overshoot."""
    out, at = [], 0
    for w in weights:
        n = len(w)
        penalty = np.append(np.full(n - 1, ridge), 1e-3)
        slope = sums[at : at + n] - penalty * w
        bend = np.zeros((n, n))
        bend[np.triu_indices(n)] = sums[at + n : at + n + n * (n + 1) // 2]
        bend = bend + np.triu(bend, 1).T + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        out.append(w + step * min(1.0, LONGEST_STEP / max(1e-12, float(np.linalg.norm(step)))))
        at += n + n * (n + 1) // 2
    return out


def _counts(rounds: list[Round], weights: list[np.ndarray]) -> Callable[[Rows], np.ndarray]:
    """How many open rows have a score of each bin, by view."""

    def run(rows: Rows) -> np.ndarray:
        _, open_ = assigned(rows, rounds)
        return np.concatenate([np.bincount(_bins(x[open_] @ w), minlength=BINS).astype(float) for x, w in zip(rows.views, weights)])

    return run


def _platt(counts: np.ndarray) -> tuple[float, float]:
    """Slope and constant from counts by label (0, 1) and bin; 1 and 0 where there aren't both labels."""
    x = np.stack([(np.arange(BINS) + 0.5) * (2 * EDGE / BINS) - EDGE, np.ones(BINS)], 1)
    w = np.array([1.0, 0.0])
    if not (counts.sum(1) > 0).all():
        return 1.0, 0.0
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        n = counts.sum(0)
        w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag([0.1, 1e-3]), x.T @ (counts[1] - n * p) - np.array([0.1, 1e-3]) * w)
    return float(w[0]), float(w[1])


def co_train(gather: Gather, sizes: list[int], share: float, pool: float) -> list[tuple[np.ndarray, float, float]]:
    """Weights, slope and constant of each view. share: of good ones among the rows to learn from; pool: the number of open rows."""
    weights, rounds = [np.zeros(n) for n in sizes], []
    for k in range(ROUNDS):
        for _ in range(STEPS[min(k, 1)]):
            weights = _step(gather(_slopes(rounds, weights)), weights)
        cuts = []
        for counts in gather(_counts(rounds, weights)).reshape(-1, BINS):
            low = int(np.searchsorted(np.cumsum(counts), SHARE * pool * (1 - share), side="right")) - 1
            high = BINS - int(np.searchsorted(np.cumsum(counts[::-1]), SHARE * pool * share, side="right"))
            cuts.append((low, max(high, low + 1)))
        rounds.append((weights, cuts))
    for _ in range(STEPS[2]):
        weights = _step(gather(_slopes(rounds, weights)), weights)

    def calibration(rows: Rows) -> np.ndarray:
        held = rows.kind == CALIBRATE
        return np.concatenate([np.bincount(rows.y[held].astype(np.int64) * BINS + _bins(x[held] @ w), minlength=2 * BINS).astype(float) for x, w in zip(rows.views, weights)])

    return [(w, *_platt(counts)) for w, counts in zip(weights, gather(calibration).reshape(-1, 2, BINS))]


def _wide(batch: pa.RecordBatch, mean: np.ndarray, scale: np.ndarray) -> Rows:
    """Stored features as both views see them: standardised values and their squares, and the places of language and source."""
    n = batch.num_rows
    x = batch.column("x").flatten().to_numpy().reshape(n, TEXT_FEATURES + 1).astype(np.float64)
    z = np.clip((x - mean) / scale, -5, 5)
    one = np.ones((n, 1))
    page = np.zeros((n, LANGS + SOURCES))
    page[np.arange(n), batch.column("lang").to_numpy()] = 1
    page[np.arange(n), LANGS + batch.column("source").to_numpy()] = 1
    y = batch.column("y").cast(pa.float64()).to_numpy(zero_copy_only=False)
    return Rows([np.hstack([z[:, :-1], z[:, :-1] ** 2, one]), np.hstack([page, z[:, -1:], z[:, -1:] ** 2, one])], batch.column("kind").to_numpy(), y)


def _see(batches):
    for batch in batches:
        x = np.array([text_features(t or "") for t in batch.column("text").to_pylist()], dtype=np.float64).reshape(-1, TEXT_FEATURES)
        length = np.log1p(np.maximum(0, np.nan_to_num(batch.column("n_chars").to_numpy(zero_copy_only=False))))
        x = pa.array(np.hstack([x, length[:, None]]).ravel())
        places = [pa.array([zlib.crc32((v or "").encode()) % n for v in batch.column(c).to_pylist()], pa.int32()) for c, n in (("lang", LANGS), ("source", SOURCES))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.FixedSizeListArray.from_arrays(x, TEXT_FEATURES + 1).cast(pa.list_(pa.float64())), *places], ["doc_id", "x", "lang", "source"])


def _summed(seen: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of the vectors that ``make`` has for each batch: added up in each task, then by place in Spark."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                total = make(batch) if total is None else total + make(batch)
        if total is not None:
            at = np.flatnonzero(total)
            at = at if len(total) - 1 in at else np.append(at, len(total) - 1)  # the last place tells the length
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "v"])

    sums = seen.mapInArrow(lean(run), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(max(sums.column("k").to_pylist(), default=-1) + 1)
    out[sums.column("k").to_numpy()] = sums.column("v").to_numpy()
    return out


def features(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """(doc_id, x, lang, source, y, kind) of each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")), F.col("n_chars").cast("double").alias("n_chars"))
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    if learn is not None:
        good = good.where(learn)
    good = good.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("y"))
    kind = F.when(F.col("y").isNull(), OPEN).when(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0, CALIBRATE).otherwise(LEARN)
    return rows.mapInArrow(lean(_see), "doc_id long, x array<double>, lang int, source int").join(good, "doc_id", "left").withColumn("kind", kind)


def quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """(doc_id, text_score, page_score, score): probabilities of good quality by either view and by both.

    docs: (doc_id, text, lang, source, n_chars); labels: (doc_id, quality). learn: a condition on doc_id, which labelled rows may be learnt from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    seen = stored(features(docs, labels, learn))
    told = {r["kind"]: (r["n"], r["y"] or 0) for r in seen.groupBy("kind").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()}
    n, good = told.get(LEARN, (0, 0))
    models, base = None, 0.5
    if 0 < good < n:

        def moments(batch):
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            return np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])

        sums = _summed(seen, moments)
        mean, squares = (sums[:-1] / sums[-1]).reshape(2, -1)
        scale = np.sqrt(np.maximum(0, squares - mean * mean)) + 1e-6
        share = good / n
        models = co_train(lambda f: _summed(seen, lambda batch: f(_wide(batch, mean, scale))), [2 * TEXT_FEATURES + 1, LANGS + SOURCES + 3], share, told.get(OPEN, (0, 0))[0])
        models = (mean, scale, models, float(np.log(share / (1 - share))))
    elif n + told.get(CALIBRATE, (0, 0))[0]:
        base = (good + told.get(CALIBRATE, (0, 0))[1]) / (n + told.get(CALIBRATE, (0, 0))[0])
    sent = spark.sparkContext.broadcast(models)

    def score(batches):
        for batch in batches:
            if sent.value is None:
                scores = [np.full(batch.num_rows, base)] * 3
            else:
                mean, scale, fitted, constant = sent.value
                a, b = (slope * (x @ w) + shift for x, (w, slope, shift) in zip(_wide(batch, mean, scale).views, fitted))
                scores = [1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (a, b, a + b - constant)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, scores)], ["doc_id", "text_score", "page_score", "score"])

    return seen.mapInArrow(lean(score), "doc_id long, text_score double, page_score double, score double")
