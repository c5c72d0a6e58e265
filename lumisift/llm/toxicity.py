"""Toxicity by noisy-channel restoration of obfuscated words.

1. *Character model.* Trigram counts of letters over the words of all documents; their number is
   bounded by the alphabet (Latin and Cyrillic letters and one class for all other letters), not by the corpus.
2. *Restoration.* Stretches with leetspeak between letters, letters repeated three
   times or more, or three single letters or more strung out by spaces or marks become character lattices, however long; a
   Viterbi search under the channel's costs and the character model finds the likeliest letters, which replace the stretch.
   A letter stands for itself in every script, a run of it for one or two: no restored stretch loses a letter.
   All other stretches have one path through the lattice and stay as they are.
3. *Lexicon.* Words and their beginnings of 4 and 5 letters in the restored texts of labelled
   documents; of those that stand in SUPPORT labelled documents the FEATURES whose presence tells most of the
   label (likelihood ratio) are the model's features, a size chosen for the model, not for the rows.
4. *Score.* Logistic regression with a ridge penalty on the presence of these features, learnt from at most
   LABELLED labelled rows (those of the smallest hash), then applied to every text.

Only the text enters the score. Null and empty texts get the score of a text without
features; so does every text where there is nothing to learn from (no labels: 0). Labels of null, of doc_ids
that no document has, and rows left out by ``learn`` have no influence; several labels of one doc_id count as their
largest. Repeated rows are scored each; an empty table gives an empty result. Very long texts and words are read whole, in
time linear in their length. Columns of docs that aren't in ``carry`` are ignored; carried columns pass unless they have the name of a result column, which then wins.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import hand_back, lean, small_batches, stored

#: Labelled rows to learn from, at most.
LABELLED = 20_000
#: Features of the score, at most.
FEATURES = 512
#: Labelled documents in which a feature must stand.
SUPPORT = 3

#: Rows of the fit that are laid out at a time.
BLOCK = 2048

#: What each character may stand for, in Latin and Cyrillic (fixed values).
LEET = {"0": "oо", "1": "il", "3": "eзе", "4": "aча", "5": "s", "7": "tт", "8": "bв", "9": "g", "6": "gbб", "@": "aа", "$": "s", "!": "i", "|": "li", "+": "tт", "€": "eе", "£": "l"}
#: Those that may as well end a word.
STOPS = "!|+"
#: Letters of the character model: a-z, the small letters of Latin-1 and Cyrillic (fixed values).
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ" + "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
_SIZE = 96
_CODE = {c: i for i, c in enumerate(LETTERS, 1)}
#: All other letters.
_OTHER = len(LETTERS) + 1


@cache
def _classes() -> np.ndarray:
    """The class of each code point: a letter's own, that of all other letters, or 0."""
    points = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    table = np.where(points, np.uint8(_OTHER), np.uint8(0))
    for c, i in _CODE.items():
        table[ord(c)] = i
    return table


def _class(char: str) -> int:
    return _CODE.get(char) or (_OTHER if char.isalpha() else 0)


_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.escape("".join(LEET))
_STRETCH = re.compile(rf"[\w{_MARKS}]+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_TAIL = re.compile(r"([^\w\s])\1\1+$")
_STRUNG = re.compile(r"(?<![^\W_])[^\W_](?:[.\-_*~]+[^\W_]){2,}(?![^\W_])")
_SPACED = re.compile(rf"(?<!\S)[\w{_MARKS}](?:(?: [.\-_*~]+)* [\w{_MARKS}]){{2,}}(?!\S)")
#: Longer tokens aren't remembered.
REMEMBERED = 64


def character_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): how often each letter trigram stands in the words of all texts."""

    def run(batches):
        counts = np.zeros(_SIZE**3, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                text = "\n".join(t or "" for t in batch.column(0).slice(lo, 256).to_pylist()).lower()
                for at in range(0, len(text), 1 << 21):  # a very long text in parts that overlap by a trigram's two letters
                    points = np.frombuffer(text[max(0, at - 2) : at + (1 << 21)].encode("utf-32-le", "replace"), np.uint32)
                    codes = _classes()[points].astype(np.int64)
                    codes = codes if at else np.concatenate([[0, 0], codes])
                    codes = codes if at + (1 << 21) < len(text) else np.concatenate([codes, [0, 0]])
                    counts += np.bincount(codes[:-2] * _SIZE * _SIZE + codes[1:-1] * _SIZE + codes[2:], minlength=_SIZE**3)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["gram", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Restorer:
    """Viterbi decoder of character lattices under trigram counts."""

    def __init__(self, counts: dict[int, int]):
        grams = np.zeros((_SIZE, _SIZE, _SIZE))
        if counts:
            grams.ravel()[list(counts)] = list(counts.values())
        single = grams.sum((0, 1)) + 1
        pairs = grams.sum(0) + 2 * single / single.sum()
        pair = pairs / pairs.sum(1, keepdims=True)
        grams += 4 * pair[None]
        self.log = np.log(grams / grams.sum(2, keepdims=True)).astype(np.float32)  # each worker has one
        self.known: dict[str, list[str]] = {}
        self.seen: dict[str, tuple[str, ...]] = {}

    def _lattice(self, odd: str) -> list[list[tuple[str, float]]]:
        """For each stretch of equal characters what may have been meant, with log costs; '' is nothing and ' ' an end of a word."""
        strung = len(odd) > 4 and not odd[1].isalnum() and odd[1] not in LEET
        cells = []
        for run in re.finditer(r"(.)\1*", odd, re.S):
            char, n = run[1], len(run[0])
            if char in LEET:
                cells.append([(x * k, -1.0 - 1.5 * (n - k)) for x in LEET[char] for k in {1, min(n, 2)}] + [(" ", -1.5 if char in STOPS else -6.0)])
            elif char.isalpha():
                cells.append([(char * n, 0.0), (char, -2.0)] if n == 2 else [(char, 0.0)] if n == 1 else [(char, -0.5), (char * 2, -0.7)])
            elif strung:
                cells.append([("", -0.5), (" ", -1.5)])
            else:
                cells.append([(" ", 0.0)])
        return cells

    def words(self, odd: str) -> list[str]:
        """The words of the likeliest path. Paths are chains of what they emit, so that time and memory follow the length."""
        if odd in self.known:
            return self.known[odd]
        log, paths = self.log.item, {(0, 0): (0.0, None)}
        for cell in [*self._lattice(odd), [(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, path) in paths.items():
                for emitted, cost in cell:
                    total, x, y = score + cost, a, b
                    for char in emitted:
                        z = _class(char)
                        if z or y:  # a second space costs nothing
                            total += log(x, y, z)
                        x, y = y, z
                    if (x, y) not in new or new[x, y][0] < total:
                        new[x, y] = (total, (path, emitted))
            paths = new
        path, found = max(paths.values(), key=lambda p: p[0])[1], []
        while path:
            path, emitted = path
            found.append(emitted)
        found = "".join(reversed(found)).split()
        if len(odd) <= REMEMBERED:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[odd] = found
        return found

    def odd(self, token: str) -> list[str]:
        """Stretches of a token, without blanks, that are restored."""
        token = _TAIL.sub("", token)
        found = [m[0] for m in _STRUNG.finditer(token) if sum(c.isalpha() for c in m[0]) > 1]
        for stretch in _STRETCH.findall(token):
            core = stretch.rstrip(STOPS)
            if _TRIPLE.search(core) or (not core.isalpha() and any(c in LEET for c in core) and any(c in _CODE for c in core)):
                found.append(stretch)
        return found

    def restored(self, token: str) -> tuple[str, int]:
        """A token with its odd stretches replaced, and how many those are."""
        odd = self.odd(token)
        for stretch in odd:
            token = token.replace(stretch, " ".join(self.words(stretch)))
        return token, len(odd)

    def token(self, token: str) -> tuple[tuple[str, ...], int]:
        """Words of a restored token, and how many stretches were restored."""
        bare = token.strip(".,;:!?\"'()&%#*")
        if bare.isalpha() and not _TRIPLE.search(bare):
            return (bare,), 0
        text, odd = self.restored(token)
        return tuple(_WORD.findall(text)), odd

    def tokens(self, text: str) -> tuple[list[str], int]:
        """Tokens of the lower-cased text, its runs of single characters between blanks restored, and how many those are."""
        tokens, runs = text.lower().split(), 0
        if sum(len(t) == 1 for t in tokens) < 3:
            return tokens, 0

        def run(m: re.Match) -> str:
            nonlocal runs
            if sum(c.isalpha() for c in m[0]) < 3:
                return m[0]
            runs += 1
            return " ".join(self.words(m[0]))

        return _SPACED.sub(run, " ".join(tokens)).split(), runs

    def restore(self, text: str) -> str:
        """The lower-cased text with obfuscated stretches replaced, its blanks as single spaces."""
        return " ".join(self.restored(token)[0] for token in self.tokens(text)[0])

    def vocabulary(self, text: str) -> set[str]:
        """Distinct words of the restored text."""
        words: set[str] = set()
        if len(self.seen) > 200_000:
            self.seen.clear()
        for token in set(self.tokens(text)[0]):
            found = self.seen.get(token)
            if found is None:
                found = self.token(token)[0]
                if len(token) <= REMEMBERED:
                    self.seen[token] = found
            words.update(found)
        return words


class Scorer:
    """Features that a text has, token by token: what a token adds is found out once."""

    def __init__(self, restorer: Restorer, weights: dict[str, float], constant: float):
        self.restorer, self.weights, self.constant = restorer, weights, constant
        self.known: set[str] = set()
        self.telling: dict[str, tuple[tuple[str, ...], int]] = {}

    def _learn(self, tokens: set[str]) -> None:
        if len(self.known) > 250_000:
            self.known.clear()
            self.telling.clear()
        weights = self.weights
        for token in tokens - self.known:
            words, odd = self.restorer.token(token)
            found = tuple(f for w in words for f in (w, w[:4] + "*", w[:5] + "*") if f in weights)
            if found or odd:
                self.telling[token] = (found, odd)
        self.known |= tokens

    def score(self, text: str) -> tuple[float, int]:
        tokens, restored = self.restorer.tokens(text)
        found, distinct = set(), set(tokens)
        self._learn(distinct)
        for token in distinct & self.telling.keys():
            features, odd = self.telling[token]
            found.update(features)
            restored += odd
        long = {t for t in distinct if len(t) > REMEMBERED}
        self.known -= long
        for token in long & self.telling.keys():
            del self.telling[token]
        z = self.constant + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), restored


def _features(words: set[str]) -> set[str]:
    return words | {w[:4] + "*" for w in words} | {w[:5] + "*" for w in words}


def _fit(ends: np.ndarray, at: np.ndarray, width: int, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the constant.

    Row i has the features at[ends[i]:ends[i + 1]], each once. Only BLOCK rows are laid out at a time.
    """
    w = np.zeros(width + 1)
    penalty = np.full(width + 1, ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        slope, bend = -penalty * w, np.diag(penalty)
        for lo in range(0, len(y), BLOCK):
            cut = ends[lo : lo + BLOCK + 1]
            x = np.zeros((len(cut) - 1, width + 1))
            x[:, -1] = 1
            x[np.repeat(np.arange(len(x)), np.diff(cut)), at[cut[0] : cut[-1]]] = 1
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope += x.T @ (y[lo : lo + BLOCK] - p)
            bend += (x * (p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _lexicon(sample: DataFrame, restorer: Restorer) -> tuple[list[str], np.ndarray]:
    """Features and weights from a bounded sample (text, y)."""

    def count(batches):
        n, toxic = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                found = _features(restorer.vocabulary(text or ""))
                n.update(found)
                if y:
                    toxic.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([toxic[k] for k in n], pa.int64())], ["feature", "n", "toxic"])

    rows, positive = sample.agg(F.count("*"), F.sum("y")).head()
    if not rows or not positive or positive == rows:
        return [], np.array([math.log(30) if rows and positive == rows else -math.log(30)])
    counted = sample.mapInArrow(lean(count), "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= SUPPORT)
    base = positive / rows

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = part(F.col("t"), F.col("n") * base) + part(F.col("n") - F.col("t"), F.col("n") * (1 - base))
    best = counted.where(F.col("t") > F.col("n") * base).select("feature", ratio.alias("g")).orderBy(F.desc("g"), "feature").limit(FEATURES).collect()
    names = [r["feature"] for r in best]
    place = {f: k for k, f in enumerate(names)}

    def present(batches):
        for batch in batches:
            found = [sorted(place[f] for f in _features(restorer.vocabulary(t or "")) & place.keys()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.int32()))], ["y", "at"])

    held = sample.mapInArrow(lean(present), "y int, at array<int>").toArrow().combine_chunks()
    lists = held.column("at").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    return names, _fit(lists.offsets.to_numpy(), lists.values.to_numpy(), len(names), held.column("y").to_numpy().astype(np.float64))


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of carry, text, score (0 to 1) and n_restored of each row.

    labels: (doc_id, toxic). learn: a condition on doc_id, which labelled rows may be learnt from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counts = character_counts(docs).toArrow()  # at most _SIZE**3 rows
    restorer = Restorer(dict(zip(counts.column("gram").to_pylist(), counts.column("n").to_pylist())))
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    if learn is not None:
        rows = rows.where(learn)
    chosen = rows.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = stored(texts.join(F.broadcast(chosen), "doc_id").select("text", "y"))  # at most LABELLED rows are broadcast
    names, weights = _lexicon(sample, restorer)
    hand_back()
    model = spark.sparkContext.broadcast((restorer, {f: float(w) for f, w in zip(names, weights)}, float(weights[-1])))

    def score(batches):
        scorer = Scorer(*model.value)
        for batch in batches:
            results = [scorer.score(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r[0] for r in results], pa.float64()), pa.array([r[1] for r in results], pa.int64())], [*batch.schema.names, "score", "n_restored"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c for c in carry if c not in ("doc_id", "text", "score", "n_restored")), F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return out.mapInArrow(lean(score), schema + ", score double, n_restored long")
