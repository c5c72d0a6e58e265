"""Token counts by a linear longest-match automaton.

Words are cut greedily: always the longest vocabulary piece that comes next, word by word, the first piece with the word mark. The
automaton is a trie of the pieces; a node's failure link leads to where the search stands after
the pieces that are certain there are popped, and its count is precomputed, so that a word is
read once, left to right, and its number of pieces is a sum: no piece is built.

Characters that are no pieces themselves count as their UTF-8 bytes (byte fallback). A null or empty text has no words and no
tokens. Repeated rows count each. Very long texts and words are read whole, in time linear in their length. Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import lean, small_batches

#: Words whose counts a worker remembers; beyond, it starts anew.
CACHED_WORDS = 500_000
#: Longer words aren't remembered.
REMEMBERED = 64


class LongestMatch:
    """The automaton of a vocabulary. Words are read with ``mark`` before them."""

    _of: dict[tuple[str, str], LongestMatch] = {}

    def __init__(self, pieces, mark: str = "▁"):
        self.mark = mark
        self.edges: list[dict[str, int]] = [{}]
        weight = {0: 0}
        singles = {c for piece in pieces for c in piece}
        for piece, count in [*((c, len(c.encode())) for c in sorted(singles)), *((p, 1) for p in pieces if p)]:
            node = 0
            for char in piece:
                node = self.edges[node].setdefault(char, len(self.edges))
                if node == len(self.edges):
                    self.edges.append({})
            weight[node] = count
        self.fail, self.popped = [-1] * len(self.edges), [0] * len(self.edges)
        level = [(0, char, node) for char, node in self.edges[0].items()]
        while level:
            for parent, char, node in level:
                if node in weight:
                    self.fail[node], self.popped[node] = 0, weight[node]
                    continue
                state, popped = self.fail[parent], self.popped[parent]
                while state >= 0 and char not in self.edges[state]:
                    popped += self.popped[state]
                    state = self.fail[state]
                # every character of a piece is a piece, so the search never ends outside
                self.fail[node], self.popped[node] = self.edges[state][char], popped
            level = [(node, char, child) for _, _, node in level for char, child in self.edges[node].items()]
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, path: str, mark: str = "▁") -> LongestMatch:
        """This worker's automaton of a sentencepiece model file; control and byte pieces are left out."""
        if (path, mark) not in cls._of:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            cls._of[path, mark] = cls([model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))], mark)
        return cls._of[path, mark]

    def count(self, word: str) -> int:
        """Pieces of one word."""
        state = total = 0
        edges, fail, popped = self.edges, self.fail, self.popped
        for char in self.mark + word:
            while char not in edges[state]:
                total += popped[state]
                if not state:  # no piece has this character
                    total += len(char.encode("utf-8", "replace"))
                    break
                state = fail[state]
            else:
                state = edges[state][char]
        while state:
            total += popped[state]
            state = fail[state]
        return total

    def counts(self, words: list[str]) -> int:
        known = self.known
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHED_WORDS:
                known.clear()
            long: dict[str, int] = {}
            for word in set(words).difference(known):
                (known if len(word) <= REMEMBERED else long)[word] = self.count(word)
            if long:
                return sum(long[word] if word in long else known[word] for word in words)
            return sum(map(known.__getitem__, words))


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each text. model: the path of a sentencepiece file that all executors can read."""

    small_batches(docs.sparkSession)

    def run(batches):
        automaton = LongestMatch.of(model)
        for batch in batches:
            words, tokens = [], []
            for lo in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(lo, 256).to_pylist():
                    split = (text or "").split()
                    words.append(len(split))
                    tokens.append(automaton.counts(split))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_words long, n_tokens long")
