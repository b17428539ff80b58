"""Token counts under a unigram model, with a trie that shares the dynamic program between pre-tokens.

A pre-token is a word with U+2581 before it.  Its best segmentation has the highest sum of piece scores; at equal sums
the fewest tokens count.  A character that no piece covers costs ``byte_score`` and one token for each of its bytes.
The distinct pre-tokens of a task go into a trie, each node of which keeps the best score and the token count of its
prefix: a prefix is worked out once for all words that begin with it, and a word's count stands at its last node.  A
document's count is the sum over its words, so nothing is shuffled.

Defined cases: null or blank text has no tokens; repeated rows are counted each; an empty table gives an empty result;
texts and words of any length are taken whole.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

#: Nodes and distinct words that a task keeps; beyond that the trie starts anew.
TRIE_NODES = 1_500_000
CACHE_WORDS = 600_000
SPACE_MARK = "▁"


def zipf_scores(path: str) -> dict[str, float]:
    """Scores for the pieces of a sentencepiece file: the logarithm of 1 / rank, as Zipf's law has it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [k for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
    return {model.id_to_piece(k): -math.log(rank + 1) for rank, k in enumerate(usual, 1)}


class Trie:
    """Prefixes of pre-tokens with the best score and token count of each."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self._scores, self._byte = scores, byte_score
        self._longest = max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self._child: dict[tuple[int, str], int] = {}
        self._best, self._tokens = array("d", [0.0]), array("q", [0])
        self._words: dict[bytes, int] = {}

    def count(self, word: str) -> int:
        """Tokens of a pre-token; new prefixes are inserted."""
        node, path = 0, [0]
        child, best, tokens, scores, longest = self._child, self._best, self._tokens, self._scores, self._longest
        for j, c in enumerate(word, 1):
            after = child.get((node, c))
            if after is None:
                size = len(c.encode())
                top, n = best[node] + size * self._byte, tokens[node] + size
                for i in range(max(0, j - longest), j):
                    s = scores.get(word[i:j])
                    if s is not None:
                        at = path[i]
                        value, m = best[at] + s, tokens[at] + 1
                        if value > top or (value == top and m < n):
                            top, n = value, m
                after = len(best)
                best.append(top), tokens.append(n)
                child[node, c] = after
            node = after
            path.append(node)
        return tokens[node]

    def words(self, found: list[bytes]) -> int:
        """Tokens of all words of a text."""
        known = self._words
        try:
            return sum(map(known.__getitem__, found))
        except KeyError:
            if len(self._best) > TRIE_NODES or len(known) > CACHE_WORDS:
                self.clear()
                known = self._words
            for w in sorted(set(found).difference(known)):
                known[w] = self.count(SPACE_MARK + w.decode())
            return sum(map(known.__getitem__, found))


def count_tokens(docs: DataFrame, scores: dict[str, float], byte_score: float = -20.0) -> DataFrame:
    """doc_id, n_words and n_tokens of each row. ``scores``: of the vocabulary's pieces, a table of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value, byte_score)
        for batch in batches:
            n, tokens = [], []
            for text in batch.column(1):
                found = (text.as_py() or "").encode().split()
                n.append(len(found))
                tokens.append(trie.words(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_words long, n_tokens long")
