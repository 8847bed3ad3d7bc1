"""Token counts by dynamic programming shared over a trie (operator 2).

A pre-token is a word of a text behind the word mark.  Each task inserts the
distinct pre-tokens that it meets into a trie; every node holds the best unigram
score of its prefix and the number of pieces on that best path, computed once
from the nodes above it.  A pre-token's count is what its terminal node holds.

The vocabulary is a public one, read from a path on the driver and broadcast
(32,000 pieces, under 1 MB).  It stores ranks, not probabilities, so a piece of
rank r gets the score -ln(r + 1), Zipf's law up to a constant per piece, plus a
fixed cost per piece (``PIECE_COST``, ln of the harmonic number of the size).

Scale.  No shuffle: a text is counted where it is read.  The trie is bounded by
``MAX_NODES`` and started afresh beyond it; a pre-token longer than
``LONG_WORD`` is counted by the same recurrence in one pass without being
stored, so time stays linear in a text of any length.

Edge cases: null and empty texts have no words and no tokens; a character
outside the vocabulary counts as its UTF-8 bytes; ties take the longer last
piece; repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MAX_NODES = 1_000_000
LONG_WORD = 64


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """The vocabulary's pieces with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranked = sorted(ids, key=lambda i: (-model.get_score(i), i))
    cost = log(sum(1 / (r + 1) for r in range(len(ranked))))
    return {model.id_to_piece(i): -log(r + 1) - cost for r, i in enumerate(ranked)}


class TrieCounter(dict):
    """word (UTF-8 bytes) -> number of tokens; unseen words go through the trie."""

    def __init__(self, pieces: dict[str, float], max_nodes: int = MAX_NODES):
        super().__init__()
        self.pieces, self.max_nodes = pieces, max_nodes
        self.longest = max(map(len, pieces), default=1)
        self.other = min(pieces.values(), default=0.0) - 10.0  # for each byte of a character outside the vocabulary
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.children: dict[int, int] = {}
        self.best, self.count = array("d", [0.0]), array("q", [0])

    def forward(self, text: str, at: int, best, count) -> tuple[float, int]:
        """Best score and count of text[:at], given those of its last prefixes: best(k) is that of text[:at - k]."""
        top, n = float("-inf"), 0
        for size in range(min(at, self.longest), 0, -1):
            score = self.pieces.get(text[at - size : at])
            if score is not None and best(size) + score > top:
                top, n = best(size) + score, count(size) + 1
        if text[at - 1] not in self.pieces:
            width = len(text[at - 1].encode("utf-8", "surrogatepass"))
            if best(1) + self.other * width > top:
                top, n = best(1) + self.other * width, count(1) + width
        return top, n

    def __missing__(self, word: bytes) -> int:
        text = MARK + word.decode("utf-8", "surrogatepass")
        if len(text) > LONG_WORD:
            return self.one_pass(text)
        if len(self.best) > self.max_nodes or len(self) > self.max_nodes:
            self.reset()
        path, node, children = [0], 0, self.children
        for at, char in enumerate(text, 1):
            key = node << 21 | ord(char)
            node = children.get(key, -1)
            if node < 0:
                top, n = self.forward(text, at, lambda k: self.best[path[-k]], lambda k: self.count[path[-k]])
                node = children[key] = len(self.best)
                self.best.append(top)
                self.count.append(n)
            path.append(node)
        self[word] = n = self.count[node]
        return n

    def one_pass(self, text: str) -> int:
        best, count = [0.0], [0]
        for at in range(1, len(text) + 1):
            top, n = self.forward(text, at, lambda k: best[-k], lambda k: count[-k])
            best.append(top)
            count.append(n)
            if len(best) > 4 * self.longest + 64:
                del best[: -self.longest - 1], count[: -self.longest - 1]
        return count[-1]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row of ``docs``."""
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TrieCounter(pieces.value)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                found = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                words.append(len(found))
                tokens.append(sum(map(counter.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(kernel, "doc_id long, n_words long, n_tokens long")
