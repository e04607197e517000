"""Token counts (operator 6): unigram dynamic programming shared along a trie.

Pre-tokens are the words of a text with a mark before them. The distinct pre-tokens of a task go into
a trie. The best forward score of a prefix and its number of tokens depend on the prefixes above
alone, so they are computed once for each node of the trie, whichever pre-tokens share it; a
pre-token's count is that of its terminal node. A document's count is the sum over its words.

The vocabulary is that of a public tokenizer file; its pieces, in their order, get the
log-probabilities of Zipf's law. A character that no piece covers costs ``UNKNOWN`` and one token
for each of its bytes. Of equal scores the split with fewer tokens counts.

Every task has tables of its own, bounded by ``NODES`` and ``KEPT``; nothing is shuffled.

Defined cases: null, empty and blank texts have no tokens. Words are split at white space and may be
of any length. Repeated rows get equal rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm.common import map_arrow, read

MARK = "▁"
UNKNOWN = -30.0
#: Nodes of a trie and pre-tokens with known counts, of one task; beyond them the tables start anew.
NODES, KEPT = 200_000, 300_000

_MODEL: dict[bytes, Counter] = {}


class Vocabulary:
    def __init__(self, pieces: list[str]):
        total = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
        self.score = {p: -math.log(i + 1) - total for i, p in reversed(list(enumerate(pieces)))}
        self.longest = max(map(len, pieces), default=1)


class Trie:
    """Nodes by number; the root is 0. Each has its children, best score and token count."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.children: list[dict[str, int]] = [{}]
        self.score = [0.0]
        self.count = [0]

    def insert(self, word: str) -> int:
        """Token count of a pre-token; only nodes that are new are computed."""
        path, node = [0], 0
        for i, c in enumerate(word):
            down = self.children[node].get(c)
            if down is None:
                down = self._grow(node, c, word, i, path)
            node = down
            path.append(node)
        return self.count[node]

    def _grow(self, node: int, c: str, word: str, i: int, path: list[int]) -> int:
        score, count = self.score[node] + UNKNOWN, self.count[node] + len(c.encode())
        known, scores, counts = self.v.score, self.score, self.count
        for k in range(max(0, i + 1 - self.v.longest), i + 1):
            s = known.get(word[k : i + 1])
            if s is not None:
                s += scores[path[k]]
                n = counts[path[k]] + 1
                if s > score or (s == score and n < count):
                    score, count = s, n
        self.children[node][c] = new = len(scores)
        self.children.append({})
        scores.append(score)
        counts.append(count)
        return new


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.trie, self.known = vocabulary, Trie(vocabulary), {}

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        out = []
        for text in texts:
            words = text.split()
            if len(self.known) > KEPT:
                self.known = {}
            known = self.known
            for w in set(words):
                if w not in known:
                    if len(self.trie.score) > NODES:
                        self.trie = Trie(self.v)
                    known[w] = self.trie.insert(MARK + w)
            out.append((len(words), sum(map(known.__getitem__, words))))
        return out


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    key = hashlib.sha256("\0".join(pieces).encode()).digest()  # of all pieces: a worker may serve several vocabularies

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _MODEL:
            _MODEL.clear()
            _MODEL[key] = Counter(Vocabulary(shared.value))
        rows = _MODEL[key].counts([x or "" for x in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_pretokens long, n_tokens long")


def pieces(path: str | None = None) -> list[str]:
    """The pieces of a sentencepiece file in their order, without control and byte pieces; read by the driver."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]


def op6_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), pieces())
