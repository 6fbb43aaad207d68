"""Token counts: unigram segmentation over a trie of the distinct pre-tokens.

A pre-token is a run of characters other than ASCII white space, with the word mark before it. Its segmentation
is the one of highest total score over the vocabulary's pieces. The score of a prefix does not depend on what follows,
so distinct pre-tokens go into a trie and each node's forward score is worked out once for all that share the prefix; the
number of tokens is read at the node where a pre-token ends. A text's count is the sum over its pre-tokens.

Scores follow from the vocabulary's order by Zipf's law: a piece of rank r has ln(1 / (r + 1)). A character that no piece
covers costs ``UNKNOWN`` more than the rarest piece, and counts as its UTF-8 bytes. Equal scores go to fewer tokens.

Each task keeps a trie of at most ``nodes`` nodes and begins a new one beyond that, which changes no count. A pre-token of more than ``LONG`` characters
shares little, and is scored by itself, with the scores of its last characters only. Nothing
is shuffled. Cases: null and blank texts have 0. Repeated rows count each for itself; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches
from tidemark.llm.packing import slices

MARK = "▁"
UNKNOWN = 10.0
#: Characters from which a pre-token goes into no trie.
LONG = 1000


def pieces_of(path: str) -> dict[str, float]:
    """Score of each piece of a SentencePiece vocabulary, by its rank among the ordinary pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: -math.log(r + 1) for r, p in reversed(list(enumerate(own)))}


class Trie:
    """Forward scores by prefix. Nodes are numbers; ``next`` has a child by parent and character."""

    def __init__(self, scores: dict[str, float], nodes: int = 600_000):
        self.scores, self.most, self.longest = scores, nodes, max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, int] = {}
        self.score, self.count = [0.0], [0]

    def tokens(self, word: str) -> int:
        """Tokens in ``word``; inserts what the trie lacks of it."""
        if len(word) > min(LONG, self.most // 2):
            return self._alone(word)
        if len(self.score) + len(word) > self.most:
            self.clear()
        after, score, count, scores, longest = self.next, self.score, self.count, self.scores, self.longest
        node, path = 0, [0]
        for k, c in enumerate(word, 1):
            key = node << 21 | ord(c)
            node = after.get(key, 0)
            if not node:
                before = path[-1]
                best, n = score[before] + self.unknown, count[before] + len(c.encode("utf-8", "replace"))
                for j in range(max(0, k - longest), k):
                    if (s := scores.get(word[j:k])) is not None:
                        s, m = s + score[path[j]], count[path[j]] + 1
                        if s > best or s == best and m < n:
                            best, n = s, m
                node = after[key] = len(score)
                score.append(best)
                count.append(n)
            path.append(node)
        return count[node]


    def _alone(self, word: str) -> int:
        """As ``tokens``, with a ring of the last scores in place of the trie."""
        ring = self.longest + 1
        score, count, scores = [0.0] * ring, [0] * ring, self.scores
        for k, c in enumerate(word, 1):
            before = (k - 1) % ring
            best, n = score[before] + self.unknown, count[before] + len(c.encode("utf-8", "replace"))
            for j in range(max(0, k - self.longest), k):
                if (s := scores.get(word[j:k])) is not None:
                    s, m = s + score[j % ring], count[j % ring] + 1
                    if s > best or s == best and m < n:
                        best, n = s, m
            score[k % ring], count[k % ring] = best, n
        return count[len(word) % ring]


def _counted(scores: Broadcast, nodes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(scores.value, nodes)
        for batch in batches:
            words, tokens = [], []
            for _, texts in slices(batch.column("text")):
                cut = pc.ascii_split_whitespace(texts.fill_null(""))
                coded = cut.values.dictionary_encode()
                distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
                n = np.array([trie.tokens(MARK + w) if w else 0 for w in distinct], np.int64)
                real = np.array([bool(w) for w in distinct], bool)
                codes, ends = coded.indices.to_numpy(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
                for out, each in ((words, real), (tokens, n)):
                    sums = np.concatenate([[0], np.cumsum(each[codes], dtype=np.int64)]) if len(each) else np.zeros(1, np.int64)
                    out.append(np.diff(sums[ends]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (words, tokens))],
                ["doc_id", "n_pretokens", "n_tokens"]
            )

    return count


def token_counts(docs: DataFrame, scores: dict[str, float], nodes: int = 600_000) -> DataFrame:
    """n_pretokens and n_tokens for each row of ``docs`` (doc_id of any type, text)."""
    own = bounded_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    schema = T.StructType([own.schema["doc_id"]]).add("n_pretokens", "long").add("n_tokens", "long")
    return own.mapInArrow(_counted(docs.sparkSession.sparkContext.broadcast(scores), nodes), schema)
