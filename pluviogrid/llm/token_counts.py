"""Operator 10, token counts: linear longest-match automaton over a public vocabulary.

Words are runs of bytes other than ASCII white space. Each word is cut greedily into the
longest pieces of the vocabulary, its first piece among those that begin with a space, the
others among those that do not. A trie over both kinds has, at each node, a failure link and
the number of pieces popped on the way there, so one pass over a word counts its pieces
without building any. A word that no pieces cover counts as one unknown piece.

Null and empty texts have 0 words and 0 tokens; whole texts count, however long; repeated
rows count alike; an empty table gives an empty result; columns of the input that are called
like a result column are replaced.
"""

from __future__ import annotations

import base64
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..shipping import ship
from .common import as_binary, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_PIECES = 2_000_000  # of a vocabulary that may be broadcast
KEPT_WORDS = 300_000  # remembered counts in a worker
ADDED = ("n_words", "n_tokens", "n_unknown")


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a ranks file: a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Node 0 begins a word, node 1 continues it; fail is -1 where no match goes on."""

    def __init__(self, pieces: list[bytes]):
        goto: dict[int, int] = {}
        whole = [False, False]
        for piece in pieces:
            node = 0 if piece[:1] == b" " else 1
            for b in piece:
                node = goto.setdefault(node << 8 | b, len(whole))
                if node == len(whole):
                    whole.append(False)
            whole[node] = bool(piece)
        whole[0] = whole[1] = False
        kids: list[list[int]] = [[] for _ in whole]
        for key in goto:
            kids[key >> 8].append(key & 255)
        fail, popped = [-1] * len(whole), [0] * len(whole)
        queue = deque((0, 1))
        while queue:
            u = queue.popleft()
            for b in kids[u]:
                v = goto[u << 8 | b]
                if whole[v]:
                    fail[v], popped[v] = 1, 1
                else:
                    z, n = fail[u], popped[u]
                    while z >= 0 and (z << 8 | b) not in goto:
                        n += popped[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], popped[v] = goto[z << 8 | b], n
                queue.append(v)
        self.goto, self.fail, self.popped = goto, fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of a word, or -1 where it is unknown."""
        goto, fail, popped, node, n = self.goto, self.fail, self.popped, 0, 0
        for b in b" " + word:
            to = goto.get(node << 8 | b)
            while to is None:
                if fail[node] < 0:
                    return -1
                n += popped[node]
                node = fail[node]
                to = goto.get(node << 8 | b)
            node = to
        while node != 1:
            if fail[node] < 0:
                return -1
            n += popped[node]
            node = fail[node]
        return n


_built: dict[int, Automaton] = {}


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.automaton.count(word)
        return n


def token_counts(docs: DataFrame, text_col: str = "text", vocabulary: str | list[bytes] = VOCABULARY) -> DataFrame:
    """The columns of docs but the text, with n_words, n_tokens and n_unknown (all long)."""
    pieces = read_vocabulary(vocabulary) if isinstance(vocabulary, str) else list(vocabulary)
    if len(pieces) > MOST_PIECES:
        raise ValueError(f"{len(pieces)} pieces are too many to broadcast")
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    key = hash(tuple(pieces))
    kept = [c for c in docs.columns if c != text_col and c not in ADDED]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in ADDED])

    def run(batches):
        if key not in _built:
            _built.clear()
            _built[key] = Automaton(sent.value)
        counts = _Counts(_built[key])
        for batch in batches:
            words, tokens, unknown = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            texts = batch.column(batch.num_columns - 1)
            for i in range(batch.num_rows):
                w = texts[i].as_py().split()
                n = list(map(counts.__getitem__, w))
                words[i], tokens[i], unknown[i] = len(n), sum(n), n.count(-1)
                if len(counts) > KEPT_WORDS:
                    counts.clear()
            tokens += 2 * unknown
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, (words, tokens, unknown))], names=[*kept, *ADDED])

    return docs.select(*kept, as_binary(text_col).alias("__text")).mapInArrow(run, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
