"""Chunks of documents that ask shards of an index: packed messages instead of a row for each token.

A chunk is a set of documents of bounded total size (but for one very long text), a shard a
part of a key space. A chunk sends each shard that it has keys of one row with all it has to ask, packed and free
of repetitions, so a key that a third of all documents share reaches its shard once from
each chunk. A shard answers each chunk with one row. Shards stand for far more text than
chunks, so there are few messages for each chunk, and never more than it has distinct keys:
messages grow with the corpus, not with its square. Chunks sort what they send by content, so
answers fit whatever order rows arrive in, also after a task is run again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import as_binary, partitions

CHUNK_BYTES = 4_000_000
SHARD_BYTES = 64_000_000  # of text whose keys a shard holds, unless the operator says otherwise
MESSAGE = "shard int, chunk int, kind int, data binary"
_NAMES = ["shard", "chunk", "kind", "data"]


def total_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def shards_for(spark: SparkSession, total: int, shard_bytes: int = SHARD_BYTES) -> int:
    """Shards for so much text, and at least as many as the session has shuffle partitions."""
    return max(partitions(spark), -(-total // shard_bytes))


def chunked(docs: DataFrame, columns: list[str | Column], chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """chunk, the columns and the text as bytes, dealt out by chunk; and the number of shards."""
    ship(docs.sparkSession)
    total = total_bytes(docs)
    n = max(partitions(docs.sparkSession), -(-total // chunk_bytes))
    own = [F.col(c) if isinstance(c, str) else c for c in columns]
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk"), *own, as_binary("text").alias("text"))
    return rows.repartition(n, "chunk"), shards_for(docs.sparkSession, total, shard_bytes)


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table([*(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=_NAMES)


def inbox(table: pa.Table) -> list[tuple[int, int, int, bytes]]:
    """The rows of a table of messages, in a fixed order."""
    return sorted(zip(*(table.column(c).to_pylist() for c in _NAMES), strict=True), key=lambda x: x[:3])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes: their number, then kind, length and content of each."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64).tobytes()
    return b"".join((head, *(np.ascontiguousarray(a).tobytes() for a in arrays)))


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for kind, length in zip(head[::2], head[1::2], strict=True):
        kind = np.dtype(chr(kind))
        out.append(np.frombuffer(data, kind, int(length), at))
        at += kind.itemsize * int(length)
    return out


def split(shard_of: np.ndarray, shards: int) -> list[np.ndarray]:
    """Positions of each shard's entries, in their order."""
    order = np.argsort(shard_of, kind="stable")
    bounds = np.searchsorted(shard_of[order], np.arange(shards + 1))
    return [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): a stable order by (a, b), and where in that order a new pair begins."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order, np.flatnonzero(new)
