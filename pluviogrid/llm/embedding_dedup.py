"""Operator 9, embedding near-dedup: Euclidean p-stable hashing, then exact cosines.

Normalised vectors are projected on Gaussian directions and quantised with width WIDTH; `k`
quantised projections are one code, and each of the tables buckets by a code of its own. k grows
with the logarithm of the number of vectors, so that a bucket holds few others by chance, and
the number of tables follows from k so that a pair at the threshold is missed with probability
MISS. Equal vectors are one class, known by a 128-bit hash, with a multiplicity. Buckets are told
apart by ids alone; of those with the same members only the first table's is compared, so
the vectors of a group that falls together in many tables are shipped once. Buckets are compared
in blocks of at most about BLOCK vectors, in double precision; a pair that shares several
buckets counts in the first. Tasks return counts and a spanning forest of the links, never all pairs.

Vectors that are null, zero, or hold null or non-finite components, and rows without an id,
link with nothing; vectors of different lengths are never linked; rows repeated in full are
copies that link with each other, rows that share an id only are vectors of their own; ids may be
of any type with an order; an empty table gives an empty result; only the columns vec_id and
embedding are read, so other columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import cut, hinted, table
from .components import connected_components

THRESHOLD = 0.95
WIDTH = 2.0
MISS = 1e-3
CHANCE = 0.05  # expected others in a bucket by chance
BLOCK = 1024


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection agrees at that distance."""
    c = width / distance
    return math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def tables_for(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Projections in a code, and tables, for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(2, n) / CHANCE) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log(1 - near**k))


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(x: np.ndarray, k: int, tables: int, seed: int = 9) -> np.ndarray:
    """uint32 code of each row of x in each table."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a, b = rng.standard_normal((x.shape[1], tables * k)), rng.uniform(0, WIDTH, tables * k)
    mul = rng.integers(0, 2**63, tables * k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(x), tables), np.uint32)
    for lo in range(0, len(x), 2048):
        q = np.floor((x[lo : lo + 2048] @ a + b) / WIDTH).astype(np.int64).astype(np.uint64)
        h = (q * mul).reshape(len(q), tables, k).sum(axis=2, dtype=np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[lo : lo + 2048] = (h >> np.uint64(32)).astype(np.uint32)
    return out


def classes(vectors: DataFrame) -> DataFrame:
    """id, smallest vec_id, copies and the vector of each distinct valid embedding."""
    good = F.expr("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x != 0)")
    return vectors.where(F.coalesce(good, F.lit(False))).groupBy(class_id()).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))


def class_id():
    """16 bytes that stand for a vector."""
    return F.unhex(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64("embedding"), F.xxhash64("embedding", F.lit(9)))))).alias("id")


def _components_in_block(mask: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix."""
    seen, out = np.zeros(len(mask), bool), []
    for s in np.flatnonzero(mask.any(axis=1)):
        if seen[s]:
            continue
        seen[s] = True
        stack = [s]
        while stack:
            u = stack.pop()
            new = np.flatnonzero(mask[u] & ~seen)
            seen[new] = True
            out += [(u, v) for v in new]
            stack.extend(new)
    return out


def link(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding)."""
    ship(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding")
    own = cut(classes(rows))
    n = own.count()
    k, tables = tables_for(n, threshold)

    def hashed(batches):
        for batch in batches:
            lists = batch.column(1).to_pylist()
            vec, code = [b""] * len(lists), [b""] * len(lists)
            length = np.array([len(v) for v in lists])
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                x = unit(np.array([lists[i] for i in at], np.float64))
                c = codes(x, k, tables)
                for i, v, w in zip(at, x, c, strict=True):
                    vec[i], code[i] = v.tobytes(), w.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vec, pa.binary()), pa.array(code, pa.binary())], names=["id", "vec", "code"])

    hashed_rows = cut(own.select("id", "embedding").mapInArrow(hashed, "id binary, vec binary, code binary"))

    def bucketed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.stack([np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()])
            keys = c.astype(np.int64) | np.arange(tables, dtype=np.int64)[None, :] << 32
            places = pa.array(np.repeat(np.arange(batch.num_rows), tables))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(places), pa.array(keys.ravel()), batch.column(2).take(places)], names=["id", "bucket", "n"])

    buckets = hashed_rows.select("id", "code", F.octet_length("vec").alias("n")).mapInArrow(bucketed, "id binary, bucket long, n int")
    alike = buckets.groupBy("bucket", "n").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(3))).alias("y")).where("m > 1")
    shared = alike.groupBy("n", "m", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "m")  # the table is in the bucket's high bits
    tasks = buckets.join(shared, ["bucket", "n"]).withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.expr("cast(pmod(xxhash64(id), parts) as int)"))
    tasks = tasks.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select("id", "bucket", "n", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    copies = own.select("id", "copies")
    earlier = F.expr("substring(code, 1, cast(4 * shiftright(bucket, 32) as int))").alias("code")  # of the tables before
    ready = tasks.join(hashed_rows.join(hinted(copies, n), "id"), "id").select("bucket", "n", "i", "j", "id", "vec", earlier, "own", "copies").repartition("bucket", "n", "i", "j").sortWithinPartitions("bucket", "n", "i", "j", "own", "id")

    def compared(batches):
        limit = threshold

        def block(ids, own_, x, c, w, i, j):
            near = x @ x.T >= limit
            np.fill_diagonal(near, False)
            if i != j:
                near &= own_[:, None] != own_[None, :]
            if c.shape[1]:
                a, b = np.nonzero(near)
                for lo in range(0, len(a), 100_000):
                    before = (c[a[lo : lo + 100_000]] == c[b[lo : lo + 100_000]]).any(axis=1)
                    near[a[lo : lo + 100_000][before], b[lo : lo + 100_000][before]] = False
            if not near.any():
                return []
            sums = near @ w
            return [(ids[u], None, int(s)) for u, s in enumerate(sums) if s] + [(ids[u], ids[v], 0) for u, v in _components_in_block(near)]

        held: list = []
        last = None

        def close():
            if len(held) < 2:
                return []
            c = [np.frombuffer(r[2], np.uint32) for r in held]
            return block([r[0] for r in held], np.array([r[3] for r in held]), np.stack([np.frombuffer(r[1]) for r in held]), np.stack(c), np.array([r[4] for r in held], np.int64), *last[2:])

        def out(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["u", "v", "links"])

        for batch in batches:
            got = []
            for bucket, length, i, j, *r in zip(*(batch.column(c).to_pylist() for c in range(9)), strict=True):
                if (bucket, length, i, j) != last:
                    got += close()
                    held, last = [], (bucket, length, i, j)
                held.append(r)
            yield out(got)
        if last is not None:
            yield out(close())

    found = cut(ready.mapInArrow(compared, "u binary, v binary, links long"))
    comps = connected_components(found.where("v is not null").select("u", "v"))
    sums = found.where("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("others"))
    named = own.select("id", "rep", "copies").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    result = named.join(least, "component").join(sums, "id", "left").select("id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = rows.select("vec_id", class_id()).join(result, "id", "left").withColumn("in", F.col("vec_id").isNotNull() & F.col("n_links").isNotNull())
    return joined.select("vec_id", F.when(F.col("in"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(F.col("in"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
