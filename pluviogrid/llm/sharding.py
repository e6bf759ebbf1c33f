"""Operator 8, sharding: sampled splitters, range partitioning, overfull ranges subdivided.

A size-weighted sample of (key, tie) pairs gives quantile boundaries of many fine ranges. One
aggregation counts each range exactly; a range that holds more than twice its share is
subdivided by further splitters, sampled within it. As splitters are pairs, a hot key (such as
thousands of equal texts) is cut along the ties, in order, and its neighbours stay ranges. The ranges in order and their exact
prefix sums then give every record a global rank and byte offset, and so its shard and slot. Only the
samples (of bounded expected size) and the counts of the ranges (at most three for each of
`n_shards * fine`) reach the driver.

Nulls in the size count as 0, in key or tie as a value of their own; repeated rows get
slots of their own (rows alike in key and tie cannot be told apart, so they share a range); an
empty table gives an empty result. Columns of the input that are called like a result column are
replaced; all others keep their names, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_binary, cut, free_name, table, text_bytes

SHARDS = 24
FINE = 64  # fine ranges for each shard
SAMPLES = 8  # expected samples for each fine range


def _longs(values) -> str:
    return "array(" + ",".join(f"{int(v)}L" if v > -(2**63) else "-9223372036854775807L" for v in values) + ")"


def _count_le(bounds: list[tuple[int, int]], key: str, tie: str) -> Column:
    """How many of the ascending pairs are <= (key, tie): a binary search inside the JVM."""
    if not bounds:
        return F.lit(0)
    steps, keys, ties = len(bounds).bit_length(), *(_longs(c) for c in zip(*bounds, strict=True))
    mid = "(s.lo + s.hi) div 2"
    return F.expr(
        f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(bounds)}), (s, i) -> if(s.lo < s.hi, "
        f"if(get({keys}, {mid}) < `{key}` or (get({keys}, {mid}) = `{key}` and get({ties}, {mid}) <= `{tie}`), named_struct('lo', cast({mid} + 1 as int), 'hi', s.hi), "
        f"named_struct('lo', s.lo, 'hi', cast({mid} as int))), s), s -> s.lo)"
    )


def shard(df: DataFrame, size: Column, key: Column, tie: Column, n_shards: int = SHARDS, law: str = "bytes", fine: int = FINE, samples: int = SAMPLES, seed: int = 8) -> DataFrame:
    """Adds size long, shard int and slot long. law: 'bytes' (sizes near equal) or 'rows' (counts at most one apart).

    key: any column to range-partition by (hashed values and numbers alike are cast to long).
    tie: decides the order and the splitters within a key.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"no such law: {law}")
    weight = F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    k, t, own, end, rank = (free_name(df, f"__{n}") for n in ("key", "tie", "range", "end", "rank"))
    keyed = df.withColumns({k: F.coalesce(key.cast("long"), F.lit(0).cast("long")), t: F.xxhash64(F.coalesce(tie.cast("string"), F.lit("\\N"))), "size": weight}).drop("shard", "slot")
    narrow = cut(keyed.select(k, t, "size"))
    amount = F.greatest(F.col("size"), F.lit(1)) if law == "bytes" else F.lit(1).cast("long")
    n, total = narrow.agg(F.count("*"), F.sum(amount)).first()
    if not n:
        return keyed.drop(k, t).withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")})
    ranges = n_shards * fine
    share = max(1, total // ranges)

    def drawn(d: DataFrame, rate: float | Column, salt: int) -> DataFrame:
        uniform = F.shiftrightunsigned(F.xxhash64(k, t, F.lit(salt)), 11) / F.lit(float(2**53))
        return d.where(uniform < amount * rate)

    def quantiles(found: list, parts: int) -> set[tuple[int, int]]:
        return {found[len(found) * i // parts] for i in range(1, parts)} if found else set()

    ranged = lambda d: d.withColumn(own, _count_le(bounds, k, t))
    bounds = sorted(quantiles(sorted(tuple(r) for r in drawn(narrow, ranges * samples / total, seed).select(k, t).collect()), ranges))
    held = {r[0]: r[1] for r in ranged(narrow).groupBy(own).agg(F.sum(amount)).collect()}
    full = {r: -(-v // share) for r, v in held.items() if v > 2 * share}
    if full:  # further splitters of the overfull ranges
        rate = F.element_at(F.create_map(*(F.lit(x) for r, parts in full.items() for x in (r, parts * samples / held[r]))), F.col(own))
        more: dict[int, list] = {}
        for r, *pair in drawn(ranged(narrow).where(F.col(own).isin(list(full))), rate, seed + 1).select(own, k, t).collect():
            more.setdefault(r, []).append(tuple(pair))
        bounds = sorted({*bounds, *(b for r, found in more.items() for b in quantiles(sorted(found), full[r]))})
    counts = {r[0]: (r[1], r[2]) for r in ranged(narrow).groupBy(own).agg(F.sum(amount), F.count("*")).collect()}
    off_b, off_n, b, c = [], [], 0, 0
    for u in range(len(bounds) + 1):
        off_b.append(b), off_n.append(c)
        got = counts.get(u, (0, 0))
        b, c = b + got[0], c + got[1]

    def placed(d: DataFrame) -> DataFrame:
        w = Window.partitionBy(own).orderBy(k, t, "size")
        d = ranged(d).withColumns({end: F.expr(f"get({_longs(off_b)}, `{own}`)") + F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, 0)), rank: F.expr(f"get({_longs(off_n)}, `{own}`)") + F.row_number().over(w) - 1})
        at = f"((2 * `{end}` - greatest(size, 1L)) * {n_shards}L) div {2 * total}L" if law == "bytes" else f"(`{rank}` * {n_shards}L) div {n}L"
        return d.withColumn("shard", F.least(F.expr(at), F.lit(n_shards - 1)).cast("int"))

    first = dict(placed(narrow).groupBy("shard").agg(F.min(rank)).collect())
    start = [first.get(s, 0) for s in range(n_shards)]
    return placed(keyed).withColumn("slot", F.col(rank) - F.expr(f"get({_longs(start)}, shard)")).drop(k, t, own, end, rank)


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, law: str = "bytes") -> DataFrame:
    """Documents with all their columns, ordered by the hash of their text, so that copies lie side by side until a range overflows."""
    return shard(docs, text_bytes("text") + 8, F.xxhash64("text"), F.col("doc_id"), n_shards, law)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", (text_bytes("text") + 8).alias("n"), F.crc32(as_binary("text")).alias("text_crc32"), F.xxhash64("text").alias("h"))
    out = shard(narrow, F.col("n"), F.col("h"), F.col("doc_id"), SHARDS, "bytes")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
