"""Operator 6, mixing sources to target weights: Poisson replication.

Each source has a target share of the output's bytes, and so a mean repetition rate
rate = target bytes / bytes it has. A document's count is the inverse of the Poisson
distribution of that mean at a uniform number hashed from its id and the seed; it is exploded
by that count, and all copies are dealt out and ordered by a hash, which is a global shuffle.
Rates over PART are drawn as a sum of independent Poisson numbers of at most PART each, so
that no probability underflows. All of it is DataFrame expressions.

A null source is a source of its own; a null id hashes as '\\N'; rows repeated in full draw
the same count; an empty table gives an empty result; columns of the input that are called
like a result column are replaced. Copies differ in `copy` (0 .. n_copies - 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, hinted, table, text_bytes

SEED = 6
PART = 64.0
ADDED = ("copy", "n_copies", "mix_key")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5, which other SQL engines compute alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict | None = None, power: float = 0.5) -> DataFrame:
    """A row for each source: mean repetition rate, number of parts, and the distribution function of a part.

    weights: source -> target share of the output's bytes (others: 0); None: bytes ** power, normalised.
    """
    own = docs.groupBy("source").agg(F.sum(text_bytes("text") + 8).alias("bytes"))
    if weights is None:
        own = own.withColumn("w", F.pow(F.col("bytes").cast("double"), F.lit(power)))
    else:
        listed = F.lit(0.0)
        for k, v in weights.items():
            listed = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(listed)
        own = own.withColumn("w", listed)
    own = cut(own)  # a row for each source
    all_bytes, all_w = own.agg(F.sum("bytes"), F.sum("w")).first()
    share = F.col("w") / F.lit(all_w) if all_w else F.lit(0.0)
    r = own.select("source", (share * F.lit(float(all_bytes or 0)) / F.col("bytes")).alias("rate"))
    r = r.withColumn("rate", F.coalesce("rate", F.lit(0.0))).withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    cdf = "aggregate(sequence(1, cast(mean + 12 * sqrt(mean) + 30 as int)), named_struct('p', exp(-mean), 'c', array(exp(-mean))), (s, k) -> named_struct('p', s.p * mean / k, 'c', array_append(s.c, element_at(s.c, -1) + s.p * mean / k)), s -> s.c)"
    return r.withColumn("cdf", F.expr(cdf)).select("source", "rate", "parts", "cdf")


def mix(docs: DataFrame, weights: dict | None = None, power: float = 0.5, seed: int = SEED) -> DataFrame:
    """Documents replicated towards the target weights, in shuffled order, with copy, n_copies and mix_key."""
    r = rates(docs, weights, power)
    kept = [c for c in docs.columns if c not in ADDED]
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("\\N"))
    rid, cid, pid, sid = (free_name(docs, f"__{x}") for x in ("id", "cdf", "parts", "source"))
    r = r.select(F.col("source").alias(sid), F.col("cdf").alias(cid), F.col("parts").alias(pid))
    d = docs.select(*kept).withColumn(rid, own).join(hinted(r, r.count()), F.col("source").eqNullSafe(F.col(sid)))  # a row for each source: documents stay where they are
    u = f"cast(conv(substring(md5(concat_ws('|', '{seed}', `{rid}`, cast(i as string))), 1, 13), 16, 10) as bigint) / {float(2**52)!r}D"
    count = F.expr(f"aggregate(sequence(1, `{pid}`), 0, (k, i) -> k + size(filter(`{cid}`, c -> c <= {u})))")
    d = d.withColumn("n_copies", count.cast("int")).drop(sid, cid, pid).where("n_copies > 0")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    d = d.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), rid, F.col("copy").cast("string")))).drop(rid)
    return d.repartition("mix_key").sortWithinPartitions("mix_key")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "copy", "n_copies", "mix_key")


ORACLE_SQL = f"""
WITH s AS (SELECT source, sum(strlen(coalesce(text, '')) + 8)::DOUBLE AS bytes FROM documents GROUP BY source),
t AS (SELECT sum(bytes) AS all_bytes, sum(sqrt(bytes)) AS all_w FROM s),
r AS (SELECT source, sqrt(bytes) / all_w * all_bytes / bytes AS rate FROM s, t),
p AS (SELECT source, rate, greatest(ceil(rate / {PART}), 1)::INT AS parts, rate / greatest(ceil(rate / {PART}), 1) AS mean FROM r),
pmf AS (SELECT source, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS pk FROM p, generate_series(0, 700) g(k) WHERE k <= mean + 12 * sqrt(mean) + 30),
c AS (SELECT source, k, sum(pk) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf FROM pmf),
a AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
d AS (SELECT doc_id, documents.source, text, cdf, parts, coalesce(doc_id::VARCHAR, '\\N') AS rid FROM documents JOIN a ON documents.source IS NOT DISTINCT FROM a.source JOIN p ON documents.source IS NOT DISTINCT FROM p.source),
n AS (SELECT doc_id, source, text, rid, list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('{SEED}|' || rid || '|' || i::VARCHAR), 1, 13))::BIGINT / {float(2**52)!r}))))::INT AS n_copies FROM d)
SELECT doc_id, source, text, u::INT AS copy, n_copies, md5('{SEED}-order|' || rid || '|' || u::VARCHAR) AS mix_key FROM n, unnest(range(0, n_copies)) AS x(u)
"""
