"""Operator 4, toxicity: maximum-scoring segments of token log-odds, calibrated as extreme values.

Log-odds of tokens (words and their prefixes) between toxic and other labelled documents are
smoothed by an informative Dirichlet prior; tokens with a significant positive z-score carry
their log-odds, all others a small negative drift. One linear scan finds all maximal
segments of a text (Ruzzo and Tompa). In shuffled text the best of n tokens follows an extreme-value
law: a segment of score S or more is expected K * n * exp(-lam * S) times by chance, where lam is the
positive root of E[exp(lam * s)] = 1 over the scores in use (of words, of prefixes of other words,
and the drift, each as often as in the training texts), and K is fitted to the best segments
of simulated shuffled texts. A logistic curve over those figures, fitted on labelled rows,
gives the score.

What is learnt comes from at most about LEARN_ROWS labelled rows (the curve from FIT_ROWS), drawn by a
hash of their ids, so the model's size is bounded; every text is scored whole. Null and empty texts
have no segment and get the score of none; equal texts count once in the statistics, however many rows or ids
have them, and score alike; without labels of both kinds all get the share of toxic ones (0
without labels); an empty table gives an empty result; columns of the input that are called
like a result column are replaced.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import cut, hinted, table

PREFIX = 5  # letters
PRIOR = 300.0  # documents
LEAST_Z = 2.0  # chosen by folds of training rows, see README
FALSE_SHARE = 0.5  # of significant tokens that may be so by chance; the z-score asked for rises with the number of tokens tested
LEAST_DOCS = 3
LEAST_ODDS = 0.7
DRIFT = 0.25
FIT_ROWS = 20_000  # labelled rows that the curve is fitted on, at most about so many
LEARN_ROWS = 1_000_000  # labelled rows that log-odds are learnt from, at most about so many
EDGES = string.punctuation


def words(text: str | None) -> list[str]:
    """Lower-case words without punctuation at their ends."""
    return [w.strip(EDGES) for w in text.lower().split()] if text else []


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)  # of words, and of prefixes followed by '*'
    lam: float = 1.0
    k: float = 1.0
    drift: float = DRIFT
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    base: float = 0.0

    def segments(self, tokens: list[str]) -> list[tuple[int, int, float]]:
        """All maximal segments (start, end, score) of the tokens, in linear time."""
        get, out, cum, last = self.odds.get, [], 0.0, 0
        for i, w in enumerate(tokens):
            s = get(w) or get(w[:PREFIX] + "*")
            if s is None:
                continue
            left = cum - self.drift * (i - last)
            cum, last = left + s, i + 1
            new = (left, cum, i, i + 1)
            # candidates: (sum left of it, sum with it, start, end)
            while True:
                j = len(out) - 1
                while j >= 0 and out[j][0] >= new[0]:
                    j -= 1
                if j < 0 or out[j][1] >= new[1]:
                    out.append(new)
                    break
                new = (out[j][0], new[1], out[j][2], new[3])
                del out[j:]
        return [(a, b, r - x) for x, r, a, b in out]

    def figures(self, tokens: list[str]) -> tuple[list[tuple[int, int, float, float]], tuple[float, float, float]]:
        """Significant segments with the log10 of their expected number, and what the curve takes."""
        found = self.segments(tokens)
        log_n = math.log(max(1, len(tokens)) * self.k)
        kept = [(a, b, s, (log_n - self.lam * s) / math.log(10)) for a, b, s in found]
        kept = [x for x in kept if x[3] <= 0]
        best = max([-x[3] for x in kept], default=0.0)
        return kept, (min(best, 12.0), math.log1p(sum(-x[3] for x in kept)), math.log1p(len(kept)))

    def score(self, f: tuple[float, float, float]) -> float:
        if not self.odds:
            return self.base
        z = self.curve[0] + sum(c * x for c, x in zip(self.curve[1:], f, strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def held_out(doc_id: Column, modulus: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, use: Column) -> DataFrame:
    """text, y and weight of texts with a label y (the larger where copies differ), of the labels that use admits.

    Each distinct text has a weight of 1 in all: its rows under the smallest of its ids share it.
    """
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & use).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    rows = own.count()
    if rows > LEARN_ROWS:
        own = own.where(F.pmod(F.xxhash64("doc_id", F.lit(44)), F.lit(1_000_000)) < int(LEARN_ROWS / rows * 1_000_000))
    text = F.coalesce(F.col("text"), F.lit(""))
    h, g = F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("g")
    d = docs.select("doc_id", h, g).join(hinted(own, rows), "doc_id").groupBy("h", "g", "doc_id").agg(F.max("y").alias("y"), F.count("*").alias("n"))
    first = d.groupBy("h", "g").agg(F.min_by("n", "doc_id").alias("n"), F.min("doc_id").alias("doc_id"), F.max("y").alias("y"))
    keyed = docs.select("doc_id", text.alias("text"), h, g).join(hinted(first, rows), ["doc_id", "h", "g"])
    return keyed.select("doc_id", "text", "y", (1 / F.col("n")).alias("weight"))


def token_statistics(rows: DataFrame) -> DataFrame:
    """token, weight of the documents with it that are toxic and not, and occurrences; token '' has the totals."""

    def run(batches):
        kept: dict[str, list[float]] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), *(pa.array([v[k] for v in kept.values()], pa.float64()) for k in range(3))], names=["token", "toxic", "other", "occurs"])

        for batch in batches:
            for text, y, weight in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                w = [x for x in words(text) if x]
                for t in {*w, *(x[:PREFIX] + "*" for x in w), ""}:
                    kept.setdefault(t, [0, 0, 0])[0 if y else 1] += weight
                kept[""][2] += len(w) * weight
                for x in w:
                    kept[x][2] += weight
                    kept[x[:PREFIX] + "*"][2] += weight
            if len(kept) > 400_000:
                yield out()
                kept = {}
        if kept:
            yield out()

    ship(rows.sparkSession)
    counts = rows.select("text", "y", "weight").mapInArrow(run, "token string, toxic double, other double, occurs double")
    return counts.groupBy("token").agg(*(F.round(F.sum(c), 6).alias(c) for c in ("toxic", "other", "occurs")))


def score_distribution(found: dict[str, tuple[float, float]], tokens: float) -> tuple[np.ndarray, np.ndarray]:
    """Positive scores in use and the share of all tokens that has each: words by their own, other words by their prefix's."""
    words_of = Counter()
    for t, (_, occurs) in found.items():
        if not t.endswith("*"):
            words_of[t[:PREFIX] + "*"] += occurs
    pairs = [(odds, max(0.0, occurs - words_of[t]) if t.endswith("*") else occurs) for t, (odds, occurs) in found.items()]
    s, n = (np.array(c, float) for c in zip(*pairs, strict=True))
    return s[n > 0], n[n > 0] / max(1.0, tokens)


def extreme_law(s: np.ndarray, p: np.ndarray, texts: int = 2000, hits: int = 200, seed: int = 4) -> tuple[float, float, float]:
    """lam, K and drift: in shuffled text with scores s of shares p and a drift elsewhere, K * n * exp(-lam * S) segments of S or more are expected.

    The drift is DRIFT, or more where that leaves the mean score above minus half of it.
    """
    share = float(p.sum())
    rest = max(1e-9, 1 - share)
    drift = max(DRIFT, 2 * float((p * s).sum()) / rest)
    lo, hi = 1e-6, 60.0
    for _ in range(80):
        mid = (lo + hi) / 2
        over = float((p * np.exp(np.minimum(600, mid * s))).sum() + rest * math.exp(-mid * drift)) > 1
        lo, hi = (lo, mid) if over else (mid, hi)
    rng = np.random.default_rng(seed)
    now = best = np.zeros(texts)
    length = np.zeros(texts)
    for _ in range(hits):  # scores are drawn a hit at a time; the drift between hits is that of a geometric gap
        gap = rng.geometric(min(1.0, share), texts)
        now = np.maximum(now - drift * (gap - 1), 0) + rng.choice(s, texts, p=p / share)
        best, length = np.maximum(best, now), length + gap
    return lo, float(texts / (length * np.exp(-lo * best)).sum()), drift  # the maximum likelihood of K for Gumbel maxima with that lam


def fit(docs: DataFrame, labels: DataFrame, use: Column, least_z: float = LEAST_Z) -> Model:
    """A model of the labelled rows that `use` (a condition on labels) admits."""
    rows = labelled(docs, labels, use)
    stats = cut(token_statistics(rows).where(f"token = '' or toxic >= {LEAST_DOCS}"))
    total = stats.where("token = ''").first()
    if total is None or not total.toxic or not total.other:
        n = (total.toxic + total.other) if total else 0
        return Model(base=total.toxic / n if n else 0.0)
    nt, no = float(total.toxic), float(total.other)
    prior = F.lit(PRIOR) * (F.col("toxic") + F.col("other")) / F.lit(nt + no)
    a, b = F.col("toxic") + prior, F.col("other") + prior
    odds = F.log(a / (F.lit(nt + PRIOR) - a)) - F.log(b / (F.lit(no + PRIOR) - b))
    z = odds / F.sqrt(1 / a + 1 / b)
    tested = stats.where("token != ''").where((a < nt + PRIOR) & (b < no + PRIOR)).select("token", "occurs", odds.alias("odds"), z.alias("z"))
    steps = [least_z + 0.25 * i for i in range(150)]
    n, *held = tested.agg(F.count("*"), *(F.count_if((F.col("z") >= x) & (F.col("odds") > LEAST_ODDS)) for x in steps)).first()
    least = next((x for x, k in zip(steps, held, strict=True) if n * math.erfc(x / math.sqrt(2)) / 2 <= FALSE_SHARE * k), None)
    good = tested.where((F.col("z") >= (least or 1e9)) & (F.col("odds") > LEAST_ODDS))
    found = {r.token: (r.odds, r.occurs) for r in good.collect()}  # of at most LEARN_ROWS rows
    model = Model(odds={k: v[0] for k, v in found.items()}, base=nt / (nt + no))
    if not found:
        return model
    model.lam, model.k, model.drift = extreme_law(*score_distribution(found, total.occurs))
    share = min(1.0, FIT_ROWS / (nt + no))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) < int(share * 1_000_000))
    got = np.array([(r.f1, r.f2, r.f3, r.y, r.weight) for r in figures(sample, model).select("f1", "f2", "f3", "y", "weight").collect()], float).reshape(-1, 5)
    model.curve = _logistic(got[:, :3], got[:, 3], got[:, 4])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> tuple[float, ...]:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    pen = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + pen @ w
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + pen
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


SEGMENT = "array<struct<first:int,last:int,score:double,log10_expected:double>>"


def figures(docs: DataFrame, model: Model, segments: bool = False, keep_text: bool = False) -> DataFrame:
    """The columns of docs (the text on request), with score, what it is made of (f1, f2, f3), n_segments and, on request, the segments."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["score", "f1", "f2", "f3", "n_segments", *["segments"] * segments]
    kept = [c for c in docs.columns if c != "text" and c not in names] + ["text"] * keep_text
    kinds = [pa.float64()] * 4 + [pa.int32()] + [pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("log10_expected", pa.float64())]))]
    more = [T.StructField(n, T.DoubleType()) for n in names[:4]] + [T.StructField("n_segments", T.IntegerType())] + [T.StructField("segments", T._parse_datatype_string(SEGMENT))] * segments
    schema = T.StructType([docs.schema[c] for c in kept] + more)

    def run(batches):
        m = sent.value
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found, f = m.figures(words(text))
                row = (m.score(f), *f, len(found), [{"first": a, "last": b - 1, "score": s, "log10_expected": e} for a, b, s, e in found] if segments else None)
                for c, v in zip(cols, row, strict=False):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names=[*kept, *names])

    return docs.select(*kept, *[] if keep_text else ["text"]).mapInArrow(run, schema)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows whose score reaches the threshold; the model learns from the labels of documents that are not held out."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    narrow = docs.withColumn("__row", F.struct(*docs.columns)).select("__row", "text")
    return figures(narrow, model).where(F.col("score") < threshold).select("__row.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    out = figures(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_segments")
