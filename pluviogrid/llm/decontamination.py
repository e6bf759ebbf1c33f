"""Operator 1, benchmark decontamination: BM25 with block-max WAND, then question and answer overlap.

The benchmark's items are an inverted index with the largest contribution of each block of
postings. Every training passage (windows of twice the longest item's words, half of them
shared with the next, so that each copy of an item lies whole in one) is a query: all items
whose BM25 score reaches TAU of the item's score for itself are retrieved. A first,
vectorised bound adds up only the rarer terms of a passage and counts all frequent terms of
an item as present; passages below it have no item above the threshold, the others go
through block-max WAND. A retrieved item is a leak where its question shares at least
OVERLAP of its five-word shingles with the passage, and its answer OVERLAP of its words. An
item's answer is the fewest last sentences with five words at least, its question what is
before them; where that has no five words, both are the whole text.

The index is broadcast. Where the items have more than INDEX_BYTES of text, they are dealt into
groups of about that size, each with an index of its own over statistics of all items, and the
documents are scanned once for each group; no item is left out at any size. Null and empty texts and
items without words match nothing; items with equal texts match together; ids may be of any type;
repeated rows give repeated results; an empty table gives an empty result; of docs only `doc_id`
and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re
import string
from bisect import bisect_left
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..shipping import ship
from .common import cut, table

TAU = 0.6
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 32
K1, B = 1.2, 0.75
INDEX_BYTES = 8_000_000  # of items' texts in one broadcast index, or one item
EDGES = string.punctuation


def words(text: str | None) -> list[str]:
    return [w for x in text.lower().split() if (w := x.strip(EDGES))] if text else []


def grams(w: list[str], k: int) -> set[tuple[str, ...]]:
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k > 0 else set()


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of question and answer."""
    sentences = [s for s in (words(x) for x in re.split(r"(?<=[.?!])\s+", text)) if s]
    answer: list[str] = []
    while sentences and len(answer) < SHINGLE:
        answer = sentences.pop() + answer
    question = [w for s in sentences for w in s]
    if len(question) >= SHINGLE:
        return question, answer
    return words(text), words(text)


class _Cursor:
    """A place in a list of postings, which moves by whole blocks."""

    __slots__ = ("at", "block", "doc", "post", "top")

    def __init__(self, post, top: float):
        self.post, self.top, self.at, self.block, self.doc = post, top, 0, 0, post[0][0]

    def item(self) -> int:
        return self.doc

    def block_of(self, item: int) -> int:
        """The first block that may hold that item or a later one (the last one if none does)."""
        return min(bisect_left(self.post[3], item, self.block), len(self.post[3]) - 1)

    def advance(self, to: int) -> bool:
        """Moves to the first item >= to; False at the end."""
        items, lasts = self.post[0], self.post[3]
        self.block = bisect_left(lasts, to, self.block)
        if self.block == len(lasts):
            return False
        low = self.block * BLOCK
        self.at = bisect_left(items, to, max(self.at, low), min(len(items), low + BLOCK))
        self.doc = items[self.at]
        return True


class Index:
    """Items with words, their parts, and postings whose contributions are shares of the item's own score.

    totals: number, mean and longest length of all items and how many of them have each term, where `items` is but a group of them.
    """

    def __init__(self, items: list[tuple[int, str]], tau: float = TAU, totals: tuple[int, float, int, dict[str, int]] | None = None):
        self.tau = tau
        self.ids, self.parts, docs = [], [], []
        for i, text in items:
            if w := words(text):
                self.ids.append(i)
                self.parts.append(split_item(text))
                docs.append(Counter(w))
        if totals is None:
            totals = len(docs), sum(sum(d.values()) for d in docs) / max(1, len(docs)), max((sum(d.values()) for d in docs), default=1), Counter(t for d in docs for t in d)
        n_items, mean, self.longest, df = totals
        idf = {t: math.log(1 + (n_items - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        self.terms = {t: k for k, t in enumerate(sorted(df, key=lambda t: (df[t], t)))}  # the rarest first
        self.postings: list[tuple[list[int], list[float], list[float], list[int]]] = [([], [], [], []) for _ in self.terms]  # items, shares; largest share and last item of each block
        for i, d in enumerate(docs):
            length = sum(d.values())
            own = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean)) for t, n in d.items()}
            whole = sum(own.values())
            for t, v in own.items():
                at = self.postings[self.terms[t]]
                at[0].append(i), at[1].append(v / whole)
        for at in self.postings:
            at[2].extend(max(at[1][j : j + BLOCK]) for j in range(0, len(at[0]), BLOCK))
            at[3].extend(at[0][min(j + BLOCK, len(at[0])) - 1] for j in range(0, len(at[0]), BLOCK))
        self.top = [max(at[2], default=0.0) for at in self.postings]
        # terms from `frequent` on may all be absent from the first bound: together they are below tau for every item
        self.common = np.zeros(len(self.ids))
        self.frequent = len(self.terms)
        for k in range(len(self.terms) - 1, -1, -1):
            more = self.common.copy()
            more[self.postings[k][0]] += self.postings[k][1]
            if more.max(initial=0) >= 0.7 * tau:
                break
            self.common, self.frequent = more, k
        self.start = np.cumsum([0] + [len(at[0]) for at in self.postings[: self.frequent]])
        self.post_item = np.array([i for at in self.postings[: self.frequent] for i in at[0]], np.int64)
        self.post_share = np.array([v for at in self.postings[: self.frequent] for v in at[1]])

    def search(self, query: set[int]) -> list[tuple[int, float]]:
        """All items with a score of tau at least, by block-max WAND: blocks that cannot hold one are stepped over by their last items alone."""
        lists = [_Cursor(self.postings[t], self.top[t]) for t in query if self.postings[t][0]]
        lists.sort(key=_Cursor.item)
        found, tau = [], self.tau - 1e-9
        while lists:
            upper, pivot = 0.0, -1
            for k, x in enumerate(lists):
                upper += x.top
                if upper >= tau:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot].doc
            while pivot + 1 < len(lists) and lists[pivot + 1].doc == item:
                pivot += 1
            ahead = lists[: pivot + 1]
            blocks = [x.block_of(item) for x in ahead]
            if sum(x.post[2][k] for x, k in zip(ahead, blocks, strict=True)) >= tau:
                if lists[0].doc == item:
                    score = sum(x.post[1][x.at] for x in ahead)
                    if score >= tau:
                        found.append((item, score))
                    to = item + 1
                else:
                    to = item
            else:  # no item up to the end of the nearest block, or to the next list, can reach tau
                to = min(x.post[3][k] for x, k in zip(ahead, blocks, strict=True)) + 1
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1].doc)
                to = max(to, item + 1)
            moved = [x for x in ahead if x.doc < to]
            rest = [x for x in ahead if x.doc >= to]
            lists = sorted([x for x in moved if x.advance(to)] + rest + lists[pivot + 1 :], key=_Cursor.item)  # few runs already in order
        return found

    def passages(self, terms: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, first word, word after) of passages that the bound does not rule out."""
        step = self.longest
        length = np.diff(offsets)
        blocks = np.maximum(1, -(-length // step))
        first = np.concatenate(([0], np.cumsum(blocks)))
        at = np.flatnonzero((terms >= 0) & (terms < self.frequent))
        if len(self.ids) and self.common.max(initial=0) >= self.tau:
            return [(d, a, a + 2 * step) for d, n in enumerate(length) for a in range(0, int(n), step)]
        doc = np.searchsorted(offsets, at, side="right") - 1
        block = first[doc] + (at - offsets[doc]) // step
        key = np.unique(block * np.int64(max(1, self.frequent)) + terms[at])
        block, term = key // max(1, self.frequent), key % max(1, self.frequent)
        n = self.start[term + 1] - self.start[term]
        row = np.repeat(np.arange(len(key)), n)
        post = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[term], n)
        pair = block[row] * np.int64(max(1, len(self.ids))) + self.post_item[post]
        pairs, where = np.unique(pair, return_inverse=True)
        total = np.bincount(where, self.post_share[post], len(pairs))
        nxt = np.searchsorted(pairs, pairs + len(self.ids))
        ok = nxt < len(pairs)
        hit = np.zeros(len(pairs), bool)
        hit[ok] = pairs[nxt[ok]] == pairs[ok] + len(self.ids)
        both = total.copy()
        both[hit] += total[nxt[hit]]
        before = np.ones(len(pairs), bool)  # without a pair in the block before, the passage that starts there counts too
        before[nxt[hit]] = False
        item, b = pairs % max(1, len(self.ids)), pairs // max(1, len(self.ids))
        good = both + self.common[item] >= self.tau - 1e-9
        lone = (total + self.common[item] >= self.tau - 1e-9) & before
        starts = np.unique(np.concatenate((b[good], b[lone] - 1)))
        doc = np.searchsorted(first, starts, side="right") - 1
        keep = (starts >= 0) & (doc >= 0)
        out = []
        for s, d in zip(starts[keep], doc[keep], strict=True):
            a = int(s - first[d]) * step
            out.append((int(d), a, a + 2 * step))
            if s + 1 < first[d + 1]:
                out.append((int(d), a + step, a + 3 * step))
        return sorted(set(out))

    def leaks(self, w: list[str], terms: np.ndarray) -> list[tuple[int, float, float, float]]:
        """(item, score, question's overlap, answer's overlap) of the items verified in a passage."""
        found = self.search({int(t) for t in np.unique(terms[terms >= 0])})
        out = []
        if found:
            have, cache = set(w), {}
            for i, score in found:
                q, a = self.parts[i]
                k = min(SHINGLE, len(q))
                if k not in cache:
                    cache[k] = grams(w, k)
                asked = grams(q, k)
                qo, ao = len(asked & cache[k]) / len(asked), len(set(a) & have) / len(set(a))
                if qo >= OVERLAP and ao >= OVERLAP:
                    out.append((i, score, qo, ao))
        return out


def _best(index: Index, texts: list[str | None]) -> dict[tuple[int, int], tuple]:
    """(text's place, item) -> score, overlaps, first word, of the best passage."""
    ws = [words(t) for t in texts]
    off = np.concatenate(([0], np.cumsum([len(x) for x in ws])))
    terms = np.fromiter(map(index.terms.get, (w for x in ws for w in x), repeat(-1)), np.int64, int(off[-1]))
    best: dict = {}
    for d, a, b in index.passages(terms, off):
        for i, *f in index.leaks(ws[d][a:b], terms[off[d] + a : min(off[d + 1], off[d] + b)]):
            if (d, i) not in best or best[d, i][:3] < tuple(f):
                best[d, i] = (*f, a)
    return best


def _slices(texts, most: int = 4_000_000):
    """Bounds of runs of texts with about so many characters."""
    size, lo = 0, 0
    for i in range(len(texts)):
        size += len(texts[i].as_py()) if texts[i].is_valid else 0
        if size > most or i + 1 == len(texts):
            yield lo, i + 1
            lo, size = i + 1, 0


def _indexes(spark: SparkSession, benchmark: DataFrame, tau: float) -> list:
    """The broadcast index of each group of items; one where all items fit it."""
    ship(spark)
    items = benchmark.select("item_id", "text").where("length(text) > 0")
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = -(-size // INDEX_BYTES)
    order = lambda x: (x[0] is None, 0 if x[0] is None else x[0], x[1])
    if groups <= 1:
        return [spark.sparkContext.broadcast(Index(sorted(((r.item_id, r.text) for r in items.collect()), key=order), tau))]

    def terms(batches):
        for batch in batches:
            rows = [(g, t, n) for g, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in [words(text)] if w for t, n in [(None, len(w)), *((t, 1) for t in set(w))]]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["part", "term", "n"])

    items = cut(items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(groups)).cast("int")))
    t = cut(items.select("part", "text").mapInArrow(terms, "part int, term string, n long"))  # a row without a term has an item's length
    n_items, mean, longest = t.where("term is null").agg(F.count("*"), F.avg("n"), F.max("n")).first()
    df = cut(t.where("term is not null").groupBy("term").agg(F.count("*").alias("n")))
    own = t.where("term is not null").select("part", "term").distinct()
    out = []
    for g in range(groups):  # a group and its terms at a time reach the driver
        counts = {r.term: r.n for r in own.where(F.col("part") == g).join(df, "term").select("term", "n").collect()}
        rows = sorted(((r.item_id, r.text) for r in items.where(F.col("part") == g).collect()), key=order)
        if rows and counts:
            out.append(spark.sparkContext.broadcast(Index(rows, tau, (n_items, mean, longest, counts))))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, tau: float = TAU) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, score (share of the item's own), overlaps, and the passage's first word."""
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"]
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, score double, question_overlap double, answer_overlap double, first_word int"

    def scan(sent):
        def run(batches):
            index = sent.value
            for batch in batches:
                if not index.ids:
                    continue
                rows = []
                ids, texts = batch.column(0), batch.column(1)
                for lo, hi in _slices(texts):
                    own = ids[lo:hi].to_pylist()
                    rows += [(own[d], index.ids[i], *f) for (d, i), f in sorted(_best(index, texts[lo:hi].to_pylist()).items())]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], ids.type), pa.array(cols[1], item_type), *(pa.array(c, pa.float64()) for c in cols[2:5]), pa.array(cols[5], pa.int32())], names=names)

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    parts = [scan(sent) for sent in _indexes(docs.sparkSession, benchmark, tau)]
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.union(p)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, tau: float = TAU) -> DataFrame:
    """docs without the rows in which an item leaks."""
    at = docs.columns.index("text")

    def without(rows: DataFrame, sent) -> DataFrame:
        def run(batches):
            index = sent.value
            for batch in batches:
                texts, keep = batch.column(at), np.ones(batch.num_rows, bool)
                for lo, hi in _slices(texts):
                    keep[[lo + d for d, _ in _best(index, texts[lo:hi].to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        return rows.mapInArrow(run, docs.schema)

    out = docs
    for sent in _indexes(docs.sparkSession, benchmark, tau):
        out = without(out, sent)
    return out


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
