"""Operator 3, language-model scoring: an Elias-Fano n-gram trie in shards.

Tokens are ASCII-lower-cased words and one end for each text. The model is of trigrams with
absolute discounting, interpolated with bigrams, and these with add-one unigrams. A shard holds
the part of the trie below the first words whose hash falls to it. Its levels: the hashes of
the first words; the second words of each; the third words of each pair. Words below the first
level are ids in the shard's own vocabulary (48 bits of a hash), made monotone by the place of
their context, and pointers tell where the successors of each context begin; all of these are
Elias-Fano sequences of exact bit widths, read through sampled ranks alone. Smoothed probabilities and
back-off weights are quantised to 8 bits. A successor is found by a search relative to its context.
Packed levels are read in place from whatever holds their bytes, a memory-mapped file included.

Documents form chunks; a chunk asks each shard once for all its distinct words, bigrams and
trigrams, itself as a trie of Elias-Fano sequences with counts in training texts, so that
training and queries share one exchange and no task holds more than a shard. Nothing is pruned:
what is gathered grows with the corpus.

Null and empty texts have one token, the end; whole texts are scored, however long; repeated
rows count and score alike; rows with a null id are not held out; without training text all
counts are 0 (the base is then log10 of 1/1 = 0 for each token); an empty table gives an empty
result; only doc_id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, table
from .exchange import MESSAGE, chunked, messages, pack, split, unpack

DISCOUNT = 0.75
CHUNK_BYTES = 8_000_000
SHARD_BYTES = 32_000_000  # of text whose contexts a shard holds
STEP = 0.03  # decades between the quantised logarithms
WORDS = 300_000  # whose hashes a worker remembers
END, BEGIN = b" end", b" begin"  # no word holds white space

_words = WordHash()


def quantise(p: np.ndarray) -> np.ndarray:
    """8-bit codes of probabilities; 0 stands for none."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round(255 + np.log10(np.maximum(p, 1e-30)) / STEP), 1, 255), 0).astype(np.uint8)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** ((codes.astype(np.float64) - 255) * STEP), 0.0)


def _bits_of_bytes() -> np.ndarray:
    """Place of the k-th set bit of each byte, by 256 k + byte."""
    set_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    out, rank = np.zeros((8, 256), np.int64), np.cumsum(set_bits, axis=1) - 1
    byte, bit = np.nonzero(set_bits)
    out[rank[byte, bit], byte] = bit
    return out.ravel()


_BIT = _bits_of_bytes()
_EACH, _TOP, _ODD, _TWO, _FOUR = (np.uint64(int(x * 8, 16)) for x in ("01", "80", "55", "33", "0f"))


def select_bit(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit (from 0) of each word, by sums over its bytes and a table of bytes."""
    one, two, four, eight = (np.uint64(n) for n in (1, 2, 4, 8))
    s = x - (x >> one & _ODD)
    s = (s & _TWO) + (s >> two & _TWO)
    s = (s + (s >> four) & _FOUR) * _EACH  # each byte: the set bits up to its end
    place = np.bitwise_count((k * _EACH | _TOP) - s & _TOP).astype(np.uint64) * eight
    rest = k - ((s << eight) >> place & np.uint64(255))
    return place.astype(np.int64) + _BIT[(rest << eight | (x >> place & np.uint64(255))).astype(np.int64)]


class EliasFano:
    """A monotone sequence of uint64: low bits packed without gaps, high bits in unary after a first 0, and the rank at each 256th high bit."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self._at = np.ndarray((max(0, low.nbytes - 7),), np.dtype("<u8"), low, strides=(1,)) if bits else None
        self._ranks = None

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values).astype(np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        bits = min(56, max(0, (int(v[-1]) // n).bit_length() - 1))  # 56 and a shift of 7 fit one load
        low = np.zeros(n * bits // 64 + 2 if bits else 0, np.uint64)
        if bits:
            at = np.arange(n, dtype=np.int64) * bits
            x, word, off = v & np.uint64((1 << bits) - 1), at >> 6, (at & 63).astype(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[first]] = np.bitwise_or.reduceat(x << off, first)
            over = np.flatnonzero((at & 63) + bits > 64)
            low[word[over] + 1] |= x[over] >> (np.uint64(64) - off[over])
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(1, n + 1)
        flags = np.zeros(256 * (int(ones[-1] + 2) // 256 + 1), np.uint8)  # two 0 bits at the end at least
        flags[ones] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little").view(np.dtype("<u8")))

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), arrays[1], arrays[2])

    @property
    def nbytes(self) -> int:
        """What the sequence takes, with the ranks once it has been read."""
        return self.low.nbytes + self.high.nbytes + (self._ranks.nbytes if self._ranks is not None else 0)

    def _low(self, at: np.ndarray) -> np.ndarray:
        """The low bits of the values at those places."""
        if not self.bits:
            return np.zeros(len(at), np.uint64)
        pos = at * self.bits
        return self._at[pos >> 3] >> (pos & 7).astype(np.uint64) & np.uint64((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place among the high bits of the k-th one (or zero), counted from 0."""
        if self._ranks is None:
            kind = np.uint32 if self.n < 1 << 32 else np.int64
            self._ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(self.high).reshape(-1, 4).sum(1, np.int64)))).astype(kind)
        before = self._ranks.astype(np.int64)
        if not one:
            before = np.arange(len(before)) * 256 - before
        word = np.searchsorted(before, k, "right") - 1
        rest = k - before[word]
        word *= 4
        flip = np.uint64(0 if one else 0xFFFFFFFFFFFFFFFF)
        bits = self.high[word] ^ flip
        for _ in range(3):
            c = np.bitwise_count(bits)
            on = rest >= c
            if not on.any():
                break
            rest -= c * on
            word += on
            bits = self.high[word] ^ flip
        return word * 64 + select_bit(bits, rest.astype(np.uint64))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self._select(at, True) - at - 1).astype(np.uint64) << np.uint64(self.bits) | self._low(at)

    def values(self) -> np.ndarray:
        """The whole sequence, decoded."""
        at = np.arange(self.n)
        high = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little").view(bool)) - at - 1
        return high.astype(np.uint64) << np.uint64(self.bits) | self._low(at)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of the first value >= x, for each x; those x whose high bits some value has; and of these, whether it is x itself."""
        zeros = 64 * len(self.high) - self.n
        h = np.minimum(x >> np.uint64(self.bits), np.uint64(zeros - 2)).astype(np.int64)  # no value has the last one
        here = self._select(h, False)
        at, here = here - h, here + 1
        some = np.flatnonzero((self.high[here >> 6] >> (here & 63).astype(np.uint64) & np.uint64(1)).astype(bool))
        low, lo, end = x[some] & np.uint64((1 << self.bits) - 1), at[some], self._select(h[some] + 1, False) - h[some] - 1
        hi, todo = end.copy(), np.arange(len(some))
        while len(todo):
            mid = (lo[todo] + hi[todo]) // 2
            less = self._low(mid) < low[todo]
            lo[todo[less]], hi[todo[~less]] = mid[less] + 1, mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        at[some] = lo
        same = lo < end
        same[same] = self._low(lo[same]) == low[same]
        return at, some, same

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value >= x (n if there is none), for each x."""
        return self._search(x)[0] if self.n else np.zeros(len(x), np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, or -1."""
        out = np.full(len(x), -1, np.int64)
        if self.n and len(x):
            at, some, same = self._search(x)
            out[some[same]] = at[some[same]]
        return out


def squeeze(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as bytes, and places and values of those that need more."""
    big = np.flatnonzero(counts > 254)
    return np.minimum(counts, 255).astype(np.uint8), big.astype(np.uint32), counts[big].astype(np.uint32)


def expand(small: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[places] = values
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the place of each key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def ascending(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sum of the counts of each; the lists are emptied."""
    k, n = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *times])
    keys.clear(), times.clear()
    order = np.argsort(k)
    k = k[order]
    first = np.flatnonzero(np.diff(k, prepend=-1))
    return k[first], np.add.reduceat(n[order], first) if len(first) else n


def smoothed(of: np.ndarray, times: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray, EliasFano]:
    """Codes of discounted probabilities of successors (of: places of their contexts, ascending), of the back-off weights of contexts, and the pointers."""
    seen, kinds = np.bincount(of, times, contexts), np.bincount(of, minlength=contexts)
    with np.errstate(divide="ignore", invalid="ignore"):
        weights = np.where(seen > 0, DISCOUNT * kinds / seen, 0.0)
        p = np.maximum(times - DISCOUNT, 0) / seen[of]
    return quantise(p), quantise(weights), EliasFano.build(np.concatenate(([0], np.cumsum(kinds))))


class Shard:
    """The levels of one shard's part of the trie, read in place from bytes or from a memory-mapped file of them."""

    def __init__(self, data: bytes | np.ndarray):
        take = iter(unpack(data))
        ef = lambda: EliasFano.of([next(take) for _ in range(3)])
        self.contexts, self.vocabulary, self.second, self.third = ef(), ef(), ef(), ef()
        self.pointers = ef(), ef()
        self.small, self.places, self.large = next(take), next(take), next(take)
        self.weights, self.codes = (next(take), next(take)), (next(take), next(take))

    @staticmethod
    def build(requests: list) -> bytes:
        """The levels out of what chunks counted in training texts; a request is decoded for each level, and one at a time."""
        heads, tails = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for r in map(Request, requests):
            used = r.counts > 0
            used[r.of2[r.times2 > 0]] = True
            heads.append(r.words[used])
            used = np.zeros(len(r.vocabulary), bool)
            used[r.after2[r.times2 > 0]] = True
            used[r.after3[r.times3 > 0]] = True
            tails.append(r.vocabulary[used])
        contexts, vocabulary = ascending(np.concatenate(heads)), ascending(np.concatenate(tails))
        count, v = np.zeros(len(contexts), np.int64), max(1, len(vocabulary))
        keys, times, places = [], [], []
        for r in map(Request, requests):
            known, trained = np.flatnonzero(r.counts), r.times2 > 0
            first, ids = np.searchsorted(contexts, r.words), np.searchsorted(vocabulary, r.vocabulary)
            count[first[known]] += r.counts[known]
            keys.append(first[r.of2[trained]] * v + ids[r.after2[trained]]), times.append(r.times2[trained])
            places.append((first.astype(np.int32), ids.astype(np.int32)))  # a shard is small
        second, n2 = summed(keys, times)
        for r, (first, ids) in zip(map(Request, requests), places, strict=True):
            trained = r.times3 > 0
            key = first[r.of2].astype(np.int64) * v + ids[r.after2]
            keys.append(np.searchsorted(second, key)[r.of3[trained]] * v + ids[r.after3[trained]]), times.append(r.times3[trained])
        third, n3 = summed(keys, times)
        code2, weight1, pointers1 = smoothed(second // v, n2, len(contexts))
        code3, weight2, pointers2 = smoothed(third // v, n3, len(second))
        levels = [EliasFano.build(x) for x in (contexts, vocabulary, second, third)]
        parts = [x for e in (*levels, pointers1, pointers2) for x in e.arrays()]
        return pack(*parts, *squeeze(count), weight1, weight2, code2, code3)

    def counts(self) -> np.ndarray:
        return expand(self.small, self.places, self.large)

    def _below(self, level: int, context: np.ndarray, of: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The places of successors (ids) of contexts (places, by `of`) on a level, or -1."""
        e, out = (self.second, self.third)[level], np.full(len(word), -1, np.int64)
        if not e.n:
            return out
        begin, end = np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        ok = np.flatnonzero(context >= 0)
        begin[ok], end[ok] = self.pointers[level].get(context[ok]), self.pointers[level].get(context[ok] + 1)
        ok = np.flatnonzero((begin < end)[of] & (word >= 0))
        at = e.find((context[of[ok]] * max(1, self.vocabulary.n) + word[ok]).astype(np.uint64))
        inside = (at >= begin[of[ok]]) & (at < end[of[ok]])
        out[ok[inside]] = at[inside]
        return out

    def answer(self, r: Request, counts: np.ndarray) -> list[np.ndarray]:
        """Counts of words; codes of the weights of words, of bigrams, of the weights of bigrams, of trigrams."""
        pick = lambda values, at: np.where(at >= 0, values[at], 0).astype(values.dtype) if len(values) else np.zeros(len(at), values.dtype)
        first, ids = self.contexts.find(r.words), self.vocabulary.find(r.vocabulary)
        second = self._below(0, first, r.of2, ids[r.after2])
        third = self._below(1, second, r.of3, ids[r.after3])
        return [*squeeze(pick(counts, first)), pick(self.weights[0], first), pick(self.codes[0], second), pick(self.weights[1], second), pick(self.codes[1], third)]


def held_out(doc_id: Column, modulus: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def fingerprint(words: np.ndarray) -> np.ndarray:
    """48 bits of a word's hash, which tell it from others in the vocabulary of a shard; words as tokens and first words keep all 64."""
    return words >> np.uint64(16)


def seal(*arrays: np.ndarray) -> bytes:
    """Packed arrays, compressed, behind their length."""
    body = pack(*arrays)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unseal(data: bytes | pa.Buffer) -> list[np.ndarray]:
    data = pa.py_buffer(data)
    return unpack(pa.decompress(data.slice(8), decompressed_size=int(np.frombuffer(data, np.int64, 1)[0]), codec="zstd"))


def inbox(table: pa.Table) -> list[tuple[int, int, pa.Buffer]]:
    """Shard, chunk and data (not copied) of the messages of a table, in a fixed order."""
    data = [x.as_buffer() for part in table.column("data").chunks for x in part]
    return sorted(zip(table.column("shard").to_pylist(), table.column("chunk").to_pylist(), data, strict=True), key=lambda x: x[:2])


class Chunk:
    """Distinct words (ascending hashes), bigrams and trigrams of some texts, and the place of each token's own; trigrams are of tokens that follow another (inner)."""

    def __init__(self, texts: list[bytes]):
        tokens, lengths, part = [], [], []
        for i, t in enumerate(texts):
            w = t.lower().split()
            lengths.append(len(w) + 1)
            part += w
            part.append(END)
            if len(part) > 50_000 or i + 1 == len(texts):
                _words.forget(WORDS)
                tokens.append(_words.of(part))
                part = []
        lengths = np.array(lengths, np.int64)
        h = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths
        begin = np.uint64(_words[BEGIN])
        self.words, where = distinct(np.concatenate((h, [begin])).astype(np.uint64))
        self.token = where[:-1]
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.starts] = where[-1]
        pairs, self.bigram = distinct(before * len(self.words) + self.token)
        self.before, self.after = pairs // len(self.words), pairs % len(self.words)
        inner = np.ones(len(self.token), bool)
        inner[self.starts] = False
        self.inner = np.flatnonzero(inner)
        triples, self.trigram = distinct(self.bigram[self.inner - 1] * len(self.words) + self.token[self.inner])
        self.pair, self.last = triples // len(self.words), triples % len(self.words)

    def by_shard(self, shards: int):
        """(places of words, of bigrams, of trigrams) of each shard; they follow their first word's."""
        of = (self.words % np.uint64(shards)).astype(np.int64)
        pairs = of[self.before]
        return list(zip(split(of, shards), split(pairs, shards), split(pairs[self.pair], shards), strict=True))

    def request(self, w: np.ndarray, p: np.ndarray, t: np.ndarray, counts: np.ndarray, times2: np.ndarray, times3: np.ndarray) -> bytes:
        """What the chunk asks one shard: a small trie with counts, whose ids are of the message's own vocabulary."""
        used = np.zeros(len(self.words), bool)
        used[self.after[p]] = True
        used[self.last[t]] = True
        ids, vocabulary = np.cumsum(used) - 1, fingerprint(self.words[used])
        v = max(1, len(vocabulary))
        second = np.searchsorted(w, self.before[p]) * v + ids[self.after[p]]
        third = np.searchsorted(p, self.pair[t]) * v + ids[self.last[t]]
        parts = [x for values in (self.words[w], vocabulary, second, third) for x in EliasFano.build(values).arrays()]
        return seal(*parts, *squeeze(counts[w]), *squeeze(times2[p]), *squeeze(times3[t]))


class Request:
    """A chunk's request, decoded: words, vocabulary; bigrams and trigrams as the place of their context (of) and the id of their word (after); counts."""

    def __init__(self, data: bytes | pa.Buffer):
        a = unseal(data)
        self.words, self.vocabulary, second, third = (EliasFano.of(a[i : i + 3]).values() for i in (0, 3, 6, 9))
        v = max(1, len(self.vocabulary))
        second, third = second.astype(np.int64), third.astype(np.int64)
        self.of2, self.of3 = second // v, third // v
        self.after2, self.after3 = second - self.of2 * v, third - self.of3 * v
        self.counts, self.times2, self.times3 = (expand(*a[i : i + 3]) for i in (12, 15, 18))


def build_shard(rows: pa.Table) -> pa.Table:
    """One row with the levels of the shard, out of all that chunks ask and count."""
    box = inbox(rows)
    return messages([(box[0][0], -1, 2, Shard.build([data for _, _, data in box]))])


def answer(rows: pa.Table) -> pa.Table:
    """For each chunk: tokens and distinct tokens of the shard in training, counts and codes of what it asked of the shard's levels."""
    box = inbox(rows)
    levels = Shard(Shard.build([data for _, _, data in box]))
    counts = levels.counts()
    own = np.array([counts.sum(), (counts > 0).sum()], np.int64)
    return messages([(shard, chunk, 1, seal(own, *levels.answer(Request(data), counts))) for shard, chunk, data in box])


def _requests(rows: DataFrame, shards: int) -> DataFrame:
    def ask(t: pa.Table) -> pa.Table:
        c = Chunk(t.column("text").to_pylist())
        trained = ~np.repeat(np.array(t.column("held_out").to_pylist(), bool), c.lengths)
        counts = np.bincount(c.token, trained, len(c.words)).astype(np.uint32)
        times2 = np.bincount(c.bigram, trained, len(c.before)).astype(np.uint32)
        times3 = np.bincount(c.trigram, trained[c.inner], len(c.pair)).astype(np.uint32)
        chunk = t.column("chunk")[0].as_py()
        return messages([(s, chunk, 0, c.request(w, p, q, counts, times2, times3)) for s, (w, p, q) in enumerate(c.by_shard(shards))])

    return rows.groupBy("chunk").applyInArrow(ask, MESSAGE)


def train(docs: DataFrame, out: Column) -> DataFrame:
    """The model of the rows of docs that `out` does not hold out: a message with the levels of each shard."""
    rows, n = chunked(docs, ["doc_id", out.alias("held_out")], chunk_bytes=CHUNK_BYTES, shard_bytes=SHARD_BYTES)
    return _requests(rows, n).groupBy("shard").applyInArrow(build_shard, MESSAGE)


def score(docs: DataFrame, out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, by the model of the rows not held out."""
    rows, n = chunked(docs, ["doc_id", out.alias("held_out")], chunk_bytes=CHUNK_BYTES, shard_bytes=SHARD_BYTES)
    told = _requests(rows, n).groupBy("shard").applyInArrow(answer, MESSAGE)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not t.num_rows:
            return pa.table([pa.array([], t.schema.field("doc_id").type), pa.array([], pa.bool_()), *(pa.array([], pa.int64()) for _ in range(3)), *(pa.array([], pa.float64()) for _ in range(2))], names=names)
        c = Chunk(t.column("text").to_pylist())
        count, weight1 = np.zeros(len(c.words), np.int64), np.zeros(len(c.words), np.uint8)
        code2, weight2, code3 = np.zeros(len(c.before), np.uint8), np.zeros(len(c.before), np.uint8), np.zeros(len(c.pair), np.uint8)
        box = {shard: unseal(data) for shard, _, data in inbox(answers)}
        total = distinct_words = 0
        for s, (w, p, q) in enumerate(c.by_shard(n)):
            own, small, places, large, weight1[w], code2[p], weight2[p], code3[q] = box[s]
            total, distinct_words = total + int(own[0]), distinct_words + int(own[1])
            count[w] = expand(small, places, large)
        unigram = (count + 1) / (total + distinct_words + 1)
        back = lambda codes: np.where(codes > 0, dequantise(codes), 1.0)
        bigram = np.minimum(dequantise(code2) + back(weight1)[c.before] * unigram[c.after], 1.0)
        each = bigram[c.bigram]
        each[c.inner] = np.minimum(dequantise(code3)[c.trigram] + back(weight2)[c.bigram[c.inner - 1]] * each[c.inner], 1.0)
        per_doc = lambda x: np.add.reduceat(x, c.starts)
        base, scored = per_doc(np.log10(unigram)[c.token]), per_doc(np.log10(each))
        return pa.table([t.column("doc_id"), t.column("held_out"), pa.array(c.lengths), pa.array(per_doc((count > 0).astype(np.int64)[c.token])), pa.array(np.full(t.num_rows, total)), pa.array(base), pa.array(scored)], names=names)

    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), held_out(F.col("doc_id")))
