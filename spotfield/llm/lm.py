"""Language-model scoring with an Elias-Fano n-gram trie (here: unigrams and bigrams).

Training takes two passes. Words are counted and become ids by the order of their 64-bit hashes; level 1 is
the sorted hashes and the counts. Pairs (context, word) are counted and dealt by ranges of context ids to
shards; a task turns a shard's pairs into level 2: monotone pointers from a context to its successors, the
successors themselves (context-relative, made monotone by adding the last value before) both Elias-Fano
coded, and their smoothed log10 probabilities in 16 bits, besides a 16-bit back-off weight per context.
Probabilities: (c(vw) - D) / c(v) + D T(v) / c(v) * P(w) with the add-one unigram P(w); an unseen context
leaves P(w).

Lookups go through the coded levels alone: the pointers of a context bound the places of its successors, and the successor search
finds the first of them that is no less than the word, by selecting the bucket of its leading bits and halving it on the rest.

Levels are files in the folder that the cluster shares, each written by one task under a name of its own and renamed into place;
tasks map them into memory and score whole texts. Only per-bucket counts reach the driver. What is shuffled is each
task's distinct pairs. Words are told apart by 64 bits; more than 2**31 - 1 different ones raise an error, as a pair is a key of
64 bits.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, partitions, shared_folder, small_batches, to_bytes

END, BATCH_TOKENS, NO_BACKOFF = b" end", 1_000_000, 65535
_STEP = 12.0 / 65534  # log10 probabilities from -12 to 0 in 16 bits


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(-log10, 0, 12) / _STEP).astype("<u2")


def restore(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) * -_STEP


_ONES = np.uint64(0x0101010101010101)
_SELECT = np.zeros((256, 8), np.uint8)  # place of the r-th set bit of a byte
for _b in range(256):
    _SELECT[_b, : _b.bit_count()] = [_i for _i in range(8) if _b >> _i & 1]


def _select(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the ``r``-th set bit, from 0, in each word."""
    x = words - ((words >> np.uint64(1)) & np.uint64(0x5555555555555555))
    x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
    upto = ((x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _ONES  # bits set up to each byte
    r, at = r.astype(np.uint64), np.zeros(len(words), np.uint64)
    for step in (32, 16, 8):  # the first byte up to which more than r bits are set
        below = (upto >> (at + np.uint64(step - 8))) & np.uint64(0xFF)
        at = at + np.where(below <= r, np.uint64(step), np.uint64(0))
    before = np.where(at > 0, (upto >> (np.maximum(at, np.uint64(8)) - np.uint64(8))) & np.uint64(0xFF), np.uint64(0))
    return at.astype(np.int64) + _SELECT[((words >> at) & np.uint64(0xFF)).astype(np.int64), (r - before).astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about 2 + log2(largest / n) bits each, with the number of set bits
    before each word of the leading parts (half a bit for each of their bits)."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        bits = max(0, int(int(v[-1] if n else 0) // max(n, 1)).bit_length() - 1)
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(((int(at[-1]) + 1 if n else 0) // 64 + 1) * 64, np.uint8)
        high[at] = 1
        ones = np.concatenate(([0], np.cumsum(high.reshape(-1, 64).sum(1, dtype=np.int64)))).astype("<u4")
        low = np.zeros(0, np.uint8)
        if bits:
            rest = v & np.uint64((1 << bits) - 1)
            low = np.packbits(((rest[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, bits, np.concatenate([low, np.zeros(8, np.uint8)]), np.packbits(high, bitorder="little").view("<u8"), ones)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], "<u8"), self.low, self.high, self.ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i * self.low_bits
        words = np.lib.stride_tricks.sliding_window_view(self.low, 8)[bit >> 3].view("<u8")[:, 0]
        return ((words >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``: the word of the i-th set bit from the counts, then its bit there."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _select(self.high[word], i - self.ones[word])
        return ((place - i) << self.low_bits) | self._low(i)

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many values have leading parts under ``h``: what stands before the h-th unset bit."""
        out = np.where(h > 0, self.n, 0)
        there = np.flatnonzero((h > 0) & (h <= self.zeros[-1]))
        k = h[there] - 1
        word = np.searchsorted(self.zeros, k, side="right") - 1
        out[there] = word * 64 + _select(~self.high[word], k - self.zeros[word]) - k
        return out

    def successor(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first place within [lo, hi) whose value is at least the given one; hi if there is none."""
        h, rest = values >> self.low_bits, values & ((1 << self.low_bits) - 1)
        a = np.clip(self._before(h), lo, hi)
        b = np.maximum(a, np.clip(self._before(h + 1), lo, hi))
        busy = np.flatnonzero(a < b)
        while len(busy):
            mid = (a[busy] + b[busy]) >> 1
            less = self._low(mid) < rest[busy]
            a[busy[less]], b[busy[~less]] = mid[less] + 1, mid[~less]
            busy = busy[a[busy] < b[busy]]
        return a


class Shard:
    """The successors of a range of contexts, their probability codes and the contexts' back-off codes."""

    def __init__(self, pointers: EliasFano, successors: EliasFano, codes: np.ndarray, back: np.ndarray):
        self.pointers, self.successors, self.codes, self.back = pointers, successors, codes, back

    @classmethod
    def of(cls, context: np.ndarray, word: np.ndarray, codes: np.ndarray, back: np.ndarray) -> Shard:
        """From pairs sorted by (context, word); contexts count from 0, and ``back`` has a code for each."""
        pointers = np.searchsorted(context, np.arange(len(back) + 1))
        last = np.zeros(len(back), np.int64)
        full = pointers[1:] > pointers[:-1]
        last[full] = word[pointers[1:][full] - 1]
        base = np.concatenate(([0], np.cumsum(last)[:-1]))
        return cls(EliasFano.of(pointers), EliasFano.of(word + base[context]), codes, back)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of pairs sorted by context, -1 where a pair is unknown, by successor search among each context's successors."""
        n = self.successors.n
        if not n or not len(context):
            return np.full(len(context), -1)
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        each = np.diff(np.append(first, len(context)))
        lo, hi = self.pointers.access(context[first]), self.pointers.access(context[first] + 1)
        base = np.where(lo > 0, self.successors.access(np.maximum(lo - 1, 0)), 0)
        lo, hi, want = np.repeat(lo, each), np.repeat(hi, each), word + np.repeat(base, each)
        at = self.successors.successor(want, lo, hi)
        safe = np.minimum(at, n - 1)
        return np.where((at < hi) & (self.successors.access(safe) == want), self.codes[safe].astype(np.int64), -1)

    def write(self, path: str) -> None:
        arrays = [*self.pointers.arrays(), *self.successors.arrays(), self.codes, self.back]
        _write(path, np.array([a.nbytes for a in arrays], "<u8"), *arrays)

    @classmethod
    def read(cls, path: str) -> Shard:
        raw = np.memmap(path, np.uint8, "r")
        ends = 80 + np.cumsum(raw[:80].view("<u8").astype(np.int64))
        part = [np.asarray(raw[a:b]) for a, b in zip([80, *ends[:-1]], ends, strict=True)]

        def coded(p):
            n, bits = np.frombuffer(p[0].tobytes(), "<u8").tolist()
            return EliasFano(n, bits, p[1], np.frombuffer(p[2].tobytes(), "<u8"), np.frombuffer(p[3].tobytes(), "<u4"))

        return cls(coded(part[:4]), coded(part[4:8]), np.frombuffer(part[8].tobytes(), "<u2"), np.frombuffer(part[9].tobytes(), "<u2"))


def _write(path: str, *arrays: np.ndarray) -> None:
    """One file, renamed into place, so a repeated task leaves a whole file."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        for a in arrays:
            f.write(a.tobytes())
    os.replace(own, path)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, then one end."""
    words = to_bytes(text).lower().split()
    words.append(END)
    return words


class Levels:
    """The mapped files of a trained model."""

    def __init__(self, folder: str, words: int, total: int, chunk: int):
        self.folder, self.words_n, self.total, self.chunk, self.shards = folder, words, total, chunk, {}
        self.hashes = np.memmap(f"{folder}/hashes", "<i8", "r", shape=(words,)) if words else np.zeros(0, np.int64)
        self.counts = np.memmap(f"{folder}/counts", "<i8", "r", shape=(words,)) if words else np.zeros(0, np.int64)
        self.ids: dict[bytes, int] = {}

    def id(self, word: bytes) -> int:
        h = word_hash(word)
        at = int(self.hashes.searchsorted(h))
        found = at if at < self.words_n and self.hashes[at] == h else -1
        if len(self.ids) > 300_000:
            self.ids.clear()
        self.ids[word] = found
        return found

    def encode(self, words: list[bytes]) -> list[int]:
        known, look = self.ids.get, self.id
        return [look(w) if (i := known(w)) is None else i for w in words]

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        """log10 of the add-one probability."""
        c = np.where(ids >= 0, self.counts[np.maximum(ids, 0)], 0) if self.words_n else np.zeros(len(ids))
        return np.log10((c + 1.0) / (self.total + self.words_n + 1.0))

    def shard(self, k: int) -> Shard | None:
        if k not in self.shards:
            path = f"{self.folder}/pairs-{k}"
            self.shards[k] = Shard.read(path) if os.path.exists(path) else None
        return self.shards[k]

    def pairs(self, context: np.ndarray, word: np.ndarray, uni: np.ndarray) -> np.ndarray:
        """log10 P(word | context); ids, -1 for unknown ones."""
        out = uni.copy()
        ok = np.flatnonzero(context >= 0)
        if not self.words_n or not len(ok):
            return out
        keys, back = np.unique((context[ok] << 32) | (word[ok] + 1), return_inverse=True)
        codes, weights = np.full(len(keys), -1), np.full(len(keys), NO_BACKOFF)
        owner = (keys >> 32) // self.chunk
        edges = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if (s := self.shard(int(owner[a]))) is not None:
                at = (keys[a:b] >> 32) - int(owner[a]) * self.chunk
                weights[a:b] = s.back[at]
                known = np.flatnonzero(keys[a:b] & 0xFFFFFFFF)
                codes[a + known] = s.find(at[known], (keys[a + known] & 0xFFFFFFFF) - 1)
        fixed = np.where(codes >= 0, restore(codes), np.where(weights == NO_BACKOFF, 0.0, restore(weights)))[back]
        seen = (codes >= 0)[back]
        out[ok] = np.where(seen, fixed, out[ok] + fixed)
        return out


@lru_cache(maxsize=1)
def opened(folder: str, words: int, total: int, chunk: int) -> Levels:
    return Levels(folder, words, total, chunk)


def _batches(texts: Iterator[tuple], levels: Levels, size: int) -> Iterator[list[tuple]]:
    """(row, token ids) in lists of at least ``size`` tokens, the last excepted."""
    held, n = [], 0
    for row, text in texts:
        held.append((row, np.array(levels.encode(tokens(text)), np.int64)))
        n += len(held[-1][1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def train(docs: DataFrame, discount: float = 0.75, shard_pairs: int = 2_000_000) -> tuple[str, int, int, int]:
    """Trains on every row's whole text; returns what ``Levels`` opens: folder, words, tokens, contexts per shard."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("text").alias("text"))
    folder = shared_folder(spark, "ngrams")

    def count_words(batches):
        seen: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["h", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(tokens(t))
            if len(seen) > 250_000:
                yield flush()
                seen.clear()
        yield flush()

    vocabulary = durable(texts.mapInArrow(count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).withColumn("bucket", F.shiftright("h", 56).cast("int")))
    buckets = sorted(tuple(r) for r in vocabulary.groupBy("bucket").agg(F.count(F.lit(1)), F.sum("c")).collect())  # 256 at most
    words, total = sum(b[1] for b in buckets), sum(b[2] for b in buckets)
    if words >= (1 << 31) - 1:
        raise ValueError("more than 2**31 - 2 different words")
    starts = dict(zip((b[0] for b in buckets), np.cumsum([0, *(b[1] for b in buckets)])[:-1].tolist(), strict=True))
    if not words:
        return folder, 0, 0, 1

    def write_words(batches):
        now, parts, made = None, [], 0
        for b in batches:
            bucket, h, c = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if bucket[lo] != now and parts:
                    made += finish(now, parts)
                    parts = []
                now = int(bucket[lo])
                parts.append((h[lo:hi], c[lo:hi]))
        if parts:
            made += finish(now, parts)
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int32())], ["n"])

    def finish(bucket, parts):
        for name, x in zip(("hashes", "counts"), zip(*parts, strict=True), strict=True):
            _write(f"{folder}/{name}-{bucket}", np.concatenate(x).astype("<i8"))
        return 1

    def join_words(batches):
        """Level 1 in one file each: a copy of the buckets' files in order, 16 bytes a word."""
        for b in batches:
            for name in b.column(0).to_pylist():
                own = f"{folder}/{name}.{uuid.uuid4().hex}"
                with open(own, "wb") as to:
                    for bucket in starts:
                        with open(f"{folder}/{name}-{bucket}", "rb") as f:
                            shutil.copyfileobj(f, to, 1 << 24)
                os.replace(own, f"{folder}/{name}")
            yield b

    vocabulary.select("bucket", "h", "c").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "h").mapInArrow(write_words, "n int").collect()
    spark.createDataFrame([("hashes",), ("counts",)], "name string").repartition(2).mapInArrow(join_words, "name string").collect()
    shards = max(partitions(spark), -(-total // shard_pairs))
    chunk = max(1, -(-(words + 1) // shards))
    model = (folder, words, total, chunk)

    def count_pairs(batches):
        levels = Levels(*model)
        for held in _batches(((None, t) for b in batches for t in b.column(0).to_pylist()), levels, BATCH_TOKENS):
            keys = np.concatenate([_keys(ids, words) for _, ids in held])
            keys, n = np.unique(keys, return_counts=True)
            owner = (keys >> 32) // chunk
            which, first = np.unique(owner, return_index=True)
            ends = [*first[1:], len(keys)]
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array([keys[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()), pa.array([n[a:b].astype("<u4").tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())], ["shard", "keys", "n"])

    def build(batches):
        levels, now, parts, made = Levels(*model), None, [], 0

        def finish():
            keys, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, n = keys[first], np.add.reduceat(n, first)
            low = now * chunk
            contexts = min(chunk, words + 1 - low)
            context, word = (keys >> 32) - low, keys & 0xFFFFFFFF
            c, types = np.bincount(context, n, contexts), np.bincount(context, minlength=contexts)
            with np.errstate(divide="ignore", invalid="ignore"):
                back = np.where(types > 0, quantise(np.log10(np.maximum(discount * types / c, 1e-12))), NO_BACKOFF).astype("<u2")
            p = (n - discount) / c[context] + (discount * types / np.maximum(c, 1))[context] * 10 ** levels.unigram(word)
            Shard.of(context, word, quantise(np.log10(p)), back).write(f"{folder}/pairs-{now}")

        for b in batches:
            for shard, keys, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if shard != now and parts:
                    finish()
                    parts, made = [], made + 1
                now = shard
                parts.append((np.frombuffer(keys, np.int64), np.frombuffer(n, "<u4").astype(np.int64)))
        if parts:
            finish()
            made += 1
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int32())], ["n"])

    texts.mapInArrow(count_pairs, "shard long, keys binary, n binary").repartition(partitions(spark), "shard").sortWithinPartitions("shard").mapInArrow(build, "n int").collect()
    return model


def _keys(ids: np.ndarray, start: int) -> np.ndarray:
    """Pairs of each token and what stands before it; the start is the id after the last word's."""
    return (np.concatenate(([start], ids[:-1])) << 32) | ids


def scores(docs: DataFrame, model: tuple[str, int, int, int], carry: list[str]) -> DataFrame:
    """The ``carry`` columns and n_tokens, n_known, base_score and score of every whole text; null texts are empty."""
    folder, words, total, chunk = model
    kept = docs.select(*carry, F.col("text").alias("__text"))

    def run(batches):
        levels = opened(folder, words, total, chunk)
        rows = ((r, t) for b in batches for r, t in zip(zip(*(b.column(i).to_pylist() for i in range(len(carry))), strict=True), b.column(len(carry)).to_pylist(), strict=True))
        for held in _batches(rows, levels, BATCH_TOKENS):
            n = np.array([len(ids) for _, ids in held])
            ids = np.concatenate([ids for _, ids in held])
            first = np.cumsum(n) - n
            context = np.concatenate(([0], ids[:-1]))
            context[first] = words
            uni = levels.unigram(ids)
            pair = levels.pairs(context, ids, uni)
            sums = [pa.array(np.add.reduceat(x, first)) for x in ((ids >= 0).astype(np.int64), uni, pair)]
            cols = [pa.array(c, t) for c, t in zip(zip(*(r for r, _ in held), strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n.astype(np.int64)), *sums], names)

    fields = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32()}
    types = [fields[k] for c, k in kept.dtypes[:-1]]
    names = [*carry, "n_tokens", "n_known", "base_score", "score"]
    schema = ", ".join([f"`{c}` {k}" for c, k in kept.dtypes[:-1]] + ["n_tokens long", "n_known long", "base_score double", "score double"])
    return kept.mapInArrow(run, schema)
