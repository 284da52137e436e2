"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Texts are tokenized whole, cut into pieces of at most ``capacity`` tokens, and the pieces' descriptors
(never the tokens) are dealt at random into blocks of about ``block_rows`` rows. A task packs one block:
best fit decreasing, then local search, which takes the emptiest bin and tries to empty it by moving its
pieces into other underfull bins, exchanging one of its pieces for a shorter one there, or one for two;
each step raises the sum of squared fills. Bins still open afterwards (less than ``closed_at`` full) are
taken apart and packed again together with those of other blocks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import durable

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordCachedTokenizer:
    """Token ids, as little-endian unsigned 32-bit bytes, of a tokenizer file that ignores white space.

    Text is split at spaces, tabs and line feeds, where such a tokenizer always has a boundary. Words of
    Latin letters and trailing ASCII signs other than the apostrophe fall apart further, into the letters,
    which the tokenizer lower-cases, and the signs. Ids of the parts are kept in caches of a bounded size.
    """

    _PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")

    def __init__(self, path: str, most_words: int = 200_000, most_parts: int = 700_000):
        self.tokenizer, self.words, self.parts = Tokenizer.from_file(path), {}, {}
        self.most_words, self.most_parts = most_words, most_parts

    def _encode(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
            if len(self.parts) >= self.most_parts:
                self.parts.clear()
            self.parts[part] = found
        return found

    def _word(self, word: str) -> bytes:
        plain = self._PLAIN.match(word)
        out = self._encode(plain[1].lower()) + (self._encode(plain[2]) if plain[2] else b"") if plain else self._encode(word)
        if len(self.words) >= self.most_words:
            self.words.clear()
        self.words[word] = out
        return out

    def ids(self, text: str) -> bytes:
        known, miss, out = self.words.get, self._word, []
        for word in text.replace("\n", " ").replace("\t", " ").split(" "):
            if word:
                got = known(word)
                out.append(miss(word) if got is None else got)
        return b"".join(out)


@lru_cache(maxsize=2)
def cached_tokenizer(path: str) -> WordCachedTokenizer:
    return WordCachedTokenizer(path)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids and then ``end_id``, cut into ``capacity`` tokens where longer.

    A null or empty text is the end id alone. ``with_ids`` adds the ids of each piece (array of ints).
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = cached_tokenizer(tokenizer_path).ids
        for b in batches:
            rows, ids = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (encode(text) if text else b"") + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices by best fit decreasing; free space is looked up in a bit set."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if open_ := there >> n:
            free = n + (open_ & -open_).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                there &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        by_free[free - n].append(b)
        there |= 1 << (free - n)
    return bins


def local_search(lengths: list[int], bins: list[list[int]], capacity: int, tries: int = 300, patience: int = 4) -> list[list[int]]:
    """Raises the sum of squared fills until bins become empty; ``tries`` is how many underfull bins an
    exchange looks at and ``patience`` how many of the emptiest bins in a row may resist."""
    least = -(-sum(lengths) // capacity)
    fill = [sum(lengths[i] for i in b) for b in bins]
    under = sorted((capacity - f, b) for b, f in enumerate(fill) if f < capacity)  # by free space
    alive, failed = len(bins), 0

    def put(b: int, items: list[int]) -> None:
        if fill[b] < capacity:
            del under[bisect_left(under, (capacity - fill[b], b))]
        bins[b], fill[b] = items, sum(lengths[i] for i in items)
        if items and fill[b] < capacity:
            x = (capacity - fill[b], b)
            under.insert(bisect_left(under, x), x)

    def improve(source: int) -> bool:
        for i in sorted(bins[source], key=lambda i: -lengths[i]):
            a = lengths[i]
            at = bisect_left(under, (a, -1))
            to = next((b for _, b in under[at : at + 2] if b != source), None)
            if to is not None:  # move
                put(to, [*bins[to], i])
                put(source, [x for x in bins[source] if x != i])
                return True
            best = None
            for free, b in under[-1 : -tries - 1 : -1]:
                if b == source or free == 0:
                    continue
                inside = sorted((lengths[x], x) for x in bins[b] if lengths[x] < a)
                for k, (n, x) in enumerate(inside):
                    if a - n <= free and (best is None or a - n > best[0]):
                        best = (a - n, b, (x,))
                    for m, y in inside[k + 1 :]:
                        if 0 < a - n - m <= free and (best is None or a - n - m > best[0]):
                            best = (a - n - m, b, (x, y))
            if best:  # one for one, one for two
                _, b, back = best
                if fill[b] + best[0] > fill[source] - best[0]:
                    put(b, [x for x in bins[b] if x not in back] + [i])
                    put(source, [x for x in bins[source] if x != i] + list(back))
                    return True
        return False

    resisting: set[int] = set()
    while alive > least and failed < patience:
        source = next((b for _, b in reversed(under) if b not in resisting), None)
        if source is None:
            break
        for _ in range(64):
            if not bins[source] or not improve(source):
                break
        if bins[source]:
            resisting.add(source)
            failed += 1
        else:
            alive, failed = alive - 1, 0
    return [b for b in bins if b]


def _pack_block(level: int, capacity: int, closed_at: float):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], ignore_index=True)
        lengths = rows["length"].tolist()
        bins = local_search(lengths, best_fit(lengths, capacity), capacity)
        sequence, offset, is_open = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64), np.empty(len(rows), bool)
        base = (int(rows["block"].iloc[0]) * 2 + level) << 32
        for k, b in enumerate(bins):
            n = [lengths[i] for i in b]
            sequence[b], offset[b], is_open[b] = base + k, np.cumsum([0, *n[:-1]]), sum(n) < closed_at * capacity
        rows["sequence_id"], rows["offset"], rows["open"] = sequence, offset, is_open
        return rows.drop(columns="block")

    return pack


def pack(pieces: DataFrame, capacity: int = 2048, block_rows: int = 20_000, closed_at: float = 0.98) -> DataFrame:
    """Each piece with the sequence that takes it and its offset there, gapless from 0.

    ``pieces`` has the columns of ``tokenized_pieces``. Blocks are drawn by a hash of the row's place, not of
    its content, so repeated rows spread like others. An empty table gives an empty one.
    """
    pieces = durable(pieces.select(*(x.split()[0] for x in PIECES.split(", "))))
    out = PIECES + ", sequence_id long, offset long, open boolean"

    def level(rows: DataFrame, number: int, closed: float) -> DataFrame:
        blocks = max(1, -(-rows.count() // block_rows))
        dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
        return durable(dealt.groupBy("block").applyInPandas(_pack_block(number, capacity, closed), out))

    first = level(pieces, 0, closed_at)
    again = level(first.where("open").drop("sequence_id", "offset", "open"), 1, 0.0)
    return first.where("not open").unionByName(again).drop("open")
