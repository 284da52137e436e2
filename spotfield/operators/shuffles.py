"""Replicates drawn inside tasks: a task gets a whole sample, packed, and a block of its replicates.

The draws are those of ``permute.replicates``: places ordered by spot, values by md5(seed:replicate:spot), then spot.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spots and edges of the largest sample that a task holds (some 80 bytes each); larger ones go by relations.
HELD = 6_000_000
#: Tasks that share a sample's replicates, each of which is sent the sample; fewer where a task's work would be tiny.
BLOCKS, LEAST_WORK = 24, 2_000_000

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_block(words: list, n: int) -> list[np.ndarray]:
    """MD5 of n messages of one block: its 16 words, each an array or one number for all."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f = np.empty(n, np.uint32)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16]
        f += a
        if isinstance(word, np.ndarray):
            f += word
            f += np.uint32(_SINES[i])
        else:
            f += np.uint32((_SINES[i] + word) & 0xFFFFFFFF)
        by = _SHIFTS[turn][i % 4]
        np.right_shift(f, np.uint32(32 - by), out=a)
        f <<= np.uint32(by)
        f |= a
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [x + np.uint32(y) for x, y in zip((a, b, c, d), _START, strict=True)]


def digests(prefix: str, ids: np.ndarray, chunk: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """The two halves, as whole numbers in the order of the hexadecimal text, of the MD5 of ``prefix`` and each of the sorted ids."""
    high, low = np.empty(len(ids), np.uint64), np.empty(len(ids), np.uint64)
    head = prefix.encode()
    if len(ids) and (ids[0] < 0 or len(head) > 35):
        for k, x in enumerate(ids.tolist()):
            digest = hashlib.md5(head + str(x).encode()).digest()
            high[k], low[k] = int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:], "big")
        return high, low
    at, width = 0, 1
    while at < len(ids):
        end = int(np.searchsorted(ids, 10**width)) if width < 19 else len(ids)
        length = len(head) + width
        for lo in range(at, end, chunk):
            part = ids[lo : min(end, lo + chunk)]
            message = np.zeros(64, np.uint8)
            message[: len(head)] = np.frombuffer(head, np.uint8)
            message[length] = 0x80
            message[56:60] = np.frombuffer((8 * length).to_bytes(4, "little"), np.uint8)
            words: list = message.view("<u4").tolist()
            rest = part.copy()
            for k in range(length - 1, len(head) - 1, -1):
                digit = (rest % 10 + 48).astype(np.uint32) << np.uint32(8 * (k % 4))
                words[k // 4] = digit | np.uint32(words[k // 4]) if not isinstance(words[k // 4], np.ndarray) else words[k // 4] | digit
                rest //= 10
            a, b, c, d = (x.byteswap().astype(np.uint64) for x in _md5_block(words, len(part)))
            high[lo : lo + len(part)], low[lo : lo + len(part)] = (a << np.uint64(32)) | b, (c << np.uint64(32)) | d
        at, width = end, width + 1
    return high, low


class Draws:
    """Where each of the sorted ids takes its value from, replicate by replicate; groups (numbers from 0) don't mix."""

    def __init__(self, ids: np.ndarray, seed: int, group: np.ndarray | None = None):
        self.ids, self.seed = ids, seed
        self.group = group if group is None or len(group) and group.min() != group.max() else None
        self.place = None if self.group is None else np.argsort(self.group, kind="stable")

    def __call__(self, perm: int) -> np.ndarray:
        if perm == 0:
            return np.arange(len(self.ids))
        high, low = digests(f"{self.seed}:{perm}:", self.ids)
        order = np.argsort(high)
        if (high[order[1:]] == high[order[:-1]]).any():
            order = np.lexsort((low, high))  # stable, so equal digests keep the order of ids
        if self.place is None:
            return order
        source = np.empty(len(order), np.int64)
        source[self.place] = order[np.argsort(self.group[order], kind="stable")]
        return source


def found(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions in the sorted ids, -1 for those that aren't there."""
    if not len(ids):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return np.where(ids[at] == wanted, at, -1)


def ends(ids: np.ndarray, edges: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges between the sorted ids, ordered, as positions of their ends, and which edges these are."""
    i, j = (found(ids, edges[c].to_numpy()) for c in ("i", "j"))
    keep = np.flatnonzero((i >= 0) & (j >= 0))
    keep = keep[np.lexsort((j[keep], i[keep]))]
    return i[keep].astype(np.int32), j[keep].astype(np.int32), keep


def by_spot(rows: pa.Table) -> pa.Table:
    return rows.take(pa.array(np.argsort(rows["spot"].to_numpy(), kind="stable")))


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = pc.unique(table["sample"]).to_pylist()
            for name in names:
                part = (table if len(names) == 1 else table.filter(pc.equal(table["sample"], name))).drop_columns(["sample"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(part)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([kind]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["sample", "kind", "rows"])

    return rows.mapInArrow(pack, "sample string, kind string, rows binary")


def sizes(spots: DataFrame, edges: DataFrame, gap: str = "false") -> DataFrame:
    """(sample, n, held): spots and edges, and whether a task can hold them and no spot has the gap."""
    n = F.count(F.lit(1)).alias("n")
    both = spots.groupBy("sample").agg(n, F.max(F.expr(gap)).alias("gap")).unionByName(edges.groupBy("sample").agg(n, F.lit(False).alias("gap")))
    return both.groupBy("sample").agg(F.sum("n").alias("n"), ((F.sum("n") <= HELD) & ~F.coalesce(F.max("gap"), F.lit(False))).alias("held"))


def in_tasks(spots: DataFrame, edges: DataFrame, largest: int, permutations: int, schema: str, work: Callable[[pa.Table, pa.Table, range], dict[str, list]]) -> DataFrame:
    """work(spots, edges, replicates) of every sample and block of replicates 0..P; it returns the columns of the schema, without sample."""
    blocks = max(1, min(BLOCKS, permutations + 1, math.ceil(largest * permutations / LEAST_WORK)))
    schemas = [x.select(*x.columns[1:]).limit(0).toArrow().schema for x in (spots, edges)]

    def unpacked(rows: pa.Table, kind: str, empty: pa.Schema) -> pa.Table:
        parts = [pa.ipc.open_stream(x.as_buffer()).read_all().cast(empty) for k, x in zip(rows["kind"].to_pylist(), rows["rows"], strict=True) if k == kind]
        return pa.concat_tables([empty.empty_table(), *parts]).combine_chunks()

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        out = work(unpacked(rows, "spots", schemas[0]), unpacked(rows, "edges", schemas[1]), range(key[1].as_py(), permutations + 1, blocks))
        n = len(next(iter(out.values())))
        return pa.table({"sample": pa.array([key[0].as_py()] * n, pa.string())} | out)

    packed = _packed(spots, "spots").unionByName(_packed(edges, "edges"))
    return packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("sample", "block").applyInArrow(run, f"sample string, {schema}")
