"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its word n-grams. Sizes fall into bands; for the band from 2**j on, the domain
of n-grams is partitioned, by hash, into about 2**j parts, and a document's signatures are the subsets made
of one part each: a hash of what the document has there, for every part in which it has something. (Below
``SMALL`` n-grams every n-gram is a part of its own; N is then the size, and N - k is t * size.) Two sets that link differ in at most
k = (1 - t) / (1 + t) * (size + size) n-grams, which touch at most k parts, so a document with N filled parts
agrees with each partner in at least N - k signatures. A document that is up to 1/t times as large as its
band's lower end gives the signatures of the band below too, so partners always meet in one band.

Of that, only rare signatures need looking at: with signatures ordered by the number of documents that
have them, partners share one among the first k + 1 of each. Documents of which fewer than N - k signatures
occur elsewhere have no partner and leave. Signatures travel as packed arrays, dealt by signature, then by
document, then by signature again; equal sets count once all the way.

Links are found in steps, all verified on the texts. First every document meets the hubs of its commonest
signature groups, twice. Sets that a signature still joins to another component are then signed again with every
n-gram as a part of its own: then a link asks for t / (1 + t) * (size + size) equal signatures, and most of a family that
shares a passage or an original without linking leaves. The rest meet hubs once more, and at last all pairs
across components are compared that share a kept signature early enough: signatures have one order everywhere
(rare ones first), so from the first that two sets share on, each must have as many left as the link asks for.
So no group of copies is expanded into pairs and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import joined
from .common import durable, partitions, small_batches, to_bytes

SMALL = 64
#: Signatures that a task holds before it sends them off, and about how many a shard has.
FLUSH, SHARD = 500_000, 2_000_000
#: Sets of one signature that are compared in one task; more are cut into blocks.
BLOCK = 2048
_M = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class _Bytes:
    """Tables for hashing words: a random number for each byte (A-Z as a-z, none for white space) and powers of a multiplier."""

    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    value = mixed(np.arange(1, 257, dtype=np.uint64) * _M)
    value[65:91] = value[97:123]
    value[space] = 0
    power = np.cumprod(np.full(1024, _M))

    @classmethod
    def powers(cls, n: int) -> np.ndarray:
        if n <= 1024:
            return cls.power
        return np.cumprod(np.full(n, _M))


def _unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _shingled(raws: list[bytes], n: int) -> list[np.ndarray]:
    """The sets of some texts, all hashed at once: words from their bytes, sequences from their words."""
    buf = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    space = _Bytes.space[buf]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate(([0], edges))
    starts = edges[::2]
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return [none] * len(raws)
    gaps = np.diff(np.append(starts, len(buf)))
    at = np.arange(starts[0], len(buf)) - np.repeat(starts, gaps)
    h = mixed(np.add.reduceat(_Bytes.value[buf[starts[0] :]] * _Bytes.powers(int(gaps.max()))[at], starts - starts[0]))
    ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws]))

    def sequences(words: np.ndarray, size: int) -> np.ndarray:
        out = np.full(len(words) - size + 1, size, np.uint64)
        for i in range(size):
            out = out * _M + words[i : len(words) - size + 1 + i]
        return mixed(out)

    whole = sequences(h, n) if len(h) >= n else none
    lo, out = 0, []
    for hi in ends.tolist():
        out.append(none if hi == lo else _unique(whole[lo : hi - n + 1]) if hi - lo >= n else sequences(h[lo:hi], hi - lo))
        lo = hi
    return out


def shingle_sets(texts: list[str | None], n: int, most: int = 1 << 19) -> list[np.ndarray]:
    """Sorted hashes of the distinct ``n``-word sequences of each text; with fewer words the whole sequence is the only one; none
    without words. About ``most`` bytes are hashed at a time."""
    out, held, size = [], [], 0
    for t in texts:
        held.append(to_bytes(t))
        size += len(held[-1])
        if size >= most:
            out += _shingled(held, n)
            held, size = [], 0
    return out + _shingled(held, n) if held else out


def set_id(items: np.ndarray) -> int:
    """64 bits that equal sets share; 0 for the empty set."""
    return int(mixed(items + _M).sum(dtype=np.uint64).view(np.int64)) if len(items) else 0


def differing(a: int, b: int, percent: int) -> int:
    """The most n-grams in which sets of these sizes may differ when they link: |A n B| >= t/(1+t) * (a + b)."""
    return (a + b) * (100 - percent) // (100 + percent)


def differing_bound(meta: np.ndarray, percent: int) -> np.ndarray:
    """About k, from packed sizes; only the order of shares needs it."""
    return ((meta >> np.uint64(32)).astype(np.int64) * 2 * (100 - percent)) // (100 + percent)


def overlap_alone(meta: np.ndarray, percent: int) -> np.ndarray:
    """The N - k of sets of which every n-gram is a part, from packed sizes; only used where that is so."""
    return -(-(meta >> np.uint64(32)).astype(np.int64) * percent // 100)


def overlap(a: np.ndarray, b: int, percent: int) -> np.ndarray:
    """The fewest n-grams that sets of these sizes have in common when they link."""
    return -(-(a + b) * percent // (100 + percent))


def band_of(size: int) -> int:
    return 0 if size < SMALL else size.bit_length() - 1


def _filled(items: np.ndarray, bits: int) -> np.ndarray:
    """Starts of the parts that sorted hashes fill, parts being told by the leading ``bits``."""
    return _groups(items >> np.uint64(64 - bits))


def bands(size: int, percent: int) -> list[tuple[int, int]]:
    """(band, most n-grams by which a partner there differs) of the bands from 1 on in which a set of this size takes part."""
    own = band_of(size)
    out = [(own, differing(size, size * 100 // percent, percent))] if own else []
    if own > SMALL.bit_length() - 1 and 100 * ((1 << own) - 1) >= percent * size:
        out.append((own - 1, differing(size, (1 << own) - 1, percent)))
    return out


def fineness(items: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(band, bits that its parts need beyond 2**band) for this set to fill more parts than partners may differ in. With
    enough bits every n-gram is alone, and then size - k > 0."""
    out = []
    for band, differ in bands(len(items), percent):
        more = 0
        while len(_filled(items, band + more)) <= differ:
            more += 1
        out.append((band, more))
    return out


def signatures(items: np.ndarray, percent: int, finer: dict[int, int] | None) -> list[tuple[int, np.ndarray, int]]:
    """(band, signatures, N - k) for each band in which a set takes part; with ``finer`` None all n-grams are parts, in band 0."""
    s, out = len(items), []
    told = [] if finer is None else bands(s, percent)
    if not told or s * percent <= 100 * (SMALL - 1) and finer is not None:
        out.append((0, mixed(mixed(items) + _M), -(-s * percent // 100)))
    for band, differ in told:
        first = _filled(items, band + finer.get(band, 0))
        parts = mixed(np.add.reduceat(mixed(items), first) + (items[first] >> np.uint64(64 - band - finer.get(band, 0))))
        out.append((band, mixed(parts + np.uint64((band + 1) * int(_M) % (1 << 64))), len(first) - differ))
    return out


def _pack(kind: int, shard: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each shard, with the shard's part of every column as bytes."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    which, first = np.unique(shard, return_index=True)
    ends = [*first[1:], len(shard)]
    packed = [[c[order[a:b]].tobytes() for a, b in zip(first, ends, strict=True)] for c in columns]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(which), pa.int32()), pa.array(which.astype(np.int64)), *(pa.array(p, pa.binary()) for p in packed)], ["kind", "shard", *(f"c{i}" for i in range(len(columns)))])


def _pack_sets(many: int, sig: np.ndarray, entry: np.ndarray, sets: np.ndarray, meta: np.ndarray) -> pa.RecordBatch:
    """Like ``_pack``, but what belongs to a set is sent once a row with the number of its signatures there."""
    shard = (sig % np.uint64(many)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    shard, sig, entry = shard[order], (sig[order] >> np.uint64(32)).astype(np.uint32), entry[order]
    runs = _groups(shard, entry)
    length, which = np.diff(np.append(runs, len(shard))).astype("<u4"), shard[runs]
    first = _groups(which)
    ends = [*first[1:], len(which)]
    at = [*runs[first], len(shard)]
    sets, meta = sets[entry[runs]], meta[entry[runs]]
    packed = [[sig[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)], *([c[a:b].tobytes() for a, b in zip(first, ends, strict=True)] for c in (sets, meta, length))]
    return pa.RecordBatch.from_arrays([pa.array([0] * len(first), pa.int32()), pa.array(which[first]), *(pa.array(p, pa.binary()) for p in packed)], ["kind", "shard", "c0", "c1", "c2", "c3"])


def _by_shard(batches: Iterator[pa.RecordBatch], kinds: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Whole shards from rows sorted by shard."""
    now, parts = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[1] != now and parts:
                yield now, [np.concatenate(c) for c in zip(*parts, strict=True)]
                parts = []
            now = row[1]
            parts.append([np.frombuffer(x, k) for x, k in zip(row[2:], kinds, strict=True)])
    if parts:
        yield now, [np.concatenate(c) for c in zip(*parts, strict=True)]


def _schema(n: int) -> str:
    return "kind int, shard long, " + ", ".join(f"c{i} binary" for i in range(n))


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def row_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64 bits of a row's id and text; only equal rows share them."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def sized_sets(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, row, n_shingles, the set's id and what ``fineness`` its bands need, of every row."""

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist(), n)
            fine = [dict(fineness(s, percent)) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([list(f.items()) for f in fine], pa.map_(pa.int32(), pa.int32()))], ["doc_id", "row", "n_shingles", "set", "fine"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), row_of().alias("row")).mapInArrow(run, "doc_id long, row long, n_shingles long, set long, fine map<int,int>")


def _width(spark: SparkSession, shards: int) -> int:
    return min(shards, 4 * partitions(spark))


def _candidates(docs: DataFrame, n: int, percent: int, finer: dict[int, int] | None, shards: int) -> DataFrame:
    """Packed (signature, set, size and share of its signatures that others have, shared signatures left from this one on) that
    later steps have to look at. Two signatures of a set that coincide in what is kept of them lower its N - k by one."""
    spark = docs.sparkSession
    many = np.uint64(shards)

    def sign(batches):
        seen, held, size = set(), [], 0

        def flush():
            sig, sets, meta = zip(*held, strict=True)
            entry = np.repeat(np.arange(len(sig), dtype=np.uint32), [len(x) for x in sig])
            return _pack_sets(shards, np.concatenate(sig), entry, np.array(sets, np.int64), np.array(meta, np.uint64))

        for b in batches:
            for items in shingle_sets(b.column(0).to_pylist(), n):
                me = set_id(items)
                if not len(items) or me in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(me)
                for band, sig, need in signatures(items, percent, finer):
                    if len(_unique(sig >> np.uint64(32))) < len(sig):
                        need -= len(sig) - len(_unique((sig % many) << np.uint64(32) | sig >> np.uint64(32)))
                    meta = np.uint64(max(need, 0)) | np.uint64(band) << np.uint64(26) | np.uint64(len(items)) << np.uint64(32)
                    held.append((sig, me, meta))
                    size += len(sig)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def shared(batches):
        for shard, (sig, sets, meta, times) in _by_shard(batches, ["<u4", "<i8", "<u8", "<u4"]):
            sets, meta = np.repeat(sets, times), np.repeat(meta, times)
            order = np.lexsort((sets, sig))
            sig, sets, meta = sig[order], sets[order], meta[order]
            once = _groups(sig, sets)
            sig, sets, meta = sig[once], sets[once], meta[once]
            first = _groups(sig)
            count = np.diff(np.append(first, len(sig)))
            each = np.repeat(count, count)
            keep = each > 1
            if keep.any():
                key = np.uint64(shard) << np.uint64(32) | sig[keep].astype(np.uint64)
                yield _pack(0, sets[keep].view(np.uint64) % many, key, sets[keep], meta[keep], np.minimum(each[keep], 65535).astype("<u2"))

    def chosen(batches):
        for _, (key, sets, meta, count) in _by_shard(batches, ["<u8", "<i8", "<u8", "<u2"]):
            band = (meta >> np.uint64(26)) & np.uint64(63)
            order = np.lexsort((key, count, band, sets))
            key, sets, meta, band = key[order], sets[order], meta[order], band[order]
            first = _groups(sets, band)
            n_shared = np.diff(np.append(first, len(key)))
            need = (meta[first] & np.uint64((1 << 26) - 1)).astype(np.int64)
            place = np.arange(len(key)) - np.repeat(first, n_shared)
            keep = (place < np.repeat(n_shared - need + 1, n_shared)) & np.repeat(n_shared >= need, n_shared)
            if not keep.any():
                continue
            parts = need + differing_bound(meta[first], percent)
            rank = (n_shared * 65535 // np.maximum(parts, 1)).astype(np.uint64)
            packed = (meta >> np.uint64(32)) | np.repeat(rank, n_shared) << np.uint64(32)
            lost = np.maximum(overlap_alone(meta[first], percent) - need, 0)
            left = (np.repeat(n_shared + lost, n_shared) - place).astype(np.uint64)
            yield _pack(0, sets[keep].view(np.uint64) % many, key[keep], sets[keep], packed[keep], left[keep])

    width = _width(spark, shards)
    signed = docs.select("text").mapInArrow(sign, _schema(4)).repartition(width, "shard").sortWithinPartitions("shard")
    rare = signed.mapInArrow(shared, _schema(4)).repartition(width, "shard").sortWithinPartitions("shard")
    return durable(rare.mapInArrow(chosen, _schema(4)))


def _bucketed(candidates: DataFrame, components: DataFrame | None, shards: int) -> DataFrame:
    """The candidates dealt by signature, each set with its component (itself without links)."""
    many = np.uint64(shards)
    width = _width(candidates.sparkSession, shards)

    def pack_components(batches):
        for b in batches:
            if b.num_rows:
                node, component = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                yield _pack(-1, node.view(np.uint64) % many, component, node, *(np.zeros(len(node), np.uint64) for _ in range(2)))

    def label(batches):  # rows sorted by shard, then kind: the components come first
        now, nodes, names = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for kind, shard, x, sets, packed, left in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != now:
                    now, nodes, names = shard, np.zeros(0, np.int64), np.zeros(0, np.int64)
                sets = np.frombuffer(sets, "<i8")
                if kind == -1:
                    nodes, names = np.concatenate([nodes, sets]), np.concatenate([names, np.frombuffer(x, "<i8")])
                    order = np.argsort(nodes)
                    nodes, names = nodes[order], names[order]
                    continue
                name = sets
                if len(nodes):
                    at = np.minimum(np.searchsorted(nodes, sets), len(nodes) - 1)
                    name = np.where(nodes[at] == sets, names[at], sets)
                key = np.frombuffer(x, "<u8")
                yield _pack(0, key >> np.uint64(32), key, sets, np.frombuffer(packed, "<u8"), np.frombuffer(left, "<u8"), name)

    rows = candidates
    if components is not None:
        rows = rows.unionByName(components.select("node", "component").mapInArrow(pack_components, _schema(4))).repartition(width, "shard").sortWithinPartitions("shard", "kind")
    return rows.mapInArrow(label, _schema(5)).repartition(width, "shard").sortWithinPartitions("shard")


def _open_buckets(batches: Iterator[pa.RecordBatch]):
    """(sets, sizes, shares, signatures left, components, starts, ends) of each shard's signatures that join different components."""
    for _, (key, sets, packed, left, name) in _by_shard(batches, ["<u8", "<i8", "<u8", "<u8", "<i8"]):
        order = np.lexsort((sets, key))
        key, sets, packed, left, name = key[order], sets[order], packed[order], left[order], name[order]
        once = _groups(key, sets)
        key, sets, packed, left, name = key[once], sets[once], packed[once], left[once], name[once]
        first = _groups(key)
        ends = np.append(first[1:], len(key))
        apart = np.minimum.reduceat(name, first) != np.maximum.reduceat(name, first)
        size = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        yield sets, size, (packed >> np.uint64(32)).astype(np.int64), left.astype(np.int64), name, first[apart], ends[apart]


def _open_sets(candidates: DataFrame, components: DataFrame | None, shards: int) -> DataFrame:
    """The sets that some signature joins to another component."""

    def run(batches):
        for sets, *_, first, ends in _open_buckets(batches):
            if len(first):
                found = np.unique(np.concatenate([sets[lo:hi] for lo, hi in zip(first, ends, strict=True)]))
                yield pa.RecordBatch.from_arrays([pa.array(found)], ["set"])

    return _bucketed(candidates, components, shards).mapInArrow(run, "set long").distinct()


def _hubs(candidates: DataFrame, components: DataFrame | None, percent: int, shards: int, most: int = 2) -> DataFrame:
    """(a, b): for each set b in an open bucket the ``most`` commonest hubs a of its buckets, out of its component. A bucket's hub
    is the set of which the largest share of signatures occurs elsewhere, which an original has over its edited copies."""
    many = np.uint64(shards)

    def hubs(batches):
        for sets, size, share, _, name, first, ends in _open_buckets(batches):
            a, b = [], []
            for lo, hi in zip(first, ends, strict=True):
                hub = lo + int(np.argmax(share[lo:hi]))
                ok = (name[lo:hi] != name[hub]) & (100 * np.minimum(size[lo:hi], size[hub]) >= percent * np.maximum(size[lo:hi], size[hub]))
                b.append(sets[lo:hi][ok])
                a.append(np.full(int(ok.sum()), sets[hub]))
            if a and sum(map(len, a)):
                b = np.concatenate(b)
                yield _pack(0, b.view(np.uint64) % many, np.concatenate(a), b)

    def commonest(batches):
        for _, (a, b) in _by_shard(batches, ["<i8", "<i8"]):
            order = np.lexsort((a, b))
            a, b = a[order], b[order]
            first = _groups(b, a)
            times = np.diff(np.append(first, len(a)))
            a, b = a[first], b[first]
            order = np.lexsort((a, -times, b))
            a, b = a[order], b[order]
            first = _groups(b)
            keep = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b)))) < most
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    width = _width(candidates.sparkSession, shards)
    found = _bucketed(candidates, components, shards).mapInArrow(hubs, _schema(2)).repartition(width, "shard").sortWithinPartitions("shard")
    once = found.mapInArrow(commonest, "a long, b long").groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max("a").alias("a"))
    return once.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"))


def _across(candidates: DataFrame, components: DataFrame, percent: int, shards: int) -> DataFrame:
    """All pairs of sets in different components that could link by size and by the signatures left from one that they share;
    ``candidates`` have n-grams as parts.

    Of a shard's buckets with equal sets, the one with most signatures left comes first in the common order and stands for all.
    Sets of a bucket are ordered by size and cut into blocks; pairs of blocks whose sizes allow links are dealt to all tasks."""
    kinds = ["<i8", "<i8", "<i8", "<i8"]

    def blocks(batches):
        for sets, size, _, left, name, first, ends in _open_buckets(batches):
            seen = set()
            early = np.argsort(-left[first], kind="stable")
            for lo, hi in zip(first[early], ends[early], strict=True):
                if (same := sets[lo:hi].tobytes()) in seen:
                    continue
                seen.add(same)
                order = lo + np.argsort(size[lo:hi], kind="stable")
                cuts = [order[i : i + BLOCK] for i in range(0, len(order), BLOCK)]
                for i, x in enumerate(cuts):
                    for y in cuts[i:]:
                        if 100 * size[x[-1]] < percent * size[y[0]]:
                            break
                        both = x if y is x else np.concatenate([x, y])
                        cols = [c[both].astype("<i8").tobytes() for c in (sets, size, name, left)]
                        yield pa.RecordBatch.from_arrays([pa.array([0 if y is x else len(x)], pa.int32()), pa.array([int(sets[x[0]] ^ sets[y[0]])]), *(pa.array([c], pa.binary()) for c in cols)], ["kind", "shard", "c0", "c1", "c2", "c3"])

    def pairs(batches):
        for batch in batches:
            a, b = [], []
            for cut, _, *cols in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, z, c, rest = (np.frombuffer(x, k) for x, k in zip(cols, kinds, strict=True))
                for i in range(cut or len(s) - 1):
                    to = slice(cut or i + 1, None)
                    ok = (c[to] != c[i]) & (100 * np.minimum(z[to], z[i]) >= percent * np.maximum(z[to], z[i])) & (np.minimum(rest[to], rest[i]) >= overlap(z[to], z[i], percent))
                    x = s[to][ok]
                    a.append(np.minimum(x, s[i]))
                    b.append(np.maximum(x, s[i]))
                if sum(map(len, a[-4000:])) > 500_000:
                    yield from once(a, b)
                    a, b = [], []
            yield from once(a, b)

    def once(a, b):
        if a and sum(map(len, a)):
            a, b = np.concatenate(a), np.concatenate(b)
            order = np.lexsort((a, b))
            a, b = a[order], b[order]
            first = _groups(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], ["a", "b"])

    dealt = _bucketed(candidates, components, shards).mapInArrow(blocks, _schema(4)).repartition(_width(candidates.sparkSession, shards), "shard", "kind")
    return dealt.mapInArrow(pairs, "a long, b long").distinct()


def _texts(involved: DataFrame, docs: DataFrame, sets: DataFrame, few: int = 1_000_000) -> DataFrame:
    """(set, text) with one text of each set, fetched by row; only these texts move."""
    rows = sets.join(involved, "set").groupBy("set", "row").agg(F.count(F.lit(1)).alias("times"))
    ids = durable(rows.groupBy("set").agg(F.min("row").alias("row"), F.min_by("times", "row").alias("times")))
    total, most = ids.agg(F.count(F.lit(1)), F.max("times")).first()
    found = docs.join(F.broadcast(ids) if total <= few else ids, "row")
    if (most or 0) < 2:
        return found.select("set", "text")
    repeated = found.where("times > 1").groupBy("set").agg(F.min("text").alias("text"))
    return found.where("times = 1").select("set", "text").unionByName(repeated)


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, n: int, percent: int, few: int = 1_000_000, most: int = 2_000) -> DataFrame:
    """The pairs of sets that link, from one text of each. A text goes to the task of the set that it is held against; a set with
    more than ``most`` partners has several tasks."""
    tasks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("tasks"))
    dealt = pairs.join(tasks, "a").select(F.col("b").alias("set"), "a", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("task"), F.lit(True).alias("other"))
    own = tasks.select(F.col("a").alias("set"), "a", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(False).alias("other"))
    sends = durable(dealt.unionByName(own))
    texts = _texts(sends.select("set").distinct(), docs, sets)
    held = texts.join(F.broadcast(sends) if sends.count() <= few else sends, "set")

    def compare(batches):
        left, items = None, None
        for batch in batches:
            out, (names, others, sets, texts) = [], (c.to_pylist() for c in batch.columns)
            for a, other, b, mine in zip(names, others, sets, shingle_sets(texts, n), strict=True):
                if not other:
                    left, items = a, mine
                    continue
                common = len(np.intersect1d(items, mine, assume_unique=True))
                if a == left and 100 * common >= percent * (len(items) + len(mine) - common):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    dealt = held.repartition(partitions(pairs.sparkSession), "a", "task").sortWithinPartitions("a", "task", "other")
    return durable(dealt.select("a", "other", F.col("set").alias("b"), "text").mapInArrow(compare, "a long, b long"))


def components(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row; see ``labelled``."""
    return labelled(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def labelled(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, row (``row_of``), n_shingles, component (null without words) and component_id (smallest doc_id in it) of every row.

    Documents without words link with nothing and are their own component, as are all if the table holds
    no links. Equal sets link. Rows that repeat an id are judged each by its own text; rows without an
    id link like others, but name no component unless they are alone (null).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    sets = durable(sized_sets(rows, n, percent))
    finer = {r["band"]: r["more"] for r in sets.select(F.explode("fine").alias("band", "more")).groupBy("band").agg(F.max("more").alias("more")).collect()}  # 60 at most
    sets = sets.drop("fine")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    shards = max(partitions(spark), -(-total // SHARD))
    placed = rows.withColumn("row", row_of())
    where = sets.where("n_shingles > 0").select("set", "row")
    classes = sets.where("n_shingles > 0").groupBy("set").agg(F.min("doc_id").alias("first"))
    candidates = _candidates(rows, n, percent, finer, shards)
    found, tried = None, None
    for step, fine in ((_hubs, False), (_hubs, False), (_hubs, True), (_across, False)):
        if fine:
            candidates = _candidates(_texts(_open_sets(candidates, found, shards), placed, where), n, percent, None, shards)
        pairs = step(candidates, found, percent, shards).withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
        pairs = durable(pairs if tried is None else pairs.join(tried, ["lo", "hi"], "left_anti"))
        if pairs.isEmpty():
            continue
        tried = pairs.select("lo", "hi") if tried is None else tried.unionByName(pairs.select("lo", "hi"))
        found = joined(found, _verified(pairs, placed, where, n, percent))
    if found is None:
        found = spark.createDataFrame([], "node long, component long")
    member = classes.join(found, classes["set"] == found["node"], "left").select("set", "first", F.coalesce("component", "set").alias("component"))
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = member.join(least, "component").select("set", "component", "component_id")
    with_words = sets.where("n_shingles > 0").join(named, "set").select("doc_id", "row", "n_shingles", "component", "component_id")
    return with_words.unionByName(sets.where("n_shingles = 0").select("doc_id", "row", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id")))
