"""Approximate nearest neighbours by largest inner product: inverted lists and adaptive dimension scan.

Candidates get one more dimension that makes all equally long. A query has 0 there and is stretched to the same
length, which leaves the order of its inner products as it is; so the candidate nearest to it by distance has the
largest inner product. Both are rotated at random, once. Centroids are fitted on a bounded sample; every vector goes to
the list of its nearest centroid. Lists are dealt to blocks, large ones to several, by their sizes in the sample; a query
is sent once to every block that holds one of the ``probes`` lists whose centroids have the largest inner product
with it, whatever the number of those lists there.

A block takes its queries in chunks, and a chunk's queries list by list. Squared distances of all queries that probe a
list to its members grow over blocks of columns, as matrix products; after each, a candidate is abandoned for a query once
a hypothesis test on the partial distance says that it lies beyond the query's bound. The bound is the ``k``-th best
distance that the query has met so far in the block, over all lists; it begins with a few members of each list. When
few pairs are left, only these go on. Survivors are scored exactly, on the original vectors in double precision.

Equal vectors are searched once: of each different vector the ``k + 1`` smallest ids can be among anyone's
best ``k``, the others can't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, partitions, small_batches


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def lengthen(x: np.ndarray, longest: float) -> np.ndarray:
    """One more column, so that all rows have the squared length ``longest``."""
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))])


def as_query(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows (none zero) stretched to the squared length ``longest``, with 0 in the column that ``lengthen`` adds."""
    x = x / np.abs(x).max(1)[:, None]
    return np.column_stack([x * np.sqrt(longest / (x * x).sum(1))[:, None], np.zeros(len(x))])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None]


def centroids(sample: np.ndarray, n: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm; an empty list takes over the point farthest from its centroid."""
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        d = squared(sample, at)
        mine = d.argmin(1)
        order = np.argsort(mine, kind="stable")
        size = np.bincount(mine, minlength=n)
        full = np.flatnonzero(size)
        at = np.zeros_like(at)
        at[full] = np.add.reduceat(sample[order], (np.cumsum(size) - size)[full]) / size[full][:, None]
        far = np.argsort(-d[np.arange(len(sample)), mine], kind="stable")
        at[size == 0] = sample[far[: int((size == 0).sum())]]
    return at


def probed(q: np.ndarray, middle: np.ndarray, probes: int) -> np.ndarray:
    """For each rotated query the ``probes`` lists whose centroids have the largest inner product with it."""
    return np.argsort(-(q @ middle.T), 1, kind="stable")[:, :probes]


class Scan:
    """Finds, for queries, the nearest of a block's members; all rotated, as single precision."""

    def __init__(self, members: np.ndarray, lists: np.ndarray, k: int, columns: int, epsilon: float, dense: float = 0.1):
        order = np.argsort(lists, kind="stable")
        self.order, self.k, self.columns, self.epsilon, self.dense = order, k, columns, epsilon, dense
        self.x = members[order].astype(np.float32)
        self.names, self.first = np.unique(lists[order], return_index=True)
        self.ends = np.append(self.first[1:], len(order))
        dim = self.x.shape[1]
        self.cuts = [(a, min(a + columns, dim)) for a in range(0, dim, columns)]
        self.norms = [(self.x[:, a:b] ** 2).sum(1) for a, b in self.cuts]

    def _limit(self, bound: np.ndarray, upto: int) -> np.ndarray:
        dim = self.x.shape[1]
        share = 1.0 if upto == dim else upto / dim * (1 + self.epsilon / np.sqrt(upto)) ** 2
        return bound * np.float32(share * (1 + 1e-5)) + np.float32(1e-30)

    def _list(self, q: np.ndarray, norms: list[np.ndarray], bound: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, member, distance) of the pairs that no test abandons."""
        part, alive = np.zeros((len(q), hi - lo), np.float32), None
        for n, (a, b) in enumerate(self.cuts):
            limit = self._limit(bound, b)
            if alive is None:
                part += norms[n][:, None] + self.norms[n][None, lo:hi] - 2 * (q[:, a:b] @ self.x[lo:hi, a:b].T)
                ok = part <= limit[:, None]
                if b == self.x.shape[1] or np.count_nonzero(ok) < self.dense * ok.size:
                    alive = np.nonzero(ok)
                    part = part[alive]
            else:
                i, j = alive
                part = part + ((q[i, a:b] - self.x[lo + j, a:b]) ** 2).sum(1)
                ok = part <= limit[i]
                alive, part = (i[ok], j[ok]), part[ok]
        return alive[0], alive[1] + lo, part

    def _bound(self, distances: np.ndarray) -> np.ndarray:
        if distances.shape[1] < self.k:
            return np.full(len(distances), np.inf, np.float32)
        return np.partition(distances, self.k - 1, 1)[:, self.k - 1]

    def survivors(self, queries: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs among which are the ``k`` nearest that the tests let pass. ``probe``: lists of each query."""
        q = queries.astype(np.float32)
        norms = [(q[:, a:b] ** 2).sum(1) for a, b in self.cuts]
        asked = np.zeros((len(q), len(self.names)), bool)
        at = np.searchsorted(self.names, probe)
        there = self.names[np.minimum(at, len(self.names) - 1)] == probe
        asked[np.nonzero(there)[0], at[there]] = True
        few = np.unique(np.concatenate([np.linspace(lo, hi - 1, min(hi - lo, max(2, 256 // len(self.names))), dtype=np.int64) for lo, hi in zip(self.first, self.ends, strict=True)]))
        owner = np.searchsorted(self.first, few, side="right") - 1
        d = (q * q).sum(1)[:, None] - 2 * q @ self.x[few].T + (self.x[few] ** 2).sum(1)[None]
        best = np.where(asked[:, owner], np.maximum(d, 0), np.float32(np.inf))
        best = np.partition(best, self.k - 1, 1)[:, : self.k] if best.shape[1] > self.k else best
        bound, out = self._bound(best), []
        for number in np.argsort(-asked.sum(0), kind="stable"):
            mine = np.flatnonzero(asked[:, number])
            if not len(mine):
                continue
            lo, hi = int(self.first[number]), int(self.ends[number])
            i, j, d = self._list(q[mine], [x[mine] for x in norms], bound[mine], lo, hi)
            out.append((mine[i], j))
            if not len(i):
                continue
            # The few members of the start may count twice here, so they leave the list of the best before it is extended.
            count = np.bincount(i, minlength=len(mine))
            place = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            new = np.full((len(mine), int(count.max())), np.float32(np.inf))
            new[i, place] = np.where(np.isin(j, few), np.float32(np.inf), d)
            both = np.concatenate([best[mine], new], 1)
            best[mine] = np.partition(both, best.shape[1] - 1, 1)[:, : best.shape[1]] if both.shape[1] > best.shape[1] else both[:, : best.shape[1]]
            bound[mine] = np.minimum(bound[mine], self._bound(best[mine]))
        query, member = (np.concatenate([x[n] for x in out]) if out else np.zeros(0, np.int64) for n in (0, 1))
        return query, self.order[member]


def valid_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows with an id and a vector of doubles that isn't null, empty or zero and has finite components only, of the
    commonest dimension (of equally common ones the largest); other rows take no part."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = table.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (dims[0]["d"] if dims else 0))


def _doubles(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest(table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, sample_rows: int = 20_000, most_lists: int = 2048, probe_share: float = 0.85, block_rows: int = 65_536, query_rows: int = 2_048, columns: int = 16, epsilon: float = 2.1, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each row whose id is divisible by ``every``.

    A row's own id is no candidate for it; other rows with equal vectors are. Ties go to the smaller id. Repeated ids count
    once, with their first vector. With no valid vector the result is empty. Extra columns have no effect.
    """
    spark = table.sparkSession
    small_batches(spark)
    rows = durable(valid_vectors(table, key, vector).groupBy("id").agg(F.min("v").alias("v")).withColumn("same", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(seed), "v").alias("b"))))
    out = "query_id long, rank int, vec_id long, score double"
    classes = durable(rows.groupBy("same").agg(F.min_by("v", "id").alias("v"), F.min("id").alias("first"), F.max(F.col("id") % every == 0).alias("asks")))
    n, longest = classes.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).first()
    if not n:
        return spark.createDataFrame([], out)
    taken = classes.orderBy(F.xxhash64("same"), "same").limit(sample_rows).select("v").toPandas()["v"]
    sample = lengthen(np.array(taken.tolist()), longest)
    turn = rotation(sample.shape[1], seed)
    middle = centroids(sample @ turn, min(len(sample), most_lists, max(1, int(np.sqrt(n) / 3))), seed)
    probes = min(len(middle), max(4, int(np.ceil(probe_share * len(middle)))))

    # List -> its first block and number of blocks, from the shares of the sample; neighbouring lists fill a block together.
    size = np.bincount(squared(sample @ turn, middle).argmin(1), minlength=len(middle)) * (n / len(sample))
    room = min(block_rows, max(2_048, -(-n // partitions(spark))))
    several = np.maximum(np.ceil(size / room).astype(int), 1)
    start, block, filled = np.zeros(len(middle), int), 0, 0.0
    for i in range(len(middle)):
        if filled and filled + size[i] > 1.25 * room:
            block, filled = block + 1, 0.0
        start[i] = block
        block, filled = (block + int(several[i]), 0.0) if several[i] > 1 else (block, filled + size[i])
    holds = [np.arange(start[i], start[i] + several[i]) for i in range(len(middle))]
    schema = "block long, first long, asks boolean, list int, v array<double>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            first, asks, x = b.column(0), b.column(1).to_numpy(zero_copy_only=False).astype(bool), _doubles(b.column(2))
            own = squared(lengthen(x, longest) @ turn, middle).argmin(1)
            to = start[own] + first.to_numpy() % several[own]
            yield pa.RecordBatch.from_arrays([pa.array(to), first, pa.array(np.zeros(len(x), bool)), pa.array(own.astype(np.int32)), b.column(2)], ["block", "first", "asks", "list", "v"])
            which = np.flatnonzero(asks)
            if len(which):
                lists = probed(as_query(x[which], longest) @ turn, middle, probes)
                blocks = [np.unique(np.concatenate([holds[i] for i in row])) for row in lists]
                rows_at = pa.array(np.repeat(which, [len(r) for r in blocks]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks)), first.take(rows_at), pa.array(np.ones(len(rows_at), bool)), pa.array(np.full(len(rows_at), -1, np.int32)), b.column(2).take(rows_at)], ["block", "first", "asks", "list", "v"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, members first: they are held, queries pass by in chunks."""
        now, scanner, held, waiting, count = None, None, [], [], 0

        def answer() -> pa.RecordBatch:
            nonlocal scanner
            if scanner is None:
                first, lists, x = (np.concatenate(c) for c in zip(*held, strict=True))
                order = np.argsort(first, kind="stable")
                first, lists, x = first[order], lists[order], x[order]
                scanner = (first, x, Scan(lengthen(x, longest) @ turn, lists, k + 1, columns, epsilon))
            first, x, scanned = scanner
            name, y = (np.concatenate(c) for c in zip(*waiting, strict=True))
            rotated = as_query(y, longest) @ turn
            i, j = scanned.survivors(rotated, probed(rotated, middle, probes))
            score = np.concatenate([(x[j[a : a + 65_536]] * y[i[a : a + 65_536]]).sum(1) for a in range(0, len(i), 65_536)]) if len(i) else np.zeros(0)
            order = np.lexsort((first[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            begin = np.searchsorted(i, i)
            keep = np.arange(len(i)) - begin <= k
            return pa.RecordBatch.from_arrays([pa.array(name[i[keep]]), pa.array(first[j[keep]]), pa.array(score[keep])], ["query", "first", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            block, first, asks, lists = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x = _doubles(b.column(4))
            edges = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (asks[1:] != asks[:-1]), [True])))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if block[lo] != now:
                    if waiting:
                        yield answer()
                    now, scanner, held, waiting, count = block[lo], None, [], [], 0
                if not asks[lo]:
                    held.append((first[lo:hi], lists[lo:hi], x[lo:hi]))
                    continue
                if not held:
                    continue  # a block that got no member
                waiting.append((first[lo:hi], x[lo:hi]))
                count += hi - lo
                if count >= query_rows:
                    yield answer()
                    waiting, count = [], 0
        if waiting:
            yield answer()

    blocks = block + 1
    dealt = classes.select("first", "asks", "v").mapInArrow(deal, schema).repartition(min(blocks, 4 * partitions(spark)), "block").sortWithinPartitions("block", "asks")
    hits = dealt.mapInArrow(scan, "query long, first long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    top = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    by_id = Window.partitionBy("same").orderBy("id")
    members = rows.select("same", "id").withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).drop("r").join(classes.select("same", "first"), "same").select("first", "id")
    asking = rows.where(F.col("id") % every == 0).select("same", F.col("id").alias("query_id")).join(classes.where("asks").select("same", F.col("first").alias("query")), "same").select("query", "query_id")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = top.join(members, "first").select("query", F.col("id").alias("vec_id"), "score").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = asking.join(lists, "query").where("vec_id <> query_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
