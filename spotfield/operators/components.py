"""Connected components of an edge list by alternating large-star and small-star steps.

Only DataFrame operations: no list of nodes, links or components comes to the driver, and every round is
written to the shared checkpoint folder. The number of rounds grows with the logarithm of a component's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import durable


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (hi, lo) edges with lo < hi."""
    both = edges.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionByName(edges.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
    least = both.groupBy("x").agg(F.min(F.least("x", "y")).alias("m"))
    large = both.join(least, "x").where(F.col("y") > F.col("x")).select(F.col("y").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
    lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = large.join(lowest, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(lowest.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, a: str = "i", b: str = "j", max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest node reachable.

    Loops, repeated edges and edges with a null end are ignored; nodes without edges are the caller's to add.
    """
    now = durable(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    state = _state(now)
    for _ in range(max_rounds if state[0] else 0):
        now = durable(_stars(now))
        new = _state(now)
        if new == state:
            break
        state = new
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("lo").alias("node")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node that it reaches) that connect what the given ones do."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, name = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:  # hook the larger name onto the smaller one, then shorten all chains
        x, y = name[a], name[b]
        new = name.copy()
        np.minimum.at(new, np.maximum(x, y), np.minimum(x, y))
        while (new != new[new]).any():
            new = new[new]
        if (new == name).all():
            return nodes, nodes[name]
        name = new


def contracted(edges: DataFrame, most: int = 500_000) -> DataFrame:
    """Edges (sample, i, j) with the same components: a forest of every ``most`` edges or so, then, dealt by nodes to as many tasks as
    that asks for, forests of these. A task holds ``most`` edges at a time, whatever the size."""
    first = durable(_forests(edges, most))
    tasks = -(-first.count() // most)
    return _forests(first.repartitionByRange(tasks, "sample", "j") if tasks > 1 else first.coalesce(1), most)


def joined(found: DataFrame | None, links: DataFrame, most: int = 500_000) -> DataFrame:
    """(node, component), like ``connected_components``, of links (a, b) and those that ``found``, an earlier result, stands for.

    Up to ``most`` links meet in one task, which needs no rounds; more are contracted first. Both inputs are to be durable.
    """
    edges = links.select("a", "b")
    if found is not None:
        edges = edges.unionByName(found.where("node <> component").toDF("a", "b"))
    edges = edges.select(F.lit("").alias("sample"), F.col("a").alias("i"), F.col("b").alias("j"))
    tasks = -(-edges.count() // most)
    if tasks > 1:
        return durable(connected_components(contracted(edges.coalesce(tasks), most)))
    return durable(_forests(edges.coalesce(1), most, roots=True).select(F.col("i").alias("node"), F.col("j").alias("component")))


def _forests(edges: DataFrame, most: int, roots: bool = False) -> DataFrame:
    """Forests of ``most`` edges or so each; with ``roots`` these are listed, too, as their own."""

    def run(batches):
        held, size = {}, 0

        def made():
            for sample, parts in held.items():
                node, root = forest(*(np.concatenate(c) for c in zip(*parts, strict=True)))
                apart = (node != root) | roots
                yield pa.RecordBatch.from_arrays([pa.array([sample] * int(apart.sum()), pa.string()), pa.array(node[apart]), pa.array(root[apart])], ["sample", "i", "j"])

        for b in batches:
            names = b.column(0).dictionary_encode()
            codes, i, j = names.indices.to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
            for code, sample in enumerate(names.dictionary.to_pylist()):
                own = codes == code
                held.setdefault(sample, []).append((i[own], j[own]))
            size += b.num_rows
            if size >= most:
                yield from made()
                held, size = {}, 0
        yield from made()

    return edges.where("sample is not null and i is not null and j is not null and i <> j").select("sample", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).mapInArrow(run, "sample string, i long, j long")


def components_by_sample(edges: DataFrame) -> DataFrame:
    """(sample, spot, component) from edges (sample, i, j); components are named by their smallest spot.

    Tasks contract the edges that they read to forests, so few rounds of the star contraction are left, which runs over all
    samples at once.
    """
    node = lambda c: F.struct("sample", F.col(c).alias("spot"))
    found = connected_components(contracted(edges.select("sample", "i", "j")).select(node("i").alias("i"), node("j").alias("j")))
    return found.select("node.sample", "node.spot", F.col("component.spot").alias("component"))
