"""Spatial neighbour joins as equi-joins on grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.numbers import percentile

HEX = ((-1, -1), (-1, 1), (0, -2), (0, 2), (1, -1), (1, 1))


def _d2(a: str = "", b: str = "o") -> Column:
    dx, dy = F.col(f"{a}x") - F.col(f"{b}x"), F.col(f"{a}y") - F.col(f"{b}y")
    return F.round(dx * dx + dy * dy, 9)


def _probe(spots: DataFrame, others: DataFrame, size: Column, ring: int) -> DataFrame:
    """Pairs of a spot and another within ``ring`` cells, by an equi-join on the cell."""
    steps = F.sequence(F.lit(-ring), F.lit(ring))
    left = spots.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select("*", (F.floor(F.col("x") / size) + F.col("dx")).alias("cx"), (F.floor(F.col("y") / size) + F.col("dy")).alias("cy")).drop("dx", "dy")
    right = others.select("sample", F.col("spot").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    return left.join(right.hint("merge"), ["sample", "cx", "cy"]).where("other <> spot")  # files are small for the rows they hold, so Spark would broadcast them


def radius_graph(spots: DataFrame, radius: float) -> DataFrame:
    """Edges (sample, i < j, dist) with dist <= radius. A cell is as wide as the radius, so 3 x 3 cells hold all partners.
    A radius that isn't positive gives no edges."""
    at = spots.select("sample", "spot", "x", "y").where("x is not null and y is not null")
    if radius <= 0:
        at = at.limit(0)
        radius = 1.0
    pairs = _probe(at, at, F.lit(float(radius)), 1).where(F.col("other") > F.col("spot")).withColumn("d2", _d2())
    return pairs.where(F.col("d2") <= round(radius * radius, 9)).select("sample", F.col("spot").alias("i"), F.col("other").alias("j"), F.sqrt("d2").alias("dist"))


def cell_sizes(at: DataFrame, crowd: float = 16.0, sampled: int = 50_000, levels: int = 24) -> DataFrame:
    """(sample, n, w, cell): spots, extent, and the widest of the halved extents in whose cells a spot meets ``crowd`` others on average.
    The average is over spots, so a dense region isn't hidden by empty space around it. Some ``sampled`` spots a sample are
    counted; the cell bears on speed alone."""
    shape = at.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("w"), F.min("x").alias("x0"), F.min("y").alias("y0"))
    shape = durable(shape.withColumn("every", F.greatest(F.lit(1), F.floor(F.col("n") / sampled))))
    few = at.join(shape, "sample").where("pmod(xxhash64(spot), every) = 0 and w > 0").withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels)))).withColumn("size", F.col("w") / F.pow(F.lit(2.0), F.col("level")))
    counts = few.groupBy("sample", "level", F.floor((F.col("x") - F.col("x0")) / F.col("size")).alias("cx"), F.floor((F.col("y") - F.col("y0")) / F.col("size")).alias("cy")).agg(F.count(F.lit(1)).alias("c"), F.first("every").alias("every"), F.first("size").alias("size"))
    met = counts.groupBy("sample", "level").agg((F.sum(F.col("c") * F.col("c")) / F.sum("c") * F.first("every")).alias("met"), F.first("size").alias("size"))
    best = met.groupBy("sample").agg(F.coalesce(F.min_by("size", F.when(F.col("met") <= crowd, F.col("level"))), F.min("size")).alias("cell"))
    return durable(shape.join(best, "sample", "left").select("sample", "n", "w", F.coalesce("cell", F.lit(1.0)).alias("cell")))


def knn(spots: DataFrame, k: int, crowd: float = 16.0) -> DataFrame:
    """Each spot's k nearest others (sample, spot, other, d2, k), ties by spot; exact.

    A spot meets the others in 5 x 5 cells. Spots whose k-th distance may lie beyond are tried again with cells twice as wide,
    until the cells cover the sample; so a spot far out costs as many probes as any, and dense regions have narrow cells.
    """
    at = durable(spots.select("sample", "spot", "x", "y").where("x is not null and y is not null"))
    shape = cell_sizes(at, crowd)
    rounds = max(0, math.ceil(math.log2(max(1.0, shape.agg(F.max(F.col("w") / (2 * F.col("cell")))).first()[0] or 1.0))))
    placed = durable(at.join(shape, "sample"))
    todo, done, steps = placed, None, F.sequence(F.lit(-2), F.lit(2))
    by = Window.partitionBy("sample", "spot").orderBy("d2", "other")
    for turn in range(rounds + 1):
        wide = F.col("cell") * F.lit(float(2**turn))
        place = lambda c: F.floor(F.col(c) / wide)
        probe = todo.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select("*", (place("x") + F.col("dx")).alias("cx"), (place("y") + F.col("dy")).alias("cy"))
        right = placed.select("sample", F.col("spot").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), place("x").alias("cx"), place("y").alias("cy"))
        near = probe.join(right, ["sample", "cx", "cy"]).where("other <> spot").withColumn("d2", _d2()).withColumn("k", F.row_number().over(by)).where(F.col("k") <= k)
        known = durable(near.select("sample", "spot", "other", "d2", "k", "n", "w", wide.alias("wide")))
        sure = known.groupBy("sample", "spot").agg(F.max("d2").alias("far"), F.max("k").alias("found"), F.first("n").alias("n"), F.first("w").alias("w"), F.first("wide").alias("wide"))
        sure = sure.where((2 * F.col("wide") >= F.col("w")) | (F.col("found") >= F.least(F.lit(k), F.col("n") - 1)) & (F.sqrt("far") < 2 * F.col("wide"))).select("sample", "spot")
        part = known.join(sure, ["sample", "spot"], "left_semi").select("sample", "spot", "other", "d2", "k")
        done = part if done is None else done.unionByName(part)
        if turn < rounds:
            todo = durable(todo.join(sure, ["sample", "spot"], "left_anti"))
            if todo.isEmpty():
                break
    return done


def knn_graph(spots: DataFrame, k: int, mutual: bool = False) -> DataFrame:
    """Undirected edges i < j where either spot (or, mutual, both) has the other among its k nearest."""
    pairs = knn(spots, k).groupBy("sample", F.least("spot", "other").alias("i"), F.greatest("spot", "other").alias("j")).agg(F.sqrt(F.min("d2")).alias("dist"), F.count(F.lit(1)).alias("n"))
    return (pairs.where("n = 2") if mutual else pairs).drop("n")


def ring_offsets(ring: int) -> list[tuple[int, int]]:
    """Offsets at up to ``ring`` steps on the hexagonal lattice, without the origin."""
    reached, edge = {(0, 0)}, {(0, 0)}
    for _ in range(ring):
        edge = {(r + a, c + b) for r, c in edge for a, b in HEX} - reached
        reached |= edge
    return sorted(reached - {(0, 0)})


def lattice_graph(spots: DataFrame, ring: int = 1) -> DataFrame:
    """Edges between lattice places at most ``ring`` steps apart; the last spot of a repeated place counts."""
    # Each pair of places is met once, from the side whose offset is the positive one.
    last = spots.where("array_row is not null and array_col is not null").groupBy("sample", "array_row", "array_col").agg(F.max("spot").alias("spot"))
    steps = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ring_offsets(ring) if (r, c) > (0, 0))))
    moved = last.select("sample", F.col("spot").alias("i"), "array_row", "array_col", steps.alias("o")).select("sample", "i", (F.col("array_row") + F.col("o.r")).alias("array_row"), (F.col("array_col") + F.col("o.c")).alias("array_col"))
    met = moved.join(last.withColumnRenamed("spot", "j").hint("merge"), ["sample", "array_row", "array_col"])  # files are small for the rows they hold, so Spark would broadcast them
    return met.select("sample", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))


def symmetric(edges: DataFrame, *columns: str) -> DataFrame:
    """Both orientations (spot, other) of undirected edges."""
    return edges.select("sample", F.col("i").alias("spot"), F.col("j").alias("other"), *columns).unionByName(edges.select("sample", F.col("j").alias("spot"), F.col("i").alias("other"), *columns))


def edge_weights(edges: DataFrame, kind: str, sigma: float | None = None) -> DataFrame:
    """Binary; inverse_distance, without zero distances; gaussian with sigma or the median positive distance."""
    if kind == "binary":
        return edges.withColumn("weight", F.lit(1.0))
    if kind == "inverse_distance":
        return edges.where("dist > 0").withColumn("weight", 1 / F.col("dist"))
    scale = edges.groupBy("sample").agg(F.lit(sigma).cast("double").alias("sigma") if sigma else F.expr("percentile(if(dist > 0, dist, null), 0.5)").alias("sigma"))
    return edges.join(scale, "sample").withColumn("weight", F.exp(-0.5 * F.pow(F.col("dist") / F.col("sigma"), 2))).drop("sigma")


def nn_spacing(spots: DataFrame, multiplier: float = 1.25) -> DataFrame:
    """Nearest-neighbour distances: min, median, q95, and the automatic radius from the positive ones."""
    d = knn(spots, 1).withColumn("d", F.sqrt("d2"))
    return d.groupBy("sample").agg(F.min("d").alias("nn_min"), percentile("d", 0.5).alias("nn_median"), percentile("d", 0.95).alias("nn_q95"), (F.expr("percentile(if(d > 0, d, null), 0.5)") * multiplier).alias("auto_radius"))


def mean_smooth(values: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """Mean over a spot and its neighbours, missing values left out."""
    own = values.select("sample", "spot", F.col("spot").alias("other")).unionByName(symmetric(edges))
    return own.join(values.select("sample", F.col("spot").alias("other"), F.col(column).alias("v")), ["sample", "other"]).groupBy("sample", "spot").agg(F.avg("v").alias(column))


def graph_smooth(values: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """(W + I) v over its row sums."""
    v = values.select("sample", F.col("spot").alias("other"), F.col(column).alias("v"))
    around = symmetric(edges, "weight").join(v, ["sample", "other"]).groupBy("sample", "spot").agg(F.sum(F.col("weight") * F.col("v")).alias("wv"), F.sum("weight").alias("w"))
    mean = (F.col(column) + F.coalesce("wv", F.lit(0.0))) / (1 + F.coalesce("w", F.lit(0.0)))
    return values.join(around, ["sample", "spot"], "left").select("sample", "spot", mean.alias(column))


def gaussian_smooth(values: DataFrame, spots: DataFrame, column: str, sigma: float) -> DataFrame:
    """Weights exp(-d² / 2 sigma²) within 3 sigma, itself included."""
    weighted = radius_graph(spots, 3 * sigma).withColumn("weight", F.exp(-F.col("dist") * F.col("dist") / (2 * sigma * sigma)))
    return graph_smooth(values, weighted, column)
