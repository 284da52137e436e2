"""The lattice engine: preprocessing, masked smoothing, gradient, interface, distance and decay.

Cells are (sample, row, col) with their means; only cells with tissue are rows, so the grid is never made dense.
Neighbouring cells meet by equi-joins on their place. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percentile, safe_corr

EPS = 1e-9
CELL = ["sample", "row", "col"]


def preprocess(spots: DataFrame, expr: DataFrame, min_genes: int = 200, gene_min_spots: int = 10, target: float = 1e4) -> tuple[DataFrame, DataFrame]:
    """(kept spots, log1p values scaled to one total a spot). Spots in tissue with more than ``min_genes`` genes stay, then genes in at least ``gene_min_spots`` of them."""
    positive = expr.where("value > 0").join(spots.where("in_tissue = 1").select("sample", "spot"), ["sample", "spot"], "left_semi")
    rich = positive.groupBy("sample", "spot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_genes).select("sample", "spot")
    inside = positive.join(rich, ["sample", "spot"], "left_semi")
    common = inside.groupBy("sample", "gene").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= gene_min_spots).select("sample", "gene")
    inside = inside.join(common, ["sample", "gene"], "left_semi")
    total = inside.groupBy("sample", "spot").agg(F.sum("value").alias("total"))
    scaled = inside.join(total, ["sample", "spot"]).select("sample", "spot", "gene", F.log1p(F.col("value") * target / F.col("total")).alias("value"))
    return spots.join(rich, ["sample", "spot"], "left_semi"), scaled


def program_means(spots: DataFrame, expr: DataFrame, programs: DataFrame) -> DataFrame:
    """Mean value of each program's genes that the sample has; 0 where it has none. Columns c and b."""
    listed = expr.join(F.broadcast(programs.select("program", "gene")), "gene")
    present = listed.groupBy("sample", "program").agg(F.countDistinct("gene").alias("n"))
    sums = listed.groupBy("sample", "spot", "program").agg(F.sum("value").alias("v")).join(present, ["sample", "program"])
    one = lambda p: F.coalesce(F.max(F.when(F.col("program") == p, F.col("v") / F.col("n"))), F.lit(0.0))
    means = sums.groupBy("sample", "spot").agg(one("C").alias("c"), one("S").alias("b"))
    return spots.select("sample", "spot", "array_row", "array_col").join(means, ["sample", "spot"], "left").fillna(0.0, ["c", "b"])


def qscaled(rows: DataFrame, columns: tuple[str, ...] = ("c", "b"), low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Values between two quantiles of the sample onto 0 to 1, clipped; all 0 without spread."""
    t = rows.groupBy("sample").agg(*(percentile(x, q).alias(f"{x}_{k}") for x in columns for k, q in (("lo", low), ("hi", high))))

    def scaled(x: str) -> Column:
        lo, hi = F.col(f"{x}_lo"), F.col(f"{x}_hi")
        return F.when(hi - lo < EPS, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(x) - lo) / (hi - lo + EPS))))

    return rows.join(F.broadcast(t), "sample").withColumns({x: scaled(x) for x in columns}).drop(*(f"{x}_{k}" for x in columns for k in ("lo", "hi")))


def lattice(rows: DataFrame) -> DataFrame:
    """Cells from 0 with the mean of their spots, and the lattice's height and width."""
    box = rows.groupBy("sample").agg(F.min("array_row").alias("r0"), F.min("array_col").alias("c0"), (F.max("array_row") - F.min("array_row") + 1).alias("height"), (F.max("array_col") - F.min("array_col") + 1).alias("width"))
    place = rows.join(F.broadcast(box), "sample").withColumns({"row": F.col("array_row") - F.col("r0"), "col": F.col("array_col") - F.col("c0")})
    return place.groupBy(*CELL, "height", "width").agg(F.avg("c").alias("c"), F.avg("b").alias("b"))


def _mirrored(i: Column, size: Column) -> Column:
    """An index beyond the edge, reflected with the edge's cell repeated."""
    m = F.pmod(i, 2 * size)
    return F.when(m < size, m).otherwise(2 * size - 1 - m)


def smooth(cells: DataFrame, sigma: float = 0.8, decimals: int = 9) -> DataFrame:
    """L3: Gaussian means over cells with tissue, out to 4 sigma, mirrored at the edges of the lattice."""
    radius = int(4 * sigma + 0.5)
    steps = range(-radius, radius + 1)
    kernel = F.array(*(F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj"), F.lit(math.exp(-(i * i + j * j) / (2 * sigma * sigma))).alias("w")) for i in steps for j in steps))
    reach = cells.select(*CELL, "height", "width", F.explode(kernel).alias("k")).select("sample", "height", "width", F.col("row").alias("to_row"), F.col("col").alias("to_col"), _mirrored(F.col("row") + F.col("k.di"), F.col("height")).alias("row"), _mirrored(F.col("col") + F.col("k.dj"), F.col("width")).alias("col"), F.col("k.w").alias("w"))
    mean = lambda x: F.round(F.sum(F.col("w") * F.col(x)) / F.sum("w"), decimals).alias(x)
    return reach.join(cells.select(*CELL, "c", "b"), CELL).groupBy("sample", F.col("to_row").alias("row"), F.col("to_col").alias("col"), "height", "width").agg(mean("c"), mean("b"))


def gradient(cells: DataFrame, decimals: int = 9) -> DataFrame:
    """L4: g = |grad c| |grad b|; central differences, one-sided at the edges, 0 outside tissue (and along an axis of one cell)."""
    row, col = F.col("row"), F.col("col")
    down, up = F.least(row + 1, F.col("height") - 1), F.greatest(row - 1, F.lit(0))
    right, left = F.least(col + 1, F.col("width") - 1), F.greatest(col - 1, F.lit(0))
    side = lambda axis, sign, r, c, span: F.struct(F.lit(axis).alias("axis"), r.alias("row"), c.alias("col"), (F.lit(float(sign)) / span).alias("w"))
    sides = F.array(side("y", 1, down, col, F.nullif(down - up, F.lit(0))), side("y", -1, up, col, F.nullif(down - up, F.lit(0))), side("x", 1, row, right, F.nullif(right - left, F.lit(0))), side("x", -1, row, left, F.nullif(right - left, F.lit(0))))
    near = cells.select("sample", row.alias("to_row"), col.alias("to_col"), F.explode(sides).alias("s")).select("sample", "to_row", "to_col", "s.axis", "s.row", "s.col", "s.w")
    part = lambda x, axis: F.coalesce(F.sum(F.when(F.col("axis") == axis, F.col("w") * F.col(x))), F.lit(0.0))
    slope = near.join(cells.select(*CELL, "c", "b"), CELL).groupBy("sample", F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(*(F.sqrt(part(x, "y") ** 2 + part(x, "x") ** 2).alias(f"d{x}") for x in "cb"))
    g = F.round(F.coalesce(F.col("dc") * F.col("db"), F.lit(0.0)), decimals)
    return cells.join(slope, CELL, "left").withColumn("g", g).drop("dc", "db")


def thresholds(cells: DataFrame, cq: float = 0.8, bq: float = 0.8, gq: float = 0.6) -> DataFrame:
    return cells.groupBy("sample").agg(percentile("c", cq).alias("c_threshold"), percentile("b", bq).alias("b_threshold"), percentile("g", gq).alias("g_threshold"))


def interface(cells: DataFrame, **quantiles: float) -> DataFrame:
    """Cells strictly above the three quantiles over tissue."""
    inside = (F.col("c") > F.col("c_threshold")) & (F.col("b") > F.col("b_threshold")) & (F.col("g") > F.col("g_threshold"))
    return cells.join(F.broadcast(thresholds(cells, **quantiles)), "sample").withColumn("interface", inside)


def _lowest(at: list[int], squared: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the parabolas squared + (x - at)**2, ``at`` ascending: the indices of those that are least for some whole x, and from which x on each is."""
    kept, since = [], []
    for i, (q, high) in enumerate(zip(at, squared, strict=True)):
        start = np.iinfo(np.int64).min
        while kept:
            p = at[kept[-1]]
            start = (q * q - p * p + high - squared[kept[-1]]) // (2 * (q - p)) + 1
            if start > since[-1]:
                break
            kept.pop()
            since.pop()
            start = np.iinfo(np.int64).min
        kept.append(i)
        since.append(start)
    return np.array(kept, np.int64), np.array(since, np.int64)


def _nearest_in_row(cells: pd.DataFrame, sites: pd.DataFrame) -> pd.DataFrame:
    if cells.empty or sites.empty:
        return cells.assign(distance=0.0).head(0)
    sites = sites.sort_values("at")
    at, squared = sites["at"].to_numpy(np.int64), sites["d"].to_numpy(np.int64) ** 2
    kept, since = _lowest(at.tolist(), squared.tolist())
    col = cells["col"].to_numpy(np.int64)
    least = kept[np.searchsorted(since, col, side="right") - 1]
    return cells.assign(distance=np.sqrt((squared[least] + (col - at[least]) ** 2).astype(float)))


def distance(cells: DataFrame) -> DataFrame:
    """Euclidean distance of every cell to the nearest interface cell; null in samples without one.

    As a separable transform, with work in proportion to the lattice: in each column the rows between two interface rows have one
    of these as their nearest; in each row the lower envelope of the columns' parabolas, in whole numbers, tells the nearest.
    A task holds one row of a lattice at a time.
    """
    by_col = cells.where("interface").groupBy("sample", F.col("col").alias("at"), "height").agg(F.sort_array(F.collect_set("row")).alias("rows"))
    none = F.array(F.lit(None).cast("int"))
    gaps = by_col.withColumn("gap", F.explode(F.arrays_zip(F.concat(none, F.col("rows")).alias("above"), F.concat(F.col("rows"), none).alias("below")))).select("sample", "at", "height", "gap.above", "gap.below")
    first, last = F.coalesce("above", F.lit(0)), F.coalesce(F.col("below") - 1, F.col("height") - 1)
    column = gaps.where(first <= last).withColumn("row", F.explode(F.sequence(first, last))).select("sample", "at", "row", F.least(F.col("row") - F.col("above"), F.col("below") - F.col("row")).alias("d"))
    near = cells.select(*CELL).groupBy("sample", "row").cogroup(column.groupBy("sample", "row")).applyInPandas(_nearest_in_row, cells.select(*CELL, F.lit(0.0).alias("distance")).schema)
    return cells.join(near, CELL, "left")


def transition(cells: DataFrame, radius: float = 3.0) -> DataFrame:
    """Cells up to ``radius`` from the interface, itself included."""
    return cells.withColumn("transition", F.coalesce(F.col("distance") <= radius, F.lit(False)))


def at_spots(cells: DataFrame, spots: DataFrame) -> DataFrame:
    """The cells' fields at every spot, with r = c - b."""
    box = spots.groupBy("sample").agg(F.min("array_row").alias("r0"), F.min("array_col").alias("c0"))
    place = spots.select("sample", "spot", "array_row", "array_col").join(F.broadcast(box), "sample").select("sample", "spot", (F.col("array_row") - F.col("r0")).alias("row"), (F.col("array_col") - F.col("c0")).alias("col"))
    return place.join(cells, CELL).withColumn("r", F.col("c") - F.col("b"))


def decay_fit(rows: DataFrame, min_points: int = 30) -> DataFrame:
    """Least squares of ln(|r| + eps) on distance, over distances above 0, or from 0 on where those are fewer than ``min_points``; null if these are, too."""
    x, y, out = F.col("distance"), F.log(F.abs("r") + EPS), []
    for name, ok in (("far", x > 0), ("all", x >= 0)):
        a, b = F.when(ok, x), F.when(ok, y)
        fits = (F.count(a) >= min_points) & (F.stddev_pop(a) >= EPS) & (F.stddev_pop(b) >= EPS)
        out += [F.count(a).alias(f"{name}_n"), F.when(fits, F.regr_slope(b, a)).alias(f"{name}_slope"), F.when(fits, F.regr_intercept(b, a)).alias(f"{name}_intercept"), F.when(fits, F.corr(a, b)).alias(f"{name}_r")]
    pick = lambda what: F.when(F.col("far_n") >= min_points, F.col(f"far_{what}")).otherwise(F.col(f"all_{what}"))
    fit = rows.groupBy("sample").agg(*out).select("sample", pick("slope").alias("alpha_fit_slope"), pick("intercept").alias("alpha_fit_intercept"), pick("r").alias("alpha_fit_r"))
    alpha = F.when(F.col("alpha_fit_slope").isNotNull(), F.greatest(-F.col("alpha_fit_slope"), F.lit(EPS)))
    return fit.withColumn("alpha", alpha).withColumn("lambda", 1 / F.col("alpha"))


def integrals(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Sums of r weighted by exp(-alpha distance): all, below 0, above 0; null without a fit."""
    v = F.col("r") * F.exp(-F.col("alpha") * F.col("distance"))
    none = F.when(F.count(v) > 0, 0.0)
    return rows.join(F.broadcast(fit.select("sample", "alpha")), "sample").groupBy("sample").agg(F.sum(v).alias("I_total"), F.coalesce(F.sum(F.when(F.col("r") < 0, v)), none).alias("I_bal"), F.coalesce(F.sum(F.when(F.col("r") > 0, v)), none).alias("I_str"))


def delta_interface(rows: DataFrame) -> DataFrame:
    """Median b less median c, inside less outside the interface; null if either side is empty."""
    mid = lambda x, inside: percentile(f"CASE WHEN {'' if inside else 'NOT '}interface THEN {x} END", 0.5)
    return rows.groupBy("sample").agg(((mid("b", True) - mid("c", True)) - (mid("b", False) - mid("c", False))).alias("delta_interface"))


def metrics(rows: DataFrame, expr: DataFrame) -> DataFrame:
    """One row a sample."""
    fit = decay_fit(rows)
    base = rows.groupBy("sample").agg(F.count(F.lit(1)).alias("n_spots"), F.max("interface").alias("interface_detected"), F.avg(F.col("interface").cast("double")).alias("interface_fraction"), safe_corr("c", "b").alias("C_B_correlation"), *(F.max(f"{x}_threshold").alias(f"{x}_threshold") for x in "cbg"))
    genes = expr.groupBy("sample").agg(F.countDistinct("gene").alias("n_genes"))
    for more in (genes, fit, integrals(rows, fit), delta_interface(rows)):
        base = base.join(more, "sample", "left")
    return base.withColumn("qc_status", F.when(F.col("interface_detected"), "ok").otherwise("no_interface"))
