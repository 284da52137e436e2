"""Group tests per gene and context fields."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.numbers import average_rank, percentile, safe_corr, with_bh


def hedges_g(value: str, group: str) -> Column:
    """A16 as an aggregate: difference of means over the pooled deviation, with the small-sample factor; NULL under two values a side;
    without variance 0 if the means agree, else NULL."""
    a, b = (F.when(F.col(group) == side, F.col(value)) for side in (True, False))
    na, nb = F.count(a), F.count(b)
    diff = F.avg(a) - F.avg(b)
    pooled = F.sqrt(F.try_divide((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b), F.nullif(na + nb - 2, F.lit(0))))
    g = F.try_divide(diff, F.nullif(pooled, F.lit(0.0))) * (1 - 3 / (4 * (na + nb) - 9))
    return F.when((na >= 2) & (nb >= 2), F.when(pooled > 0, g).when(F.abs(diff) < 1e-12, F.lit(0.0)))


def mannwhitney(values: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """U of the TRUE group, the tie term, z with continuity correction, and two-sided p.

    p is exact (counted by dynamic programming) when the smaller group has at most 8 values and there are no ties, else normal;
    NULL under two values a side. Ranks and U are plain windows; only one row per key reaches Python.
    """
    ok = values.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    tie = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    ranked = ok.withColumn("rk", average_rank(value, keys)).withColumn("t", tie)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col(group).cast("long")).alias("n1"), F.sum((~F.col(group)).cast("long")).alias("n2"), F.sum(F.when(F.col(group), F.col("rk"))).alias("r1"), F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    n = n1 + n2
    sd = F.sqrt(F.try_divide((n1 * n2).cast("double"), F.lit(12.0)) * (n + 1 - F.try_divide("ties", (n * (n - 1)).cast("double"))))
    z = F.try_divide(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.nullif(sd, F.lit(0.0)))
    rows = sums.withColumn("u", u).withColumn("z", z)

    @pandas_udf("double")
    def p_value(n1: pd.Series, n2: pd.Series, u: pd.Series, z: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([two_sided_p(*x) for x in zip(n1, n2, u, z, ties, strict=True)])

    return rows.withColumn("p", p_value("n1", "n2", "u", "z", "ties"))


def two_sided_p(n1: float, n2: float, u: float, z: float, ties: float) -> float | None:
    if not (n1 >= 2 and n2 >= 2) or u != u:
        return None
    n1, n2 = int(n1), int(n2)
    if min(n1, n2) > 8 or ties > 0:
        return None if z != z else min(1.0, math.erfc(z / math.sqrt(2)))
    n1, n2 = min(n1, n2), max(n1, n2)  # both tails count, so the groups may change places
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1  # ways[k, s]: k values of the first group exceed s values of the second in all
    for m in range(1, n1 + n2 + 1):
        for k in range(min(m, n1), 0, -1):
            shift = m - k
            if shift <= n2:
                ways[k, shift:] += ways[k - 1, : ways.shape[1] - shift] if shift else ways[k - 1]
    top = max(u, n1 * n2 - u)
    return float(min(1.0, 2 * ways[n1, int(math.ceil(top)) :].sum() / ways[n1].sum()))


def interface_enrichment(values: DataFrame, masked: DataFrame, mask: str = "interface") -> DataFrame:
    """Per gene, means inside and outside a mask, shifted fold with a pseudocount, Hedges g, Mann-Whitney p and its q."""
    rows = values.select("sample", "spot", "program", "gene", "e").join(masked.select("sample", "spot", F.col(mask).alias("inside")), ["sample", "spot"])
    keys = ["sample", "program", "gene"]
    shift = F.greatest(F.lit(0.0), -F.min("e"))
    stats = rows.groupBy(*keys).agg(F.sum(F.col("inside").cast("long")).alias("n_interface"), F.sum((~F.col("inside")).cast("long")).alias("n_noninterface"), F.avg(F.when(F.col("inside"), F.col("e"))).alias("mean_interface"), F.avg(F.when(~F.col("inside"), F.col("e"))).alias("mean_noninterface"), shift.alias("shift"), F.greatest(F.lit(1e-12), 1e-6 * F.expr("percentile(abs(e), 0.5)")).alias("pseudo"), hedges_g("e", "inside").alias("hedges_g"))
    fold = (F.col("mean_interface") + F.col("shift") + F.col("pseudo")) / (F.col("mean_noninterface") + F.col("shift") + F.col("pseudo"))
    stats = stats.withColumn("mean_difference", F.col("mean_interface") - F.col("mean_noninterface")).withColumn("fold_enrichment", fold).withColumn("log2_fold_enrichment", F.log2("fold_enrichment")).drop("shift", "pseudo")
    tests = mannwhitney(rows, keys, "e", "inside").select(*keys, F.col("u").alias("mannwhitney_u"), F.col("p").alias("mannwhitney_p"))
    return with_bh(stats.join(tests, keys, "left"), "mannwhitney_p", "mannwhitney_fdr_bh", ["sample"]).withColumn("significant_fdr_0_05", F.coalesce(F.col("mannwhitney_fdr_bh") < 0.05, F.lit(False)))


def context_scores(z: DataFrame, mode: str) -> DataFrame:
    """Mean over a program's genes of the value, its z-score or its rank quantile (rank - 1) / (n - 1)."""
    if mode == "rank_quantile":
        n = F.count(F.lit(1)).over(Window.partitionBy("sample", "program", "gene"))
        z = z.withColumn("v", F.coalesce(F.try_divide(average_rank("e", ["sample", "program", "gene"]) - 1, (n - 1).cast("double")), F.lit(0.0)))
    else:
        z = z.withColumn("v", F.col("z" if mode == "z_score_mean" else "e"))
    return z.groupBy("sample", "spot", "program").agg(F.round(F.avg("v"), 9).alias("score"))


def context_coverage(values: DataFrame, programs: DataFrame, min_fraction: float = 0.01) -> DataFrame:
    """Requested genes with detection; missing ones stay."""
    det = values.groupBy("sample", "program", "gene").agg(F.avg((F.col("e") > 0).cast("double")).alias("detection_fraction"))
    rows = values.select("sample").distinct().crossJoin(programs).join(det, ["sample", "program", "gene"], "left")
    return rows.select("sample", F.col("program").alias("field"), "gene", "requested_order", F.when(F.col("detection_fraction").isNull(), "missing").otherwise("present").alias("status"), "detection_fraction", F.coalesce(F.col("detection_fraction") >= min_fraction, F.lit(False)).alias("expressed"))


def leave_one_out(z: DataFrame) -> DataFrame:
    """For each gene, the score without it against the whole: correlation, mean |change|, change of variance, rank."""
    per = Window.partitionBy("sample", "spot", "program")
    n, total = F.count(F.lit(1)).over(per), F.sum("z").over(per)
    rows = z.withColumn("whole", total / n).withColumn("without", F.try_divide(total - F.col("z"), F.nullif(n - 1, F.lit(0)).cast("double")))
    out = rows.groupBy("sample", "program", "gene").agg(safe_corr("whole", "without").alias("loo_correlation"), F.avg(F.abs(F.col("whole") - F.col("without"))).alias("loo_mean_abs_change"), (F.var_pop("without") - F.var_pop("whole")).alias("loo_variance_change"))
    order = Window.partitionBy("sample", "program").orderBy(F.round("loo_mean_abs_change", 9).desc_nulls_last(), "gene")
    return out.withColumn("influence_rank", F.row_number().over(order))


def joint_state(scores: DataFrame, q: float = 0.8) -> DataFrame:
    """C4: high masks of two context fields H and V and their joint state."""
    wide = scores.groupBy("sample", "spot").agg(F.max(F.when(F.col("program") == "H", F.col("score"))).alias("h"), F.max(F.when(F.col("program") == "V", F.col("score"))).alias("v"))
    t = wide.groupBy("sample").agg(percentile("h", q).alias("th"), percentile("v", q).alias("tv"))
    h, v = F.col("h") >= F.col("th"), F.col("v") >= F.col("tv")
    state = F.when(h & v, "H_high_V_high").when(h, "H_high_V_low").when(v, "H_low_V_high").otherwise("H_low_V_low")
    return wide.join(t, "sample").select("sample", "spot", "h", "v", h.alias("h_high"), v.alias("v_high"), state.alias("joint_state"))
