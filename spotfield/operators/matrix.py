"""Matrix operators on long non-zero tables: zeros are restored only for selected genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.numbers import EPS, percentile


def count_like(expr: DataFrame) -> DataFrame:
    """A1: stored values with minimum >= 0 and maximum > 20 are counts; no values, no counts."""
    return expr.groupBy("sample").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value")).withColumn("count_like", (F.col("min_value") >= 0) & (F.col("max_value") > 20))


def dense(spots: DataFrame, expr: DataFrame, programs: DataFrame, clamp: bool = False) -> DataFrame:
    """(sample, spot, program, gene, e) for the requested genes that a sample has: zeros filled in and counts log1p'd."""
    wanted = programs.select("program", "gene")
    chosen = expr.join(programs.select("gene").distinct(), "gene", "left_semi")
    have = expr.join(wanted, "gene").select("sample", "program", "gene").distinct()
    grid = spots.select("sample", "spot").join(have, "sample")
    flag = count_like(expr).select("sample", "count_like")
    value = F.coalesce("value", F.lit(0.0))
    logged = F.log1p(F.greatest(value, F.lit(0.0)) if clamp else F.when(F.col("count_like"), value).otherwise(F.lit(0.0)))
    return grid.join(chosen, ["sample", "spot", "gene"], "left").join(flag, "sample").select("sample", "spot", "program", "gene", F.when(F.col("count_like"), logged).otherwise(value).alias("e"))


def gene_zscore(values: DataFrame) -> DataFrame:
    """A2: (e - mean) / population deviation over a sample's spots; deviation 0 counts as 1."""
    stats = values.groupBy("sample", "program", "gene").agg(F.avg("e").alias("mean"), F.coalesce(F.nullif(F.stddev_pop("e"), F.lit(0.0)), F.lit(1.0)).alias("sd"))
    return values.join(stats, ["sample", "program", "gene"]).withColumn("z", (F.col("e") - F.col("mean")) / F.col("sd"))


def program_scores(z: DataFrame, decimals: int = 9) -> DataFrame:
    """A3: c, s and r = c - s per spot, means of z over each program's genes, rounded so that thresholds agree across runs."""
    by = z.groupBy("sample", "spot").agg(F.avg(F.when(F.col("program") == "C", F.col("z"))).alias("c"), F.avg(F.when(F.col("program") == "S", F.col("z"))).alias("s"))
    return by.select("sample", "spot", F.round("c", decimals).alias("c"), F.round("s", decimals).alias("s"), F.round(F.col("c") - F.col("s"), decimals).alias("r"))


def normalize(fields: DataFrame, mode: str, columns: tuple[str, ...] = ("c", "s")) -> DataFrame:
    """A4: raw_mean, z_score or rank_quantile = (average rank - 0.5) / n, per sample. Means come from an aggregate; ranks from
    counts of equal values, summed up range by range, so that a large sample is no single task."""
    if mode == "z_score":
        stats = fields.groupBy("sample").agg(*(f(x).alias(f"__{n}_{x}") for x in columns for n, f in (("m", F.avg), ("sd", F.stddev_pop))))
        fields = fields.join(stats, "sample")
        for x in columns:
            fields = fields.withColumn(x, (F.col(x) - F.col(f"__m_{x}")) / F.coalesce(F.nullif(F.col(f"__sd_{x}"), F.lit(0.0)), F.lit(1.0)))
        return fields.drop(*stats.columns[1:])
    if mode == "rank_quantile":
        for x in columns:
            ranks = ranked(fields, x).withColumnRenamed(x, "__v")
            joined = fields.join(ranks.withColumnRenamed("sample", "__sample"), (F.col("sample") == F.col("__sample")) & F.col(x).eqNullSafe(F.col("__v")), "left")
            fields = joined.withColumn(x, (F.col("__rank") - 0.5) / F.col("__n")).drop("__sample", "__v", "__rank", "__n")
    return fields


def ranked(fields: DataFrame, column: str) -> DataFrame:
    """(sample, column, __rank, __n): the average rank of each different value and the number of values, per sample."""
    spark = fields.sparkSession
    times = fields.where(F.col(column).isNotNull()).groupBy("sample", column).agg(F.count(F.lit(1)).alias("__t"))
    dealt = durable(times.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "sample", column).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy("sample", "__part").agg(F.sum("__t").alias("__s"))  # a row for each sample and range
    before = parts.withColumn("__before", F.sum("__s").over(Window.partitionBy("sample").orderBy("__part")) - F.col("__s")).withColumn("__n", F.sum("__s").over(Window.partitionBy("sample")))
    inside = F.sum("__t").over(Window.partitionBy("sample", "__part").orderBy(column))
    return dealt.join(before, ["sample", "__part"]).select("sample", column, (F.col("__before") + inside - F.col("__t") + (F.col("__t") + 1) / 2).alias("__rank"), "__n")


def robust_unit(fields: DataFrame, column: str, name: str) -> DataFrame:
    """Clipped (v - q05) / (q95 - q05); 0.5 without spread."""
    q = fields.groupBy("sample").agg(percentile(column, 0.05).alias("lo"), percentile(column, 0.95).alias("hi"))
    unit = F.when(F.col("hi") - F.col("lo") > EPS * 100, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo"))))).otherwise(F.lit(0.5))
    return fields.join(q, "sample").withColumn(name, unit).drop("lo", "hi")


def gene_composition(spots: DataFrame, expr: DataFrame, programs: DataFrame) -> DataFrame:
    """Mean, median, detection and share within the program of each requested gene; missing genes stay with share 0."""
    stats = dense(spots, expr, programs, clamp=True).groupBy("sample", "program", "gene").agg(F.avg("e").alias("mean_expression"), percentile("e", 0.5).alias("median_expression"), F.avg((F.col("e") > 0).cast("double")).alias("detection_fraction"))
    rows = spots.select("sample").distinct().crossJoin(programs).join(stats, ["sample", "program", "gene"], "left")
    per = Window.partitionBy("sample", "program")
    weight = F.when(F.min("mean_expression").over(per) < 0, F.abs("mean_expression")).otherwise(F.col("mean_expression"))
    rows = rows.withColumn("w", weight)
    share = F.coalesce(F.try_divide(100 * F.col("w"), F.sum("w").over(per)), F.lit(0.0))
    return rows.select("sample", "program", "gene", "requested_order", F.when(F.col("w").isNull(), "missing").otherwise("present").alias("status"), "mean_expression", "median_expression", "detection_fraction", share.alias("relative_contribution_percent"))


def normalize_total_log1p(expr: DataFrame, target: float = 1e4) -> DataFrame:
    """log1p(v * target / spot total); spots without counts stay 0."""
    total = F.sum("value").over(Window.partitionBy("sample", "spot"))
    return expr.withColumn("value", F.log1p(F.when(total > 0, F.col("value") * target / total).otherwise(F.lit(0.0))))


def gene_qc(expr: DataFrame, min_spots: int = 10) -> DataFrame:
    """Genes expressed in at least ``min_spots`` spots."""
    return expr.where("value > 0").groupBy("sample", "gene").agg(F.countDistinct("spot").alias("n_spots")).where(F.col("n_spots") >= min_spots)


def adaptive_topk(spots: DataFrame, expr: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The k genes of highest variance, implicit zeros included; ties in candidate order."""
    n = spots.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    logged = expr.join(candidates, "gene").withColumn("e", F.log1p("value"))
    var = logged.groupBy("sample", "gene", "requested_order").agg(F.sum("e").alias("s1"), F.sum(F.col("e") * F.col("e")).alias("s2")).join(n, "sample").withColumn("variance", F.round(F.col("s2") / F.col("n") - F.pow(F.col("s1") / F.col("n"), 2), 9))
    by = Window.partitionBy("sample").orderBy(F.desc("variance"), "requested_order")
    return var.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("sample", "gene", "variance", "rank")
