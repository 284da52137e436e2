"""The balance-field mapper: gradient, masks, adjacency, components, regime and its robustness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import EPS, percentile
from .components import components_by_sample
from .neighbors import symmetric


def gradient(fields: DataFrame, edges: DataFrame, decimals: int = 9) -> DataFrame:
    """g = mean |r_i - r_j| over neighbours; 0 for isolated spots. The mean is taken of whole units of the last decimal and
    rounded half up in whole numbers, so ties fall alike everywhere."""
    unit = 10**decimals
    r = fields.select("sample", "spot", F.round(F.col("r") * unit).cast("long").alias("u"))
    pair = symmetric(edges).join(r, ["sample", "spot"]).join(r.toDF("sample", "other", "uo"), ["sample", "other"])
    g = pair.groupBy("sample", "spot").agg(F.sum(F.abs(F.col("u") - F.col("uo"))).alias("total"), F.count("uo").alias("n"))
    g = g.select("sample", "spot", (F.expr("(2 * total + n) div (2 * n)") / F.lit(float(unit))).alias("g"))
    return fields.join(g, ["sample", "spot"], "left").fillna(0.0, ["g"])


def high_mask(fields: DataFrame, column: str, q: float, name: str) -> DataFrame:
    """V >= quantile, inclusive; nothing is high without two values and spread."""
    t = fields.groupBy("sample").agg(percentile(column, q).alias("t"), (F.max(column) - F.min(column)).alias("range"), F.count(column).alias("n"))
    high = F.coalesce((F.col("n") >= 2) & (F.col("range") > EPS * 100) & (F.col(column) >= F.col("t")), F.lit(False))
    return fields.join(t, "sample").withColumn(name, high).drop("t", "range", "n")


def masks(fields: DataFrame, cq: float = 0.8, sq: float = 0.8, gq: float = 0.6) -> DataFrame:
    """interface = high in all three; diffuse = high g and c or s, outside the interface."""
    for column, q in (("c", cq), ("s", sq), ("g", gq)):
        fields = high_mask(fields, column, q, f"high_{column}")
    inside = F.col("high_c") & F.col("high_s") & F.col("high_g")
    return fields.withColumn("interface", inside).withColumn("diffuse", F.col("high_g") & (F.col("high_c") | F.col("high_s")) & ~inside)


def mask_components(masked: DataFrame, edges: DataFrame, mask: str) -> DataFrame:
    """(sample, component, size) of the sub-graph that a mask keeps; components are named by their smallest spot."""
    on = masked.where(F.col(mask)).select("sample", "spot")
    inner = edges.join(on.withColumnRenamed("spot", "i"), ["sample", "i"], "left_semi").join(on.withColumnRenamed("spot", "j"), ["sample", "j"], "left_semi")
    found = components_by_sample(inner)
    return on.join(found, ["sample", "spot"], "left").groupBy("sample", F.coalesce("component", "spot").alias("component")).agg(F.count(F.lit(1)).alias("size"))


def adjacency_metrics(fields: DataFrame, edges: DataFrame) -> DataFrame:
    """A10: signs of r with a neutral band at its 20 % quantile of |r|; shares of edges that agree, touch neutral, oppose, cross 0."""
    neutral = fields.groupBy("sample").agg(percentile("abs(r)", 0.2).alias("band"))
    sign = F.when(F.col("r") > F.col("band"), 1).when(F.col("r") < -F.col("band"), -1).otherwise(0)
    r = fields.join(neutral, "sample").select("sample", "spot", "r", sign.alias("sign"))
    e = edges.select("sample", "i", "j").join(r.toDF("sample", "i", "ri", "si"), ["sample", "i"]).join(r.toDF("sample", "j", "rj", "sj"), ["sample", "j"])
    share = lambda c: F.avg(c.cast("double"))
    si, sj, ri, rj = (F.col(x) for x in ("si", "sj", "ri", "rj"))
    return e.groupBy("sample").agg(share((si == sj) & (si != 0)).alias("adj_same_fraction"), share((si == 0) | (sj == 0)).alias("adj_zero_fraction"), share(si * sj == -1).alias("adj_opposite_fraction"), share((ri <= 0) & (rj > 0) | (rj <= 0) & (ri > 0)).alias("r_crossing_fraction"))


def component_summary(masked: DataFrame, edges: DataFrame, mask: str) -> DataFrame:
    """n components, the largest one's share of masked spots, the share of components of up to 3 spots."""
    return mask_components(masked, edges, mask).groupBy("sample").agg(F.count(F.lit(1)).alias(f"n_{mask}_components"), (F.max("size") / F.sum("size")).alias(f"largest_{mask}_component_ratio"), F.avg((F.col("size") <= 3).cast("double")).alias(f"{mask}_small_fraction"))


def regime(interface: Column, diffuse: Column) -> Column:
    return F.when(interface >= 0.01, "Type A").when(diffuse >= 0.05, "Type B").otherwise("Type C")


def pattern() -> Column:
    zero, same = F.col("adj_zero_fraction"), F.col("adj_same_fraction")
    return F.when((zero >= 0.55) & (F.col("diffuse_small_fraction") >= 0.2) & (F.col("largest_diffuse_component_ratio") <= 0.35), "Fragmented").when((same >= 0.8) & (zero <= 0.2), "Continuous").otherwise("Weakly organized")


def sample_metrics(masked: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per sample with fractions, components, burden, means and the regime."""
    m = masked.groupBy("sample").agg(F.count(F.lit(1)).alias("n_spots"), F.avg(F.col("interface").cast("double")).alias("interface_fraction"), F.sum(F.col("interface").cast("long")).alias("interface_spots"), F.avg(F.col("diffuse").cast("double")).alias("diffuse_fraction"), F.sum(F.col("diffuse").cast("long")).alias("diffuse_spots"), F.avg("c").alias("c_mean"), F.avg("s").alias("s_mean"), F.avg("r").alias("r_mean"), F.stddev_pop("r").alias("r_sd"), (percentile("r", 0.9) - percentile("r", 0.1)).alias("r_dynamic_range"), F.avg("g").alias("g_mean"), percentile("g", 0.9).alias("g_q90"))
    for mask in ("interface", "diffuse"):
        m = m.join(component_summary(masked, edges, mask), "sample", "left").fillna(0, [f"n_{mask}_components"]).fillna(0.0, [f"largest_{mask}_component_ratio", f"{mask}_small_fraction"])
        m = m.withColumn(f"{mask}_coherence_score", F.col(f"{mask}_fraction") * F.col(f"largest_{mask}_component_ratio"))
    m = m.withColumn("interface_fragmentation_index", F.coalesce(F.try_divide("n_interface_components", "interface_spots"), F.lit(0.0)))
    burden = 0.5 * F.col("diffuse_fraction") + 0.25 * F.col("g_q90") + F.when(F.col("diffuse_spots") > 0, 0.25 * (1 - F.col("largest_diffuse_component_ratio"))).otherwise(F.lit(0.0))
    m = m.join(adjacency_metrics(masked, edges), "sample", "left").withColumn("transition_burden_score", burden)
    m = m.withColumn("regime_label", regime(F.col("interface_fraction"), F.col("diffuse_fraction")))
    return m.withColumn("public_transition_pattern", F.when(F.col("regime_label") == "Type B", pattern()).otherwise(F.lit("not_applicable")))


def threshold_perturbation(fields: DataFrame, edges: DataFrame, cqs=(0.75, 0.8, 0.85), sqs=(0.75, 0.8, 0.85), gqs=(0.5, 0.6, 0.7)) -> DataFrame:
    """Regime and pattern for every cell of the threshold grid; cells are samples of their own, so one plan finds all components."""
    q = fields.groupBy("sample").agg(*(F.expr(f"percentile({x}, array({', '.join(map(str, qs))}))").alias(f"t{x}") for x, qs in (("c", cqs), ("s", sqs), ("g", gqs))))
    q = q.select("sample", F.posexplode("tc").alias("ci", "vc"), "ts", "tg").select("*", F.posexplode("ts").alias("si", "vs")).select("*", F.posexplode("tg").alias("gi", "vg"))
    pick = lambda i, qs: F.element_at(F.array(*map(F.lit, qs)), F.col(i) + 1)
    grid = q.select("sample", pick("ci", cqs).alias("c_q"), pick("si", sqs).alias("s_q"), pick("gi", gqs).alias("g_q"), "vc", "vs", "vg").withColumn("cell", F.concat_ws("|", "sample", "c_q", "s_q", "g_q"))
    c, s, g = F.col("c") >= F.col("vc"), F.col("s") >= F.col("vs"), F.col("g") >= F.col("vg")
    m = fields.join(grid, "sample").select(F.col("cell").alias("sample"), "spot", "r", (c & s & g).alias("interface"), (g & (c | s) & ~(c & s & g)).alias("diffuse"))
    cells = edges.join(grid.select("sample", "cell"), "sample").select(F.col("cell").alias("sample"), "i", "j")
    parts = component_summary(m, cells, "diffuse")
    share = m.groupBy("sample").agg(F.avg(F.col("interface").cast("double")).alias("interface_fraction"), F.avg(F.col("diffuse").cast("double")).alias("diffuse_fraction"))
    rows = share.join(parts, "sample", "left").fillna(0.0).withColumnRenamed("sample", "cell").join(grid, "cell").join(adjacency_metrics(fields, edges), "sample", "left").withColumn("regime_label", regime(F.col("interface_fraction"), F.col("diffuse_fraction")))
    return rows.select("sample", "c_q", "s_q", "g_q", "regime_label", F.when(F.col("regime_label") == "Type B", pattern()).otherwise("not_applicable").alias("type_b_subtype"), "interface_fraction", "diffuse_fraction")


def spot_state_labels(masked: DataFrame, cq: float = 0.8, sq: float = 0.8) -> DataFrame:
    """The last rule that holds names the spot; plain inclusive quantiles."""
    t = masked.groupBy("sample").agg(percentile("c", cq).alias("tc"), percentile("s", sq).alias("ts"))
    ch, sh = F.col("c") >= F.col("tc"), F.col("s") >= F.col("ts")
    state = F.when(F.col("interface"), "localized_interface_like").when(F.col("diffuse"), "diffuse_transition").when(sh & ~ch, "S_dominant").when(ch & ~sh, "C_dominant").otherwise("balanced_or_transition_like")
    return masked.join(t, "sample").select("sample", "spot", state.alias("state"), (F.col("interface") | F.col("diffuse") | (ch & sh)).alias("transition_like"))


def graph_qc(spots: DataFrame, edges: DataFrame, long_factor: float = 3.0) -> DataFrame:
    """Degrees, isolation, density, components, distances, duplicate coordinates and warnings, per sample."""
    deg = degree_table(spots, edges)
    d = deg.groupBy("sample").agg(F.count(F.lit(1)).alias("n_spots"), F.min("degree").alias("degree_min"), percentile("degree", 0.5).alias("degree_median"), F.avg("degree").alias("degree_mean"), F.max("degree").alias("degree_max"), F.sum((F.col("degree") == 0).cast("long")).alias("isolated_spots"))
    comp = mask_components(deg.withColumn("all", F.lit(True)), edges, "all").groupBy("sample").agg(F.count(F.lit(1)).alias("n_components"), F.max("size").alias("largest"))
    dist = edges.groupBy("sample").agg(F.count(F.lit(1)).alias("n_edges"), percentile("dist", 0.5).alias("distance_median"), percentile("dist", 0.95).alias("distance_q95"), F.max("dist").alias("distance_max"))
    dup = spots.groupBy("sample").agg((F.count(F.lit(1)) - F.countDistinct("x", "y")).alias("duplicate_coordinates"))
    m = d.join(comp, "sample").join(dist, "sample", "left").fillna(0, ["n_edges"]).join(dup, "sample")
    n = F.col("n_spots")
    m = m.withColumn("density", F.coalesce(F.try_divide(2 * F.col("n_edges"), n * (n - 1)), F.lit(0.0))).withColumn("largest_component_ratio", F.col("largest") / n).drop("largest")
    warn = F.concat_ws(";", F.when(F.col("isolated_spots") / n > 0.1, "many_isolated"), F.when(F.col("largest_component_ratio") < 0.8, "fragmented"), F.when(F.col("degree_median") < 2, "low_degree"))
    return m.withColumn("warnings", warn)


def degree_table(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of every spot, 0 for isolated ones."""
    n = symmetric(edges.select("sample", "i", "j")).groupBy("sample", "spot").agg(F.count(F.lit(1)).alias("degree"))
    return spots.select("sample", "spot").join(n, ["sample", "spot"], "left").fillna(0, ["degree"])

