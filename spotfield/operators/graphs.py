"""Graph builder with fallback, its metadata, and agreement across graphs; groups of permutations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import durable
from . import fields as ff
from . import neighbors as nn
from .components import components_by_sample

# Names of the micrometre, and the version of the metadata.
MICROMETRE = ("micrometer", "micrometre", "um", "µm")


@dataclass(frozen=True)
class GraphConfig:
    """How to build a graph. Without a radius 1.25 times the median spacing counts; coordinates are physical only if a source of the
    scale is named and they are in micrometres or have a positive scale."""

    method: str = "radius"
    radius: float | None = None
    k: int = 6
    ring: int = 1
    mutual: bool = False
    coordinate_unit: str = "native"
    coordinate_scale: float | None = None
    scale_source: str = ""

    def __post_init__(self):
        if self.method not in ("radius", "lattice", "knn"):
            raise ValueError("the graph is built by radius, lattice or knn")
        if self.k < 1 or self.ring < 1:
            raise ValueError("k and ring start at 1")

    @property
    def factor(self) -> float | None:
        """What coordinates are multiplied by to be micrometres; None where that isn't known."""
        if not self.scale_source.strip():
            return None
        if self.coordinate_unit.lower() in MICROMETRE:
            return 1.0
        return float(self.coordinate_scale) if self.coordinate_scale and self.coordinate_scale > 0 else None


def lattice_places(spots: DataFrame) -> DataFrame:
    """L1: array_row and array_col of every spot: as given, else the rounded coordinates (row y, column x)."""
    return spots.withColumn("array_row", F.coalesce("array_row", F.round("y").cast("int"))).withColumn("array_col", F.coalesce("array_col", F.round("x").cast("int")))


def build_graph(spots: DataFrame, config: GraphConfig = GraphConfig()) -> tuple[DataFrame, DataFrame]:
    """(edges (sample, i, j, dist), metadata). Coordinates are scaled before distances are taken. Samples without lattice places
    for all spots get a radius graph where a lattice was asked for; zero distances make no edges."""
    at = spots.where("x is not null and y is not null")
    if config.factor is not None:
        at = at.withColumn("x", F.col("x") * config.factor).withColumn("y", F.col("y") * config.factor)
    at = durable(at)
    has = at.groupBy("sample").agg(F.every(F.col("array_row").isNotNull() & F.col("array_col").isNotNull()).alias("lattice"))
    xy = at.select("sample", F.col("spot").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    effective = F.lit(config.method) if config.method != "lattice" else F.when(F.col("lattice"), "lattice").otherwise("radius")
    kinds = durable(has.select("sample", "lattice", effective.alias("method")))
    none = at.limit(0).select("sample", F.col("spot").alias("i"), F.col("spot").alias("j"), F.col("x").alias("dist"))
    edges, radii = none, None
    if config.method == "knn":
        edges = nn.knn_graph(at, config.k, config.mutual)
    else:
        if config.method == "lattice":
            pairs = nn.lattice_graph(at.join(kinds.where("method = 'lattice'").select("sample"), "sample", "left_semi"), config.ring)
            far = pairs.join(xy, ["sample", "i"]).join(xy.toDF("sample", "j", "xj", "yj"), ["sample", "j"])
            edges = far.select("sample", "i", "j", F.round(F.sqrt(F.pow(F.col("xi") - F.col("xj"), 2) + F.pow(F.col("yi") - F.col("yj"), 2)), 9).alias("dist"))
        rest = at.join(kinds.where("method = 'radius'").select("sample"), "sample", "left_semi")
        radii = durable(nn.nn_spacing(rest).select("sample", F.coalesce(F.lit(config.radius).cast("double"), "auto_radius").alias("radius")))
        for r in sorted({x["radius"] for x in radii.select("radius").distinct().collect() if x["radius"]}):  # one pass for each radius
            edges = edges.unionByName(nn.radius_graph(rest.join(radii.where(F.col("radius") == r), "sample", "left_semi"), r))
    edges = durable(edges.select("sample", "i", "j", "dist"))
    zero = edges.groupBy("sample").agg(F.count_if(F.col("dist") == 0).alias("zero_distance_edges_excluded"))
    edges = edges.where("dist > 0")
    qc = ff.graph_qc(at, edges)
    meta = qc.join(kinds, "sample").join(zero, "sample", "left").fillna(0, ["zero_distance_edges_excluded"])
    meta = meta.join(radii, "sample", "left") if radii is not None else meta.withColumn("radius", F.lit(None).cast("double"))
    physical = config.factor is not None
    rows = meta.select(
        "sample", F.lit(config.method).alias("requested_method"), F.col("method").alias("effective_method"), (F.col("method") != config.method).alias("fallback_used"), F.lit(config.radius).cast("double").alias("requested_radius"), F.col("radius").alias("effective_radius"),
        F.lit("micrometer" if physical else config.coordinate_unit).alias("radius_unit"), F.when(F.col("method") == "knn", config.k).alias("k"), F.lit(config.ring if config.method == "lattice" else None).cast("int").alias("lattice_ring"), (F.col("method") == "lattice").alias("lattice_detection_succeeded"),
        F.lit(physical).alias("physical_calibration_available"), F.col("n_spots").alias("n_nodes"), "n_edges", F.col("degree_mean").alias("mean_degree"), F.col("degree_median").alias("median_degree"), (F.col("isolated_spots") / F.col("n_spots")).alias("isolated_fraction"), "n_components", "largest_component_ratio", "zero_distance_edges_excluded", "warnings",
    )
    return edges, rows


def graph_comparison(spots: DataFrame, config: GraphConfig) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Metadata of the radius, lattice and knn graphs with their largest differences, and the edges of each."""
    made = {m: build_graph(spots, GraphConfig(**{**config.__dict__, "method": m})) for m in ("radius", "lattice", "knn")}
    rows = made["radius"][1].unionByName(made["lattice"][1]).unionByName(made["knn"][1]).withColumn("status", F.when(F.col("n_edges") > 0, "ok").otherwise("insufficient_edges"))
    spread = rows.groupBy("sample").agg(*((F.max(c) - F.min(c)).alias(n) for c, n in (("isolated_fraction", "isolated_fraction_variation"), ("n_components", "connected_component_variation"), ("n_edges", "valid_edge_variation"))))
    return rows.join(spread, "sample"), {m: e for m, (e, _) in made.items()}


def stability_across_graphs(tables: dict[str, DataFrame]) -> DataFrame:
    """Per pair of labels the directions and significance in each graph, whether they agree, and the range of ratio and z."""
    every = None
    for i, (name, table) in enumerate(tables.items()):
        one = table.select("sample", "label_a", "label_b", F.lit(i).alias("n"), F.lit(name).alias("graph"), "association_direction", (F.coalesce(F.col("q_value_bh_fdr") <= 0.05, F.lit(False))).alias("significant"), "observed_expected_ratio", "z")
        every = one if every is None else every.unionByName(one)
    listed = F.array_sort(F.collect_list(F.struct("n", "graph", "association_direction", F.when(F.col("significant"), "significant").otherwise("not_significant").alias("state"))))  # a few graphs
    joined = lambda c: F.concat_ws(";", F.col(f"l.{c}"))
    m = every.groupBy("sample", "label_a", "label_b").agg(F.count(F.lit(1)).alias("graphs_evaluated"), listed.alias("l"), F.countDistinct("association_direction").alias("d"), F.countDistinct("significant").alias("s"), *(f(c).alias(f"{c}_{n}") for c in ("observed_expected_ratio", "z") for n, f in (("min", F.min), ("max", F.max))))
    out = m.select("sample", "label_a", "label_b", "graphs_evaluated", joined("graph").alias("requested_graphs"), joined("association_direction").alias("association_directions"), (F.col("d") == 1).alias("direction_stable_across_graphs"), joined("state").alias("significance_states"), (F.col("s") == 1).alias("significance_stable_across_graphs"), *(f"{c}_{n}" for c in ("observed_expected_ratio", "z") for n in ("min", "max")))
    return out.withColumns({f"{c}_variation": F.col(f"{c}_max") - F.col(f"{c}_min") for c in ("observed_expected_ratio", "z")})


def permutation_groups(spots: DataFrame, edges: DataFrame, scope: str, strata: str | None = None) -> DataFrame:
    """(sample, spot, grp): one group, the connected component (its smallest spot), or the stratum's number; spots without a
    stratum have none and take no part."""
    if scope == "whole_slide":
        return spots.select("sample", "spot", F.lit(0).cast("long").alias("grp"))
    if scope == "within_connected_components":
        found = components_by_sample(edges)
        return spots.select("sample", "spot").join(found, ["sample", "spot"], "left").select("sample", "spot", F.coalesce("component", F.col("spot").cast("long")).alias("grp"))
    if scope != "within_user_strata" or not strata:
        raise ValueError("permutations stay within whole_slide, within_connected_components or within_user_strata with a column of strata")
    names = spots.select("sample", F.col(strata).cast("string").alias("name")).where("name is not null").distinct()
    codes = names.withColumn("grp", (F.row_number().over(Window.partitionBy("sample").orderBy("name")) - 1).cast("long"))  # a row for each stratum
    return spots.select("sample", "spot", F.col(strata).cast("string").alias("name")).join(codes, ["sample", "name"], "left").select("sample", "spot", "grp")


def tissue_only(spots: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spots in the tissue and the edges between them; all, if the table doesn't tell."""
    if "in_tissue" not in spots.columns:
        return spots, edges
    kept = spots.where(F.col("in_tissue").cast("double") == 1)
    ids = kept.select("sample", "spot")
    return kept, edges.join(ids.toDF("sample", "i"), ["sample", "i"], "left_semi").join(ids.toDF("sample", "j"), ["sample", "j"], "left_semi")


def smoothed(fields: DataFrame, spots: DataFrame, mode: str, k: int = 6, sigma: float = 1.0) -> tuple[DataFrame, str]:
    """C and s smoothed by ``knn_mean`` or ``gaussian`` and r made anew, with a warning; as they are for ``none``, for a sigma of 0
    and without coordinates."""
    if mode == "none" or mode == "gaussian" and sigma == 0:
        return fields, ""
    if spots.where("x is not null and y is not null").isEmpty():
        return fields, "smoothing_skipped"
    edges = durable(nn.knn_graph(spots, k)) if mode == "knn_mean" else None
    smooth = lambda x: nn.mean_smooth(fields, edges, x) if edges is not None else nn.gaussian_smooth(fields, spots, x, sigma)
    c, s = (smooth(x).select("sample", "spot", F.round(x, 9).alias(x)) for x in ("c", "s"))
    return fields.drop("c", "s", "r").join(c, ["sample", "spot"]).join(s, ["sample", "spot"]).withColumn("r", F.round(F.col("c") - F.col("s"), 9)), ""
