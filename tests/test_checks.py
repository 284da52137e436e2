"""Validation, names, quality flags, graphs, permutation scopes and rank tests."""

import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotfield.operators import checks, enrich, graphs, matrix, neighbors, permute, tables

SPOT = "sample string, spot long, x double, y double, array_row int, array_col int"


def test_programs_are_checked_before_anything_runs():
    fine = checks.check_programs("cd3d, CD2;cd3d\nTRAC", ["col1a1", "IGHG1"])
    assert fine.c_genes == ["CD3D", "CD2", "TRAC"] and fine.c_duplicates_removed == ["CD3D"] and fine.action_taken == checks.REPAIRED
    assert fine.validation_status == "valid" and "IGHG1" in fine.warnings[0] and fine.provenance()["n_overlap_genes"] == 0
    assert checks.check_programs(["A"], ["B"]).action_taken == checks.NORMAL
    with pytest.raises(checks.OverlappingPrograms) as e:
        checks.check_programs(["A", "b"], ["B", "c"])
    assert e.value.result.overlap_genes == ["B"]
    told = checks.check_programs(["A", "b"], ["B", "c"], overlap_policy="report")
    assert told.validation_status == "invalid_overlap" and told.action_taken == checks.BLOCKED
    for c, s, policy in (("", "A", "error"), ("A", [], "error"), ("A", "B", "other")):
        with pytest.raises(ValueError):
            checks.check_programs(c, s, overlap_policy=policy)


def test_options():
    assert checks.Options(smoothing="odd", normalisation="odd") == checks.Options()
    for bad in ({"c_q": 1.0}, {"k": 0}, {"sigma": -1}, {"permutations": 0}, {"scope": "all"}):
        with pytest.raises(ValueError):
            checks.Options(**bad)


def test_sample_contract(spark):
    inf = float("inf")
    spots = spark.createDataFrame([("a", 1, 0.0, 0.0, 0, 0), ("b", 1, None, None, 0, 0), ("c", 1, inf, 0.0, 0, 0)], SPOT)
    genes = spark.createDataFrame([("a", "g"), ("a", "h"), ("b", "g"), ("b", "g "), ("c", " "), ("c", None), ("d", "g")], "sample string, gene string")
    got = {r["sample"]: (r["errors"], r["valid"]) for r in checks.validate_sample(spots, genes).collect()}
    assert got == {"a": ("", True), "b": ("repeated_gene_names;no_coordinates", False), "c": ("blank_gene_names;non_finite_coordinates", False), "d": ("no_spots;no_coordinates", False)}
    loose = {r["sample"]: (r["errors"], r["warnings"]) for r in checks.validate_sample(spots, genes, require_spatial=False).collect()}
    assert loose["b"] == ("repeated_gene_names", "no_coordinates")
    with pytest.raises(ValueError, match="blank_gene_names"):
        checks.require_valid(checks.validate_sample(spots, genes))


def test_unique_names_skip_taken_ones(spark):
    names = ["a", "a", "a-1", "a", "", None, "b", "a-1"]
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate(names)], "sample string, gene_idx long, gene string")
    got = [r["unique_name"] for r in checks.unique_names(rows).orderBy("gene_idx").collect()]
    assert got == ["a", "a-1", "a-1-1", "a-2", "unnamed_gene", "unnamed_gene-1", "b", "a-1-2"]
    safe = spark.createDataFrame([(' a<b>:"c.', )], "n string").select(checks.safe_name(F.col("n"))).first()[0]
    assert safe == "a_b_c"


def test_quality_flags(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0, "PASS", True, 50, False), ("b", 0.7, 1.0, "PASS", True, 5, True), ("c", 0.4, 1.0, "WARN", False, 50, False), ("d", 1.0, 1.0, "FAIL", True, 50, False)], "sample string, c_coverage double, s_coverage double, spatial_qc_status string, unique_names boolean, n_spots long, smoothing_skipped boolean")
    got = {r["sample"]: (r["qc_flag"], r["qc_notes"]) for r in checks.qc_flag(rows).collect()}
    assert got == {"a": ("PASS", ""), "b": ("WARN", "partial_gene_program_coverage;very_small_spot_count;smoothing_skipped"), "c": ("FAIL", "low_gene_program_coverage;spatial_warn;duplicate_feature_names"), "d": ("FAIL", "spatial_fail")}


def test_receptor_table(spark):
    rows = spark.createDataFrame([("egfr", "2.5"), ("SLC2A1", None), ("CD44", "x"), ("ACTB", "9"), (None, "1")], "gene string, candidate_score string")
    got = [(r["gene"], r["annotation_reason"], r["priority_score"]) for r in tables.receptor_filter(rows).collect()]
    assert got == [("egfr", "receptor_like", 3.5), ("CD44", "receptor_like;surface_like", 1.5), ("SLC2A1", "transporter_like", 0.5)]
    assert tables.receptor_filter(rows.drop("candidate_score")).where("gene = 'egfr'").first()["priority_score"] == 1.0


def test_dashboards_and_gate(spark):
    table = spark.createDataFrame([("s", "C", "a", 1, "present", 60.0), ("s", "C", "b", 2, "present", 40.0), ("s", "S", "c", 1, "missing", 0.0)], "sample string, program string, gene string, requested_order int, status string, relative_contribution_percent double")
    got = {r["program"]: (r["top_gene"], r["top_percent"], r["present"], r["missing"]) for r in checks.dashboard_composition(table).collect()}
    assert got == {"C": ("a", 60.0, 2, 0), "S": (None, None, 0, 1)} or got["C"] == ("a", 60.0, 2, 0)
    effects = spark.createDataFrame([("s", "a", 3, 7, 0.5, True), ("s", "b", 3, 7, -0.9, False), ("s", "c", 3, 7, None, False)], "sample string, gene string, n_interface long, n_noninterface long, hedges_g double, significant_fdr_0_05 boolean")
    r = checks.dashboard_enrichment(effects).first()
    assert (r["n_interface"], r["significant"], r["genes"], r["strongest_gene"], r["strongest_effect"]) == (3, 1, 3, "b", 0.9)
    cover = spark.createDataFrame([("s", "H", "present"), ("s", "V", "missing")], "sample string, field string, status string")
    with pytest.raises(ValueError, match="V"):
        checks.coverage_gate(cover)
    assert checks.coverage_gate(cover, allow=True).where("scored").count() == 2
    said = spark.createDataFrame([("s", "Type A", 0.2, 0.0, 10)], "sample string, regime_label string, interface_fraction double, diffuse_fraction double, n_spots long")
    assert "localised interface" in checks.interpretation(said).first()["interpretation"]


def test_graph_builder(spark):
    places = [(r, 2 * c + r % 2) for r in range(6) for c in range(6)]
    spots = spark.createDataFrame([("a", i, float(y), r * math.sqrt(3), r, y) for i, (r, y) in enumerate(places)] + [("b", i, float(i), 0.0, None, None) for i in range(4)] + [("b", 9, 3.0, 0.0, None, None)], SPOT)
    edges, meta = graphs.build_graph(spots, graphs.GraphConfig("lattice"))
    m = {r["sample"]: r for r in meta.collect()}
    assert m["a"]["effective_method"] == "lattice" and not m["a"]["fallback_used"] and m["b"]["effective_method"] == "radius" and m["b"]["fallback_used"]
    assert m["a"]["n_edges"] == neighbors.lattice_graph(spots.where("sample = 'a'")).count() and m["b"]["zero_distance_edges_excluded"] == 1
    assert {(r["i"], r["j"]) for r in edges.where("sample = 'b'").collect()} == {(0, 1), (1, 2), (2, 3), (2, 9)}
    scaled, meta = graphs.build_graph(spots, graphs.GraphConfig("radius", radius=5.0, coordinate_scale=2.0, scale_source="sidecar"))
    assert meta.first()["radius_unit"] == "micrometer" and scaled.where("sample = 'b' and dist > 0").agg(F.max("dist")).first()[0] == 4.0
    _, meta = graphs.build_graph(spots, graphs.GraphConfig("radius", radius=5.0, coordinate_scale=2.0))
    assert meta.first()["radius_unit"] == "native" and not meta.first()["physical_calibration_available"]
    with pytest.raises(ValueError):
        graphs.GraphConfig("delaunay")


def test_agreement_across_graphs(spark):
    places = [(r, 2 * c + r % 2) for r in range(8) for c in range(8)]
    spots = spark.createDataFrame([("a", i, float(y), r * math.sqrt(3), r, y) for i, (r, y) in enumerate(places)], SPOT).withColumn("label", F.when(F.col("array_row") < 4, "u").otherwise("v"))
    rows, edges = graphs.graph_comparison(spots, graphs.GraphConfig(radius=2.1, k=4))
    assert {r["requested_method"]: r["status"] for r in rows.collect()} == dict.fromkeys(("radius", "lattice", "knn"), "ok")
    found = {m: permute.categorical_enrichment(spots, e, 39, 7).withColumn("observed_expected_ratio", F.col("observed") / F.col("expected")) for m, e in edges.items()}
    got = {(r["label_a"], r["label_b"]): r for r in graphs.stability_across_graphs(found).collect()}
    assert len(got) == 3 and all(r["graphs_evaluated"] == 3 and r["direction_stable_across_graphs"] for r in got.values())
    assert got["u", "u"]["association_directions"] == "enriched;enriched;enriched" and got["u", "v"]["requested_graphs"] == "radius;lattice;knn"


def test_permutation_scopes(spark):
    spots = spark.createDataFrame([("a", i, float(i), 0.0, 0, i) for i in range(6)], SPOT).withColumn("stratum", F.when(F.col("spot") < 3, "p").when(F.col("spot") < 5, "q")).withColumn("in_tissue", (F.col("spot") != 2).cast("int"))
    edges = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("a", 3, 4)], "sample string, i long, j long")
    kept, inner = graphs.tissue_only(spots, edges)
    assert kept.count() == 5 and inner.count() == 2
    groups = lambda *a: {r["spot"]: r["grp"] for r in graphs.permutation_groups(*a).collect()}
    assert groups(spots, inner, "within_connected_components") == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5}
    assert groups(spots, edges, "within_user_strata", "stratum") == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: None}
    with pytest.raises(ValueError):
        graphs.permutation_groups(spots, edges, "within_user_strata")


def test_smoothing_dispatch(spark):
    spots = spark.createDataFrame([("a", i, float(i), 0.0, 0, i) for i in range(4)], SPOT)
    f = spark.createDataFrame([("a", i, float(i), 1.0, float(i) - 1) for i in range(4)], "sample string, spot long, c double, s double, r double")
    assert graphs.smoothed(f, spots, "none") == (f, "")
    nowhere = spots.withColumn("x", F.lit(None).cast("double"))
    assert graphs.smoothed(f, nowhere, "knn_mean")[1] == "smoothing_skipped"
    got = {r["spot"]: (r["c"], r["r"]) for r in graphs.smoothed(f, spots, "knn_mean", k=1)[0].collect()}
    assert got[0] == (0.5, -0.5) and got[3] == (2.5, 1.5)


def exact_p(x, y):
    """Two-sided p by listing all ways to deal the values into the groups."""
    both, n = list(x) + list(y), len(x)
    u = lambda a, b: sum((p > q) + 0.5 * (p == q) for p in a for q in b)
    top = max(u(x, y), n * len(y) - u(x, y))
    ways = [u([both[i] for i in c], [both[i] for i in range(len(both)) if i not in c]) for c in itertools.combinations(range(len(both)), n)]
    return min(1.0, 2 * np.mean([w >= top - 1e-9 for w in ways]))


def normal_p(x, y):
    """The normal approximation with corrections for ties and continuity, from its textbook form."""
    n1, n2 = len(x), len(y)
    n, u = n1 + n2, sum((p > q) + 0.5 * (p == q) for p in x for q in y)
    ties = sum(t**3 - t for t in collections.Counter([*x, *y]).values())
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    return min(1.0, math.erfc((abs(u - n1 * n2 / 2) - 0.5) / sd / math.sqrt(2)))


def test_rank_test_against_brute_force(spark):
    rng = np.random.default_rng(8)
    cases = {}
    for k, (n1, n2, tied) in enumerate([(3, 4, False), (5, 2, False), (7, 6, False), (2, 9, False), (9, 2, False), (12, 15, False), (4, 5, True), (10, 11, True), (1, 5, False)]):
        draw = (lambda n: rng.integers(0, 4, n).astype(float).tolist()) if tied else (lambda n: rng.standard_normal(n).tolist())
        cases[f"k{k}"] = (draw(n1), draw(n2), tied)
    rows = [(k, v, side) for k, (x, y, _) in cases.items() for side, vs in ((True, x), (False, y)) for v in vs]
    got = {r["key"]: r["p"] for r in enrich.mannwhitney(spark.createDataFrame(rows, "key string, v double, inside boolean"), ["key"], "v", "inside").collect()}
    for k, (x, y, tied) in cases.items():
        if min(len(x), len(y)) < 2:
            assert got[k] is None
        else:
            assert got[k] == pytest.approx((normal_p if tied or min(len(x), len(y)) > 8 else exact_p)(x, y), rel=1e-9)


def test_interface_enrichment_q_values(spark):
    rng = np.random.default_rng(2)
    genes = {f"g{i}": rng.standard_normal(40) + (i % 3) * np.repeat([1, 0], 20) for i in range(6)}
    values = spark.createDataFrame([("a", s, "C", g, float(v[s])) for g, v in genes.items() for s in range(40)], "sample string, spot long, program string, gene string, e double")
    masked = spark.createDataFrame([("a", s, s < 20) for s in range(40)], "sample string, spot long, interface boolean")
    got = {r["gene"]: (r["mannwhitney_p"], r["mannwhitney_fdr_bh"], r["significant_fdr_0_05"]) for r in enrich.interface_enrichment(values, masked).collect()}
    p = {g: normal_p(v[:20], v[20:]) for g, v in genes.items()}
    order, q, least = sorted(p, key=p.get), {}, 1.0
    for rank in range(len(order), 0, -1):
        least = q[order[rank - 1]] = min(least, p[order[rank - 1]] * len(order) / rank)
    assert all(got[g][0] == pytest.approx(p[g], rel=1e-9) and got[g][1] == pytest.approx(q[g], rel=1e-9) and got[g][2] == (q[g] < 0.05) for g in genes)


def test_ranks_over_ranges_equal_ranks_in_one_window(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 20, 300).astype(float)
    rows = spark.createDataFrame([("ab"[i % 2], i, float(x), None if i % 7 == 0 else float(x)) for i, x in enumerate(v)], "sample string, spot long, c double, s double")
    got = {r["spot"]: (r["c"], r["s"]) for r in matrix.normalize(rows, "rank_quantile").collect()}
    for sample in (0, 1):
        own = {i: x for i, x in enumerate(v) if i % 2 == sample}
        rank = {i: sum(y < x for y in own.values()) + (sum(y == x for y in own.values()) + 1) / 2 for i, x in own.items()}
        assert all(got[i][0] == pytest.approx((rank[i] - 0.5) / len(own)) for i in own)
    assert got[7][1] is None and len(got) == 300
