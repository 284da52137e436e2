"""Closed-form fixtures of the spatial operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotfield.functions.numbers import with_bh
from spotfield.operators import enrich, fields, neighbors, permute
from spotfield.operators.components import components_by_sample, connected_components, joined

SPOT = "sample string, spot long, x double, y double"


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([("a", r * 10 + c, float(c), float(r)) for r in range(10) for c in range(10)], SPOT)


def test_radius_and_knn_on_unit_grid(spark, grid):
    assert neighbors.radius_graph(grid, 1.01).count() == 180
    assert neighbors.radius_graph(grid, 0.0).count() == 0
    near = neighbors.knn(grid, 4).groupBy("spot").count().where("count <> 4").count()
    assert near == 0
    got = {(r["spot"], r["other"]) for r in neighbors.knn(grid, 2).collect() if r["spot"] == 55}
    assert got == {(55, 45), (55, 54)}  # ties by spot


def test_knn_of_uneven_places(spark):
    """A dense crowd, a sparse field, far outliers, equal places and a sample of two, against all distances."""
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.normal(0, 0.01, (150, 2)), rng.uniform(-50, 50, (60, 2)), [[1e4, 1e4], [-1e4, 3.0]], np.repeat([[7.0, 7.0]], 5, 0)])
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [("b", 0, 0.0, 0.0), ("b", 1, 9.0, 0.0), ("c", 5, 1.0, 1.0), ("d", 1, None, 2.0)]
    got = {}
    for r in neighbors.knn(spark.createDataFrame(rows, SPOT), 4).collect():
        got.setdefault((r["sample"], r["spot"]), []).append((r["k"], r["other"]))
    for i in range(len(xy)):
        d = np.round(((xy - xy[i]) ** 2).sum(1), 9)
        want = [j for j in np.lexsort((np.arange(len(xy)), d)) if j != i][:4]
        assert [o for _, o in sorted(got["a", i])] == want
    assert got["b", 0] == [(1, 1)] and ("c", 5) not in got and ("d", 1) not in got


def test_lattice_offsets(spark):
    spots = spark.createDataFrame([("a", 0, 0, 0), ("a", 1, 0, 2), ("a", 2, 1, 1), ("a", 3, 1, 3)], "sample string, spot long, array_row int, array_col int")
    assert {(r["i"], r["j"]) for r in neighbors.lattice_graph(spots).collect()} == {(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)}
    assert len(neighbors.ring_offsets(2)) == 18


def test_zero_distances_leave_inverse_weights(spark):
    spots = spark.createDataFrame([("a", i, 0.0, 0.0) for i in range(3)], SPOT)
    edges = neighbors.radius_graph(spots, 1.0)
    assert edges.count() == 3 and neighbors.edge_weights(edges, "inverse_distance").count() == 0


def test_components_agree_in_both_ways(spark):
    pairs = [(i, i + 1) for i in range(200) if i % 50] + [(7, 7), (300, 400), (400, 301)]
    edges = spark.createDataFrame([("s", a, b) for a, b in pairs], "sample string, i long, j long")
    stars = {(r["node"], r["component"]) for r in connected_components(edges).collect()}
    small = {(r["spot"], r["component"]) for r in components_by_sample(edges).collect()}
    assert stars == small
    assert {c for _, c in stars} == {1, 51, 101, 151, 300}


@pytest.mark.parametrize("most", [500_000, 40])
def test_links_join_earlier_components(spark, most):
    """In one task, whatever partitions the links lie in, or by rounds; null ends, loops and repeated links don't matter."""
    first = [(-i, -i - 1) for i in range(1, 90) if i % 30] + [(7, 7), (400, 300), (400, 300), (None, 5)]
    more = [(-31, -30), (300, -90), (8, 9)]
    links = lambda rows: spark.createDataFrame(rows, "a long, b long").repartition(7)
    found = joined(joined(None, links(first), most), links(more), most)
    told = {(r["node"], r["component"]) for r in connected_components(links(first + more), "a", "b").collect()}
    assert {tuple(r) for r in found.collect()} == told and {c for _, c in told} == {-90, -60, 8}
    assert most == 40 or found.rdd.getNumPartitions() == 1
    assert joined(None, links(first).limit(0), most).count() == 0


def test_constant_field_has_no_high_spots(spark):
    f = spark.createDataFrame([("a", i, 1.0) for i in range(5)], "sample string, spot long, v double")
    assert fields.high_mask(f, "v", 0.8, "high").where("high").count() == 0


def test_benjamini_hochberg_keeps_nulls(spark):
    p = spark.createDataFrame([(0.04,), (0.001,), (None,), (0.02,), (0.5,)], "p double").withColumn("sample", F.lit("a"))
    q = {r["p"]: r["q"] for r in with_bh(p, "p", "q", ["sample"]).collect()}
    assert q[None] is None and q[0.001] == pytest.approx(0.004) and q[0.02] == pytest.approx(0.04) and q[0.04] == pytest.approx(0.16 / 3) and q[0.5] == 0.5


def test_continuous_statistic_on_path(spark):
    v = spark.createDataFrame([("a", i, x, y) for i, (x, y) in enumerate([(1.0, 4.0), (2.0, 5.0), (3.0, 6.0)])], "sample string, spot long, x double, y double")
    e = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 1, 2, 1.0)], "sample string, i long, j long, weight double")
    assert permute.continuous_edge_stats(v, e, [("x", "y")], 9, 1).first()["observed"] == pytest.approx(10.0)


def test_shuffles_stay_within_groups(spark):
    v = spark.createDataFrame([("a", i, float(i), i // 2) for i in range(4)], "sample string, spot long, v double, g int")
    rows = permute.replicates(v, "v", 20, 3, F.col("g")).collect()
    assert all((r["v"] < 2) == (r["spot"] < 2) for r in rows)


def test_mann_whitney_exact_and_normal():
    assert enrich.two_sided_p(3, 3, 9.0, 0.0, 0.0) == pytest.approx(0.1)
    assert enrich.two_sided_p(1, 3, 3.0, 0.0, 0.0) is None
    assert enrich.two_sided_p(20, 20, 300.0, 1.959964, 0.0) == pytest.approx(0.05, abs=1e-4)


def test_registered_permutations_are_the_reference_defaults(spark):
    from spotfield.plans import inference_queries as iq

    p = [r["empirical_p"] for r in iq.QUERIES["binary_association"](spark, "/root/testdata/sf0.001").collect()]
    assert min(p) < 0.05 and all(abs(x * 1000 - round(x * 1000)) < 1e-6 for x in p)  # multiples of 1 / (999 + 1)
    assert "range(1, 500)" in iq.ORACLES["interaction_null"]
