"""Replicates drawn in tasks: digests, draws, and every statistic against the relations that larger samples go by."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spotfield.operators import neighbors, permute, shuffles
from spotfield.plans import inference_queries as iq

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def samples(spark):
    """Two samples of a grid with equal labels, one spot without a label, one without a group, one without edges."""
    rng = np.random.default_rng(4)
    rows = []
    for s, side in (("a", 7), ("b", 4)):
        for k in range(side * side):
            label = None if k == 5 else "xyz"[int(rng.integers(3))]
            rows.append((s, k * 37, k // side, k % side, label, None if k == 6 else int(rng.integers(3)), float(rng.integers(100)) / 10, None if k == 8 else float(rng.normal()), bool(rng.integers(2)), bool(rng.integers(2))))
    spots = spark.createDataFrame([*rows, ("b", 9999, 900, 900, "x", 0, 1.0, 2.0, True, False)], "sample string, spot long, y int, x int, label string, g int, c double, s double, m boolean, k boolean").cache()
    edges = neighbors.radius_graph(spots.select("sample", "spot", F.col("x").cast("double"), F.col("y").cast("double")), 1.5)
    extra = spark.createDataFrame([("a", 37, 123456, 1.0)], "sample string, i long, j long, dist double")  # an end that is no spot
    return spots, neighbors.edge_weights(edges.unionByName(extra), "inverse_distance").cache()


def both_ways(monkeypatch, run):
    def rows():
        out = run()
        return sorted(out.select(*sorted(out.columns)).collect(), key=str)

    with monkeypatch.context() as m:
        m.setattr(permute, "replicates", None)  # replicates that are relations would fail here
        inside = rows()
    monkeypatch.setattr(shuffles, "HELD", 0)
    return inside, rows()


def equal(inside, relations):
    assert len(inside) == len(relations) > 0
    for x, y in zip(inside, relations, strict=True):
        x, y = x.asDict(), y.asDict()
        assert x.keys() == y.keys()
        for c in x:
            assert x[c] == (pytest.approx(y[c], abs=2e-9) if isinstance(y[c], float) else y[c]), (c, x, y)


def test_digests_are_md5():
    ids = np.unique(np.concatenate([np.arange(1200), np.random.default_rng(1).integers(0, 2**62, 500), [10**17, 10**18 - 1, 10**18, 2**63 - 1]]).astype(np.int64))
    for prefix, at in (("7:1:", ids), ("7:123:", ids), ("1234567890123:9999999:", ids), ("x" * 60, ids[:40]), ("7:3:", np.concatenate([[-12, -3], ids[:9]]))):
        high, low = shuffles.digests(prefix, at)
        assert [f"{h:016x}{x:016x}" for h, x in zip(high.tolist(), low.tolist(), strict=True)] == [hashlib.md5(f"{prefix}{x}".encode()).hexdigest() for x in at.tolist()]


def test_draws_are_those_of_the_relations(spark, samples):
    at = samples[0].where("sample = 'a' and g is not null").orderBy("spot").collect()
    draw = shuffles.Draws(np.array([r["spot"] for r in at]), 7, np.array([r["g"] for r in at]))
    got = {(p, at[k]["spot"]): at[x]["c"] for p in range(6) for k, x in enumerate(draw(p))}
    assert got == {(r["perm"], r["spot"]): r["c"] for r in permute.replicates(samples[0].where("sample = 'a'"), "c", 5, 7, F.col("g")).collect()}


def test_equal_digests_keep_the_order_of_spots(monkeypatch):
    monkeypatch.setattr(shuffles, "digests", lambda prefix, ids: (np.array([5, 5, 1, 5], np.uint64), np.array([2, 1, 9, 1], np.uint64)))
    assert shuffles.Draws(np.arange(4), 7)(1).tolist() == [2, 1, 3, 0]


@pytest.mark.parametrize("group", [None, "g"])
def test_categorical_enrichment_in_both_ways(monkeypatch, samples, group):
    equal(*both_ways(monkeypatch, lambda: permute.categorical_enrichment(samples[0], samples[1], 30, 7, None if group is None else F.col(group))))


def test_binary_association_in_both_ways(monkeypatch, samples):
    spots, edges = samples
    masks = spots.selectExpr("sample", "spot", "'m' as mask", "m as on").unionByName(spots.where("label is not null").selectExpr("sample", "spot", "'k' as mask", "k as on"))
    equal(*both_ways(monkeypatch, lambda: permute.binary_association(masks, edges, [("m", "m"), ("m", "k"), ("k", "m")], 30, 7)))


def test_masks_with_missing_values_in_both_ways(monkeypatch, samples):
    """They are shuffled in tasks, too; where nothing is known, nothing is counted."""
    spots, edges = samples
    masks = spots.selectExpr("sample", "spot", "'m' as mask", "if(spot % 5 = 0, null, m) as on").unionByName(spots.selectExpr("sample", "spot", "'k' as mask", "if(sample = 'b', null, label = 'x') as on"))
    masks = masks.unionByName(spots.selectExpr("sample", "spot", "'never' as mask", "cast(null as boolean) as on")).unionByName(spots.selectExpr("sample", "spot", "'off' as mask", "if(spot = 0, null, false) as on"))
    inside, relations = both_ways(monkeypatch, lambda: permute.binary_association(masks, edges, [("m", "m"), ("m", "k"), ("k", "m"), ("m", "never"), ("off", "m"), ("never", "never")], 30, 7))
    equal(inside, relations)
    assert {r["observed"] for r in inside if r["mask_a"] == "never"} == {None}
    assert {r["observed"] for r in inside if r["mask_a"] == "off"} == {0.0}


def test_continuous_edge_stats_in_both_ways(monkeypatch, samples):
    equal(*both_ways(monkeypatch, lambda: permute.continuous_edge_stats(samples[0], samples[1], [("c", "s"), ("c", "c")], 30, 7)))


def test_interaction_null_in_both_ways(monkeypatch, samples):
    spots, edges = samples
    units = spots.select("sample", "spot", F.expr("c / 10").alias("cu"), F.expr("round(pmod(spot, 11) / 10, 9)").alias("su"))
    equal(*both_ways(monkeypatch, lambda: permute.interaction_null(units, edges, 30, 7)))


def test_samples_of_both_kinds_and_gaps(monkeypatch, samples):
    spots, edges = samples
    units = spots.select("sample", "spot", F.expr("c / 10").alias("cu"), F.expr("if(sample = 'a' and spot = 37, null, c / 10)").alias("su"))
    whole = sorted(permute.interaction_null(units, edges, 9, 7).collect(), key=str)  # sample a has a gap, so it goes by relations
    monkeypatch.setattr(shuffles, "HELD", 0)
    equal(whole, sorted(permute.interaction_null(units, edges, 9, 7).collect(), key=str))


def test_no_replicate_leaves_a_task(spark, monkeypatch):
    """The registered queries make no relation of spots times replicates."""
    monkeypatch.setattr(permute, "replicates", None)
    for name, rows in (("categorical_enrichment", 15), ("categorical_enrichment_in_strata", 15), ("empirical_p", 15), ("bh_fdr", 15), ("binary_association", 6), ("binary_split_exports", 3), ("continuous_edge_stats", 2), ("interaction_null", 500)):
        assert iq.QUERIES[name](spark, SF).count() == rows, name


@pytest.mark.parametrize("name", ["empirical_p", "bh_fdr", "binary_split_exports"])
def test_missing_values_equal_sql_without_relations(spark, monkeypatch, tmp_path, name):
    """Without missing labels for enrichment: the operator, like the reference, leaves such spots out, SQL's least() does not."""
    segment = "if(c_custkey % 11 = 3, null, c_mktsegment)" if name == "binary_split_exports" else "c_mktsegment"
    db = duckdb.connect()
    db.execute(f"create table customer as select * replace (if(c_custkey % 7 = 5, null, c_acctbal) as c_acctbal, {segment} as c_mktsegment) from '{SF}/customer.parquet'")
    db.execute(f"copy customer to '{tmp_path}/customer.parquet' (format parquet)")
    monkeypatch.setattr(permute, "replicates", None)
    got = iq.QUERIES[name](spark, str(tmp_path))
    columns = sorted(got.columns, key=lambda c: (got.schema[c].dataType.simpleString() != "string", c))  # keys come first
    told = db.execute(f"select {', '.join(columns)} from ({iq.ORACLES[name]}) order by all").fetchall()
    rows = sorted(map(tuple, got.select(*columns).collect()), key=str)
    assert len(rows) == len(told) > 0
    for x, y in zip(rows, told, strict=True):
        assert x == tuple(pytest.approx(v, abs=2e-6) if isinstance(v, float) else v for v in y)
