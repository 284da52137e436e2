"""Joins of places: not broadcast, each pair once."""

from spotfield.operators import neighbors
from spotfield.plans import field_queries as fq

SF = "/root/testdata/sf0.001"


def test_places_are_not_broadcast(spark):
    """The files of spots are small for the rows they hold; Spark would send them all to the driver."""
    for edges in (fq.QUERIES["lattice_ring2"](spark, SF), fq.QUERIES["lattice_graph"](spark, SF), fq.hexagons(spark, SF)):
        assert "Broadcast" not in edges._jdf.queryExecution().sparkPlan().toString()


def test_rings_give_each_pair_once(spark):
    spots = spark.createDataFrame([("a", 100 - i, r, 2 * c + r % 2) for i, (r, c) in enumerate((r, c) for r in range(5) for c in range(5))] + [("a", 200, 0, 0)], "sample string, spot long, array_row int, array_col int")
    last = {(r["array_row"], r["array_col"]): r["spot"] for r in spots.orderBy("spot").collect()}
    want = sorted((s, last[r + a, c + b]) for (r, c), s in last.items() for a, b in neighbors.ring_offsets(2) if s < last.get((r + a, c + b), -1))
    assert sorted(map(tuple, neighbors.lattice_graph(spots, 2).select("i", "j").collect())) == want
