import math

import numpy as np

from spotfield.operators import lattice as lt

CELLS = "sample string, row int, col int, height int, width int, c double, b double"


def cells(spark, rng, height=5, width=4, hole=(2, 1)):
    return spark.createDataFrame([(s, i, j, height, width, float(rng.random()), float(rng.random())) for s in ("p", "q") for i in range(height) for j in range(width) if (i, j) != hole], CELLS)


def grid(rows, x, height=5, width=4):
    out = np.full((height, width), np.nan)
    for r in rows:
        out[r["row"], r["col"]] = r[x]
    return out


def test_smoothing_and_gradient_against_dense_grids(spark):
    df = cells(spark, np.random.default_rng(1))
    smooth = lt.smooth(df, 0.8)
    rows, found, sloped = df.collect(), smooth.collect(), lt.gradient(smooth).collect()
    k = np.array([math.exp(-(i * i) / 1.28) for i in range(-3, 4)])
    for s in ("p", "q"):
        mine = lambda rs: [r for r in rs if r["sample"] == s]
        fields = {}
        for x in "cb":
            v = grid(mine(rows), x)
            pad = lambda a: np.pad(a, 3, mode="symmetric")
            top, low = pad(np.nan_to_num(v)), pad((~np.isnan(v)).astype(float))
            want = np.array([[(top[i : i + 7, j : j + 7] * np.outer(k, k)).sum() / (low[i : i + 7, j : j + 7] * np.outer(k, k)).sum() for j in range(4)] for i in range(5)])
            want[np.isnan(v)] = np.nan
            np.testing.assert_allclose(grid(mine(found), x), want, atol=1e-8)
            fields[x] = np.hypot(*np.gradient(np.nan_to_num(grid(mine(found), x))))
        want = np.where(np.isnan(v), np.nan, fields["c"] * fields["b"])
        np.testing.assert_allclose(grid(mine(sloped), "g"), want, atol=1e-8)


def test_distance_and_transition(spark):
    rows = [("p", i, j, 4, 6, (i, j) in ((0, 0), (3, 5))) for i in range(4) for j in range(6)] + [("none", 0, 0, 1, 1, False)]
    df = spark.createDataFrame(rows, "sample string, row int, col int, height int, width int, interface boolean")
    got = lt.transition(lt.distance(df), 2.0).collect()
    for r in got:
        want = None if r["sample"] == "none" else min(math.hypot(r["row"], r["col"]), math.hypot(r["row"] - 3, r["col"] - 5))
        assert r["distance"] == want and r["transition"] == (want is not None and want <= 2)


def test_distance_against_all_interface_cells(spark):
    rng, rows, marks = np.random.default_rng(5), [], {}
    for sample, height, width, share in (("few", 9, 23, 0.02), ("many", 17, 8, 0.4), ("line", 1, 30, 0.1), ("pole", 30, 1, 0.1)):
        inside = rng.random((height, width)) < 0.8
        marked = inside & (rng.random((height, width)) < share)
        inside[0, 0] = marked[0, 0] = True
        marks[sample] = np.argwhere(marked)
        rows += [(sample, int(i), int(j), height, width, bool(marked[i, j])) for i, j in np.argwhere(inside)]
    df = spark.createDataFrame(rows, "sample string, row int, col int, height int, width int, interface boolean")
    got = lt.distance(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["distance"] == math.sqrt(((marks[r["sample"]] - (r["row"], r["col"])) ** 2).sum(axis=1).min())
    assert lt.distance(df.limit(0)).count() == 0


def test_decay_integrals_and_empty(spark):
    rows = spark.createDataFrame([("p", float(d), math.exp(-0.5 * d) - 1e-9) for d in range(1, 41)], "sample string, distance double, r double")
    fit = lt.decay_fit(rows)
    one = fit.first()
    assert abs(one["alpha"] - 0.5) < 1e-9 and abs(one["lambda"] - 2) < 1e-8
    total = lt.integrals(rows, fit).first()
    assert total["I_bal"] == 0 and abs(total["I_total"] - sum(math.exp(-d) for d in range(1, 41))) < 1e-6
    assert lt.decay_fit(rows.limit(5)).first()["alpha"] is None
    assert lt.gradient(lt.smooth(spark.createDataFrame([], CELLS))).count() == 0
