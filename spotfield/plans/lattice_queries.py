"""Queries over the lattice engine, with their SQL."""

from __future__ import annotations

from ..functions.durable import durable
from ..operators import lattice as lt
from ..sources import adapters as ad
from . import field_queries as fq
from .support import CNT, PROG, SPOTS, r, rounded

QUERIES, ORACLES = {}, {}
#: The test matrix has 25 genes, so few of them have to be detected.
MIN_GENES, GENE_MIN_SPOTS = 12, 10

PRE = f"""{SPOTS}, {CNT}, {PROG}, rich AS (SELECT spot FROM cnt WHERE v > 0 GROUP BY 1 HAVING count(*) > {MIN_GENES}), ins AS (SELECT * FROM cnt WHERE v > 0 AND spot IN (FROM rich)),
com AS (SELECT gene FROM ins GROUP BY 1 HAVING count(*) >= {GENE_MIN_SPOTS}), kept AS (SELECT * FROM ins WHERE gene IN (FROM com)),
pre AS (SELECT spot, gene, ln(1 + v * 10000 / sum(v) OVER (PARTITION BY spot)) AS value FROM kept)"""
MEAN = f"""{PRE}, has AS (SELECT program, gene FROM prog WHERE gene IN (FROM com)), pm AS (SELECT s.spot, array_row, array_col,
  coalesce(sum(value) FILTER (program = 'C') / (SELECT count(*) FROM has WHERE program = 'C'), 0) AS c, coalesce(sum(value) FILTER (program = 'S') / (SELECT count(*) FROM has WHERE program = 'S'), 0) AS b
  FROM spots s JOIN rich USING (spot) LEFT JOIN (SELECT spot, program, value FROM pre JOIN has USING (gene)) x ON x.spot = s.spot GROUP BY ALL)"""
_Q = lambda x: f"CASE WHEN h{x} - l{x} < 1e-9 THEN 0 ELSE least(1, greatest(0, ({x} - l{x}) / (h{x} - l{x} + 1e-9))) END AS {x}"
SCALED = f"{MEAN}, qs AS (SELECT spot, array_row, array_col, {_Q('c')}, {_Q('b')} FROM pm, (SELECT quantile_cont(c, 0.05) AS lc, quantile_cont(c, 0.95) AS hc, quantile_cont(b, 0.05) AS lb, quantile_cont(b, 0.95) AS hb FROM pm))"
CELLS = f"""{SCALED}, box AS (SELECT min(array_row) AS r0, min(array_col) AS c0, max(array_row) - min(array_row) + 1 AS height, max(array_col) - min(array_col) + 1 AS width FROM qs),
cell AS (SELECT array_row - r0 AS "row", array_col - c0 AS col, height, width, avg(c) AS c, avg(b) AS b FROM qs, box GROUP BY ALL)"""
_MIRROR = lambda i, n: f"CASE WHEN (({i}) + 2 * {n}) % (2 * {n}) < {n} THEN (({i}) + 2 * {n}) % (2 * {n}) ELSE 2 * {n} - 1 - (({i}) + 2 * {n}) % (2 * {n}) END"
SMOOTH = f"""{CELLS}, ker AS (SELECT i, j, exp(-(i * i + j * j) / (2 * 0.8 * 0.8)) AS w FROM range(-3, 4) a(i), range(-3, 4) b(j)),
sm AS (SELECT t."row", t.col, t.height, t.width, round(sum(w * f.c) / sum(w), 9) AS c, round(sum(w * f.b) / sum(w), 9) AS b FROM cell t, ker, cell f WHERE f."row" = {_MIRROR('t."row" + i', 't.height')} AND f.col = {_MIRROR('t.col + j', 't.width')} GROUP BY ALL)"""
_AT = lambda x, row, col: f'coalesce((SELECT {x} FROM sm o WHERE o."row" = {row} AND o.col = {col}), 0)'
_UP, _DOWN, _LEFT, _RIGHT = 'greatest(t."row" - 1, 0)', 'least(t."row" + 1, t.height - 1)', "greatest(t.col - 1, 0)", "least(t.col + 1, t.width - 1)"
_DY = lambda x: f"""coalesce(({_AT(x, _DOWN, 't.col')} - {_AT(x, _UP, 't.col')}) / nullif({_DOWN} - {_UP}, 0), 0)"""
_DX = lambda x: f"""coalesce(({_AT(x, 't."row"', _RIGHT)} - {_AT(x, 't."row"', _LEFT)}) / nullif({_RIGHT} - {_LEFT}, 0), 0)"""
GRAD = f"""{SMOOTH}, gr AS (SELECT "row", col, height, width, c, b, round(sqrt(cy * cy + cx * cx) * sqrt(by_ * by_ + bx * bx), 9) AS g FROM (SELECT t.*, {_DY('c')} AS cy, {_DX('c')} AS cx, {_DY('b')} AS by_, {_DX('b')} AS bx FROM sm t))"""
FACE = f"""{GRAD}, th AS (SELECT quantile_cont(c, 0.8) AS c_threshold, quantile_cont(b, 0.8) AS b_threshold, quantile_cont(g, 0.6) AS g_threshold FROM gr),
fa AS (SELECT gr.*, th.*, c > c_threshold AND b > b_threshold AND g > g_threshold AS interface FROM gr, th)"""
DIST = f"""{FACE}, di AS (SELECT fa.*, (SELECT sqrt(min((o."row" - fa."row") * (o."row" - fa."row") + (o.col - fa.col) * (o.col - fa.col))) FROM fa o WHERE o.interface) AS distance FROM fa)"""
ROWS = f"""{DIST}, ro AS (SELECT s.spot, di.*, di.c - di.b AS r FROM qs s, box, di WHERE di."row" = s.array_row - r0 AND di.col = s.array_col - c0)"""
FIT = f"""{ROWS}, ft AS (SELECT CASE WHEN n >= 30 THEN sf ELSE sa END AS slope, CASE WHEN n >= 30 THEN nf ELSE na END AS intercept, CASE WHEN n >= 30 THEN rf ELSE ra END AS fr FROM (SELECT count(*) FILTER (distance > 0) AS n, regr_slope(y, distance) FILTER (distance > 0) AS sf,
  regr_intercept(y, distance) FILTER (distance > 0) AS nf, corr(y, distance) FILTER (distance > 0) AS rf, regr_slope(y, distance) AS sa, regr_intercept(y, distance) AS na, corr(y, distance) AS ra FROM (SELECT *, ln(abs(r) + 1e-9) AS y FROM ro))),
al AS (SELECT *, greatest(-slope, 1e-9) AS alpha FROM ft), ig AS (SELECT sum(v) AS t, coalesce(sum(v) FILTER (r < 0), 0) AS l, coalesce(sum(v) FILTER (r > 0), 0) AS h FROM (SELECT r, r * exp(-alpha * distance) AS v FROM ro, al)),
de AS (SELECT (quantile_cont(b, 0.5) FILTER (interface) - quantile_cont(c, 0.5) FILTER (interface)) - (quantile_cont(b, 0.5) FILTER (NOT interface) - quantile_cont(c, 0.5) FILTER (NOT interface)) AS delta FROM ro)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return add


def prepared(s, d):
    return lt.preprocess(fq.spots(s, d), durable(ad.customer_expr(s, d)), MIN_GENES, GENE_MIN_SPOTS)


def scaled(s, d):
    spots, expr = prepared(s, d)
    return lt.qscaled(durable(lt.program_means(spots, expr, fq.programs(s))))


def cells(s, d):
    """Every later step reads its cells several times, so each is written once (there are fewer of them than stored values)."""
    return durable(lt.lattice(scaled(s, d)))


def smoothed(s, d):
    return durable(lt.smooth(cells(s, d)))


def sloped(s, d):
    return durable(lt.gradient(smoothed(s, d)))


def with_distance(s, d):
    return lt.distance(durable(lt.interface(sloped(s, d))))


def rows(s, d):
    return durable(lt.at_spots(with_distance(s, d), prepared(s, d)[0]))


@query(f"WITH {PRE} SELECT 'cust' AS sample, spot, gene, {r('value', 'value')} FROM pre")
def istz_preprocess(s, d):
    return prepared(s, d)[1]


@query(f"WITH {MEAN} SELECT 'cust' AS sample, spot, {r('c', 'c')}, {r('b', 'b')} FROM pm")
def istz_program_mean(s, d):
    spots, expr = prepared(s, d)
    return lt.program_means(spots, expr, fq.programs(s)).select("sample", "spot", "c", "b")


@query(f"WITH {SCALED} SELECT 'cust' AS sample, spot, {r('c', 'c')}, {r('b', 'b')} FROM qs")
def istz_qscale(s, d):
    return scaled(s, d).select("sample", "spot", "c", "b")


_CELL = "'cust' AS sample, \"row\", col"


@query(f"WITH {CELLS} SELECT {_CELL}, height, width, {r('c', 'c')}, {r('b', 'b')} FROM cell")
def istz_lattice(s, d):
    return cells(s, d)


@query(f"WITH {SMOOTH} SELECT {_CELL}, {r('c', 'c')}, {r('b', 'b')} FROM sm")
def istz_smooth(s, d):
    return smoothed(s, d).select(*lt.CELL, "c", "b")


@query(f"WITH {GRAD} SELECT {_CELL}, {r('c', 'c')}, {r('b', 'b')}, {r('g', 'g')} FROM gr")
def istz_gradient(s, d):
    return sloped(s, d).select(*lt.CELL, "c", "b", "g")


@query(f"WITH {FACE} SELECT {_CELL}, {r('c_threshold', 'c_threshold')}, {r('b_threshold', 'b_threshold')}, {r('g_threshold', 'g_threshold')}, interface FROM fa")
def istz_interface(s, d):
    return lt.interface(sloped(s, d)).select(*lt.CELL, "c_threshold", "b_threshold", "g_threshold", "interface")


@query(f"WITH {DIST} SELECT {_CELL}, {r('distance', 'distance')} FROM di")
def istz_distance(s, d):
    return with_distance(s, d).select(*lt.CELL, "distance")


@query(f"WITH {DIST} SELECT {_CELL}, interface, coalesce(distance <= 3, false) AS transition FROM di")
def istz_transition(s, d):
    return lt.transition(with_distance(s, d)).select(*lt.CELL, "interface", "transition")


_FITTED = ", ".join((r("alpha", "alpha"), r("1 / alpha", "lambda"), r("slope", "alpha_fit_slope"), r("intercept", "alpha_fit_intercept"), r("fr", "alpha_fit_r")))


@query(f"WITH {FIT} SELECT 'cust' AS sample, {_FITTED} FROM al")
def istz_decay_fit(s, d):
    return lt.decay_fit(rows(s, d))


_INTEGRALS = ", ".join((r("t", "I_total"), r("l", "I_bal"), r("h", "I_str")))


@query(f"WITH {FIT} SELECT 'cust' AS sample, {_INTEGRALS} FROM ig")
def istz_integrals(s, d):
    at = rows(s, d)
    return lt.integrals(at, lt.decay_fit(at))


@query(f"WITH {FIT} SELECT 'cust' AS sample, {r('delta', 'delta_interface')} FROM de")
def istz_delta_interface(s, d):
    return lt.delta_interface(rows(s, d))


@query(f"""WITH {FIT} SELECT 'cust' AS sample, n_spots, interface_detected, {r('fi', 'interface_fraction')}, {r('cb', 'C_B_correlation')}, {r('ct', 'c_threshold')}, {r('bt', 'b_threshold')}, {r('gt', 'g_threshold')}, (SELECT count(*) FROM com) AS n_genes, {_FITTED}, {_INTEGRALS}, {r('delta', 'delta_interface')},
CASE WHEN interface_detected THEN 'ok' ELSE 'no_interface' END AS qc_status FROM (SELECT count(*) AS n_spots, bool_or(interface) AS interface_detected, avg(CAST(interface AS INT)) AS fi, corr(c, b) AS cb, max(c_threshold) AS ct, max(b_threshold) AS bt, max(g_threshold) AS gt FROM ro), al, ig, de""")
def istz_metrics(s, d):
    return lt.metrics(rows(s, d), prepared(s, d)[1])
