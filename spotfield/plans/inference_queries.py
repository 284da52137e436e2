"""Queries over permutation, enrichment and context operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich as en
from ..operators import matrix as mm
from ..operators import neighbors as nn
from ..operators import permute as pm
from ..sources import adapters as ad
from . import field_queries as fq
from .support import CNT, HEXE, HV, MASKS, MATRIX, PAIR, SPOTS, SYM, r, rounded

QUERIES, ORACLES = {}, {}
P, P_INTERACTION, SEED = 999, 499, 7  # the reference's defaults: graph, interaction


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _reps(table: str, column: str, group: str = "0", permutations: int = P) -> str:
    """Replicates of a column in SQL; replicate 0 as given."""
    return f"""mm_{column} AS (SELECT spot, {column} AS v, {group} AS grp, perm FROM {table}, range(1, {permutations + 1}) x(perm) WHERE ({group}) IS NOT NULL),
rp_{column} AS (SELECT 0 AS perm, spot, {column} AS v FROM {table} WHERE ({group}) IS NOT NULL UNION ALL SELECT a.perm, a.spot, b.v FROM (SELECT *, row_number() OVER (PARTITION BY perm, grp ORDER BY spot) AS n FROM mm_{column}) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY perm, grp ORDER BY md5(concat_ws(':', {SEED}, perm, spot)), spot) AS n FROM mm_{column}) b USING (perm, grp, n))"""


def _infer(stats: str, keys: str, extra: str = "", positive: str = "enriched", negative: str = "depleted", names: str = "") -> str:
    """SQL of the inference over stats(perm, keys, n)."""
    return f"""i0 AS (SELECT {keys}, max(n) FILTER (perm = 0) AS observed, avg(n) FILTER (perm > 0) AS expected, stddev_samp(n) FILTER (perm > 0) AS sd FROM {stats} GROUP BY {keys}),
i1 AS (SELECT {keys}, sum(CAST(abs(n - expected) >= abs(observed - expected) - 1e-12 AS BIGINT)) AS far, count(n) AS cnt FROM {stats} JOIN i0 USING ({keys}) WHERE perm > 0 GROUP BY {keys}),
i2 AS (SELECT *, (observed - expected) / nullif(sd, 0) AS z, (far + 1) / (cnt + 1) AS p FROM i0 JOIN i1 USING ({keys})),
i3 AS (SELECT *, p * count(p) OVER () / rank_last AS raw FROM (SELECT *, count(p) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank_last FROM i2)),
i4 AS (SELECT *, least(1, min(raw) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM i3)
SELECT 'cust' AS sample, {keys}, {r('observed', 'observed')}, {r('expected', 'expected')}, {r('sd', 'permutation_sd')}, {r('z', 'z')}, {r('p', 'empirical_p')}, {r('q', 'q_value_bh_fdr')},
CASE WHEN q <= 0.05 AND z > 0 THEN '{positive}' WHEN q <= 0.05 AND z < 0 THEN '{negative}' ELSE 'neutral_or_inconclusive' END AS association_direction{extra} FROM i4"""


def _categorical_sql(group: str) -> str:
    return f"""WITH {SPOTS}, {PAIR}, {HEXE}, {_reps('spots', 'label', group)},
ct AS (SELECT a.perm, least(a.v, b.v) AS label_a, greatest(a.v, b.v) AS label_b, count(*) AS n FROM e JOIN rp_label a ON a.spot = e.i JOIN rp_label b ON b.spot = e.j AND b.perm = a.perm GROUP BY 1, 2, 3),
st AS (SELECT DISTINCT label AS l FROM spots), grid AS (SELECT a.l AS label_a, b.l AS label_b, perm FROM st a JOIN st b ON a.l <= b.l, range(0, {P + 1}) x(perm)),
full_ AS (SELECT grid.*, CAST(coalesce(n, 0) AS DOUBLE) AS n FROM grid LEFT JOIN ct USING (perm, label_a, label_b)),
{_infer('full_', 'label_a, label_b', f", {r('observed / nullif(expected, 0)', 'observed_expected_ratio')}, CASE WHEN z IS NULL THEN 'not_interpretable' WHEN z >= 0 THEN 'enrichment' ELSE 'depletion' END AS interpretation")}"""


@query(_categorical_sql("0"))
def categorical_enrichment(s, d):
    return pm.categorical_enrichment(fq.spots(s, d), fq.hexagons(s, d), P, SEED)


@query(_categorical_sql("stratum"))
def categorical_enrichment_in_strata(s, d):
    return pm.categorical_enrichment(fq.spots(s, d), fq.hexagons(s, d), P, SEED, F.col("stratum"))


PAIRS = [("positive", "positive"), ("positive", "machinery"), ("machinery", "machinery")]


def _masks(s, d):
    at = fq.spots(s, d)
    return at.select("sample", "spot", F.lit("positive").alias("mask"), F.col("mask").alias("on")).unionByName(at.select("sample", "spot", F.lit("machinery").alias("mask"), (F.col("label") == "MACHINERY").alias("on")))


_BINARY = f"""WITH {SPOTS}, {PAIR}, {HEXE}, k AS (SELECT spot, mask AS positive, label = 'MACHINERY' AS machinery FROM spots), {_reps('k', 'positive')}, {_reps('k', 'machinery')},
a AS (SELECT spot, 'positive' AS mask_a, positive AS a FROM k UNION ALL SELECT spot, 'machinery', machinery FROM k), b AS (SELECT perm, spot, 'positive' AS mask_b, v AS b FROM rp_positive UNION ALL SELECT perm, spot, 'machinery', v FROM rp_machinery),
ab AS (SELECT perm, spot, mask_a, mask_b, a, b FROM a JOIN b USING (spot) WHERE NOT (mask_a = 'machinery' AND mask_b = 'positive')),
st AS (SELECT perm, mask_a, mask_b, 'same_spot_overlap' AS mode, CAST(sum(CAST(a AND b AS INT)) AS DOUBLE) AS n FROM ab GROUP BY 1, 2, 3 UNION ALL
  SELECT x.perm, x.mask_a, x.mask_b, 'neighboring_association', CAST(sum(CAST((x.a AND y.b) OR (x.b AND y.a) AS INT)) AS DOUBLE) FROM e JOIN ab x ON x.spot = e.i JOIN ab y ON y.spot = e.j AND y.perm = x.perm AND y.mask_a = x.mask_a AND y.mask_b = x.mask_b GROUP BY 1, 2, 3),
{_infer('st', 'mask_a, mask_b, mode')}"""


@query(_BINARY)
def binary_association(s, d):
    return pm.binary_association(_masks(s, d), fq.hexagons(s, d), PAIRS, P, SEED)


@query(f"SELECT * FROM ({_BINARY}) WHERE mode = 'neighboring_association'")
def binary_split_exports(s, d):
    return binary_association(s, d).where("mode = 'neighboring_association'")


@query(f"""WITH {MASKS}, {_reps('cs', 's')}, {_reps('cs', 'r')},
st AS (SELECT a.perm, 'I_CS' AS statistic, avg(0.5 * (x.c * b.v + a.v * y.c)) AS n FROM e JOIN rp_s a ON a.spot = e.i JOIN rp_s b ON b.spot = e.j AND b.perm = a.perm JOIN cs x ON x.spot = e.i JOIN cs y ON y.spot = e.j GROUP BY 1
  UNION ALL SELECT a.perm, 'I_RR', avg(0.5 * (x.r * b.v + a.v * y.r)) FROM e JOIN rp_r a ON a.spot = e.i JOIN rp_r b ON b.spot = e.j AND b.perm = a.perm JOIN cs x ON x.spot = e.i JOIN cs y ON y.spot = e.j GROUP BY 1),
{_infer('st', 'statistic', positive='above_null', negative='below_null')}""")
def continuous_edge_stats(s, d):
    e = nn.edge_weights(nn.knn_graph(fq.spots(s, d), 6), "binary")
    return pm.continuous_edge_stats(fq.scores(s, d), e, [("c", "s"), ("r", "r")], P, SEED)


@query(f"SELECT sample, label_a, label_b, empirical_p FROM ({_categorical_sql('0')})")
def empirical_p(s, d):
    return categorical_enrichment(s, d).select("sample", "label_a", "label_b", "empirical_p")


@query(f"SELECT sample, label_a, label_b, empirical_p, q_value_bh_fdr FROM ({_categorical_sql('0')})")
def bh_fdr(s, d):
    return categorical_enrichment(s, d).select("sample", "label_a", "label_b", "empirical_p", "q_value_bh_fdr")


def _units(s, d):
    both = mm.robust_unit(mm.robust_unit(fq.scores(s, d), "c", "cu"), "s", "su")
    return both.select("sample", "spot", F.round("cu", 9).alias("cu"), F.round("su", 9).alias("su"))


_UNITS = """qq AS (SELECT quantile_cont(c, 0.05) AS c0, quantile_cont(c, 0.95) AS c1, quantile_cont(s, 0.05) AS s0, quantile_cont(s, 0.95) AS s1 FROM cs),
un AS (SELECT spot, round(greatest(0, least(1, (c - c0) / (c1 - c0))), 9) AS cu, round(greatest(0, least(1, (s - s0) / (s1 - s0))), 9) AS su FROM cs, qq)"""


def _interaction_sql(units: str) -> str:
    return f"""ar AS (SELECT u.perm, sym.i AS spot, u.cu, u.su FROM sym JOIN {units} u ON u.spot = sym.j UNION ALL SELECT perm, spot, cu, su FROM {units}),
lo AS (SELECT perm, spot, round(avg(cu), 9) AS lc, round(avg(su), 9) AS ls FROM ar GROUP BY 1, 2),
ix AS (SELECT perm, avg(least(lc, ls)) AS coexistence, avg(abs(lc - ls)) AS antagonism, avg(1 - abs(lc - ls) / (lc + ls + 1e-9)) AS balance, sum(least(lc, ls)) / (sum(greatest(lc, ls)) + 1e-9) AS overlap FROM lo GROUP BY 1),
ro AS (SELECT perm, spot, CASE WHEN greatest(lc, ls) < 0.5 THEN NULL WHEN round(lc - ls, 9) >= 0.15 THEN 1 WHEN round(lc - ls, 9) <= -0.15 THEN -1 END AS role FROM lo),
mx AS (SELECT a.perm, avg(CAST(a.role * b.role = -1 AS INT)) AS dominance_mixing, count(*) AS informative_edges FROM e JOIN ro a ON a.spot = e.i AND a.role IS NOT NULL JOIN ro b ON b.spot = e.j AND b.perm = a.perm AND b.role IS NOT NULL GROUP BY 1)"""


_INDICES = ("coexistence", "antagonism", "balance", "overlap", "dominance_mixing")


@query(f"WITH {MASKS}, {_UNITS}, u0 AS (SELECT 0 AS perm, * FROM un), {_interaction_sql('u0')} SELECT 'cust' AS sample, {', '.join(r(x, x) for x in _INDICES)}, informative_edges FROM ix LEFT JOIN mx USING (perm)")
def interaction_indices(s, d):
    return pm.interaction_values(_units(s, d).withColumn("perm", F.lit(0)), nn.knn_graph(fq.spots(s, d), 6)).drop("perm")


@query(f"WITH {MASKS}, {_UNITS}, {_reps('un', 'su', permutations=P_INTERACTION)}, u0 AS (SELECT p.perm, p.spot, un.cu, p.v AS su FROM rp_su p JOIN un USING (spot)), {_interaction_sql('u0')} SELECT 'cust' AS sample, CAST(perm AS INT) AS perm, {', '.join(r(x, x) for x in _INDICES)}, informative_edges FROM ix LEFT JOIN mx USING (perm)")
def interaction_null(s, d):
    return pm.interaction_null(_units(s, d), nn.knn_graph(fq.spots(s, d), 6), P_INTERACTION, SEED)


@query(f"""WITH {MASKS}, {_UNITS}, u0 AS (SELECT 0 AS perm, * FROM un), {_interaction_sql('u0')} SELECT 'cust' AS sample, spot, {r('cu', 'cx_unit')}, {r('su', 'sx_unit')}, {r('lc', 'local_cx')}, {r('ls', 'local_sx')}, {r('least(lc, ls)', 'local_coexistence')}, {r('abs(lc - ls)', 'local_antagonism')} FROM un JOIN lo USING (spot)""")
def interaction_spot_table(s, d):
    u, e = _units(s, d), nn.knn_graph(fq.spots(s, d), 6)
    c, x = (nn.mean_smooth(u, e, n).withColumn(n, F.round(n, 9)) for n in ("cu", "su"))
    rows = u.select("sample", "spot", F.col("cu").alias("cx_unit"), F.col("su").alias("sx_unit")).join(c.withColumnRenamed("cu", "local_cx"), ["sample", "spot"]).join(x.withColumnRenamed("su", "local_sx"), ["sample", "spot"])
    return rows.withColumn("local_coexistence", F.least("local_cx", "local_sx")).withColumn("local_antagonism", F.abs(F.col("local_cx") - F.col("local_sx")))


# ---------------------------------------------------------------- groups and context

_GROUPED = f"WITH {MATRIX}, x AS (SELECT z.program, z.gene, z.e, spots.mask AS inside FROM z JOIN spots USING (spot))"
_HEDGES = "(avg(e) FILTER (inside) - avg(e) FILTER (NOT inside)) / sqrt(((count(*) FILTER (inside) - 1) * var_samp(e) FILTER (inside) + (count(*) FILTER (NOT inside) - 1) * var_samp(e) FILTER (NOT inside)) / (count(*) - 2)) * (1 - 3.0 / (4 * count(*) - 9))"


@query(f"{_GROUPED} SELECT 'cust' AS sample, gene, {r(_HEDGES, 'hedges_g')} FROM x GROUP BY gene")
def hedges_g(s, d):
    v = fq.zscores(s, d).join(fq.spots(s, d).select("sample", "spot", "mask"), ["sample", "spot"])
    return v.groupBy("sample", "gene").agg(en.hedges_g("e", "mask").alias("hedges_g"))


_MWU = f"""{_GROUPED}, rk AS (SELECT gene, inside, rank() OVER (PARTITION BY gene ORDER BY e) + (count(*) OVER (PARTITION BY gene, e) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY gene, e) AS t FROM (SELECT gene, inside, round(e, 9) AS e FROM x)),
sm AS (SELECT gene, count(*) FILTER (inside) AS n1, count(*) FILTER (NOT inside) AS n2, sum(rk) FILTER (inside) AS r1, sum(CAST(t * t - 1 AS DOUBLE)) AS ties FROM rk GROUP BY gene),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM sm)"""


@query(f"{_MWU} SELECT 'cust' AS sample, gene, n1, n2, {r('u', 'u')}, {r('(abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12.0 * (n + 1 - ties / (n * (n - 1))))', 'z')} FROM u")
def mannwhitney_u(s, d):
    v = fq.zscores(s, d).withColumn("e", F.round("e", 9)).join(fq.spots(s, d).select("sample", "spot", "mask"), ["sample", "spot"])
    return en.mannwhitney(v, ["sample", "gene"], "e", "mask").select("sample", "gene", "n1", "n2", "u", "z")


@query(f"""WITH {MASKS}, x AS (SELECT z.program, z.gene, z.e, m.interface AS inside FROM z JOIN m USING (spot)),
y AS (SELECT program, gene, count(*) FILTER (inside) AS n_interface, count(*) FILTER (NOT inside) AS n_noninterface, avg(e) FILTER (inside) AS a, avg(e) FILTER (NOT inside) AS b, greatest(0, -min(e)) AS sh, greatest(1e-12, 1e-6 * quantile_cont(abs(e), 0.5)) AS ps, {_HEDGES} AS g FROM x GROUP BY 1, 2)
SELECT 'cust' AS sample, program, gene, n_interface, n_noninterface, {r('a', 'mean_interface')}, {r('b', 'mean_noninterface')}, {r('g', 'hedges_g')}, {r('a - b', 'mean_difference')}, {r('(a + sh + ps) / (b + sh + ps)', 'fold_enrichment')}, {r('log2((a + sh + ps) / (b + sh + ps))', 'log2_fold_enrichment')} FROM y""")
def interface_enrichment(s, d):
    return en.interface_enrichment(fq.zscores(s, d), fq.masked(s, d)).drop("mannwhitney_u", "mannwhitney_p", "mannwhitney_fdr_bh", "significant_fdr_0_05")


@query()
def interface_enrichment_tests(s, d):
    """The same table with the Mann-Whitney p, which SQL has no error function for."""
    return en.interface_enrichment(fq.zscores(s, d), fq.masked(s, d))


def _hv(s):
    return ad.program_table(s, H=ad.H_GENES, V=ad.V_GENES)


def _context(s, d):
    return mm.gene_zscore(mm.dense(fq.spots(s, d), ad.customer_expr(s, d), _hv(s)))


_CTX = f"""WITH {SPOTS}, {CNT}, {HV}, hd AS (SELECT s.spot, p.program, p.gene, ln(1 + coalesce(x.v, 0)) AS e FROM spots s CROSS JOIN (SELECT * FROM hv WHERE gene IN (SELECT gene FROM cnt)) p LEFT JOIN cnt x ON x.spot = s.spot AND x.gene = p.gene),
hz AS (SELECT hd.*, (e - avg(e) OVER (PARTITION BY gene)) / coalesce(nullif(stddev_pop(e) OVER (PARTITION BY gene), 0), 1) AS z, (rank() OVER (PARTITION BY gene ORDER BY e) + (count(*) OVER (PARTITION BY gene, e) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY gene) - 1) AS rq FROM hd)"""


def _score_query(name: str, mode: str, column: str):
    def run(s, d):
        return en.context_scores(_context(s, d), mode)

    run.__name__ = name
    query(f"{_CTX} SELECT 'cust' AS sample, spot, program, {r(f'round(avg({column}), 9)', 'score')} FROM hz GROUP BY spot, program")(run)


for _n, _m, _c in (("context_score_raw_mean", "raw_mean", "e"), ("context_score_z_mean", "z_score_mean", "z"), ("context_score_rank", "rank_quantile", "rq")):
    _score_query(_n, _m, _c)


@query(f"{_CTX}, dt AS (SELECT gene, avg(CAST(e > 0 AS INT)) AS f FROM hd GROUP BY 1) SELECT 'cust' AS sample, program AS field, gene, CAST(requested_order AS INT) AS requested_order, CASE WHEN f IS NULL THEN 'missing' ELSE 'present' END AS status, {r('f', 'detection_fraction')}, coalesce(f >= 0.01, false) AS expressed FROM hv LEFT JOIN dt USING (gene)")
def context_coverage(s, d):
    return en.context_coverage(_context(s, d), _hv(s))


@query(f"""{_CTX}, w AS (SELECT *, sum(z) OVER p / count(*) OVER p AS whole, (sum(z) OVER p - z) / nullif(count(*) OVER p - 1, 0) AS wo FROM hz WINDOW p AS (PARTITION BY spot, program)),
g AS (SELECT program, gene, covar_pop(whole, wo) / (stddev_pop(whole) * stddev_pop(wo)) AS c, avg(abs(whole - wo)) AS a, var_pop(wo) - var_pop(whole) AS v FROM w GROUP BY 1, 2)
SELECT 'cust' AS sample, program, gene, {r('c', 'loo_correlation')}, {r('a', 'loo_mean_abs_change')}, {r('v', 'loo_variance_change')}, CAST(row_number() OVER (PARTITION BY program ORDER BY round(a, 9) DESC, gene) AS INT) AS influence_rank FROM g""")
def context_loo(s, d):
    return en.leave_one_out(_context(s, d))


@query(f"""{_CTX}, sc AS (SELECT spot, round(avg(z) FILTER (program = 'H'), 9) AS h, round(avg(z) FILTER (program = 'V'), 9) AS v FROM hz GROUP BY 1), t AS (SELECT quantile_cont(h, 0.8) AS th, quantile_cont(v, 0.8) AS tv FROM sc)
SELECT 'cust' AS sample, spot, {r('h', 'h')}, {r('v', 'v')}, h >= th AS h_high, v >= tv AS v_high, 'H_' || CASE WHEN h >= th THEN 'high' ELSE 'low' END || '_V_' || CASE WHEN v >= tv THEN 'high' ELSE 'low' END AS joint_state FROM sc, t""")
def hv_joint_state(s, d):
    return en.joint_state(en.context_scores(_context(s, d), "z_score_mean"))
