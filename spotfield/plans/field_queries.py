"""Queries over matrix, neighbour and field operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fields as ff
from ..operators import matrix as mm
from ..operators import neighbors as nn
from ..functions.durable import durable
from ..operators.components import components_by_sample
from ..sources import adapters as ad
from .support import ADJ, CNT, DENSE, FIELDS, GRAPH, HEXE, MASKS, MATRIX, NN, PAIR, PROG, SPOTS, SYM, comp_sql, exact, r, rounded

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, decimals: int = 6):
    """Registers a query; results that an operator has rounded to 9 decimals are given so, not rounded again."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), decimals)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def spots(s, d):
    return ad.customer_spots(s, d)


def programs(s):
    return ad.program_table(s, C=ad.C_GENES, S=ad.S_GENES)


def expression(s, d):
    """The matrix, aggregated once: it is read for the genes that are there, its kind and its values."""
    return durable(ad.customer_expr(s, d))


def zscores(s, d):
    return mm.gene_zscore(durable(mm.dense(spots(s, d), expression(s, d), programs(s))))


def scores(s, d):
    return durable(mm.program_scores(zscores(s, d)))


def knn6(s, d):
    return durable(nn.knn_graph(spots(s, d), 6))


def hexagons(s, d):
    return nn.radius_graph(spots(s, d), 2.0)


def field_table(s, d, edges=None):
    return durable(ff.gradient(scores(s, d), knn6(s, d) if edges is None else edges))


def masked(s, d, edges=None):
    return durable(ff.masks(field_table(s, d, edges)))


@query(f"WITH {MATRIX} SELECT 'cust' AS sample, spot, program, gene, {r('e', 'e')}, {r('z', 'z')} FROM z")
def gene_zscore(s, d):
    return zscores(s, d).select("sample", "spot", "program", "gene", "e", "z")


@query(f"WITH {MATRIX} SELECT 'cust' AS sample, spot, {exact('c')}, {exact('s')}, {exact('r')} FROM cs", decimals=9)
def program_scores(s, d):
    return scores(s, d)


@query(f"WITH {GRAPH} SELECT 'cust' AS sample, i, j, {r('dist', 'dist')} FROM e")
def knn_graph(s, d):
    return nn.knn_graph(spots(s, d), 6)


@query(f"WITH {FIELDS} SELECT 'cust' AS sample, spot, {exact('c')}, {exact('s')}, {exact('r')}, {exact('g')} FROM f", decimals=9)
def gradient_field(s, d):
    return field_table(s, d)


@query(f"WITH {MATRIX} SELECT 'cust' AS sample, spot, {exact('c')}, c >= (SELECT quantile_cont(c, 0.8) FROM cs) AS high_c FROM cs", decimals=9)
def high_mask(s, d):
    return ff.high_mask(scores(s, d), "c", 0.8, "high_c").select("sample", "spot", "c", "high_c")


@query(f"WITH {MASKS} SELECT 'cust' AS sample, spot, {exact('c')}, {exact('s')}, {exact('r')}, {exact('g')}, high_c, high_s, high_g, interface, diffuse FROM m", decimals=9)
def field_masks(s, d):
    return masked(s, d)


def _metrics_sql(columns: str) -> str:
    part = lambda m: f"(SELECT count(*) AS n, coalesce(max(size) / sum(size), 0) AS l, coalesce(avg(CAST(size <= 3 AS INT)), 0) AS sm FROM co_{m}) AS {m[0]}"
    return f"""WITH RECURSIVE {MASKS}, {comp_sql('interface')}, {comp_sql('diffuse')}, {ADJ},
b AS (SELECT count(*) AS n_spots, avg(CAST(interface AS INT)) AS fi, sum(CAST(interface AS BIGINT)) AS ni, avg(CAST(diffuse AS INT)) AS fd, sum(CAST(diffuse AS BIGINT)) AS nd, avg(c) AS c_mean, avg(s) AS s_mean, avg(r) AS r_mean,
  stddev_pop(r) AS r_sd, quantile_cont(r, 0.9) - quantile_cont(r, 0.1) AS r_dyn, avg(g) AS g_mean, quantile_cont(g, 0.9) AS g_q90 FROM m),
x AS (SELECT b.*, i.n AS i_n, i.l AS i_l, i.sm AS i_sm, d.n AS d_n, d.l AS d_l, d.sm AS d_sm, adj.*, CASE WHEN fi >= 0.01 THEN 'Type A' WHEN fd >= 0.05 THEN 'Type B' ELSE 'Type C' END AS regime_label FROM b, {part('interface')}, {part('diffuse')}, adj)
SELECT {columns} FROM x"""


_PATTERN = "CASE WHEN regime_label <> 'Type B' THEN 'not_applicable' WHEN adj_zero_fraction >= 0.55 AND d_sm >= 0.2 AND d_l <= 0.35 THEN 'Fragmented' WHEN adj_same_fraction >= 0.8 AND adj_zero_fraction <= 0.2 THEN 'Continuous' ELSE 'Weakly organized' END"


@query(_metrics_sql(", ".join((
    "'cust' AS sample", "n_spots", r("fi", "interface_fraction"), "CAST(ni AS BIGINT) AS interface_spots", r("fd", "diffuse_fraction"), "CAST(nd AS BIGINT) AS diffuse_spots", r("c_mean", "c_mean"), r("s_mean", "s_mean"), r("r_mean", "r_mean"), r("r_sd", "r_sd"), r("r_dyn", "r_dynamic_range"), r("g_mean", "g_mean"), r("g_q90", "g_q90"),
    "i_n AS n_interface_components", r("i_l", "largest_interface_component_ratio"), r("i_sm", "interface_small_fraction"), r("fi * i_l", "interface_coherence_score"), "d_n AS n_diffuse_components", r("d_l", "largest_diffuse_component_ratio"), r("d_sm", "diffuse_small_fraction"), r("fd * d_l", "diffuse_coherence_score"),
    r("CASE WHEN ni > 0 THEN i_n / ni ELSE 0 END", "interface_fragmentation_index"), r("adj_same_fraction", "adj_same_fraction"), r("adj_zero_fraction", "adj_zero_fraction"), r("adj_opposite_fraction", "adj_opposite_fraction"), r("r_crossing_fraction", "r_crossing_fraction"),
    r("0.5 * fd + 0.25 * g_q90 + CASE WHEN nd > 0 THEN 0.25 * (1 - d_l) ELSE 0 END", "transition_burden_score"), "regime_label", _PATTERN + " AS public_transition_pattern"))))
def sample_metrics(s, d):
    e = knn6(s, d)
    return ff.sample_metrics(masked(s, d, e), e)


@query(_metrics_sql(f"'cust' AS sample, regime_label, {_PATTERN} AS public_transition_pattern"))
def regime_call(s, d):
    return sample_metrics(s, d).select("sample", "regime_label", "public_transition_pattern")


@query(f"WITH {CNT} SELECT 'cust' AS sample, min(v) AS min_value, max(v) AS max_value, min(v) >= 0 AND max(v) > 20 AS count_like FROM cnt UNION ALL SELECT 'emb', {r('min(v)')}, {r('max(v)')}, min(v) >= 0 AND max(v) > 20 FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)")
def count_like(s, d):
    return mm.count_like(ad.customer_expr(s, d).unionByName(ad.embedding_expr(s, d)))


@query(f"WITH {MATRIX} SELECT 'cust' AS sample, spot, {r('(c - avg(c) OVER ()) / stddev_pop(c) OVER ()', 'c')}, {r('(s - avg(s) OVER ()) / stddev_pop(s) OVER ()', 's')} FROM cs")
def normalize_zscore(s, d):
    return mm.normalize(scores(s, d), "z_score").select("sample", "spot", "c", "s")


_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0 - 0.5) / count(*) OVER ()"


@query(f"WITH {MATRIX} SELECT 'cust' AS sample, spot, {r(_RANK.format('c'), 'c')}, {r(_RANK.format('s'), 's')} FROM cs")
def normalize_rank(s, d):
    return mm.normalize(scores(s, d), "rank_quantile").select("sample", "spot", "c", "s")


@query(f"WITH {MATRIX}, q AS (SELECT quantile_cont(c, 0.05) AS lo, quantile_cont(c, 0.95) AS hi FROM cs) SELECT 'cust' AS sample, spot, {r('greatest(0, least(1, (c - lo) / (hi - lo)))', 'c_unit')} FROM cs, q")
def robust_unit(s, d):
    return mm.robust_unit(scores(s, d), "c", "c_unit").select("sample", "spot", "c_unit")


@query(f"""WITH {SPOTS}, {CNT}, {PROG}, p2 AS (SELECT * FROM prog UNION ALL SELECT 'C', 'Brand#99', 7), {DENSE}, st AS (SELECT program, gene, avg(e) AS m, quantile_cont(e, 0.5) AS md, avg(CAST(e > 0 AS INT)) AS de FROM dense GROUP BY 1, 2)
SELECT 'cust' AS sample, program, gene, CAST(requested_order AS INT) AS requested_order, CASE WHEN m IS NULL THEN 'missing' ELSE 'present' END AS status, {r('m', 'mean_expression')}, {r('md', 'median_expression')}, {r('de', 'detection_fraction')}, {r('coalesce(100 * m / sum(m) OVER (PARTITION BY program), 0)', 'relative_contribution_percent')}
FROM p2 LEFT JOIN st USING (program, gene)""")
def gene_composition(s, d):
    return mm.gene_composition(spots(s, d), ad.customer_expr(s, d), ad.program_table(s, C=(*ad.C_GENES, "Brand#99"), S=ad.S_GENES))


@query(f"WITH {CNT} SELECT 'cust' AS sample, spot, gene, {r('ln(1 + v * 1e4 / sum(v) OVER (PARTITION BY spot))', 'value')} FROM cnt")
def normalize_total_log1p(s, d):
    return mm.normalize_total_log1p(ad.customer_expr(s, d))


@query(f"WITH {CNT} SELECT 'cust' AS sample, gene, count(DISTINCT spot) AS n_spots FROM cnt WHERE v > 0 GROUP BY gene HAVING count(DISTINCT spot) >= 10")
def gene_qc_filter(s, d):
    return mm.gene_qc(ad.customer_expr(s, d), 10)


@query(f"""WITH {SPOTS}, {CNT}, v AS (SELECT gene, round(sum(ln(1 + v) * ln(1 + v)) / (SELECT count(*) FROM spots) - power(sum(ln(1 + v)) / (SELECT count(*) FROM spots), 2), 9) AS variance FROM cnt GROUP BY 1),
k AS (SELECT gene, variance, row_number() OVER (ORDER BY variance DESC, gene) AS rank FROM v) SELECT 'cust' AS sample, gene, {exact('variance')}, CAST(rank AS INT) AS rank FROM k WHERE rank <= 6""", decimals=9)
def adaptive_topk_genes(s, d):
    genes = sorted(f"Brand#{i}" for i in range(1, 60))
    return mm.adaptive_topk(spots(s, d), ad.customer_expr(s, d), ad.program_table(s, X=tuple(genes)).select("gene", "requested_order"), 6)


# ---------------------------------------------------------------- neighbours


@query(f"WITH {SPOTS}, {PAIR} SELECT 'cust' AS sample, i, j, {r('sqrt(d2)', 'dist')} FROM pair WHERE i < j AND d2 <= 12")
def radius_graph(s, d):
    return nn.radius_graph(spots(s, d), 12**0.5)


@query(f"WITH {SPOTS}, {PAIR} SELECT 'cust' AS sample, i, j FROM pair WHERE i < j AND d2 <= 4")
def lattice_graph(s, d):
    return nn.lattice_graph(spots(s, d))


@query(f"WITH {SPOTS}, {PAIR} SELECT 'cust' AS sample, i, j FROM pair WHERE i < j AND d2 <= 16")
def lattice_ring2(s, d):
    return nn.lattice_graph(spots(s, d), 2)


@query(f"WITH {SPOTS}, {PAIR}, {NN} SELECT DISTINCT 'cust' AS sample, least(i, j) AS i, greatest(i, j) AS j, {r('sqrt(d2)', 'dist')} FROM nn WHERE k <= 4")
def knn_union(s, d):
    return nn.knn_graph(spots(s, d), 4)


@query(f"WITH {SPOTS}, {PAIR}, {NN} SELECT 'cust' AS sample, least(i, j) AS i, greatest(i, j) AS j, {r('sqrt(min(d2))', 'dist')} FROM nn WHERE k <= 4 GROUP BY 2, 3 HAVING count(*) = 2")
def knn_mutual(s, d):
    return nn.knn_graph(spots(s, d), 4, mutual=True)


@query(f"WITH {GRAPH}, q AS (SELECT quantile_cont(dist, 0.5) AS sg FROM e WHERE dist > 0) SELECT 'cust' AS sample, i, j, {r('dist', 'dist')}, {r('1 / dist', 'inverse')}, {r('exp(-0.5 * (dist / sg) * (dist / sg))', 'gaussian')} FROM e, q WHERE dist > 0")
def edge_weights(s, d):
    e = nn.edge_weights(nn.edge_weights(nn.knn_graph(spots(s, d), 6), "inverse_distance").withColumnRenamed("weight", "inverse"), "gaussian")
    return e.select("sample", "i", "j", "dist", "inverse", F.col("weight").alias("gaussian"))


@query(f"WITH {SPOTS}, {PAIR}, d AS (SELECT i, sqrt(min(d2)) AS d FROM pair GROUP BY 1) SELECT 'cust' AS sample, {r('min(d)', 'nn_min')}, {r('quantile_cont(d, 0.5)', 'nn_median')}, {r('quantile_cont(d, 0.95)', 'nn_q95')}, {r('1.25 * quantile_cont(d, 0.5)', 'auto_radius')} FROM d")
def nn_spacing(s, d):
    return nn.nn_spacing(spots(s, d))


@query(f"WITH {GRAPH}, o AS (SELECT i, j FROM sym UNION ALL SELECT spot, spot FROM cs) SELECT 'cust' AS sample, i AS spot, {r('avg(r)', 'r')} FROM o JOIN cs ON cs.spot = o.j GROUP BY i")
def knn_mean_smooth(s, d):
    return nn.mean_smooth(scores(s, d), nn.knn_graph(spots(s, d), 6), "r")


@query(f"WITH {MATRIX}, {PAIR}, o AS (SELECT i, j, exp(-d2 / 4.5) AS w FROM pair WHERE d2 <= 20.25 UNION ALL SELECT spot, spot, 1 FROM cs) SELECT 'cust' AS sample, i AS spot, {r('sum(w * c) / sum(w)', 'c')} FROM o JOIN cs ON cs.spot = o.j GROUP BY i")
def gaussian_smooth(s, d):
    return nn.gaussian_smooth(scores(s, d), spots(s, d), "c", 1.5)


@query(f"WITH {GRAPH}, o AS (SELECT i, j, 1 / dist AS w FROM sym UNION ALL SELECT spot, spot, 1 FROM cs) SELECT 'cust' AS sample, i AS spot, {r('sum(w * s) / sum(w)', 's')} FROM o JOIN cs ON cs.spot = o.j GROUP BY i")
def graph_mean_smooth(s, d):
    return nn.graph_smooth(scores(s, d), nn.edge_weights(nn.knn_graph(spots(s, d), 6), "inverse_distance"), "s")


@query(f"WITH {FIELDS}, {ADJ} SELECT 'cust' AS sample, {', '.join(r(x, x) for x in ('adj_same_fraction', 'adj_zero_fraction', 'adj_opposite_fraction', 'r_crossing_fraction'))} FROM adj")
def adjacency_metrics(s, d):
    e = knn6(s, d)
    return ff.adjacency_metrics(field_table(s, d, e), e)


@query(f"WITH {SPOTS}, {PAIR}, {HEXE} SELECT 'cust' AS sample, i, j FROM e ORDER BY md5(concat_ws(':', 42, i, j)), i, j LIMIT 500")
def plot_edge_sample(s, d):
    """K5: a fixed-size sample of edges for a plot, the same on every run."""
    return hexagons(s, d).select("sample", "i", "j").orderBy(F.md5(F.concat_ws(":", F.lit("42"), "i", "j")), "i", "j").limit(500)


# ---------------------------------------------------------------- components and quality


@query(f"WITH RECURSIVE {MASKS}, on_ AS (SELECT spot FROM m WHERE high_g), x AS (SELECT i, j FROM sym WHERE i IN (SELECT spot FROM on_) AND j IN (SELECT spot FROM on_)), re AS (SELECT i AS a, i AS b FROM x UNION SELECT re.a, x.j FROM re JOIN x ON x.i = re.b) SELECT a AS node, min(b) AS component FROM re GROUP BY 1")
def connected_components_of_high_gradient(s, d):
    e = knn6(s, d)
    m = masked(s, d, e).where("high_g").select("spot")
    return components_by_sample(e.join(m.toDF("i"), "i", "left_semi").join(m.toDF("j"), "j", "left_semi")).select(F.col("spot").alias("node"), "component")


QUERIES["connected_components"], ORACLES["connected_components"] = QUERIES.pop("connected_components_of_high_gradient"), ORACLES.pop("connected_components_of_high_gradient")


@query(f"WITH RECURSIVE {MASKS}, {comp_sql('diffuse')} SELECT 'cust' AS sample, component, size FROM co_diffuse")
def mask_components(s, d):
    e = knn6(s, d)
    return ff.mask_components(masked(s, d, e), e, "diffuse")


@query(f"WITH {SPOTS}, {PAIR}, {HEXE}, {SYM} SELECT 'cust' AS sample, spot, (SELECT count(*) FROM sym WHERE sym.i = spots.spot) AS degree FROM spots")
def degree_table(s, d):
    return ff.degree_table(spots(s, d), hexagons(s, d))


@query(f"""WITH RECURSIVE {SPOTS}, {PAIR}, {HEXE}, {SYM}, re AS (SELECT spot AS a, spot AS b FROM spots UNION SELECT re.a, sym.j FROM re JOIN sym ON sym.i = re.b),
co AS (SELECT count(*) AS nc, max(size) AS largest FROM (SELECT c, count(*) AS size FROM (SELECT a, min(b) AS c FROM re GROUP BY 1) GROUP BY 1)), du AS (SELECT count(*) - count(DISTINCT concat_ws(',', array_col, array_row)) AS dup FROM spots), dg AS (SELECT spot, (SELECT count(*) FROM sym WHERE sym.i = spots.spot) AS degree FROM spots),
a AS (SELECT count(*) AS n, min(degree) AS mi, quantile_cont(degree, 0.5) AS md, avg(degree) AS av, max(degree) AS ma, sum(CAST(degree = 0 AS BIGINT)) AS iso FROM dg), b AS (SELECT count(*) AS ne, quantile_cont(dist, 0.5) AS dm, quantile_cont(dist, 0.95) AS dq, max(dist) AS dx FROM e)
SELECT 'cust' AS sample, n AS n_spots, mi AS degree_min, {r('md', 'degree_median')}, {r('av', 'degree_mean')}, ma AS degree_max, CAST(iso AS BIGINT) AS isolated_spots, nc AS n_components, ne AS n_edges, {r('dm', 'distance_median')}, {r('dq', 'distance_q95')}, {r('dx', 'distance_max')}, dup AS duplicate_coordinates, {r('2 * ne / (n * (n - 1))', 'density')}, {r('largest / n', 'largest_component_ratio')},
concat_ws(';', CASE WHEN iso / n > 0.1 THEN 'many_isolated' END, CASE WHEN largest / n < 0.8 THEN 'fragmented' END, CASE WHEN md < 2 THEN 'low_degree' END) AS warnings FROM a, b, co, du""")
def graph_qc(s, d):
    return ff.graph_qc(spots(s, d), hexagons(s, d))


def _grid_sql() -> str:
    quant = lambda x, qs: ", ".join(f"({q}, (SELECT quantile_cont({x}, {q}) FROM f))" for q in qs)
    return f"""WITH RECURSIVE {FIELDS}, {ADJ}, qc(c_q, tc) AS (VALUES {quant('c', (0.75, 0.8, 0.85))}), qs(s_q, ts) AS (VALUES {quant('s', (0.75, 0.8, 0.85))}), qg(g_q, tg) AS (VALUES {quant('g', (0.5, 0.6, 0.7))}),
m AS (SELECT f.spot, CAST(c_q AS DOUBLE) AS c_q, CAST(s_q AS DOUBLE) AS s_q, CAST(g_q AS DOUBLE) AS g_q, c >= tc AND s >= ts AND g >= tg AS interface, g >= tg AND (c >= tc OR s >= ts) AND NOT (c >= tc AND s >= ts) AS diffuse FROM f, qc, qs, qg),
x AS (SELECT a.c_q, a.s_q, a.g_q, sym.i, sym.j FROM sym JOIN m a ON a.spot = sym.i AND a.diffuse JOIN m b ON b.spot = sym.j AND b.diffuse AND b.c_q = a.c_q AND b.s_q = a.s_q AND b.g_q = a.g_q),
re AS (SELECT c_q, s_q, g_q, spot AS a, spot AS b FROM m WHERE diffuse UNION SELECT re.c_q, re.s_q, re.g_q, re.a, x.j FROM re JOIN x ON x.i = re.b AND x.c_q = re.c_q AND x.s_q = re.s_q AND x.g_q = re.g_q),
co AS (SELECT c_q, s_q, g_q, c, count(*) AS size FROM (SELECT c_q, s_q, g_q, a, min(b) AS c FROM re GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3, 4),
cz AS (SELECT c_q, s_q, g_q, max(size) / sum(size) AS d_l, avg(CAST(size <= 3 AS INT)) AS d_sm FROM co GROUP BY 1, 2, 3),
y AS (SELECT c_q, s_q, g_q, avg(CAST(interface AS INT)) AS fi, avg(CAST(diffuse AS INT)) AS fd FROM m GROUP BY 1, 2, 3),
w AS (SELECT y.*, adj.*, coalesce(d_l, 0) AS d_l, coalesce(d_sm, 0) AS d_sm, CASE WHEN fi >= 0.01 THEN 'Type A' WHEN fd >= 0.05 THEN 'Type B' ELSE 'Type C' END AS regime_label FROM y LEFT JOIN cz USING (c_q, s_q, g_q), adj)
SELECT 'cust' AS sample, c_q, s_q, g_q, regime_label, {_PATTERN} AS type_b_subtype, {r('fi', 'interface_fraction')}, {r('fd', 'diffuse_fraction')} FROM w"""


@query(_grid_sql())
def threshold_perturbation(s, d):
    e = knn6(s, d)
    return ff.threshold_perturbation(field_table(s, d, e), e)


@query(f"""WITH {MASKS} SELECT 'cust' AS sample, spot, CASE WHEN interface THEN 'localized_interface_like' WHEN diffuse THEN 'diffuse_transition' WHEN high_s AND NOT high_c THEN 'S_dominant' WHEN high_c AND NOT high_s THEN 'C_dominant' ELSE 'balanced_or_transition_like' END AS state, interface OR diffuse OR (high_c AND high_s) AS transition_like FROM m""")
def spot_state_labels(s, d):
    return ff.spot_state_labels(masked(s, d))
