"""Queries over validation, quality, graph metadata and report rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import safe_corr
from ..operators import checks as ck
from ..operators import enrich as en
from ..operators import fields as ff
from ..operators import graphs as gr
from ..operators import matrix as mm
from ..operators import optimizer as op
from ..operators import summary as sm
from ..operators import tables as tt
from ..sources import adapters as ad
from . import field_queries as fq
from .support import CNT, HEXE, MASKS, PAIR, SPOTS, SYM, r, rounded

QUERIES, ORACLES = {}, {}
METRICS = ("sample", "n_spots", "interface_fraction", "interface_spots", "diffuse_fraction", "diffuse_spots", "c_mean", "s_mean", "r_mean", "r_sd", "r_dynamic_range", "g_mean", "g_q90", "n_interface_components", "largest_interface_component_ratio", "interface_small_fraction", "interface_coherence_score", "n_diffuse_components", "largest_diffuse_component_ratio", "diffuse_small_fraction", "diffuse_coherence_score", "interface_fragmentation_index", "adj_same_fraction", "adj_zero_fraction", "adj_opposite_fraction", "r_crossing_fraction", "transition_burden_score", "regime_label", "public_transition_pattern")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _two(s, d):
    """Spots and genes of two samples; the second one has no coordinates."""
    none = F.lit(None).cast("double")
    spots = fq.spots(s, d).select("sample", "spot", "x", "y", "array_row", "array_col").unionByName(ad.embedding_spots(s, d).select("sample", F.col("spot").cast("long").alias("spot"), none.alias("x"), none.alias("y"), "array_row", "array_col"))
    genes = ad.customer_expr(s, d).select("sample", "gene").unionByName(ad.embedding_expr(s, d).select("sample", "gene")).distinct()
    return spots, genes


_GENES = "gn AS (SELECT DISTINCT 'cust' AS sample, gene FROM cnt UNION ALL SELECT 'emb', 'D' || i FROM (SELECT unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v FROM embeddings) WHERE v <> 0 GROUP BY i)"


@query(f"""WITH {SPOTS}, {CNT}, {_GENES}, nv AS (SELECT sample, count(*) AS n FROM gn GROUP BY 1)
SELECT 'cust' AS sample, (SELECT count(*) FROM spots) AS n_obs, (SELECT n FROM nv WHERE sample = 'cust') AS n_vars, true AS gene_names_present, true AS gene_names_unique, true AS has_spatial, '' AS errors, '' AS warnings, true AS valid
UNION ALL SELECT 'emb', (SELECT count(*) FROM embeddings), (SELECT n FROM nv WHERE sample = 'emb'), true, true, false, 'no_coordinates', '', false""")
def validate_sample(s, d):
    return ck.validate_sample(*_two(s, d))


@query(f"""WITH {SPOTS}, {CNT}, {_GENES}, pr(program, gene) AS (VALUES {', '.join(f"('C', '{g.upper()}')" for g in (*ad.C_GENES, 'Brand#99', 'Brand#98'))}, {', '.join(f"('S', '{g.upper()}')" for g in ad.S_GENES)}),
cv AS (SELECT sample, avg(CAST(gene IN (SELECT upper(g.gene) FROM gn g WHERE g.sample = x.sample) AS INT)) FILTER (program = 'C') AS c, avg(CAST(gene IN (SELECT upper(g.gene) FROM gn g WHERE g.sample = x.sample) AS INT)) FILTER (program = 'S') AS s FROM pr, (SELECT DISTINCT sample FROM gn) x GROUP BY 1),
st AS (SELECT 'cust' AS sample, (SELECT count(*) FROM spots) AS n_spots, 'PASS' AS sp UNION ALL SELECT 'emb', (SELECT count(*) FROM embeddings), 'WARN')
SELECT sample, n_spots, {r('c', 'c_coverage')}, {r('s', 's_coverage')}, sp AS spatial_qc_status,
concat_ws(';', CASE WHEN least(c, s) < 0.5 THEN 'low_gene_program_coverage' WHEN least(c, s) < 0.8 THEN 'partial_gene_program_coverage' END, CASE WHEN sp <> 'PASS' THEN 'spatial_' || lower(sp) END, CASE WHEN n_spots < 10 THEN 'very_small_spot_count' END) AS qc_notes,
CASE WHEN least(c, s) < 0.5 OR sp = 'FAIL' THEN 'FAIL' WHEN least(c, s) < 0.8 OR sp <> 'PASS' OR n_spots < 10 THEN 'WARN' ELSE 'PASS' END AS qc_flag FROM cv JOIN st USING (sample)""")
def qc_flag(s, d):
    spots, genes = _two(s, d)
    programs = ad.program_table(s, C=(*ad.C_GENES, "Brand#99", "Brand#98"), S=ad.S_GENES)
    rows = tt.spatial_qc(spots).join(ck.program_coverage(genes, programs), "sample").withColumn("unique_names", F.lit(True)).withColumn("smoothing_skipped", F.lit(False))
    return ck.qc_flag(rows).select("sample", "n_spots", "c_coverage", "s_coverage", "spatial_qc_status", "qc_notes", "qc_flag")


@query("SELECT 'part' AS sample, CAST(p_partkey AS BIGINT) AS gene_idx, p_brand AS gene, CASE WHEN n = 0 THEN p_brand ELSE p_brand || '-' || n END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)")
def unique_names(s, d):
    return ck.unique_names(ad.table(s, d, "part").select(F.lit("part").alias("sample"), F.col("p_partkey").alias("gene_idx"), F.col("p_brand").alias("gene")))


@query(f"WITH {MASKS} SELECT label, {r('CASE WHEN count(*) >= 3 AND stddev_pop(c) > 1e-12 AND stddev_pop(s) > 1e-12 THEN covar_pop(c, s) / (stddev_pop(c) * stddev_pop(s)) END', 'correlation')} FROM m JOIN spots USING (spot) GROUP BY 1")
def guarded_corr(s, d):
    return fq.scores(s, d).join(fq.spots(s, d).select("spot", "label"), "spot").groupBy("label").agg(safe_corr("c", "s").alias("correlation"))


@query(f"WITH {MASKS} SELECT label, {r('coalesce(sum(CAST(high_c AND high_g AS INT)) / nullif(sum(CAST(high_c OR high_g AS INT)), 0), 1)', 'jaccard')} FROM m JOIN spots USING (spot) GROUP BY 1")
def mask_jaccard(s, d):
    return op.mask_jaccard(fq.masked(s, d).join(fq.spots(s, d).select("spot", "label"), "spot"), ["label"], "high_c", "high_g")


_COMPOSITION = fq.ORACLES["gene_composition"]


@query(f"""WITH x AS ({_COMPOSITION}) SELECT 'cust' AS sample, program, arg_max(gene, relative_contribution_percent) FILTER (status = 'present') AS top_gene, max(relative_contribution_percent) FILTER (status = 'present') AS top_percent, count(*) FILTER (status = 'present') AS present, count(*) FILTER (status = 'missing') AS missing FROM x GROUP BY 2""")
def dashboard_composition(s, d):
    return ck.dashboard_composition(mm.gene_composition(fq.spots(s, d), fq.expression(s, d), ad.program_table(s, C=(*ad.C_GENES, "Brand#99"), S=ad.S_GENES)))


@query()
def dashboard_enrichment(s, d):
    return ck.dashboard_enrichment(en.interface_enrichment(fq.zscores(s, d), fq.masked(s, d)))


@query(fq._metrics_sql(f"'cust' AS sample, {r('(SELECT quantile_cont(c, 0.8) FROM m)', 'c_threshold')}, {r('(SELECT quantile_cont(s, 0.8) FROM m)', 'b_threshold')}, {r('(SELECT quantile_cont(g, 0.6) FROM m)', 'g_threshold')}, {r('(SELECT avg(CAST(high_g AS INT)) FROM m)', 'g_high_fraction')}, CAST(ni AS BIGINT) AS interface_spot_count, CAST(nd AS BIGINT) AS transition_spot_count, {r('fd', 'transition_fraction')}, {r('r_sd * r_sd', 'r_variance')}, '{','.join(ad.C_GENES)}' AS \"selected_C\", '{','.join(ad.S_GENES)}' AS \"selected_B\", regime_label"))
def compatibility_summary(s, d):
    e = fq.knn6(s, d)
    m = fq.masked(s, d, e)
    rows = ck.compatibility_summary(ff.sample_metrics(m, e), m, list(ad.C_GENES), list(ad.S_GENES))
    return rows.select("sample", "c_threshold", "b_threshold", "g_threshold", "g_high_fraction", "interface_spot_count", "transition_spot_count", "transition_fraction", "r_variance", "selected_C", "selected_B", "regime_label")


def _graph_sql(name: str, method: str, edges: str) -> str:
    """Metadata of the edges (i < j) that a table holds."""
    return f"""SELECT '{method}' AS requested_method, n AS n_nodes, ne AS n_edges, 2.0 * ne / n AS mean_degree, iso / n AS isolated_fraction, nc AS n_components, largest / n AS largest_component_ratio
FROM (SELECT count(*) AS n, sum(CAST(spot NOT IN (SELECT i FROM {edges}) AS INT)) AS iso FROM spots), (SELECT count(*) // 2 AS ne FROM {edges}), (SELECT count(*) AS nc, max(size) AS largest FROM (SELECT c, count(*) AS size FROM (SELECT a, min(b) AS c FROM re_{name} GROUP BY 1) GROUP BY 1))"""


def _reach(name: str, edges: str) -> str:
    return f"re_{name} AS (SELECT spot AS a, spot AS b FROM spots UNION SELECT x.a, y.j FROM re_{name} x JOIN {edges} y ON y.i = x.b)"


_LATTICE = f"lat AS (SELECT i, j FROM pair WHERE d2 <= 4), {_reach('l', 'lat')}"
_RADIUS = f"rd AS (SELECT i, j FROM pair WHERE d2 <= round(2.5 * 2.5, 9)), {_reach('r', 'rd')}"
_KNN = f"nn AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS k FROM pair), kn AS (SELECT i, j FROM nn WHERE k <= 4 UNION SELECT j, i FROM nn WHERE k <= 4), {_reach('k', 'kn')}"
_META = ("mean_degree", "isolated_fraction", "largest_component_ratio")


@query(f"""WITH RECURSIVE {SPOTS}, {PAIR}, {_LATTICE}, m AS ({_graph_sql('l', 'lattice', 'lat')})
SELECT 'cust' AS sample, requested_method, 'lattice' AS effective_method, false AS fallback_used, 'native' AS radius_unit, n_nodes, n_edges, {', '.join(r(x, x) for x in _META)}, n_components, CAST(0 AS BIGINT) AS zero_distance_edges_excluded FROM m""")
def graph_metadata(s, d):
    _, meta = gr.build_graph(fq.spots(s, d), gr.GraphConfig("lattice"))
    return meta.select("sample", "requested_method", "effective_method", "fallback_used", "radius_unit", "n_nodes", "n_edges", *_META, "n_components", "zero_distance_edges_excluded")


@query(f"""WITH RECURSIVE {SPOTS}, {PAIR}, {_LATTICE}, {_RADIUS}, {_KNN}, m AS ({_graph_sql('l', 'lattice', 'lat')} UNION ALL {_graph_sql('r', 'radius', 'rd')} UNION ALL {_graph_sql('k', 'knn', 'kn')})
SELECT 'cust' AS sample, requested_method, CASE WHEN n_edges > 0 THEN 'ok' ELSE 'insufficient_edges' END AS status, n_nodes, n_edges, {', '.join(r(x, x) for x in _META)}, n_components, {r('max(isolated_fraction) OVER () - min(isolated_fraction) OVER ()', 'isolated_fraction_variation')}, max(n_components) OVER () - min(n_components) OVER () AS connected_component_variation, max(n_edges) OVER () - min(n_edges) OVER () AS valid_edge_variation FROM m""")
def graph_robustness(s, d):
    rows, _ = gr.graph_comparison(fq.spots(s, d), gr.GraphConfig(radius=2.5, k=4))
    return rows.select("sample", "requested_method", "status", "n_nodes", "n_edges", *_META, "n_components", "isolated_fraction_variation", "connected_component_variation", "valid_edge_variation")


@query(f"""WITH RECURSIVE {SPOTS}, {PAIR}, e AS (SELECT i, j FROM pair WHERE d2 <= 4 AND i IN (SELECT spot FROM spots WHERE mask) AND j IN (SELECT spot FROM spots WHERE mask)), {_reach('e', 'e')}
SELECT 'whole_slide' AS scope, 'cust' AS sample, spot, CAST(0 AS BIGINT) AS grp FROM spots UNION ALL SELECT 'within_connected_components', 'cust', a, min(b) FROM re_e GROUP BY a
UNION ALL SELECT 'within_user_strata', 'cust', spot, CASE WHEN label <> 'MACHINERY' THEN dense_rank() OVER (ORDER BY CASE WHEN label <> 'MACHINERY' THEN label END NULLS LAST) - 1 END FROM spots""")
def permutation_groups(s, d):
    spots = fq.spots(s, d).withColumn("label", F.when(F.col("label") != "MACHINERY", F.col("label")))
    _, edges = gr.tissue_only(spots.withColumn("in_tissue", F.col("mask").cast("int")), fq.hexagons(s, d))
    parts = [gr.permutation_groups(spots, edges, scope, "label").select(F.lit(scope).alias("scope"), "sample", "spot", "grp") for scope in ck.SCOPES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {SPOTS}, {PAIR}, {HEXE}, {SYM}, t AS (SELECT spot FROM spots WHERE mask) SELECT 'cust' AS sample, spot, (SELECT count(*) FROM sym WHERE sym.i = t.spot AND sym.j IN (SELECT spot FROM t)) AS degree FROM t")
def tissue_only_degree(s, d):
    spots, edges = gr.tissue_only(fq.spots(s, d).withColumn("in_tissue", F.col("mask").cast("int")), fq.hexagons(s, d))
    return ff.degree_table(spots, edges)


@query(f"""WITH g AS ({fq.ORACLES['threshold_perturbation']}), n AS (SELECT regime_label, count(*) AS times, min(100 * c_q + 10 * s_q + g_q) AS first FROM g GROUP BY 1)
SELECT 'cust' AS sample, arg_max(regime_label, times * 1000 - first) AS dominant, {r('max(times) / sum(times)', 'dominant_fraction')} FROM n""")
def threshold_dominant_regime(s, d):
    e = fq.knn6(s, d)
    grid = ff.threshold_perturbation(fq.field_table(s, d, e), e)
    return ck.dominant_value(grid.withColumn("place", 100 * F.col("c_q") + 10 * F.col("s_q") + F.col("g_q")), ["sample"], "regime_label", "place")


@query(f"""WITH {SPOTS}, {CNT}, lib AS (SELECT gene, avg(CAST(v > 0 AS INT)) AS x FROM cnt GROUP BY 1), f(field, gene) AS (VALUES {', '.join(f"('H', '{g}')" for g in (*ad.H_GENES, 'Brand#99'))}, {', '.join(f"('V', '{g}')" for g in ad.V_GENES)})
SELECT 'cust' AS sample, field, {r('avg(CAST(gene IN (SELECT gene FROM lib) AS INT))', 'coverage')}, avg(CAST(gene IN (SELECT gene FROM lib) AS INT)) >= 0.25 AS scored FROM f GROUP BY 2""")
def context_gate(s, d):
    programs = ad.program_table(s, H=(*ad.H_GENES, "Brand#99"), V=ad.V_GENES)
    return ck.coverage_gate(en.context_coverage(mm.dense(fq.spots(s, d), fq.expression(s, d), programs), programs))


def _dominant(value: str, where: str) -> str:
    return f"(SELECT struct_pack(v := {value}, s := n / total) FROM (SELECT {value}, count(*) AS n, sum(count(*)) OVER () AS total, min(c_q * 10000 + s_q * 100 + g_q) AS first FROM grid {where} GROUP BY 1) ORDER BY n DESC, first LIMIT 1)"


_GRID = f"grid AS ({fq.ORACLES['threshold_perturbation']}), dr AS (SELECT {_dominant('regime_label', '')} AS a, {_dominant('type_b_subtype', 'WHERE regime_label = ' + chr(39) + 'Type B' + chr(39))} AS b)"
_CHECKED = ck.check_programs([*ad.C_GENES, "brand#1", "Brand#99"], list(ad.S_GENES))
_HAVE = "upper(gene) IN (SELECT upper(gene) FROM cnt)"


def _listed(genes, having: str) -> str:
    rows = ", ".join(f"('{g}', {i})" for i, g in enumerate(genes))
    return f"(SELECT coalesce(string_agg(gene, ';' ORDER BY i), '') FROM (VALUES {rows}) v(gene, i) WHERE {having}{_HAVE})"


def _coverage(genes) -> str:
    return f"(SELECT avg(CAST({_HAVE} AS INT)) FROM (VALUES {', '.join(f'({chr(39)}{g}{chr(39)})' for g in genes)}) v(gene))"


@query(f"""WITH {_GRID} SELECT 'cust' AS sample, (SELECT count(*) FROM grid) AS robustness_grid_evaluated, a.v AS dominant_regime, {r('a.s', 'regime_stability')}, coalesce(b.v, 'not_applicable') AS "dominant_typeB_subtype", {r('b.s', 'subtype_stability')} FROM dr""")
def robustness_summary(s, d):
    e = fq.knn6(s, d)
    return sm.robustness(ff.threshold_perturbation(fq.field_table(s, d, e), e))


@query(f"""WITH {CNT}, {_GRID}, base AS ({fq.ORACLES['sample_metrics']}), k AS (SELECT (SELECT count(DISTINCT gene) FROM cnt) AS n_genes, {_coverage(_CHECKED.c_genes)} AS cc, {_coverage(_CHECKED.s_genes)} AS sc, {len(_CHECKED.c_genes)} AS nc, {len(_CHECKED.s_genes)} AS ns)
SELECT base.*, n_genes, n_spots || 'x' || n_genes AS matrix_shape, {r('n_spots * n_genes * 8 / 1e9', '"dense_float64_GB"')}, '{';'.join(_CHECKED.c_genes)}' AS "C_gene_set", {_listed(_CHECKED.c_genes, '')} AS "C_genes_present", {_listed(_CHECKED.c_genes, 'NOT ')} AS "C_genes_missing", {r('cc', '"C_gene_coverage"')}, {_listed(_CHECKED.s_genes, '')} AS "S_genes_present", {r('sc', '"S_gene_coverage"')},
true AS unique_feature_names, 'PASS' AS spatial_qc_status, CASE WHEN least(cc, sc) < 0.5 THEN 'low_gene_program_coverage' WHEN least(cc, sc) < 0.8 THEN 'partial_gene_program_coverage' ELSE '' END AS qc_notes, CASE WHEN least(cc, sc) < 0.5 THEN 'FAIL' WHEN least(cc, sc) < 0.8 THEN 'WARN' ELSE 'PASS' END AS qc_flag,
interface_fraction >= 0.01 AS localized_interface_call, diffuse_fraction >= 0.05 AS transition_zone_call, 'BRAND#1' AS "C_duplicates_removed", {r('n_spots * (cc * nc + sc * ns) * 8 / 1048576', '"selected_expression_dense_float64_MB"')}, a.v AS dominant_regime, {r('a.s', 'regime_stability')} FROM base, k, dr""")
def sample_summary(s, d):
    e, expr = fq.knn6(s, d), fq.expression(s, d)
    m = fq.masked(s, d, e)
    rows = sm.sample_summary(fq.spots(s, d), expr, fq.programs(s), m, e, ff.threshold_perturbation(m.select("sample", "spot", "c", "s", "r", "g"), e), _CHECKED)
    return rows.select(*METRICS, "n_genes", "matrix_shape", "dense_float64_GB", "C_gene_set", "C_genes_present", "C_genes_missing", "C_gene_coverage", "S_genes_present", "S_gene_coverage", "unique_feature_names", "spatial_qc_status", "qc_notes", "qc_flag", "localized_interface_call", "transition_zone_call", "C_duplicates_removed", "selected_expression_dense_float64_MB", "dominant_regime", "regime_stability")
