"""Queries over gene lists, candidate tables, names, positions and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as tt
from ..sources import adapters as ad
from . import field_queries as fq
from .support import CNT, PROG, SPOTS, r, rounded

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return add


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


#: Every part gets a gene symbol, so that the marker sets and patterns all occur.
SYMBOLS = [*tt.KNOWN_RECEPTORS, *tt.KNOWN_LIGANDS, "SLC2A1", "KCNA1", "ITGA4", "MUC1", "MT-CO1", "RPL3", "MALAT1", "ACTB", "gpr15", "cd8a"]
_LIST = "[" + ", ".join(f"'{g}'" for g in SYMBOLS) + "]"
CAND = f"cand AS (SELECT CAST(p_partkey AS BIGINT) AS id, {_LIST}[1 + p_partkey % {len(SYMBOLS)}] AS gene, p_retailprice AS candidate_score, p_name FROM part)"


def candidates(s, d):
    p = ad.table(s, d, "part")
    return p.select(F.col("p_partkey").cast("long").alias("id"), F.element_at(F.array(*map(F.lit, SYMBOLS)), (F.col("p_partkey") % len(SYMBOLS) + 1).cast("int")).alias("gene"), F.col("p_retailprice").alias("candidate_score"), "p_name")


_NORMAL = "list_filter(list_transform(string_split(regexp_replace(p_type || ';' || p_brand || ', ' || lower(p_brand), '[;\\n]', ',', 'g'), ','), lambda x: upper(trim(x))), lambda x: x <> '')"


@query(f"SELECT CAST(p_partkey AS BIGINT) AS id, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda t: list_position(l, t[1]) = t[2]), lambda t: t[1]), ',') AS genes FROM (SELECT p_partkey, {_NORMAL} AS l FROM part)")
def gene_list_normalize(s, d):
    text = F.concat(F.col("p_type"), F.lit(";"), F.col("p_brand"), F.lit(", "), F.lower("p_brand"))
    return ad.table(s, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.array_join(tt.gene_list(text), ",").alias("genes"))


@query(f"WITH {PROG}, o AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_size <= 10) SELECT gene, CAST(requested_order AS INT) AS requested_order FROM prog WHERE program = 'C' AND gene IN (SELECT b FROM o)")
def gene_overlap(s, d):
    other = ad.table(s, d, "part").where("p_size <= 10").select(F.col("p_brand").alias("gene")).distinct()
    return ad.program_table(s, C=ad.C_GENES).join(other, "gene", "left_semi").select("gene", "requested_order")


@query(f"WITH {PROG}, g AS (SELECT upper(p_brand) AS k, min(p_partkey) AS gene_idx, arg_min(p_brand, p_partkey) AS found FROM part GROUP BY 1) SELECT program, gene, CAST(requested_order AS INT) AS requested_order, CAST(gene_idx AS BIGINT) AS gene_idx, found FROM prog LEFT JOIN g ON k = upper(gene)")
def gene_resolve(s, d):
    genes = ad.table(s, d, "part").select(F.col("p_brand").alias("gene"), F.col("p_partkey").cast("long").alias("gene_idx"))
    return tt.resolve(genes, fq.programs(s))


_REC, _TRA, _SUR = f"(upper(gene) IN {_in(tt.KNOWN_RECEPTORS)} OR regexp_matches(upper(gene), '{tt.RECEPTOR}'))", f"regexp_matches(upper(gene), '{tt.TRANSPORTER}')", f"regexp_matches(upper(gene), '{tt.SURFACE}')"


@query(f"""WITH {CAND}, fl AS (SELECT id, gene, CASE WHEN id % 7 = 0 THEN NULL ELSE candidate_score END AS candidate_score, {_REC} AS receptor_like, {_TRA} AS transporter_like, {_SUR} AS surface_like FROM cand)
SELECT id, gene, {r('candidate_score', 'candidate_score')}, receptor_like, true AS membrane_like, transporter_like, surface_like, concat_ws(';', CASE WHEN receptor_like THEN 'receptor_like' END, CASE WHEN transporter_like THEN 'transporter_like' END, CASE WHEN surface_like THEN 'surface_like' END) AS annotation_reason,
{r('coalesce(candidate_score, 0) + CAST(receptor_like AS INT) + 0.5 * CAST(transporter_like AS INT) + 0.5 * CAST(surface_like AS INT)', 'priority_score')} FROM fl WHERE receptor_like OR transporter_like OR surface_like""")
def receptor_filter(s, d):
    return tt.receptor_filter(candidates(s, d).drop("p_name").withColumn("candidate_score", F.when(F.col("id") % 7 != 0, F.col("candidate_score"))))


@query(f"WITH {CAND} SELECT id, gene, upper(gene) IN {_in(tt.KNOWN_LIGANDS)} AS is_ligand, upper(gene) IN {_in(tt.KNOWN_RECEPTORS)} AS is_receptor, '' AS protein_id, '' AS sequence FROM cand")
def annotate_sequences(s, d):
    return tt.annotate_sequences(candidates(s, d).select("id", "gene"))


@query(f"WITH {CAND} SELECT id, gene FROM cand WHERE NOT regexp_matches(upper(gene), '{tt.TECHNICAL}')")
def technical_gene_filter(s, d):
    return candidates(s, d).where(~F.upper("gene").rlike(tt.TECHNICAL)).select("id", "gene")


@query(f"WITH {CAND} SELECT upper(gene) AS gene, {r('max(candidate_score)', 'candidate_score')} FROM cand GROUP BY 1 ORDER BY max(candidate_score) DESC, 1 LIMIT 25")
def qubo_pool_topk(s, d):
    return tt.top_pool(candidates(s, d), 25)


_LR = f"lr AS (SELECT l.gene AS ligand, rc.gene AS receptor FROM (SELECT gene, min(id) AS o FROM cand WHERE gene IN {_in(tt.KNOWN_LIGANDS)} GROUP BY 1) l, (SELECT gene, min(id) AS o FROM cand WHERE gene IN {_in(tt.KNOWN_RECEPTORS)} GROUP BY 1) rc ORDER BY l.o, rc.o LIMIT 300)"


@query(f"WITH {CAND}, {_LR} SELECT ligand, receptor FROM lr")
def ligrec_crossjoin(s, d):
    c = candidates(s, d)
    side = lambda genes, name: c.where(F.col("gene").isin(genes)).groupBy(F.col("gene").alias(name)).agg(F.min("id").alias(f"{name}_order"))
    return tt.ligand_receptor_pairs(side(tt.KNOWN_LIGANDS, "ligand"), side(tt.KNOWN_RECEPTORS, "receptor"), 300)


@query(f"WITH {CAND}, {_LR} SELECT gene, 'pending' AS review_status, '' AS evidence, '' AS notes FROM (SELECT ligand AS gene FROM lr UNION SELECT receptor FROM lr)")
def evidence_plan(s, d):
    return tt.evidence_plan(ligrec_crossjoin(s, d))


@query(f"WITH {CAND} SELECT gene, '>' || CASE WHEN id % 3 = 0 THEN gene ELSE 'P' || id END AS header, upper(regexp_replace(p_name, '[^A-Za-z*]', '', 'g')) AS residues FROM cand WHERE regexp_replace(p_name, '[^A-Za-z*]', '', 'g') <> ''")
def fasta_records(s, d):
    return tt.fasta_records(candidates(s, d).withColumn("protein_id", F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("P"), "id"))).withColumnRenamed("p_name", "sequence"))


@query(f"WITH {CAND} SELECT id, gene, upper(gene) IN {_in(tt.KNOWN_LIGANDS)} AS excluded FROM cand")
def opposite_side_exclusion(s, d):
    return tt.exclude_opposite(candidates(s, d).select("id", "gene"), s.createDataFrame([(g,) for g in tt.KNOWN_LIGANDS], "gene string"))


@query("SELECT CAST(c_custkey AS BIGINT) AS spot, c_acctbal > 0 AS by_number, lower(trim(c_mktsegment)) IN ('true', 'yes', 'y', '1', 'positive', 'high') AS by_word FROM customer")
def obs_binary_mask(s, d):
    c = ad.table(s, d, "customer").withColumn("n", F.col("c_acctbal").cast("string"))
    return c.select(F.col("c_custkey").cast("long").alias("spot"), tt.binary_mask("n").alias("by_number"), tt.binary_mask("c_mktsegment").alias("by_word"))


@query("WITH k AS (SELECT CAST(s_suppkey AS BIGINT) AS id, 'n' || s_nationkey AS stem FROM supplier) SELECT id, stem, CASE WHEN n > 1 THEN stem || '_' || n ELSE stem END AS name FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY id) AS n FROM k)")
def dedupe_sample_names(s, d):
    return tt.dedupe_names(ad.table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("stem")), "id")


@query("WITH p AS (SELECT CAST(c_custkey AS BIGINT) AS id, 's' || (c_custkey // 3) || CASE c_custkey % 3 WHEN 0 THEN '_PRE' WHEN 1 THEN '_post' ELSE '_x' END AS stem FROM customer WHERE c_custkey % 7 <> 0), q AS (SELECT 's' || (id // 3) || '_' AS key, max('/d/' || stem) FILTER (id % 3 = 0) AS pre, max('/d/' || stem) FILTER (id % 3 = 1) AS post FROM p GROUP BY 1) SELECT * FROM q WHERE pre IS NOT NULL AND post IS NOT NULL")
def pair_pre_post(s, d):
    k = F.col("c_custkey")
    stem = F.concat(F.lit("s"), F.floor(k / 3), F.when(k % 3 == 0, "_PRE").when(k % 3 == 1, "_post").otherwise("_x"))
    return tt.pair_stages(ad.table(s, d, "customer").where(k % 7 != 0).select(stem.alias("stem"), F.concat(F.lit("/d/"), stem).alias("path")))


@query(f"""WITH x AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'pre' ELSE 'post' END AS stage, user_id, event_type AS gene, count(*) AS v FROM events GROUP BY 1, 2, 3),
y AS (SELECT *, ln(1 + v * 1e4 / sum(v) OVER (PARTITION BY stage, user_id)) AS e, (SELECT count(DISTINCT user_id) FROM events) AS n FROM x), z AS (SELECT stage, upper(gene) AS gene, sum(e) / max(n) AS m, count(*) / max(n) AS dt FROM y GROUP BY 1, 2),
j AS (SELECT a.gene, a.m AS mp, a.dt AS dp, b.m AS mq, b.dt AS dq FROM z a JOIN z b USING (gene) WHERE a.stage = 'pre' AND b.stage = 'post')
SELECT gene, {r('mp', 'mean_pre')}, {r('dp', 'detection_pre')}, {r('mq', 'mean_post')}, {r('dq', 'detection_post')}, {r('mq - mp', 'delta_mean')}, {r('dq - dp', 'delta_detection')}, {r('log2((mq + 1e-6) / (mp + 1e-6))', 'logfc_like')}, CASE WHEN mq > mp THEN 'up_post' WHEN mq < mp THEN 'down_post' ELSE 'unchanged' END AS direction, {r('abs(mq - mp) * (0.5 + greatest(dp, dq)) + 0.25 * abs(dq - dp)', 'candidate_score')} FROM j""")
def pre_post_compare(s, d):
    from ..operators.matrix import normalize_total_log1p

    e = ad.table(s, d, "events")
    counts = e.groupBy(F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "pre").otherwise("post").alias("sample"), F.col("user_id").alias("spot"), F.col("event_type").alias("gene")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    n = e.agg(F.countDistinct("user_id").alias("n"))
    logged = normalize_total_log1p(counts).join(F.broadcast(n))
    return tt.pre_post(logged.groupBy(F.col("sample").alias("stage"), "gene").agg((F.sum("value") / F.max("n")).alias("mean"), (F.count(F.lit(1)) / F.max("n")).alias("detection")))


@query("WITH s AS (SELECT CAST(n_nationkey AS BIGINT) + 20240226 AS seed FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT) FROM region) SELECT seed, CAST(k AS INT) AS k, CASE WHEN seed > 10000 AND try_strptime(CAST(seed AS VARCHAR), '%Y%m%d') IS NOT NULL THEN CAST(strftime(try_strptime(CAST(seed AS VARCHAR), '%Y%m%d') + k * INTERVAL 1 DAY, '%Y%m%d') AS BIGINT) ELSE seed + k END AS value FROM s, range(0, 10) x(k)")
def seed_sequence(s, d):
    seeds = ad.table(s, d, "nation").select((F.col("n_nationkey").cast("long") + 20240226).alias("seed")).union(ad.table(s, d, "region").select(F.col("r_regionkey").cast("long")))
    return tt.seed_sequence(seeds, 10)


@query(f"WITH {SPOTS}, {CNT}, x AS (SELECT (SELECT count(*) FROM spots) AS n, count(DISTINCT gene) AS g, count(*) AS v FROM cnt) SELECT 'cust' AS sample, n AS n_spots, g AS n_genes, v AS stored_values, n * g * 8 AS dense64_bytes, n * g * 4 AS dense32_bytes, n * g * 8 > 4294967296 AS exceeds FROM x")
def memory_preflight(s, d):
    return tt.memory_preflight(fq.spots(s, d), ad.customer_expr(s, d))


@query(f"WITH {SPOTS} SELECT 'cust' AS sample, count(*) AS n_spots, CAST(0 AS BIGINT) AS bad, 'PASS' AS spatial_qc_status FROM spots UNION ALL SELECT 'holes', count(*), count(*) FILTER (spot % 5 = 0), 'FAIL' FROM spots UNION ALL SELECT 'none', count(*), count(*), 'WARN' FROM spots")
def spatial_qc(s, d):
    at = fq.spots(s, d).select("sample", "spot", "x", "y")
    holes = at.withColumn("sample", F.lit("holes")).withColumn("x", F.when(F.col("spot") % 5 == 0, float("nan")).otherwise(F.col("x")))
    none = at.select(F.lit("none").alias("sample"), "spot", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    return tt.spatial_qc(at.unionByName(holes).unionByName(none))


@query(f"""WITH {SPOTS}, {CNT}, c AS (SELECT count(DISTINCT gene) AS g, count(*) AS v, min(v) AS lo, max(v) AS hi FROM cnt), n AS (SELECT count(*) AS n FROM spots), ev AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), en AS (SELECT count(*) AS n FROM embeddings)
SELECT 'cust' AS sample, n AS n_spots, g AS n_genes, v AS stored, {r('1 - v / (n * g)', 'zero_fraction')}, {r('lo', 'lowest')}, {r('hi', 'highest')}, 'raw_counts' AS expression_state, CAST(0 AS BIGINT) AS duplicate_places FROM c, n
UNION ALL SELECT 'emb', max(n), CAST(64 AS BIGINT), count(*) FILTER (v <> 0), {r('1 - count(*) FILTER (v <> 0) / (max(n) * 64)')}, {r('min(v)')}, {r('max(v)')}, 'centered_or_scaled', CAST(0 AS BIGINT) FROM ev, en""")
def input_audit(s, d):
    spots = fq.spots(s, d).select("sample", "spot", "array_row", "array_col").unionByName(ad.embedding_spots(s, d).drop("label"))
    return tt.input_audit(spots, ad.customer_expr(s, d).unionByName(ad.embedding_expr(s, d)))


@query("SELECT 'c_mktsegment' AS variable, 'categorical_state' AS mode, count(c_mktsegment) AS n_valid, CAST(0 AS BIGINT) AS n_missing, count(DISTINCT c_mktsegment) AS n_different FROM customer UNION ALL SELECT 'c_acctbal', 'continuous_score', count(*), 0, count(DISTINCT c_acctbal) FROM customer UNION ALL SELECT 'flag', 'binary_mask', count(*), 0, count(DISTINCT c_acctbal > 0) FROM customer UNION ALL SELECT 'half', 'binary_mask', count(*) FILTER (c_custkey % 2 = 0), count(*) FILTER (c_custkey % 2 = 1), count(DISTINCT c_custkey % 4) FILTER (c_custkey % 2 = 0) FROM customer")
def variable_semantics(s, d):
    c = ad.table(s, d, "customer").withColumn("flag", F.col("c_acctbal") > 0).withColumn("half", F.when(F.col("c_custkey") % 2 == 0, F.floor(F.col("c_custkey") % 4 / 2).cast("int")))
    return tt.variable_semantics(c, ["c_mktsegment", "c_acctbal", "flag", "half"])


@query("SELECT 'C' || c_custkey AS barcode, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_acctbal AS DOUBLE) AS y FROM customer WHERE c_custkey % 2 = 0")
def positions_join_strict(s, d):
    c = ad.table(s, d, "customer").select("c_custkey", F.concat(F.lit("C"), "c_custkey").alias("barcode"), F.col("c_nationkey").cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    return tt.positions_strict(c.where("c_custkey % 2 = 0").select("barcode"), c.select("barcode", "x", "y"))


@query("WITH p AS (SELECT 'N' || c_nationkey AS barcode, arg_min(c_acctbal, c_custkey) AS x, CAST(min(c_custkey) AS DOUBLE) AS y FROM customer GROUP BY 1) SELECT barcode, x, y FROM p")
def positions_join_lenient(s, d):
    c = ad.table(s, d, "customer").select("c_custkey", F.concat(F.lit("N"), "c_nationkey").alias("barcode"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))
    return tt.positions_lenient(c.select("barcode").distinct(), c, "c_custkey")
