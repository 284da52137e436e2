"""Gene lists, candidate tables, names, positions and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marker sets and patterns of the candidate tables.
KNOWN_RECEPTORS = [
    "AXL", "CCR2", "CCR5", "CD274", "CTLA4", "CXCR3", "CXCR4", "EGFR", "ERBB2", "ERBB3",
    "ERBB4", "FAS", "FGFR1", "FGFR2", "FGFR3", "FLT1", "HAVCR2", "IL6R", "IL6ST", "KDR",
    "LAG3", "MET", "PDCD1", "PDGFRA", "PDGFRB", "TGFBR1", "TGFBR2", "TIGIT", "TNFRSF1A",
]
KNOWN_LIGANDS = [
    "AREG", "CCL2", "CCL5", "CD274", "CXCL10", "CXCL12", "CXCL9", "EGF", "EREG", "FASLG",
    "FGF1", "FGF2", "GAS6", "HGF", "IFNG", "IL10", "IL6", "PDGFA", "PDGFB", "SPP1",
    "TGFA", "TGFB1", "TGFB2", "TNF", "VEGFA", "VEGFB", "WNT5A",
]
RECEPTOR = r"^(?:GPR|ADGR|IL\d*R|CXCR|CCR|TNFRSF|TGFBR|FGFR|ERBB|PTPR|CD\d)"
TRANSPORTER = r"^(?:SLC|ABCA|ABCB|ABCC|ATP\d|KCN|SCN|CACNA|CLCN)"
SURFACE = r"^(?:CD\d|CLDN|ITGA|ITGB|EPCAM|MCAM|MUC\d)"
TECHNICAL = r"^(?:MT-|RPL|RPS|MALAT1)"
TRUE_WORDS = ("true", "yes", "y", "1", "positive", "high")


def gene_list(text: Column) -> Column:
    """Entries between commas, semicolons and line feeds, trimmed, upper-cased, without blanks and repeats, in first-seen order."""
    parts = F.split(F.regexp_replace(text, r"[;\n]", ","), ",")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.upper(F.trim(x))), lambda x: x != ""))


def resolve(genes: DataFrame, programs: DataFrame) -> DataFrame:
    """P5: requested genes with the first index that matches them, letter case aside; missing ones stay with NULL."""
    first = genes.groupBy(F.upper("gene").alias("key")).agg(F.min("gene_idx").alias("gene_idx"), F.min_by("gene", "gene_idx").alias("found"))
    return programs.join(first, F.upper(programs["gene"]) == first["key"], "left").select("program", "gene", "requested_order", "gene_idx", "found")


def receptor_filter(candidates: DataFrame) -> DataFrame:
    """Receptor, transporter and surface genes with flags, the reasons and a priority, by falling priority; others leave. A
    missing or unreadable score counts as 0, as does a missing score column."""
    g = F.upper("gene")
    rec, tra, sur = (F.coalesce(x, F.lit(False)) for x in (g.isin(KNOWN_RECEPTORS) | g.rlike(RECEPTOR), g.rlike(TRANSPORTER), g.rlike(SURFACE)))
    base = F.coalesce(F.col("candidate_score").try_cast("double"), F.lit(0.0)) if "candidate_score" in candidates.columns else F.lit(0.0)
    reason = F.concat_ws(";", F.when(rec, "receptor_like"), F.when(tra, "transporter_like"), F.when(sur, "surface_like"))
    found = candidates.withColumns({"receptor_like": rec, "membrane_like": rec | tra | sur, "transporter_like": tra, "surface_like": sur, "annotation_reason": reason, "priority_score": base + rec.cast("double") + 0.5 * tra.cast("double") + 0.5 * sur.cast("double")})
    return found.where("membrane_like").orderBy(F.desc("priority_score"), "gene")


def annotate_sequences(candidates: DataFrame) -> DataFrame:
    """Ligand and receptor flags; sequence columns are added empty only where the table lacks them."""
    out = candidates.withColumn("is_ligand", F.upper("gene").isin(KNOWN_LIGANDS)).withColumn("is_receptor", F.upper("gene").isin(KNOWN_RECEPTORS))
    for c in ("protein_id", "sequence"):
        out = out if c in out.columns else out.withColumn(c, F.lit(""))
    return out


def top_pool(candidates: DataFrame, n: int) -> DataFrame:
    """Top ``n`` genes by score, rows without gene or score left out, the best row of a gene kept."""
    ok = candidates.where("gene is not null and candidate_score is not null")
    return ok.groupBy(F.upper("gene").alias("gene")).agg(F.max("candidate_score").alias("candidate_score")).orderBy(F.desc("candidate_score"), "gene").limit(n)


def ligand_receptor_pairs(ligands: DataFrame, receptors: DataFrame, most: int = 2500) -> DataFrame:
    """Pairs in nested order, at most ``most``; only that many of each side can take part, so the product stays bounded."""
    left = ligands.select("ligand", "ligand_order").orderBy("ligand_order").limit(most)
    right = receptors.select("receptor", "receptor_order").orderBy("receptor_order").limit(most)
    return left.crossJoin(right).orderBy("ligand_order", "receptor_order").limit(most).select("ligand", "receptor")


def fasta_records(rows: DataFrame) -> DataFrame:
    """K7: header and residues; other signs than letters and * go, empty and NAN records leave, the gene stands in for a missing id."""
    seq = F.upper(F.regexp_replace("sequence", r"[^A-Za-z*]", ""))
    name = F.when(F.trim(F.coalesce("protein_id", F.lit(""))) != "", F.trim("protein_id")).otherwise(F.col("gene"))
    return rows.select("gene", F.concat(F.lit(">"), name).alias("header"), seq.alias("residues")).where("residues <> '' and residues <> 'NAN'")


def evidence_plan(pairs: DataFrame) -> DataFrame:
    """Each ligand or receptor once, with constant review columns."""
    genes = pairs.select(F.col("ligand").alias("gene")).union(pairs.select("receptor")).distinct()
    return genes.select("gene", F.lit("pending").alias("review_status"), F.lit("").alias("evidence"), F.lit("").alias("notes"))


def exclude_opposite(candidates: DataFrame, opposite: DataFrame) -> DataFrame:
    """Candidates with a flag for those that the other program holds."""
    other = opposite.select(F.upper("gene").alias("key")).distinct().withColumn("excluded", F.lit(True))
    return candidates.join(other, F.upper(candidates["gene"]) == other["key"], "left").select(candidates["*"], F.coalesce("excluded", F.lit(False)).alias("excluded"))


def binary_mask(c: str) -> Column:
    """Numbers are on above 0, words if they mean yes."""
    n = F.expr(f"try_cast(`{c}` as double)")
    return F.when(n.isNotNull(), n > 0).otherwise(F.coalesce(F.lower(F.trim(F.col(c))).isin(*TRUE_WORDS), F.lit(False)))


def dedupe_names(samples: DataFrame, order: str) -> DataFrame:
    """The nth repeat of a name gets the suffix _n."""
    n = F.row_number().over(Window.partitionBy("stem").orderBy(order))
    return samples.withColumn("name", F.when(n > 1, F.concat_ws("_", "stem", n)).otherwise(F.col("stem")))


def pair_stages(paths: DataFrame) -> DataFrame:
    """Files that differ only in a pre or post token, where both exist."""
    token = r"(?i)(^|[_.-])(pre|post)([_.-]|$)"
    rows = paths.withColumn("stage", F.lower(F.regexp_extract("stem", token, 2))).where("stage <> ''").withColumn("key", F.regexp_replace("stem", token, "_"))
    return rows.groupBy("key").agg(F.max(F.when(F.col("stage") == "pre", F.col("path"))).alias("pre"), F.max(F.when(F.col("stage") == "post", F.col("path"))).alias("post")).dropna()


def pre_post(stages: DataFrame) -> DataFrame:
    """Genes of both stages with change, log ratio, direction and score. ``stages``: stage, gene, mean, detection."""
    pre, post = (stages.where(F.col("stage") == x).select(F.upper("gene").alias("gene"), F.col("mean").alias(f"mean_{x}"), F.col("detection").alias(f"detection_{x}")) for x in ("pre", "post"))
    j = pre.join(post, "gene").withColumn("delta_mean", F.col("mean_post") - F.col("mean_pre")).withColumn("delta_detection", F.col("detection_post") - F.col("detection_pre"))
    j = j.withColumn("logfc_like", F.log2((F.col("mean_post") + 1e-6) / (F.col("mean_pre") + 1e-6))).withColumn("direction", F.when(F.col("delta_mean") > 0, "up_post").when(F.col("delta_mean") < 0, "down_post").otherwise("unchanged"))
    return j.withColumn("candidate_score", F.abs("delta_mean") * (0.5 + F.greatest("detection_pre", "detection_post")) + 0.25 * F.abs("delta_detection"))


def seed_sequence(seeds: DataFrame, n: int) -> DataFrame:
    """Seeds that are calendar days (YYYYMMDD) go on by day, others by one."""
    day = F.expr("try_to_date(if(seed between 10000101 and 99991231, cast(seed as string), null), 'yyyyMMdd')")
    k = seeds.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return k.select("seed", "k", F.when(day.isNotNull(), F.date_format(F.date_add(day, F.col("k")), "yyyyMMdd").cast("long")).otherwise(F.col("seed") + F.col("k")).alias("value"))


def memory_preflight(spots: DataFrame, expr: DataFrame, warn_gb: float = 4.0) -> DataFrame:
    """S3: shape and dense size of each sample's matrix, with a warning above the limit."""
    n = spots.groupBy("sample").agg(F.count(F.lit(1)).alias("n_spots")).join(expr.groupBy("sample").agg(F.countDistinct("gene").alias("n_genes"), F.count(F.lit(1)).alias("stored_values")), "sample", "left")
    size = F.col("n_spots") * F.col("n_genes") * 8
    return n.withColumn("dense64_bytes", size).withColumn("dense32_bytes", (size / 2).cast("long")).withColumn("exceeds", size > warn_gb * 1024**3)


def spatial_qc(spots: DataFrame) -> DataFrame:
    """P10: coordinates missing everywhere warn, missing or non-finite ones somewhere fail."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    a = spots.groupBy("sample").agg(F.count(F.lit(1)).alias("n_spots"), F.sum((bad("x") | bad("y")).cast("long")).alias("bad"), F.sum((F.col("x").isNull() & F.col("y").isNull()).cast("long")).alias("absent"))
    return a.select("sample", "n_spots", "bad", F.when(F.col("absent") == F.col("n_spots"), "WARN").when(F.col("bad") > 0, "FAIL").otherwise("PASS").alias("spatial_qc_status"))


def input_audit(spots: DataFrame, expr: DataFrame) -> DataFrame:
    """What a matrix seems to hold, its zeros and totals, per sample."""
    n = spots.groupBy("sample").agg(F.count(F.lit(1)).alias("n_spots"), (F.count(F.lit(1)) - F.countDistinct("array_row", "array_col")).alias("duplicate_places"))
    v = expr.groupBy("sample").agg(F.countDistinct("gene").alias("n_genes"), F.count(F.lit(1)).alias("stored"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.avg((F.col("value") == F.floor("value")).cast("double")).alias("integers"))
    m = n.join(v, "sample", "left")
    zeros = 1 - F.try_divide("stored", F.col("n_spots") * F.col("n_genes"))
    whole = 1 - (1 - zeros) * (1 - F.col("integers"))
    state = F.when(F.col("stored").isNull(), "unknown").when(F.col("lowest") < 0, "centered_or_scaled").when(whole >= 0.995, "raw_counts").when(F.col("highest") <= 30, "log1p_normalized").otherwise("unknown_method")
    return m.select("sample", "n_spots", "n_genes", "stored", zeros.alias("zero_fraction"), "lowest", "highest", state.alias("expression_state"), "duplicate_places")


def variable_semantics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each column its mode (mask, proportion, score or categories), valid and missing values and different ones."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("v")) for c in columns))).alias("s")).select("s.*")
    n = F.expr("try_cast(v as double)")
    a = long.groupBy("variable").agg(F.count("v").alias("n_valid"), F.sum(F.col("v").isNull().cast("long")).alias("n_missing"), F.countDistinct("v").alias("n_different"), F.count(n).alias("numbers"), F.min(n).alias("lowest"), F.max(n).alias("highest"), F.sum((~F.coalesce(n.isin(0.0, 1.0), F.col("v").isin("true", "false"), F.lit(True))).cast("long")).alias("other"), F.sum(F.col("v").isin("true", "false").cast("long")).alias("flags"))
    mode = F.when((F.col("flags") == F.col("n_valid")) | (F.col("numbers") == F.col("n_valid")) & (F.col("other") == 0), "binary_mask").when((F.col("numbers") == F.col("n_valid")) & (F.col("lowest") >= 0) & (F.col("highest") <= 1), "proportion_composition").when(F.col("numbers") == F.col("n_valid"), "continuous_score").otherwise("categorical_state")
    return a.select("variable", mode.alias("mode"), "n_valid", "n_missing", "n_different")


def positions_strict(barcodes: DataFrame, positions: DataFrame) -> DataFrame:
    """Every barcode has to have a position; up to five that lack one are named in the error."""
    lost = [r["barcode"] for r in barcodes.join(positions, "barcode", "left_anti").orderBy("barcode").limit(5).collect()]
    if lost:
        raise ValueError(f"no position for {', '.join(map(str, lost))}")
    return barcodes.join(positions, "barcode")


def positions_lenient(barcodes: DataFrame, positions: DataFrame, order: str) -> DataFrame:
    """The first position of a barcode counts; coordinates are attached only if all spots have finite ones."""
    first = positions.withColumn("n", F.row_number().over(Window.partitionBy("barcode").orderBy(order))).where("n = 1").select("barcode", "x", "y")
    both = barcodes.join(first, "barcode", "left")
    complete = both.agg(F.coalesce(F.every(F.col("x").isNotNull() & F.col("y").isNotNull()), F.lit(False)).alias("complete"))
    return both.join(F.broadcast(complete)).select("barcode", F.when(F.col("complete"), F.col("x")).alias("x"), F.when(F.col("complete"), F.col("y")).alias("y"))
