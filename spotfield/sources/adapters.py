"""Tables in the canonical model: spots, expr (stored non-zeros), programs.

Customers are spots on a hexagonal lattice, brands are genes and quantities counts; embeddings are a second,
centred sample. Every table has a ``sample`` column, and no statistic crosses samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C_GENES = tuple(f"Brand#{i}" for i in range(1, 7))
S_GENES = tuple(f"Brand#{i}" for i in range(11, 17))
H_GENES = tuple(f"Brand#{i}" for i in range(17, 21))
V_GENES = tuple(f"Brand#{i}" for i in range(21, 26))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    row = F.floor(F.col("c_custkey") / 40).cast("int")
    col = (2 * (F.col("c_custkey") % 40) + row % 2).cast("int")
    return c.select(F.lit("cust").alias("sample"), F.col("c_custkey").cast("long").alias("spot"), col.cast("double").alias("x"), (row * F.sqrt(F.lit(3.0))).alias("y"), row.alias("array_row"), col.alias("array_col"), F.lit(1).alias("in_tissue"), F.col("c_mktsegment").alias("label"), F.col("c_nationkey").cast("int").alias("stratum"), (F.col("c_acctbal") > 0).alias("mask"), F.col("c_acctbal").alias("score"))


def customer_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, p = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    return rows.groupBy(F.col("o_custkey").cast("long").alias("spot"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value")).where("value <> 0").select(F.lit("cust").alias("sample"), "spot", "gene", "value")


def embedding_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    row = F.floor(F.col("vec_id") / 25).cast("int")
    return e.select(F.lit("emb").alias("sample"), F.col("vec_id").alias("spot"), row.alias("array_row"), (2 * (F.col("vec_id") % 25) + row % 2).cast("int").alias("array_col"), F.col("label").cast("string").alias("label"))


def embedding_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("d", "v"))
    return e.select(F.lit("emb").alias("sample"), F.col("vec_id").alias("spot"), F.format_string("D%d", F.col("d") + 1).alias("gene"), F.col("v").cast("double").alias("value")).where("value <> 0")


def program_table(spark: SparkSession, **programs: tuple[str, ...]) -> DataFrame:
    """(program, gene, requested_order); a list of genes that the caller gave, so it is small."""
    return spark.createDataFrame([(p, g, i + 1) for p, genes in programs.items() for i, g in enumerate(genes)], "program string, gene string, requested_order int")
