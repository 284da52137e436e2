"""What the corpus operators share: reading tables, folds, words, durable cuts of lineage."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.durable import checkpoint_dir, durable  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids stay null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder, as a plain path, that the driver and all executors can open.

    The checkpoint folder has to be a mounted file system for this (``file:`` or no scheme);
    memory-mapped files can be opened nowhere else.
    """
    uri = urlparse(checkpoint_dir(spark))
    if uri.scheme not in ("", "file"):
        raise ValueError(f"{label}: memory-mapped levels need a mounted spark.checkpoint.dir, not {uri.scheme}:")
    path = os.path.join(unquote(uri.path), f"{label}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def to_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and 8 MB, where the session has its defaults, so that whole texts and packed rows stay
    few in a Python worker."""
    for name, default, ours in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "8388608b")):
        if spark.conf.get(key := f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(key, ours)


def running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, in ``order``, which tells all rows apart) and, under each name in ``sums``, the sum of that
    column over the rows before. Ranges are numbered each by itself; only a range's count and sums reach the driver."""
    spark = rows.sparkSession
    dealt = durable(rows.repartitionByRange(partitions(spark), *order).withColumn("range", F.spark_partition_id()))
    totals = sorted(tuple(r) for r in dealt.groupBy("range").agg(F.count(F.lit(1)).cast("double"), *(F.sum(c).cast("double") for c in sums.values())).collect())
    offsets, now = [], [0.0] * (1 + len(sums))
    for part, *own in totals:
        offsets.append((part, *now))
        now = [a + b for a, b in zip(now, own, strict=True)]
    names = [f"before_{i}" for i in range(1 + len(sums))]
    before = spark.createDataFrame(offsets, "range int, " + ", ".join(f"{n} double" for n in names))  # a row for each range
    inside = Window.partitionBy("range").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.join(F.broadcast(before), "range").withColumn("place", (F.col(names[0]) + F.row_number().over(inside) - 1).cast("long"))
    for n, (name, column) in zip(names[1:], sums.items(), strict=True):
        found = found.withColumn(name, F.col(n) + F.coalesce(F.sum(column).over(earlier), F.lit(0.0)))
    return found.drop("range", *names)
