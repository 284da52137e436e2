"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of ``budget`` times all words, limited to ``cap`` times its own words, the
excess shared out again by weight. Every document of a source is to be copied target / source size times:
the whole part is certain, the fraction is a probability. Pivotal rounding takes two documents with
fractional probabilities at a time and moves words of expectation from one to the other, up or down at
random so that expectations stay, until one of the two is integral. The words expected in total never
change, so each source misses its target by no more than the last document's size.

Leaves of ``leaf_rows`` documents, drawn by a hash, are worked off in sorted order, with one pending
document for each source; what is left over at the end of a leaf goes up a reduction tree in which
a node takes ``fan_in`` leaves, per source. Random numbers depend on the seed, the level, the leaf and
the source alone, so reruns agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, partitions, running

WEIGHTS = (3.0, 1.0, 2.0)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest of the text, and size: its words, runs of other than ASCII white space; null texts: 0."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("digest"), words.alias("size"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target.

    Sources in code point order, null last, take the weights in turn. With r = cap * size / weight ascending,
    a source is capped if the level that the sources from it on would share lies above its r. Both orders are made by
    ranges, so any number of sources can be dealt with.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turned = running(by_source, [F.col("source").asc_nulls_last()], {})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    rated = turned.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap))).withColumn("r", F.col("limit") / F.col("weight")).drop("place")
    filled = durable(running(rated, [F.col("r"), F.col("source").asc_nulls_last()], {"limits": "limit", "weights": "weight"}))
    words, weight = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    share = (F.lit(float((words or 0) * budget)) - F.col("limits")) / (F.lit(float(weight or 1)) - F.col("weights"))
    level = filled.withColumn("share", share).where(F.col("share") * F.col("weight") <= F.col("limit")).agg(F.min(F.struct("r", "limits", "weights", "share"))["share"]).first()[0]
    target = F.col("limit") if level is None else F.least(F.lit(level) * F.col("weight"), F.col("limit"))
    return filled.select("source", "source_size", target.alias("target"))


_IN = ["doc_id", "source", "digest", "size", "source_size", "target", "base", "p", "node"]
_OUT = "doc_id long, source string, digest long, size long, source_size long, target double, base int, p double, node long, open boolean"


def _pair(w1: float, p1: float, w2: float, p2: float, u: float) -> tuple[float, float]:
    """Probabilities after words of expectation moved between two documents; one of them is 0 or 1."""
    up, down = min((1 - p1) * w1, p2 * w2), min(p1 * w1, (1 - p2) * w2)
    if u * (up + down) < down:  # the first gains
        return (1.0, min(max(p2 - up / w2, 0.0), 1.0)) if (1 - p1) * w1 <= p2 * w2 else (min(p1 + up / w1, 1.0), 0.0)
    return (0.0, min(p2 + down / w2, 1.0)) if p1 * w1 <= (1 - p2) * w2 else (max(p1 - down / w1, 0.0), 1.0)


def _round(seed: int, level: int, last: bool):
    """Rows sorted by node and source; gives each back with p 0 or 1, or open with what is still undecided."""
    at = {n: i for i, n in enumerate(_IN)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rng, held = None, None, None

        def settled(row: list, p: float) -> tuple:
            row[at["p"]] = p
            return (*row, False)

        def left_over() -> list[tuple]:
            if held is None:
                return []
            return [settled(held, float(rng.random() < held[at["p"]]))] if last else [(*held, True)]

        for b in batches:
            out = []
            for row in map(list, zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if key != (row[at["node"]], row[at["source"]]):
                    out += left_over()
                    key, held = (row[at["node"]], row[at["source"]]), None
                    rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(repr((seed, level, *key)).encode(), digest_size=16).digest(), "big"))
                p, w = row[at["p"]], row[at["size"]]
                if w == 0 or p in (0.0, 1.0):
                    out.append(settled(row, float(p == 1.0)))
                elif held is None:
                    held = row
                else:
                    q1, q2 = _pair(held[at["size"]], held[at["p"]], w, p, rng.random())
                    first, held = held, None
                    for x, q in ((first, q1), (row, q2)):
                        if q in (0.0, 1.0):
                            out.append(settled(x, q))
                        else:
                            x[at["p"]], held = q, x
            if out:
                yield _batch(out)
        if rest := left_over():
            yield _batch(rest)

    return run


_TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0, seed: int = 20240, leaf_rows: int = 8192, fan_in: int = 32) -> DataFrame:
    """Every document with its size, source_size, target, copies and taken (copies * size).

    Empty and null texts have size 0 and take nothing; a null source is a source of its own; rows that
    repeat are documents of their own. An empty table gives an empty one.
    """
    sized = durable(sizes(docs))
    aim = targets(sized, weights, budget, cap)
    per = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    rows = sized.join(aim, sized["source"].eqNullSafe(aim["source"])).select(sized["*"], "source_size", "target", per.alias("per"))
    leaves = max(1, -(-sized.count() // leaf_rows))
    rows = rows.withColumn("base", F.floor("per").cast("int")).withColumn("p", F.col("per") - F.col("base")).withColumn("node", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(leaves))).select(_IN)
    level, done = 0, []
    while True:
        n = min(leaves, partitions(docs.sparkSession))
        dealt = rows.repartition(n, "node") if level == 0 else rows.repartition(n, "source", "node")
        got = durable(dealt.sortWithinPartitions("node", "source", "doc_id", "digest", "size").mapInArrow(_round(seed, level, leaves == 1), _OUT))
        done.append(got.where("not open"))
        if leaves == 1:
            break
        leaves, level = -(-leaves // fan_in), level + 1
        rows = got.where("open").withColumn("node", F.floor(F.col("node") / fan_in)).select(_IN)
    whole = done[0]
    for x in done[1:]:
        whole = whole.unionByName(x)
    copies = (F.col("base") + F.col("p")).cast("int")
    return whole.select("doc_id", "source", "digest", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it. Rows alike in id, source and text are numbered, so each
    gets a decision of its own."""
    keys = ["__doc", "__source", "__digest"]
    alike = Window.partitionBy(keys).orderBy("__digest")
    decided = mix(docs, **options)
    take = decided.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__doc"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__source"), F.col("digest").alias("__digest"), "copies")
    take = take.withColumn("__n", F.row_number().over(alike)).where("copies > 0").withColumnRenamed("copies", "__copies")
    rows = docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")), "__digest": F.xxhash64("text")}).withColumn("__n", F.row_number().over(alike))
    joined = rows.join(take, [*keys, "__n"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies")))
    return joined.select(docs.columns)
