"""A corpus pipeline: quality, language, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept and is written as
Parquet before the next begins. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotfield.llm import compression, jaccard, mixing, packing
from spotfield.llm.common import checkpoint_dir, fold, table


def _fresh(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """Names that no column of ``docs`` has, so that a stage's own columns replace none of the caller's."""
    taken = {c.lower() for c in docs.columns}
    while any(n in taken for n in names):
        names = tuple(f"_{n}" for n in names)
    return names


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the compression classifier predicts to be good; learns from labels outside its test fold.

    Null and empty texts have the score of difference 0, which the labels' shares decide; equal texts share their fate; an
    empty table stays empty; columns that are called like the model's stay as they are.
    """
    score, predicted = _fresh(docs, "score", "predicted")
    model = compression.fit_quality(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return compression.quality_scores(docs, model, 0.3, (score, predicted)).where(f"{predicted} = 1").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a margin that isn't narrow for their length.

    Texts without a letter, null and empty ones included, have no language and go; equal texts share their fate; an empty table
    stays empty; columns that are called like the model's stay as they are.
    """
    names = _fresh(docs, "lang_pred", "margin", "accepted", "letter_bytes")
    model = compression.fit_languages(docs.where(~F.coalesce(fold("doc_id", 4) == 2, F.lit(False))))
    return compression.language_id(docs, model, names).where(names[2]).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, of the smallest id, of each group joined by five-word shingles at 0.75, and all without words.

    Rows are judged each by its own text, also where ids repeat or are null; of rows that agree in id and text one stays; a group
    without any id keeps one row.
    """
    judged = jaccard.labelled(docs, n=5, percent=75)
    row, words, number = _fresh(docs, "row_key", "has_words", "number")
    kept = judged.where("n_shingles > 0 and doc_id <=> component_id").groupBy("component").agg(F.min("row").alias(row)).select(row, F.lit(True).alias(words))
    kept = kept.unionByName(judged.where("n_shingles = 0").select(F.col("row").alias(row), F.lit(False).alias(words)).distinct())
    rows = docs.withColumn(row, jaccard.row_of()).join(kept, row)
    several = rows.where(words).dropDuplicates([row])
    return several.unionByName(rows.where(f"not {words}")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights.

    Documents without words, null texts included, have size 0: no target counts them, and they have as many copies as the whole
    part of their source's ratio. A null source is a source of its own; repeated rows are documents of their own.
    """
    return mixing.mixed_documents(docs, weights=mixing.WEIGHTS, budget=1.5, cap=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences; a null or empty text is its end id alone, a text of more
    tokens has several pieces, and repeated rows have pieces of their own."""
    return packing.pack(packing.tokenized_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048), capacity=2048)


STAGES = [("quality classifier", quality), ("language ID", language), ("n-gram Jaccard join", near_duplicates), ("mixing sources", mix), ("best-fit packing", pack)]

#: The learned and the random stages have no SQL. Tests recompute the whole on a small table: classifiers by zstandard on their
#: fitted dictionaries, links by comparing all pairs of shingle sets, targets by filling to a level, pieces by the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again, and goes once the next one is written."""
    folder, docs = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}")
        docs = spark.read.parquet(path)
        if k:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
