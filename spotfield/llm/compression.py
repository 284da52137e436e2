"""Classification by compression: the label whose raw-content zstandard dictionary packs a text best.

``language_id`` compares one dictionary per language and rejects a text when the two smallest sizes
are too close for its length; ``quality_scores`` turns the normalised difference between the sizes under a "good"
and a "bad" dictionary into a calibrated probability.

Models are fitted on a bounded sample (``Fit``): per label the ``sample_rows`` labelled rows with the smallest hashes.
Two thirds of them share a dictionary of at most ``dictionary_bytes`` evenly, each with an excerpt that begins at a place
drawn by a hash; the rest, whole texts scored where they lie, calibrate margins and probabilities. Only excerpts and
numbers reach the driver. Predictions read whole texts. Model size is the number of labels times ``dictionary_bytes``,
whatever the table's size, and travels in the task closure.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import small_batches, to_bytes


@dataclass(frozen=True)
class Fit:
    """The bounds of the sample of each label, and the compressor's level."""

    sample_rows: int = 1200
    dictionary_bytes: int = 256 * 1024
    level: int = 6

    def held(self, rank: str) -> str:
        """SQL: whether the sampled row of this rank, from 1, calibrates and doesn't enter the dictionary."""
        return f"{rank} % 3 = 0"

    def row_bytes(self, rows: int) -> int:
        """Bytes that each of a label's sampled rows may give to its dictionary."""
        return self.dictionary_bytes // max(1, min(rows, self.sample_rows) - min(rows, self.sample_rows) // 3)


class Packer:
    """Sizes of one text under each of some raw-content dictionaries (and none, for ``None``)."""

    def __init__(self, dictionaries: list[bytes], level: int):
        self.each = [self._one(d, level) for d in dictionaries]

    @staticmethod
    def _one(raw: bytes, level: int) -> Callable[[bytes], bytes]:
        options = {"level": level, "write_content_size": False, "write_dict_id": False}
        if len(raw) < 8:
            return zstandard.ZstdCompressor(**options).compress
        made = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=made, **options).compress

    def sizes(self, raw: bytes) -> list[int]:
        return [len(f(raw)) for f in self.each]


def label_counts(rows: DataFrame) -> dict:
    """label -> rows. One row for each label reaches the driver, where the model will hold a dictionary of each."""
    return {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}


def ranked_sample(rows: DataFrame, counts: dict, n: int) -> DataFrame:
    """The ``n`` rows of each label with the smallest ``key`` (a hash), with their ``rank``. Keys over a bound that lets
    three times as many rows pass fall first, so that a label with most rows is no larger a group than others."""
    if not counts:
        return rows.withColumn("rank", F.lit(0)).where("false")
    bound = F.create_map(*(x for label, c in counts.items() for x in (F.lit(label), F.lit(min(1 << 31, (3 * n + 200) * (1 << 31) // c)))))
    low = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 31)) < F.element_at(bound, F.col("label")))
    by = Window.partitionBy("label").orderBy(F.pmod(F.xxhash64("key"), F.lit(1 << 31)), "key")
    return low.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def excerpt(raw: bytes, most: int) -> bytes:
    """At most ``most`` bytes, from a place that the text's checksum draws."""
    if len(raw) <= most:
        return raw
    at = zlib.crc32(raw) % (len(raw) - most + 1)
    return raw[at : at + most]


def dictionaries_of(texts: DataFrame, counts: dict, fit: Fit, label_type: str, clean: Callable[[str], str]) -> dict:
    """label -> dictionary, from (label, key, text) of sampled rows; excerpts in the order of their keys."""
    share = {label: fit.row_bytes(c) for label, c in counts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [excerpt(to_bytes(clean(t)), share[x]) for x, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cut, pa.binary())], ["label", "key", "cut"])

    out: dict = {}
    for r in sorted(texts.select("label", "key", "text").mapInArrow(run, f"label {label_type}, key long, cut binary").collect(), key=lambda r: (r["key"], r["cut"])):
        out.setdefault(r["label"], []).append(bytes(r["cut"]))
    return {label: b"\n".join(cuts)[: fit.dictionary_bytes] for label, cuts in out.items()}


def _with_columns(docs: DataFrame, names: tuple[str, ...], types: tuple[str, ...], of_text: Callable[[], Callable[[str | None], tuple]]) -> DataFrame:
    """``docs`` and the columns that ``of_text()`` makes of each whole text; columns of the same names are replaced."""
    small_batches(docs.sparkSession)
    kept = docs.drop(*names)
    arrow = [{"string": pa.string(), "double": pa.float64(), "integer": pa.int32(), "boolean": pa.bool_()}[x] for x in types]
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = of_text()
        for b in batches:
            rows = [each(t) for t in b.column(at).to_pylist()]
            cols = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, arrow, strict=True))], [*b.schema.names, *names])

    schema = StructType(list(kept.schema))
    for n, x in zip(names, types, strict=True):
        schema = schema.add(n, x)
    return kept.mapInArrow(run, schema)


# ---------------------------------------------------------------- language


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int
    margins: tuple[float, ...] = ()


_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The lower-cased words of a text without what other signs and digits stand between them."""
    return _OTHER.sub(" ", text.lower()).strip()


def _length_class(n: int) -> int:
    """Lengths in bytes by powers of two, to 16 KiB and more."""
    return min(n.bit_length(), 15)


def margins_of(told: list[tuple[int, float]], least_rows: int = 50, share: float = 0.01) -> tuple[float, ...]:
    """The least margin to accept for each ``_length_class``: half the ``share`` quantile of the margins of texts told right,
    (class, margin). A class of under ``least_rows`` texts takes that of the next shorter class, else of the next longer one."""
    out: list[float | None] = []
    for c in range(16):
        own = [m for x, m in told if x == c]
        out.append(float(np.quantile(own, share)) / 2 if len(own) >= least_rows else None)
    known = [c for c in range(16) if out[c] is not None]
    if not known:
        return (0.0,) * 16
    return tuple(out[max((k for k in known if k <= c), default=known[0])] for c in range(16))


def fit_languages(docs: DataFrame, fit: Fit = Fit()) -> LanguageModel:
    """One dictionary of the ``letters`` of sample texts for each non-null ``lang``, and the least margins for texts by length.

    Rows that repeat an id count as rows of their own, those that repeat id and text once or as often as they fall in the sample;
    a row without a text or a language teaches nothing. An empty table gives a model without languages.
    """
    rows = docs.where("text is not null and lang is not null").select(F.col("lang").alias("label"), F.xxhash64("doc_id", "text").alias("key"), "text")
    counts = label_counts(rows)
    keys = ranked_sample(rows.select("label", "key"), counts, fit.sample_rows).withColumn("held", F.expr(fit.held("rank"))).select("label", "key", "held").distinct().collect()
    if not keys:
        return LanguageModel((), (), fit.level)
    few = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in keys], "label string, key long, held boolean"))  # sample_rows a label
    sampled = rows.join(few, ["label", "key"])
    made = dictionaries_of(sampled.where("not held"), counts, fit, "string", letters)
    names = tuple(sorted(made, key=lambda x: (-counts[x], x.encode())))
    model = LanguageModel(names, tuple(made[x] for x in names), fit.level)
    scored = language_id(sampled.where("held").select("label", "text"), model, ("told", "margin", "accepted", "bytes"))
    told = [(_length_class(r["bytes"]), r["margin"]) for r in scored.where("told = label").select("bytes", "margin").collect()]
    return LanguageModel(names, model.dictionaries, fit.level, margins_of(told))


def language_id(docs: DataFrame, model: LanguageModel, names: tuple[str, str, str, str] = ("lang_pred", "score", "accepted", "letter_bytes")) -> DataFrame:
    """``docs`` with lang_pred, score, accepted and letter_bytes (under the given names; columns so called are replaced).

    score is the margin: (second smallest size - smallest) / second smallest, within 0 to 1. Texts without a letter,
    null and empty ones included, get ``und`` and score 0, as do all texts if no language was learned; they and
    texts whose margin is under the model's least one for their length are not accepted. Equal sizes go to the language with
    more learned rows, then to the first in code point order. With a single language its score is 1. Rows are judged each by
    itself, so repeated ones alike; an empty table gives an empty one.
    """
    languages, dictionaries, level, least = model.languages, list(model.dictionaries), model.level, model.margins or (0.0,) * 16

    def start():
        packer = Packer(dictionaries, level)

        def one(text):
            if not languages or not text or not any(map(str.isalpha, text)):
                return "und", 0.0, False, 0
            raw = to_bytes(letters(text))
            sizes = packer.sizes(raw)
            best = min(range(len(sizes)), key=sizes.__getitem__)
            second = min(sizes[:best] + sizes[best + 1 :], default=0)
            score = (second - sizes[best]) / second if second else 1.0
            return languages[best], score, score >= least[_length_class(len(raw))], min(len(raw), (1 << 31) - 1)

        return one

    return _with_columns(docs, names, ("string", "double", "boolean", "integer"), start)


# ---------------------------------------------------------------- quality


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    level: int
    slope: float
    offset: float


def _difference(sizes: list[int], n: int) -> float:
    """(size under bad - size under good) / bytes of text; the empty text gives 0."""
    return (sizes[1] - sizes[0]) / n if n else 0.0


def fit_quality(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(dictionary_bytes=512 * 1024)) -> QualityModel:
    """Dictionaries from two thirds of the sampled rows of each class, the logistic calibration from the whole texts of the others,
    weighted by how common the classes are among all given labels.

    Ids without a label of 0 or 1 or with both teach nothing, nor do null texts; of rows that repeat a labelled id each text counts.
    Without rows of both classes the score is the constant share of good labels (0.5 without any).
    """
    alike = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.min("quality").cast("int").alias("label"), F.max("quality").cast("int").alias("other"))
    rows = alike.where("label = other").select("label", "key")
    counts = label_counts(rows)
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    constant = QualityModel(b"", b"", fit.level, 0.0, math.log(share / (1 - share)))
    if len(counts) < 2:
        return constant
    keys = ranked_sample(rows, counts, fit.sample_rows).withColumn("held", F.expr(fit.held("rank"))).select("label", "key", "held").collect()
    few = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in keys], "label int, key long, held boolean"))  # 2 * sample_rows rows
    sampled = docs.select(F.col("doc_id").cast("long").alias("key"), "text").where("text is not null").join(few, "key")
    made = dictionaries_of(sampled.where("not held"), counts, fit, "int", str)
    if len(made) < 2:
        return constant
    model = QualityModel(made[1], made[0], fit.level, 0.0, 0.0)
    held = [tuple(r) for r in _differences(sampled.where("held").select("label", "text"), model).select("label", "difference").collect()]
    size = {x: sum(label == x for label, _ in held) for x in (0, 1)}
    if not all(size.values()):
        return constant
    w = [counts[label] / sum(counts.values()) / size[label] for label, _ in held]
    return QualityModel(made[1], made[0], fit.level, *logistic(np.array([d for _, d in held]), np.array([float(x) for x, _ in held]), np.array(w)))


def _differences(docs: DataFrame, model: QualityModel) -> DataFrame:
    def start():
        packer = Packer([model.good, model.bad], model.level)

        def one(text):
            raw = to_bytes(text)
            return (_difference(packer.sizes(raw), len(raw)),)

        return one

    return _with_columns(docs, ("difference",), ("double",), start)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-6) -> tuple[float, float]:
    """(slope, offset) of a weighted, slightly damped logistic regression on one feature, by Newton's method."""
    spread = float(np.std(x)) or 1.0
    a = np.column_stack([x / spread, np.ones_like(x)])
    w, b = w / w.sum(), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (w * (y - p)) - ridge * b
        hess = (a * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b += step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / spread), float(b[1])


def quality_scores(docs: DataFrame, model: QualityModel, threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with score (calibrated probability of the good class) and predicted (1 if score >= threshold), under the given
    names; columns so called are replaced.

    Empty and null texts get the score of difference 0. Rows are judged each by itself, so repeated ones alike; an empty
    table gives an empty one.
    """

    def start():
        packer = Packer([model.good, model.bad], model.level)

        def one(text):
            raw = to_bytes(text)
            z = model.slope * (_difference(packer.sizes(raw), len(raw)) if raw else 0.0) + model.offset
            score = 1 / (1 + math.exp(-min(max(z, -700), 700)))
            return score, int(score >= threshold)

        return one

    return _with_columns(docs, names, ("double", "integer"), start)
