"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (pieces between line feeds). Every paragraph is hashed to
a wide vector and the vectors are summed lane by lane, modulo 2**32 or 2**16:

* ``EXACT`` lanes of 32 bits, from SHAKE-128 of the paragraph: equal sums mean equal multisets;
* ``SKETCH`` lanes of 16 bits: each word start of the paragraph adds +1 or -1, by a hash of the
  16 bytes from there to the paragraph's end at most, to one lane. The centred inner product of two
  such vectors estimates how much of the wording two texts share.

Sums don't depend on the order of paragraphs, and a paragraph is inserted or deleted by adding or
subtracting its vector, so an edited text's fingerprint costs only the paragraphs that changed.
The empty text is the empty multiset (all lanes 0); a null text counts as empty.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import partitions, to_bytes

EXACT, SKETCH, WINDOW = 32, 256, 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([[(1 << 8 * min(n, 8)) - 1, (1 << 8 * max(n - 8, 0)) - 1] for n in range(WINDOW + 1)], dtype=np.uint64)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


class Fingerprint:
    """A sum of paragraph vectors; supports ``+``, ``-``, ``==`` and ``likeness``."""

    __slots__ = ("exact", "sketch")

    def __init__(self, exact: np.ndarray, sketch: np.ndarray):
        self.exact, self.sketch = exact, sketch

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - other.exact, self.sketch - other.sketch)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.exact == other.exact).all() and (self.sketch == other.sketch).all())

    __hash__ = None

    def __str__(self) -> str:
        return base64.b64encode(self.exact.astype("<u4").tobytes() + self.sketch.astype("<u2").tobytes()).decode()

    def likeness(self, other: Fingerprint) -> float:
        """1.0 for equal fingerprints; otherwise 2<a,b> / (<a,a> + <b,b>) of the sketches, within [0, 1)."""
        if self == other:
            return 1.0
        a, b = (x.sketch.view(np.int16).astype(np.float64) for x in (self, other))
        size = a @ a + b @ b
        return float(min(max(2 * (a @ b) / size, 0.0), 1 - 2.0**-20)) if size else 0.0


def empty() -> Fingerprint:
    return Fingerprint(np.zeros(EXACT, np.uint32), np.zeros(SKETCH, np.uint16))


def _sum_exact(paragraphs: Iterable[bytes]) -> np.ndarray:
    wide = b"".join(hashlib.shake_128(p).digest(4 * EXACT) for p in paragraphs)
    return np.frombuffer(wide, "<u4").reshape(-1, EXACT).sum(axis=0, dtype=np.uint32)


def _sum_sketch(joined: bytes) -> np.ndarray:
    a = np.frombuffer(joined + bytes(WINDOW), np.uint8)
    n = len(joined)
    space = _SPACE[a[:n]]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.zeros(SKETCH, np.uint16)
    ends = np.append(np.flatnonzero(a[:n] == 10), n)
    left = np.minimum(ends[np.searchsorted(ends, starts)] - starts, WINDOW)
    x = np.lib.stride_tricks.sliding_window_view(a, WINDOW)[starts].view("<u8") & _MASKS[left]
    h = (x[:, 0] * _K1) ^ ((x[:, 1] + _K3) * _K2)
    h = (h ^ (h >> np.uint64(29))) * _K3
    h ^= h >> np.uint64(32)
    both = np.bincount((h >> np.uint64(7)).astype(np.int64) & (2 * SKETCH - 1), minlength=2 * SKETCH)
    return (both[:SKETCH] - both[SKETCH:]).astype(np.uint16)


def of_paragraphs(paragraphs: list[bytes]) -> Fingerprint:
    """The fingerprint of a multiset of paragraphs, none of which holds a line feed."""
    return Fingerprint(_sum_exact(paragraphs), _sum_sketch(b"\n".join(paragraphs))) if paragraphs else empty()


def of_text(text: str | None) -> Fingerprint:
    return of_paragraphs(to_bytes(text).split(b"\n")) if text else empty()


def replace_tail(whole: Fingerprint, text: str, cut: int, tail: str) -> Fingerprint:
    """The fingerprint of ``text[:cut] + tail`` from that of ``text``: deletes and inserts what changed."""
    if not text or not (text[:cut] or tail):
        return of_text(text[:cut] + tail)
    start = text.rfind("\n", 0, cut) + 1
    gone, new = text[start:], text[start:cut] + tail
    if gone == new:
        return whole
    return whole - of_paragraphs(to_bytes(gone).split(b"\n")) + of_paragraphs(to_bytes(new).split(b"\n"))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint) of every row; one pass without a shuffle. Empty table: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([str(of_text(t)) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next_document(docs: DataFrame, share: int = 4) -> DataFrame:
    """Fingerprints of every text and of the text whose last floor(n/share) code points are replaced by
    the start of the next document, by ascending doc_id; the first follows the last.

    Rows are dealt into contiguous id ranges (boundaries: approximate quantiles of the ids) and each
    range also gets the first row of the range after it, so texts are shuffled once and no global
    window is needed. Tasks stream over sorted rows and hold two texts at a time.

    Null texts are empty, null ids come first, rows that repeat an id follow each other by text (null
    first), an empty table gives no rows and a single row is its own next document.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    n = partitions(spark)
    ids = keyed.select(order.cast("double").alias("k"))
    cuts = np.unique(ids.approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else [])

    @pandas_udf("int")
    def range_of(k):
        return k.__class__(np.searchsorted(cuts, k.to_numpy(np.float64), side="right").astype(np.int32))

    dealt = keyed.withColumn("k", order).withColumn("range", range_of(F.col("k").cast("double")))
    firsts = sorted((r["range"], r["k"]) for r in dealt.groupBy("range").agg(F.min("k").alias("k")).collect())
    if not firsts:
        return spark.createDataFrame([], _SCHEMA)
    borders = [(firsts[(i + 1) % len(firsts)][1], part) for i, (part, _) in enumerate(firsts)]
    border = spark.createDataFrame(borders, "k long, range int")
    after = keyed.withColumn("k", order).join(F.broadcast(border), "k").select("range", F.lit(1).alias("after"), "doc_id", "text")
    rows = dealt.select("range", F.lit(0).alias("after"), "doc_id", "text").unionByName(after)
    return rows.repartition(n, "range").sortWithinPartitions("range", "after", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).mapInArrow(_stream(share), _SCHEMA)


def _stream(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next document has not come yet
        for batch in batches:
            out = []
            for part, after, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = text or ""
                if after and (held is None or held[0] != part):
                    continue
                own = of_text(text)
                if held is not None and held[0] == part:
                    out.append(_row(*held[1:], text, own, share))
                held = None if after else (part, doc, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)

    return run


_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in _SCHEMA.split(", ")]


def _row(doc, text: str, own: Fingerprint, following: str, their: Fingerprint, share: int) -> tuple:
    cut = len(text) - len(text) // share
    tail = following[: len(text) // share]
    edited = replace_tail(own, text, cut, tail)
    return doc, len(text), hashlib.sha256(to_bytes(text[:cut] + tail)).hexdigest(), str(own), str(edited), own.likeness(edited), own.likeness(their)
