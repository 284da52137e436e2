"""Token counts without tokens: count-only Viterbi over a unigram vocabulary.

The vocabulary is a public piece file's list of pieces and scores, read as a unigram model with byte
fallback. White space marks a word's start (``▁``) and no piece crosses it, so each word is solved by
itself and solved words are kept in a cache of bounded size. An Aho-Corasick automaton enumerates all
pieces that end at a position, longest first; dynamic programming carries the best score and the number
of pieces on the best path.

Tie rules are those of the usual unigram encoder in double precision: candidates for an end are taken by
ascending start and only a strictly greater score replaces. A character for which no single-character
piece exists may be unknown, at the least score minus 10, and then counts as its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, UNKNOWN_PENALTY = "▁", 10.0


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id, of a sentencepiece model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Piece counts and best scores of texts; ``pieces`` is a list of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]], most_words: int = 400_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.breaks = not any("\n" in p for p, _ in pieces)
        self.most_words, self.words = most_words, {}

    def word(self, chunk: str) -> tuple[int, float]:
        """(pieces, score) of the best path through one chunk; the first of equal ones by the tie rules."""
        n = len(chunk)
        score, count, ends = [0.0] * (n + 1), [0] * (n + 1), [[] for _ in range(n + 1)]
        for last, found in self.automaton.iter(chunk):
            ends[last + 1].append(found)
        for end in range(1, n + 1):
            best, pieces, single = None, 0, False
            for length, s in ends[end]:
                candidate = s + score[end - length]
                if best is None or candidate > best:
                    best, pieces = candidate, count[end - length] + 1
                single = single or length == 1
            if not single:
                candidate = self.unknown + score[end - 1]
                if best is None or candidate > best:
                    best, pieces = candidate, count[end - 1] + len(chunk[end - 1].encode("utf-8", "surrogatepass"))
            score[end], count[end] = best, pieces
        return count[n], score[n]

    def _known(self, chunk: str) -> tuple[int, float]:
        found = self.words.get(chunk)
        if found is None:
            if len(self.words) >= self.most_words:
                self.words.clear()
            found = self.words[chunk] = self.word(chunk)
        return found

    def text(self, text: str | None) -> tuple[int, float]:
        """(pieces, score) of a whole text; a null or empty one has none."""
        if not text:
            return 0, 0.0
        total, score = 0, 0.0
        text = text.replace(MARK, " ")
        text = text if text[0] == " " else " " + text
        known, solve = self.words.get, self._known
        for k, line in enumerate(text.split("\n") if self.breaks else [text]):
            words = line.split(" ")
            if k:  # the line feed itself is an unknown character of one byte
                total, score = total + 1, score + self.unknown
            if words[0]:
                n, s = known(words[0]) or solve(words[0])
                total, score = total + n, score + s
            for w in words[1:]:
                n, s = known(w := MARK + w) or solve(w)
                total, score = total + n, score + s
        return total, score


@lru_cache(maxsize=2)
def cached_counter(path: str) -> UnigramCounter:
    return UnigramCounter(read_pieces(path))


def token_counts(docs: DataFrame, pieces_path: str) -> DataFrame:
    """doc_id, n_tokens and best_score of every whole text; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = cached_counter(pieces_path).text
        for b in batches:
            found = [count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "n_tokens", "best_score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, best_score double")
