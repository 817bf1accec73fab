"""Token counts of a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic programming carries to each place the best score and the number of pieces of the path
that has it.  Ties go as in the tokenizer: a later path has to be better, and paths come by start of their last piece.  A character
that no piece of one character covers may be unknown, at a penalty; neighbouring unknowns are one piece."""
from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.tokens import Cache

SPACE = "▁"                     # stands for a blank and begins every word
UNKNOWN_PENALTY = 10.0
LONG_WORD = 64                       # longer ones are not kept in the cache


class Vocabulary(NamedTuple):
    pieces: list[tuple[str, float]]
    lowest: float


def vocabulary(model_path: str | None = None) -> Vocabulary:
    """Pieces of a public vocabulary with unigram scores by rank (Zipf's law); its control and byte pieces are left out."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_path or public_tokenizers.path("piece_bpe_32k.model"))
    names = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(names))))
    pieces = [(p, -math.log(r + 1) - total) for r, p in enumerate(names)]
    return Vocabulary(pieces, min(s for _, s in pieces))


class Counter:
    """Counts the pieces of words."""

    def __init__(self, words: Vocabulary):
        self._automaton = ahocorasick.Automaton()
        for piece, score in words.pieces:
            self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._singles = {p for p, _ in words.pieces if len(p) == 1}
        self._unknown = words.lowest - UNKNOWN_PENALTY
        self._cache = Cache(self.pieces)

    def pieces(self, word: str) -> int:
        """Pieces of the best path through a word; of equal scores the path whose last piece starts first."""
        n = len(word)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = iter(self._automaton.iter(word))
        ahead = next(matches, None)
        singles, penalty = self._singles, self._unknown
        for end in range(1, n + 1):
            top, start, lost = -math.inf, -1, False
            while ahead is not None and ahead[0] == end - 1:
                length, score = ahead[1]
                value = score + best[end - length]
                if value > top or (value == top and end - length < start):
                    top, start = value, end - length
                ahead = next(matches, None)
            if word[end - 1] not in singles and penalty + best[end - 1] > top:
                top, start, lost = penalty + best[end - 1], end - 1, True
            best[end], unknown[end] = top, lost
            count[end] = count[start] + (not (lost and unknown[start]))
        return count[n]

    def count(self, text: str) -> int:
        """Pieces of a text: every blank (or its sign) begins a word, and so does a text that does not begin with one."""
        if not text:
            return 0
        cache, total = self._cache, 0
        words = text.replace(SPACE, " ").split(" ")
        for word in words if words[0] else words[1:]:
            total += cache[SPACE + word] if len(word) <= LONG_WORD else self.pieces(SPACE + word)
        return total


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, n_chars`` for every row of ``docs (doc_id, text, ...)``; null and empty texts have no token."""
    model_path = model_path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(model_path).count
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array([count(t) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64())],
                                  names=["doc_id", "n_tokens", "n_chars"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_chars long")
