"""Token counts of a unigram tokenizer without building tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at a character; a
forward pass keeps the best score and the piece count that goes with it. Ties follow the tokenizers
library's unigram model: among equal scores the piece that starts first stays, sums
are taken from the left, a character that is no piece of its own costs ten less than
the lowest score and counts as its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from rarefold.llm.common import text_or_empty

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000


@cache
def unigram_vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """(piece, score) in id order from a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()))


class PieceCounter(dict):
    """word -> number of pieces; filled on demand and bounded."""

    def __init__(self, vocabulary: tuple[tuple[str, float], ...]):
        super().__init__()
        self.found = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY

    def count(self, word: str) -> int:
        ending: list[list] = [[] for _ in word]
        for end, match in self.found.iter(word):
            ending[end].append(match)
        best, pieces = [0.0] * (len(word) + 1), [0] * (len(word) + 1)
        for end, char in enumerate(word, 1):
            top, n = None, 0
            for length, score in sorted(ending[end - 1], reverse=True) if len(ending[end - 1]) > 1 else ending[end - 1]:
                s = score + best[end - length]
                if top is None or s > top:
                    top, n = s, pieces[end - length] + 1
            if char not in self.single and (top is None or self.unknown + best[end - 1] > top):
                top, n = self.unknown + best[end - 1], pieces[end - 1] + len(char.encode("utf-8", "surrogatepass"))
            best[end], pieces[end] = top, n
        return pieces[-1]

    def __missing__(self, word: str) -> int:
        n = self.count(SPACE + word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n

    def text(self, text: str) -> int:
        """Pieces of a text; spaces mark word starts, and one is put in front if there is none."""
        if not text:
            return 0
        words = text.replace(" ", SPACE).split(SPACE)
        return sum(map(self.__getitem__, words if words[0] else words[1:]))


@cache
def _counter(path: str) -> PieceCounter:
    return PieceCounter(unigram_vocabulary(path))


def count_tokens(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id and n_tokens (long) for every row; null and empty texts have 0.

    Whole texts are counted, in Arrow batches and without a shuffle; repeated rows count each and other
    columns are not read. ``model_path`` is read on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in batches:
            counts = [counter.text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long")
