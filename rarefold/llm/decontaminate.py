"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every word n-gram of a test item is a seed, whatever other copies of the item hold. Documents with one seed
of an item are aligned with it, word by word, so that passages with words changed, added or left out still
score; spans with too few of the item's words to reach the similarity are passed over. Only occurrences of item
n-grams leave the scan of the documents; the scan's filter has a fixed size whatever the benchmark's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import BitFilter, on_columns, staged, text_key, text_or_empty, texts_of, without_texts

_WORD = re.compile(r"\w+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Decontamination:
    gram: int = 3
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    #: share of an item's best possible score from which a passage counts as a copy
    similarity: float = 0.5


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in words), np.uint64, len(words))


def _grams(w: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the word n-grams; n is part of the hash."""
    with np.errstate(over="ignore"):
        h = np.full(max(0, len(w) - n + 1), n, np.uint64)
        for i in range(n):
            h = h * _MULT + w[i : len(w) - n + 1 + i]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))).view(np.int64)


def _item_grams(items: DataFrame, p: Decontamination) -> DataFrame:
    """(ikey, gram, ipos, n): an item with fewer words than p.gram is one n-gram of its own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column("ikey").to_pylist(), batch.column("item_text").to_pylist(), strict=True):
                w = _hashes(_WORD.findall(text))
                n = min(p.gram, len(w))
                out += [(key, g, i, n) for i, g in enumerate(_grams(w, n).tolist())] if n else []
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["ikey", "gram", "ipos", "n"])

    return items.mapInArrow(run, "ikey binary, gram long, ipos int, n int")


def _occurrences(documents: DataFrame, grams: DataFrame, p: Decontamination) -> DataFrame:
    """(tkey, gram, pos) where a document has an n-gram of some item."""
    known = BitFilter(grams.select("gram"))
    lengths = sorted(r.n for r in grams.select("n").distinct().collect())  # at most p.gram values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found, places = [], [], []
            for key, text in zip(batch.column("tkey").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = _hashes(_WORD.findall(text))
                for n in lengths:
                    g = _grams(w, n)
                    at = np.flatnonzero(known.test(g)) if len(g) else []
                    if len(at):
                        keys += [key] * len(at)
                        found.append(g[at])
                        places.append(at)
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(found or none)), pa.array(np.concatenate(places or none).astype(np.int64))], ["tkey", "gram", "pos"])

    text = documents.select(text_key("text").alias("tkey"), text_or_empty("text").alias("text"))
    return text.mapInArrow(run, "tkey binary, gram long, pos long")


def align(a: np.ndarray, b: np.ndarray, p: Decontamination) -> tuple[int, int, int]:
    """Best local alignment score of a in b, and the ends (exclusive) in a and b of the first place that has it."""
    h, best = np.zeros(len(b) + 1, np.int64), (0, 0, 0)
    slope = np.arange(len(b) + 1) * -p.gap
    for i, x in enumerate(a, 1):
        t = np.zeros(len(b) + 1, np.int64)
        np.maximum(h[:-1] + np.where(b == x, p.match, p.mismatch), h[1:] + p.gap, out=t[1:])
        np.maximum(t, 0, out=t)
        h = np.maximum.accumulate(t + slope) - slope  # gaps in a, all at once
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (int(h[j]), i, j)
    return best


def best_passage(item: np.ndarray, doc: np.ndarray, diagonals: list[int], p: Decontamination) -> tuple[int, int, int]:
    """(score, first word, end word) of the passage that aligns best, near the diagonals its seeds lie on; score 0 if none can be a copy."""
    m, best = len(item), (0, 0, 0)
    slack = m // 2 + 4
    spans: list[list[int]] = []
    for d in sorted(set(diagonals)):
        lo, hi = max(0, d - slack), min(len(doc), d + m + slack)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    for lo, hi in spans:
        part = doc[lo:hi]
        if np.isin(item, part).sum() < p.similarity * m:  # each matched word is in the span: the score stays below
            continue
        score, i, j = align(item, part, p)
        if score > best[0]:
            back = align(item[:i][::-1], part[:j][::-1], p)
            best = (score, lo + j - back[2], lo + j)
    return best


def contaminated(documents: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """(tkey, ikey, similarity, start, end): texts that hold a copy of an item, and where (code points).

    Similarity is the alignment score over the item's best possible one. Words are runs of letters, digits and
    underscores in lower case; an item without one matches nothing, null texts count as empty. Equal texts are aligned
    once. A copy in which no ``p.gram`` words of the item in a row are left has no seed and is not found.
    """
    items = benchmark.select(text_key("text").alias("ikey"), text_or_empty("text").alias("item_text")).dropDuplicates(["ikey"])
    grams = staged(_item_grams(items, p), "item-grams")
    hits = staged(_occurrences(documents, grams, p), "gram-hits")
    near = hits.distinct().join(grams.select("ikey", "gram", "ipos"), "gram")
    pairs = near.groupBy("tkey", "ikey").agg(F.collect_set(F.col("pos") - F.col("ipos")).alias("diagonals")).join(items, "ikey")
    wanted = staged(pairs.groupBy("tkey").agg(F.collect_list(F.struct("ikey", "item_text", "diagonals")).alias("items")), "candidates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, own in zip(*(batch.column(c).to_pylist() for c in ("tkey", "text", "items")), strict=True):
                found = list(_WORD.finditer(text))
                doc = _hashes([m[0] for m in found])
                for c in own:
                    item = _hashes(_WORD.findall(c["item_text"]))
                    score, lo, hi = best_passage(item, doc, c["diagonals"], p)
                    if score >= p.similarity * p.match * len(item):
                        out.append((key, c["ikey"], score / (p.match * len(item)), found[lo].start(), found[hi - 1].end()))
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.binary(), pa.binary(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["tkey", "ikey", "similarity", "start", "end"])

    return staged(texts_of(documents, wanted).select("tkey", "text", "items").mapInArrow(run, "tkey binary, ikey binary, similarity double, start long, end long"), "contaminated")


def contaminated_documents(documents: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """doc_id, item_id, similarity, start, end for every row and item whose passage it holds.

    Clean documents give no row; repeated documents and items give a row each. Columns other than doc_id, item_id and
    the texts are not read.
    """
    found = contaminated(documents, benchmark, p)
    docs = documents.select("doc_id", text_key("text").alias("tkey"))
    items = benchmark.select("item_id", text_key("text").alias("ikey"))
    return docs.join(found, "tkey").join(items, "ikey").select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start", "end")


def decontaminate(documents: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """``documents`` without the rows that hold a passage of the benchmark."""
    step = lambda d: without_texts(d, contaminated(d, benchmark, p).select("tkey").distinct())
    return on_columns(documents, ("text",), step)
