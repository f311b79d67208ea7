"""Periodic runs of words by an online sparse dynamic program over diagonals.

A diagonal is a lag: word i matches the word ``lag`` places before it. Going through the words, each
earlier occurrence of the word at hand lengthens the diagonal at its lag, and a diagonal that ends long enough
emits its run at once. Lags are taken in levels, L <= lag < 4 L with L = 1, 4, 16, ...; a level
starts diagonals only where 2 L words agree at once, as any run of such a lag makes them, and never inside runs
of a shorter period: by the critical factorisation theorem every period of a longer run has a place where no shorter
square is centred, so the run is still met there. That leaves at most eight earlier
occurrences a word and level: a text of n words takes about n log n steps, however repetitive it is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rarefold.llm.common import text_or_empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
Run = tuple[int, int, int]


def _sweep(ids: list[int], starts: list[int], symbol: list[int], low: int, seen: dict[tuple[int, int], int]) -> None:
    """Runs whose period is from ``low`` to 4 ``low`` - 1, into ``seen`` ((start, length) -> least period).

    ``starts`` are the words at which a diagonal may start, rising, and ``symbol`` tells which of them agree.
    """
    n, high = len(ids), 4 * low
    active: dict[int, int] = {}  # lag -> words matched so far
    places: dict[int, list[int]] = {}  # symbol -> its last places

    def end(lag: int, at: int) -> None:
        length = active.pop(lag) + lag
        if length >= max(6, 4 * lag):
            seen.setdefault((at - length, length), lag)

    def step(at: int) -> None:
        word = ids[at]
        ended = []
        for lag in active:
            if ids[at - lag] == word:
                active[lag] += 1
            else:
                ended.append(lag)
        for lag in sorted(ended):
            end(lag, at)

    at = 0
    for i, s in zip(starts, symbol, strict=True):
        while active and at < i:
            step(at)
            at += 1
        at = i
        step(at)
        at += 1
        earlier = [j for j in places.get(s, ()) if i - j < high]
        for j in earlier:
            lag = i - j
            if lag >= low and lag not in active:
                k = i
                while k > lag and ids[k - 1] == ids[k - 1 - lag]:
                    k -= 1
                active[lag] = i - k + 1
        earlier.append(i)
        places[s] = earlier
    while active and at < n:
        step(at)
        at += 1
    for lag in sorted(active):
        end(lag, n)


def find_runs(words: list[str]) -> list[Run]:
    """(start, length, period) of every maximal run with length >= max(6, 4 period), by start, then period."""
    n = len(words)
    if n < 6:
        return []
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == n:
        return []
    own = ids.tolist()
    seen: dict[tuple[int, int], int] = {}
    inside = np.zeros(n + 1, np.int64)  # running sum > 0: a square of a found run is centred there
    symbol, size, low, done = ids, 1, 1, 0
    while 4 * low <= n:
        while size < max(4, 2 * low) and len(symbol) > size:
            _, symbol = np.unique(symbol[:-size] * (n + 1) + symbol[size:], return_inverse=True)
            size *= 2
        if size < max(4, 2 * low):
            break
        order = np.argsort(symbol, kind="stable")
        same = symbol[order[1:]] == symbol[order[:-1]]
        if not same.any():
            break  # longer stretches do not agree either
        near = same & (np.diff(order) < 4 * low)
        may = np.zeros(len(symbol), bool)
        may[order[1:][near]] = True
        may[order[:-1][near]] = True
        if done:
            may &= np.cumsum(inside)[: len(symbol)] == 0
        if may.any():
            starts = np.flatnonzero(may)
            _sweep(own, starts.tolist(), symbol[starts].tolist(), low, seen)
            fresh = list(seen.items())[done:]
            for (start, length), period in fresh:
                inside[start + period] += 1
                inside[start + length - period + 1] -= 1
            done = len(seen)
        low *= 4
    return sorted(((start, length, period) for (start, length), period in seen.items()), key=lambda r: (r[0], r[2]))


def with_tail(words: list[str], doc_id: int | None) -> list[str]:
    """The words, for a tenth of the ids (by CRC-32 of the decimal id) with a periodic tail in place of their own."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(b"%d" % doc_id)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[: n - a]


def collapse(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop) > 0
    return [w for w, x in zip(words, gone[:-1].tolist(), strict=True) if not x]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Rows that are Python objects at a time.
SLICE = 256


def periodic_runs(documents: DataFrame, tails: bool = False) -> DataFrame:
    """doc_id, runs (array of start, length, period, in order) and collapsed (kept words joined by one space) for every row.

    With ``tails`` a tenth of the documents first get a periodic tail (``with_tail``), which plants runs. Null
    and empty texts have no run and an empty collapsed text; a null doc_id is kept and its text is never changed.
    Repeated rows are taken each; other columns are not read. Texts of any length are taken whole,
    in one pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                found, kept = [], []
                for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = WORD.findall(text)
                    if tails:
                        words = with_tail(words, key)
                    runs = find_runs(words)
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    kept.append(" ".join(collapse(words, runs)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _RUNS), pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", text_or_empty("text").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(runs: DataFrame) -> DataFrame:
    """Per document the number of runs, its longest one (ties: least start, then period) and SHA-256 of all runs and of the collapsed text."""
    longest = "array_min(transform(runs, r -> struct(-r.length as length, r.start as start, r.period as period)))"
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return runs.selectExpr("doc_id", "cast(size(runs) as bigint) as n_runs", f"{longest} as top", f"sha2({listed}, 256) as runs_sha256", "sha2(collapsed, 256) as collapsed_sha256").selectExpr(
        "doc_id",
        "n_runs",
        "top.start as start",
        "-top.length as length",
        "top.period as period",
        "(-1000 * top.length) div top.period as exponent_milli",
        "runs_sha256",
        "collapsed_sha256",
    )
