"""License scans by diagonal voting.

Every text gives the hashes of all its runs of k words, which Spark joins to the places of the same runs in
license templates (a table of some hundred rows, broadcast). Hits with one difference of places lie on one
diagonal and are counted; weak diagonals go, neighbouring ones (words put in or left out) are merged, and the
spans that remain are compared word by word with their template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rarefold.llm.common import staged, text_key, text_or_empty, texts_of


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: share of the template's words that a span must hold in order; 1 asks for exactly these words
    share: float = 0.8
    base: bool = False


# The three phrases of the contract.
PHRASES = (
    Template("mit", "mit license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
)

# Public license notices.
NOTICES = (
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    Template("cc-by", "licensed under CC BY 4.0", 1.0),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", 1.0),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", 1.0),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", 1.0),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
)


@dataclass(frozen=True)
class LicenseScan:
    templates: tuple[Template, ...] = PHRASES + NOTICES
    #: words in a hashed run; no template may have fewer
    k: int = 2
    #: a diagonal of an inexact template with fewer hits is noise
    votes: int = 3
    #: diagonals at most this far apart are merged, if the later starts at most ``gap`` words after the end of the earlier
    slack: int = 6
    gap: int = 8


WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.ones(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _IS_WORD[_lo : _hi + 1] = False
_BYTE = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are hashed at a time; a longer text is hashed alone.
BYTES = 1 << 20


def fold(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(text: str) -> list[str]:
    return WORD.findall(fold(text))


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def run_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text; text, place and hash of every run of ``k`` words), for all texts at once."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    folded = _FOLD[data]
    edge = np.diff(_IS_WORD[folded].astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power = np.full(len(data), _BASE, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[folded] * power)])
    # a word's sum starts with the power of its place: its inverse makes equal words equal
    inverse = np.full(len(data), np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    word = _finish((sums[end] - sums[begin]) * inverse[begin])
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(begin, starts)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(begin)) - first[text]
    n = max(0, len(word) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + word[j : j + n]
    inner = text[:n] == text[k - 1 :] if n else np.zeros(0, bool)
    return counts, text[:n][inner], place[:n][inner], _finish(h[inner]).view(np.int64)


def template_places(spark: SparkSession, p: LicenseScan) -> DataFrame:
    """(hash, template, at): where each run of words stands in the templates; as many rows as these have words."""
    texts = [t.text.encode() for t in p.templates]
    counts, template, at, h = run_hashes(texts, p.k)
    if counts.min() < p.k:
        raise ValueError(f"every template needs {p.k} words")
    return spark.createDataFrame(list(zip(h.tolist(), template.tolist(), at.tolist(), strict=True)), "hash long, template int, at int")


def _signals(documents: DataFrame, p: LicenseScan) -> DataFrame:
    """A row for every hit of a template (row, place, template, at) and one for every document (place -1, hash its number of words)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", text_or_empty("text").alias("text"), text_key("text").alias("tkey"), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            counts, text, place, h = run_hashes(texts, p.k)
            which = np.concatenate([np.arange(len(texts)), text])
            blank = pa.nulls(len(text), part.schema.field("doc_id").type), pa.nulls(len(text), pa.binary())
            return pa.RecordBatch.from_arrays(
                [
                    part.column("row").take(pa.array(which)),
                    pa.array(np.concatenate([np.full(len(texts), -1), place]), pa.int64()),
                    pa.array(np.concatenate([counts, h]), pa.int64()),
                    pa.concat_arrays([part.column("doc_id"), blank[0]]),
                    pa.concat_arrays([part.column("tkey").cast(pa.binary()), blank[1]]),
                ],
                ["row", "place", "hash", "doc_id", "tkey"],
            )

        for batch in batches:
            lo, size, texts = 0, 0, []
            for i in range(batch.num_rows):
                texts.append(batch.column("text")[i].as_py().encode())
                size += len(texts[-1])
                if size > BYTES:
                    yield out(batch.slice(lo, i + 1 - lo), texts)
                    lo, size, texts = i + 1, 0, []
            if texts:
                yield out(batch.slice(lo), texts)

    runs = rows.mapInArrow(run, f"row long, place long, hash long, doc_id {kind}, tkey binary")
    places = F.broadcast(template_places(documents.sparkSession, p).withColumnRenamed("hash", "of"))
    joined = runs.join(places, (F.col("hash") == F.col("of")) & (F.col("place") >= 0), "left").drop("of")
    return joined.where("place = -1 or template is not null")


def candidate_spans(hits: DataFrame, p: LicenseScan) -> DataFrame:
    """(row, template, first, last): merged diagonals; words of the text, last exclusive.

    Diagonals of a template that asks for exact words must have all its runs and are never merged; the others need
    ``votes`` hits, and 0.3 of the template's runs once merged.
    """
    spark = hits.sparkSession
    sizes = [len(words_of(t.text)) - p.k + 1 for t in p.templates]
    known = F.broadcast(spark.createDataFrame([(i, n, t.share >= 1) for i, (n, t) in enumerate(zip(sizes, p.templates, strict=True))], "template int, runs int, exact boolean"))
    lines = hits.groupBy("row", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.min("place").alias("first"), (F.max("place") + p.k).alias("last"))
    lines = lines.join(known, "template")
    exact = lines.where("exact and votes = runs").select("row", "template", "first", "last")
    loose = lines.where(f"not exact and votes >= least({p.votes}, runs)")
    own = Window.partitionBy("row", "template").orderBy("first", "diagonal")
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(own)) > p.slack) | (F.col("first") - F.lag("last").over(own) > p.gap)
    loose = loose.withColumn("group", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(own))
    merged = loose.groupBy("row", "template", "group").agg(F.sum("votes").alias("votes"), F.first("runs").alias("runs"), F.min("first").alias("first"), F.max("last").alias("last"))
    return exact.unionByName(merged.where("10 * votes >= 3 * runs").select("row", "template", "first", "last"))


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def verified(texts: DataFrame, p: LicenseScan) -> DataFrame:
    """(tkey, template, first, last, score) of the ``spans`` that hold; score is the share of the template's words found in order."""
    known = [words_of(t.text) for t in p.templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                out = []
                for key, text, spans in zip(*(batch.column(c).to_pylist() for c in ("tkey", "text", "spans")), strict=True):
                    words = words_of(text)
                    for s in spans:
                        t, share, first, last = known[s["template"]], p.templates[s["template"]].share, s["first"], s["last"]
                        if share >= 1:
                            score = float(words[first:last] == t)
                        else:  # words beside an edit at the end of the span belong to no hit
                            score = common_words(t, words[max(0, first - p.slack) : last + p.slack]) / len(t)
                        if score >= share:
                            out.append((key, s["template"], s["first"], s["last"], score))
                cols = list(zip(*out, strict=True)) or [()] * 5
                kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["tkey", "template", "first", "last", "score"])

    return texts.select("tkey", "text", "spans").mapInArrow(run, "tkey binary, template int, first long, last long, score double")


def license_spans(documents: DataFrame, signals: DataFrame, p: LicenseScan) -> DataFrame:
    """(tkey, label, base, first, last, score) of every license span of every distinct text."""
    hits = signals.where("place >= 0").select("row", "place", "template", "at")
    rows = signals.where("place = -1").select("row", "tkey")
    found = candidate_spans(hits, p).join(rows, "row").select("tkey", F.struct("template", "first", "last").alias("span")).distinct()
    per_text = staged(found.groupBy("tkey").agg(F.array_sort(F.collect_list("span")).alias("spans")), "spans")
    known = F.broadcast(documents.sparkSession.createDataFrame([(i, t.label, t.base) for i, t in enumerate(p.templates)], "template int, label string, base boolean"))
    return verified(texts_of(documents, per_text), p).join(known, "template").drop("template")


def scan_licenses(documents: DataFrame, p: LicenseScan = LicenseScan()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for every row.

    Texts are lower-cased (A-Z); words are numbered from 0. ``n_base``, ``first_word`` and ``last_word`` are the count, least and
    greatest start of the places of base phrases (none: 0, null, null); ``labels`` adds those of notices; ``score`` is the best
    share of a template found, 0 without one; ``spans`` lists (first, last, label, score). Null and empty texts have no words and empty
    labels; repeated rows are answered each, a null doc_id is kept, other columns are not read. Equal texts are verified once.
    """
    signals = staged(_signals(documents, p), "signals")
    spans = license_spans(documents, signals, p)
    base = F.col("base")
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    own = spans.groupBy("tkey").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("score").alias("score"),
        F.array_sort(F.collect_list(F.struct("first", "last", "label", "score"))).alias("spans"),
    )
    every = signals.where("place = -1").select("doc_id", F.col("hash").alias("n_words"), "tkey")
    out = every.join(staged(own, "licenses"), "tkey", "left")
    none = F.lit("")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", none).alias("base_labels"),
        F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )
