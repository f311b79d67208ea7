"""Cross-entropy difference scores from two bigram models with one vocabulary.

The target model is counted over the target documents, the background model over all documents; order,
smoothing and vocabulary are the same. A document's score is its loss per token under the target model less that
under the background model: the lower, the more it looks like the target.

Counts and lookups are dealt by a hash of the bigram, so no word is hot. Bigrams travel as packed
32-bit codes in batches of documents, and the model's share of a hash part meets the documents' share of it.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import BitFilter, shuffle_partitions, staged, text_or_empty

_WORD = re.compile(r"\w+")
UNKNOWN, START = 0, 1


@dataclass(frozen=True)
class CrossEntropy:
    #: words of the shared vocabulary: the target's most frequent, with at least ``min_count`` uses; others are one unknown word
    vocabulary: int = 50_000
    min_count: int = 2
    #: weight of the bigram estimate against the unigram estimate
    weight: float = 0.7
    #: hash parts that documents are looked up in, a power of two
    parts: int = 32
    #: documents in one batch, tokens counted before a flush, and tokens of one lookup group
    batch: int = 512
    flush: int = 4_000_000
    group: int = 4_000_000


def vocabulary(target: DataFrame, p: CrossEntropy) -> dict[str, int]:
    """word -> id, by falling count and then by word; 0 and 1 stand for unknown words and the start of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(_WORD.findall(text.lower()))
            if len(seen) > 500_000:
                yield out()
                seen.clear()
        yield out()

    counts = target.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= p.min_count)
    top = counts.orderBy(F.desc("n"), "word").limit(p.vocabulary).collect()  # at most p.vocabulary rows
    return {r.word: i + 2 for i, r in enumerate(top)}


class _Coder:
    def __init__(self, words: dict[str, int]):
        self.words, self.radix = words, len(words) + 4  # two more contexts, for counts of single words

    def bigrams(self, text: str) -> np.ndarray:
        get = self.words.get
        found = _WORD.findall(text.lower())
        ids = np.fromiter((get(w, UNKNOWN) for w in found), np.uint32, len(found))
        before = np.empty_like(ids)
        before[:1], before[1:] = START, ids[:-1]
        return before * np.uint32(self.radix) + ids

    def part(self, codes: np.ndarray, parts: int) -> np.ndarray:
        return ((codes * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) & (parts - 1)


def _counted(texts: DataFrame, kind: int, shared, parts: int, p: CrossEntropy) -> DataFrame:
    """(part, kind, codes, counts): counts of bigrams, and under two extra contexts of words and of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        held, size = [], 0

        def out() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            extra = []
            for k, ids in ((2, codes % np.uint32(coder.radix)), (1, codes // np.uint32(coder.radix))):
                total = np.bincount(ids, weights=n).astype(np.int64)
                used = np.flatnonzero(total)
                extra.append((((coder.radix - k) * coder.radix + used).astype(np.uint32), total[used]))
            codes, n = np.concatenate([codes, *(e[0] for e in extra)]), np.concatenate([n, *(e[1] for e in extra)])
            part = coder.part(codes, parts)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            codes, n = codes[order], n[order].astype(np.int64)
            rows = [i for i in range(parts) if cut[i] < cut[i + 1]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int32()),
                    pa.array([kind] * len(rows), pa.int32()),
                    pa.array([codes[cut[i] : cut[i + 1]].tobytes() for i in rows], pa.binary()),
                    pa.array([n[cut[i] : cut[i + 1]].tobytes() for i in rows], pa.binary()),
                ],
                ["part", "kind", "codes", "counts"],
            )

        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = coder.bigrams(text)
                if len(own):
                    held.append(own)
                    size += len(own)
                if size >= p.flush:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "part int, kind int, codes binary, counts binary")


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    codes = [np.frombuffer(c, np.uint32) for c in pdf["codes"]]
    counts = [np.frombuffer(c, np.int64) for c in pdf["counts"]]
    kinds = np.repeat(pdf["kind"].to_numpy(), [len(c) for c in codes])
    all_codes, n = np.concatenate(codes), np.concatenate(counts)
    unique, at = np.unique(all_codes, return_inverse=True)
    sums = [np.bincount(at, weights=np.where(kinds == k, n, 0), minlength=len(unique)).astype(np.int64).tobytes() for k in (0, 1)]
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "codes": [unique.tobytes()], "target": [sums[0]], "background": [sums[1]]})


def _single_counts(model: DataFrame, radix: int) -> np.ndarray:
    """[word or context][target or background] -> counts by id; at most two rows a vocabulary word reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, t, b in zip(*(batch.column(c).to_pylist() for c in ("codes", "target", "background")), strict=True):
                codes, t, b = np.frombuffer(codes, np.uint32), np.frombuffer(t, np.int64), np.frombuffer(b, np.int64)
                at = codes >= np.uint32((radix - 2) * radix)
                yield pa.RecordBatch.from_arrays([pa.array(codes[at].astype(np.int64)), pa.array(t[at]), pa.array(b[at])], ["code", "t", "b"])

    out = np.zeros((2, 2, radix))
    got = model.mapInArrow(run, "code long, t long, b long").toPandas()
    k, ids = got["code"].to_numpy(np.int64) // radix - (radix - 2), got["code"].to_numpy(np.int64) % radix
    out[k, 0, ids], out[k, 1, ids] = got["t"], got["b"]
    return out


def _dealt(texts: DataFrame, shared, p: CrossEntropy) -> DataFrame:
    """(batch, part, lengths, codes, doc_ids): a batch of documents by hash part; part 0 carries the doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seq = shared.value, TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, p.batch):
                batch = whole.slice(at, p.batch)
                own = [coder.bigrams(t) for t in batch.column("text").to_pylist()]
                codes = np.concatenate(own)
                row = np.repeat(np.arange(len(own)), [len(o) for o in own])
                part = coder.part(codes, p.parts)
                order = np.lexsort((codes, row, part))
                cut = np.searchsorted(part[order], np.arange(p.parts + 1))
                lengths, packed = [], []
                for i in range(p.parts):
                    one = order[cut[i] : cut[i + 1]]
                    lengths.append(np.bincount(row[one], minlength=len(own)).astype(np.int32).tobytes())
                    packed.append(codes[one].tobytes())
                ids = pa.array([pickle.dumps(batch.column("doc_id").to_pylist())] + [None] * (p.parts - 1), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task << 32 | seq] * p.parts, pa.int64()), pa.array(range(p.parts), pa.int32()), pa.array(lengths, pa.binary()), pa.array(packed, pa.binary()), ids],
                    ["batch", "part", "lengths", "codes", "doc_ids"],
                )
                seq += 1

    return texts.mapInArrow(run, "batch long, part int, lengths binary, codes binary, doc_ids binary")


def cross_entropy_difference(documents: DataFrame, target_ids: DataFrame, p: CrossEntropy = CrossEntropy()) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for every row of ``documents``.

    ``target_ids`` has one column of doc_ids (nulls and unknown ids match nothing; repeats count once). Tokens are runs of letters, digits and
    underscores in lower case. A text without one (null, empty) has n_tokens 0 and null losses and score. Every row counts in the
    background model, repeated rows as often as they occur. Losses are mean negative natural logs of
    weight * c(v w) / c(v) + (1 - weight) * (c(w) + 1) / (N + V); an unseen context v leaves the second term alone, with weight 1.
    Other columns are not read.
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", text_or_empty("text").alias("text"))
    ids = target_ids.toDF("doc_id").where("doc_id is not null").distinct()
    chosen = BitFilter(ids.select(F.xxhash64("doc_id"))).column(F.xxhash64("doc_id"))
    target = staged(texts.where(F.col("doc_id").isNotNull() & chosen).join(ids, "doc_id").select("text"), "target")
    words = vocabulary(target, p)
    shared = spark.sparkContext.broadcast(_Coder(words))  # bounded by the vocabulary
    radix = len(words) + 4
    fine = p.parts
    while fine < shuffle_partitions(spark):
        fine *= 2
    counted = _counted(target, 0, shared, fine, p).unionByName(_counted(texts, 1, shared, fine, p))
    model = staged(counted.groupBy("part").applyInPandas(_merge, "part int, codes binary, target binary, background binary"), "bigrams")
    singles = _single_counts(model, radix)
    tables = spark.sparkContext.broadcast(singles)
    tokens = int(singles[0, 1].sum())
    salts = max(1, -(-tokens // (p.parts * p.group)))
    weight = p.weight

    def losses(key: tuple, docs: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if docs.empty:
            return pd.DataFrame({"batch": [], "sums": [], "n": [], "doc_ids": []}, dtype=object)
        word, context = tables.value
        sizes = word.sum(axis=1)
        codes = [np.frombuffer(c, np.uint32) for c in model["codes"]]
        known = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        order = np.argsort(known, kind="stable")
        known = known[order]
        counts = [np.concatenate([np.frombuffer(c, np.int64) for c in model[k]])[order] for k in ("target", "background")] if codes else [np.zeros(0)] * 2
        out = {"batch": [], "sums": [], "n": [], "doc_ids": []}
        for batch, lengths, packed, doc_ids in zip(docs["batch"], docs["lengths"], docs["codes"], docs["doc_ids"], strict=True):
            lengths, own = np.frombuffer(lengths, np.int32), np.frombuffer(packed, np.uint32)
            row = np.repeat(np.arange(len(lengths)), lengths)
            before, now = own // np.uint32(radix), own % np.uint32(radix)
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            sums = []
            for k in (0, 1):
                single = (word[k][now] + 1) / (sizes[k] + radix - 2)
                if len(known):
                    pair, all_ = np.where(known[at] == own, counts[k][at], 0), context[k][before]
                    seen = all_ > 0
                    prob = np.where(seen, weight * pair / np.maximum(all_, 1) + (1 - weight) * single, single)
                else:
                    prob = single
                sums.append(np.bincount(row, weights=-np.log(prob), minlength=len(lengths)))
            out["batch"].append(batch)
            out["sums"].append(np.stack(sums).tobytes())
            out["n"].append(lengths.tobytes())
            out["doc_ids"].append(doc_ids)
        return pd.DataFrame(out)

    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = _dealt(texts, shared, p).withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int"))
    part = F.col("part").bitwiseAND(F.lit(p.parts - 1)).alias("part")  # low bits of the finer hash
    pieces = model.select(part, "codes", "target", "background", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    summed = docs.groupBy("part", "salt").cogroup(pieces.groupBy("part", "salt")).applyInPandas(losses, "batch long, sums binary, n binary, doc_ids binary")

    def total(pdf: pd.DataFrame) -> pd.DataFrame:  # one batch: at most p.batch documents, p.parts rows
        n = np.sum([np.frombuffer(x, np.int32) for x in pdf["n"]], axis=0)
        sums = np.sum([np.frombuffer(x).reshape(2, -1) for x in pdf["sums"]], axis=0)
        ids = pickle.loads(next(x for x in pdf["doc_ids"] if x is not None))
        with np.errstate(invalid="ignore", divide="ignore"):
            t, b = np.where(n > 0, sums / n, np.nan)
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "n_tokens": n.astype(np.int64), "target_loss": t, "background_loss": b})

    rows = summed.groupBy("batch").applyInPandas(total, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double")
    empty = F.col("n_tokens") == 0
    loss = lambda c: F.when(~empty, F.round(c, 9)).alias(c)
    return rows.select("doc_id", "n_tokens", loss("target_loss"), loss("background_loss"), F.when(~empty, F.round(F.col("target_loss") - F.col("background_loss"), 9)).alias("score"))


#: The scores for DuckDB, with the default parameters and the documents of good quality as target.
SQL = r"""
with texts as (select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as words from documents),
tok as (select r, doc_id, unnest(words) as word, unnest(range(len(words))) as i from texts),
target as (select distinct r from texts join labels using (doc_id) where quality = 1),
voc as (select word, row_number() over (order by count(*) desc, word) + 1 as id from tok where r in (select r from target) group by word having count(*) >= 2
  qualify row_number() over (order by count(*) desc, word) <= 50000),
size as (select count(*) + 2 as v from voc),
ids as (select r, i, coalesce(id, 0) as w from tok left join voc using (word)),
pairs as (select r, w, coalesce(lag(w) over (partition by r order by i), 1) as v, r in (select r from target) as good from ids),
one as (select w, count(*) as b, count(*) filter (where good) as t from pairs group by w),
ctx as (select v, count(*) as b, count(*) filter (where good) as t from pairs group by v),
two as (select v, w, count(*) as b, count(*) filter (where good) as t from pairs group by v, w),
total as (select count(*) as b, count(*) filter (where good) as t from pairs),
single as (select w, (one.t + 1) / (total.t + size.v) as t, (one.b + 1) / (total.b + size.v) as b from one, total, size),
loss as (select v, w,
    -ln(case when ctx.t > 0 then 0.7::double * (two.t / ctx.t) + 0.3::double * single.t else single.t end) as t,
    -ln(case when ctx.b > 0 then 0.7::double * (two.b / ctx.b) + 0.3::double * single.b else single.b end) as b
  from two join ctx using (v) join single using (w)),
docs as (select r, count(*) as n, avg(t) as t, avg(b) as b from pairs join loss using (v, w) group by r)
select doc_id, coalesce(n, 0) as n_tokens, round(t, 9) as target_loss, round(b, 9) as background_loss, round(t - b, 9) as score from texts left join docs using (r)
"""
