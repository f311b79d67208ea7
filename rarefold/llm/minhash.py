"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard checks.

A signature has K coordinates but only two permutations of the shingle universe: the
first scrambles a shingle's place, the second is read at K circular shifts of it, so the K
minima of a document are minima over contiguous slices of one table. Bands of
the signature propose pairs; a pair counts only if the full shingle sets agree.

Groups are never expanded to all pairs. Equal sets are one node. In a bucket every node
is first checked against the bucket's least node. After connected components, nodes of a bucket in *different*
components are compared by small histograms that bound their intersection from above, block by block inside tasks, and only
pairs that would join two components go on to the exact check; once those are in, every pair that is still open does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import FILTER_BITS, BitFilter, on_columns, shuffle_partitions, staged, text_key, text_or_empty, texts_of
from rarefold.llm.graph import components


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters; 25 bands of 5 miss a pair at similarity 0.85 with probability 4e-7."""

    words: int = 5
    percent: int = 85
    bands: int = 25
    rows: int = 5
    universe_bits: int = 20
    seed: int = 7
    #: pairs of one center that one sorted run checks; a center with more has several runs
    run: int = 512
    #: cells of the histogram that bounds intersections, and nodes of a bucket in one block
    cells: int = 256
    block: int = 1024


_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text.

    Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z. Fewer than n
    words form one shingle; no word gives the empty set.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            h = h * _MULT + w[i : len(words) - k + 1 + i]
        return np.unique(_mixed(h))


@cache
def _tables(bits: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The scrambling permutation, and all k-long circular slices of the other one."""
    rng, size = np.random.default_rng(seed), 1 << bits
    first, second = rng.permutation(size).astype(np.int32), rng.permutation(size).astype(np.int32)
    return first, sliding_window_view(np.concatenate([second, second[:k]]), k)


def signature(hashes: np.ndarray, p: NearDuplicates) -> np.ndarray:
    k = p.bands * p.rows
    first, slices = _tables(p.universe_bits, k, p.seed)
    at = first[(hashes & np.uint64((1 << p.universe_bits) - 1)).astype(np.int64)]
    sig = np.full(k, 1 << p.universe_bits, np.int32)
    for i in range(0, len(at), 4096):
        np.minimum(sig, slices[at[i : i + 4096]].min(axis=0), out=sig)
    return sig


def _band_keys(sig: np.ndarray, p: NearDuplicates) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.arange(1, p.bands + 1, dtype=np.uint64) * _MULT
        for column in sig.reshape(p.bands, p.rows).T.astype(np.uint64):
            h = _mixed(h * _MULT + column)
    return h.view(np.int64)


def _histogram(hashes: np.ndarray, p: NearDuplicates) -> bytes:
    """Shingles per cell; the sum of cellwise minima of two sets is at least their intersection."""
    n = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % p.cells, minlength=p.cells)
    return n.astype(np.uint16 if len(hashes) < 1 << 16 else np.uint32).tobytes()


def sketch(documents: DataFrame, p: NearDuplicates) -> DataFrame:
    """doc_id, tkey, n_shingles, set_key (null if empty), band keys and histogram for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands, cells = [], [], [], []
            for text in batch.column("text").to_pylist():
                h = shingles(text, p.words)
                sizes.append(len(h))
                keys.append(hashlib.md5(h.tobytes()).digest() if len(h) else None)
                bands.append(_band_keys(signature(h, p), p) if len(h) else None)
                cells.append(_histogram(h, p) if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tkey"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(cells, pa.binary())],
                ["doc_id", "tkey", "n_shingles", "set_key", "bands", "cells"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", text_key("text").alias("tkey"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, tkey binary, n_shingles long, set_key binary, bands array<long>, cells binary")


def _sets(documents: DataFrame, nodes: DataFrame, wanted: DataFrame, p: NearDuplicates) -> DataFrame:
    """(node, shingles) of the wanted nodes, from one text of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shingles(t, p.words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], ["node", "shingles"])

    need = nodes.join(wanted, "node", "left_semi").select("tkey", "node")
    found = texts_of(documents, need).select("node", "text")
    return staged(found.mapInArrow(run, "node long, shingles binary"), "sets")


def _linked(pairs: DataFrame, sets: DataFrame, p: NearDuplicates) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Each run of at most about ``p.run`` pairs of one a is sorted behind a's set, so a's set
    moves once a run, b's once a pair, and a center with many partners is spread over runs.
    """
    spark = pairs.sparkSession
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(p.run)).alias("runs"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "runs").alias("part"))
    left = many.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("part")).join(sets.withColumnRenamed("node", "a"), "a")
    right = dealt.join(sets.withColumnRenamed("node", "b"), "b")
    rows = left.select("a", "part", F.lit(None).cast("long").alias("b"), "shingles").unionByName(right.select("a", "part", "b", "shingles"))
    rows = rows.repartition(shuffle_partitions(spark), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center = np.zeros(0, np.uint64)
        for batch in batches:
            found_a, found_b = [], []
            for a, b, raw in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                own = np.frombuffer(raw, np.uint64)
                if b is None:
                    center = own
                    continue
                small, large = (own, center) if len(own) < len(center) else (center, own)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                common = int((large[at] == small).sum())
                if 100 * common >= p.percent * (len(small) + len(large) - common):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return staged(rows.mapInArrow(run, "a long, b long"), "linked")


def _across(buckets: DataFrame, comp: DataFrame, cells: DataFrame, p: NearDuplicates, every: bool) -> DataFrame:
    """Pairs (a, b) of one bucket in different components whose histograms allow a link.

    Unless ``every``, a group gives only pairs that join components that it has not joined already. A bucket is cut into
    blocks, and each two blocks are one group, so no task holds more than two blocks of a bucket.
    """
    spark = buckets.sparkSession
    placed = buckets.join(comp, "node", "left").select("key", "node", "n", F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count(F.lit(1)) / F.lit(p.block)).alias("blocks"))
    placed = placed.join(mixed.where(F.col("lo") < F.col("hi")).select("key", "blocks"), "key")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "comp").join(cells, "node")
    rows = rows.repartition(shuffle_partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def group(j: int, own: list[int], node: list[int], n: list[int], comp: list[int], cells: list[bytes]) -> Iterator[tuple[int, int]]:
        node, n, comp, second = np.array(node), np.array(n), np.array(comp), np.array(own) == j
        hist = np.stack([np.frombuffer(c, np.uint16 if m < 1 << 16 else np.uint32) for c, m in zip(cells, n.tolist(), strict=True)])
        both = not second.all() and second.any()  # two blocks: only pairs between them are this group's
        names = {c: c for c in comp.tolist()}

        def top(c: int) -> int:
            while names[c] != c:
                names[c] = c = names[names[c]]
            return c

        for x in range(len(node) - 1):
            y = np.arange(x + 1, len(node))
            ok = (comp[y] != comp[x]) & (100 * np.minimum(n[y], n[x]) >= p.percent * np.maximum(n[y], n[x]))
            y = y[ok & (second[y] != second[x])] if both else y[ok]
            if not len(y):
                continue
            common = np.minimum(hist[y], hist[x]).sum(axis=1, dtype=np.int64)
            for z in y[100 * common >= p.percent * (n[y] + n[x] - common)].tolist():
                a, b = top(int(comp[x])), top(int(comp[z]))
                if every or a != b:
                    names[a] = b
                    yield min(int(node[x]), int(node[z])), max(int(node[x]), int(node[z]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, found = [], None, []
        columns = ("own", "node", "n", "comp", "cells")

        def close() -> None:
            if len(held) > 1:
                found.extend(group(last[2], *map(list, zip(*held, strict=True))))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for key, row in zip(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")), strict=True), zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
                if key != last:
                    close()
                    held, last = [], key
                held.append(row)
            if len(found) > 10_000:
                yield out()
                found.clear()
        close()
        yield out()

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, tkey, comp for every row of ``documents``.

    component_id is the smallest doc_id of the rows linked directly or through others;
    ``kept`` marks the row that has it. A null or wordless text has no shingle and is linked with
    nothing. Null doc_ids are never the smallest unless all of a group are null. Rows that share doc_id
    and text are in one group and all marked kept if their id is the smallest. Columns
    other than doc_id and text are not read.
    """
    rows = staged(sketch(documents, p), "sketch")
    own = rows.where(F.col("set_key").isNotNull())
    nodes = own.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.min("tkey").alias("tkey"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("cells").alias("cells"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    buckets = nodes.select(F.explode("bands").alias("key"), "node", "n")
    shared = buckets.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where(F.col("a") < F.col("z")).drop("z")
    buckets = staged(buckets.join(shared, "key"), "buckets")  # without the keys that one node alone has
    fits = lambda n, m: 100 * F.least(n, m) >= p.percent * F.greatest(n, m)  # noqa: E731  no pair beyond this ratio can pass
    sizes = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"))
    star = buckets.where(F.col("a") != F.col("node")).groupBy("a", F.col("node").alias("b")).agg(F.min("n").alias("nb"))
    star = staged(star.join(sizes, "a").where(fits(F.col("na"), F.col("nb"))).select("a", "b"), "star")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    links = _linked(star, _sets(documents, nodes, ends(star), p), p)
    comp = staged(components(links), "comp")

    # what is left: nodes that share a bucket but not a component; first enough pairs to join components, then all that are open
    for every in (False, True):
        pairs = staged(_across(buckets.select("key", "node", "n"), comp, nodes.select("node", "cells"), p, every), "cross")
        if pairs.isEmpty():
            break
        links = links.unionByName(_linked(pairs, _sets(documents, nodes, ends(pairs), p), p))
        comp = staged(components(links), "comp")

    named = nodes.join(comp, "node", "left").select("set_key", "doc", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "comp").select("set_key", "component_id", "comp")
    out = rows.drop("bands", "cells").join(named, "set_key", "left")
    group = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", group.alias("component_id"), F.col("doc_id").eqNullSafe(group).alias("kept"), "tkey", "comp")


def deduplicate(documents: DataFrame, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """``documents`` with one row of each group of near duplicates: one that has the group's smallest doc_id.

    Of rows that share that doc_id the one with the least text key stays, and one of rows that share the text too; texts without
    words are in no group and all stay. Only rows that may go are shuffled.
    """

    def step(d: DataFrame) -> DataFrame:
        row_key = lambda key: F.unhex(F.md5(F.concat(F.hex(key), F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")))))
        found = staged(near_duplicates(d, p).where(F.col("comp").isNotNull()).select("comp", "kept", "tkey", row_key(F.col("tkey")).alias("row")), "near")
        first = found.where("kept").groupBy("comp").agg(F.min(F.struct("tkey", "row")).alias("first")).select(F.col("first.row").alias("row"), F.lit(True).alias("stays"))
        rows = found.groupBy("row").agg(F.count(F.lit(1)).alias("copies")).join(first, "row", "left")
        ruled = rows.where(F.col("stays").isNull() | (F.col("copies") > 1)).select(F.col("row").alias("__row"), F.coalesce("stays", F.lit(False)).alias("__stays"))
        ruled = staged(ruled, "ruled")
        keyed = d.withColumn("__row", row_key(text_key("text")))
        n = max(1, ruled.count())
        maybe = BitFilter(ruled.select(F.xxhash64("__row")), min(FILTER_BITS, max(12, (16 * n).bit_length()))).column(F.xxhash64("__row"))
        doubt = keyed.where(maybe).join(ruled, "__row", "left")
        free = doubt.where(F.col("__stays").isNull())
        single = doubt.where("__stays").dropDuplicates(["__row"])
        return keyed.where(~maybe).unionByName(free.unionByName(single).drop("__stays"))

    return on_columns(documents, ("doc_id", "text"), step)


#: Groups of documents for DuckDB, from all shingles that two documents share.
SQL = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words),
sh as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (select a.doc_id as x, b.doc_id as y from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways as (select x, y from links union all select y, x from links),
reach(doc_id, root) as (select doc_id, doc_id from sets union select b.y, r.root from reach r join both_ways b on b.x = r.doc_id where r.root < b.y),
least as (select doc_id, min(root) as component_id from reach group by doc_id)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from sets join least using (doc_id)
"""
