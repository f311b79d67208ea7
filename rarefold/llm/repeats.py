"""Long exact repeats by run-length compressed suffix indexes.

A string of ``length`` bytes that occurs twice has the same least-hashed ``seed``-byte piece in
both places. So each string start belongs to one *anchor* (that piece's place), equal strings
have equal anchors, and only pieces of text around anchors whose hash occurs twice
can hold repeats. Those segments meet by anchor hash: equal segments are collapsed to a class
with a count, and the classes of an anchor go into one index.

The index is a run-length Burrows-Wheeler transform with samples at its run boundaries. Matching
statistics of the indexed text against itself need nothing else: away from a run
boundary the longest match shrinks by one per byte, so it is streamed from the samples. Anchors with
more classes than one index should hold (a passage that a large share of documents has, in
different surroundings) are split by content first, half a segment's starts at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import filter_for, shuffle_partitions, staged, text_key, text_or_empty, texts_of


@dataclass(frozen=True)
class LongRepeats:
    length: int = 400
    seed: int = 200
    #: bytes of segments in one index, and the most that one anchor may bring along
    index_bytes: int = 1 << 20
    group_bytes: int = 1 << 21
    #: starts that are looked at together in a very long text
    block: int = 1 << 22


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        made = []
        for b in (_BASE, _INVERSE):
            p = np.full(1 << bits, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
    return made[0], made[1]


@cache
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _seed_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    up, down = _powers(max(10, (len(raw) + 1).bit_length()))
    with np.errstate(over="ignore"):
        s = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_byte_codes()[raw] * up[: len(raw)], out=s[1:])
        h = (s[k:] - s[:-k]) * down[: len(raw) - k + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v) - w + 1
    blocks = np.full(-(-len(v) // w) * w, np.iinfo(v.dtype).max, v.dtype)
    blocks[: len(v)] = v
    grid = blocks.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: bytes, p: LongRepeats) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(anchor hash, first start, number of starts, bytes from there to the anchor, class key) covering every start of ``data``."""
    w = p.length - p.seed + 1
    for at in range(0, max(0, len(data) - p.length + 1), p.block):
        raw = np.frombuffer(data, np.uint8, min(p.block + p.length - 1, len(data) - at), at)
        h = _seed_hashes(raw, p.seed)
        # least hash first, leftmost place among equals: both depend on the bytes alone
        low = _sliding_min((h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64), w)
        place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        counts = np.diff(first, append=len(place))
        own = place[first]
        for a, s, c, hashed in zip(own.tolist(), first.tolist(), counts.tolist(), h[own].view(np.int64).tolist(), strict=True):
            s += at
            lead = a + at - s
            yield hashed, s, c, lead, hashlib.md5(data[s : s + c - 1 + p.length] + lead.to_bytes(4, "little")).digest()


def _suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``t`` (sentinels unique), ordered to at least ``depth`` symbols by prefix doubling.

    Every round sorts only suffixes that still share their rank.
    """
    n = len(t)
    _, rank = np.unique(t, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    pad = np.zeros(2, np.int64)
    top = int(rank.max()) + 1
    if top < 1 << 20:  # three symbols at once
        joined = np.concatenate([rank, pad])
        key, h = (joined[:n] * top + joined[1 : n + 1]) * top + joined[2 : n + 2], 3
    else:
        key, h = rank, 1
    order = np.argsort(key, kind="stable")
    while True:
        s = key[order]
        new = np.empty(len(order), bool)
        new[0] = True
        np.not_equal(s[1:], s[:-1], out=new[1:])
        if len(order) == n:
            sa = order.copy()
            rank = np.empty(n, np.int64)
            head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            rank[order] = head
            slots = np.arange(n)
        else:
            sa[slots] = order
            head = np.maximum.accumulate(np.where(new, slots, 0))
            rank[order] = head
        alone = new & np.append(new[1:], True)
        slots, order = slots[~alone], order[~alone]
        if not len(order) or h >= depth:
            return sa
        follow = np.where(order + h < n, rank[np.minimum(order + h, n - 1)] + 1, 0)
        key_of = rank[order] * (n + 2) + follow
        by = np.argsort(key_of, kind="stable")
        order = order[by]
        key = np.zeros(n, np.int64)
        key[order] = key_of[by]
        h *= 2


class RunIndex:
    """Run-length BWT of a text with its run boundaries sampled."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        sa = _suffix_order(text, depth)
        bwt = text[sa - 1]
        self.starts = np.flatnonzero(np.diff(bwt, prepend=-1))  # runs in suffix order
        self.symbols = bwt[self.starts]
        up = self.starts[self.starts > 0]
        # samples: the suffix at each run's head with its neighbour above, and at each run's end with the one below
        self.heads = np.concatenate([[sa[0]], sa[up]])
        self.head_match = np.concatenate([[0], self._common(text, sa[up], sa[up - 1], depth)])
        ends = up - 1
        self.tails = np.concatenate([[sa[n - 1]], sa[ends]])
        self.tail_match = np.concatenate([[0], self.head_match[1:]])
        self.size = n

    @staticmethod
    def _common(text: np.ndarray, i: np.ndarray, j: np.ndarray, depth: int) -> np.ndarray:
        """Longest common prefixes of pairs of suffixes."""
        n, out = len(text), np.zeros(len(i), np.int64)
        at = np.arange(32)
        for first in range(0, len(i), 1 << 14):  # a bounded number of pairs at a time
            live = np.arange(first, min(len(i), first + (1 << 14)))
            while len(live):
                x, y = (i[live] + out[live])[:, None] + at, (j[live] + out[live])[:, None] + at
                same = (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)]) & (x < n) & (y < n)
                run = np.where(same.all(axis=1), 32, same.argmin(axis=1))
                out[live] += run
                live = live[(run == 32) & (out[live] < depth)]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each place, the longest match with any other place, streamed from the samples."""

        def stream(places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            known = np.full(self.size, -1, np.int64)
            known[places] = lengths + places
            # a sample lasts until the next one: one byte less per place
            last = np.maximum.accumulate(np.where(known >= 0, np.arange(self.size), -1))
            return np.where(last >= 0, known[np.maximum(last, 0)], 0) - np.arange(self.size)

        return np.maximum(np.maximum(stream(self.heads, self.head_match), stream(self.tails, self.tail_match)), 0)


def repeated_starts(segments: list[bytes], p: LongRepeats) -> list[np.ndarray]:
    """Per segment, whether the string of ``p.length`` bytes at each of its starts occurs again in any segment."""
    parts, at = [], []
    here = 0
    for i, s in enumerate(segments):
        parts += [np.frombuffer(s, np.uint8).astype(np.int32), np.array([256 + i], np.int32)]
        at.append(here)
        here += len(s) + 1
    index = RunIndex(np.concatenate(parts), max(map(len, segments)) + 1)
    long = index.matching_statistics() >= p.length
    return [long[a : a + len(s) - p.length + 1] for a, s in zip(at, segments, strict=True)]


def _segment_bytes(p: LongRepeats) -> Column:
    """Bytes of the segments in a group of members, without reading them."""
    return F.sum(F.col("starts") + (p.length - 1))


def _indexed(members: DataFrame, p: LongRepeats) -> DataFrame:
    """(class, lo, hi): ranges of repeated starts of the open members, one index per run of groups.

    The members of a group must meet in one index. So they are grouped by a bucket of ``grp``: after a mere repartition by
    ``grp``, adaptive execution may take the join before it for that repartition, and then read its shuffle by mappers.
    """
    total = members.agg(_segment_bytes(p)).first()[0] or 0
    buckets = max(4 * shuffle_partitions(members.sparkSession), -(-total // p.index_bytes))
    rows = members.select(F.pmod(F.xxhash64("grp"), F.lit(buckets)).alias("bucket"), "grp", "home", "off", "n", "seg")

    def run(bucket: pa.Table) -> pa.Table:
        ids, lo, hi = [], [], []
        held, size, last = [], 0, None

        def index() -> None:
            if len(held) > 1:
                for (home, off, n, _), flags in zip(held, repeated_starts([h[3] for h in held], p), strict=True):
                    if n == 1 and flags.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
                        ids.extend([home] * (len(edge) // 2))
                        lo.extend((edge[::2] + off).tolist())
                        hi.extend((edge[1::2] - 1 + off).tolist())

        for grp, *member in sorted(zip(*(bucket.column(c).to_pylist() for c in ("grp", "home", "off", "n", "seg")), strict=True), key=lambda m: m[0]):
            if size >= p.index_bytes and grp != last:
                index()
                held, size = [], 0
            held.append(member)
            size += len(member[3])
            last = grp
        index()
        return pa.table([pa.array(ids, pa.binary()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["class", "lo", "hi"])

    return rows.groupBy("bucket").applyInArrow(run, "class binary, lo long, hi long")


def _halved(over: DataFrame, p: LongRepeats, width: int) -> DataFrame:
    """Parts of members by the distance from a string's start to its anchor, ``width`` distances each.

    Equal strings have the same distance, so they stay together. A part is keyed by the bytes that all strings with its
    distances contain.
    """
    near = F.col("lead") - F.col("starts") + 1  # least distance among the member's starts
    bands = F.sequence(F.floor(near / width), F.floor(F.col("lead") / width))
    d = over.select("home", "off", "n", "seg", "lead", near.alias("near"), F.explode(bands).alias("band"))
    d = d.withColumn("far", F.least(F.col("lead"), (F.col("band") + 1) * width - 1)).withColumn("near", F.greatest("near", F.col("band") * width))
    d = d.withColumn("skip", F.col("lead") - F.col("far")).withColumn("starts", F.col("far") - F.col("near") + 1)
    core = F.expr(f"substring(seg, cast(lead - band * {width} + 1 as int), {p.length - width + 1})")
    seg = F.expr(f"substring(seg, cast(skip + 1 as int), cast(starts as int) + {p.length - 1})")
    tail = F.concat_ws(":", F.col("band").cast("string"), F.col("far").cast("string")).cast("binary")
    return d.select(
        F.concat(F.unhex(F.md5(core)), F.col("band").cast("string").cast("binary")).alias("grp"),
        F.unhex(F.md5(F.concat(seg, tail))).alias("class"),
        "home",
        (F.col("off") + F.col("skip")).alias("off"),
        "n",
        F.col("far").alias("lead"),
        "starts",
        seg.alias("seg"),
    )


def _split_hot(members: DataFrame, p: LongRepeats) -> tuple[DataFrame, DataFrame | None]:
    """Members in groups that fit one index, and (class, lo, hi) that splitting settled on the way.

    ``members`` has grp, class, home, off, n, lead, starts, seg. Overfull groups are cut into parts with fewer distances
    to the anchor and longer shared keys: equal parts settle each other, a part alone under its key has no
    repeat, and with one distance left every part is settled. Nothing is dropped.
    """
    ready = settled = None
    width = 1 << (p.length - p.seed).bit_length()
    while True:
        hot = staged(members.groupBy("grp").agg(_segment_bytes(p).alias("bytes")).where(F.col("bytes") > p.group_bytes).select("grp"), "hot")
        done = hot.isEmpty()
        fit = members if done else members.join(hot, "grp", "left_anti")
        ready = fit if ready is None else ready.unionByName(fit)
        if done:
            return ready, settled
        over = staged(members.join(hot, "grp"), "overfull")
        width //= 2
        cut = staged(_halved(over, p, width), "halves")
        merged = cut.groupBy("grp", "class").agg(
            F.sum("n").alias("n"), F.min("home").alias("home"), F.min("off").alias("off"), F.min("lead").alias("lead"), F.min("starts").alias("starts"), F.first("seg").alias("seg")
        )
        merged = staged(merged, "parts")
        again = merged.where(F.col("n") > 1).select("grp", "class")
        same = cut.where(F.col("n") == 1).join(again, ["grp", "class"]).select(F.col("home").alias("class"), F.col("off").alias("lo"), (F.col("off") + F.col("starts") - 1).alias("hi"))
        settled = same if settled is None else settled.unionByName(same)
        open_ = merged.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least")).where((F.col("members") > 1) & (F.col("least") == 1))
        members = staged(merged.join(open_.select("grp"), "grp"), "members")


def _segments(documents: DataFrame, classes: DataFrame, p: LongRepeats) -> DataFrame:
    """The classes with the bytes of one of their places."""
    wanted = classes.groupBy("tkey").agg(F.collect_list(F.struct("anchor", "class", "n", "start", "starts", "lead")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "class", "home", "off", "n", "lead", "starts", "seg"]
        kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for c in cuts:
                    grp = c["anchor"].to_bytes(8, "little", signed=True)
                    rows.append((grp, c["class"], c["class"], 0, c["n"], c["lead"], c["starts"], data[c["start"] : c["start"] + c["starts"] - 1 + p.length]))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    found = texts_of(documents, wanted).select("text", "cuts")
    return found.mapInArrow(run, "grp binary, class binary, home binary, off long, n long, lead long, starts long, seg binary")


def repeated_ranges(documents: DataFrame, p: LongRepeats = LongRepeats()) -> DataFrame:
    """(tkey, ranges): for every text with repeats, the byte ranges [lo, hi) of its repeated strings, unmerged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("tkey").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = list(anchors(text.encode("utf-8", "surrogatepass"), p))
                if rows:
                    a, s, c, d, k = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(a), pa.binary()), pa.array(a, pa.int64()), pa.array(s, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(k, pa.binary())],
                        ["tkey", "anchor", "start", "starts", "lead", "class"],
                    )

    text = documents.select(text_key("text").alias("tkey"), text_or_empty("text").alias("text")).where(F.octet_length("text") >= p.length)
    rows = staged(text.mapInArrow(run, "tkey binary, anchor long, start long, starts long, lead long, class binary"), "anchors")
    twice = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("anchor")
    # copies of a text are one row with a count
    places = staged(rows.join(twice, "anchor").groupBy("tkey", "anchor", "start", "starts", "lead", "class").agg(F.count(F.lit(1)).alias("n")), "places")
    classes = places.groupBy("anchor", "class").agg(F.sum("n").alias("n"), F.min(F.struct("tkey", "start", "starts", "lead")).alias("one"))
    classes = staged(classes.select("anchor", "class", "n", "one.*"), "classes")
    open_ = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least")).where((F.col("members") > 1) & (F.col("least") == 1))
    members = staged(_segments(documents, classes.join(open_.select("anchor"), "anchor"), p), "segments")
    ready, settled = _split_hot(members, p)
    found = _indexed(ready, p)
    found = found.unionByName(settled) if settled is not None else found
    found = found.unionByName(classes.where(F.col("n") > 1).select("class", F.lit(0).cast("long").alias("lo"), (F.col("starts") - 1).alias("hi")))
    ranges = places.join(staged(found, "ranges"), "class")
    span = F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + p.length).alias("hi"))
    return staged(ranges.groupBy("tkey").agg(F.collect_list(span).alias("ranges")), "spans")


def merged_spans(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def cut_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for lo, hi in spans:
        kept.append(data[at:lo])
        at = hi
    return b"".join([*kept, data[at:]])


def remove_repeats(documents: DataFrame, p: LongRepeats = LongRepeats()) -> DataFrame:
    """(tkey, spans, kept): for every distinct text with repeats, the removed byte ranges and the bytes left.

    Matches lie within one text (null counts as empty), are judged on the input and may overlap; every copy of
    a repeat goes, whole copies of a text of at least ``p.length`` bytes included. Texts without repeats give no
    row. Only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for batch in batches:
            spans = [merged_spans(r) for r in batch.column("ranges").to_pylist()]
            kept = [cut_spans(t.encode("utf-8", "surrogatepass"), s) for t, s in zip(batch.column("text").to_pylist(), spans, strict=True)]
            listed = pa.array([[{"lo": a, "hi": b} for a, b in s] for s in spans], kind)
            yield pa.RecordBatch.from_arrays([batch.column("tkey"), listed, pa.array(kept, pa.binary())], ["tkey", "spans", "kept"])

    found = texts_of(documents, repeated_ranges(documents, p)).select("tkey", "text", "ranges")
    return found.mapInArrow(run, "tkey binary, spans array<struct<lo: long, hi: long>>, kept binary")


def digest(documents: DataFrame, p: LongRepeats = LongRepeats()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text for every row of ``documents``.

    ``kept_text`` is what is left, as text; a character of which only some bytes are left shows as the replacement
    character. Rows whose text is surely without repeats, by a bit filter over the cut texts, are not shuffled.
    """
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["hi"] - s["lo"])
    cut = remove_repeats(documents, p).select("tkey", size.alias("removed"), F.size("spans").cast("long").alias("runs"), "kept")
    cut = staged(cut, "kept")
    text = text_or_empty("text")
    whole = documents.select("doc_id", text_key("text").alias("tkey"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    maybe = filter_for(cut.select("tkey")).column(F.xxhash64("tkey"))
    zero = F.lit(0).cast("long")
    clean = whole.where(~maybe).select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.col("text").alias("kept_text"))
    left = F.coalesce("kept", F.col("text").cast("binary"))
    doubt = whole.where(maybe).join(cut, "tkey", "left").select(
        "doc_id", "n_bytes", F.coalesce("removed", zero).alias("n_removed"), F.coalesce("runs", zero).alias("n_spans"), F.sha2(left, 256).alias("kept_sha256"), F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.make_valid_utf8(F.col("kept").cast("string"))).alias("kept_text")
    )
    return clean.unionByName(doubt)
