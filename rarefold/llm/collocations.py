"""Collocations by stripes: each prefix keys a counter of the words that come next.

Tasks fill stripes from their texts and merge them elementwise after a shuffle by prefix, in sorted order, one
stripe in memory at a time. Prefixes have 0 to 3 words. The merged stripes hold all that scoring needs: their entries are the
extensions of a prefix and so the totals of the prefixes one word longer, the empty prefix sums to all words, and the greatest
entries tell whether a longer phrase subsumes a shorter one. A stripe is filled only with phrases whose parts one word shorter
are both frequent, which loses nothing, as no phrase is more frequent than its parts.

The stripe of the empty prefix has words as text and is dealt to many buckets. The others have 64-bit hashes of
(language, prefix) and (language, next word), and only frequent phrases are turned into text again, by joins with
the level below; two frequent phrases of one hash raise an error. Prefixes that hold more than 1 / ``HOT`` of all words,
at most ``HOT`` of them, are dealt to buckets of next words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarefold.llm.common import BitFilter, beside, shuffle_partitions, staged, text_or_empty


@dataclass(frozen=True)
class Collocations:
    #: occurrences that make a phrase a candidate
    least: int = 30
    #: a longer candidate with this percentage of the occurrences drops a shorter one
    subsumed: int = 80
    #: phrases reported for each language
    top: int = 2000
    longest: int = 4


#: Ends a piece; no word holds it.
MARK = b"."
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + MARK * 9)
#: Buckets of the empty prefix and of a hot one.
FIRST_BUCKETS, HOT_BUCKETS, HOT = 4096, 64, 2000
#: Distinct words, and distinct phrases, that a task holds before it hands its stripes on.
HELD, HELD_PHRASES = 400_000, 2_000_000
#: Bytes of text that are cut into words at a time.
BYTES = 1 << 20
STRIPE = "lang string, bucket int, next array<string>, n array<long>"
#: An entry of a hashed stripe.
ENTRY = np.dtype([("next", "<i8"), ("n", "<u4")])


def words_of(texts: list[bytes]) -> list[bytes]:
    """All words in order; a mark stands between pieces and at the end."""
    return MARK.join(texts).translate(_FOLD).replace(MARK, b" . ").split() + [MARK]


def word_hash(word: bytes) -> int:
    return 0 if word == MARK else xxhash.xxh64_intdigest(word) or 1


class WordHashes(dict):
    """word -> 64-bit hash, 0 for the mark; bounded."""

    def __missing__(self, word: bytes) -> int:
        h = word_hash(word)
        if len(self) > 200_000:
            self.clear()
        self[word] = h
        return h


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def phrase_hashes(hashes: np.ndarray, lang: str, length: int) -> np.ndarray:
    """Hash of the phrase of ``length`` words that starts at each word, words given by theirs."""
    h = np.full(max(0, len(hashes) - length + 1), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    word = _mix(np.full(len(hashes), h[0] if len(h) else 0, np.uint64), hashes)
    h = word[: len(h)]
    for k in range(1, length):
        h = _mix(h, word[k : k + len(h)])
    return h


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, about ``BYTES`` at a time."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 512):
            batch = whole.slice(lo, 512)
            held: dict[str, list[bytes]] = {}
            size: dict[str, int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, []).append(text.encode())
                size[lang] = size.get(lang, 0) + len(held[lang][-1])
                if size[lang] > BYTES:
                    yield lang, held.pop(lang)
                    size.pop(lang)
            yield from held.items()


def fill_words(texts: DataFrame) -> DataFrame:
    """Stripes of the empty prefix: the words of each language, as many rows for a bucket as tasks that meet it."""

    def stripes(lang: str, counted: Counter) -> pa.RecordBatch:
        own: dict[int, tuple[list, list]] = {}
        for word, n in counted.items():
            next_, count = own.setdefault(zlib.crc32(word) % FIRST_BUCKETS, ([], []))
            next_.append(word.decode())
            count.append(n)
        lists = list(own.values())
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int32()), pa.array([x[0] for x in lists], pa.list_(pa.string())), pa.array([x[1] for x in lists], pa.list_(pa.int64()))],
            ["lang", "bucket", "next", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for lang, own in _batches(batches):
            held.setdefault(lang, Counter()).update(words_of(own))
            if sum(map(len, held.values())) > HELD:
                for key, counted in held.items():
                    del counted[MARK]
                    yield stripes(key, counted)
                held = {}
        for key, counted in held.items():
            del counted[MARK]
            yield stripes(key, counted)

    return texts.mapInArrow(run, STRIPE)


def merge_words(stripes: DataFrame, least: int) -> DataFrame:
    """One stripe for each language and bucket: elementwise sums.

    ``total`` is the sum of all counts; next, n and hash list the words counted ``least`` times or more. Tasks read
    their stripes in order and hold one.
    """
    parts = shuffle_partitions(stripes.sparkSession)

    def row(lang: str, bucket: int, own: dict[str, int]) -> pa.RecordBatch:
        kept = {w: n for w, n in own.items() if n >= least}
        words = np.fromiter((word_hash(w.encode()) for w in kept), np.uint64, len(kept))
        hashes = phrase_hashes(words, lang, 1).view(np.int64).tolist()
        cols = [[lang], [bucket], [sum(own.values())], [list(kept)], [list(kept.values())], [hashes]]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["lang", "bucket", "total", "next", "n", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, {}
        for batch in batches:
            for lang, bucket, next_, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "bucket", "next", "n")), strict=True):
                if (lang, bucket) != last:
                    if last is not None:
                        yield row(*last, own)
                    last, own = (lang, bucket), {}
                for w, c in zip(next_, n, strict=True):
                    own[w] = own.get(w, 0) + c
        if last is not None:
            yield row(*last, own)

    dealt = stripes.repartition(parts, "lang", "bucket").sortWithinPartitions("lang", "bucket")
    return dealt.mapInArrow(run, "lang string, bucket int, total long, next array<string>, n array<long>, hash array<long>")


def _summed(rank: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows sorted by ``rank`` (first column first), those equal in all of them as one, with the sum of ``n``."""
    if not len(n):
        return rank, n
    order = np.lexsort(rank[::-1])
    rank, n = [r[order] for r in rank], n[order]
    new = np.ones(len(n), bool)
    new[1:] = np.logical_or.reduce([r[1:] != r[:-1] for r in rank])
    at = np.flatnonzero(new)
    return [r[at] for r in rank], np.add.reduceat(n, at)


def fill(texts: DataFrame, length: int, frequent: BitFilter, hot: np.ndarray) -> DataFrame:
    """(prefix, bucket, entries): stripes of the prefixes of ``length`` words, as many for a prefix as tasks that meet it.

    ``frequent`` passes at least all frequent phrases of ``length`` words; ``hot`` are the prefixes dealt to several buckets.
    """

    def stripes(prefix: np.ndarray, next_: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        bucket = np.where(np.isin(prefix, hot), next_ & (HOT_BUCKETS - 1), 0).astype(np.int32)
        (prefix, bucket, next_), n = _summed([prefix, bucket, next_], n)
        entries = np.empty(len(n), ENTRY)
        entries["next"], entries["n"] = next_, n
        new = np.ones(len(n), bool)
        new[1:] = (prefix[1:] != prefix[:-1]) | (bucket[1:] != bucket[:-1])
        at = np.flatnonzero(new)
        ends = (np.append(at, len(n)) * ENTRY.itemsize).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(entries.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(prefix[at]), pa.array(bucket[at]), data], ["prefix", "bucket", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held, size, fresh = [], 0, 0

        def together() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            (prefix, next_), n = _summed([np.concatenate([h[k] for h in held]) for k in (0, 1)], np.concatenate([h[2] for h in held]))
            return prefix, next_, n

        for lang, own in _batches(batches):
            words = words_of(own)
            h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
            one, of = phrase_hashes(h, lang, 1), phrase_hashes(h, lang, length)
            may = frequent.test(of)
            for k in range(length):
                may &= h[k : k + len(may)] != 0
            at = np.flatnonzero(may[:-1] & may[1:])
            held.append((of[at].view(np.int64), one[at + length].view(np.int64), np.ones(len(at), np.int64)))
            size, fresh = size + len(at), fresh + len(at)
            if fresh > HELD_PHRASES // 4:
                held = [together()]
                size, fresh = len(held[0][0]), 0
                if size > HELD_PHRASES:
                    yield stripes(*held[0])
                    held, size = [], 0
        if size:
            yield stripes(*together())

    return texts.mapInArrow(run, "prefix long, bucket int, entries binary")


def merge(stripes: DataFrame, least: int) -> DataFrame:
    """(prefix, next, a, hash): the entries counted ``least`` times or more once all stripes of a prefix (and bucket) are summed; hash is the whole phrase's."""
    parts = shuffle_partitions(stripes.sparkSession)

    def out(rows: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        prefix, _, next_ = (r[n >= least] for r in rows)
        whole = _mix(prefix.view(np.uint64), next_.view(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (prefix, next_, n[n >= least], whole)], ["prefix", "next", "a", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)], np.zeros(0, np.int64)
        for batch in batches:
            entries = [np.frombuffer(e, ENTRY) for e in batch.column("entries").to_pylist()]
            sizes = np.fromiter(map(len, entries), np.int64, len(entries))
            all_ = np.concatenate(entries) if entries else np.zeros(0, ENTRY)
            fresh = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("prefix", "bucket")] + [all_["next"]]
            rows, n = _summed([np.concatenate(x) for x in zip(rows, fresh, strict=True)], np.concatenate([n, all_["n"].astype(np.int64)]))
            if len(n):  # the last stripe may go on
                open_ = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
                yield out([r[~open_] for r in rows], n[~open_])
                rows, n = [r[open_] for r in rows], n[open_]
        yield out(rows, n)

    dealt = stripes.repartition(parts, "prefix", "bucket").sortWithinPartitions("prefix", "bucket")
    return dealt.mapInArrow(run, "prefix long, next long, a long, hash long")


def _known(phrases: DataFrame) -> DataFrame:
    """``phrases`` staged; their hashes must tell them apart."""
    phrases = staged(phrases, "phrases")
    n = phrases.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("hashes")).first()
    if n.n != n.hashes:
        raise ValueError("two frequent phrases have one hash")
    return phrases


def collocations(documents: DataFrame, p: Collocations = Collocations()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each language.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and those into words at spaces and tabs. A candidate
    is a phrase of 2 to 4 words with a >= ``least``; of its cuts in two the one with the lowest score
    floor(2000000 a / (l + r)) counts (ties: the shortest first part). Candidates within a longer one that has ``subsumed``
    percent of their occurrences are dropped; by transitivity it is enough to look at candidates one word longer.
    Null languages are ``und``, null texts empty; repeated rows count each; other columns are not read. Without a candidate the
    result is empty. All sums are exact (decimals where a product may pass 64 bits).
    """
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty("text").alias("text"))
    first = staged(merge_words(fill_words(texts), p.least), "stripes")
    words = first.groupBy("lang").agg(F.sum("total").alias("n"))
    single = first.select("lang", F.explode(F.arrays_zip("next", "n", "hash")).alias("e"))
    single = _known(single.select("lang", F.lit(None).cast("string").alias("prefix"), F.col("e.next").alias("phrase"), F.lit(1).alias("m"), F.col("e.n").alias("a"), F.col("e.hash").alias("hash")))
    share = (words.agg(F.sum("n")).first()[0] or 0) // HOT
    below, counts = single, single
    for length in range(1, p.longest):
        hot = np.array([r.hash for r in below.where(F.col("a") > share).select("hash").collect()], np.int64)  # at most HOT rows
        merged = merge(fill(texts, length, BitFilter(below.select("hash")), hot), p.least)
        prefix = below.select("lang", F.col("phrase").alias("prefix"), F.col("hash").alias("of"))
        next_ = single.select(F.col("phrase").alias("word"), F.col("hash").alias("of_next"))
        merged = staged(merged.toDF("of", "of_next", "a", "hash"), "stripes").join(prefix, "of").join(next_, "of_next")
        below = _known(merged.select("lang", "prefix", F.concat_ws(" ", "prefix", "word").alias("phrase"), F.lit(length + 1).alias("m"), "a", "hash"))
        counts = counts.unionByName(below)
    counts = counts.drop("hash")
    found = counts.where("m > 1")

    longer = found.where("m > 2")
    suffix = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    above = longer.select("lang", F.col("prefix").alias("phrase"), "a").unionByName(longer.select("lang", suffix.alias("phrase"), "a"))
    above = above.groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    kept = found.drop("prefix").join(above, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("above") < p.subsumed * F.col("a"), F.lit(True))).drop("above")

    cuts = kept.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, m - k), ' ')").alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(20,0)) * 2000000BD) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= p.top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= p.top)
    return beside(ranked, words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with pieces as (
  select lang, regexp_extract_all(piece, '[^ \t]+') as w from (
    select coalesce(lang, 'und') as lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents)
),
grams as (
  select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase
  from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from pieces, (select unnest([1, 2, 3, 4]) as m))
),
f as (select lang, m, phrase, count(*) as a from grams group by all having count(*) >= 30),
words as (select lang, sum(len(w)) as n from pieces group by lang),
cand as (select lang, m, phrase, a, string_split(phrase, ' ') as w from f where m > 1),
inner_ as (
  select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, a as longer
  from (select *, unnest(range(1, m - k + 2)) as i from (select *, unnest(range(2, m)) as k from cand))
),
kept as (
  select c.* from cand c left join (select lang, phrase, max(longer) as longer from inner_ group by all) x using (lang, phrase)
  where x.longer is null or 100 * x.longer < 80 * c.a
),
cuts as (
  select c.lang, c.phrase, c.a, k, p.a as l, q.a as r, (2000000::hugeint * c.a) // (p.a + q.a) as score
  from (select *, unnest(range(1, m)) as k from kept) c
  join f p on p.lang = c.lang and p.phrase = array_to_string(c.w[1:k], ' ')
  join f q on q.lang = c.lang and q.phrase = array_to_string(c.w[k + 1:], ' ')
),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from ranked join words using (lang) where rank <= 2000
"""
