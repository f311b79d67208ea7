"""Best-fit packing of tokenized documents, improved by swap-based local search.

Documents are tokenized once; only (row, length) travels after that. Pieces are dealt to
blocks of bounded size by a hash, each block is packed on its own (best fit, then local search
over its underfull sequences), and sequences that stay underfull are pooled and packed again
until they fit in one block. Every block is one small group: no task holds more.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefold.llm.common import staged, text_or_empty


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    separator: int = 0
    #: pieces in one block
    block: int = 8192
    #: a sequence with more free tokens than this is packed again with those of other blocks
    slack: int = 8
    rounds: int = 6


#: Bytes of word encodings that a worker remembers, in two memories; beyond it they start anew. Longer chunks are not remembered.
REMEMBERED_BYTES, REMEMBERED_LENGTH = 400 << 20, 64
#: Bytes of text that are encoded at a time; a longer text is encoded alone.
BYTES = 1 << 20


#: Lower-case letters whose lower-casing and normal form are themselves, and marks that end a word.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+").fullmatch
_ENDINGS = ".,;:!?)"


class WordEncoder(dict):
    """chunk between white space -> its ids as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    chunks in order; chunks repeat far more than texts do. A chunk of plain letters with closing marks is two of the tokenizer's
    own pieces, letters in lower case and marks, which are remembered apart and go straight to its model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.held = 0
        # the letters that stand for bytes in the model's vocabulary
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x250)) if _LETTERS(c)}

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = np.array([t.id for t in self.model.tokenize(word.translate(self.letters))], "<u4").tobytes()
            self._keep(self.words, word, ids)
        return ids

    def _keep(self, memory: dict[str, bytes], chunk: str, ids: bytes) -> None:
        if len(chunk) <= REMEMBERED_LENGTH:
            memory[chunk] = ids
            self.held += 240 + len(chunk) + len(ids)  # an entry, its string and its bytes

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Remembers the encodings of short chunks of ``new`` and returns those of the others."""
        other, made = [], {}
        for c in new:
            word = c.rstrip(_ENDINGS)
            low = word.lower()
            if _LETTERS(low):
                made[c] = self._word(low) + (self._marks(c[len(word) :]) if len(word) < len(c) else b"")
            else:
                other.append(c)
        for at in range(0, len(other), 4096):
            part = other[at : at + 4096]
            made.update(zip(part, self._whole(part), strict=True))
        short = {c: ids for c, ids in made.items() if len(c) <= REMEMBERED_LENGTH}
        self.update(short)
        self.held += 240 * len(short) + sum(map(len, short)) + sum(map(len, short.values()))
        return {c: ids for c, ids in made.items() if len(c) > REMEMBERED_LENGTH} if len(short) < len(made) else {}

    def _marks(self, marks: str) -> bytes:
        ids = self.words.get(marks)
        if ids is None:
            ids = self._whole([marks])[0]
            self._keep(self.words, marks, ids)
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        chunks = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if self.held > REMEMBERED_BYTES:
            self.clear()
            self.words.clear()
            self.held = 0
        long = self._learn({c for own in chunks for c in own if c not in self})
        if not long:
            return [b"".join(map(self.__getitem__, own)) for own in chunks]
        return [b"".join([self[c] if c in self else long[c] for c in own]) for own in chunks]


@cache
def _encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
    return WordEncoder(path)


def pieces(documents: DataFrame, tokenizer_path: str, p: Packing, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and on demand ids (little-endian 32-bit), for every piece of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    step, end = 4 * p.capacity, np.array([p.separator], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        row, piece, start, length, crc, ids = [], [], [], [], [], []
        for i, data in enumerate(_encoder(tokenizer_path).encode(texts)):
            data += end
            for k, lo in enumerate(range(0, len(data), step)):
                part = data[lo : lo + step]
                row.append(i)
                piece.append(k)
                start.append(lo // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(part)
        columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lo, size, texts = 0, 0, []
            for i in range(whole.num_rows):
                texts.append(whole.column("text")[i].as_py())
                size += len(texts[-1])
                if size > BYTES:
                    yield cut(whole.slice(lo, i + 1 - lo), texts)
                    lo, size, texts = i + 1, 0, []
            if texts:
                yield cut(whole.slice(lo), texts)

    rows = documents.select("doc_id", text_or_empty("text").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit in falling order of length; bins are lists of item numbers."""
    bins: list[list[int]] = []
    at_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g: some bin has g tokens free
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = gaps >> n
        if fits:
            g = n + (fits & -fits).bit_length() - 1
            b = at_gap[g].pop()
            if not at_gap[g]:
                gaps ^= 1 << g
            bins[b].append(i)
            g -= n
        else:
            b, g = len(bins), capacity - n
            bins.append([i])
        if g:
            at_gap[g].append(b)
            gaps |= 1 << g
    return bins


def _least_bins(lengths: np.ndarray, capacity: int) -> int:
    return max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))


def local_search(lengths: np.ndarray, place: np.ndarray, capacity: int) -> np.ndarray:
    """Empty bins by moves and swaps that each raise the sum of squared fills.

    ``place`` gives each item's bin. The least full bin is the donor. For an item of it, in falling length: move it
    to the fullest bin with room; else exchange it for a shorter item of a fuller bin, or for two
    items there that are shorter together; else put two of the donor's items in place of one. A step must fit
    and must fill the other bin further, so fills only spread apart and the search ends. A donor that
    cannot be emptied is left as it stands and the next one is tried.
    """
    place = place.copy()
    fill = np.bincount(place, weights=lengths).astype(np.int64)
    least = _least_bins(lengths, capacity)
    live = int((fill > 0).sum())
    tried = np.zeros(len(fill), bool)
    while live > least:
        open_ = np.flatnonzero((fill > 0) & ~tried & (fill < capacity))
        if not len(open_):
            break
        donor = int(open_[np.argmin(fill[open_])])
        tried[donor] = True
        while _one_step(lengths, place, fill, donor, capacity):
            pass
        live -= fill[donor] == 0
    return place


def _one_step(lengths: np.ndarray, place: np.ndarray, fill: np.ndarray, donor: int, capacity: int) -> bool:
    own = np.flatnonzero(place == donor)
    if not len(own):
        return False
    own = own[np.argsort(-lengths[own], kind="stable")]
    gap = capacity - fill
    gap[(fill == 0) | (fill < fill[donor])] = 0
    gap[donor] = 0
    for i in own.tolist():  # move
        room = np.where(gap >= lengths[i], gap, capacity + 1)
        b = int(room.argmin())
        if room[b] <= capacity:
            place[i] = b
            fill[b] += lengths[i]
            fill[donor] -= lengths[i]
            return True
    there = np.flatnonzero(gap[place] > 0)
    size, room = lengths[there], gap[place[there]]

    def swap(out: list[int], back: list[int], b: int) -> bool:
        gain = int(lengths[out].sum() - lengths[back].sum())
        place[out], place[back] = b, donor
        fill[b] += gain
        fill[donor] -= gain
        return True

    for i in own.tolist():  # one for one: the exchange that fills the other bin most
        gain = lengths[i] - size
        gain[(gain <= 0) | (gain > room)] = 0
        if len(gain) and gain.max() > 0:
            j = int(there[gain.argmax()])
            return swap([i], [j], int(place[j]))
    order = np.lexsort((size, place[there]))  # neighbours of one bin, shortest first
    first, second = there[order][:-1], there[order][1:]
    pair = place[first] == place[second]
    first, second = first[pair], second[pair]
    for i in own.tolist():  # one for two
        gain = lengths[i] - lengths[first] - lengths[second]
        gain[(gain <= 0) | (gain > gap[place[first]])] = 0
        if len(gain) and gain.max() > 0:
            k = int(gain.argmax())
            return swap([i], [int(first[k]), int(second[k])], int(place[first[k]]))
    for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):  # two for one
        gain = lengths[x] + lengths[y] - size
        gain[(gain <= 0) | (gain > room)] = 0
        if len(gain) and gain.max() > 0:
            j = int(there[gain.argmax()])
            return swap([x, y], [j], int(place[j]))
    return False


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A bin number for each item: best fit, then local search."""
    place = np.zeros(len(lengths), np.int64)
    for b, items in enumerate(_best_fit(lengths.tolist(), capacity)):
        place[items] = b
    return local_search(lengths, place, capacity)


def place_pieces(sized: DataFrame, p: Packing) -> DataFrame:
    """``sized`` (uid long unique, length long from 1 to the capacity) plus sequence_id and offset.

    A sequence is named by the least uid in it. Full pieces are sequences of their own.
    """

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        place = pack(lengths, p.capacity)
        fill = np.bincount(place, weights=lengths).astype(np.int64)
        by = pdf.groupby(place)
        return pd.DataFrame(
            {
                "uid": pdf["uid"],
                "length": lengths,
                "sequence_id": by["uid"].transform("min"),
                "offset": by["length"].cumsum() - lengths,
                "free": p.capacity - fill[place],
            }
        )

    full = sized.where(F.col("length") >= p.capacity).select("uid", "length", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, todo = full, sized.where(F.col("length") < p.capacity).select("uid", "length")
    last = None
    for k in range(p.rounds):
        n = todo.count()
        if n and n == last:  # no sequence was closed: the open ones stay as they are
            done = done.unionByName(out.where(again).drop("free"))
        if not n or n == last:
            break
        last = n
        blocks = -(-n // p.block)
        dealt = todo.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(k)), F.lit(blocks)))
        out = staged(dealt.groupBy("block").applyInPandas(block, "uid long, length long, sequence_id long, offset long, free long"), "packed")
        again = (F.col("free") > p.slack) if blocks > 1 and k + 1 < p.rounds else F.lit(False)
        done = done.unionByName(out.where(~again).drop("free"))
        todo = out.where(again).select("uid", "length")
        if blocks == 1:
            break
    return done


def pack_documents(documents: DataFrame, tokenizer_path: str, p: Packing = Packing()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    A document is its ids and one separator; null and empty texts are the separator alone. Only documents longer
    than the capacity are cut, at multiples of it. Repeated rows are packed each; a null doc_id is
    kept; columns other than doc_id and text are not read. Offsets are gapless from 0 in each sequence.
    """

    made = pieces(documents, tokenizer_path, p)
    made = staged(made.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = place_pieces(made.select("uid", "length"), p)
    return made.join(placed.select("uid", "sequence_id", "offset"), "uid").drop("uid")


def sequences(documents: DataFrame, placed: DataFrame, tokenizer_path: str, p: Packing = Packing()) -> DataFrame:
    """(sequence_id, ids): the token arrays that a placement by ``pack_documents`` stands for.

    doc_ids must be unique here. Each sequence gathers at most ``capacity`` pieces.
    """
    made = pieces(documents, tokenizer_path, p, True).select("doc_id", "piece", "ids")
    rows = placed.select("doc_id", "piece", "sequence_id", "offset").join(made, ["doc_id", "piece"])
    parts = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in own), "<u4").astype(np.int64) for own in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int64()))], ["sequence_id", "ids"])

    return parts.mapInArrow(run, "sequence_id long, ids array<long>")
