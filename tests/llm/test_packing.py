import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from rarefold.llm.packing import Packing, _best_fit, _least_bins, local_search, pack, pack_documents, sequences

PATH = P.path("word_bpe_49k.json")


def test_encoder_is_the_tokenizer(spark, awkward):
    lib = Tokenizer.from_file(PATH)
    extra = [(800, "á ́b don't <|endoftext|>x <|startoftext|> \x1c y\x85z\xa0Σ ΑΣ İ ﬁ​1234 ###!", "en", "s", 0, 0), (801, "\t a\r\n b\x0bc ", "en", "s", 0, 0)]
    df = awkward.unionByName(spark.createDataFrame(extra, awkward.schema))
    p = Packing()
    rows = pack_documents(df, PATH, p).collect()
    want = []
    for r in df.collect():
        ids = np.array(lib.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [repr((r.doc_id, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()))) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(want) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    gapless(rows, 2048)


def gapless(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= capacity
    return len(by)


def test_local_search_only_improves():
    rng = random.Random(2)
    saved = 0
    for _ in range(80):
        lengths = np.array([rng.choice([rng.randrange(1, 60), rng.randrange(30, 100)]) for _ in range(rng.randrange(2, 120))])
        place = np.zeros(len(lengths), np.int64)
        order, fill = rng.sample(range(len(lengths)), len(lengths)), [0]
        for i in order:  # next fit, a poor start
            if fill[-1] + lengths[i] > 100:
                fill.append(0)
            place[i] = len(fill) - 1
            fill[-1] += lengths[i]
        after = local_search(lengths, place, 100)
        now = np.bincount(after, weights=lengths)
        assert now.max() <= 100 and (now**2).sum() >= (np.bincount(place, weights=lengths) ** 2).sum()
        assert len(set(after.tolist())) <= len(fill)
        saved += len(fill) - len(set(after.tolist()))
        assert len(set(pack(lengths, 100).tolist())) <= len(_best_fit(lengths.tolist(), 100))
    assert saved > 100


def test_blocks_come_close_to_the_bound(spark, empty):
    rng = random.Random(5)
    rows = [(i, "word " * rng.choice([rng.randrange(1, 40), rng.randrange(1, 190)]), "en", "s", 0, 0) for i in range(1500)]
    df = spark.createDataFrame(rows, empty.schema)
    p = Packing(capacity=128, block=200)
    out = pack_documents(df, PATH, p)
    got = out.collect()
    n = gapless(got, 128)
    assert n <= 1.01 * _least_bins(np.array([r.length for r in got]), 128) + 1
    ids = {r.sequence_id: r.ids for r in sequences(df, out, PATH, p).collect()}
    assert len(ids) == n and all(zlib.crc32(np.array(ids[r.sequence_id][r.offset : r.offset + r.length], "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert pack_documents(empty, PATH).count() == 0


def test_items_that_leave_no_choice(spark):
    assert len(set(pack(np.full(50, 60), 100).tolist())) == 50
    assert len(set(pack(np.array([100, 50, 50, 1]), 100).tolist())) == 3


def test_equal_lengths_over_blocks_all_stay(spark, empty):
    df = spark.createDataFrame([(i, "word " * 80, "en", "s", 0, 0) for i in range(500)], empty.schema)
    got = pack_documents(df, PATH, Packing(capacity=128, block=200)).collect()
    assert sorted(r.doc_id for r in got) == list(range(500))
    assert gapless(got, 128) == 500
