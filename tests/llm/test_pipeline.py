import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rarefold.llm import quality as Q
from rarefold.llm.common import staged, table

from .conftest import SCHEMA, awkward_rows, prose
from .test_minhash import naive_components
from .test_packing import gapless
from .test_quality import naive as naive_stats
from .test_secrets import naive as naive_secrets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, d = random.Random(21), str(tmp_path_factory.mktemp("sf"))
    items = [(i, prose(rng, 30)) for i in range(5)]
    rows = [(1000 + i, prose(rng, rng.randrange(40, 200)), "en", f"s{i % 2}", 0, 0) for i in range(500)]
    rows += [(3000 + i, rows[i][1] + " " + prose(rng, 2), "en", "s0", 0, 0) for i in range(0, 60)]
    rows += [(4000 + i, prose(rng, 60) + " " + items[i % 5][1] + " " + prose(rng, 20), "en", "s1", 0, 0) for i in range(25)]
    rows += [(5000 + i, prose(rng, 60) + f" password = hunter2x{i:04d} " + prose(rng, 20), "en", "s1", 0, 0) for i in range(25)]
    rows += [(6000 + i, " ".join("#|%$" for _ in range(50 + i)), "en", "s1", 0, 0) for i in range(25)]
    rows += [rows[100], rows[100]]
    # columns whose names clash with what the operators use
    df = spark.createDataFrame(rows + awkward_rows(), SCHEMA).selectExpr("*", "doc_id as n_words", "'x' as kept", "1 as uid", "text as tkey", "lang as __c1", "2 as distance", "3 as `with.dot and space`")
    df.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_against_plain_python(spark, folder):
    docs = table(spark, folder, "documents")
    columns = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = staged(stage(spark, docs, folder), name)
        after[name] = (before, docs.collect())
        assert name == "best_fit_packing" or docs.columns == columns
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or "")

    before, kept = after["quality_rules"]
    rules, left = Q.QualityRules(), {key(r) for r in kept}
    for r in before:
        n, *_, repeats = naive_stats(r.text)
        if n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n or 6000 <= (r.doc_id or 0) < 7000:
            assert key(r) not in left
        elif (r.doc_id or 0) >= 1000:
            assert key(r) in left
    assert {repr(r) for r in kept} <= {repr(r) for r in before}

    before, kept = after["near_duplicates"]
    _, comp = naive_components([r.text for r in before])
    groups = {}
    for r, c in zip(before, comp):
        groups.setdefault(c, []).append(r)
    assert len(kept) == len(groups)
    ids = lambda rs: [r.doc_id for r in rs if r.doc_id is not None]
    assert sorted(min(ids(g), default=-1) for g in groups.values()) == sorted(-1 if r.doc_id is None else r.doc_id for r in kept)

    before, kept = after["benchmark_decontamination"]
    assert sorted(map(repr, kept)) == sorted(repr(r) for r in before if not 4000 <= (r.doc_id or 0) < 5000)

    before, kept = after["secret_scan"]
    assert len(before) == len(kept) and sum("[secret]" in r.text for r in kept) == 25
    was = {key(r)[0]: r for r in before}
    for r in kept:
        if 5000 <= (r.doc_id or 0) < 6000:
            [(_, a, b)] = naive_secrets(was[r.doc_id].text)
            assert r.text == was[r.doc_id].text[:a] + "[secret]" + was[r.doc_id].text[b:] and r.n_chars == len(r.text)
        else:
            assert repr(r) == repr(was[key(r)[0]])

    before, rows = after["best_fit_packing"]
    lib, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), []
    for r in before:
        x = np.array(lib.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [repr((r.doc_id, k, s, len(x[s : s + 2048]), zlib.crc32(x[s : s + 2048].tobytes()))) for k, s in enumerate(range(0, len(x), 2048))]
    assert sorted(want) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    total = sum(r.length for r in rows)
    assert gapless(rows, 2048) <= -(-total // 2048) + 1


def test_empty_tables(spark, folder, tmp_path):
    d = str(tmp_path)
    table(spark, folder, "documents").limit(0).write.parquet(f"{d}/documents.parquet")
    table(spark, folder, "benchmark").limit(0).write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_near_duplicates_link_from_080_on(spark):
    rng, rows = random.Random(4), []
    for i, (n, changed) in enumerate([(104, 10), (94, 10), (104, 12)] * 10):  # similarity 90/110, 80/100 and 88/112
        words = prose(rng, n).split()
        rows += [(2 * i, " ".join(words), "en", "s", 0, 0), (2 * i + 1, " ".join(words[:-changed] + prose(rng, changed).split()), "en", "s", 0, 0)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, *_ in rows if d % 2 == 0 or d // 2 % 3 == 2)
