import random

import public_tokenizers as P
from tokenizers import Tokenizer, models, pre_tokenizers

from rarefold.llm.tokencount import PieceCounter, count_tokens, unigram_vocabulary

PATH = P.path("piece_bpe_32k.model")


def library(vocabulary):
    t = Tokenizer(models.Unigram(list(vocabulary), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_ties_and_unknowns_against_the_library():
    rng = random.Random(4)
    for _ in range(150):
        pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 14))}
        bytes_ = [f"<0x{i:02X}>" for i in range(256)]
        vocabulary = [("<unk>", 0.0)] + [(b, 0.0) for b in bytes_] + [(x, rng.choice([-1.0, -2.0, -2.5, -0.1, -0.3])) for x in sorted(pieces)]
        lib, own = library(vocabulary), PieceCounter(tuple(vocabulary))
        for _ in range(40):
            text = "".join(rng.choice("aabbcc dé\n") for _ in range(rng.randrange(0, 14)))
            assert own.text(text) == len(lib.encode(text, add_special_tokens=False).ids), (vocabulary[257:], text)


def test_public_vocabulary(awkward, empty):
    lib = library(unigram_vocabulary(PATH))
    got = sorted(map(repr, count_tokens(awkward, PATH).collect()))
    want = [(r.doc_id, len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in awkward.collect()]
    assert got == sorted(f"Row(doc_id={a}, n_tokens={b})" for a, b in want)
    assert count_tokens(empty, PATH).count() == 0
