"""Small tables with the awkward rows every operator must take."""

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def awkward_rows(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars, text_crc32): nulls, empties, a very long text, repeats and a clashing extra column."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(n)]
    texts += [None, "", "   \n\t ", "one", "a b c d", "Ünï çödé ſeCRET " * 3, texts[0], texts[0], texts[1] + " tail", prose(rng, 30_000), "same line\n" * 300]
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s1"][i % 2] if i % 7 else None, len(t or ""), i) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id " * 40, "en", "s0", 240, 0), (5, "another text under an id that exists " * 9, "en", "s0", 0, 0)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_crc32 int"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
