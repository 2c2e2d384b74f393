import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def prose():
    """n words drawn with a seed."""

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(50)) * (r.random() < 0.5) for _ in range(n))

    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, bucket string, hits string"


@pytest.fixture(scope="session")
def docs(spark):
    """documents from (doc_id, text[, source, lang]), with extra columns whose names the operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", None, "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
