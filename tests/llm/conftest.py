import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, partitions=3):
        """A documents table of (doc_id, text) pairs."""
        return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(4)
    words = ["the", "of", "and", "to"] * 3 + ["".join(rng.choice(["ka", "lo", "mi", "ré", "tu", "Än"]) for _ in range(rng.randint(1, 5))) for _ in range(400)]

    def text(n, seed=None):
        r = random.Random(seed) if seed is not None else rng
        return " ".join(r.choice(words) for _ in range(n))

    return text


#: Odd rows that every operator takes: null and empty texts, spaces only, null ids, repeated rows, long texts, odd signs.
ODD = [(90, None), (91, ""), (92, " \t\n "), (None, "a null id"), (93, "same row"), (93, "same row"), (94, "x"), (95, "…🙂   ½"), (96, "ab " * 30000), (97, "z" * 50000)]
