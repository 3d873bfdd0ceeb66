import os
import sys
from functools import cache

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def spark():
    from tracehound.session import local_session

    return local_session(cpus=4, shuffle_partitions=4)


@cache
def prose(seed: int, n: int = 120) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(WORDS) for _ in range(2)) for _ in range(n)) + "."


def odd_documents() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows."""
    near = prose(1).split()
    near[60] = "changed"
    return [
        (1, prose(1), "en", "a", 10), (2, " ".join(near), "en", "a", 10), (3, prose(1).upper(), None, None, None), (4, None, "en", "b", None),
        (5, "", "en", "b", 0), (6, " \t\n\x0b\x0c\r ", "en", "b", 7), (7, prose(2, 30_000), "en", "a", 1), (8, prose(3), "en", None, 1), (8, prose(3), "en", None, 1),
        (9, "one", "en", "", 3), (10, "one two", "en", "", 7), (11, "ONE two", "en", "", 7), (12, "naïve 日本語 😀\x00 Ünï", "de", "é", 5), (None, prose(4), None, "a", 1),
        (13, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" x", "en", "c", 1), (14, "x" * 70_000, "en", "c", 1),
    ]


DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DOC).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns with the names that operators use inside and for their results."""
    from pyspark.sql import functions as F

    names = "id n v row hash bucket doc size target taken host path rule ids n_tokens same new_text _id clean kept score d1 d2 family count"
    return odd.withColumns({n: F.lit("mine") for n in names.split()})
