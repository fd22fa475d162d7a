import random

import pytest


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows, ties and clashing extra columns."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "Delta", "eps", "zeta", "ça", "über", "<|endoftext|>", "x\x1cy", "don't", "42", "ﬁ", "İx"]
    base = " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 90))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])) for i in range(40)]
    rows += [(100, base, "en", "a"), (101, base, "en", "a"), (101, base, "en", "a"), (102, base + " tail", None, "b"), (102, "another text of the same id", "fr", "b")]
    rows += [(200, None, "en", "a"), (201, "", "en", None), (202, " \n\t ", None, "a"), (None, base, "en", "a"), (None, None, None, None), (203, "!!! ...", "en", "b")]
    rows += [(300, "long " + " ".join(rng.choice(words[:6]) for _ in range(40_000)), "en", "a"), (301, "y" * 30_000, "en", "a")]
    schema = "doc_id long, text string, lang string, source string, start string, TEXT int, n_tokens string, Doc_Id string"
    return spark.createDataFrame([(*r, "s", 1, "n", "d") for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
