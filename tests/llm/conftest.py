from __future__ import annotations

import random

import pytest

PLACES = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu", "nu", "xi", "omi", "pi", "rho", "sig", "tau", "ups"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(PLACES) + r.choice("abcdefgh") for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, grp int, key long, part int, v double"


def rows_of(texts) -> list[tuple]:
    return [(d, t, lang, src, len(t) if t is not None else None, 1, 2, 3, 4, 5.0) for d, t, lang, src in texts]


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and columns whose names operators use inside."""
    passage = prose(1, 60)
    near = prose(7, 300)
    texts = [
        (1, "", "en", "a"), (2, None, "en", "a"), (3, " \n\t ", None, "a"), (4, "one", "en", None), (5, passage, "en", "a"), (6, "Start. " + passage + " end of it", "de", "b"),
        (7, prose(2, 5000), "en", "b"), (8, near, "en", "b"), (9, near + " extra", "en", "b"), (10, near, "en", "b"), (10, near, "en", "b"), (11, "x " * 400, "en", "c"),
        (None, passage, "en", "a"), (None, None, None, None), (12, "### $$$ %%% " * 20, None, "c"), (13, "é" * 3000 + " ünï", "fr", "c"), (14, prose(3, 25) + "\n" + prose(3, 25), "fr", "c"),
        (15, "tie", "en", "a"), (15, "other tie", "en", "a"), (16, "a" * 20000, "en", "a"), (17, "12345 67 !?", "en", "a"), (-5, prose(4, 40), "es", "a"),
    ]
    return rows_of(texts)


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    from conftest import SF

    return spark.read.parquet(f"{SF}/documents.parquet")
