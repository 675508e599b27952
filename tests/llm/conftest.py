import random

import pytest

#: Extra columns named like those that operators use inside.
CLASHES = "k long, t long, fp long, pos binary, found string, lines array<int>, size long, shard long, _text string, gone string"


def odd_rows():
    """Nulls in every column, empty, blank and long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = [f"w{n}" for n in range(60)]
    run = " ".join(rng.choice(words) for _ in range(70))
    lines = "\n".join(" ".join(rng.choice(words) for _ in range(10)) for _ in range(4))
    texts = [None, "", " \n\t ", "one", "two words", "Ünïcode ß 中文 😀 é", run, "start " + run + " end", run, lines, "x y z\n" + lines, lines]
    texts += [" ".join(rng.choice(words) for _ in range(30_000)), "a a a a a a", "same\nsame\nsame", "<|endoftext|> it's <|STARTOFTEXT|>"]
    rows = [(n, t, ("en", None, "de")[n % 3], ("s", "z", None)[n % 3], None if n % 4 else 1) for n, t in enumerate(texts)]
    rows += [rows[6], rows[9], rows[9], (None, run, "en", None, 0), (None, "alone", None, "s", 1), (3, "other text of the same id", "en", "s", 1), (None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([r + (None,) * 10 for r in odd_rows()], f"{SCHEMA}, {CLASHES}").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
