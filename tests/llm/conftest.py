import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, rank int, key string, part int"


def frame(spark, rows):
    """Rows (doc_id, text[, lang]) with further columns whose names clash with internal ones."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 7, 1, "k", 0) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_texts():
    rng = random.Random(5)
    words = ["the", "of", "and", "Über", "naïve", "x1", "straße", "don't", "東京", "ok.", "(yes)"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ","]) + str(rng.randint(0, 40)) for _ in range(n))
    base, other = prose(120), prose(60)
    near = base.replace(" the", " a", 1)
    return [None, "", " \n\t ", "a", "one two", "one two", base, base, near, base + " tail", other + "\n" + base,
            other + "\n\n" + other, "x" * 500, "ab" * 300, "é" * 150 + "\n" + "é" * 150, prose(4000), "z\x1cq\x85w",
            "<|endoftext|> and <|startoftext|>", "áb 😀 😀", "\n\n\n", other]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, list(enumerate(odd_texts())))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [(1, "x")]).filter("doc_id = 2")
