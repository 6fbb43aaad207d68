import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece string, n_tokens string, bin string, h double, range int, tid string"


def row(doc_id, text, lang="en", source="s"):
    """A document with columns whose names the operators use themselves."""
    return (doc_id, text, lang, source, None if text is None else len(text), "x", "y", "z", 0.5, 7, "t")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows and ids, ties, long texts, odd characters."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "été", "日本", "naïve", "OMEGA", "x1", "don't", "end."]
    long = " ".join(rng.choice(words) for _ in range(9000))
    rows = [
        row(1, None), row(2, ""), row(3, "  \n\t "), row(4, "alpha"), row(5, "alpha beta gamma delta été end."),
        row(5, "alpha beta gamma delta été end."), row(5, "another text under the same id"),
        row(None, "no id here at all"), row(None, None, None, None), row(7, long), row(8, long + " more"), row(9, "!!! ??? 123"),
        row(10, "İstanbul ΣΑΣ ²³½ x\x1cy <|endoftext|> 日本語"), row(11, "alpha " * 300),
        row(12, "line one is here today\nsecond line of twelve words is standing here for all to see", None),
        row(13, "second line of twelve words is standing here for all to see\nown line", "de"),
        row(-4, "paid invoice 17 on 2021-01-01 in full\ncafé"), row(14, "paid invoice 99 on 2022-02-02 in full\nunique rest of it"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
