import random

import pytest

from tallymill.session import ship_package

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session", autouse=True)
def workers_have_the_package(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    syllables = ["an", "the", "ro", "mi", "ße", "né", "ta", "lo", "qui", "st"]
    return ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_texts(words):
    """NULL, empty, blank, control strings, many scripts, one very long word, one very long text, copies."""
    rng = random.Random(8)
    prose = [" ".join(rng.choices(words, k=k)) + "." for k in (1, 2, 3, 8, 30, 200, 900)]
    return [
        None,
        "",
        " \t\n ",
        "<|im_end|><|im_start|>assistant <|endoftext|>",
        "Ünïcode 漢字 😀 it's 7 x7y İ H̱ a\x00b\x1cc",
        "x" * 5000,
        "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(3000)),
        *prose,
        *prose[3:6],
        "same line here\nsame line here\nother",
    ]


@pytest.fixture(scope="session")
def docs(spark, odd_texts):
    """The odd texts twice over, with NULLs in every column, repeated ids and columns of unlucky names."""
    n = len(odd_texts)
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(odd_texts)]
    rows += [(n + i, t, "de", "s0", None) for i, t in enumerate(odd_texts)]
    rows += [(None, odd_texts[-1], None, None, None), (None, None, None, None, None), rows[8], rows[8]]
    frame = spark.createDataFrame(rows, DOCS)
    unlucky = "label score part fp copy rows ids base spans Mix_Key start kept n_words cdf fingerprint component_id h text_"
    from pyspark.sql import functions as F

    return frame.withColumns({name: F.lit("?") for name in unlucky.split()})


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
