import os

import pytest

FOLDER = os.environ.get("WARDFLOW_TEST_TABLES", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key long, g string, size int, spans string, shard int"


def prose(seed, n):
    """Words of a seeded generator, with sentences and lines."""
    import random

    draw = random.Random(seed)
    words = ["".join(draw.choice("abdeilmnorstué") for _ in range(draw.randint(2, 9))) for _ in range(n)]
    out = []
    for i, word in enumerate(words):
        out.append(word.capitalize() if i % 9 == 0 else word)
        if i % 9 == 8:
            out[-1] += draw.choice([".", ".", "!", ".\n"])
    return " ".join(out).replace("\n ", "\n")


PASSAGE = prose(1000, 70)


def edge_rows():
    base = prose(1, 120)
    near = base.replace(base.split(" ")[60], "changed", 1)
    texts = [
        (1, base),
        (2, base),
        (2, base),
        (3, near),
        (4, None),
        (5, ""),
        (6, "  \n\t "),
        (7, "one"),
        (8, "two words"),
        (9, "x" * 5000),
        (10, "word " * 3000),
        (11, prose(2, 90) + " " + PASSAGE + " " + prose(3, 60)),
        (12, prose(4, 80) + "\n" + PASSAGE + "\n" + prose(5, 70)),
        (None, prose(6, 80)),
        (None, None),
        (13, "a # b $ c % " * 60),
        (14, "same line of words\n" * 40),
        (15, "漢字とかな交じり文。 " * 20 + "Ωμέγα ½ ٣ 😀"),
        (16, prose(7, 60) + " All rights reserved. " + prose(8, 30)),
        (17, "first\tsecond\r\nthird  fourth fifth <|endoftext|> don't"),
    ]
    own = ("en", "s", 1, 77, "clash", 9, "kept", 5)
    return [(doc_id, text, *own) for doc_id, text in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """All documents of the smallest test table."""
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables not available")
    return spark.read.parquet(f"{FOLDER}/documents.parquet")
