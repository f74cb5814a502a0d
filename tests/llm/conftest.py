import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double, token string, digest string"


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, ties, repeated rows, near copies."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 8))) for _ in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    out = []
    for i in range(60):
        t = "\n".join(text(r.randint(1, 12)) for _ in range(r.randint(1, 9)))
        out.append((i, t, r.choice(["en", "de", None]), r.choice(["a", "b", "c", "é", None]), len(t)))
    long = text(20_000)
    out += [
        (100, None, None, None, None), (101, "", "en", "a", 0), (102, " \n\t ", "en", "a", 4), (103, long, "en", "b", len(long)), (104, long + " end", "de", "b", None),
        (105, "1 2 3 -- 4", "en", "", 10), (None, out[3][1], "en", "a", 5), (None, None, None, None, None), out[4], out[4], (7, "another text of row seven", "en", "c", 3),
        (106, "x" * 5000, "en", "c", 5000), (107, "One word", None, "c", 8), (108, out[5][1], "en", "hot", 1), (109, out[5][1].upper(), "en", "hot", 1), (110, out[5][1] + "\n" + out[6][1], "en", "hot", 1),
    ]
    return [(*row, 1, 2, 0.5, "t", None) for row in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

