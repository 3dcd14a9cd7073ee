import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, n string"


def make_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünïcode", "$#|", "<a>"]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    line = "This line of boilerplate is Shared by many documents"
    base = [prose(120) for _ in range(8)]
    texts = [None, "", " \n\t ", "one", "two words", "A b", "a B", "\n", "x" * 5000, prose(6000), (prose(12) + "\n") * 9]
    for b in base:
        words = b.split()
        texts += [b, b.upper(), " ".join([*words[:-1], "changed"]), prose(30) + " " + " ".join(words[20:80]) + " " + prose(20)]
    texts += [f"{prose(15)}\n  {line if i % 2 else line.lower()}\t\n{prose(9)}" for i in range(7)]
    texts += [base[0]] * 6 + ["same short text"] * 4
    return [(i, t, "en", None if i % 9 == 0 else f"s{min(i % 7, 3)}", 0, 1, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Null and repeated keys, repeated rows."""
    return spark.createDataFrame([(None, *rows[20][1:]), (None, *rows[20][1:]), (None, None, None, None, None, None, None), rows[30], rows[30], rows[31]], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
