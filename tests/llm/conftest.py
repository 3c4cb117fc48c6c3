import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, size int, fp string, row string, h double, keep boolean"


def _rows():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    a, long = prose(80), prose(6000)
    texts = [a, a, a + " more", prose(60), "", None, "one", "two words", " \t\n ", long, long + " tail", "x" * 5000, "é ü 漢字 😀 " * 30, prose(70), prose(1)]
    docs = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 3 else f"s{i % 3}", None if t is None else len(t), "clash", i, None, "r", 0.5, None) for i, t in enumerate(texts)]
    # repeated rows, a null doc_id, one doc_id with two texts
    return docs + [docs[0], docs[0], docs[3], (None, prose(55), "en", "s1", 1, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), (3, prose(90), "en", "s0", 2, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd_rows():
    return _rows()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns."""
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


PAGES = "page_id long, url string, html string, text string, digest string, n int, payload string, response long"


@pytest.fixture(scope="session")
def odd_pages(spark):
    big = "<article><p>" + "long enough prose here. " * 60 + "</p></article>"
    rows = [(1, "u", big), (2, "u", big), (7, None, big), (7, "x y\nz", big), (None, "u", big), (3, "u", None), (4, None, ""), (5, "u", "<p>short"), (6, "u", "<p>short"), (8, "u", "no markup at all"), (None, None, "<nav>menu</nav>" + big + "x")]
    return spark.createDataFrame([(*r, "t", "d", 1, "p", 2) for r in rows], PAGES).repartition(2)


@pytest.fixture(scope="session")
def no_pages(spark):
    return spark.createDataFrame([], PAGES)
