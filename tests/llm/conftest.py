import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, taken string, size int"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def words(n, seed, vocabulary=400):
    import random

    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, white space, one word, long, ties and repeats."""
    long = words(60_000, 1)
    return [
        (1, BASE), (2, BASE), (3, BASE.upper() + "  "), (4, BASE + " twentyone"), (5, None), (6, ""), (7, " \t\n\r "), (8, "word"), (9, "word"), (10, "Word two"),
        (11, long), (12, long + " tail"), (13, "é" * 50 + "\n" + "ñ ß ü"), (None, BASE), (None, None), (14, words(90, 2)), (15, words(90, 2) + " x y"), (15, words(90, 2) + " x y"), (16, words(80, 3)), (16, words(80, 4)),
        (17, "\n".join(["same line here"] * 40)), (18, "## ** $$ %% && || <> " * 30), (19, " nbsp em \x1f unit"), (20, "12 34 !? ..."),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Those texts as documents, with two columns whose names clash with results."""
    rows = [(i, t, [None, "en", "fr"][k % 3], [None, "src0", "src0", "src1"][k % 4], len(t or ""), "clash", 5) for k, (i, t) in enumerate(odd_texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


PAGES = "page_id long, url string, html string, text string, verdict int"


@pytest.fixture(scope="session")
def odd_pages(spark):
    page = "<html><body><nav><a href=/x>menu</a></nav><article><h1>T</h1><p>Hello &amp; bye</p></article></body></html>"
    rows = [
        (1, "http://A.example.com/fr/1", page, "clash", 1), (2, "https://www.example.com/en/2?a=1&b=2", page, None, 1), (3, "http://x.example.com/en/3#top", None, None, 1), (4, None, "", None, 1),
        (5, "no scheme", page + " ", None, 1), (6, "ftp://h.net/es/", "<p>" + "long text " * 20000 + "</p>", None, 1), (7, "http://net/fr/x", page, None, 1), (None, "http://b.org/", page, None, 1), (2, "https://www.example.com/en/2?a=1&b=2", page, None, 1),
        (8, "http://xexample.com/en/\nq", "plain", None, None),
    ]
    return spark.createDataFrame(rows, PAGES)


@pytest.fixture(scope="session")
def no_pages(spark):
    return spark.createDataFrame([], PAGES)
