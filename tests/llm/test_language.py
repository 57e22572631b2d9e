import random

import numpy as np

from framelark.llm import language
from framelark.llm.common import remainder

WORDS = {"xx": ["thing", "the", "and", "shing", "of"], "yy": ["été", "ôter", "que", "eaux", "ï"]}


def make(spark, n=120):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(WORDS[lang]) for _ in range(40)), lang) for i, lang in ((i, ("xx", "yy")[i % 2]) for i in range(n))]
    rows += [(n, None, "xx"), (n + 1, "", "yy"), (n + 2, "123 !!", "xx"), (n + 3, "the of " * 30, None), (None, "the and " * 9, "xx")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(language, "STEPS", 150)
    docs = make(spark)
    net = language.fit(docs, remainder(F.col("doc_id"), 3) != 1)
    assert net.languages == ("xx", "yy")
    got = {r.doc_id: r for r in language.identify(docs, net).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    sure = [i for i in range(120)]
    assert np.mean([got[i].lang_pred == truth[i] for i in sure]) > 0.97
    assert [(got[i].lang_pred, got[i].score) for i in (120, 121, 122)] == [("und", 0.0)] * 3
    assert got[123].lang_pred == "xx" and all(0 <= r.score <= 1 for r in got.values())
    kept = language.accept(docs, net)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_tables_equal_convolution(monkeypatch):
    monkeypatch.setattr(language, "STEPS", 3)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (40, language.WINDOW)).astype(np.uint8)
    net = language.train(x, np.arange(40) % 2, ("a", "b"))
    pooled = [np.max([[sum(o[j][row[p + j]] for j in range(len(o))) for p in range(language.WINDOW - len(o) + 1)] for row in x], axis=1) for o in net.offsets]
    hidden = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0)
    assert np.allclose(language.Predictor(net).probabilities(x), language._softmax(hidden @ net.weight + net.out), atol=1e-4)


def test_windows_cover_all():
    text = "a" * 1000
    cut = language.windows(text.encode())
    assert (cut > 0).sum() == 1000 and cut.shape[1] == language.WINDOW


def test_odd_and_empty(odd_docs, no_docs, odd_texts, monkeypatch):
    monkeypatch.setattr(language, "STEPS", 5)
    net = language.fit(odd_docs)
    assert language.identify(odd_docs, net).count() == len(odd_texts)
    none = language.fit(no_docs)
    assert none.languages == () and language.identify(no_docs, none).count() == 0
    assert {r.lang_pred for r in language.identify(odd_docs, none).collect()} == {"und"}
    assert language.accept(odd_docs, none).count() == len(odd_texts)
