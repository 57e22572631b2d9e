import re
from collections import Counter

import numpy as np
import pytest

from framelark.llm import quality_rules as rules
from framelark.llm import quality_score as scores

from .conftest import words

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = SPACE.findall(text)
    three = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts(odd_texts):
    extra = ["a b c a b c", "a a a a", "x\n\nx\n x\nx", "a b c d\na b c", "\r\nq\r\nq", "a\x0bb\x0cc", "ａ 漢字 #", "x y ".join(["".join("ab"[bin(i).count("1") & 1] for i in range(4096)) + " ", "".join("ba"[bin(i).count("1") & 1] for i in range(4096)) + " ", ""])]
    for text in [t for _, t in odd_texts] + extra:
        assert tuple(rules.measure(text)[0]) == brute(text)


def test_viterbi_is_best():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 8):
        e, step = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda y: sum(e[i, y[i]] for i in range(n)) + sum(step[y[i - 1], y[i]] for i in range(1, n))
        best = max(value([k >> i & 1 for i in range(n)]) for k in range(2**n))
        assert value(rules.viterbi(e, step)) == pytest.approx(best)


def labelled(spark, n=60):
    rows, marks = [], []
    for i in range(n):
        good = i % 3 > 0
        text = "\n".join(words(40, 10 * i + k).capitalize() + "." for k in range(4)) if good else "\n".join(" ".join(w + "%%%" for w in words(40, 10 * i + k).split()) for k in range(4))
        rows.append((i, text))
        marks.append((i, int(good)))
    marks += [(0, 0), (None, 1), (5, None), (99999, 1), (7, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")


def test_rules_learn(spark):
    docs, labels = labelled(spark)
    field = rules.fit(docs, labels)
    got = {r.doc_id: r for r in rules.apply(docs, field).collect()}
    assert all(got[i].kept == (i % 3 > 0) for i in got)
    assert rules.accept(docs, field).count() == sum(i % 3 > 0 for i in range(60))


def test_rules_learn_from_all_lines(spark, monkeypatch):
    long = "\n".join(words(6, k) for k in range(300))
    docs = spark.createDataFrame([(1, long), (2, words(80, 9))], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(rules, "train", lambda sequences, labels: seen.extend(zip(sequences, labels)) or rules.NO_FIELD)
    rules.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    got = np.concatenate([s for s, t in seen if t[0] == 1])
    assert sorted(map(tuple, got.tolist())) == sorted(map(tuple, rules.measure(long)[1].tolist())) and len(got) == 300


MENU = ["Home", "About us", "Contact", "Log in", "Shop | News | Help | Jobs", "Terms of use"]


def mixed(i, menu_first=True):
    menu, article = MENU + [f"Item {i}", f"More {i}"], [words(30, 100 * i + k).capitalize() + "." for k in range(5)]
    return menu + article if menu_first else article + menu, [0] * len(menu) + [1] * 5 if menu_first else [1] * 5 + [0] * len(menu)


def test_lines_get_labels_of_their_own(spark):
    """Menus above articles: both labels occur within documents, and the field's transitions say so."""
    good = [(i, "\n".join(mixed(i)[0])) for i in range(30)]
    bad = [(100 + i, "\n".join(MENU * 3 + [words(30, 9000 + i).capitalize() + "."])) for i in range(30)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    field = rules.fit(docs, spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad], "doc_id long, quality int"))
    for i in (500, 501, 502):
        for first in (True, False):
            lines, want = mixed(i, first)
            _, features, chars = rules.measure("\n".join(lines))
            assert rules.viterbi(field.emit[features].sum(axis=1), field.step).tolist() == want
            share = rules.content_share(features, chars, field)
            assert share == pytest.approx(sum(c for c, w in zip(chars, want) if w) / chars.sum())


def test_hidden_lines_of_bad_documents():
    """Decoded with the least bias that makes half of the characters boilerplate."""
    _, lines, chars = rules.measure("\n".join(words(20, k) for k in range(6)))
    half = np.array([True] * 4 + [False] * 2)
    assert rules.bad_labels(lines, chars, half, rules.NO_FIELD).tolist() == [0, 0, 0, 0, 1, 1]
    assert rules.bad_labels(lines, chars, np.zeros(6, dtype=bool), rules.NO_FIELD).tolist() == [0] * 6


def test_recurring_lines_but_not_copies():
    assert rules.recurring([[1, 2, 3, 9], [4, 5, 6, 9], [7, 8, 10, 9]]) == {9}
    assert rules.recurring([[1, 2, 3]] * 10) == set()


def test_sample_takes_every_id_once(spark):
    from framelark.llm.common import least_by_hash

    rows = spark.createDataFrame([(0, 1)] * 500 + [(i, 1) for i in range(1, 60)], "doc_id long, quality int")
    assert least_by_hash(rows, "quality", 40).count() == 40


def test_rules_odd(odd_docs, no_docs, odd_texts, spark):
    got = rules.apply(odd_docs, rules.NO_FIELD).collect()
    assert len(got) == len(odd_texts)
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.fit(odd_docs, empty) is rules.NO_FIELD
    assert rules.apply(no_docs, rules.fit(no_docs, empty)).count() == 0
    assert rules.accept(odd_docs, rules.NO_FIELD).columns == odd_docs.columns


def test_score_learns(spark):
    docs, labels = labelled(spark, 240)
    got = {r.doc_id: r for r in scores.classify(docs, labels).collect()}
    held = [i for i in got if got[i].held_out]
    assert held and np.mean([got[i].predicted == (i % 3 > 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_score_odd(odd_docs, no_docs, odd_texts, spark):
    labels = spark.createDataFrame([(1, 1), (8, 0), (8, 0), (17, 0), (None, 1), (11, 1)], "doc_id long, quality int")
    assert scores.classify(odd_docs, labels).count() == len(odd_texts)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in scores.classify(odd_docs, none).collect()} == {0.5}
    assert scores.classify(no_docs, labels).count() == 0


def test_pool_is_monotone():
    got = scores.pool(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 1, 1]))
    assert (np.diff(got) >= 0).all() and got[1] == pytest.approx(2 / 3)


def rates(counts, positives):
    """Isotonic rates by their definition, in quadratic time a place."""
    n = len(counts)
    mean = lambda i, j: sum(positives[i : j + 1]) / sum(counts[i : j + 1])
    return [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


def test_pool_against_its_definition():
    rng = np.random.default_rng(5)
    for n in range(1, 25):
        counts = rng.integers(1, 6, n)
        positives = rng.integers(0, counts + 1)
        assert scores.pool(counts, positives) == pytest.approx(rates(counts.tolist(), positives.tolist()))


def test_score_against_dense_solution(spark):
    """Weighted ridge by stacked least squares, isotonic rates by definition, one row at a time."""
    import zlib

    docs, labels = labelled(spark, 240)
    texts = {r.doc_id: r.text for r in docs.collect()}
    told = [(r.doc_id, float(r.quality)) for r in labels.collect() if r.quality in (0, 1) and r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    ids, y = [i for i, _ in told], np.array([q for _, q in told])
    assert len(set(ids)) < len(ids)  # each label of an id counts
    x = np.array([scores.statistics(texts[i]) for i in ids])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    weigh = np.where(y > 0.5, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    held = np.array([zlib.crc32(f"calibrate:{i}".encode()) % 4 == 0 for i in ids])
    lifted = scores.lift(x, mean, scale)
    own, w = lifted[~held], np.sqrt(weigh[~held] / weigh[~held].sum())
    size = own.shape[1]
    weight = np.linalg.lstsq(np.vstack([own * w[:, None], np.sqrt(scores.RIDGE) * np.eye(size)]), np.r_[y[~held] * w, np.zeros(size)], rcond=None)[0]
    step = (scores.HIGH - scores.LOW) / scores.BINS
    bins: dict = {}
    for raw, truth in zip(lifted[held] @ weight, y[held]):
        bins.setdefault(min(scores.BINS - 1, max(0, int((raw - scores.LOW) / step))), []).append(truth)
    knots = [scores.LOW + (b + 0.5) * step for b in sorted(bins)]
    told = rates([len(bins[b]) for b in sorted(bins)], [sum(bins[b]) for b in sorted(bins)])
    got = scores.classify(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = float(scores.lift(scores.statistics(texts[r.doc_id])[None], mean, scale)[0] @ weight)
        want = (1 - scores.RAW_SHARE) * np.interp(raw, knots, told) + scores.RAW_SHARE * min(1, max(0, (raw - scores.LOW) / (scores.HIGH - scores.LOW)))
        assert r.score == pytest.approx(want, abs=1e-6)


def test_rows_that_are_all_the_same(spark):
    docs = spark.createDataFrame([(1, words(80, 1))] * 40, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 3, "doc_id long, quality int")
    assert len({r.score for r in scores.classify(docs, labels).collect()}) == 1
    assert len({(r.n_words, r.kept) for r in rules.apply(docs, rules.fit(docs, labels)).collect()}) == 1
