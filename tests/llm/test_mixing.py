import re

import pytest

from framelark.llm import mixing

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Clamp and reshare until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    free = set(order)
    while free:
        rest, w = total - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / w >= most * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / w for s in free}
        target |= {s: float(most * sizes[s]) for s in over}
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 7}, {"a": 1}, {"a": 0, "b": 0}, {"a": 5, "b": 5, "c": 5, "d": 500}, {str(i): i * i for i in range(30)}])
def test_targets_match_resharing(spark, sizes):
    made = mixing.plan_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in made} == want
    assert all(r.target <= 3 * r.source_size + 1e-9 for r in made)


def test_words_taken(spark, odd_docs, odd_texts):
    made = mixing.mix(odd_docs).collect()
    assert len(made) == len(odd_texts)
    assert sorted(r["size"] for r in made) == sorted(len(SPACE.findall(t or "")) for _, t in odd_texts)
    assert all(r.taken <= 3 * r["size"] for r in made)
    told = {}
    for r in made:
        told.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in told.items():
        assert target - 2 <= sum(taken) <= target
    assert sorted(made, key=str) == sorted(mixing.mix(odd_docs.repartition(3)).collect(), key=str)


def test_empty(no_docs):
    assert mixing.mix(no_docs).count() == 0
    assert mixing.repeat(no_docs).count() == 0


def test_hot_source_and_repeat(spark):
    from .conftest import words

    docs = spark.createDataFrame([(i, words(5 + i % 40, i), "hot" if i % 3 else f"s{i % 7}") for i in range(600)], "doc_id long, text string, source string")
    made = mixing.mix(docs).collect()
    by = {}
    for r in made:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(v) - t) <= 1 for (_, t), v in by.items())
    repeated = mixing.repeat(docs)
    assert repeated.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in repeated.groupBy("doc_id").count().collect()}
    assert all(abs(counts.get(r.doc_id, 0) - r.copies) <= 1 for r in made)
