import pytest

import corpus_pipeline
from framelark.llm import bpe, language, queries


@pytest.fixture
def small(spark, tmp_path, monkeypatch):
    from .conftest import words

    monkeypatch.setattr(language, "STEPS", 60)
    good = [(i, words(80, i), "en", f"s{i % 3}") for i in range(30)]
    rows = good + [(100, good[0][1] + " extra", "en", "s0"), (101, good[1][1], "en", "s1"), (102, "too short", "en", "s0"), (103, None, "en", None), (104, "12 34 " * 60, "en", "s1"), (105, "%% ##a " * 80, "en", "s2")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(20)] + [(105, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows


def test_stages_against_brute_force(spark, small):
    sf_dir, rows = small
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality_rules", "near_dedup", "mixing", "bpe"]
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == before
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(sorted(r.doc_id for r in docs.collect()))
    assert seen[0] == sorted(i for i, *_ in rows if i not in (103, 104))
    assert seen[1] == [*range(30), 100, 101]
    assert seen[2] == list(range(30))
    assert set(seen[3]) <= set(seen[2])
    text = {r[0]: r[1] for r in rows}
    total, taken = sum(80 for _ in seen[2]), sum(80 for _ in seen[3])
    assert abs(total - taken) <= 3 * 80
    mine = bpe.WordBpe(bpe.vocabulary_path())
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == sorted((i, *mine.digest(text[i])[:2]) for i in seen[3])


def test_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == 0
