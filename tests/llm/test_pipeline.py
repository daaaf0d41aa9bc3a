"""Every stage on rows that are hard, through the pipeline's own functions."""

import pytest
from cases import DOCS, HARD, crowded, frame

import corpus_pipeline

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
FILTERS = list(STAGES)[:-1]


@pytest.fixture(scope="module")
def real(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*DOCS.names).collect()]


def run(spark, name, docs):
    return STAGES[name](spark, docs, SF)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", list(STAGES))
def test_hard_rows_repeated_and_crowded(spark, real, name):
    """Null ids and texts, empty and very long texts, repeated rows, one id with two texts, clashing names."""
    docs = crowded(frame(spark, [*real, *HARD, *HARD, (2, "another text of id two", "en", "a", 5)]))
    got = run(spark, name, docs)
    if name in FILTERS:
        assert got.columns == docs.columns
        have = {(r["doc_id"], r["lang"], r["source"]) for r in docs.collect()}
        out = got.collect()
        assert out and len(out) <= docs.count() and {(r["doc_id"], r["lang"], r["source"]) for r in out} <= have
        assert all(r["rank"] == r["bucket"] == r["words"] == "x" for r in out)
    else:
        assert got.select("doc_id").where("doc_id is null").count() >= 2
        sums = got.groupBy("sequence_id").sum("length").collect()
        assert max(r[1] for r in sums) <= 1024


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, name):
    assert run(spark, name, frame(spark, [])).count() == 0


def test_repeated_rows_are_decided_alike(spark, real):
    twice = frame(spark, [*real, *real])
    for name in ("quality_classifier", "benchmark_decontamination"):
        once = rows_of(run(spark, name, frame(spark, real)))
        assert rows_of(run(spark, name, twice)) == sorted([*once, *once], key=str)
    lone = run(spark, "minhash_near_dedup", twice)
    assert rows_of(lone) == rows_of(run(spark, "minhash_near_dedup", frame(spark, real)))
    cut = run(spark, "substring_dedup", twice)
    assert {(r["doc_id"], r["text"]) for r in cut.collect()} == {(r["doc_id"], r["text"]) for r in run(spark, "substring_dedup", frame(spark, real)).collect()}


def test_without_labels_nothing_is_rejected(spark):
    """No document has a label: there is no vote, and scores are a half."""
    docs = frame(spark, [(10**9 + i, f"some words {i}", "en", "s", 1) for i in range(30)])
    assert run(spark, "quality_classifier", docs).count() == 30


def test_a_benchmark_passage_takes_its_document_and_no_other(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    own = " ".join(f"own{i}" for i in range(40))
    docs = frame(spark, [(1, own, "en", "s", 1), (2, own[:60] + " " + item + " " + own[60:90], "en", "s", 1), (3, None, "en", "s", 1)])
    assert [r["doc_id"] for r in run(spark, "benchmark_decontamination", docs).orderBy("doc_id").collect()] == [1, 3]
