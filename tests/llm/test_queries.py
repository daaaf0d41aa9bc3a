"""The registered queries on the smallest tables, against plain versions where SQL has none."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_decontaminate import brute as contamination
from test_minhash import brute as near
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from millrace.llm import passages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return __spark_entry__.queries()[name](spark, SF).toPandas()


def test_every_operator_is_registered():
    names = [n.split("_")[0] for n in __spark_entry__.queries()]
    assert [n for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 14)] and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_token_files(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: np.array([*tok.encode(docs[k], add_special_tokens=False).ids, 1], "<u4") for k in sorted(docs)}
    got = run(spark, "op2_token_files").set_index("doc_id")
    start = 0
    for k, v in ids.items():
        assert tuple(got.loc[k, ["start", "n_tokens", "ids_crc32"]]) == (start, len(v), zlib.crc32(v.tobytes()))
        start += len(v)
    assert len(got) == len(docs)


def test_sharding(spark, docs):
    got = run(spark, "op3_sharding")
    assert sorted(got.doc_id) == sorted(docs) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    assert all((r.size, r.text_crc32) == (len(docs[r.doc_id].encode()) + 1, zlib.crc32(docs[r.doc_id].encode())) for r in got.rename(columns={"size": "size_"}).itertuples() for r in [type("R", (), {"size": r.size_, "doc_id": r.doc_id, "text_crc32": r.text_crc32})])
    loads = got.groupby("shard")["size"].sum()
    assert len(loads) == 16 and loads.max() - loads.min() < 0.05 * loads.mean() + 200
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))


def test_packing(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = run(spark, "op4_packing")
    total = 0
    for k, rows in got.groupby("doc_id"):
        ids = np.array([*tok.encode(docs[k], add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        rows = rows.sort_values("piece")
        assert rows.start.tolist() == [0, *np.cumsum(rows.length)[:-1]] and rows.length.sum() == len(ids) and (rows.length[1:] == 1024).all()
        assert rows.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(rows.start, rows.length)]
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1]] and rows.length.sum() <= 1024
    assert got.sequence_id.nunique() <= 1.02 * total / 1024 + 2


def test_passages(spark, docs):
    """Places are word places; the first stretch of a cluster stays, and the words that go are in earlier documents."""
    got = run(spark, "op5_passages")
    words = {k: t.lower().split() for k, t in docs.items()}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    assert (got.n_words >= passages.Setting().least).all() and (got.groupby("cluster_id").doc_id.nunique() > 1).all()
    for _, rows in got.groupby("cluster_id"):
        rows = sorted(rows.itertuples(), key=lambda r: (r.doc_id, r.first_word))
        assert not rows[0].removed and {(r.kept_doc_id, r.kept_first_word, r.copies) for r in rows} == {(rows[0].doc_id, rows[0].first_word, len(rows))}
        for r in rows:
            if r.removed:
                own = grams(words[r.doc_id][r.first_word : r.first_word + r.n_words])
                earlier = set().union(*[grams(words[o.doc_id][o.first_word : o.first_word + o.n_words]) for o in rows if o.doc_id < r.doc_id])
                assert 100 * len(own & earlier) >= 75 * len(own)


def test_quality(spark, docs):
    got = run(spark, "op7_quality")
    assert sorted(got.doc_id) == sorted(docs) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(k).encode()) % 3 == 1 for k in got.doc_id]).all() and (got.predicted == (got.score >= 0.5)).all()


def test_media(spark, docs):
    got = run(spark, "op10_media").set_index("doc_id")
    for k, t in docs.items():
        data = t.encode().ljust(max(192, -(-len(t.encode()) // 192) * 192))
        assert tuple(got.loc[k, ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]]) == (len(t.encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))


def test_pipeline_stage_by_stage(spark):
    """Each stage on what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, SF)
    scored = {r["doc_id"]: r["predicted"] for r in __spark_entry__.queries()["op7_quality"](spark, SF).collect()}
    good = spark.createDataFrame(good.collect(), docs.schema)
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == {k for k, p in scored.items() if p}
    lone = stages["minhash_near_dedup"](spark, good, SF)
    lone = spark.createDataFrame(lone.collect(), docs.schema)
    assert sorted(r["doc_id"] for r in lone.collect()) == sorted(i for i, _, c in near([(r["doc_id"], r["text"]) for r in good.collect()]) if i == c)
    cut = stages["substring_dedup"](spark, lone, SF)
    before, after = ({r["doc_id"]: r for r in d.collect()} for d in (lone, cut))
    gone = {}
    for r in passages.clusters(lone).where("removed").collect():
        gone.setdefault(r["doc"], set()).update(range(r["first_word"], r["first_word"] + r["n_words"]))
    assert cut.columns == columns and set(before) == set(after)
    for k, r in before.items():
        assert after[k]["text"].split() == [w for i, w in enumerate(r["text"].split()) if i not in gone.get(k, ())] and after[k]["n_chars"] == len(after[k]["text"])
    cut = spark.createDataFrame([after[k] for k in after], docs.schema)
    clean = stages["benchmark_decontamination"](spark, cut, SF)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r["doc_id"] for r in clean.collect()}
    for k, r in list(after.items())[:60]:
        if len(r["text"]) < 8000:
            assert (k in kept) == (not contamination(r["text"], items)[4])
    packed = stages["best_fit_packing"](spark, clean, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_repeated_rows_leave_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    twice = docs.union(docs).union(spark.createDataFrame([(900, None, "en", "s", 0), (900, None, "en", "s", 0)], docs.schema))
    kept = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, twice, SF).groupBy("doc_id").count().collect()
    assert all(r["count"] == (2 if r["doc_id"] == 900 else 1) for r in kept)
