import numpy as np
from cases import crowded, frame
from pyspark.sql import functions as F

from millrace.llm import quality as Q


def test_held_out_rows_are_judged_well(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.classify(docs, labels).join(labels, "doc_id").where(Q.held_out(F.col("doc_id"))).select("score", "quality").toPandas()
    good, bad = rows[rows.quality == 1].score.values, rows[rows.quality == 0].score.values
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert ((rows.score >= 0.5) == (rows.quality == 1)).mean() > 0.95


def test_held_out_labels_and_other_columns_do_not_count(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    moved = docs.withColumn("source", F.lit("x")).withColumn("lang", F.lit("y"))
    one = {r["doc_id"]: r["score"] for r in Q.classify(docs, labels).collect()}
    two = {r["doc_id"]: r["score"] for r in Q.classify(crowded(moved), turned).collect()}
    assert one == two and all(0 <= s <= 1 for s in one.values())


def test_votes_match_brute_force():
    rng = np.random.default_rng(1)
    texts = ["plain words in a row number %d here" % i for i in range(20)] + [f"$$$ ### {i} %%% ***" for i in range(20)]
    labels = np.array([1.0] * 20 + [0.0] * 20)
    idf = np.ones(Q.DIMS, np.float32)
    x = Q.weighted(Q.counts(texts), idf, 1.0)
    basis = Q.latent_basis(x, 8)
    model = Q.Model(idf, basis, Q.unit(x @ basis), labels, 0.5, Q.Setting(neighbours=5))
    probe = ["plain words again 5", "### $$$", "", None, *rng.choice(texts, 5).tolist()]
    for text, got in zip(probe, model.score(probe)):
        raw = Q.counts([text])
        v = Q.unit(Q.weighted(raw.copy(), idf, 1.0) @ basis)[0]
        near = sorted(((float(v @ r), y) for r, y in zip(model.vectors, labels)), reverse=True)[:5]
        total = sum(max(c, 0) for c, _ in near)
        assert abs(got - (sum(max(c, 0) * y for c, y in near) / total if raw.any() and total else 0.5)) < 1e-4


def test_basis_is_the_leading_one():
    x = np.random.default_rng(2).standard_normal((60, 30)).astype(np.float32) * np.linspace(5, 0.1, 30, dtype=np.float32)
    basis = Q.latent_basis(x, 5)
    _, s, _ = np.linalg.svd(x)
    assert np.allclose(np.linalg.norm(x @ basis), np.linalg.norm(s[:5]), rtol=1e-3)


def test_hard_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (5, 0), (99, 1), (None, 1)], "doc_id long, quality int")
    rows = Q.classify(crowded(frame(spark)), labels).select("doc_id", "text", "score").collect()
    assert len(rows) == frame(spark).count() and all(r["score"] is not None for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert {r["score"] for r in Q.classify(frame(spark), labels.limit(0)).collect()} == {0.5}
    assert Q.classify(frame(spark, []), labels).count() == 0
