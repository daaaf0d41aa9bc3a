"""Quality classifier: votes of the nearest labelled documents in a latent semantic space.

A document becomes log counts of hashed byte trigrams, weighted by inverse
document frequencies taken over all documents, and a few shape measures (marks,
repeats, word lengths) as soft bins. A truncated singular value decomposition of
the labelled sample gives the latent space. The labelled vectors are broadcast;
each block of documents takes exact cosine products with all of them, and the
``neighbours`` nearest vote with their similarities as weights.

Bounds: at most ``per_class`` labelled rows of each class are used, chosen by a
hash of their ids; so the broadcast is 2 * per_class vectors of ``rank`` numbers.
Only label rows that the caller passes as ``train`` are learned from; ids,
sources and languages are no inputs.

Defined results: null, empty and blank texts have no vector and score the share
of label 1 among the sample; so do all texts when there are no labels; null
labels are ignored; documents with equal texts score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import wordhash
from millrace.llm.runtime import prepare

TRIGRAMS = 4096
BINS = 12
MEASURES = 5
DIMS = TRIGRAMS + BINS * MEASURES


@dataclass(frozen=True)
class Setting:
    per_class: int = 2000
    rank: int = 64
    neighbours: int = 25
    shape_weight: float = 1.0


def counts(texts: list[str | None]) -> np.ndarray:
    """Trigram log counts and shape bins, a row for each text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    grid = np.arange(BINS)
    for first, _, run in wordhash.buffers(texts):
        found = wordhash.words(run, wordhash.WHITE)
        for i, data in enumerate(run):
            row = out[first + i]
            b = np.frombuffer(data, np.uint8)
            w = found.hashes[found.edges[i] : found.edges[i + 1]]
            if not len(w):
                continue
            if len(b) > 2:
                x = b.astype(np.uint32)
                h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(20)
                row[:TRIGRAMS] = np.log1p(np.bincount(h, minlength=TRIGRAMS))
            marks = wordhash.MARKS[b] & ~wordhash.WHITE[b]
            _, times = np.unique(w, return_counts=True)
            measures = (
                8 * marks.mean(),
                2 * (w[1:] == w[:-1]).mean() if len(w) > 1 else 0.0,
                4 * times.max() / len(w) if len(w) > 7 else 0.5,
                len(b) / len(w) / 12,
                4 * (marks[1:] & marks[:-1]).mean() if len(b) > 1 else 0.0,
            )
            for k, m in enumerate(measures):
                at = TRIGRAMS + k * BINS
                row[at : at + BINS] = np.maximum(0, 1 - np.abs(min(float(m), 1.0) * (BINS - 1) - grid))
    return out


def weighted(x: np.ndarray, idf: np.ndarray, shape_weight: float) -> np.ndarray:
    """Both blocks to unit length (times the weight), in place; empty rows stay zero."""
    x *= idf
    for block, weight in ((x[:, :TRIGRAMS], 1.0), (x[:, TRIGRAMS:], shape_weight)):
        norm = np.linalg.norm(block, axis=1, keepdims=True)
        block *= weight / np.where(norm > 0, norm, 1)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def latent_basis(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank].astype(np.float32)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each trigram bucket occurs; and their number."""
    prepare(docs.sparkSession)

    def tally(batches):
        total, n = np.zeros(TRIGRAMS, "i8"), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(at, 256).to_pylist()
                n += len(texts)
                for text in texts:
                    b = np.frombuffer((text or "").encode(), np.uint8)
                    if len(b) > 2:
                        x = b.astype(np.uint32)
                        h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(20)
                        total += np.bincount(h, minlength=TRIGRAMS) > 0
        yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(TRIGRAMS + 1), pa.int32()), "n": pa.array(np.append(total, n), pa.int64())})

    rows = docs.select(text_col).mapInArrow(tally, "dim int, n long").groupBy("dim").agg(F.sum("n")).collect()  # TRIGRAMS + 1 rows
    out = np.zeros(TRIGRAMS + 1, "i8")
    for dim, n in rows:
        out[dim] = n
    return out[:-1], int(out[-1])


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    setting: Setting

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        for at in range(0, len(texts) if len(self.labels) else 0, 128):
            raw = counts(texts[at : at + 128])
            some = raw.any(axis=1)
            x = unit(weighted(raw, self.idf, self.setting.shape_weight) @ self.basis)
            near = x @ self.vectors.T
            k = min(self.setting.neighbours, len(self.labels))
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            votes = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype("f8")
            total = votes.sum(axis=1)
            share = (votes * self.labels[top]).sum(axis=1) / np.where(total > 0, total, 1)
            out[at : at + 128] = np.where((total > 0) & some, share, self.prior)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, train: DataFrame, setting: Setting = Setting(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> Model:
    """``train`` has ``id_col`` and a 0/1 ``label_col``; frequencies come from all of ``docs``."""
    frequencies, n = document_frequencies(docs, text_col)
    idf = np.ones(DIMS, np.float32)
    idf[:TRIGRAMS] = np.log((1 + n) / (1 + frequencies)) + 0.1
    there = docs.select(F.col(id_col).alias("id")).distinct()
    known = train.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    known = known.join(there, "id", "left_semi")
    order = [F.xxhash64("id"), F.col("id")]
    sample = known.where("label = 0").orderBy(*order).limit(setting.per_class).union(known.where("label = 1").orderBy(*order).limit(setting.per_class))

    def features(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [r.astype(np.float16).tobytes() for r in counts(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], ["id", "label", "x"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # 2 * per_class rows at most
    rows = texts.select(F.col("id").cast("string").alias("id"), "label", "text").mapInArrow(features, "id string, label int, x binary")
    rows = rows.groupBy("id").agg(F.min("label").alias("label"), F.min("x").alias("x")).orderBy("id").collect()
    labels = np.array([r["label"] for r in rows], "f8")
    x = np.zeros((len(rows), DIMS), np.float32)
    for i in range(len(rows)):  # bytes go as their row is filled
        x[i], rows[i] = np.frombuffer(rows[i]["x"], np.float16), None
    x = weighted(x, idf, setting.shape_weight)
    basis = latent_basis(x, setting.rank) if len(rows) else np.zeros((DIMS, 1), np.float32)
    return Model(idf, basis, unit(x @ basis), labels, float(labels.mean()) if len(rows) else 0.5, setting)


def scorer(spark, model: Model):
    """A function from a text column to the column of scores."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # of bounded size, see the module

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts.to_pylist()), pa.float64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double").asNondeterministic()  # else Spark may run it again in a filter above


def held_out(key: Column) -> Column:
    """A third of all ids, by the checksum of their text; null ids are not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", setting: Setting = Setting(), id_col: str = "doc_id", text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score; learns from the labels whose ids are not held out."""
    train = labels.select(F.col(id_col), F.col(label).alias("label")).where(~held_out(F.col(id_col)))
    model = fit(docs, train, setting, id_col, text_col)
    return docs.withColumn(into, scorer(docs.sparkSession, model)(F.col(text_col)))
