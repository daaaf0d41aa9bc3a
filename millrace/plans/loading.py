"""Source strings to train and validation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.reshape import interleave, union_all
from millrace.operators.sampling import ranked, shuffled, split_train_val
from millrace.sources.registry import load_one


def keyed(df: DataFrame) -> DataFrame:
    """A number for each row by the hash of its values, so that splits do not depend on partitions."""
    whole = F.xxhash64(F.to_json(F.struct(*df.columns)))
    return ranked(df.withColumn("_h", whole), "_h", "_row").drop("_h")


def load_dataset(
    spark: SparkSession, sources: list[str], ratio: float = 0.0, seed: int = 42, weights: list[float] | None = None, stop: str = "first_exhausted", shuffle: bool = False, base: str = ""
) -> tuple[DataFrame | None, DataFrame | None]:
    """(train, val): each source loaded and split, then concatenated, or interleaved by weights."""
    parts = []
    for s in sources:
        df = keyed(load_one(spark, s, base))
        parts.append(split_train_val(df, "_row", ratio, seed))
    out = []
    for frames in zip(*parts):
        frames = list(frames)
        joined = interleave(frames, weights, "_row", seed, stop).drop("source", "position") if weights and all(not f.isEmpty() for f in frames) else union_all(*frames)
        joined = shuffled(joined, "_row", seed) if shuffle else joined
        out.append(joined.drop("_row"))
    return tuple(out)
