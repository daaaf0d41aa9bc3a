"""The curation chain: filter, balance, threshold, merge, split; and the flagship plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.rewards import repetition
from millrace.operators import normalize, reshape, sampling, validate, windows
from millrace.sources.workers import written


def quality_filter(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with the first reason) under the quality cascade."""
    cols = (F.col(c) for c in ("answer_accuracy_score", "question_logic_score", "composite_score", "should_filter"))
    return validate.split_by_reason(df, validate.quality_rules(*cols))


def curate(df: DataFrame, category: str = "type", key: str = "id", least: int = 10, threshold: int = 7, large: int | None = None) -> DataFrame:
    """Quality filter, small categories out, the largest cut, both dependency scores high, a split by category (a share of each; ``large`` as in ``split_by_type``)."""
    kept, _ = quality_filter(df)
    common = sampling.drop_small(kept, category, least)
    even = sampling.balance_largest(common, category, "video_dependency_score", "audio_dependency_score", "composite_score", key)
    strong = even.where((F.col("video_dependency_score") >= threshold) | (F.col("audio_dependency_score") >= threshold))
    return sampling.split_by_type(strong, category, key, large=large)


def flagship(turns: DataFrame) -> DataFrame:
    """Turns to messages, single-turn rows, a repetition score of each answer, and advantages within conversations."""
    messages = normalize.conversations_to_messages(turns)
    rest = normalize.tool_messages(F.col("messages"))[1]  # without a leading system message
    rows = messages.select(F.col("conv_id").alias("conv"), F.col("conv_id").alias("id"), rest.alias("messages"))
    single = reshape.split_turns(rows)
    scored = single.select("conv", "id", F.col("messages")[0]["content"].alias("question"), repetition(F.col("messages")[1]["content"]).alias("reward"))
    scored = written(scored, "scored")  # the advantages join the rewards with their own statistics
    return windows.advantages(scored, "conv", scale="group").select("conv", "id", "question", F.round("reward", 6).alias("reward"), (F.round("advantage", 6) + 0.0).alias("advantage"))
