"""Group-relative and ordered operators: advantages, pairs, sessions, slices."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-4


def sample_std(c: Column, *keys: str) -> Column:
    """Sample deviation over groups; a group of one has 0."""
    w = Window.partitionBy(*keys)
    return F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0))


def weighted_reward(rewards: list[Column], weights: list[float]) -> Column:
    """Weighted sum; a reward without a verdict (null or NaN) adds nothing."""
    total = F.lit(0.0)
    for r, w in zip(rewards, weights):
        total = total + F.coalesce(F.nanvl(r, F.lit(None).cast("double")), F.lit(0.0)) * w
    return total


def with_statistics(df: DataFrame, group: str, columns: dict[str, Column], over_all: bool = False) -> DataFrame:
    """Aggregates joined back: pre-aggregated by group, so a large group is no large task."""
    stats = df.agg(*[c.alias(n) for n, c in columns.items()]) if over_all else df.groupBy(F.col(group).alias("_g")).agg(*[c.alias(n) for n, c in columns.items()])
    if over_all:
        return df.crossJoin(F.broadcast(stats))  # one row
    return df.join(stats, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def advantages(df: DataFrame, group: str, reward: str = "reward", estimator: str = "grpo", scale: str = "group", into: str = "advantage") -> DataFrame:
    """Group-relative advantages.

    ``grpo`` subtracts the group mean; ``rloo`` the mean of the others;
    ``reinforce_plus_plus`` is grpo scaled by the deviation of the advantages.
    ``scale`` is none, group or batch; a deviation of one row is 0, and divisors
    have 1e-4 added.
    """
    r, mean, k = F.col(reward), F.col("_mean"), F.col("_k")
    rows = with_statistics(df, group, {"_mean": F.avg(reward), "_k": F.count("*"), "_std": F.coalesce(F.stddev_samp(reward), F.lit(0.0))})
    plain = r - mean
    if estimator == "rloo":
        plain = F.when(k > 1, (r - mean) * k / (k - 1)).otherwise(plain)
    rows = rows.withColumn(into, plain)
    if scale == "none":
        return rows.drop("_mean", "_k", "_std")
    if estimator == "reinforce_plus_plus":
        rows = with_statistics(rows.drop("_std"), group, {"_std": F.coalesce(F.stddev_samp(into), F.lit(0.0))}, scale == "batch")
    elif scale == "batch":
        rows = with_statistics(rows.drop("_std"), group, {"_std": F.coalesce(F.stddev_samp(reward), F.lit(0.0))}, True)
    return rows.withColumn(into, F.col(into) / (F.col("_std") + EPS)).drop("_mean", "_k", "_std")


def last_per_request(df: DataFrame, request: str, order: str) -> DataFrame:
    """The last row of each request."""
    last = df.groupBy(F.col(request).alias("_r")).agg(F.max(order).alias("_o"))
    return df.join(last, (F.col(request) == F.col("_r")) & (F.col(order) == F.col("_o"))).drop("_r", "_o")


def request_advantages(df: DataFrame, prompt: str, request: str, order: str, reward: str = "reward", tolerance: float = 1e-6) -> DataFrame:
    """Advantages over requests, given to all their rows; rows of a request with different rewards are an error."""
    spread = df.groupBy(F.col(request).alias("_r")).agg((F.max(reward) - F.min(reward)).alias("_spread"))
    last = advantages(last_per_request(df, request, order), prompt, reward).select(F.col(request).alias("_r"), "advantage")
    rows = df.join(last, F.col(request) == F.col("_r")).drop("_r").join(spread, F.col(request) == F.col("_r")).drop("_r")
    checked = F.when(F.col("_spread") <= tolerance, F.col("advantage")).otherwise(F.raise_error(F.lit("rewards differ within a request")).cast("double"))
    return rows.withColumn("advantage", checked).drop("_spread")


def kl_in_reward(reward: Column, kl: Column, mask: Column, beta: float) -> Column:
    return reward - beta * F.aggregate(F.zip_with(kl, mask, lambda k, m: k * m), F.lit(0.0), lambda a, x: a + x)


def varied_groups(df: DataFrame, group: str, reward: str = "reward") -> DataFrame:
    """Rows of groups whose rewards differ."""
    stats = df.groupBy(group).agg(F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_std"))
    return df.join(stats.where("_std > 0").select(group), group, "left_semi")


def shift_answers(df: DataFrame, batch: str, order: str, answer: str, into: str = "rejected_response") -> DataFrame:
    """Each row takes the answer of the row before it in its batch; the first takes the last one's. Batches are of bounded size."""
    w = Window.partitionBy(batch).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.row_number().over(w) == 1
    return df.withColumn(into, F.when(first, F.last(answer).over(whole)).otherwise(F.lag(answer).over(w)))


def smoothing(values: Column, smooth: float = 0.9) -> Column:
    """Debiased exponential smoothing of an array."""
    state = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("n"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, v: Column) -> Column:
        x, n = s["x"] * smooth + v, s["n"] * smooth + 1
        return F.struct(x.alias("x"), n.alias("n"), F.concat(s["out"], F.array(x / n)).alias("out"))

    return F.aggregate(values, state, step)["out"]


def smoothed_series(df: DataFrame, key: str, value: str, *order: str, smooth: float = 0.9, block: int = 1024) -> DataFrame:
    """(key, i, v): debiased exponential smoothing of each key's whole series, counted from 1; values are not null.

    Rows go in blocks: a block's own weighted sum is a plain aggregate, one row
    for each block carries the state on, and blocks are smoothed side by side.
    """
    from millrace.operators.sampling import ranked

    rows = ranked(df.select(key, *order, F.col(value).cast("double").alias("v")), key, "_rank", *order)
    firsts = rows.groupBy(F.col(key).alias("_key")).agg(F.min("_rank").alias("_first"))
    rows = rows.join(firsts, F.col(key).eqNullSafe(F.col("_key"))).select(key, (F.col("_rank") - F.col("_first")).alias("i"), "v")
    rows = rows.withColumn("block", F.floor(F.col("i") / block).cast("long"))
    # only full blocks have one after them, so the weight counts from a full block's end
    sums = rows.groupBy(key, "block").agg(F.sum(F.col("v") * F.pow(F.lit(smooth), block - 1 - F.col("i") % block)).alias("x"))
    kind = df.schema[key].dataType.simpleString()

    def carried(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        x, before = 0.0, []
        for own in part["x"]:
            before.append(x)
            x = x * smooth**block + own
        return part.assign(x=before)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        x, out = part["x"].iloc[0], []
        for v, i in zip(part["v"], part["i"]):
            x = x * smooth + v
            out.append(x * (1 - smooth) / (1 - smooth ** (i + 1)))
        return part.assign(v=out, i=part["i"] + 1)[[key, "i", "v"]]

    states = sums.groupBy(key).applyInPandas(carried, f"`{key}` {kind}, block long, x double").withColumnsRenamed({key: "_key", "block": "_block"})
    rows = rows.join(states, F.col(key).eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block"))).select(key, "block", "i", "v", "x")
    return rows.groupBy(key, "block").applyInPandas(one, f"`{key}` {kind}, i long, v double")


def sessions(df: DataFrame, key: str, order: str, begins: Column, *tie: str) -> DataFrame:
    """A ``session`` number within each key: it goes up where a row begins a session; rows before the first are session 0.

    Begins are counted within range partitions of key and order; only a key that
    goes over a partition's end takes on counts from others, and there are no
    more such (key, partition) rows than twice the partitions. So a hot key is
    as many tasks as it has partitions.
    """
    from millrace.operators.sampling import placed

    rows, part, _ = placed(df.withColumn("__one", F.coalesce(begins.cast("long"), F.lit(0))), key, order, *tie)
    rows = rows.withColumn("__part", part)
    own = Window.partitionBy("__part", key).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("session", F.sum("__one").over(own))
    totals = rows.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__p")).agg(F.sum("__one").alias("__n"))
    by_key = Window.partitionBy("__key")
    before = by_key.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    more = totals.withColumn("__parts", F.count("*").over(by_key)).withColumn("__more", F.sum("__n").over(before))
    more = F.broadcast(more.where("__parts > 1 and __more > 0").select("__key", "__p", "__more"))
    out = counted.join(more, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p")), "left")
    return out.withColumn("session", F.col("session") + F.coalesce("__more", F.lit(0))).select(*df.columns, "session")


def last_value_of_trajectory(df: DataFrame, request: str, order: str, value: str, into: str) -> DataFrame:
    """The value of the last turn of a request, on all of its rows."""
    last = df.groupBy(F.col(request).alias("_r")).agg(F.max_by(value, order).alias(into))
    return df.join(last, F.col(request) == F.col("_r")).drop("_r")


def repeated(df: DataFrame, k: int, into: str = "generation") -> DataFrame:
    return df.withColumn(into, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def slice_of(ordinal: Column, total: int, n: int, contiguous: bool = True) -> Column:
    """Which of ``n`` slices a row is in: even boundaries, or every n-th row."""
    if not contiguous:
        return (ordinal % n).cast("int")
    out = F.lit(0)
    for k in range(1, n):
        out = out + (ordinal >= total * k // n).cast("int")
    return out


def prompt_ids(df: DataFrame, messages: str, order: str) -> DataFrame:
    """A dense ``prompt_id`` by first appearance of equal messages, and a ``request_id`` for each row."""
    from millrace.operators.sampling import ranked

    key = F.to_json(messages)
    firsts = df.groupBy(key.alias("_key")).agg(F.min(order).alias("_first"))
    ids = ranked(firsts, "_first", "prompt_id").drop("_first")
    return df.withColumn("_k", key).join(ids, F.col("_k") == F.col("_key")).drop("_k", "_key").withColumn("request_id", F.md5(F.col(order).cast("string")))
