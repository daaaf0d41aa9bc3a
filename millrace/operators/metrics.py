"""Aggregations: reports, statistics, ranking, similarity and off-policy metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOUND = 20.0


def histogram(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n")).orderBy(F.desc("n"), category)


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows for each reason (null is ``kept``) with its share of all, in percent."""
    counts = df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("_total")))).select("reason", "n", F.try_divide(F.col("n") * 100.0, "_total").alias("percent"))


def duplicate_ids(df: DataFrame, key: str, line: str, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """(summary, ids that occur most): a missing id counts as one of its own; ties by first appearance."""
    named = df.select(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("no_id_line_"), F.col(line))).alias("id"), F.col(line).alias("line"))
    counts = named.groupBy("id").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    summary = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), (F.sum("n") - F.count("*")).alias("surplus"), F.count_if(F.col("n") > 1).alias("repeated"))
    return summary, counts.where("n > 1").orderBy(F.desc("n"), "first").limit(top)


def length_statistics(df: DataFrame, length: Column, *by: str) -> DataFrame:
    """Mean, population deviation, least, most and number; arrays of lengths are summed first."""
    rows = df.select(*by, length.alias("_l"))
    if dict(rows.dtypes)["_l"].startswith("array"):
        rows = rows.withColumn("_l", F.aggregate("_l", F.lit(0).cast("long"), lambda a, x: a + x))
    aggs = [F.avg("_l").alias("mean"), F.stddev_pop("_l").alias("std"), F.min("_l").alias("min"), F.max("_l").alias("max"), F.count("_l").alias("size")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def dataset_report(df: DataFrame, length: Column, key: str, most: int = 100_000) -> DataFrame:
    """Length statistics over at most ``most`` rows, chosen by a hash of the key."""
    from millrace.operators.sampling import draw

    return length_statistics(df.orderBy(draw(F.col(key)), key).limit(most), length)


def mean_or(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.avg(c), F.lit(default))


def throughput(df: DataFrame, request: str, order: str, tokens: str, runtime: Column) -> DataFrame:
    """Samples and tokens a second, the last row of a request counting."""
    last = df.groupBy(request).agg(F.max_by(tokens, order).alias("_t"), F.max_by(runtime, order).alias("_s"))
    total = last.agg(F.count("*").alias("num_samples"), F.sum("_t").alias("num_tokens"), F.max("_s").alias("runtime"))
    return total.select("*", F.try_divide("num_samples", "runtime").alias("samples_per_s"), F.try_divide("num_tokens", "runtime").alias("tokens_per_s"))


def exact_match(df: DataFrame, prediction: Column, label: Column) -> DataFrame:
    return df.agg(F.avg(F.coalesce((prediction == label).cast("double"), F.lit(0.0))).alias("acc"))


def masked_hits(predictions: Column, labels: Column, ignore: int = -100) -> Column:
    """Per token: right, wrong, or null for ignored; labels are one token ahead of predictions."""
    n = F.size(labels) - 1
    return F.zip_with(F.slice(predictions, 1, F.greatest(n, F.lit(0))), F.slice(labels, 2, F.greatest(n, F.lit(0))), lambda p, t: F.when(t != ignore, p == t))


def token_accuracy(df: DataFrame, predictions: Column, labels: Column) -> DataFrame:
    """Accuracy over tokens and over whole sequences."""
    hits = F.filter(masked_hits(predictions, labels), lambda h: h.isNotNull())
    rows = df.select(F.size(F.filter(hits, lambda h: h)).alias("r"), F.size(hits).alias("n"), F.forall(hits, lambda h: h).alias("whole"))
    return rows.agg(F.try_divide(F.sum("r").cast("double"), F.sum("n")).alias("token_acc"), F.avg(F.col("whole").cast("double")).alias("seq_acc"))


def _lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a whole row of the table at a time in the bits of an integer."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hits = row & places.get(y, 0)
        row = (row + hits | row - hits) & full
    return len(a) - row.bit_count()


def text_overlap(prediction: Column, label: Column, digits: int = 6) -> Column:
    """(rouge-1, rouge-2, rouge-l, bleu-4) over words between white space, times 100; texts that share no word have 0."""
    import math
    from collections import Counter

    def grams(w, n):
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    def f1(hits, a, b):
        return 2 * hits / (a + b) if a + b else 0.0

    def bleu(h, r, hit):
        if not hit[0]:
            return 0.0
        logs, k = 0.0, 0
        for n in range(1, 5):
            hits, total = hit[n - 1], max(len(h) - n + 1, 1)
            if not hits:
                k += 1
                hits = 1 / 2**k
            logs += math.log(hits / total) / 4
        return math.exp(logs + (0.0 if len(h) > len(r) else 1 - len(r) / len(h)))

    def one(p, t):
        h, r = (p or "").split(), (t or "").split()
        hit = [sum((grams(h, n) & grams(r, n)).values()) for n in range(1, 5)]
        rouge = [f1(hit[n - 1], max(len(h) - n + 1, 0), max(len(r) - n + 1, 0)) for n in (1, 2)]
        return [round(100 * x, digits) for x in (*rouge, f1(_lcs(h, r), len(h), len(r)), bleu(h, r, hit))]

    @F.pandas_udf("array<double>")
    def run(p: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(p, t)])

    return run(prediction, label)


OVERLAPS = ("rouge_1", "rouge_2", "rouge_l", "bleu_4")


def corpus_overlap(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """One row: the means of ``text_overlap`` over rows with words on both sides, and ``n``, their number; 0 where there are none.

    Both columns are arrays of words, as ``segment.segmented`` gives them; null and empty ones are left out.
    """
    both = df.where((F.size(prediction) > 0) & (F.size(label) > 0))
    scores = both.select(text_overlap(F.array_join(prediction, " "), F.array_join(label, " "), 15).alias("v"))
    return scores.agg(*[F.round(mean_or(F.col("v")[i]), 6).alias(name) for i, name in enumerate(OVERLAPS)], F.count("*").alias("n"))


def reward_report(df: DataFrame, group: str, reward: str, functions: list[str], batch_std: bool = False) -> DataFrame:
    """Mean of group means and deviations, share of groups without variance, mean and deviation of each function."""
    groups = df.groupBy(group).agg(F.avg(reward).alias("_m"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_s"))
    one = groups.agg(F.avg("_m").alias("reward"), F.avg("_s").alias("reward_std"), F.avg((F.col("_s") < 1e-12).cast("double")).alias("frac_zero_std"))
    if batch_std:
        one = one.drop("reward_std").crossJoin(df.agg(F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("reward_std")))  # one row each
    each = df.agg(*[a for f in functions for a in (F.avg(f).alias(f"{f}_mean"), F.coalesce(F.stddev_samp(f), F.lit(0.0)).alias(f"{f}_std"))])
    return one.crossJoin(each)


def weighted_metrics(df: DataFrame, weight: str, means: list[str], least: list[str] = (), most: list[str] = ()) -> DataFrame:
    """Chunk metrics merged: means weighted by tokens, extremes by extremes."""
    aggs = [F.try_divide(F.sum(F.col(m) * F.col(weight)), F.sum(F.when(F.col(m).isNotNull(), F.col(weight)))).alias(m) for m in means]
    return df.agg(*aggs, *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most])


def channel_loss(df: DataFrame, channel: str, losses: str, mask: str) -> DataFrame:
    tokens = df.select(channel, F.explode(F.arrays_zip(F.col(losses).alias("l"), F.col(mask).alias("m"))).alias("t")).where(F.col("t.m") == 1)
    return tokens.groupBy(channel).agg(F.avg("t.l").alias("loss"), F.count("*").alias("tokens"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def pair_scores(a: Column, b: Column) -> dict[str, Column]:
    """cosine, manhattan, euclidean (negative distances) and dot."""
    norm = lambda v: F.sqrt(dot(v, v))
    minus = F.zip_with(a, b, lambda x, y: x.cast("double") - y)
    return {
        "cosine": dot(a, b) / (norm(a) * norm(b)),
        "manhattan": -F.aggregate(minus, F.lit(0.0), lambda s, x: s + F.abs(x)),
        "euclidean": -F.sqrt(dot(minus, minus)),
        "dot": dot(a, b),
    }


def average_ranks(df: DataFrame, by: str, value: str, into: str) -> DataFrame:
    """Ranks from 1 within each ``by`` with ties sharing their mean, from counts of distinct values.

    The values are numbered once over all of ``by``; running counts are added up
    in sections of 100,000 values, so no task holds all values of one ``by``.
    """
    from millrace.operators.sampling import ranked

    counts = df.groupBy(F.col(by).alias("_b"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    parts = ranked(counts, "_b", "_r", "_v").withColumn("_p", F.floor(F.col("_r") / 100_000))
    before = Window.orderBy("_p", "_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_p", "_b").agg(F.sum("_c").alias("_sum")).withColumn("_all", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    first = Window.partitionBy("_b")
    bases = sums.select("_p", "_b", (F.col("_all") - F.min("_all").over(first)).alias("_base"))  # a row for every 100,000 values
    upto = F.sum("_c").over(Window.partitionBy("_p", "_b").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    ranks = parts.withColumn("_upto", upto).join(bases, ["_p", "_b"])
    ranks = ranks.select("_b", "_v", (F.col("_base") + F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(into))
    return df.join(ranks, (F.col(by) == F.col("_b")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_b", "_v")


def paired_similarity(df: DataFrame, key: str, a: str, b: str, label: str) -> DataFrame:
    """Pearson and Spearman correlation of labels with four similarities, in one row."""
    scores = pair_scores(F.col(a), F.col(b))
    named = [F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in {"y": F.col(label), **scores}.items()]
    long_ = average_ranks(df.select(key, F.inline(F.array(*named))), "name", "value", "rank")
    wide = long_.groupBy(key).agg(*[F.max(F.when(F.col("name") == n, F.col(c))).alias(f"{n}_{c}") for n in ("y", *scores) for c in ("value", "rank")])
    return wide.agg(*[F.corr(f"y_{c}", f"{n}_{c}").alias(f"{p}_{n}") for p, c in (("pearson", "value"), ("spearman", "rank")) for n in scores])


def retrieval_margin(df: DataFrame, query: str, batch: str, similarity: str, positive: str) -> DataFrame:
    """Means of positive and negative similarities, and of positive minus the query's best negative.

    Takes scored (query, candidate) rows, so in-batch or own negatives are up to the caller.
    """
    per = df.groupBy(batch, query).agg(F.max(F.when(F.col(positive), F.col(similarity))).alias("p"), F.max(F.when(~F.col(positive), F.col(similarity))).alias("n"))
    margin = per.agg(F.avg(F.col("p") - F.col("n")).alias("margin"))
    means = df.agg(F.avg(F.when(F.col(positive), F.col(similarity))).alias("mean_pos"), F.avg(F.when(~F.col(positive), F.col(similarity))).alias("mean_neg"))
    return margin.crossJoin(means)  # one row each


def query_groups(df: DataFrame, part: str, order: str, label: str) -> DataFrame:
    """Numbers the queries of a part: each begins at a positive; rows before the first are left out."""
    from millrace.operators.windows import sessions

    return sessions(df, part, order, F.col(label) == 1).where("session > 0")


def ranking_metrics(df: DataFrame, keys: list[str], order: str, score: str, label: str) -> DataFrame:
    """MRR and NDCG over queries of two rows or more, ties by order; 0 where there are none."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_rank", F.row_number().over(w.orderBy(F.desc(score), order))).withColumn("_ideal", F.row_number().over(w.orderBy(F.desc(label), order)))
    gain = lambda r: (F.pow(F.lit(2.0), F.col(label)) - 1) / F.log2(F.col(r) + 1)
    first = F.min(F.when(F.col(label) == 1, F.col("_rank")))
    per = rows.groupBy(*keys).agg(F.count("*").alias("n"), (1 / first).alias("mrr"), F.try_divide(F.sum(gain("_rank")), F.sum(gain("_ideal"))).alias("ndcg"))
    return per.where("n >= 2").agg(mean_or(F.col("mrr")).alias("mrr"), mean_or(F.col("ndcg")).alias("ndcg"))


def preference_bounds(df: DataFrame, label: str, desirable: float = 1.0, undesirable: float = 1.0) -> DataFrame:
    """Bounds for the weights of desirable and undesirable examples from their numbers, rounded half to even."""
    counts = df.agg(F.greatest(F.sum(F.col(label).cast("int")), F.lit(1)).alias("d"), F.count("*").alias("t"))
    counts = counts.withColumn("u", F.greatest(F.col("t") - F.col("d"), F.lit(1)))
    up, down = F.col("u") * undesirable / F.col("d"), F.col("d") * desirable / F.col("u")
    return counts.select("d", "u", F.bround(up, 2).alias("des_low"), F.bround(up * 1.33, 2).alias("des_high"), F.bround(down / 1.33, 2).alias("und_low"), F.bround(down, 2).alias("und_high"))


def normalised_scores(df: DataFrame, group: str, score: str, threshold: float | None = None) -> DataFrame:
    """Scores of a group from 0 to 1 (a constant group keeps at most 1, or 0), and whether they are above the threshold."""
    from millrace.operators.windows import with_statistics

    rows = with_statistics(df, group, {"_lo": F.min(score), "_hi": F.max(score)})
    flat = F.when(F.col("_lo") == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.col("_lo")))
    value = F.when(F.col("_lo") == F.col("_hi"), flat).otherwise((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-5))
    mask = F.lit(True) if threshold is None else F.col(score) > threshold
    return rows.withColumns({"normalised": value, "mask": mask}).drop("_lo", "_hi")


def best_experiments(df: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """A flag for each metric on the experiments that have its best value (True: higher is better), within 1e-9."""
    best = df.agg(*[(F.max(m) if high else F.min(m)).alias(f"_{m}") for m, high in metrics.items()])
    rows = df.crossJoin(F.broadcast(best))  # one row
    return rows.withColumns({f"{m}_best": F.abs(F.col(m) - F.col(f"_{m}")) <= 1e-9 * F.greatest(F.abs(m), F.abs(f"_{m}")) for m in metrics}).drop(*[f"_{m}" for m in metrics])


def judge_average(verdicts: Column) -> Column:
    """Mean of 1/0 verdicts, nulls left out; null for none."""
    known = F.filter(verdicts, lambda v: v.isNotNull())
    return F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(known), F.lit(0))


def caption_mean(scores: Column) -> Column:
    return F.coalesce(F.aggregate(scores, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(scores), F.lit(0)), F.lit(0.0))


def split_summary(df: DataFrame, kind: str, split: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count_if(F.col(split) == "train").alias("train"), F.count_if(F.col(split) == "test").alias("test"), F.count("*").alias("total"))


def outcome_counts(df: DataFrame, outcome: str) -> DataFrame:
    kinds = ("Success", "Skipped", "Failures", "Errors", "UnexpectedSuccesses", "ExpectedFailures")
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(outcome) == k).alias(k.lower()) for k in kinds])


def _clamped(log_ratio: Column) -> Column:
    return F.transform(log_ratio, lambda x: F.greatest(F.least(x, F.lit(BOUND)), F.lit(-BOUND)))


def _masked(values: Column, mask: Column) -> Column:
    return F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda a, x: a + x)


def _count(mask: Column) -> Column:
    return F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1.0))


def sequence_ratio(log_ratio: Column, mask: Column) -> Column:
    return F.exp(_masked(_clamped(log_ratio), mask) / _count(mask))


def importance_weights(log_ratio: Column, mask: Column, mode: str, threshold: float) -> Column:
    """Weights of tokens: truncated or masked, by token or by the geometric mean of the sequence."""
    ratio = F.transform(_clamped(log_ratio), lambda x: F.exp(x))
    whole = sequence_ratio(log_ratio, mask)
    if mode == "token_truncate":
        return F.transform(ratio, lambda r: F.least(r, F.lit(threshold)))
    if mode == "token_mask":
        return F.transform(ratio, lambda r: F.when(r <= threshold, r).otherwise(F.lit(0.0)))
    if mode == "sequence_truncate":
        return F.transform(ratio, lambda r: F.least(whole, F.lit(threshold)))
    if mode == "sequence_mask":
        return F.transform(ratio, lambda r: r * F.when(whole <= threshold, F.lit(1.0)).otherwise(F.lit(0.0)))
    return ratio


def off_policy_metrics(df: DataFrame, new: str, old: str, mask: str) -> DataFrame:
    """Divergences and perplexities of a policy against the one that made the rollouts, in one row."""
    n = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m)
    ratio = F.zip_with(F.zip_with(new, old, lambda p, o: p - o), mask, lambda d, m: d * m)
    rows = df.select(
        n.alias("n"),
        _masked(ratio, F.col(mask)).alias("kl"),
        _masked(F.transform(ratio, lambda r: F.exp(r) - r - 1), F.col(mask)).alias("k3"),
        _masked(F.transform(_clamped(ratio), lambda r: F.exp(r * 2)), F.col(mask)).alias("square"),
        (_masked(F.col(new), F.col(mask)) / _count(F.col(mask))).alias("mine"),
        (_masked(F.col(old), F.col(mask)) / _count(F.col(mask))).alias("theirs"),
    )
    rows = rows.withColumn("diff", F.col("theirs") - F.col("mine"))
    tokens = F.greatest(F.sum("n"), F.lit(1.0))
    bounded = F.greatest(F.least(-F.col("diff"), F.lit(BOUND)), F.lit(-BOUND))
    return rows.agg(
        F.avg(F.exp(-F.col("mine"))).alias("training_ppl"), F.avg(-F.col("mine")).alias("training_log_ppl"), (F.sum("kl") / tokens).alias("kl"), (F.sum("k3") / tokens).alias("k3_kl"),
        F.avg(F.exp(-F.col("theirs"))).alias("rollout_ppl"), F.avg(-F.col("theirs")).alias("rollout_log_ppl"), F.avg("diff").alias("log_ppl_diff"), F.avg(F.abs("diff")).alias("log_ppl_abs_diff"),
        F.max("diff").alias("log_ppl_diff_max"), F.min("diff").alias("log_ppl_diff_min"), F.avg(F.exp("diff")).alias("ppl_ratio"), (F.sum("square") / tokens - 1).alias("chi2_token"), (F.avg(F.exp(bounded * 2)) - 1).alias("chi2_seq"),
    )


def correction_metrics(df: DataFrame, log_ratio: str, mask: str, mode: str, threshold: float) -> DataFrame:
    """Mean weight, effective sample size and clipped share of an importance correction, in one row."""
    weights = importance_weights(F.col(log_ratio), F.col(mask), mode, threshold)
    bounded = F.transform(weights, lambda w: F.greatest(F.least(w, F.lit(threshold)), F.lit(1 / threshold)))
    ratio = F.transform(_clamped(F.col(log_ratio)), lambda x: F.exp(x))
    hit = {
        "token_truncate": _masked(F.transform(ratio, lambda r: (r > threshold).cast("double")), F.col(mask)),
        "token_mask": _masked(F.transform(weights, lambda w: (w == 0).cast("double")), F.col(mask)),
    }.get(mode, (sequence_ratio(F.col(log_ratio), F.col(mask)) > threshold).cast("double"))
    rows = df.select(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m).alias("n"), _masked(weights, F.col(mask)).alias("w"), _masked(bounded, F.col(mask)).alias("b"), _masked(F.transform(bounded, lambda b: b * b), F.col(mask)).alias("b2"), hit.alias("hit"))
    tokens = F.greatest(F.sum("n"), F.lit(1.0))
    share = F.sum("hit") / tokens if mode.startswith("token") else F.avg("hit")
    sums = rows.agg(tokens.alias("t"), F.sum("w").alias("w"), F.sum("b").alias("b"), F.sum("b2").alias("b2"), share.alias("clipped_frac"))
    mean = F.col("b") / F.col("t") + 1e-8
    return sums.select((F.col("w") / F.col("t")).alias("is_weight_mean"), (1 / F.greatest(F.col("b2") / F.col("t") / (mean * mean), F.lit(1e-10))).alias("ess"), "clipped_frac")


def entropy_cut(df: DataFrame, entropies: str, mask: str, top: float) -> DataFrame:
    """Rows with a ``keep`` array: tokens whose entropy is at or above the (1 - top) quantile of all masked tokens."""
    tokens = df.select(F.explode(F.arrays_zip(F.col(entropies).alias("e"), F.col(mask).alias("m"))).alias("t")).where(F.col("t.m") == 1)
    cut = tokens.agg(F.percentile("t.e", F.lit(1 - top)).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("keep", F.zip_with(entropies, mask, lambda e, m: F.when((m == 1) & (e >= F.col("_cut")), 1).otherwise(0))).drop("_cut")
