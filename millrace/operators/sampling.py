"""Sorts, limits, samples, splits and packing; randomness comes from hashes of keys, never from partitions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.selection import first_of_groups, first_rows
from millrace.sources.workers import written

PRIME = 2147483647


def draw(key: Column, seed: int = 42) -> Column:
    """A number from 0 to 2**31 - 2 for an integer key, by arithmetic that other engines share."""
    return (F.pmod(key.cast("long") * 48271 + seed, F.lit(PRIME)) * 69621 + 11) % PRIME


def placed(df: DataFrame, *keys: str) -> tuple[DataFrame, Column, Column]:
    """Rows in range partitions of the keys, sorted there and written, with expressions for a row's partition and its place in it.

    Ranged rows are written once, as another evaluation would draw other ranges.
    """
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    return written(rows, "placed"), F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))  # as the numbering has them


def ranked(df: DataFrame, order: str, name: str, *tie: str) -> DataFrame:
    """A dense rank from 0 over the whole table, without one task for all rows.

    A row's rank is the number of rows in the range partitions before its own
    plus its place. The partition sizes are one row for each partition.
    """
    rows, part, place = placed(df, order, *tie)
    sizes = rows.groupBy(part.alias("__part")).count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    numbered = rows.join(F.broadcast(bases), part == F.col("__part"))
    return numbered.withColumn(name, F.col("__base") + place).drop("__at", "__part", "__base")


def balance_largest(df: DataFrame, category: str, first_score: str, second_score: str, composite: str, order: str, times: int = 3) -> DataFrame:
    """The largest category cut to ``times`` the second; rows with both scores 10 first, then by composite, then by order."""
    top = df.groupBy(category).count().orderBy(F.desc("count"), category).limit(2).collect()
    if len(top) < 2 or top[0][category] is None:
        return df
    in_largest = F.col(category).eqNullSafe(F.lit(top[0][category]))
    first = (F.col(first_score) == 10) & (F.col(second_score) == 10)
    large = df.where(in_largest).withColumns({"_late": F.when(first, 0).otherwise(1), "_minus": -F.col(composite)})
    kept = first_rows(large, times * top[1]["count"], "_late", "_minus", order, into="_in").where("_in")
    return df.where(~in_largest).unionByName(kept.select(*df.columns))


def drop_small(df: DataFrame, category: str, least: int = 10) -> DataFrame:
    """Rows whose category is missing (``unknown``) or has enough rows; null and 'none' categories go."""
    named = df.where(F.col(category).isNotNull() & (F.lower(category) != "none"))
    return named.join(named.groupBy(category).count().where(F.col("count") >= least).select(category), category, "left_semi")


def order_by_size(df: DataFrame, category: str, order: str) -> DataFrame:
    """Categories by falling size, then first appearance; rows in order."""
    sizes = df.groupBy(category).agg(F.count("*").alias("_n"), F.min(order).alias("_at"))
    return df.join(sizes, category).orderBy(F.desc("_n"), "_at", order).drop("_n", "_at")


def sample_times(df: DataFrame, n: int, key: str, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """``n`` rows: whole copies, and the rest by a hash of the key (or the first ones)."""
    total = df.count()
    if not total:
        return df
    copies, rest = divmod(n, total)
    out = df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("__copy") if copies else None
    drawn = df.withColumn("__draw", draw(F.col(key), seed) if shuffle else F.col(key))
    more = first_rows(drawn, rest, "__draw", key, into="__in").where("__in").select(*df.columns) if rest else df.limit(0)
    return out.unionByName(more) if out is not None else more


def split_train_val(df: DataFrame, key: str, ratio: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, val) without overlap; val has at least one row unless the ratio is 0."""
    n = max(int(df.count() * ratio), 1) if ratio > 0 else 0
    if ratio == 0:
        return df, df.limit(0)
    if ratio == 1:
        return df.limit(0), df
    marked = first_rows(df.withColumn("_draw", draw(F.col(key), seed)), n, "_draw", key, into="_val").drop("_draw")
    return marked.where(~F.col("_val")).drop("_val"), marked.where("_val").drop("_val")


def split_head(df: DataFrame, ordinal: str, val: int, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, val) of an ordered stream: val are the first rows, train the rest up to ``n``."""
    top = df if n is None else df.where(F.col(ordinal) < n)
    return top.where(F.col(ordinal) >= val), top.where(F.col(ordinal) < val)


def split_by_type(df: DataFrame, kind: str, key: str, share: float = 0.1, large: int | None = 20_000, fixed: int = 1000, seed: int = 42) -> DataFrame:
    """A ``split`` column: of each kind a fixed number (large kinds) or a share, at least one, is test; rows without a kind go.

    With ``large=None`` no kind is large, and a share of each is test.
    """
    rows = df.where(F.col(kind).isNotNull()).withColumn("_draw", draw(F.col(key), seed))
    n = F.col("count")
    quota = F.greatest(F.floor(n * share), F.lit(1))
    if large is not None:
        quota = F.when(n > large, F.lit(fixed)).otherwise(quota)
    quotas = rows.groupBy(kind).count().select(kind, quota.cast("long").alias("k"))
    marked = first_of_groups(rows, quotas, kind, "_draw", "_draw", key, into="_test")
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).select(*df.columns, "split")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(draw(F.col(key), seed), key)


def best_of_n(df: DataFrame, group: str, order: str, orm: str, prm: str, mask: str, keep: int = 1, easy: int | None = None) -> DataFrame:
    """Preference pairs: the best answers that pass against the worst; ``easy`` drops groups with so many right ones."""
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_score"), F.desc(order)))
    worst = F.row_number().over(Window.partitionBy(group).orderBy("_score", order))
    of = Window.partitionBy(group)
    rows = df.withColumn("_score", F.col(prm) + 10 * F.col(orm)).withColumns({"_best": best, "_worst": worst})
    rows = rows.withColumn("_any", F.max(F.col(mask).cast("int")).over(of)).withColumn("_right", F.sum((F.col(orm) > 0).cast("int")).over(of))
    rows = rows.withColumn("_rejected", F.min(F.when(F.col("_worst") == 1, F.col(order))).over(of))
    ok = (F.col("_best") <= keep) & F.col(mask) & (F.col(order) != F.col("_rejected")) & (F.col("_any") == 1)
    if easy is not None:
        ok &= F.col("_right") < easy
    return rows.where(ok).select(*df.columns, F.col("_rejected").alias("rejected"))


def best_fit(items: list[tuple[int, int]], volume: int) -> list[list[tuple[int, int]]]:
    """Bins of (index, length) by best fit over falling lengths; an item over the volume has a bin for itself."""
    import bisect

    bins: list[list] = []
    gaps: list[tuple[int, int]] = []
    for i, n in sorted(items, key=lambda x: -x[1]):
        at = bisect.bisect_left(gaps, (n, -1))
        gap, b = gaps.pop(at) if at < len(gaps) else (volume, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append((i, n))
        bisect.insort(gaps, (gap - n, b))
    return bins


def pack_groups(df: DataFrame, shard: str, index: str, length: str, volume: int, batch: int = 1000) -> DataFrame:
    """Bins of constant volume: (shard, bin, items, filled).

    A shard's rows go in order of index, in batches; the last bin of a batch is
    open and its items go on to the next one. Shards are independent, and a
    shard's rows of two numbers meet in one task, so shards are of bounded size.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = list(pdf.sort_values(index)[[index, length]].astype("int64").itertuples(index=False, name=None))
        done, open_ = [], []
        for at in range(0, len(data), batch):
            bins = best_fit(open_ + data[at : at + batch], volume)
            open_ = [] if at + batch >= len(data) else bins.pop()
            done += bins
        rows = [(pdf[shard].iloc[0], b, [i for i, _ in x], sum(n for _, n in x)) for b, x in enumerate(done)]
        return pd.DataFrame(rows, columns=["shard", "bin", "items", "filled"])

    return df.groupBy(shard).applyInPandas(run, "shard long, bin long, items array<long>, filled long")


def packed_row(tokens: Column) -> tuple[Column, Column, Column]:
    """(all tokens, position ids that begin anew with each row, lengths) of an array of token arrays."""
    positions = F.flatten(F.transform(tokens, lambda t: F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))))
    return F.flatten(tokens), positions, F.transform(tokens, lambda t: F.size(t))


def negatives_from_pool(df: DataFrame, pool: DataFrame, key: str, positive: str, item: str, n: int = 7, seed: int = 42) -> DataFrame:
    """``n`` items of a bounded pool for each row, none of them its positive.

    The pool is numbered; a row starts at a place drawn from its key and takes
    the next items in turn, skipping its positive, so no row meets the whole pool.
    """
    numbered = ranked(pool.select(F.col(item).alias("_item")).distinct(), "_item", "_at")
    size = numbered.agg(F.count("*").alias("_size"))
    tries = df.crossJoin(F.broadcast(size)).withColumn("_step", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("_size").cast("int") - 1))))
    tries = tries.withColumn("_at", (draw(F.col(key), seed) + F.col("_step")) % F.col("_size"))
    got = tries.join(numbered, "_at").where(F.col("_item") != F.col(positive))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_step"))
    return got.withColumn("n", rank).where(F.col("n") <= n).select(*df.columns, "n", F.col("_item").alias("negative"))


def fixed_negatives(negatives: Column, n: int) -> Column:
    """Cut to ``n``, or filled up by going round."""
    many = F.flatten(F.array_repeat(negatives, n))
    return F.when(F.size(negatives) > 0, F.slice(many, 1, n)).otherwise(negatives)


def top_probabilities(probs: Column, n: int) -> Column:
    """The ``n`` largest as (class, probability), ties by class."""
    pairs = F.transform(probs, lambda p, i: F.struct((-p).alias("m"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda x: F.struct(x["i"].alias("index"), (-x["m"]).alias("p")))


def allocation(weights: Column, budget: int, most: int) -> Column:
    """Shares of a budget for an array of weights, each at most ``most``; an array of whole numbers in the same order.

    Null and negative weights count as 0 and get nothing. First come the floors
    of the proportional shares, under the cap. The units left are dealt one each
    to the others that weigh something, by falling fraction, then by place, again
    and again; a full one leaves, and the dealing starts over at the front.

    Units go in phases, each up to the next one that is full: with room ``m`` of
    the one with the least room (the first such, at place ``p``), ``m`` units go
    to those up to it and ``m - 1`` to those after it. A phase that the units
    left do not fill is the last: whole rounds, and one more for the first ones.
    """
    w = F.transform(weights, lambda x: F.greatest(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0)))

    def shares(w: Column) -> Column:
        total = F.nullif(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
        floors = F.transform(w, lambda x: F.coalesce(F.floor(x / total * budget), F.lit(0).cast("long")))
        given = F.transform(floors, lambda x: F.least(x, F.lit(most)))
        waiting = F.filter(
            F.zip_with(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), F.arrays_zip(floors.alias("f"), given.alias("g")), lambda x, y: F.struct((y["f"] - x["w"] / total * budget).alias("minus"), x["i"].alias("i"), (F.lit(most) - y["g"]).alias("room"), x["w"].alias("w"))),
            lambda x: (x["w"] > 0) & (x["room"] > 0),
        )
        ring = F.transform(F.array_sort(waiting), lambda x: F.struct(x["i"].alias("i"), x["room"].cast("long").alias("room"), F.lit(0).cast("long").alias("got")))
        left = F.greatest(F.lit(budget).cast("long") - F.aggregate(given, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
        none = F.filter(ring, lambda x: F.lit(False))
        start = F.struct(ring.alias("ring"), none.alias("full"), left.alias("left"))

        def phase(s: Column, _: Column) -> Column:
            n = F.nullif(F.size(s["ring"]), F.lit(0))
            m = F.array_min(F.transform(s["ring"], lambda x: x["room"]))
            p = F.array_position(F.transform(s["ring"], lambda x: x["room"]), m)  # from 1
            whole = s["left"] >= (m - 1) * n + p

            def after(x: Column, i: Column) -> Column:
                units = F.when(whole, m - (i >= p).cast("int")).otherwise(F.floor(s["left"] / n) + (i < s["left"] % n).cast("int"))
                return F.struct(x["i"].alias("i"), (x["room"] - units).alias("room"), (x["got"] + units).alias("got"))

            dealt = F.transform(s["ring"], after)
            going, out = F.filter(dealt, lambda x: x["room"] > 0), F.filter(dealt, lambda x, i: x["room"] <= 0)
            used = F.when(whole, (m - 1) * n + p).otherwise(s["left"])
            return F.when(n.isNull() | (s["left"] == 0), s).otherwise(F.struct(going.alias("ring"), F.concat(s["full"], out).alias("full"), (s["left"] - used).alias("left")))

        end = F.aggregate(F.sequence(F.lit(1), F.size(w)), start, phase)
        extra = lambda e, i: F.aggregate(F.filter(F.concat(e["ring"], e["full"]), lambda x: x["i"] == i), F.lit(0).cast("long"), lambda a, x: a + x["got"])
        return F.transform(F.array(end), lambda e: F.transform(given, lambda g, i: g.cast("long") + extra(e, i)))[0]

    bound = F.transform(F.array(w), shares)[0]  # the weights are worked out once
    return F.when(F.size(weights) > 0, bound).otherwise(F.array().cast("array<bigint>"))


def allocate_budget(df: DataFrame, root: str, order: str, weight: str, budget: int, most: int) -> DataFrame:
    """(root, leaf, share) for each leaf of a root, in the given order; a root's leaves are a small group."""
    leaves = df.groupBy(root).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(weight).alias("w")))).alias("a"))
    shares = allocation(F.transform("a", lambda x: x["w"]), budget, most)
    rows = leaves.select(F.col(root).alias("root"), F.inline(F.arrays_zip(F.transform("a", lambda x: x["o"]).alias("leaf"), shares.alias("share"))))
    return rows.select("root", F.col("leaf").cast("long").alias("leaf"), "share")


def batch_shares(df: DataFrame, key: str, ranks: int, batch: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(rank, batch number) of each row of a seeded order; what fills no whole share or batch is left out.

    Only keys and what is drawn from them are ranked; ``key`` is unique, and other columns are joined to it.
    """
    total = df.count()
    per = total // ranks // batch * batch
    if not per:
        return df.withColumns({"rank": F.lit(0), "batch": F.lit(0)}).limit(0)
    rows = ranked(df.select(key, draw(F.col(key), seed + epoch).alias("_draw")), "_draw", "_row", key)
    share = total // ranks
    rows = rows.withColumn("rank", F.floor(F.col("_row") / share).cast("int")).withColumn("_in", F.col("_row") % share)
    rows = rows.where((F.col("rank") < ranks) & (F.col("_in") < per)).select(key, "rank", F.floor(F.col("_in") / batch).cast("int").alias("batch"))
    return (rows if df.columns == [key] else df.join(rows, key)).select(*df.columns, "rank", "batch")


def contiguous_piece(df: DataFrame, ordinal: str, total: int, piece: int, pieces: int) -> DataFrame:
    """Piece ``piece`` (from 0) of equal contiguous pieces; the remainder is dropped."""
    size = total // pieces
    return df.where((F.col(ordinal) >= piece * size) & (F.col(ordinal) < (piece + 1) * size))


def even_process(ordinal: Column, total: int, processes: int) -> Column:
    """The process of a row in even contiguous slices; the first ones take one more."""
    size, more = divmod(total, processes)
    edge = more * (size + 1)
    return F.when(ordinal < edge, F.floor(ordinal / (size + 1))).otherwise(more + F.floor((ordinal - edge) / max(size, 1))).cast("int")


def padded(tokens: Column, to: Column | int, pad: int = 0) -> Column:
    """Arrays of one length."""
    to = F.lit(to) if isinstance(to, int) else to
    return F.concat(tokens, F.array_repeat(F.lit(pad), F.greatest(to - F.size(tokens), F.lit(0))))
