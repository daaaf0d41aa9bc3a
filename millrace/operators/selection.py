"""The first k rows in an order, without sorting: histograms find the last row's key, and a filter does the rest.

Each counting pass reads the key alone and has at most 65,536 counts to look at,
those of 16 bits of the key below the bits already known; so a key of 31 bits
takes a pass for its range and two for its bits. Rows are neither shuffled nor
written. Only rows that equal the last one in all that the histograms can tell
are ranked, by their true keys.

Keys are columns of any type that sorts, nulls first. A histogram sees a whole
number that does not fall where the key rises: the number itself, a floor for
fractions, the first bytes for text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = -(1 << 63)
BITS = 16


def coarse(df: DataFrame, key: str) -> Column:
    """A long that never falls where ``key`` rises; nulls have the least one."""
    kind, c = df.schema[key].dataType, F.col(f"`{key}`")
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        number = c.cast("long")
    elif isinstance(kind, (T.DateType, T.TimestampType)):
        number = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.FractionalType):
        scaled = c.cast("double") * 1024
        number = F.when(F.isnan(scaled) | (scaled >= 2.0**62), F.lit(1 << 62)).when(scaled <= -(2.0**62), F.lit(-(1 << 62))).otherwise(F.floor(scaled))
    else:
        number = F.conv(F.rpad(F.hex(F.substring(F.encode(c.cast("string"), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return F.coalesce(number, F.lit(LEAST))


def last_of_first(rows: DataFrame, number: Column, k: int) -> tuple[int, int]:
    """(v, n): the k-th smallest number is v, and n of the rows have smaller ones; ``k`` is at most their count."""
    keys = rows.select(number.alias("v"), number.bitwiseXOR(F.lit(LEAST)).alias("u"))  # u: as an unsigned number from 0
    low, high = (x - LEAST for x in keys.agg(F.min("v"), F.max("v")).first())
    open_, below = (low ^ high).bit_length(), 0
    prefix = low >> open_
    while open_:
        width = min(BITS, open_)
        part = keys if open_ == 64 else keys.where(F.shiftrightunsigned("u", open_) == prefix)
        digit = F.shiftrightunsigned("u", open_ - width).bitwiseAND(F.lit((1 << width) - 1))
        for d, n in sorted(part.groupBy(digit.alias("d")).count().collect()):
            if below + n >= k:
                break
            below += n
        open_ -= width
        prefix = prefix << width | d
    return prefix + LEAST, below


def first_rows(df: DataFrame, k: int, *keys: str, into: str = "_first") -> DataFrame:
    """``df`` with a flag for its first ``k`` rows in the order of ``keys``; equal rows are told apart as they come."""
    from millrace.operators.sampling import ranked

    total = df.count()
    if k <= 0 or k >= total:
        return df.withColumn(into, F.lit(k > 0))
    sure, tied, left = F.lit(False), F.lit(True), k
    for key in keys:
        number = coarse(df, key)
        here = df.where(tied)
        v, below = last_of_first(here, number, left)
        sure, tied, left = sure | (tied & (number < v)), tied & (number == v), left - below
        n = df.where(tied).count()
        if n == left:
            return df.withColumn(into, sure | tied)
    rest = ranked(df.where(tied), keys[0], "_rank", *keys[1:]).withColumn(into, F.col("_rank") < left).drop("_rank")
    return df.where(~tied).withColumn(into, sure).unionByName(rest)


def first_of_groups(df: DataFrame, quotas: DataFrame, group: str, number: str, *keys: str, into: str = "_first") -> DataFrame:
    """The same in each group of ``quotas`` (group, k), for a whole number from 0 to 2**32 - 1, then ``keys``; k is at most a group's size.

    Two counting passes give each group's last number. Counts of a group and 16
    bits are summed where they are made, so a large group is no large task.
    """
    from millrace.operators.sampling import ranked

    def digit_of(rows: DataFrame, digit: Column, left: str, *own: str) -> DataFrame:
        """For each group the digit in which its quota ends, what is left of it there, and how many rows have that digit."""
        counts = rows.groupBy("g", *own, left, digit.alias("d")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g").orderBy("d"))
        ends = counts.withColumn("upto", upto).where((F.col("upto") >= F.col(left)) & (F.col("upto") - F.col("n") < F.col(left)))
        return ends.select("g", *own, "d", (F.col(left) - F.col("upto") + F.col("n")).alias("left"), "n")

    named = quotas.select(F.col(group).alias("g"), F.col("k").alias("quota")).where("quota > 0")
    narrow = df.select(F.col(group).alias("g"), F.col(number).alias("u")).join(named, "g")
    high = digit_of(narrow, F.shiftright("u", BITS), "quota").withColumnRenamed("d", "high").withColumnRenamed("left", "rest").drop("n")
    inner = narrow.drop("quota").join(high, "g").where(F.shiftright("u", BITS) == F.col("high"))
    cuts = digit_of(inner, F.col("u").bitwiseAND(F.lit((1 << BITS) - 1)), "rest", "high")
    cuts = cuts.select(F.col("g").alias("_g"), (F.shiftleft("high", BITS) + F.col("d")).alias("_cut"), F.col("left").alias("_left"), (F.col("n") == F.col("left")).alias("_whole"))
    rows = df.join(cuts, F.col(group) == F.col("_g"), "left")  # a row for each group: a small side
    at = F.coalesce((F.col(number) == F.col("_cut")) & ~F.col("_whole"), F.lit(False))
    sure = F.coalesce(F.col(number) <= F.col("_cut"), F.lit(False))
    done = rows.where(~at).withColumn(into, sure)
    tied = ranked(rows.where(at), group, "_rank", *keys)
    firsts = tied.groupBy(F.col(group).alias("_t")).agg(F.min("_rank").alias("_from"))
    tied = tied.join(firsts, F.col(group) == F.col("_t")).withColumn(into, F.col("_rank") - F.col("_from") < F.col("_left"))
    return done.select(*df.columns, into).unionByName(tied.select(*df.columns, into))
