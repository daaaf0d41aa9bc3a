"""Aggregates that a user writes: zero, update, merge and finish, in two stages.

Tasks update states of the groups they see, bounded in number, and give them out as
binary columns. States of a group are merged where they meet, first in shares and
then for good, streaming in order of the group; so a hot group is neither gathered
nor one task's work, and results do not depend on partitions if merging does not.

Defined results: null group keys are a group; an empty table has no group, and
without keys one row, that of the zero state.
"""

from __future__ import annotations

import math
import pickle
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from millrace.sources.workers import let_workers_import

SHARES, HELD = 16, 10_000


class Aggregate:
    """Subclass it: states are values that ``dump`` and ``load`` turn into bytes and back."""

    result = "value double"  # the column that ``finish`` gives

    def zero(self):
        raise NotImplementedError

    def update(self, state, row: dict):
        raise NotImplementedError

    def merge(self, a, b):
        raise NotImplementedError

    def finish(self, state):
        raise NotImplementedError

    def dump(self, state) -> bytes:
        return pickle.dumps(state)

    def load(self, data: bytes):
        return pickle.loads(data)


def aggregated(df: DataFrame, keys: list[str], aggregate: Aggregate, columns: list[str], shares: int = SHARES) -> DataFrame:
    """``keys`` and the aggregate of ``columns`` for each group."""
    spark = df.sparkSession
    let_workers_import(spark)
    key_fields = [df.schema[k] for k in keys]
    kinds = [to_arrow_type(f.dataType) for f in key_fields]
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)
    result = StructType.fromDDL(aggregate.result)[0]
    names = [*keys, "_state"]

    def batch_of(rows: list[tuple], last: pa.DataType, name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate([*kinds, last])], [*keys, name])

    def update(batches):
        states: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                states[key] = aggregate.update(states[key] if key in states else aggregate.zero(), row)
            if len(states) > HELD:
                yield batch_of([(*k, aggregate.dump(s)) for k, s in states.items()], pa.binary(), "_state")
                states = {}
        yield batch_of([(*k, aggregate.dump(s)) for k, s in states.items()], pa.binary(), "_state")

    def merged(give, kind: pa.DataType, name: str):
        def run(batches):
            key = state = None
            for batch in batches:
                out = []
                for *k, data in zip(*(batch.column(n).to_pylist() for n in names)):
                    if k != key:
                        if key is not None:
                            out.append((*key, give(state)))
                        key, state = k, aggregate.load(data)
                    else:
                        state = aggregate.merge(state, aggregate.load(data))
                yield batch_of(out, kind, name)
            if key is not None:
                yield batch_of([(*key, give(state))], kind, name)

        return run

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prefix = f"{own}, " if keys else ""
    states = df.select(*keys, *[c for c in columns if c not in keys]).mapInArrow(update, f"{prefix}_state binary").withColumn("_share", F.spark_partition_id() % shares)
    first = states.repartition(parts, *keys, "_share").sortWithinPartitions(*keys, "_share").select(*names)
    first = first.mapInArrow(merged(aggregate.dump, pa.binary(), "_state"), f"{prefix}_state binary")
    if not keys:
        zero = spark.createDataFrame([(aggregate.dump(aggregate.zero()),)], "_state binary")
        first = first.unionByName(zero).coalesce(1)  # one state for each share
    second = first.repartition(parts, *keys).sortWithinPartitions(*keys) if keys else first
    return second.mapInArrow(merged(aggregate.finish, to_arrow_type(result.dataType), result.name), f"{prefix}`{result.name}` {result.dataType.simpleString()}")


class ExactMean(Aggregate):
    """The mean of a column of doubles, rounded once: sums are exact, so no order of rows changes a digit. Nulls are left out."""

    result = "mean double"

    def __init__(self, column: str):
        self.column = column

    def zero(self):
        return 0, 0, 0  # a whole number, times 2 to a power, over so many values

    def update(self, state, row):
        x = row[self.column]
        if x is None or not math.isfinite(x):
            return state
        top, bottom = x.as_integer_ratio()
        return self.merge(state, (top, 1 - bottom.bit_length(), 1))

    def merge(self, a, b):
        power = min(a[1], b[1])
        return (a[0] << (a[1] - power)) + (b[0] << (b[1] - power)), power, a[2] + b[2]

    def finish(self, state):
        top, power, n = state
        return float(Fraction(top) * Fraction(2) ** power / n) if n else None
