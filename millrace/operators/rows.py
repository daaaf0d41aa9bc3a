"""A user's Python function on rows: none, one or several rows out, and what failed as rows too.

The function sees a row as a dict and gives None, a dict or a list of dicts. One
pass over Arrow batches evaluates it once for each row; results and rejects leave
it side by side and are written once, so both tables are views of one evaluation.
A row whose function raises, or whose result does not fit the schema, is a reject
with its key and error; a task adds the traceback to its first few of them. With
``strict`` the first failure ends the job.

Defined results: a null or empty result drops the row; fields that a result lacks
are null, and others are an error; a result of several rows keeps their order in
``_part`` (from 0); if one of them does not fit, the input row is a reject as a
whole; repeated rows are evaluated each; an empty table gives two empty tables.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.sources.workers import let_workers_import, written

Row = dict
Result = dict | list | None
REJECT = "_key string, _error string, _traceback string"


class NotARow(ValueError):
    """A result that is neither None, a dict nor a list of dicts, or has fields that the schema lacks."""


def rows_of(result: Result, names: set[str]) -> list[Row]:
    found = [] if result is None else [result] if isinstance(result, dict) else result
    if not isinstance(found, list) or not all(isinstance(r, dict) for r in found):
        raise NotARow(f"a {type(result).__name__} in place of rows")
    if unknown := sorted({k for r in found for k in r} - names):
        raise NotARow(f"fields that the schema lacks: {', '.join(unknown)}")
    return found


@dataclass(frozen=True)
class RowFunction:
    """A function of rows with the schema of what it gives; ``columns`` are those it reads (all if none are named)."""

    preprocess: Callable[[Row], Result]
    schema: str
    columns: tuple[str, ...] = ()

    def __call__(self, df: DataFrame, key: str, strict: bool = False, tracebacks: int = 10) -> tuple[DataFrame, DataFrame]:
        """(results, rejects): the schema's columns with ``_key`` and ``_part``; ``_key``, ``_error`` and ``_traceback``."""
        spark = df.sparkSession
        let_workers_import(spark)
        schema = StructType.fromDDL(self.schema)
        kind = pa.struct(list(to_arrow_schema(schema)))
        read = list(self.columns or df.columns)
        rows = df.select(F.col(key).cast("string").alias("_key"), F.struct(*read).alias("_row"))
        both = f"_key string, _part int, _out struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in schema)}>, _error string, _traceback string"
        names, function = set(schema.names), self.preprocess

        def run(batches):
            left = tracebacks
            for batch in batches:
                keys, parts, outs, errors, traces = [], [], [], [], []
                for own, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    try:
                        found = rows_of(function(row), names)
                        pa.array(found, kind)  # whether they fit
                    except Exception as error:  # a user's function may raise anything
                        if strict:
                            raise
                        found = [None]
                        errors.append(f"{type(error).__name__}: {error}")
                        traces.append(traceback.format_exc() if left > 0 else None)
                        left -= 1
                    else:
                        errors += [None] * len(found)
                        traces += [None] * len(found)
                    outs += found
                    keys += [own] * len(found)
                    parts += range(len(found))
                cols = [pa.array(keys, pa.string()), pa.array(parts, pa.int32()), pa.array(outs, kind), pa.array(errors, pa.string()), pa.array(traces, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["_key", "_part", "_out", "_error", "_traceback"])

        once = written(rows.mapInArrow(run, both), "rows")
        results = once.where("_error is null").select("_key", "_part", *[F.col(f"_out.`{n}`").alias(n) for n in schema.names])
        return results, once.where("_error is not null").select("_key", "_error", "_traceback")


def rows_to_batch(df: DataFrame, *order: str) -> DataFrame:
    """One row that holds each column as a list, missing values null; for batches of bounded size."""
    whole = df.agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order]))).alias("_rows"))
    return whole.select(*[F.col("_rows").getField(c).alias(c) for c in df.columns])


def batch_to_rows(df: DataFrame) -> DataFrame:
    """The rows of a row of lists; shorter lists end in nulls."""
    return df.select(F.inline(F.arrays_zip(*df.columns)))
