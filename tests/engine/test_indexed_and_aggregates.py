"""Indexed sets, aggregates of users, and calls read from broken texts."""

import datetime
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.agents import read_calls, tool_calls_text
from millrace.operators.aggregates import Aggregate, ExactMean, aggregated
from millrace.queries import QUERIES
from millrace.sources import indexed


def made(spark, n=500):
    columns = "id long, text string, n array<int>, s struct<a:double,b:string>, day date, at timestamp, d decimal(9,3)"
    rows = [(i, None if i % 7 == 0 else "é\n" * (i % 50), [i, None], (i / 3, None), datetime.date(2024, 1, 1 + i % 28), datetime.datetime(2024, 1, 1, 1, i % 60), None) for i in range(n)]
    return spark.createDataFrame(rows, columns).withColumn("d", (F.col("id") / 8).cast("decimal(9,3)")).repartition(5), rows


def test_rows_by_number(spark, tmp_path):
    df, rows = made(spark)
    path = f"file://{tmp_path}/set"
    indexed.write_indexed(df, path, "id", shard_bytes=4000)
    known = indexed.manifest(path)
    assert known["rows"] == 500 and len(known["shards"]) > 10 and all(s["bytes"] < 5000 for s in known["shards"])
    whole = indexed.read_indexed(spark, path).orderBy("_row").collect()
    want = {r["id"]: r for r in df.collect()}
    assert [r["_row"] for r in whole] == [r["id"] for r in whole] == list(range(500))
    assert all(tuple(r)[1:] == tuple(want[r["id"]]) for r in whole)
    got = indexed.read_indexed(spark, path, [499, 0, -1, 250, 250, -500])
    assert sorted(r["id"] for r in got.collect()) == [0, 0, 250, 250, 499, 499]
    assert got.rdd.getNumPartitions() <= 3  # only the shards in question
    with pytest.raises(Exception, match="row 500 of 500"):
        indexed.read_indexed(spark, path, [500]).collect()
    split = spark.read.format("indexed").option("path", path).option("splitBytes", 1000).load()
    assert split.rdd.getNumPartitions() > 3 * len(known["shards"]) and split.count() == 500
    indexed.write_indexed(df.limit(0), path, "id")
    assert indexed.read_indexed(spark, path).count() == 0


def test_a_failed_write_leaves_the_earlier_set(spark, tmp_path):
    df, _ = made(spark, 50)
    path = str(tmp_path / "set")
    indexed.write_indexed(df, path, "id")
    before = sorted(os.listdir(path))
    broken = df.withColumn("id", F.when(F.col("id") == 30, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("indexed").option("path", path).mode("overwrite").save()
    assert indexed.read_indexed(spark, path).count() == 50
    shards = {s["name"] for s in indexed.manifest(path)["shards"]}
    assert {f"{n}.{k}" for n in shards for k in ("bin", "idx")} | {"manifest.json"} == set(before)


def test_aggregates_are_the_same_under_any_partitioning(spark):
    class Longest(Aggregate):
        """The longest text, ties by order of texts."""

        result = "longest string"

        def zero(self):
            return ""

        def update(self, state, row):
            return self.merge(state, row["text"] or "")

        def merge(self, a, b):
            return max(a, b, key=lambda t: (len(t), t))

        def finish(self, state):
            return state or None

        def dump(self, state):
            return state.encode()

        def load(self, data):
            return data.decode()

    draw = random.Random(2)
    data = [("hot" if i % 3 else draw.choice(["a", "b", None]), None if i % 11 == 0 else draw.choice([1e17, -1e17, 1e-9, 0.1, 3.0]), "x" * draw.randrange(9) + str(i % 5)) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v double, text string")
    means = {g: math.fsum(v for h, v, _ in data if h == g and v is not None) / sum(v is not None for h, v, _ in data if h == g) for g in {r[0] for r in data}}
    longest = {g: max((t for h, _, t in data if h == g), key=lambda t: (len(t), t)) for g in means}
    for rows in (df.coalesce(1), df.repartition(7), df.orderBy("v")):
        got = {r["g"]: r["mean"] for r in aggregated(rows, ["g"], ExactMean("v"), ["v"]).collect()}
        assert got.keys() == means.keys() and all(abs(got[g] - means[g]) <= 1e-15 * abs(means[g]) for g in means)
        assert {r["g"]: r["longest"] for r in aggregated(rows, ["g"], Longest(), ["text"], shares=3).collect()} == longest
        assert [r["longest"] for r in aggregated(rows, [], Longest(), ["text"]).collect()] == [max(longest.values(), key=lambda t: (len(t), t))]
    exact = {tuple(r) for r in aggregated(df, ["g"], ExactMean("v"), ["v"]).collect()}
    assert exact == {tuple(r) for r in aggregated(df.repartition(13), ["g"], ExactMean("v"), ["v"], shares=2).collect()}
    assert aggregated(df.limit(0), ["g"], ExactMean("v"), ["v"]).collect() == []
    assert [r["mean"] for r in aggregated(df.limit(0), [], ExactMean("v"), ["v"]).collect()] == [None]


def calls(spark, text, form):
    row = spark.range(1).select(F.transform(read_calls(F.lit(text), form), lambda c: F.struct(c["name"].alias("n"), F.to_json(c["arguments"]).alias("a"))).alias("c")).first()
    return [(c["n"], json.loads(c["a"])) for c in row["c"]]


def test_calls_in_broken_and_odd_texts(spark):
    assert calls(spark, "", "hermes") == calls(spark, None, "react_en") == calls(spark, "no call here", "deepseek_v3_1") == []
    assert calls(spark, '<tool_call>{"name": "f"}</tool_call><tool_call>{"name": "g", "arguments": {"x": [1, "}"]}}</tool_call>', "hermes") == [("g", {"x": [1, "}"]})]
    assert calls(spark, "<tool_call>{broken</tool_call>\nAction: f\nAction Input: {\"a\": 1}\nObservation:", "hermes") == [("f", {"a": 1})]
    assert calls(spark, "Action: f\nAction: g\nAction Input: plain words", "react_en") == [("g", "plain words")]
    assert calls(spark, "<tool_call>\n<function=f>\n<parameter=a>\ntwo\nlines\n</parameter>\n<parameter=n>\n5\n</parameter>\n</function>\n</tool_call>", "qwen3_coder") == [("f", {"a": "two\nlines", "n": 5})]
    assert calls(spark, '[TOOL_CALLS][\n{"name": "f", "arguments": {"a": 1}}\n{oops}\n]</s>', "mistral") == [("f", {"a": 1})]
    assert calls(spark, '<tool_call>f\n```json{"a": 2}```</tool_call>', "hunyuan_hermes") == [("f", {"a": 2})]
    text = tool_calls_text(F.array(F.struct(F.lit("f").alias("name"), F.lit('{"a": 1, "b": "x y"}').alias("arguments"))), "glm4_5")
    assert calls(spark, spark.range(1).select(text).first()[0], "glm4_5") == [("f", {"a": 1, "b": "x y"})]


def test_metric_counts_all_rows(spark, tmp_path):
    """The mean leaves nulls out, the number of rows does not."""
    rows = [("a", 1.0), ("a", None), ("a", 3.0), (None, 5.0), ("b", None)]
    spark.createDataFrame(rows, "event_type string, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_type"]: (r["mean"], r["n"]) for r in QUERIES["D3_metric"](spark, str(tmp_path)).collect()}
    assert got == {"a": (2.0, 3), None: (5.0, 1), "b": (None, 1)}
