"""Row identity, functions of rows, selection without sorting, and interleaving, against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.canonical import canonical_json, json_row_key, python_variant, row_key
from millrace.operators import reshape, rows, sampling, selection

LETTERS = ["a", '"', "\\", "é", "😀", "\n", "\t", "\x01", "\x1f", "\x7f", "/", " ", ",", ":", "{", "1.50", " ", "u001F", "\b", "\f", "\r"]
FLOATS = [0.0, -0.0, 1.0, 1.5, -2.25, 1e15, 1e16, 123456789.125, 1e7, 1.5e7, 0.001, 0.0001, 0.00012, 1e-5, 1.25e-7, 1e22, 3.0e100, 12345678.9, 0.1]


def made(draw, depth=0):
    kind = draw.randrange(9 if depth < 4 else 6)
    if kind == 0:
        return draw.choice([0, 1, -5, 10**12, 2**62, 123456789012345678901])
    if kind == 1:
        return draw.choice(FLOATS)
    if kind == 2:
        return draw.choice([None, True, False])
    if kind < 6:
        return "".join(draw.choices(LETTERS, k=draw.randrange(8)))
    if kind == 6:
        return [made(draw, depth + 1) for _ in range(draw.randrange(4))]
    return {draw.choice('abcé"\\z') + draw.choice(["", "x", " "]): made(draw, depth + 1) for _ in range(draw.randrange(5))}


def test_canonical_json_is_pythons(spark):
    draw = random.Random(5)
    values = [{f"k{j}": made(draw) for j in range(draw.randrange(5))} | {"choices": [1]} for _ in range(500)]
    values += [{"text": 'x"\\\n' * 100_000}]  # a long string is no deep recursion
    lines = [json.dumps(v, ensure_ascii=i % 2 == 0, separators=[(",", ":"), (", ", ": ")][i // 2 % 2]) for i, v in enumerate(values)]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    for r in df.select("i", canonical_json(python_variant(F.col("t"))).alias("c"), json_row_key(F.col("t")).alias("k")).collect():
        v = values[r["i"]]
        assert r["c"] == json.dumps(v, sort_keys=True)
        assert r["k"] == hashlib.md5(json.dumps({k: x for k, x in v.items() if k != "choices"}, sort_keys=True).encode()).hexdigest()


def test_row_keys_of_columns(spark):
    df = spark.createDataFrame([(2, "é", None, [1.0, 2.5], {"z": 1, "a": 2}, 9), (1, None, True, [], {}, 8)], "b int, a string, n boolean, l array<double>, m map<string,int>, choices int")
    got = [r[0] for r in df.select(row_key("b", "a", "n", "l", "m", "choices")).collect()]
    want = [{"b": r["b"], "a": r["a"], "n": r["n"], "l": r["l"], "m": r["m"]} for r in df.collect()]
    assert got == [hashlib.md5(json.dumps(w, sort_keys=True).encode()).hexdigest() for w in want]
    assert spark.range(1).select(json_row_key(F.lit("{broken"))).first()[0] is None


def test_functions_of_rows(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def f(row):
        with open(seen / str(row["id"]), "a") as out:
            out.write("x")
        if row["id"] % 5 == 0:
            raise KeyError(row["id"])
        return [None, {"a": row["id"]}, [{"a": 1, "b": "x"}, {"b": "y"}], {"a": "no"}, {"c": 1}, "row", []][row["id"] % 7]

    df = spark.range(1, 71).withColumn("a", F.lit("clash")).repartition(3)
    good, bad = rows.RowFunction(f, "a long, b string")(df, "id", tracebacks=2)
    want, failed = [], {}
    for i in range(1, 71):
        if i % 5 == 0:
            failed[str(i)] = "KeyError"
        elif i % 7 == 1:
            want.append((str(i), 0, i, None))
        elif i % 7 == 2:
            want += [(str(i), 0, 1, "x"), (str(i), 1, None, "y")]
        elif i % 7 in (3, 4, 5):
            failed[str(i)] = {3: "Arrow", 4: "NotARow", 5: "NotARow"}[i % 7]
    assert sorted(map(tuple, good.collect())) == sorted(want)
    rejects = bad.collect()
    assert {r["_key"] for r in rejects} == set(failed) and all(r["_error"].startswith(failed[r["_key"]]) for r in rejects)
    assert 2 <= sum(r["_traceback"] is not None for r in rejects) <= 6  # two of each of three tasks
    assert all(p.read_text() == "x" for p in seen.iterdir()) and len(list(seen.iterdir())) == 70  # each once
    with pytest.raises(Exception, match="KeyError"):
        rows.RowFunction(f, "a long, b string")(df, "id", strict=True)
    none = rows.RowFunction(f, "a long, b string")(df.limit(0), "id")
    assert [d.count() for d in none] == [0, 0]


def test_rows_and_batches(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i int, s string")
    batch = rows.rows_to_batch(df, "i")
    assert tuple(batch.first()) == ([1, 2, 3], ["a", None, "c"])
    short = batch.select("i", F.slice("s", 1, 2).alias("s"))
    assert sorted(map(tuple, rows.batch_to_rows(short).collect())) == [(1, "a"), (2, None), (3, None)]


@pytest.mark.parametrize("kind", ["long", "double", "string", "date", "decimal(9,3)", "boolean"])
def test_first_rows_of_any_type(spark, kind):
    draw = random.Random(kind)
    n = 300
    df = spark.createDataFrame([(i, draw.choice([None, *range(-40, 40), 2**40, -(2**40)])) for i in range(n)], "id long, x long")
    cast = {"date": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("x") % 50).cast("int")), "boolean": F.col("x") > 0, "decimal(9,3)": (F.col("x") % 90000 / 7).cast(kind), "string": F.concat(F.lit("pre"), F.col("x").cast("string"))}
    df = df.withColumn("key", cast.get(kind, (F.col("x") / (7 if kind == "double" else 1)).cast(kind)))
    order = [r["id"] for r in df.orderBy("key", "id").collect()]
    for k in (0, 1, 17, 150, 299, 300, 500):
        flagged = selection.first_rows(df, k, "key", "id")
        assert {r["id"] for r in flagged.where("_first").collect()} == set(order[:k]) and flagged.count() == n


def test_equal_rows_are_counted(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(2, "b")] * 5 + [(None, "c")] * 3, "k int, s string")
    flagged = selection.first_rows(df, 6, "k")
    assert sorted(r["s"] for r in flagged.where("_first").collect()) == ["a"] * 3 + ["c"] * 3 and flagged.count() == 13
    assert selection.first_rows(df.limit(0), 3, "k").count() == 0


def test_selection_moves_no_rows(spark):
    df = spark.range(10_000).withColumn("wide", F.repeat(F.lit("x"), 50)).withColumn("d", sampling.draw(F.col("id")))
    plan = selection.first_rows(df, 100, "d", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    train, val = sampling.split_train_val(df, "id", 0.1)
    assert (train.count(), val.count(), train.join(val, "id").count()) == (9000, 1000, 0)


def test_first_of_groups(spark):
    draw = random.Random(3)
    data = [(i, draw.choice("abc"), draw.choice([5, 70_000, 70_001, draw.randrange(2**31)])) for i in range(400)]
    df = spark.createDataFrame(data, "id long, g string, u long")
    for quota in ({"a": 1, "b": 20, "c": 60}, {"a": 0, "b": 3}):
        quotas = spark.createDataFrame(list(quota.items()), "g string, k long")
        got = selection.first_of_groups(df, quotas, "g", "u", "u", "id")
        want = {i for g, k in quota.items() for _, i in sorted((u, i) for i, h, u in data if h == g)[:k]}
        assert {r["id"] for r in got.where("_first").collect()} == want and got.count() == 400


@pytest.mark.parametrize("stop", ["first_exhausted", "all_exhausted"])
@pytest.mark.parametrize("sizes, weights", [([30, 7], [0.7, 0.3]), ([900, 2], [999, 1]), ([5, 5, 40], [1, 2, 3]), ([4], [1])])
def test_interleave_draws_as_told(spark, stop, sizes, weights):
    frames = [spark.range(n).select(F.col("id").alias("row"), F.lit(k).alias("of")) for k, n in enumerate(sizes)]
    got = [tuple(r) for r in reshape.interleave(frames, weights, "row", stop=stop).select("position", "source", "of", "row").orderBy("position").collect()]
    taken, want, place = [0] * len(sizes), [], 0
    while not (any if stop == "first_exhausted" else all)(t >= n for t, n in zip(taken, sizes)):
        u = ((place * 48271 + 42) % sampling.PRIME * 69621 + 11) % sampling.PRIME / sampling.PRIME
        k = next((k for k in range(len(sizes) - 1) if u < sum(weights[: k + 1]) / sum(weights)), len(sizes) - 1)
        want.append((place, k, k, taken[k] % sizes[k]))
        taken[k] += 1
        place += 1
    assert got == want
