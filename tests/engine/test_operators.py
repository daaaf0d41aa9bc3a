"""Hand-worked cases and properties."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import rewards as R
from millrace.functions.parts import loss_scale, split_parts
from millrace.operators import metrics, normalize, reshape, sampling, validate, windows
from millrace.sources.registry import Meta, Source, Subset, register, select_subsets

M = "array<struct<role:string,content:string,loss:double>>"


def value(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(x):
    return F.lit(x)


def test_choice_accuracy_cases(spark):
    cases = [("<answer>A</answer>", "A. x", 1.0), ("<answer>\n B. y</answer>", "B", 1.0), ("<answer>Apple</answer>", "A", 1.0), ("<answer>a</answer>", "a", 0.0), ("A", "A", 0.0), ("<answer></answer>", "A", 0.0), ("<answer>B</answer><answer>A</answer>", "A", 0.0)]
    rows = spark.createDataFrame(cases, "c string, s string, want double").select("want", R.choice_accuracy(F.col("c"), F.col("s")).alias("got"))
    assert all(r["want"] == r["got"] for r in rows.collect())
    assert value(spark, R.choice_accuracy_a_to_g(lit("<answer>Z</answer>"), lit("Z"))) == (0.0,)


def test_format_cases(spark):
    good = "<time>1.0-2.0</time><caption>a</caption><thinking>t</thinking><answer>A</answer>"
    assert value(spark, *[R.time_caption_format(lit(t)) for t in (good, good + "<time>3</time>", good.replace("<thinking>", ""), "")]) == (1.0, 0.0, 0.0, 0.0)
    assert value(spark, *[R.think_then_answer(lit(t)) for t in ("<think>a</think>\n<answer>b</answer>", " <think>a</think><answer>b</answer>", "<think>a</think>x<answer>b</answer>")]) == (1.0, 0.0, 0.0)
    assert value(spark, *[R.judge_json(lit(t)) for t in ('```json\n{"score": 0.7}\n```', 'well {"score": 2} ok', "0.25", "about 0.5 I say", "none")]) == (0.7, 1.0, 0.25, 0.5, 0.0)
    assert value(spark, R.soft_overlong(lit(900), 1000, 200), R.soft_overlong(lit(100), 1000, 200)) == (-0.5, 0.0)


def test_python_rewards():
    call = lambda n, **p: {"name": n, "parameters": p}
    assert R.tool_calls_score([call("f", a=1)], [call("f", a=1)]) == 3.0
    assert R.tool_calls_score([call("f", a=1)], [call("g", a=1)]) == -3.0
    assert abs(R.tool_calls_score([call("f", a=1)], [call("f", a=2)]) - (6 * 2 / 3 - 3)) < 1e-12
    assert R._call_f1('{"a": 1, "b": 2}', '{"a": 1, "b": 3}') == 0.75 and R._call_f1("x", "x") == 0.0 and R._call_f1("{}", "{}") == 1.0
    assert R.calculator_text("(1+2)*3") == "9" and R.calculator_text("2**3").startswith("Error") and R.calculator_text("__import__('os')").startswith("Error") and "zero" in R.calculator_text("1/0")
    assert R._countdown("<answer>(1+2)*3 = 9</answer>", 9, [3, 1, 2]) == 1.0 and R._countdown("<answer>9</answer>", 9, [3, 3]) == 0.0


def dealt_one_by_one(weights, budget, most):
    """Units dealt singly to a queue, as the rule says it."""
    w = [max(x or 0.0, 0.0) for x in weights]
    total = 0.0
    for x in w:
        total += x
    if not total:
        return [0] * len(w)
    share = [x / total * budget for x in w]
    got = [min(int(x), most) for x in share]
    order = sorted((int(x) - x, i) for i, x in enumerate(share) if w[i] > 0 and got[i] < most)
    queue, at = [i for _, i in order], 0
    for _ in range(budget - sum(got)):
        if not queue:
            break
        i = queue[at]
        got[i] += 1
        if got[i] == most:
            queue.pop(at)
            at = 0
        else:
            at = (at + 1) % len(queue)
    return got


def test_budgets_are_dealt_as_the_rule_says(spark):
    import random

    rng = random.Random(3)
    cases = [([1.0, 1.0, 2.0, None], 8, 3), ([0.0, None], 5, 2), ([], 4, 2), ([5.0], 9, 4), ([-1.0, 2.0], 3, 3)]
    cases += [([rng.choice([None, 0.0, 1.0, 2.0, 3.5, rng.random()]) for _ in range(rng.randint(1, 7))], rng.randint(0, 25), rng.randint(1, 6)) for _ in range(150)]
    plans = sorted({(b, m) for _, b, m in cases})
    for b, m in plans:
        rows = [w for w, x, y in cases if (x, y) == (b, m)]
        df = spark.createDataFrame([(w,) for w in rows], "w array<double>").coalesce(1)
        assert [r["a"] for r in df.select(sampling.allocation(F.col("w"), b, m).alias("a")).collect()] == [dealt_one_by_one(w, b, m) for w in rows]
    assert dealt_one_by_one([1, 1, 2, None], 8, 3) == [3, 2, 3, 0]


def test_parts(spark):
    both = lambda c: [tuple(p) for p in value(spark, c)[0]]
    assert both(split_parts(lit("a Action: x Action Input: y"), ["Action:", "Action Input:"])) == [("", "a "), ("Action:", " x "), ("Action Input:", " y")]
    assert both(split_parts(lit("aXbYc"), ["X|Y"], regex=True)) == [("", "a"), ("X|Y", "X"), ("", "b"), ("X|Y", "Y"), ("", "c")]
    assert both(loss_scale(lit("q"), lit("t Action: x"), {"Action:": [2.0, 3.0]})) == [("t ", 1.0), ("Action:", 2.0), (" x", 3.0)]
    assert both(loss_scale(lit("has key"), lit("r"), {}, {"key": 5})) == [("r", 5.0)]
    assert both(split_parts(lit("Action:Action:\n"), ["Action:"])) == [("Action:", ""), ("Action:", "\n")]
    assert both(split_parts(lit(""), ["a"])) == [] == both(split_parts(F.lit(None).cast("string"), ["a"])) and both(split_parts(lit("a.b"), ["."])) == [("", "a"), (".", "b")]
    assert both(split_parts(lit("AB"), ["A", "AB"])) == [("A", "B")] and both(split_parts(lit("\\Q^✿"), ["^", "✿"])) == [("", "\\Q"), ("^", ""), ("✿", "")]


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="aAb.\n✿ ", max_size=30), st.lists(st.sampled_from(["a", "A", "ab", ".", "✿", "b\n"]), unique=True, max_size=3))
def test_parts_joined_give_the_text(spark, text, delimiters):
    parts = value(spark, split_parts(lit(text), delimiters))[0]
    assert "".join(p["key"] + p["content"] for p in parts) == text and {p["key"] for p in parts[1:]} <= set(delimiters)
    assert all(d not in p["content"] for p in parts for d in delimiters if len(d) == 1)


def test_reasons_take_the_first_rule(spark):
    rows = spark.createDataFrame([("10", "8", "7", "False"), (None, "1", "1", "1"), ("10", "abc", "9", "0"), ("10", "8", None, "true"), ("10", "9", "9", "True"), ("10", "9", "9", "yes")], "a string, l string, c string, f string")
    got = rows.select(validate.first_reason(validate.quality_rules(*(F.col(x) for x in "alcf"))).alias("r")).collect()
    assert [r["r"] for r in got] == [None, "answer_accuracy", "question_logic", "composite", "should_filter", None]


def test_turns_of_every_length(spark):
    msg = lambda *roles: [(r, f"{r}{i}", None) for i, r in enumerate(roles)]
    rows = [("none", []), ("one", msg("user")), ("two", msg("user", "assistant")), ("three", msg("user", "assistant", "user")), ("four", msg("user", "assistant", "user", "assistant")), ("lead", msg("system", "user", "assistant", "user", "assistant"))]
    got = {r["id"]: [m["content"] for m in r["messages"]] for r in reshape.split_turns(spark.createDataFrame(rows, f"id string, messages {M}"), prefix="P").collect()}
    assert got == {"two": ["Puser0", "assistant1"], "three": ["Puser0", "assistant1", "user2"], "four_turn1": ["Puser0", "assistant1"], "four_turn2": ["Puser2", "assistant3"], "lead_turn1": ["Psystem0", "user1"], "lead_turn2": ["Passistant2", "user3"]}


def test_renames_leave_contested_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Prompt int, Question int, Answer int")
    assert normalize.rename_aliases(df, normalize.RESPONSE_ALIASES).columns == ["Prompt", "Question", "response"]
    assert normalize.strip_prefix(spark.createDataFrame([(1, 2, 3)], "a int, rejected_a int, rejected_b int"), "rejected_").columns == ["a", "b"]


def test_sources_and_subsets():
    for text in ("hf::a/b:x/y#5", "c", "c#7", "ms::d:all", "/tmp/x.jsonl"):
        assert Source.parse(text).text() == text
    meta = Meta(path="zz", subsets=[Subset("a"), Subset("b", weak=True)])
    register(meta, exist_ok=True)
    assert [s.name for s in select_subsets(("all",), meta)] == ["a"]
    for bad in (lambda: register(meta), lambda: select_subsets((), meta)):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError("no error")


def test_ranks_are_dense_and_ordered(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"), F.col("id").alias("k"))
    got = sampling.ranked(df, "v", "r", "k").collect()
    assert all(r["v"] == r["r"] for r in got)


def test_splits_are_disjoint_and_whole(spark):
    df = spark.range(101).withColumn("t", F.when(F.col("id") < 1, "solo").otherwise("many"))
    train, val = sampling.split_train_val(df, "id", 0.1)
    a, b = {r["id"] for r in train.collect()}, {r["id"] for r in val.collect()}
    assert len(b) == 10 and not a & b and len(a | b) == 101
    tests = sampling.split_by_type(df, "t", "id").where("split = 'test'").groupBy("t").count().collect()
    assert {r["t"]: r["count"] for r in tests} == {"solo": 1, "many": 10}
    assert sampling.sample_times(df, 250, "id").count() == 250 and sampling.sample_times(df, 0, "id").count() == 0


def test_large_kinds_are_split_as_the_queries_have_it(spark, tmp_path):
    """More than 20,000 rows of one kind: a fixed number by default, a share in the queries that split by type."""
    import duckdb

    from millrace.plans.curation import curate
    from millrace.queries import ORACLE, QUERIES

    docs = spark.range(20_101).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") < 100, "fr").otherwise("en").alias("lang"), F.lit(300).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).where("doc_id % 5 = 0").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("K6_split_by_type", "A23_split_summary"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({ORACLE[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)
    kinds = sampling.split_by_type(docs, "lang", "doc_id").where("split = 'test'").groupBy("lang").count()
    assert {r["lang"]: r["count"] for r in kinds.collect()} == {"fr": 10, "en": 1000}
    scores = {"answer_accuracy_score": 10, "question_logic_score": 10, "composite_score": 10, "video_dependency_score": 10, "audio_dependency_score": 10}
    rows = spark.range(20_001).select("id", F.lit("t").alias("type"), F.lit(False).alias("should_filter"), *[F.lit(v).alias(k) for k, v in scores.items()])
    assert curate(rows).where("split = 'test'").count() == 2000
    assert QUERIES["K6_split_by_type"](spark, str(tmp_path)).where("split = 'test'").count() == 2010


def test_bins_hold_their_volume(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("batch"), "id", (F.col("id") * 37 % 90 + 1).alias("n"))
    bins = sampling.pack_groups(df, "batch", "id", "n", 100).collect()
    assert all(b["filled"] <= 100 for b in bins) and sorted(i for b in bins for i in b["items"]) == list(range(300))
    total = df.agg(F.sum("n")).first()[0]
    assert len(bins) <= 1.3 * total / 100 + 2


def test_open_bins_go_on_to_the_next_batch(spark):
    import random

    rng = random.Random(9)
    items = [(i, rng.randint(1, 130)) for i in range(57)]

    def plain(data):  # every item looks at every bin
        bins = []
        for i, n in sorted(data, key=lambda x: -x[1]):
            fits = [b for b in bins if sum(m for _, m in b) + n <= 100]
            if fits:
                max(fits, key=lambda b: sum(m for _, m in b)).append((i, n))
            else:
                bins.append([(i, n)])
        return bins

    want, carried = [], []
    for at in range(0, len(items), 10):
        bins = plain(carried + items[at : at + 10])
        carried = bins.pop() if at + 10 < len(items) else []
        want += bins
    df = spark.createDataFrame([(3, i, n) for i, n in items], "s int, i int, n int").repartition(4)
    got = sampling.pack_groups(df, "s", "i", "n", 100, batch=10).orderBy("bin").collect()
    assert [(r["items"], r["filled"]) for r in got] == [([i for i, _ in b], sum(n for _, n in b)) for b in want]
    assert all(r["filled"] <= 100 or len(r["items"]) == 1 for r in got)


def test_ranks_of_a_large_table_are_whole(spark):
    """Wide rows, so that the sample that draws the ranges is not the table."""
    n = 250_000
    df = spark.range(0, n, 1, 7).select(F.xxhash64("id").alias("h"), (F.xxhash64("id") % 9).alias("g"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("wide"), F.lit(None).alias("nothing"))
    for adaptive, parts in (("true", "8"), ("true", "64"), ("false", "8")):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = sampling.ranked(df, "g", "r", "h")
            assert got.columns == [*df.columns, "r"]
            rows = got.select("g", "h", "r").toPandas()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        rows = rows.sort_values(["g", "h"])
        assert rows.r.tolist() == list(range(n))


def test_long_texts_take_linear_time(spark):
    import time

    long_ = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("w"), i % 5000)), " ").alias("t"))
    began = time.perf_counter()
    assert long_.select(R.repetition(F.col("t")).alias("v")).first()["v"] < -0.9
    assert time.perf_counter() - began < 20  # minutes where every n-gram splits the text again


def test_advantages_do_not_depend_on_order(spark):
    rows = [(g, i, float(i * g % 5)) for g in range(4) for i in range(g + 1)]
    for kind in ("grpo", "rloo", "reinforce_plus_plus"):
        one = windows.advantages(spark.createDataFrame(rows, "g int, i int, reward double"), "g", estimator=kind).collect()
        two = windows.advantages(spark.createDataFrame(rows[::-1], "g int, i int, reward double").repartition(3), "g", estimator=kind).collect()
        key = lambda r: (r["g"], r["i"])
        assert [round(r["advantage"], 9) for r in sorted(one, key=key)] == [round(r["advantage"], 9) for r in sorted(two, key=key)]
        assert [r["advantage"] for r in one if r["g"] == 0] == [0.0]


def test_differing_rewards_of_a_request_are_an_error(spark):
    df = spark.createDataFrame([(1, 1, 0, 0.5), (1, 1, 1, 0.7)], "p int, r int, o int, reward double")
    try:
        windows.request_advantages(df, "p", "r", "o").collect()
    except Exception as e:
        assert "rewards differ" in str(e)
    else:
        raise AssertionError("no error")


def test_interleave_keeps_order_and_stops(spark):
    a, b = spark.range(30).select(F.col("id").alias("o")), spark.range(100, 110).select(F.col("id").alias("o"))
    got = reshape.interleave([a, b], [1, 1], "o").orderBy("position").collect()
    for k in (0, 1):
        seen = [r["o"] for r in got if r["source"] == k]
        assert seen == sorted(seen)
    assert got[-1]["o"] in (29, 109) and len({r["position"] for r in got}) == len(got)


def test_text_overlap(spark):
    got = value(spark, metrics.text_overlap(lit("a b c d"), lit("a b c d")), metrics.text_overlap(lit("a b"), lit("x y")))
    assert got[0] == [100.0, 100.0, 100.0, 100.0] and got[1][:3] == [0.0, 0.0, 0.0]


def test_whole_series_are_smoothed(spark):
    import random

    from millrace.operators import windows

    rng = random.Random(6)
    rows = [(rng.choice("ab"), t, rng.gauss(0, 10)) for t in range(150)] + [("c", 0, 2.0)]
    want = {}
    for key in "abc":
        x = n = 0.0
        for i, (_, _, v) in enumerate((r for r in rows if r[0] == key), 1):
            x, n = x * 0.9 + v, n * 0.9 + 1
            want[key, i] = x / n
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t int, x double").repartition(5)
    for block in (8, 1024):
        got = {(r["k"], r["i"]): r["v"] for r in windows.smoothed_series(df, "k", "x", "t", block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_smoothing_query_has_every_event(spark):
    from millrace.queries import QUERIES

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert QUERIES["W8_smoothing"](spark, "/root/testdata/sf0.001").count() == events.count()


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_text_overlap_query_compares_whole_turns(spark, tmp_path):
    import random

    from millrace.queries import QUERIES

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n)) for n in (90, 130, 70)]
    turns = [(7, 2 * i + 1, "assistant", t) for i, t in enumerate(texts)] + [(7, 2 * i, "user", "hello") for i in range(3)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["turn"]: r for r in QUERIES["A11_text_overlap"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 3, 5} and got[5]["rouge_l"] == 0
    for i in (0, 1):
        h, r = texts[i].split(), texts[i + 1].split()
        common = sum(min(h.count(w), r.count(w)) for w in set(h))
        assert abs(got[2 * i + 1]["rouge_1"] - 200 * common / (len(h) + len(r))) < 1e-6
        assert abs(got[2 * i + 1]["rouge_l"] - 200 * plain_lcs(h, r) / (len(h) + len(r))) < 1e-6


@settings(max_examples=10, deadline=None)
@given(st.text(alphabet="ab \n\t\r  é<", max_size=20))
def test_prefix_and_strip_like_python(spark, text):
    from millrace.functions.text import strip, words

    once = normalize.prepend_once(lit(text))
    got = value(spark, once, normalize.prepend_once(once), strip(lit(text)), words(lit(text)))
    assert got[0] == got[1] and got[2] == text.strip() and got[3] == text.split()


def test_sessions_of_a_hot_key_go_over_partitions(spark):
    rows = [(1 if i % 3 else None, i, i % 7 == 0) for i in range(4000)] + [(k, k, True) for k in range(2, 60)]
    want, seen = {}, {}
    for k, t, b in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        seen[k] = seen.get(k, 0) + b
        want[k, t] = seen[k]
    df = spark.createDataFrame(rows, "k int, t int, b boolean").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = windows.sessions(df, "k", "t", F.col("b")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r["k"], r["t"]): r["session"] for r in got} == want and len(got) == len(rows)


def test_layouts_with_drawn_questions(spark):
    from millrace.plans.presets import PIXELPROSE_QUESTIONS, PRESETS, SA1B_QUESTIONS

    both = lambda df: [(r["messages"][0]["content"], r["messages"][1]["content"]) for r in df.collect()]
    rows = spark.createDataFrame([(k, f"cap {k}", "u", f"{{'a': 1, 'global_caption': 'it\\'s {k}'}}", f"This image displays: x{k} ", ["q0", "q1", "q2"], ["a0", "a1", "a2"], "i") for k in range(30)], "key long, global_caption string, url string, cap_seg string, vlm_caption string, questions array<string>, answers array<string>, image string")
    got = both(PRESETS["sa1b"](rows.withColumn("opensource_url", F.col("url"))))
    assert {q for q, _ in got} == set(SA1B_QUESTIONS) and {a for _, a in got} == {f"cap {k}" for k in range(30)}
    assert {a for _, a in both(PRESETS["sa1b_dense"](rows))} == {f"it's {k}" for k in range(30)}
    got = both(PRESETS["pixelprose"](rows))
    assert {q for q, _ in got} == set(PIXELPROSE_QUESTIONS) and {a for _, a in got} == {f"x{k}" for k in range(30)}
    got = both(PRESETS["ocrvqa"](rows))
    assert {q for q, _ in got} == {"q0", "q1", "q2"} and all(q[1:] == a[1:] for q, a in got)


def test_keys_of_cached_rows_are_computed_once(spark):
    """Both results of a join with a cache read the keys; neither plan computes them again."""
    from millrace.operators import reshape

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    cache = df.where("id = 1").select(reshape.row_key("id", "text").alias("row_md5"), F.lit(5).cast("long").alias("n_choices"))
    found, todo = reshape.cached_join(df, cache, ["id", "text"], 4)
    assert found.count() == 2 and todo.count() == 1
    assert all("md5(" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (found, todo))
