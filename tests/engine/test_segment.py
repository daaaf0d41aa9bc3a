"""Segmentation by the most probable path, and means of a corpus."""

import itertools
import math
import random

from millrace.operators import metrics, segment
from millrace.queries import QUERIES

TABLE = [("北京", 50), ("大学", 40), ("北京大学", 30), ("学生", 45), ("大学生", 20), ("生前", 9), ("来", 30), ("前来", 10), (None, 5), ("", 7), ("到", 0)]
TEXTS = ["北京大学生前来", "我 在 北京大学，rate 3.5% ok!", "", None, "  \n", "学生" * 5, "北京大学生前来", "abc"]


def plain(run, counts):
    """Every way to cut a run, the most probable one first, longer first words before shorter ones."""
    total, ways = sum(counts.values()), []
    for cuts in itertools.product((0, 1), repeat=len(run) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(run)]
        words = [run[a:b] for a, b in zip(at, at[1:])]
        if all(w in counts or len(w) == 1 for w in words):
            ways.append((-round(sum(math.log(counts.get(w, 1) / total) for w in words), 9), [-len(w) for w in words], words))
    return min(ways)[2]


def test_both_ways_cut_as_every_path_compared(spark):
    words = spark.createDataFrame(TABLE, "word string, n long")
    counts = {w: n for w, n in TABLE if w and n}
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "id int, text string, word string").repartition(3)
    small = segment.segmented(df, "text", words, "cut")
    large = segment.segmented(df, "text", words, "cut", bound=0)
    assert small.columns == large.columns == ["id", "text", "word", "cut"]
    got = {r["id"]: r["cut"] for r in small.collect()}
    assert got == {r["id"]: r["cut"] for r in large.collect()} and len(got) == len(TEXTS)
    assert got[0] == got[6] == plain(TEXTS[0], counts) and got[5] == plain(TEXTS[5], counts)
    assert got[1] == ["我", "在", "北京大学", "，", "rate", "3.5%", "ok", "!"]
    assert got[2] == got[3] == got[4] == [] and got[7] == ["abc"]


def test_random_runs():
    rng = random.Random(3)
    for _ in range(200):
        counts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): rng.randint(1, 30) for _ in range(6)}
        run = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        got, want = segment.best_path(run, counts, sum(counts.values()), max(map(len, counts))), plain(run, counts)
        total = sum(counts.values())
        assert "".join(got) == run
        assert abs(sum(math.log(counts.get(w, 1) / total) for w in got) - sum(math.log(counts.get(w, 1) / total) for w in want)) < 1e-9


def test_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], "word string, n long")
    df = spark.createDataFrame([("北京",), ("学" * 50_000,)], "text string")
    for bound in (segment.BOUND, -1):
        got = [r["cut"] for r in segment.segmented(df, "text", none, "cut", bound=bound).collect()]
        assert sorted(map(len, got)) == [2, 50_000]
        assert segment.segmented(df.limit(0), "text", none, "cut", bound=bound).count() == 0


def test_means_leave_out_empty_sides(spark):
    rows = [(["a", "b", "c", "d"], ["a", "b", "c", "d"]), (["a", "b"], ["x", "y"]), ([], ["a"]), (["a"], None), (None, None)]
    df = spark.createDataFrame(rows, "p array<string>, t array<string>")
    assert metrics.corpus_overlap(df, "p", "t").first().asDict() == {"rouge_1": 50.0, "rouge_2": 50.0, "rouge_l": 50.0, "bleu_4": 50.0, "n": 2}
    assert metrics.corpus_overlap(df.limit(0), "p", "t").first().asDict() == {"rouge_1": 0.0, "rouge_2": 0.0, "rouge_l": 0.0, "bleu_4": 0.0, "n": 0}


def test_query_is_the_mean_of_brute_force(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["ab", "abc", "c", "dd"]) for _ in range(rng.randint(1, 4))) for _ in range(8)]
    turns = [(i // 4, i % 4, "assistant", t) for i, t in enumerate(texts)] + [(0, 9, "assistant", " "), (0, 10, "assistant", None)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    counts = {}
    for w in " ".join(texts).split():
        counts[w] = counts.get(w, 0) + 1
    cut = [plain("".join(t.split()), counts) for t in texts]
    scores = []
    for i in (0, 1, 2, 4, 5, 6):
        a, b = cut[i], cut[i + 1]
        scores.append(200 * sum(min(a.count(w), b.count(w)) for w in set(a)) / (len(a) + len(b)))
    got = QUERIES["A11_corpus_means"](spark, str(tmp_path)).first()
    assert got["n"] == 6 and abs(got["rouge_1"] - sum(scores) / 6) < 1e-5


def test_only_lengths_that_words_have_are_tried():
    """A long word in the table does not make every place of a run cost its length."""

    class Counted(dict):
        tried = 0

        def get(self, *key):
            Counted.tried += 1
            return super().get(*key)

    counts = Counted({"ab": 4, "ba": 2, "z" * 900: 1})
    got = segment.best_path("ab" * 1000, counts, 7, 900)
    assert got == ["ab"] * 1000 and Counted.tried <= 2 * 2000
