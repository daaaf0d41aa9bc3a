import hashlib
import random
import re

from cases import DOCS, crowded, frame
from pyspark.sql import functions as F

from millrace.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w = split(text)
    hit, found, longest = set(), set(), 0
    for name, item in items:
        q = split(item)
        k = min(13, len(q))
        for j in range(len(q) - k + 1 if q else 0):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == q[j : j + k]:
                    found.add(str(name) if name is not None else "null")
                    hit.update(range(i, i + k))
                    n = k
                    while i + n < len(w) and j + n < len(q) and w[i + n] == q[j + n]:
                        n += 1
                    longest = max(longest, n)
    names = sorted(found)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), longest or None


def check(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.flagged(crowded(docs), bench).select("doc_id", "contamination.*").collect()
    for r in rows:
        want = brute(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"], r["longest_match"]) == want, texts[r["doc_id"]]
    kept = {r["doc_id"] for r in D.decontaminate(docs, bench).collect()}
    assert kept == {i for i, t in enumerate(texts) if not brute(t, items)[4]}


def test_random_texts(spark):
    rng = random.Random(1)
    words = [*"abcdef", "Ü", "x1"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 12, 13, 14, 30])))) for i in range(25)] + [(3, "a b c d"), (None, "é é é"), (77, None)]
    items = [x for x in items if len(split(x[1])) != 1]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 200))) for _ in range(60)]
    for k in range(40):
        q = split(rng.choice(items)[1])
        texts.append(" ".join(rng.choices(words, k=k) + q[rng.randint(0, 3) :] + ["ZZ"] * rng.randint(0, 300)).upper())
    check(spark, [*texts, None, "", " ", "a " * 3000], items)


def test_one_word_item_and_hard_rows(spark):
    check(spark, [r["text"] for r in frame(spark).collect()], [(1, "FOX"), (2, "the quick brown"), (3, "no id here at all")])


def test_empty_tables(spark):
    check(spark, ["a b", None], [])
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.decontaminate(frame(spark, []), bench).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 40)
    check(spark, ["one two three four five six", "x y one two three y z", "four five six"], [(i, t) for i, t in enumerate(["one two three", "three four five six", "y z", "q r s t u v w"])])


def test_driver_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    rows = D.flagged(docs, bench).where(F.col("contamination")["n_hit"] > 0).select("text", "contamination.*").collect()
    assert rows
    for r in rows[:12]:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"], r["longest_match"]) == brute(r["text"][:60000], items) or len(r["text"]) > 60000
