"""Words of texts that put no blanks between them, by the most probable path.

A run of letters is a graph whose edges are the words of a table that lie in it, and
every single letter. A path through the run is as probable as the product of its words'
shares of all counts (a letter that is no word counts once), and the most probable one
is taken; of equally probable ones, that whose first word is longest, and so on.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.workers import written

HAN = "[一-鿕]+"
OTHER = r"[A-Za-z0-9]+(?:\.[0-9]+)?%?|\S"
BOUND = 64 << 20


def word_table(df: DataFrame, text: str) -> DataFrame:
    """(word, n): how often each word between blanks occurs."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def sizes_by_start(counts: dict[str, int]) -> dict[str, list[int]]:
    """The lengths of the words of more than one letter that begin with each two letters, shortest first."""
    found: dict[str, set[int]] = {}
    for word, n in counts.items():
        if n and len(word) > 1:
            found.setdefault(word[:2], set()).add(len(word))
    return {start: sorted(sizes) for start, sizes in found.items()}


def best_path(run: str, counts: dict[str, int], total: int, longest: int, starts: dict[str, list[int]] | None = None) -> list[str]:
    """The words of one run; ``starts`` is ``sizes_by_start`` of the table, so that only lengths that words have are tried."""
    starts = sizes_by_start(counts) if starts is None else starts
    end = len(run)
    score, step = [0.0] * (end + 1), [1] * (end + 1)
    base = math.log(max(total, 1))
    for i in range(end - 1, -1, -1):
        best = math.log(max(counts.get(run[i], 0), 1)) - base + score[i + 1]
        for size in starts.get(run[i : i + 2], ()):
            if size > longest or i + size > end:
                break
            n = counts.get(run[i : i + size], 0)
            if n:
                way = math.log(n) - base + score[i + size]
                if way >= best:
                    best, step[i] = way, size
        score[i] = best
    out, i = [], 0
    while i < end:
        out.append(run[i : i + step[i]])
        i += step[i]
    return out


def segmented(df: DataFrame, text: str, words: DataFrame, into: str, letters: str = HAN, bound: int = BOUND) -> DataFrame:
    """``df`` with ``into``, the words of ``text`` in order: an array without blanks; null and blank texts have none.

    ``words`` is (word, n). Runs of ``letters`` go by the path; elsewhere Latin letters and digits make words, and any other sign
    is one by itself. A table whose words take up to ``bound`` bytes is broadcast; a larger one is joined with the parts of each
    different text that may be words, and each text is cut by those of them that are. Both ways give the same words. Words
    repeated in the table are added up; null, empty and uncounted ones are left out.
    """
    words = written(words.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0 and word <> ''"), "words")
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.length("word")), F.lit(1)), F.coalesce(F.sum(F.octet_length("word") + 8), F.lit(0))).first()
    total, longest = int(size[0]), int(size[1])
    parts = re.compile(f"({letters})|{OTHER}")

    def cut(text: str | None, counts: dict[str, int], starts: dict[str, list[int]]) -> list[str]:
        found = []
        for m in parts.finditer(text or ""):
            found.extend(best_path(m[1], counts, total, longest, starts) if m[1] else [m[0]])
        return found

    if size[2] <= bound:
        counts = {r["word"]: r["n"] for r in words.toLocalIterator()}
        table = df.sparkSession.sparkContext.broadcast((counts, sizes_by_start(counts)))

        @F.pandas_udf("array<string>")
        def by_table(texts: pd.Series) -> pd.Series:
            counts, starts = table.value
            return pd.Series([cut(t, counts, starts) for t in texts], dtype=object)

        return df.withColumn(into, by_table(F.col(text)))

    @F.pandas_udf("array<string>")
    def candidates(texts: pd.Series) -> pd.Series:
        def of(t):
            runs = [m[1] for m in parts.finditer(t) if m[1]]
            return list({r[i : i + k] for r in runs for i in range(len(r)) for k in range(1, min(longest, len(r) - i) + 1)})

        return pd.Series([of(t) for t in texts], dtype=object)

    @F.pandas_udf("array<string>")
    def by_own(texts: pd.Series, own: pd.Series, n: pd.Series) -> pd.Series:
        tables = (dict(zip(w, c)) if w is not None else {} for w, c in zip(own, n))
        return pd.Series([cut(t, table, sizes_by_start(table)) for t, table in zip(texts, tables)], dtype=object)

    def key(c: str) -> Column:
        return F.sha2(F.col(c), 256)

    texts = df.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    edges = texts.select(key("_text").alias("_key"), F.explode(candidates("_text")).alias("word")).join(words, "word")
    own = edges.groupBy("_key").agg(F.collect_list(F.struct("word", "n")).alias("_own"))
    cuts = texts.withColumn("_key", key("_text")).join(own, "_key", "left").select("_key", by_own("_text", F.col("_own.word"), F.col("_own.n")).alias("_words"))
    none = F.array().cast("array<string>")
    return df.join(cuts, key(text) == F.col("_key"), "left").select(*df.columns, F.coalesce("_words", none).alias(into))
