"""The prefix trie against plain tries: families, long conversations in sections, and many ends."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every node by its whole prefix. Turns are told apart by ``turn``."""
    own = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    convs = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        base = [] if c is None else own.get(c - (abs(c) % 20) * (1 if c > 0 else -1), [])
        convs[c] = tuple(base[:h] + turns[h:])
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    kids, below = {}, {p: [0, 0] for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, ids in nodes.items():
        saved = (len(ids) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]][0] += p not in kids
            below[p[:d]][1] += saved
    out = []
    for p, ids in nodes.items():
        ends = ",".join(map(str, sorted(c for c in ids if c is not None and convs[c] == p)))
        out.append((least(ids), len(p), least(nodes[p[:-1]]) if p else None, len(ids), kids.get(p, 0), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r[:7]) + (r[7],))


def check(spark, rows, **more):
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), **more)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert order(map(tuple, got.collect())) == order(brute(rows))


def talk(c, n, words="word and more"):
    return [(c, t, ("user", "assistant")[t % 2], f"{words} {t}") for t in range(n)]


FAMILIES = [r for c in (0, 1, 2, 3, 7, 19, 20, 23, 25, 41, 59, 101, -3, -20, -41) for r in talk(c, 1 + abs(c) % 6, "same" if c % 2 else f"own {c}")]


def test_families(spark):
    check(spark, FAMILIES)


def test_nulls_empty_and_repeated_rows(spark):
    rows = FAMILIES + [(200, None, None, None), (200, 1, "user", ""), (200, 1, "user", ""), (201, 5, "user", " \t\n"), (None, 0, "user", "no id"), (None, 1, None, "x y"), (260, 0, None, "éà ß")]
    check(spark, rows)
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    check(spark, [(5, 0, "user", "alone")])
    check(spark, [(None, 0, "user", "alone")])


def test_copies_of_long_conversations(spark):
    """Sections of four turns; copies in several families share nodes at any depth."""
    rows = FAMILIES + talk(60, 37) + talk(80, 37) + talk(81, 30) + talk(100, 23) + talk(105, 37) + talk(120, 2) + talk(121, 11) + talk(None, 9)
    check(spark, rows, section=4)
    check(spark, rows, section=16)
    check(spark, rows)


def test_many_ends_at_one_node(spark):
    rows = FAMILIES + [r for c in range(300, 800) for r in talk(c, 1 + c % 3, "hot")]
    check(spark, rows, ends=7)
    check(spark, rows)


def test_other_columns_and_ties(spark):
    rows = spark.createDataFrame(FAMILIES, SCHEMA)
    crowded = rows.select("*", *[F.lit("x").alias(c) for c in ("c", "rank", "h1", "words", "depth", "base", "place", "k1")])
    assert order(map(tuple, prefix_trie.trie(crowded).collect())) == order(brute(FAMILIES))
    tied = [(0, 1, "user", "b"), (0, 1, "user", "a"), (0, 1, "user", "a")]
    first = [tuple(r) for r in prefix_trie.trie(spark.createDataFrame(tied, SCHEMA)).collect()]
    assert order(first) == order([tuple(r) for r in prefix_trie.trie(spark.createDataFrame(tied[::-1], SCHEMA).repartition(3)).collect()]) and len(first) == 4


def test_a_section_holds_what_a_base_gives(spark):
    with pytest.raises(ValueError):
        prefix_trie.trie(spark.createDataFrame(FAMILIES, SCHEMA), section=3)
