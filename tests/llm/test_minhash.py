import random
import re

import numpy as np
import pytest
from cases import DOCS, crowded, frame

from millrace.llm import minhash, wordhash
from millrace.llm.minhash import Banding, circulant_signatures, components, near_duplicates


def word_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    sets = [(i, word_shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(k)
    seen = set()
    for group in by.values():
        for x in range(len(group)):
            for y in range(x):
                pair = (group[y], group[x])
                if pair in seen:
                    continue
                seen.add(pair)
                a, b = sets[pair[0]][1], sets[pair[1]][1]
                if 100 * len(a & b) >= 75 * len(a | b):
                    parent[find(pair[0])] = find(pair[1])
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return [(i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)]


def same(spark, rows, banding=Banding()):
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)
    got = near_duplicates(crowded(docs), banding).collect()
    key = lambda r: tuple(-(10**9) if x is None else x for x in r)
    assert sorted((key((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got)) == sorted(map(key, brute(rows)))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_hard_rows(spark):
    same(spark, [(r["doc_id"], r["text"]) for r in frame(spark).collect()])


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).count() == 0


def test_documents(spark):
    same(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def family(rng, n, edits):
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        yield " ".join(w)


@pytest.mark.parametrize("chunk", [8, 256])
def test_large_families_near_the_threshold(spark, chunk):
    rng = random.Random(3)
    texts = [*family(rng, 90, 4), *family(rng, 40, 6), *family(rng, 5, 1)]
    texts += ["shared passage " * 30 + " ".join(f"own{i}x{k}" for k in range(60)) for i in range(30)]
    same(spark, [(1000 - i, t) for i, t in enumerate(texts)], Banding(chunk=chunk))


def test_coordinates_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(5)
    for total, common in ((40, 30), (400, 300), (3000, 300)):
        agree = []
        for _ in range(40):
            x = rng.integers(0, 1 << 63, total, dtype=np.uint64)
            lone = (total - common) // 2
            a, b = np.unique(x[: common + lone]), np.unique(np.r_[x[:common], x[common + lone :]])
            s = circulant_signatures([a, b], 200)
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - common / total) < 0.03
        assert np.std(agree) < 2.5 * (0.25 / 200) ** 0.5


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000), (2000, 1500)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[i] for i in (1000, 1500, 2000)} == {1000} and len(got) == 304


def test_words_and_separators():
    found = wordhash.words([b"A bc\tA  a", b"", b"bc "], wordhash.WHITE)
    h = found.hashes
    assert found.edges.tolist() == [0, 4, 4, 5] and h[0] == h[2] == h[3] and h[1] == h[4] and h[0] != h[1]
    assert len(minhash.sign(["a b c d e f", None, " "], Banding())[0]) == 3


def test_sets_that_have_the_same_node_are_told_apart(spark):
    rng = random.Random(12)
    texts = [*family(rng, 40, 3), *family(rng, 40, 5), *family(rng, 40, 0)]
    same(spark, list(enumerate(texts)), Banding(node_bits=5))
