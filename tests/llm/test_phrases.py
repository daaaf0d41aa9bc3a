"""Collocations against plain counting."""

import random
import re
from collections import Counter

from cases import LONG, crowded, frame

from millrace.llm import phrases


def brute(rows, longest=3, least=10, swallowed=50, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    found = {}
    for (lang, w), a in candidates.items():
        if inside[lang, w] and 100 * inside[lang, w] >= swallowed * a:
            continue
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def check(spark, rows, **more):
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)], frame(spark, []).schema)
    plain = {k: v for k, v in more.items() if k != "bits"}
    assert sorted(map(tuple, phrases.collocations(df, **more).collect())) == brute(rows, **plain)


def made(seed, n=60):
    draw = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "hall", "naïve", "ÉTÉ", "a\x00b", "x-y", "'s", "　z"]
    gaps = [" ", " ", "  ", "\t", ". ", ", ", "\n", "; ", " \x0b"]
    return [(draw.choice(["en", "fr", None, "und"]), "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randrange(80)))) for _ in range(n)]


def test_plain_counting(spark):
    for bits in (8, 20):
        check(spark, made(bits) + [(None, None), ("en", ""), ("en", " . , ")], bits=bits)


def test_longer_phrases_and_other_limits(spark):
    check(spark, made(3), longest=4, least=3, swallowed=30, bits=16, top=5)
    check(spark, made(4), longest=2, least=2, bits=16)
    rows = [("en", "a b c " * 5), ("en", "a b, b c. a b c"), ("fr", "a b")] * 3  # ties, and a phrase within a phrase
    check(spark, rows, bits=12)


def test_tables_given_out_early(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "RECENT", 5)
    check(spark, made(5), bits=10)


def test_hard_rows(spark):
    rows = frame(spark)
    want = brute([(r["lang"], r["text"]) for r in rows.collect()])
    assert any(r[0] == "en" for r in want)  # from the long text
    for df in (rows, crowded(rows).repartition(3)):
        assert sorted(map(tuple, phrases.collocations(df, bits=20).collect())) == want
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert len(LONG) > 100_000
