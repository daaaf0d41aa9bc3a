"""Byte-pair encoding against the tokenizers library, and the merge tree against plain merging."""

import hashlib
import random

import public_tokenizers
import pytest
from cases import crowded, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe

PATHS = {n: public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k")}
CODECS = {n: (bpe.Codec(p), Tokenizer.from_file(p)) for n, p in PATHS.items()}
TEXTS = [
    "", " ", "a", "Hello, World's best!!  3.14  \t\n x", "naïve ßtraße İstanbul’s 你好 　 x́ don't 'S'LL!! \t\n 12 34", "ΑΣ Σας ΟΔΟΣ", "x\x1c\x1d\x00\x85\xa0 y", "é ́ a",
    "<|endoftext|>a<|startoftext|><|endoftext|> b", "<|endoftext", "😀👨‍👩‍👧 नमस्ते ½²ⅷ", "a" * 3000, "the " * 500, "​﻿᠎",
]


def plain_merges(symbols, ranks, merged):
    symbols = list(symbols)
    while True:
        found = [(ranks[k], i) for i in range(len(symbols) - 1) if (k := symbols[i] << 32 | symbols[i + 1]) in ranks]
        if not found:
            return symbols
        rank, i = min(found)
        symbols[i : i + 2] = [merged[rank]]


@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.integers(0, 10**6))
@settings(max_examples=200, deadline=None)
def test_tree_merges_lowest_rank_leftmost_first(symbols, seed):
    draw = random.Random(seed)
    pairs = draw.sample([(a, b) for a in range(9) for b in range(9)], 30)
    ranks, merged = {a << 32 | b: r for r, (a, b) in enumerate(pairs)}, [draw.randrange(9) for _ in pairs]
    assert bpe.MergeTree(list(symbols), ranks, merged).run() == plain_merges(symbols, ranks, merged)


@pytest.mark.parametrize("name", CODECS)
@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(name, text):
    codec, library = CODECS[name]
    want = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text).tolist() == want
    assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


@given(st.text(st.characters(codec="utf-8", exclude_categories=("Cn", "Co")), max_size=80))
@settings(max_examples=300, deadline=None)
def test_as_the_library_on_any_text(text):
    for codec, library in CODECS.values():
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == want
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


@given(st.lists(st.integers(-1, 60_000), max_size=30))
@settings(max_examples=100, deadline=None)
def test_any_ids_decode(ids):
    for codec, library in CODECS.values():
        assert codec.decode(ids) == library.decode([i for i in ids if i >= 0], skip_special_tokens=False)


def test_long_texts_go_in_parts(monkeypatch):
    text = "it's the  end of\tthe world, and I'd say  so. " * 40 + "x" * 50 + "  y"
    want = {n: c.encode(text).tolist() for n, (c, _) in CODECS.items()}
    monkeypatch.setattr(bpe, "PART", 7)
    for n, (c, _) in CODECS.items():
        assert len(list(c._parts(text))) > 100 and c.encode(text).tolist() == want[n]


def test_a_pretoken_of_any_length():
    codec, library = CODECS["word_bpe_49k"]
    text = "".join(random.Random(1).choices("aeinorst", k=40_000))
    assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_full_memo_changes_nothing():
    codec = bpe.Codec(PATHS["word_bpe_49k"], capacity=3)
    for text in TEXTS * 2:
        assert codec.encode(text).tolist() == CODECS["word_bpe_49k"][0].encode(text).tolist() and len(codec.memo) < 40


def test_columns_and_hard_rows(spark):
    path = PATHS["word_bpe_49k"]
    library = CODECS["word_bpe_49k"][1]
    rows = crowded(frame(spark))
    found = bpe.round_trips(rows, path).collect()
    texts = [r["text"] for r in rows.collect()]
    assert [r["doc_id"] for r in found] == [r["doc_id"] for r in rows.collect()]
    for r, text in zip(found, texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trips(frame(spark, []), path).collect() == []
    coded = rows.select("*", bpe.encode(F.col("text"), path).alias("ids")).withColumn("back", bpe.decode(F.col("ids"), path))
    for r in coded.collect():
        want = None if r["text"] is None else library.encode(r["text"], add_special_tokens=False).ids
        assert r["ids"] == want and r["back"] == (None if want is None else library.decode(want, skip_special_tokens=False))
