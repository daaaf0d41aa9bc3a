import zlib

import numpy as np
import public_tokenizers
from cases import crowded, frame
from tokenizers import Tokenizer

from millrace.llm.token_files import map_shard, read_manifest, read_token_files, write_token_files
from millrace.llm.runtime import SharedFiles, scratch

WORD = public_tokenizers.path("word_bpe_49k.json")


def plain(rows):
    tok = Tokenizer.from_file(WORD)
    return {(r["doc_id"], r["text"]): [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in rows}


def test_files_match_the_library(spark):
    docs = frame(spark)
    root = scratch(spark, "t")
    write_token_files(crowded(docs), root, WORD, end_id=1, shards=3)
    got = read_token_files(spark, root).toPandas()
    want = plain(docs.collect())
    assert sorted(got.ids_crc32) == sorted(zlib.crc32(np.array(want[r["doc_id"], r["text"]], "<u4").tobytes()) for r in docs.collect())
    got = got.sort_values("start")
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]
    keys = got.doc_id.fillna(-(10**9)).tolist()
    assert keys == sorted(keys)
    manifest = read_manifest(root)
    tokens = sum(len(map_shard(SharedFiles(root), s["shard"], manifest["dtype"])[3]) for s in manifest["shards"])
    assert tokens == sum(got.n_tokens)


def test_empty_table(spark):
    root = scratch(spark, "t")
    write_token_files(frame(spark, []), root, WORD, end_id=1, shards=3)
    assert read_token_files(spark, root).count() == 0


def test_ids_are_the_library_s_for_all_kinds_of_text():
    import random

    from millrace.llm.memo_tokenizer import MemoTokenizer

    rng = random.Random(5)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "  ", "\n", "a", "Hello", "'s", "don't", "12", "é", "你好", "x́", "\u00a0", "!?", "<|endof", "text|>", "İ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        for plain_ in (False, True):
            tok = Tokenizer.from_file(public_tokenizers.path(name))
            tok.encode_special_tokens = plain_
            own = MemoTokenizer(public_tokenizers.path(name), 500, plain_)
            got = [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)]
            assert got == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_strings_of_added_tokens_are_those_tokens(spark):
    texts = ["a <|endoftext|> b", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>"]
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    root = scratch(spark, "t")
    write_token_files(docs, root, WORD, end_id=1, shards=2)
    want = plain(docs.collect())
    got = read_token_files(spark, root).orderBy("doc_id").collect()
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(want[i, t], "<u4")) for i, t in enumerate(texts)]


def test_shards_are_bounded_and_whole(spark, tmp_path):
    rows = [(i if i % 11 else None, "word and " * (i * 7 % 40), "en", "s", 1) for i in range(300)] + [(500, "long text " * 5000, "en", "s", 1)]
    docs = frame(spark, rows)
    sets = []
    for name, bounds in (("whole", {}), ("bytes", {"shard_bytes": 2000}), ("docs", {"shard_docs": 7, "task_bytes": 3000})):
        root = f"{tmp_path}/{name}"
        manifest = write_token_files(docs, root, WORD, end_id=1, **bounds)
        got = read_token_files(spark, root).toPandas().sort_values("start")
        sets.append([tuple(r) for r in got.fillna(-1).itertuples(index=False)])
        assert manifest == read_manifest(root) and sum(s["n_docs"] for s in manifest["shards"]) == len(rows)
        if name == "bytes":
            width = np.dtype(manifest["dtype"]).itemsize
            small = [s for s in manifest["shards"] if s["n_docs"] > 1]
            assert len(small) >= sum(s["n_tokens"] for s in small) * width / 2000 and all(s["n_tokens"] * width <= 2000 or s["n_docs"] == 1 for s in manifest["shards"])
        if name == "docs":
            assert all(s["n_docs"] <= 7 for s in manifest["shards"])
    assert sets[0] == sets[1] == sets[2]
    assert [(r[1], r[1] + r[2]) for r in sets[0]][1:] == [(a[1] + a[2], a[1] + a[2] + b[2]) for a, b in zip(sets[0], sets[0][1:])]
