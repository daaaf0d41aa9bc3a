import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from cases import crowded, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm.packing import SumIndex, _plan, pack, plan_packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_and_sequences(spark):
    docs = frame(spark)
    got = pack(crowded(docs), BYTE, end_id=2).toPandas()
    tok = Tokenizer.from_file(BYTE)
    want = []
    for r in docs.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        want += [(r["doc_id"] or -1, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(want)
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1]]
        assert rows.length.sum() <= 1024


def test_empty_table(spark):
    assert pack(frame(spark, []), BYTE, end_id=2).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_uses_every_piece_once(histogram):
    plan = plan_packing(histogram, 64)
    used = defaultdict(int)
    for lengths, times in plan.patterns:
        assert sum(lengths) <= 64 and times > 0
        for n in lengths:
            used[n] += times
    assert used == histogram


def test_exact_complements_fill_every_sequence():
    assert plan_packing({40: 3, 24: 3, 30: 2, 20: 2, 14: 2, 64: 1}, 64).sequences == 6
    assert plan_packing({34: 2, 16: 2, 8: 2, 6: 2}, 64).sequences == 2  # 34 + 16 + 8 + 6


def test_the_index_finds_sums_of_two_and_three():
    """Best fit alone would open three sequences: 6 + 3, 5 + 2 + 2, 2."""
    plan = plan_packing({6: 1, 5: 1, 3: 1, 2: 3}, 10)
    assert sorted(plan.patterns) == [((5, 3, 2), 1), ((6, 2, 2), 1)]
    assert _plan({6: 1, 5: 1, 3: 1, 2: 3}, 10, 1).sequences == 3
    assert ((30, 16, 11, 7), 4) in _plan({30: 4, 16: 4, 11: 4, 7: 4}, 64, 3).patterns


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 3), max_size=8), st.integers(1, 24))
def test_lookups_match_all_combinations(histogram, held):
    from itertools import combinations_with_replacement as combinations

    have = [histogram.get(n, 0) for n in range(41)]
    index = SumIndex(have, 3)
    if have[held]:
        for gap in range(1, 40):
            for size in (1, 2, 3):
                want = [c for c in combinations(sorted(histogram), size) if sum(c) == gap and index.there(*c, held)]
                got = index.filling(gap, held, size)
                assert (got is None) == (not want) and (got is None or tuple(sorted(got)) in want)


def test_strings_of_added_tokens_are_those_tokens(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", " <|ENDOFTEXT|>", "x<|endof<|endoftext|>text|>"]
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    tok = Tokenizer.from_file(BYTE)
    want = [zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")) for t in texts]
    assert [r["ids_crc32"] for r in pack(docs, BYTE, end_id=2).orderBy("doc_id").collect()] == want
    assert 50256 in tok.encode(texts[0], add_special_tokens=False).ids
