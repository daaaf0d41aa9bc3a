import random
import re

from cases import DOCS, HARD, crowded, frame
from pyspark.sql import functions as F

from millrace.llm.passages import LAST, Setting, clusters, remove_repeats, without_words


def prose(rng, n, words=None):
    """``n`` words in sentences of 4 to 14; the last word is like no other."""
    out = []
    while len(out) < n:
        s = [rng.choice(words) if words else f"w{rng.randrange(10**6)}" for _ in range(rng.randint(4, 14))]
        out += [s[0].title(), *s[1:-1], s[-1] + "."]
    return " ".join(out[: n - 1]) + f" e{rng.randrange(10**9)}."


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


def test_repeated_passages_go_and_clean_documents_stay(spark):
    rng = random.Random(4)
    passage, line = prose(rng, 60), prose(rng, 80)
    near = line.split()
    near[40] = "changed"
    clean = [prose(rng, 200) + "\n" + prose(rng, 50) for _ in range(6)]
    texts = [*clean, "", None]
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 40) for _ in range(5)]  # inside a line
    texts += [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 40)]
    texts += [prose(rng, 40) + "\n" + line, prose(rng, 40) + "\n" + " ".join(near)]
    texts += [clean[0].split("\n")[0]]
    docs = crowded(docs_of(spark, texts))
    got = {r["doc_id"]: r["text"] for r in remove_repeats(docs).collect()}
    assert remove_repeats(docs).columns == docs.columns
    for i in range(len(texts)):
        if i < 8:
            assert got[i] == texts[i]
    holders = [i for i, t in got.items() if t and passage in t]
    assert holders == [8]
    for i in range(9, 14):
        left = [w for w in texts[i].split() if w not in passage.split()]
        assert sum(w in passage.split() for w in got[i].split()) <= 2 and all(w in got[i] for w in left)
    assert line in got[14] and len(got[15].split()) <= 40 + 14 + Setting().least  # the changed sentence stays, and what is too short
    assert got[16] == ""


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_planted_passages_are_caught(spark):
    """Verbatim and near copies between any two words of clean texts without marks are caught, and nothing else goes."""
    rng = random.Random(8)
    kinds = {"verbatim 51-60": (51, 60, 0), "verbatim 61-100": (61, 100, 0), "near 0.9": (80, 120, 1), "near 0.8": (120, 160, 3)}
    texts, planted = [], []
    for kind, (low, high, changes) in kinds.items():
        for _ in range(40):
            p = words_of(rng, rng.randint(low, high), "p")
            q = list(p)
            for at in rng.sample(range(6, len(p) - 6), changes):
                q[at] = f"c{rng.randrange(10**9)}"
            assert not changes or similarity(p, q) >= 0.75
            own = [[words_of(rng, rng.randint(20, 120)) for _ in range(2)] for _ in range(2)]
            planted.append((kind, len(texts) + 1, q, own[1]))
            texts += [" ".join(a + x + b) for x, (a, b) in zip((p, q), own)]
    texts += [" ".join(words_of(rng, 200)) for _ in range(50)]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(docs_of(spark, texts)).collect()}
    clean = [i for i in range(len(texts)) if i not in {x[1] for x in planted}]
    assert all(got[i] == texts[i] for i in clean)
    for kind in kinds:
        gone = []
        for k, i, q, (a, b) in planted:
            if k == kind:
                left = got[i].split()
                assert left[: len(a)] == a and left[len(left) - len(b) :] == b
                gone.append(1 - (len(left) - len(a) - len(b)) / len(q))
        assert all(g >= 0.5 for g in gone) and sum(gone) >= 0.95 * len(gone)
        # what stands beyond a change near either end of a passage at the threshold may stay
        assert sum(g >= 0.9 for g in gone) >= (0.85 if kind == "near 0.8" else 0.95) * len(gone), (kind, sorted(gone))


def test_rows_say_who_keeps_what(spark):
    rng = random.Random(2)
    p = prose(rng, 55)
    rows = clusters(docs_of(spark, [prose(rng, 40) + "\n" + p, p, p + "\n" + p])).orderBy("doc", "first_word").collect()
    assert [(r["doc"], r["first_word"], r["n_words"], r["removed"]) for r in rows] == [(0, 40, 55, False), (1, 0, 55, True), (2, 0, 55, True), (2, 55, 55, True)]
    assert {(r["keeper"], r["keeper_word"], r["copies"]) for r in rows} == {(0, 40, 4)}


def test_hard_rows_and_empty_table(spark):
    twice = [*HARD, (None, HARD[6][1], "en", "s", 1), (40, HARD[6][1], "en", "s", 1), (40, HARD[6][1], "en", "s", 1)]
    got = remove_repeats(frame(spark, twice)).collect()
    assert len(got) == len(twice)
    want = {(r[0], r[1]) for r in HARD}
    assert {(r["doc_id"], r["text"]) for r in got if r["doc_id"] not in (40, None)} <= want
    rest = [r["text"] for r in got if r["doc_id"] == 40]
    assert len(rest) == 2 and rest[0] == rest[1] == ""
    assert {r["keeper"] for r in clusters(frame(spark, twice)).collect()} == {5} and LAST in {r["doc"] for r in clusters(frame(spark, twice)).collect()}
    assert clusters(frame(spark, [])).count() == 0 and remove_repeats(frame(spark, [])).count() == 0


def test_words_are_cut_out_with_the_space_before():
    assert without_words("a b\nc  d", [1, 3]) == "a  d"
    assert without_words(" a b\nc", [0, 2]) == "c"
    assert without_words("a b", [0, 2]) == "" and without_words("a b", []) == "a b"
    assert re.fullmatch("a b", without_words("a b c d", [2, 3, 3, 4]))
    assert F is not None


def test_passages_without_sentence_ends_are_found(spark):
    rng = random.Random(11)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    texts = [prose(rng, 80) + " " + passage + " " + prose(rng, 80) for _ in range(4)] + [prose(rng, 150) for _ in range(3)]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(docs_of(spark, texts)).collect()}
    assert got[0] == texts[0] and all(got[i] == texts[i] for i in (4, 5, 6))
    for i in (1, 2, 3):
        assert len(set(got[i].split()) & set(passage.split())) < 30


def lines_of(rng, n, tag):
    """``n`` words in lines of 5 to 9 without sentence ends."""
    words, out = [f"{tag}{rng.randrange(10**6)}" for _ in range(n)], []
    while words:
        k = rng.randint(5, 9)
        out.append(" ".join(words[:k]))
        words = words[k:]
    return "\n".join(out)


def test_passages_over_short_lines_go(spark):
    rng = random.Random(21)
    passage = lines_of(rng, 59, "p")
    texts = [lines_of(rng, 60, "h") + "\n" + passage + "\n" + lines_of(rng, 60, "i") for _ in range(3)] + [lines_of(rng, 120, "c")]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(docs_of(spark, texts)).collect()}
    assert got[0] == texts[0] and got[3] == texts[3]
    for i in (1, 2):
        assert got[i].split() == [w for w in texts[i].split() if w not in passage.split()]


def test_short_lines_that_are_near_copies_go(spark):
    rng = random.Random(22)
    lines = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(12)) for _ in range(9)]
    near = [x.rsplit(" ", 1)[0] + f" n{i}" if i % 3 == 2 else x for i, x in enumerate(lines)]  # no three lines in a row are alike
    texts = ["\n".join(lines), "\n".join(near)]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(docs_of(spark, texts)).collect()}
    assert got[0] == texts[0] and got[1] == "n8"  # the last word is no copy


def test_overlapping_passages_of_one_holder_go(spark):
    rng = random.Random(23)
    s = [" ".join(f"s{rng.randrange(10**6)}" for _ in range(14)) + "." for _ in range(6)]
    own = lambda: prose(rng, 60)
    a, b, c = s, s[:4], s[2:]
    texts = [own() + " " + " ".join(x) + " " + own() for x in (a, b, c)]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(docs_of(spark, texts)).collect()}
    assert got[0] == texts[0]
    for i in (1, 2):
        assert len(got[i].split()) == 120


def test_a_piece_of_an_earlier_document_does_not_split_a_run(spark):
    rng = random.Random(24)
    s = [" ".join(f"s{rng.randrange(10**6)}" for _ in range(13)) + "." for _ in range(5)]
    s[2] = "So."  # document 0 has it, and nothing else of the passage; either side is under 27 words
    texts = [prose(rng, 40) + " So. " + prose(rng, 40)] + [prose(rng, 60) + " " + " ".join(s) + " " + prose(rng, 60) for _ in range(2)]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(docs_of(spark, texts)).collect()}
    assert got[0] == texts[0] and got[1] == texts[1]
    assert len(got[2].split()) == 120


def words_of(rng, n, tag="w"):
    return [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]


def test_two_passages_side_by_side_in_one_document_go_from_the_others(spark):
    rng = random.Random(31)
    one, two = prose(rng, 63), prose(rng, 63)
    texts = [one + " " + two, prose(rng, 70) + " " + one + " " + prose(rng, 70), prose(rng, 70) + " " + two + " " + prose(rng, 70)]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(docs_of(spark, texts)).collect()}
    assert got[0] == texts[0] and all(len(got[i].split()) == 140 for i in (1, 2))


def test_common_sentences_inside_a_copied_block(spark):
    rng = random.Random(32)
    common = [" ".join(words_of(rng, 4, "c")) + "." for _ in range(6)]
    block = " ".join(x for c in common for x in (prose(rng, 23), c))
    texts = [" ".join(x for c in common for x in (c, prose(rng, 30)))] + [prose(rng, 60) + " " + block + " " + prose(rng, 60) for _ in range(2)]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(docs_of(spark, texts)).collect()}
    assert got[0] == texts[0] and got[1] == texts[1] and len(got[2].split()) == 120


def test_passages_that_begin_and_end_within_sentences(spark):
    """No marks at all: nine of ten passages of 60 words are found at every length of what stands before."""
    rng = random.Random(33)
    texts, passages = [], []
    for _ in range(60):
        p = words_of(rng, 60, "p")
        passages.append(set(p))
        texts += [" ".join(words_of(rng, rng.randint(40, 90)) + p + words_of(rng, rng.randint(40, 90))) for _ in range(2)]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(docs_of(spark, texts)).collect()}
    assert all(got[2 * k] == texts[2 * k] for k in range(60))
    left = [len(passages[k] & set(got[2 * k + 1].split())) for k in range(60)]
    assert sum(n < 60 for n in left) >= 54 and all(n <= 36 for n in left if n < 60)
    for k in range(60):
        assert [w for w in texts[2 * k + 1].split() if w not in passages[k]] == [w for w in got[2 * k + 1].split() if w not in passages[k]]


def test_a_common_part_of_a_passage_in_an_earlier_document(spark):
    """The middle of a passage stands alone in an earlier document, so that buckets of its grams begin with that one."""
    rng = random.Random(38)
    p = words_of(rng, 60, "p")
    texts = [" ".join(words_of(rng, 80) + p[5:55] + words_of(rng, 80))] + [" ".join(words_of(rng, 80) + p + words_of(rng, 80)) for _ in range(3)]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(docs_of(spark, texts)).collect()}
    assert got[0] == texts[0] and got[1] == texts[1] and all(len(got[i].split()) == 160 for i in (2, 3))


def test_short_repeats_and_repeats_within_one_document_stay(spark):
    rng = random.Random(34)
    short = prose(rng, 36)
    own = prose(rng, 70)
    texts = [prose(rng, 60) + " " + short + " " + prose(rng, 60) for _ in range(3)] + [own + "\n" + own + "\n" + own]
    docs = docs_of(spark, texts)
    assert clusters(docs).count() == 0
    assert {r["doc_id"]: r["text"] for r in remove_repeats(docs).collect()} == dict(enumerate(texts))


def test_long_runs_of_one_word_are_alike(spark):
    rng = random.Random(35)
    texts = [prose(rng, 60) + " of" * n + " " + prose(rng, 60) for n in (80, 200, 30)]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(docs_of(spark, texts)).collect()}
    assert got[0] == texts[0] and got[2] == texts[2] and len(got[1].split()) == 120


def test_pieces_that_repeat_are_one(spark):
    rng = random.Random(37)
    texts = [prose(rng, 60) + " Ab cd." * n + " " + prose(rng, 60) for n in (60, 200, 90, 5)]
    rows = clusters(docs_of(spark, texts)).collect()
    assert {r["doc"] for r in rows} == {0, 1, 2} and len(rows) <= 9
    got = {r["doc_id"]: r["text"] for r in remove_repeats(docs_of(spark, texts)).collect()}
    assert got[0] == texts[0] and got[3] == texts[3] and all(len(got[i].split()) <= 126 for i in (1, 2))


def test_keys_of_texts_have_64_bits(spark):
    """Many texts without an id: each is a document of its own."""
    rng = random.Random(36)
    p = prose(rng, 60)
    rows = [(None, p + " " + prose(rng, 20 + i % 30), "en", "s", None) for i in range(40)]
    got = [r["text"] for r in remove_repeats(spark.createDataFrame(rows, DOCS)).collect()]
    assert sum(p in t for t in got) == 1 and len(set(got)) == 40


def longest_shared(texts, width=13):
    """Words of the longest run of every text that another text has, through all runs of ``width`` words."""
    split = {k: t.lower().split() for k, t in texts.items()}
    first = {}
    for k, w in split.items():
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            first[g] = k if first.get(g, k) == k else -1
    out = {}
    for k, w in split.items():
        best = run = 0
        for i in range(len(w) - width + 1):
            run = run + 1 if first[tuple(w[i : i + width])] == -1 else 0
            best = max(best, run)
        out[k] = best + width - 1 if best else 0
    return out


def test_recall_and_precision_over_a_table(spark):
    """Against brute force: a document with a run of over 50 words that another has is found, others are not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    longest = longest_shared(texts)
    found = {r["doc"] for r in clusters(docs).select("doc").distinct().collect()}
    have, have_not = [k for k, n in longest.items() if n > 50], [k for k, n in longest.items() if n <= 50]
    print("found", sum(k in found for k in have), len(have), "left alone", sum(k not in found for k in have_not), len(have_not))
    assert sum(k in found for k in have) >= 0.99 * len(have)
    assert sum(k not in found for k in have_not) >= 0.97 * len(have_not)
    left = longest_shared({r["doc_id"]: r["text"] or "" for r in remove_repeats(docs).collect()})
    print("left over", sum(n > 50 for n in left.values()), sorted(left.items(), key=lambda x: -x[1])[:12])
    assert sum(n > 50 for n in left.values()) <= 0.05 * len(have)


def test_a_crowded_bucket_loses_no_pair(spark):
    """A phrase of 31 words in many texts: pairs that share more than it are found, however many documents come before them in its bucket."""
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    phrase = words(31)
    texts = {i: words(40) + phrase + words(40) for i in range(8)}
    for i in range(12):
        shared = words(10) + phrase + words(10)  # one window of 51 words, mostly with its least gram in the phrase
        texts |= {k: words(40) + shared + words(40) for k in (100 + 2 * i, 101 + 2 * i)}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    gone = {(r["doc"], r["first_word"], r["n_words"], r["keeper"]) for r in clusters(docs).where("removed").collect()}
    assert gone == {(101 + 2 * i, 40, 51, 100 + 2 * i) for i in range(12)}


def test_a_common_phrase_makes_no_pairs(spark, monkeypatch):
    """Texts that share 40 words and no passage are compared with a few others each, not with all; a near copy among them is found."""
    from millrace.llm import passages

    rng, rows = random.Random(5), []
    real = passages.compared

    def counted(pairs, setting):
        rows.append(pairs.count())
        return real(pairs, setting)

    monkeypatch.setattr(passages, "compared", counted)
    phrase = words_of(rng, 40, "p")
    texts = [words_of(rng, 40) + phrase + words_of(rng, 40) for _ in range(60)]
    before, after = words_of(rng, 30, "b"), words_of(rng, 30, "a")
    for _ in range(2):
        texts.append(words_of(rng, 40) + before[:15] + words_of(rng, 1, "c") + before[16:] + phrase + after + words_of(rng, 40))
    gone = clusters(docs_of(spark, [" ".join(t) for t in texts])).where("removed").collect()
    assert {(r["doc"], r["keeper"]) for r in gone} == {(61, 60)}
    assert sum(rows) <= 6 * len(texts) * 5, rows


def test_a_phrase_almost_as_long_as_a_passage_makes_no_pairs(spark, monkeypatch):
    """Texts that share 48 words, too few for a passage, are not compared with all others; a near copy among them is found."""
    from millrace.llm import passages

    rng, rows = random.Random(6), []
    real = passages.compared

    def counted(pairs, setting):
        rows.append(pairs.count())
        return real(pairs, setting)

    monkeypatch.setattr(passages, "compared", counted)
    phrase = words_of(rng, 48, "p")
    texts = [words_of(rng, 40) + phrase + words_of(rng, 40) for _ in range(60)]
    before, after = words_of(rng, 30, "b"), words_of(rng, 30, "a")
    for _ in range(2):
        texts.append(words_of(rng, 40) + before[:15] + words_of(rng, 1, "c") + before[16:] + phrase + after + words_of(rng, 40))
    gone = clusters(docs_of(spark, [" ".join(t) for t in texts])).where("removed").collect()
    assert {(r["doc"], r["keeper"]) for r in gone} == {(61, 60)}
    assert sum(rows) <= 6 * len(texts) * 5, rows
