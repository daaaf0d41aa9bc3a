"""Collocations by frequent phrases, counted level by level with hashed buckets.

Level k reads the texts once. It counts phrases of k words exactly, and at the
same time adds up how often the phrases of k + 1 words fall into each of a fixed
number of buckets. A phrase of k words is counted only if

* both of its parts of k - 1 words are frequent, which a bitmap of the hashes of
  all frequent phrases of the level before says (false alarms only), and
* its bucket was filled often enough in the level before (a second bitmap);

and a phrase of k + 1 words enters a bucket only if both of its parts of k words
passed that test. All else is exact: counts are those of the phrases' texts.

Bounds: bitmaps have ``1 << bits`` bits whatever the input, 8 MB for 26, and only
they are broadcast. A task holds one saturating byte for each bucket, and a table
of counts that is given out when it reaches ``HELD`` phrases. Buckets travel as
the filled cells of 65,536-bucket sections. When a corpus is so large that most
buckets fill up, buckets say little, parts that are frequent still prune, and
results stay the same. Within a task phrases are told by 64-bit hashes, between
tasks by their texts.

Defined results: null texts count as empty, null languages as ``und``; empty
texts and pieces have no words; repeated rows count as often as they are there;
an empty table has no phrase; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import wordhash
from millrace.llm.runtime import cut, discard, free_shuffles, prepare, tidy

U = np.uint64
SECTION_BITS = 16
HELD, RECENT = 1_000_000, 1 << 16
FULL = 255
#: Bytes that end a piece, and those that end a word.
PIECE = np.isin(np.arange(256), [*b".,;:!?", *range(10, 14)])
WORD = PIECE | np.isin(np.arange(256), [32, 9])
PARTIAL = "lang string, phrase string, n long, section int, cells binary"
NAMES = [c.split()[0] for c in PARTIAL.split(", ")]
KINDS = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()]


class Buckets:
    """Saturating counts of hashes by their first ``bits`` bits."""

    def __init__(self, bits: int):
        self.shift, self.cells = U(64 - bits), np.zeros(1 << bits, np.uint8)

    def add(self, hashes: np.ndarray, times: int = 1) -> None:
        at, n = np.unique(hashes >> self.shift, return_counts=True)
        at = at.astype("i8")
        self.cells[at] = np.minimum(self.cells[at] + n * times, FULL)

    def filled(self):
        """(section, places of filled cells as uint16, then their counts as bytes)."""
        size = 1 << SECTION_BITS
        for section in range(0, len(self.cells), size):
            part = self.cells[section : section + size]
            at = np.flatnonzero(part)
            if len(at):
                yield section >> SECTION_BITS, at.astype("<u2").tobytes() + part[at].tobytes()


class Bitmap:
    """Which hashes fall into set bits; all do where there is no bitmap."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.shift, self.packed = U(64 - bits), packed

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> self.shift).astype("i8")
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


class Counts:
    """Counts of phrases by hash: sorted arrays, and a small table of what came since they were sorted."""

    def __init__(self):
        self.keys, self.slots = np.empty(0, U), np.empty(0, "i8")
        self.recent: dict[int, int] = {}
        self.langs: list[str] = []
        self.texts: list[bytes] = []
        self.n = np.zeros(RECENT, "i8")

    def add(self, keys: np.ndarray, n: np.ndarray, name) -> None:
        """``keys`` differ; ``name`` gives the language and text of the one at a place."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        old = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        self.n[self.slots[at[old]]] += n[old]
        recent = self.recent
        new = np.flatnonzero(~old)
        slots = []
        for i, key in zip(new.tolist(), keys[new].tolist()):
            slot = recent.get(key)
            if slot is None:
                slot = recent[key] = len(self.texts)
                lang, text = name(i)
                self.langs.append(lang)
                self.texts.append(text)
            slots.append(slot)
        if len(self.texts) > len(self.n):
            self.n = np.concatenate([self.n, np.zeros(max(len(self.n), len(self.texts)), "i8")])
        self.n[slots] += n[new]
        if len(recent) > RECENT:
            keys = np.concatenate([self.keys, np.fromiter(recent.keys(), U, len(recent))])
            order = np.argsort(keys)
            self.keys, self.slots = keys[order], np.concatenate([self.slots, np.fromiter(recent.values(), "i8", len(recent))])[order]
            recent.clear()

    def rows(self, size: int = 1 << 16):
        """What was counted, in batches."""
        for a in range(0, len(self.texts), size):
            texts = pa.array(self.texts[a : a + size], pa.binary()).cast(pa.string())
            yield batch_of(pa.array(self.langs[a : a + size], pa.string()), texts, pa.array(self.n[a : a + len(texts)]))


def batch_of(*cols: pa.Array) -> pa.RecordBatch:
    """A batch of :data:`PARTIAL` from its first columns or its last two."""
    none = [pa.nulls(len(cols[0]), k) for k in KINDS]
    return pa.RecordBatch.from_arrays([*cols, *none[len(cols) :]] if len(cols) == 3 else [*none[: -len(cols)], *cols], NAMES)


def cells_of(buckets: Buckets) -> list[pa.Array]:
    rows = list(buckets.filled())
    return [pa.array([r[i] for r in rows], KINDS[i - 2]) for i in (0, 1)]


def hashed(texts: list[bytes], langs: list[str]) -> tuple[wordhash.Words, np.ndarray, np.ndarray]:
    """Words of a buffer, their hashes by language, and whether a word goes on in its piece."""
    found = wordhash.words(texts, WORD)
    own = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], U)
    h = wordhash.mix(found.hashes ^ np.repeat(own, np.diff(found.edges)))
    marks = np.cumsum(PIECE[np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)])
    goes_on = np.zeros(len(h), bool)
    goes_on[:-1] = marks[found.starts[1:]] == marks[found.ends[:-1] - 1]
    return found, h, goes_on


def gram_hashes(h: np.ndarray, goes_on: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the phrases of ``size`` words that begin at each word, and which there are."""
    if size == 1:
        return h, np.ones(len(h), bool)
    total, there = np.zeros(len(h), U), np.ones(len(h), bool)
    for k in range(size):
        moved = np.zeros(len(h), U)
        moved[: len(h) - k] = h[k:]
        total += moved * wordhash._PLACES[k]
        if k:
            there[: len(h) - k + 1] &= goes_on[k - 1 :]
            there[len(h) - k + 1 :] = False
    return wordhash.mix(total + U(size)), there


def shifted(x: np.ndarray) -> np.ndarray:
    """What each place's next one has."""
    return np.append(x[1:], False)


def level(docs: DataFrame, size: int, last: bool, bits: int, known, allowed) -> DataFrame:
    """Partial counts of phrases of ``size`` words, and partial buckets of longer ones by one.

    ``known`` and ``allowed`` are broadcast bitmaps of the frequent phrases of the
    level before, and of the buckets of this one.
    """

    def run(batches):
        before = Bitmap(bits, known.value) if known else None
        bucket = Bitmap(bits, allowed.value) if allowed else None
        buckets = None if last else Buckets(bits)
        counts = Counts()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, end, texts in wordhash.buffers(batch.column(1).to_pylist()):
                found, h, goes_on = hashed(texts, langs[first:end])
                if not len(h):
                    continue
                grams, there = gram_hashes(h, goes_on, size)
                if before:
                    parts = before.has(gram_hashes(h, goes_on, size - 1)[0])
                    there &= parts & shifted(parts)
                    there[there] = bucket.has(grams[there])
                if buckets:
                    longer, whole = gram_hashes(h, goes_on, size + 1)
                    buckets.add(longer[whole & there & shifted(there)])
                at = np.flatnonzero(there)
                keys, where, n = np.unique(grams[at], return_index=True, return_counts=True)
                at = at[where]
                text_of = np.searchsorted(found.edges, at, side="right") - 1 + first
                data = (b"\n" + b"\n".join(texts)).lower()
                starts, ends = [[x[at + k].tolist() for k in range(size)] for x in (found.starts, found.ends)]

                def name(i):
                    return langs[text_of[i]], b" ".join(data[a[i] : b[i]] for a, b in zip(starts, ends))

                counts.add(keys, n, name)
                if len(counts.texts) > HELD:
                    yield from counts.rows()
                    counts = Counts()
        yield from counts.rows()
        if buckets:
            yield batch_of(*cells_of(buckets))
        tidy()

    return docs.mapInArrow(run, PARTIAL)


def bitmap(cells: DataFrame, bits: int, least: int) -> np.ndarray:
    """The packed bits of buckets with ``least`` or more, from rows (section, cells). ``1 << bits`` bits come to the driver."""
    spark = cells.sparkSession
    size = 1 << min(SECTION_BITS, bits)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for section, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(packed) // 3
                at, total = np.frombuffer(packed, "<u2", n), sums.setdefault(section, np.zeros(size, np.uint8))
                total[at] = np.minimum(total[at].astype("u2") + np.frombuffer(packed, np.uint8, n, 2 * n), FULL)
        out = [(k, np.packbits(v >= least, bitorder="little").tobytes()) for k, v in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["section", "bits"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in cells.select("section", "cells").repartition(parts, "section").mapInArrow(run, "section int, bits binary").collect():
        at = row["section"] * size // 8
        out[at : at + size // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def marked(frequent: DataFrame, size: int, bits: int) -> DataFrame:
    """Cells (section, cells) that the hashes of all frequent phrases of ``size`` words fill."""

    def run(batches):
        buckets = Buckets(bits)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, end, texts in wordhash.buffers(batch.column(1).to_pylist()):
                found, h, goes_on = hashed(texts, langs[first:end])
                buckets.add(gram_hashes(h, goes_on, size)[0][found.edges[:-1]], FULL)
        yield pa.RecordBatch.from_arrays(cells_of(buckets), ["section", "cells"])

    return frequent.select("lang", "phrase").mapInArrow(run, "section int, cells binary")


def frequent_phrases(docs: DataFrame, longest: int, least: int, bits: int, lang_col: str, text_col: str) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, f) of frequent phrases of 1 to ``longest`` words, and (lang, n) of all words."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tables, totals, known, allowed = [], None, None, None
    for size in range(1, longest + 1):
        partial = cut(level(texts, size, size == longest, bits, known, allowed), f"phrases-{size}")
        counted = partial.where("phrase is not null")
        if size == 1:
            totals = cut(counted.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        found = cut(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), f"frequent-{size}")
        tables.append(found)
        if size < longest:
            known = spark.sparkContext.broadcast(bitmap(marked(found, size, bits), bits, FULL))
            allowed = spark.sparkContext.broadcast(bitmap(partial.where("cells is not null"), bits, least))
        discard(partial)
        free_shuffles(spark)
    return tables, totals


def joined(words: Column, at, n) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, swallowed: int = 50, top: int | None = 2000, bits: int = 26, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``top`` phrases of 2 to ``longest`` words in each language.

    Of the ways to cut a phrase in two, the one of the lowest score counts:
    floor(1,000,000 a a / (l r)) for phrase, left and right parts found a, l and r
    times. A phrase goes if a longer one that holds it is found ``swallowed``
    percent as often or more. Products take 38 digits, for counts below 10**15.
    """
    if not 8 <= bits <= 32 or least > FULL:
        raise ValueError("8 to 32 bits, and a least count that a byte holds")
    tables, totals = frequent_phrases(docs, longest, least, bits, lang_col, text_col)
    words = F.split("phrase", " ")
    candidates, shorter = tables[1], tables[0]
    for i, t in enumerate(tables[2:]):
        candidates, shorter = candidates.unionByName(t), shorter.unionByName(tables[i + 1])
    parts = cut(shorter, "parts")  # a side of its own, so that Spark can split the joins where a part is hot
    cuts = candidates.withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", joined(F.col("w"), F.lit(1), F.col("k")).alias("left"), joined(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        of = parts.select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of"), F.col("f").alias(name))
        cuts = cut(cuts.join(of, (F.col("lang") == F.col("of_lang")) & (F.col(side) == F.col("of"))).drop("of_lang", "of", side), f"cuts-{name}")
    cuts = cuts.withColumn("score", F.expr("(1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    # phrases inside longer ones
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: joined(F.col("w"), i, m))))
    inside = candidates.withColumn("w", words).where("size(w) > 2").select("lang", F.explode(spans).alias("inner"), "f")
    inside = cut(inside.groupBy(F.col("lang").alias("in_lang"), "inner").agg(F.max("f").alias("longer")), "inside")
    kept = best.join(inside, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inner")), "left")
    kept = kept.where(F.col("longer").isNull() | (100 * F.col("longer") < swallowed * F.col("a"))).drop("in_lang", "inner", "longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # the first of each of 64 shares, then the first of those
        share = F.pmod(F.xxhash64("phrase"), F.lit(64))
        kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("place") <= top).drop("place")
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        kept = kept.where(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB.
SQL = r"""
with d as (select coalesce(lang, 'und') as lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as pieces from documents),
p as (select lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') as w from d),
total as (select lang, sum(len(w))::bigint as n from p group by lang),
gram as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, k, w, unnest(range(1, len(w) - k + 2)) as i from p, range(1, 4) t(k))),
f as (select lang, k, phrase, count(*) as n from gram group by all having count(*) >= 10),
c as (select lang, phrase, n as a, k, string_split(phrase, ' ') as w from f where k > 1),
part as (select lang, c.phrase, a, j, l.n as l, r.n as r, (1000000::hugeint * a * a) // (l.n::hugeint * r.n) as score
  from (select *, unnest(range(1, k)) as j from c) c join f l using (lang) join f r using (lang)
  where l.k = j and r.k = c.k - j and l.phrase = array_to_string(c.w[1:j], ' ') and r.phrase = array_to_string(c.w[j + 1:], ' ')),
best as (select * from part qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inner_ as (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, a from c where k = 3),
swallowed as (select lang, phrase, max(a) as longer from inner_ group by all),
ranked as (select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank, b.phrase, a, l, r, score::bigint as score
  from best b left join swallowed s on s.lang = b.lang and s.phrase = b.phrase where s.longer is null or 100 * s.longer < 50 * a)
select r.lang, rank, phrase, a, l, r, n, score from ranked r join total using (lang) where rank <= 2000
"""
