"""Substring dedup: passages that documents share, by MinHash over windows of words.

A paragraph is every run of ``least`` words (51), wherever it begins. Its MinHash
is the least of the hashes of its ``gram``-word grams; windows that follow one
another mostly have the same one, so a document has a row for about every twenty
words, and two documents with a passage of ``least`` words in common have the
same value for that window. So one band of one row misses no verbatim passage,
and near copies are found from any of their windows whose least gram is intact.

Documents that collide are compared where they do: each with the first document of
its bucket, and those that have no passage in common with it with the first of
them, up to ``rounds`` times. Those whose words then go with no earlier document are
compared with the first that has a window of ``least`` words in common with them, and then with
all earlier ones of their bucket whose surroundings can be alike: they have a shingle in common
that is rarer than those which make up a place of ``least`` words (a prefix filter). All go word by word from the common gram outwards, over changed
words as long as the five-word shingles of the two places have a Jaccard
similarity of 0.75 or more. What is found from several grams of one pair is
chained under the same rule, and a chain of at least ``least`` words is a link. It
ends where words cease to agree, so passages go from their first word to their last.

Linked places that overlap in a document are one stretch, and components of links
are clusters. A document loses the words that an earlier document (smaller id)
has too; so of each cluster the first stretch stays.

Places are counted in words (runs without ASCII white space), and words around a
gram travel as 16 bits each. Texts move once, those with a collision, to be read
at the places in question, and once to be edited.

Bounds: rows are per gram or per link; in the rounds a bucket is joined with one row, so a hot
one is split by Spark's skew join; what the rounds leave over is compared in
pairs that share a shingle which tells, so texts that share one phrase of up to
``least`` - 1 words make none; members of a large group of loosely similar texts
still make pairs with all of it; a document's rows stream in order.

Defined results: null and empty texts have no passage; null ids count as larger
than all others; rows equal in id and text are one document, and are edited
alike; rows with one id and several texts are several documents; what one
document repeats alone stays; a text that loses all of its words becomes empty;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import wordhash
from millrace.llm.minhash import components
from millrace.llm.runtime import cut, free_shuffles, prepare, tidy

LAST = (1 << 63) - 1
PLACE_BITS = 26  # words of a buffer, which one text may fill
KEYS = ["doc", "text_key"]
ABSENT = (1 << 31) - 1


@dataclass(frozen=True)
class Setting:
    least: int = 51  # words of a passage
    gram: int = 8  # words of a gram; a window has least - gram + 1
    reach: int = 56  # words compared on either side of a gram; no end of a window is further away
    numerator: int = 75  # a link: 100 * intersection >= numerator * union
    width: int = 5  # words of a shingle
    gap: int = 12  # words between parts of a chain
    rounds: int = 3  # documents of a bucket that the others are compared with, one after another, before those left without a passage meet all
    at_once: int = 500_000  # pairs at a gram whose surroundings are joined at a time

    @property
    def cost(self) -> int:
        """Shingles in common that make up for one that is not."""
        return -(-2 * self.numerator // (100 - self.numerator))

    @property
    def lost(self) -> int:
        """Shingles of surroundings that two passages may not have in common."""
        n = 2 * self.reach + self.gram - self.width + 1
        return n + (-2 * self.numerator * n // (100 + self.numerator))

    @property
    def shorter(self) -> int:
        """Words by which the other of two passages may be shorter than ``least``, if they are left out at one place."""
        return self.least - 2 * (self.width - 1) + -self.numerator * self.least // 100


def documents_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc")
    return docs.select(key, F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))


def gram_hashes(found: wordhash.Words, size: int) -> np.ndarray:
    """The hash of the gram that begins at each word, whatever text it ends in."""
    n = max(len(found.hashes) - size + 1, 0)
    powers, inverses = wordhash._powers_to(len(found.hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(found.hashes * powers[: len(found.hashes)])])
    return wordhash.mix((sums[size:] - sums[:n]) * inverses[:n])


def least_grams(found: wordhash.Words, setting: Setting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word, text) of the least gram of every window, one for windows in a row that have the same."""
    none = np.empty(0, np.uint64), np.empty(0, "i8"), np.empty(0, "i8")
    if len(found.hashes) < setting.least:
        return none
    grams = gram_hashes(found, setting.gram)
    bits = np.uint64(PLACE_BITS)
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)  # a gram and its place: the leftmost among equals
    size, wanted = 1, setting.least - setting.gram + 1
    while size < wanted:
        step = min(size, wanted - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    starts = np.arange(len(least))
    text = np.searchsorted(found.edges, starts, side="right") - 1
    inside = starts + setting.least <= found.edges[text + 1]
    starts, text = starts[inside], text[inside]
    if not len(starts):
        return none
    place = (least[starts] & np.uint64((1 << PLACE_BITS) - 1)).astype("i8")
    value = grams[place]
    new = np.ones(len(value), bool)
    moved = place // 32  # words that repeat have one value all along
    other = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    new[1:] = other | (moved[1:] != moved[:-1])
    last = np.append(other, True) & (place != place[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))])
    new |= last
    return value[new], place[new], text[new]


def anchors(base: DataFrame, setting: Setting) -> DataFrame:
    """(gram, doc, text_key, place) of every document. No shuffle."""

    def run(batches):
        for batch in batches:
            keys = [np.asarray(batch.column(i)) for i in (0, 1)]
            for first, _, texts in wordhash.buffers(batch.column(2).to_pylist()):
                found = wordhash.words(texts, wordhash.WHITE)
                value, place, text = least_grams(found, setting)
                cols = [pa.array(value.view("i8")), *[pa.array(k[first + text]) for k in keys], pa.array((place - found.edges[text]).astype("i4"))]
                yield pa.RecordBatch.from_arrays(cols, ["gram", *KEYS, "place"])
        tidy()

    return base.mapInArrow(run, "gram long, doc long, text_key long, place int")


def surroundings(rows: DataFrame, setting: Setting) -> DataFrame:
    """(gram, doc, text_key, place, around) of rows (doc, text_key, grams, places, text): 16 bits of each word around a gram, 0 outside the text."""
    whole = np.arange(-setting.reach, setting.gram + setting.reach)

    def run(batches):
        for batch in batches:
            keys = [np.asarray(batch.column(i)) for i in (0, 1)]
            for first, end, texts in wordhash.buffers(batch.column(4).to_pylist()):
                found = wordhash.words(texts, wordhash.WHITE)
                small = (found.hashes >> np.uint64(48)).astype("<u2")
                small[small == 0] = 1
                own = [batch.column(2)[i].values for i in range(first, end)]
                grams = np.concatenate([np.asarray(x) for x in own])
                text = np.repeat(np.arange(end - first), [len(x) for x in own])
                place = np.concatenate([np.asarray(batch.column(3)[i].values) for i in range(first, end)])
                at = (found.edges[text] + place)[:, None] + whole
                inside = (at >= found.edges[text][:, None]) & (at < found.edges[text + 1][:, None])
                around = np.where(inside, small[np.clip(at, 0, max(len(small) - 1, 0))], 0).astype("<u2") if len(small) else np.zeros(at.shape, "<u2")
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * len(whole)), len(around), [None, pa.py_buffer(np.ascontiguousarray(around))])
                cols = [pa.array(grams), *[pa.array(k[first + text]) for k in keys], pa.array(place.astype("i4")), data.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["gram", *KEYS, "place", "around"])
        tidy()

    return rows.mapInArrow(run, "gram long, doc long, text_key long, place int, around binary")


def first_run(equal: np.ndarray) -> np.ndarray:
    """Words that agree before the first that does not, in each row."""
    return np.where(equal.all(axis=1), equal.shape[1], (~equal).argmax(axis=1))


def extended(equal: np.ndarray, run: np.ndarray, credit: np.ndarray, setting: Setting, cost: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, credit) of going on beyond words that differ, as far as five agree again and the credit lasts.

    A shingle in common earns one, and one that is not costs as much as keeps the similarity at its threshold.
    """
    n, width, again = equal.shape[1], setting.width, 5
    padded = np.concatenate([np.ones((len(equal), again - 1), bool), equal], axis=1)
    after = np.cumsum(np.concatenate([np.zeros((len(equal), 1), "i4"), padded.astype("i4")], axis=1), axis=1)
    both = after[:, again:] - after[:, :-again] == again
    common = after[:, again:] - after[:, again - width : n + again - width] == width
    score = credit[:, None] - run[:, None] + np.cumsum(np.where(common, 1, -cost), axis=1)
    good = both & (score >= 0)
    end = np.where(good.any(axis=1), n - good[:, ::-1].argmax(axis=1), 0)
    further = end > run
    end = np.where(further, end, run)
    return end, np.where(further, score[np.arange(len(end)), np.maximum(end - 1, 0)], credit)


def compared(pairs: DataFrame, setting: Setting) -> DataFrame:
    """Places of ``doc`` that are like places of ``of_doc``, ``shift`` words further on, from rows with the words around a gram in both.

    ``far_first`` and ``far_end`` are where words agree again beyond more changes
    than the similarity allows; a longer chain may allow them. ``changed`` are the
    words that differ.
    """
    reach, gram = setting.reach, setting.gram
    names = ["gram", "place", "doc", "text_key", "of_doc", "of_key", "first", "end", "far_first", "far_end", "shift", "changed"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: batch.column(n) for n in batch.schema.names}
            a, b = (np.frombuffer(b"".join(cols[n].to_pylist()), "<u2").reshape(-1, 2 * reach + gram) for n in ("around", "of_around"))
            equal = (a == b) & (a != 0)
            before, behind = equal[:, :reach][:, ::-1], equal[:, reach + gram :]
            left, right = first_run(before), first_run(behind)
            credit = left + right + gram - setting.width + 1
            far_left, far_right = (extended(x, y, credit, setting, 1)[0] for x, y in ((before, left), (behind, right)))
            right, credit = extended(behind, right, credit, setting, setting.cost)
            left, _ = extended(before, left, credit, setting, setting.cost)
            far_left, far_right = np.maximum(left, far_left), np.maximum(right, far_right)
            place = np.asarray(cols["place"]).astype("i8")
            first, end = place - left, place + gram + right
            at = np.arange(2 * reach + gram)
            wrong = ~equal & (at >= (reach - far_left)[:, None]) & (at < (reach + gram + far_right)[:, None])
            row, where = np.nonzero(wrong)
            changed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(wrong.sum(axis=1))]).astype("i4")), pa.array((place[row] - reach + where).astype("i4")))
            out = [*[cols[n] for n in names[:6]], *[pa.array(x.astype("i4")) for x in (first, end, place - far_left, place + gram + far_right, np.asarray(cols["of_place"]) - place)], changed]
            yield pa.RecordBatch.from_arrays(out, names)
        tidy()

    return pairs.mapInArrow(run, "gram long, place int, doc long, text_key long, of_doc long, of_key long, first int, end int, far_first int, far_end int, shift int, changed array<int>")


class Chain:
    """Places of one pair of documents, as far as they meet or are close to one another; ``changed`` has the words that do not agree."""

    def __init__(self, first: int, end: int, far_first: int, far_end: int, shift: int, changed: list[int]):
        self.first, self.end, self.far_first, self.far_end, self.shift, self.changed = first, end, far_first, far_end, shift, set(changed)
        self.of_first, self.of_end, self.moved = first + shift, end + shift, 0

    def with_(self, new: Chain) -> Chain:
        out = Chain(self.first, max(self.end, new.end), self.far_first, max(self.far_end, new.far_end), new.shift, [])
        known = {x for x in self.changed if x < new.first or x in new.changed or x >= new.end}
        out.changed = known | {x for x in new.changed if x >= self.end} | set(range(self.end, new.first))
        out.of_first, out.of_end, out.moved = min(self.of_first, new.of_first), max(self.of_end, new.of_end), self.moved
        if new.first >= self.end:  # words between that only one of the two has
            out.moved += abs(new.shift - self.shift)
        return out

    def similar(self, setting: Setting, first: int | None = None, end: int | None = None) -> bool:
        """Whether the shingles of the two places have the similarity, up to these ends."""
        first, end = self.first if first is None else first, self.end if end is None else end
        n, edges = end - first, [first - 1, *sorted(x for x in self.changed if first <= x < end), end]
        common = sum(max(b - a - setting.width, 0) for a, b in zip(edges, edges[1:]))
        both = 2 * (n - setting.width + 1) + self.moved
        return 100 * common >= setting.numerator * (both - common)

    def place(self, setting: Setting) -> tuple[int, int] | None:
        """From the first word to the last, if they are enough and alike."""
        first, end = self.first, self.end
        if self.far_end > end and self.similar(setting, first, self.far_end):
            end = self.far_end
        if self.far_first < first and self.similar(setting, self.far_first, end):
            first = self.far_first
        return (first, end) if end - first >= setting.least and self.similar(setting, first, end) else None


def chained(rows: DataFrame, setting: Setting) -> DataFrame:
    """Links (doc, text_key, first, end, of_doc, of_key, of_first, of_end) from rows sorted by pair and place."""
    names = ["doc", "text_key", "first", "end", "of_doc", "of_key", "of_first", "of_end"]

    def run(batches):
        pair = chain = None

        def link():
            if chain is not None and (found := chain.place(setting)):
                yield (*pair[:2], *found, *pair[2:], chain.of_first - chain.first + found[0], chain.of_end - chain.end + found[1])

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                own, new = row[:4], Chain(*row[4:])
                if own == pair and (new.first < chain.end or new.first <= chain.end + setting.gap and abs(new.shift - chain.shift) <= setting.gap):
                    longer = chain.with_(new)
                    if longer.similar(setting):
                        chain = longer
                        continue
                out += link()
                pair, chain = own, new
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int32() if i in (2, 3, 6, 7) else pa.int64()) for i in range(8)], names)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in link()], pa.int32() if i in (2, 3, 6, 7) else pa.int64()) for i in range(8)], names)
        tidy()

    return rows.mapInArrow(run, "doc long, text_key long, first int, end int, of_doc long, of_key long, of_first int, of_end int")


def hashed(around: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether all are there) of every ``size`` words in a row, in each row of surroundings."""
    powers, inverses = wordhash._powers_to(around.shape[1] + 1)
    mixed = wordhash.mix(around.astype(np.uint64)) * powers[: around.shape[1]]
    first = np.zeros((len(around), 1), np.uint64)
    sums, there = (np.concatenate([first, np.cumsum(x, axis=1, dtype=np.uint64)], axis=1) for x in (mixed, around != 0))
    n = around.shape[1] - size + 1
    return wordhash.mix((sums[:, size:] - sums[:, :n]) * inverses[:n]), there[:, size:] - there[:, :n] == size


def window_keys(faces: DataFrame, setting: Setting) -> DataFrame:
    """(key, face, of_doc, of_key, open): a key for each window of ``least`` words with the gram in its place."""
    reach, gram = setting.reach, setting.gram

    def run(batches):
        for batch in batches:
            value, there = hashed(around_of(batch.column("around"), setting), setting.least)
            start = np.arange(value.shape[1])
            there = there & (start <= reach) & (start + setting.least >= reach + gram)
            value = wordhash.mix(value + start.astype(np.uint64) + np.asarray(batch.column("gram")).view("u8")[:, None])
            row, at = np.nonzero(there)
            cols = [pa.array(value[row, at].view("i8")), *[batch.column(c).take(pa.array(row)) for c in ("face", "of_doc", "of_key", "open")]]
            yield pa.RecordBatch.from_arrays(cols, ["key", "face", "of_doc", "of_key", "open"])
        tidy()

    return faces.mapInArrow(run, "key long, face long, of_doc long, of_key long, open boolean")


def around_of(column: pa.Array, setting: Setting) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, 2 * setting.reach + setting.gram)


def shingle_keys(faces: DataFrame, setting: Setting) -> DataFrame:
    """(key, face, at, open): a key for each shingle of surroundings that goes beyond the gram, and where it begins."""

    def run(batches):
        for batch in batches:
            value, there = hashed(around_of(batch.column("around"), setting), setting.width)
            start = np.arange(value.shape[1])
            there = there & ((start < setting.reach) | (start + setting.width > setting.reach + setting.gram))
            value = wordhash.mix(value + np.asarray(batch.column("gram")).view("u8")[:, None])
            row, at = np.nonzero(there)
            cols = [pa.array(value[row, at].view("i8")), batch.column("face").take(pa.array(row)), pa.array(at.astype("i4")), batch.column("open").take(pa.array(row))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "face", "at", "open"])
        tidy()

    return faces.mapInArrow(run, "key long, face long, at int, open boolean")


def telling(rank: np.ndarray, span: int, setting: Setting) -> np.ndarray:
    """Which shingles tell, in rows of their ranks from the most frequent on: one of them is the rarest that a similar place can have in common.

    A place that begins with one shingle ends with one ``span`` or more further on, and
    has all but ``lost`` of those from the one to the other in common. So the rarest of
    what is in common is no more frequent than the most frequent ones that make up
    such a place.
    """
    n, few = setting.reach + 1, span + 1 - setting.lost
    ends = np.minimum.accumulate(rank[:, ::-1], axis=1)[:, ::-1][:, span : span + n]
    windows = np.lib.stride_tricks.sliding_window_view(rank, span + 1, axis=1)[:, :n]
    least = np.maximum(np.maximum(rank[:, :n], ends), np.partition(windows, few - 1, axis=2)[:, :, few - 1])
    least = np.minimum.accumulate(least, axis=1)
    least = np.concatenate([least, np.repeat(least[:, -1:], rank.shape[1] - n, axis=1)], axis=1)
    return (rank >= least) & (rank < ABSENT)


def rare_keys(rows: DataFrame, setting: Setting) -> DataFrame:
    """(face, key, asks): the keys that tell, of rows (face, shingles with n, key and at); those with ``asks`` tell of places of ``least`` words, others of the shorter ones that may be like them."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(1)
                row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
                n, key, place = (np.asarray(lists.flatten().field(i)) for i in range(3))
                order = np.lexsort((key, -n, row))
                row, key, place = row[order], key[order], place[order]
                first = np.ones(len(row), bool)
                first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                rank = np.full((part.num_rows, 2 * setting.reach + setting.gram - setting.width + 1), ABSENT, "i4")
                rank[:, setting.reach : setting.reach + setting.gram - setting.width + 1] = -1  # the gram's own
                rank[row, place] = np.cumsum(first)
                span = setting.least - setting.width
                asks, tells = telling(rank, span, setting)[row, place], telling(rank, span - setting.shorter, setting)[row, place]
                group = np.cumsum(first) - 1
                asks, tells = (np.bincount(group, x, minlength=group[-1] + 1 if len(group) else 0) > 0 for x in (asks, tells))
                row, key = row[first][tells], key[first][tells]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(key), pa.array(asks[tells])], ["face", "key", "asks"])
        tidy()

    return rows.mapInArrow(run, "face long, key long, asks boolean")


def open_links(met: DataFrame, alone: DataFrame, pairs: DataFrame, setting: Setting) -> DataFrame:
    """Links of pairs of documents (doc, text_key, of_doc, of_key), compared at all grams where the first has a row of ``alone``."""
    pairs = cut(pairs.distinct(), "left_pairs")
    at = cut(alone.select("gram", *KEYS).distinct().join(pairs, KEYS), "left_at")
    of_names = {"doc": "of_doc", "text_key": "of_key", "place": "of_place", "around": "of_around"}
    free_shuffles(met.sparkSession)
    slices, found = at.count() // setting.at_once + 1, []
    for n in range(slices):  # by gram, so that surroundings of some pairs at a time are on disk
        part = F.pmod(F.xxhash64("gram"), F.lit(slices)) == n
        others = met.where(part).join(at.where(part).select("gram", F.col("of_doc").alias("doc"), F.col("of_key").alias("text_key")).distinct(), ["gram", *KEYS], "left_semi")
        others = others.groupBy("gram", *KEYS, "around").agg(F.min("place").alias("place")).withColumnsRenamed(of_names)
        rows = alone.where(part).join(at.where(part), ["gram", *KEYS]).join(others, ["gram", "of_doc", "of_key"])
        found.append(cut(compared(rows, setting), "compared"))
        free_shuffles(met.sparkSession)
    return cut(chain(reduce(DataFrame.unionByName, found), setting), "links")


def chain(found: DataFrame, setting: Setting) -> DataFrame:
    """Links from compared rows, pair by pair."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*KEYS, "of_doc", "of_key", "first", "end", "far_first", "far_end", "shift", "changed"]
    pairs = found.drop("gram", "place").dropDuplicates()
    return chained(pairs.select(*order).repartition(parts, *KEYS, "of_doc", "of_key").sortWithinPartitions(*order), setting)


def uncovered(rows: DataFrame, found: DataFrame, setting: Setting) -> DataFrame:
    """``rows`` without those whose gram is in words that an earlier document has."""
    gone = islands(found.select(*KEYS, "first", "end").distinct(), "stretch").groupBy(*KEYS, "stretch").agg(F.max("end").alias("stop"))
    gone = cut(gone.withColumnsRenamed({"doc": "d", "text_key": "k"}), "gone")
    inside = (F.col("doc") == F.col("d")) & (F.col("text_key") == F.col("k")) & (F.col("place") >= F.col("stretch")) & (F.col("place") + setting.gram <= F.col("stop"))
    return cut(rows.join(gone, inside, "left_anti"), "alone")


def left_over(met: DataFrame, alone: DataFrame, setting: Setting) -> list[DataFrame]:
    """What the rounds may have missed: links of rows of ``alone``, whose words go with no earlier document, to all earlier ones of their buckets.

    Rows with the same surroundings meet the first of them, and all meet the first
    document of each of their windows of ``least`` words; so copies of one passage
    meet one document. Those left over may be near copies of others: two places of
    ``least`` words that are alike have most shingles from the first to the last in common,
    so they have one in common that tells (see ``telling``; a prefix filter). They meet the first document that has it, and if no words go with that one, all.
    """
    me, other = F.struct(*KEYS), F.struct("of_doc", "of_key")
    large = met.groupBy("gram").count().where("count > 2").select("gram")  # of two rows the first round has compared the one with the other
    alone = alone.join(cut(large, "large"), "gram", "left_semi")
    alone = cut(met.join(alone, ["gram", *KEYS, "place"], "left_semi").withColumn("face", F.xxhash64("gram", "around")), "alone")
    found = []

    def faces_of(rows: DataFrame) -> DataFrame:
        """(gram, face, around, of_doc, of_key, open): surroundings at the grams of ``rows`` with their first document, and whether any of the rows has them."""
        own = rows.select(F.col("face").alias("own")).distinct()
        near = met.join(cut(rows.select("gram").distinct(), "grams"), "gram", "left_semi").groupBy("gram", "around").agg(F.min(F.struct(*KEYS)).alias("p"))
        near = near.select("gram", F.xxhash64("gram", "around").alias("face"), "around", F.col("p.doc").alias("of_doc"), F.col("p.text_key").alias("of_key"))
        return cut(near.join(own, F.col("face") == F.col("own"), "left").withColumn("open", F.col("own").isNotNull()).drop("own"), "faces")

    def meet(pairs: DataFrame) -> DataFrame:
        """Pairs (face, of_doc, of_key) are compared; returned are the rows left over."""
        pairs = alone.select("face", *KEYS).distinct().join(pairs, "face").where(other < me).drop("face")
        found.append(open_links(met, alone, pairs, setting))
        return uncovered(alone, found[-1], setting)

    faces = faces_of(alone)
    names = faces.select("face", "of_doc", "of_key", "open")
    keys = cut(window_keys(faces, setting), "windows")
    firsts = cut(keys.groupBy("key").agg(F.min(other).alias("p"), F.count_if("open").alias("n")).where("n > 0").select("key", "p.*"), "firsts")
    same = keys.where("open").select("key", "face").join(firsts, "key").drop("key")
    alone = meet(same.unionByName(names.where("open").drop("open")).distinct())
    if alone.isEmpty():
        return found
    faces = faces_of(alone)
    names = faces.select("face", "of_doc", "of_key", "open")
    keys = cut(shingle_keys(faces, setting), "shingles")
    often = cut(keys.groupBy("key").agg(F.count("*").alias("n"), F.count_if("open").alias("m")).where("n > 1 and m > 0").select("key", "n"), "often")
    shared = keys.join(often, "key").groupBy("face").agg(F.collect_list(F.struct(F.col("n").cast("int"), "key", "at")).alias("k"))
    rare = cut(rare_keys(shared, setting).join(names, "face"), "rare")
    asks = F.col("open") & F.col("asks")
    firsts = cut(rare.groupBy("key").agg(F.min(other).alias("p"), F.count_if(asks).alias("n")).where("n > 0").select("key", "p.*"), "firsts")
    alone = meet(rare.where(asks).select("key", "face").join(firsts, "key").drop("key").distinct())
    if not alone.isEmpty():
        rest = rare.where(asks).join(alone.select("face").distinct(), "face", "left_semi").select("key", "face", other.alias("own"))
        meet(rest.join(rare.select("key", "of_doc", "of_key"), "key").where(other < F.col("own")).select("face", "of_doc", "of_key").distinct())
    return found


def links(base: DataFrame, setting: Setting) -> DataFrame:
    """Places of documents with the place of an earlier document that is like each."""
    spark = base.sparkSession
    found = cut(anchors(base, setting), "anchors")
    sides = [f(c).alias(f"{f.__name__}_{c}") for c in KEYS for f in (F.min, F.max)]  # either one is another document's
    shared = found.groupBy("gram").agg(*sides).where("min_doc < max_doc or min_text_key < max_text_key").select("gram")
    shared = cut(shared, "shared")  # a side of its own, so that Spark can split the join where a gram is hot
    free_shuffles(spark)
    places = found.join(shared, "gram").dropDuplicates(["gram", *KEYS, "place"]).groupBy(*KEYS).agg(F.collect_list(F.struct("gram", "place")).alias("p"))
    places = cut(places.select(*KEYS, F.col("p.gram").alias("grams"), F.col("p.place").alias("places")), "places").withColumnsRenamed({"doc": "d", "text_key": "k"})
    free_shuffles(spark)
    rows = base.join(places, (F.col("doc") == F.col("d")) & (F.col("text_key") == F.col("k"))).select(*KEYS, "grams", "places", "text")
    met = cut(surroundings(rows, setting), "met")
    free_shuffles(spark)
    found, every, alone = [], met, None
    for _ in range(setting.rounds):
        pivots = met.groupBy("gram").agg(F.min(F.struct(*KEYS, "place", "around")).alias("p"))
        pivots = cut(pivots.select(F.col("gram").alias("g"), F.col("p.doc").alias("of_doc"), F.col("p.text_key").alias("of_key"), F.col("p.place").alias("of_place"), F.col("p.around").alias("of_around")), "pivots")
        pairs = met.join(pivots, F.col("gram") == F.col("g")).where("doc <> of_doc or text_key <> of_key").drop("g")
        found.append(cut(compared(pairs, setting), "compared"))
        free_shuffles(spark)
        row = ["gram", *KEYS, "place"]
        short = found[-1].where(F.col("end") - F.col("first") < setting.least).select(*row).distinct()
        alone = cut(short, "short") if alone is None else alone
        met = cut(met.join(short, row, "left_semi"), "met")
        if met.isEmpty():
            break
    linked = cut(chain(reduce(DataFrame.unionByName, found), setting), "links")
    alone = uncovered(alone, linked, setting)
    if alone.isEmpty():
        return linked
    return reduce(DataFrame.unionByName, [linked, *left_over(every, alone, setting)])


def islands(places: DataFrame, into: str) -> DataFrame:
    """``places`` (doc, text_key, first, end) with the first word of the stretch of overlapping places that each is in."""
    order = Window.partitionBy(*KEYS).orderBy("first", "end")
    apart = F.col("first") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = places.withColumn("_n", F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(order))
    return numbered.withColumn(into, F.min("first").over(Window.partitionBy(*KEYS, "_n"))).drop("_n")


def clusters(docs: DataFrame, setting: Setting = Setting(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every stretch of a cluster: (doc, text_key, first_word, n_words, cluster, keeper, keeper_word, copies, removed)."""
    prepare(docs.sparkSession)
    found = links(documents_of(docs, id_col, text_col), setting)
    gone = found.select(*KEYS, "first", "end").distinct()
    kept = found.select(F.col("of_doc").alias("doc"), F.col("of_key").alias("text_key"), F.col("of_first").alias("first"), F.col("of_end").alias("end")).distinct()
    places = gone.withColumn("gone", F.lit(True)).unionByName(kept.withColumn("gone", F.lit(False))).groupBy(*KEYS, "first", "end").agg(F.max("gone").alias("gone"))
    places = cut(islands(places, "stretch").withColumn("node", F.xxhash64(*KEYS, "stretch")), "places")
    node = lambda p: places.select(*[F.col(c).alias(f"{p}{c}") for c in ("doc", "text_key", "first", "end", "node")])
    same = lambda p, names: [F.col(f"{p}{c}") == F.col(n) for c, n in zip(("doc", "text_key", "first", "end"), names)]
    edges = found.join(node("a_"), same("a_", (*KEYS, "first", "end"))).select("of_doc", "of_key", "of_first", "of_end", F.col("a_node").alias("a")).distinct()
    edges = edges.join(node("b_"), same("b_", ("of_doc", "of_key", "of_first", "of_end"))).select("a", F.col("b_node").alias("b"))
    labels = cut(components(edges), "labels")
    # a stretch without words that go stays; of others the words that go are rows
    stretches = places.groupBy(*KEYS, "stretch", "node").agg(F.max("gone").alias("gone"), F.max("end").alias("end"))
    rows = stretches.where("not gone").select(*KEYS, F.col("stretch").alias("first_word"), "end", "node", F.lit(False).alias("removed"))
    words = islands(places.where("gone").select(*KEYS, "first", "end", "node"), "first_word").groupBy(*KEYS, "first_word", "node").agg(F.max("end").alias("end"))
    rows = rows.unionByName(words.select(*KEYS, "first_word", "end", "node", F.lit(True).alias("removed")))
    rows = cut(rows.join(labels, "node").withColumn("n_words", F.col("end") - F.col("first_word")), "stretches")
    firsts = cut(rows.groupBy(F.col("label").alias("cluster")).agg(F.min(F.struct("removed", "doc", "first_word")).alias("kept"), F.count("*").alias("copies")), "clusters")
    out = rows.join(firsts, F.col("label") == F.col("cluster"))
    return out.select(*KEYS, "first_word", "n_words", "cluster", F.col("kept.doc").alias("keeper"), F.col("kept.first_word").alias("keeper_word"), "copies", "removed")




def without_words(text: str, spans: list[int]) -> str:
    """``text`` without the words of the flat (first, last + 1) spans, which are in order and may overlap; the white space before a removed word goes with it."""
    import re

    places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        start = places[a - 1][1] if a else 0
        out.append(text[at:start] if start > at else "")
        at = max(at, places[b - 1][1])
    out.append(text[at:])
    return "".join(out).lstrip(" \t\n\r\x0b\x0c") if spans and not spans[0] else "".join(out)


def remove_repeats(docs: DataFrame, setting: Setting = Setting(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text_col``; all other columns stay."""
    gone = clusters(docs, setting, id_col, text_col).where("removed")
    spans = gone.groupBy("doc", "text_key").agg(F.flatten(F.array_sort(F.collect_list(F.array(F.col("first_word"), F.col("first_word") + F.col("n_words"))))).alias("spans"))
    spans = spans.select(F.struct("doc", "text_key").alias("_millrace_key"), F.col("spans").alias("_millrace_spans"))
    key = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text_col).alias("text_key"))

    def edit(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        return pa.array([t if s is None or t is None else without_words(t, s) for t, s in zip(texts.to_pylist(), cuts.to_pylist())], pa.string())

    edit.__annotations__ = {"texts": pa.Array, "cuts": pa.Array, "return": pa.Array}
    changed = F.arrow_udf(edit, "string")
    joined = docs.withColumn("_millrace_key", key).join(spans, "_millrace_key", "left")
    return joined.withColumn(text_col, changed(F.col(text_col), F.col("_millrace_spans"))).select(*docs.columns)
