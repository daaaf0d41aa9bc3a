"""Best-fit packing of whole documents into sequences of a fixed size.

The plan needs the histogram of piece lengths alone, which has at most
``capacity`` entries however many pieces there are. Exact-complement hashing
runs on it: an index holds combinations of one, two and three lengths by their
sum. Gaps are looked up in it, for single lengths first, then pairs, then
triples, each time from the longest length down, and a hit closes as many
sequences at once as the availability counts allow. When no gap has an exact
complement left, best fit packs the rest: the longest length that fits, until
the gap is closed or nothing fits.

The plan is a list of (sequence pattern, times). Every piece has a rank among
the pieces of its length; ranks are dealt to patterns by ranges, so pieces find
their sequence by binary search and are never gathered by length.

Defined results: a null text is empty and holds its end id; a document of more
than ``capacity`` tokens is cut into full pieces but for the first, which holds
the rest; an empty table gives no rows; repeated rows are packed each for
itself.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import memo_tokenizer
from millrace.llm.runtime import cut, prepare

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its rank among the pieces of its length in its partition. No shuffle."""
    prepare(docs.sparkSession)

    def encode(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tok = memo_tokenizer.load(tokenizer)
        end = np.array([end_id], tok.dtype).tobytes()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys = batch.column(0).slice(at, 256).to_pylist()
                out = []
                for key, packed in zip(keys, tok.encode(batch.column(1).slice(at, 256).to_pylist())):
                    ids = np.frombuffer(packed + end, tok.dtype).astype("<u4")
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        out.append((key, k, a, b - a, zlib.crc32(ids[a:b]), part, seen[b - a]))
                        seen[b - a] += 1
                cols = list(zip(*out))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part"]
                )

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    return rows.mapInArrow(encode, PIECE_SCHEMA)


@dataclass
class Plan:
    """``patterns``: (lengths of a sequence, times). The arrays say, for each length, which ranks go where."""

    patterns: list[tuple[tuple[int, ...], int]]

    def tables(self):
        """Per length: first ranks of runs (sorted), first sequence of each run and the offset in it."""
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        sequence = 0
        for lengths, times in self.patterns:
            offset = 0
            for n in lengths:
                runs[n].append((used[n], sequence, offset))
                used[n] += times
                offset += n
            sequence += times
        return {n: tuple(np.array(c, "i8") for c in zip(*r)) for n, r in runs.items()}

    @property
    def sequences(self) -> int:
        return sum(t for _, t in self.patterns)


class SumIndex:
    """Combinations of one, two and three available lengths by their sum.

    ``pairs[s]`` holds pairs of lengths, ``triples[s]`` a pair's sum with a third
    length; the longest lengths come last, where a lookup begins. Counts only
    fall, so a combination that is not there any more never comes back and is
    dropped when a lookup meets it: all lookups together cost no more than the
    index has entries, about ``capacity**2``.
    """

    def __init__(self, have: list[int], reach: int):
        self.have = have
        capacity, lengths = len(have) - 1, [n for n, c in enumerate(have) if c and n]
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.triples: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if reach > 1:
            for k, a in enumerate(lengths):
                for b in lengths[: k + 1]:
                    if a + b > capacity:
                        break
                    self.pairs[a + b].append((a, b))
        if reach > 2:
            for total in sorted(self.pairs, reverse=True):  # a small pair's sum is met with a long third
                for c in lengths:
                    if total + c > capacity:
                        break
                    self.triples[total + c].append((total, c))

    def there(self, *lengths: int) -> bool:
        return all(self.have[n] >= lengths.count(n) for n in lengths)

    def pair(self, total: int, *held: int) -> tuple[int, int] | None:
        """Two lengths of this sum that are there beside those held."""
        entries = self.pairs.get(total, [])
        for i in range(len(entries) - 1, -1, -1):
            if self.there(*entries[i], *held):
                return entries[i]
            if not self.there(*entries[i]):
                entries.pop(i)
        return None

    def triple(self, total: int, held: int) -> tuple[int, int, int] | None:
        entries = self.triples.get(total, [])
        for i in range(len(entries) - 1, -1, -1):
            two, c = entries[i]
            if self.there(c, held) and (found := self.pair(two, c, held)):
                return (c, *found)
            if not self.have[c] or not self.pairs[two]:
                entries.pop(i)
        return None

    def filling(self, gap: int, held: int, size: int) -> tuple[int, ...] | None:
        """So many lengths of exactly this sum that are there beside the one held."""
        if size == 1:
            return (gap,) if self.there(gap, held) else None
        return self.pair(gap, held) if size == 2 else self.triple(gap, held)


def plan_packing(histogram: dict[int, int], capacity: int) -> Plan:
    """The plan of fewest sequences among those that look for complements of up to three, two and one lengths."""
    return min((_plan(histogram, capacity, reach) for reach in (3, 2, 1)), key=lambda p: p.sequences)


def _plan(histogram: dict[int, int], capacity: int, reach: int) -> Plan:
    """Exact complements from the index of sums while there are any, then best fit for what is left."""
    have = [histogram.get(n, 0) for n in range(capacity + 1)]
    index = SumIndex(have, reach)
    patterns: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> None:
        need = {n: lengths.count(n) for n in lengths}
        times = min(have[n] // k for n, k in need.items())
        for n, k in need.items():
            have[n] -= k * times
        patterns.append((lengths, times))

    if have[capacity]:
        take((capacity,))
    for size in range(1, reach + 1):
        for n in range(capacity - 1, 0, -1):
            while have[n] and (found := index.filling(capacity - n, n, size)):
                take((n, *found))
    for n in range(capacity, 0, -1):  # no gap can be filled exactly now
        while have[n]:
            bin_, left = [n], capacity - n
            have[n] -= 1
            while fits := [x for x in range(min(left, n), 0, -1) if have[x]][:1]:
                bin_ += fits
                have[fits[0]] -= 1
                left -= fits[0]
            for x in bin_:
                have[x] += 1
            take(tuple(bin_))
    return Plan(patterns)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: document, piece, start, length, checksum, sequence and offset in it."""
    cutting = cut(pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    counts = cutting.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most `capacity` rows
    tables = plan_packing(histogram, capacity).tables()

    def place(batches):
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = np.asarray(cols["length"]), np.asarray(cols["rank"])
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:]):
                at = order[a:b]
                first, seq, off = tables[int(length[at[0]])]
                run = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = seq[run] + rank[at] - first[run]
                offset[at] = off[run]
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(cols[n] for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    ranked = cutting.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("rank_in_part"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
