"""Benchmark decontamination with suffix arrays over the training texts.

Every batch of documents becomes a shard with a suffix array of its words.
Every suffix of every benchmark item is binary-searched in it: the range of
training suffixes that share the suffix's window gives the occurrences and
their places, and extending them gives the longest verbatim matches.

A window is ``window`` consecutive words of an item; an item of fewer words is
one window. Words are runs of ASCII digits, letters (A-Z count as a-z) and
non-ASCII characters. A document is contaminated if the words inside
occurrences are more than none and at least a 20th of its words.

Bounds: the array holds only suffixes that begin with an anchor (three words,
or the shortest window if that is less) of the benchmark, as no other suffix
can match; suffixes are ordered as far as the longest item. A shard is about
``SHARD_BYTES`` of text, or one document. The benchmark is compiled in blocks
of about ``BLOCK_CHARS``, which workers read one at a time from the shared
folder; there is no shuffle, and documents never leave their task.

Words are told apart by 64-bit hashes.

Defined results: a null text has no words and is clean; null items and items
without words have no window; items with equal ids count once, a null id is
the word ``null``; repeated documents are decided alike; with an empty
benchmark every document is clean.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import wordhash
from millrace.llm.runtime import SharedFiles, prepare, scratch

WINDOW = 13
ANCHOR = 3
SHARD_BYTES = 16 << 20
BLOCK_CHARS = 8 << 20
RESULT = (
    "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,contaminated:boolean,items:array<string>,longest_match:bigint,longest_item:string,longest_at:bigint>"
)


class Benchmark:
    """A block of items: word ids with zeros between items, its suffixes, and windows told apart by content."""

    FIELDS = ("vocabulary", "words", "at", "left", "window", "content", "names", "name_of", "anchor")

    def __init__(self, **fields):
        self.__dict__.update(fields)
        self.longest = int(self.left.max(initial=0))
        self.anchors = np.unique(keys_at(self.words, self.at, self.anchor, len(self.vocabulary) + 1)) if len(self.at) else np.empty(0, "i8")

    @classmethod
    def compile(cls, items: list[tuple[str, str | None]], window: int) -> "Benchmark":
        hashed = [np.empty(0, np.uint64)] * len(items)
        for first, last, run in wordhash.buffers([t for _, t in items]):
            found = wordhash.words(run, wordhash.MARKS)
            hashed[first:last] = np.split(found.hashes, found.edges[1:-1])
        vocabulary = np.unique(np.concatenate([*hashed, np.empty(0, np.uint64)]))
        words, at, left, wide, name_of, contents = [np.zeros(1, "i4")], [], [], [], [], {}
        content = []
        place = 1
        for k, h in enumerate(hashed):
            ids = (np.searchsorted(vocabulary, h) + 1).astype("i4")
            n = len(ids)
            for j in range(n):
                w = (min(n, window) if j == 0 else window) if j + min(n, window) <= n else 0
                at.append(place + j)
                left.append(n - j)
                wide.append(w)
                name_of.append(k)
                content.append(contents.setdefault(ids[j : j + w].tobytes(), len(contents)) if w else -1)
            words += [ids, np.zeros(1, "i4")]
            place += n + 1
        arrays = {n: np.array(x, "i8") for n, x in (("at", at), ("left", left), ("window", wide), ("content", content), ("name_of", name_of))}
        some = arrays["window"][arrays["window"] > 0]
        anchor = min(ANCHOR, int(some.min())) if len(some) else ANCHOR
        ok = arrays["left"] >= anchor
        return cls(
            vocabulary=vocabulary, words=np.concatenate([*words, np.zeros(window, "i4")]), names=np.array([i for i, _ in items], object), anchor=anchor, **{n: x[ok] for n, x in arrays.items()}
        )

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) if f != "names" else np.array("\x00".join(self.names)) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data) -> "Benchmark":
        found = np.load(io.BytesIO(bytes(data)))
        fields = {f: found[f] for f in cls.FIELDS}
        fields["names"] = np.array(str(fields["names"]).split("\x00"), object)
        fields["anchor"] = int(fields["anchor"])
        return cls(**fields)


def keys_at(words: np.ndarray, at: np.ndarray, anchor: int, base: int) -> np.ndarray:
    """The ``anchor`` words at each place as one number, in the order of the words."""
    key = np.zeros(len(at), "i8")
    for k in range(anchor):
        key = key * base + words[at + k]
    return key


class SuffixArray:
    """Suffixes of a shard that begin with one of the benchmark's anchors, ordered as far as its longest item."""

    def __init__(self, hashes: list[np.ndarray], bench: Benchmark):
        self.bench = bench
        lengths = np.fromiter(map(len, hashes), "i8", len(hashes))
        self.doc_start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        pad = bench.anchor + 2
        words = np.zeros(int(lengths.sum()) + len(hashes) + pad, "i4")
        all_hashes = np.concatenate([*hashes, np.empty(0, np.uint64)])
        vocabulary = bench.vocabulary
        if len(vocabulary):
            found = np.minimum(np.searchsorted(vocabulary, all_hashes), len(vocabulary) - 1)
            ids = np.where(vocabulary[found] == all_hashes, found + 1, 0).astype("i4")
            words[np.arange(len(ids)) + np.repeat(np.arange(len(hashes)), lengths)] = ids
        self.words = words
        base, g = len(vocabulary) + 1, bench.anchor
        body = len(words) - pad
        full = words[:body] > 0
        for k in range(1, g):
            full &= words[k : body + k] > 0
        here = np.flatnonzero(full)
        key = keys_at(words, here, g, base)
        if len(bench.anchors):
            spot = np.minimum(np.searchsorted(bench.anchors, key), len(bench.anchors) - 1)
            ok = bench.anchors[spot] == key
            here, key = here[ok], key[ok]
        else:
            here, key = here[:0], key[:0]
        self.array = self._ordered(here, g, base, body)
        self.keys = keys_at(words, self.array, g, base)

    def _ordered(self, here: np.ndarray, g: int, base: int, body: int) -> np.ndarray:
        """Prefix doubling over the kept suffixes and those that begin up to ``g`` words later."""
        if not len(here):
            return here
        close = np.unique(np.concatenate([here + k for k in range(g + 1)]))
        close = close[close < body]
        _, rank = np.unique(keys_at(self.words, close, g, base), return_inverse=True)
        ranks = np.zeros(body + 1, "i8")
        ranks[close] = rank + 1
        step = g
        while step < self.bench.longest:
            after = np.minimum(close + step, body)
            values, rank = np.unique(ranks[close] << 32 | ranks[after], return_inverse=True)
            ranks[close] = rank + 1
            if len(values) == len(close):
                break
            step *= 2
        return here[np.argsort(ranks[here], kind="stable")]

    def _before(self, suffix: np.ndarray, place: np.ndarray, limit: np.ndarray, equal: bool) -> np.ndarray:
        """Whether the training suffix comes before the benchmark suffix in its first ``limit`` words (or is equal there)."""
        out = np.full(len(suffix), equal)
        active = np.arange(len(suffix))
        for k in range(int(limit.max(initial=0))):
            active = active[limit[active] > k]
            if not len(active):
                break
            mine = self.words[np.minimum(self.array[place[active]] + k, len(self.words) - 1)]
            theirs = self.bench.words[self.bench.at[suffix[active]] + k]
            differ = mine != theirs
            out[active[differ]] = (mine < theirs)[differ]
            active = active[~differ]
        return out

    def ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix, first, last) for the benchmark suffixes with a window that occurs."""
        bench = self.bench
        suffix = np.flatnonzero(bench.window > 0)
        key = keys_at(bench.words, bench.at[suffix], bench.anchor, len(bench.vocabulary) + 1)
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        some = lo < hi
        suffix, lo, hi = suffix[some], lo[some], hi[some]
        limit = bench.window[suffix]
        bounds = []
        for equal in (False, True):
            a, b = lo.copy(), hi.copy()
            while (open_ := np.flatnonzero(a < b)).size:
                mid = (a[open_] + b[open_]) // 2
                before = self._before(suffix[open_], mid, limit[open_], equal)
                a[open_] = np.where(before, mid + 1, a[open_])
                b[open_] = np.where(before, b[open_], mid)
            bounds.append(a)
        found = bounds[0] < bounds[1]
        return suffix[found], bounds[0][found], bounds[1][found]

    def search(self, hit: np.ndarray, items: dict[int, set], longest: dict[int, tuple]) -> None:
        """Mark words inside occurrences, and note for each document its items and its longest match."""
        bench = self.bench
        seen: set[int] = set()
        edges = np.zeros(len(hit) + 1, "i4")
        for suffix, first, last in zip(*self.ranges()):
            at, wide, left = self.array[first:last], int(bench.window[suffix]), int(bench.left[suffix])
            name = bench.names[bench.name_of[suffix]]
            if bench.content[suffix] not in seen:
                seen.add(int(bench.content[suffix]))
                np.add.at(edges, at, 1)
                np.add.at(edges, at + wide, -1)
            docs = np.searchsorted(self.doc_start, at, side="right") - 1
            for d in np.unique(docs).tolist():
                items.setdefault(d, set()).add(name)
            # extend the matches that do not go on to the left
            begin = (at == self.doc_start[docs]) | (self.words[at - 1] != bench.words[bench.at[suffix] - 1]) | (bench.words[bench.at[suffix] - 1] == 0)
            at, docs = at[begin], docs[begin]
            length = np.full(len(at), wide)
            active = np.arange(len(at))
            for k in range(wide, left):
                active = active[self.words[at[active] + k] == bench.words[bench.at[suffix] + k]]
                if not len(active):
                    break
                length[active] = k + 1
            for d, n, p in zip(docs.tolist(), length.tolist(), (at - self.doc_start[docs]).tolist()):
                best = longest.get(d)
                if best is None or (-n, p, name) < (-best[0], -best[1], best[2]):
                    longest[d] = (n, -p, name)
        hit |= np.cumsum(edges[:-1]) > 0


_BLOCKS: dict[str, Benchmark] = {}


def _block(root: str, k: int) -> Benchmark:
    """A compiled block; the last one read stays in the process."""
    key = f"{root}/{k}"
    if key not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[key] = Benchmark.load(SharedFiles(root).map(f"{k}.npz"))
    return _BLOCKS[key]


def judge(texts: list[str | None], blocks) -> list[dict]:
    """Results of one shard of texts against blocks of a benchmark."""
    hashes: list[np.ndarray] = []
    for _, _, run in wordhash.buffers(texts):
        found = wordhash.words(run, wordhash.MARKS)
        hashes += np.split(found.hashes, found.edges[1:-1])
    items: dict[int, set] = {}
    longest: dict[int, tuple] = {}
    hit = np.zeros(sum(map(len, hashes)) + len(hashes), bool)
    for bench in blocks:
        SuffixArray(hashes, bench).search(hit, items, longest)
    out, at = [], 0
    for d, h in enumerate(hashes):
        n, k = len(h), int(hit[at : at + len(h)].sum()) if d in items else 0
        at += n + 1
        names = sorted(items.get(d, ()))
        best = longest.get(d, (None, None, None))
        out.append(
            {
                "n_words": n, "n_hit": k, "n_items": len(names), "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(),
                "contaminated": k > 0 and 20 * k >= n, "items": names, "longest_match": best[0], "longest_item": best[2], "longest_at": None if best[1] is None else -best[1],
            }
        )
    return out


def matcher(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text"):
    """Compile the benchmark; returns a function from a text column to the column of results."""
    spark = benchmark.sparkSession
    prepare(spark)
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text"))
    n_blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    root = scratch(spark, "benchmark")
    files = SharedFiles(root)
    for k in range(n_blocks):  # one block at a time, of bounded size
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k).collect()
        files.write(f"{k}.npz", [Benchmark.compile([tuple(r) for r in rows], window).dump()])

    def run(texts: pa.Array) -> pa.Array:
        out: list[dict] = []
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).cumsum()
        first = 0
        while first < len(texts):
            start = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, start + SHARD_BYTES, side="right")))
            out += judge(texts.slice(first, last - first).to_pylist(), (_block(root, k) for k in range(n_blocks)))
            first = last
        return pa.array(out, RESULT_TYPE)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    RESULT_TYPE = to_arrow_type(_parse_datatype_string(RESULT))
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    match = F.arrow_udf(run, RESULT).asNondeterministic()  # else Spark may run it again in a filter above
    return lambda text: match(text)


def flagged(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", into: str = "contamination", window: int = WINDOW) -> DataFrame:
    """``docs`` with a column of results; all other columns stay."""
    match: Column = matcher(benchmark, window)(F.col(text_col))
    return docs.withColumn(into, match)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without its contaminated rows."""
    name = "contamination"
    while name in docs.columns:
        name += "_"
    return flagged(docs, benchmark, text_col, name, window).where(~F.col(name)["contaminated"]).drop(name)
