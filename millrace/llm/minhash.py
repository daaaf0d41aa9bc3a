"""Near-duplicate detection by circulant MinHash.

Signatures use two permutations of the 32-bit numbers: the first scatters the
shingles, the second is shifted circularly, by k for coordinate k, over what
the first gives, so all coordinates come from one pair. Coordinates are cut
into bands; texts that agree in a whole band are candidates; a link needs the
exact Jaccard similarity of the full shingle sets.

How the work is kept proportional to the input:

* texts with the same shingle set are one node, so copies never meet in pairs;
* in a bucket (texts equal in a band) every node is held against one pivot
  first, the member that meets most others; pairs are grouped by pivot, large
  groups are salted, and a group streams through a task that holds one set;
* where that leaves one component, nothing more is done; in other buckets only
  nodes of different components are compared, in chunks of bounded size, each
  pair in the first bucket it shares, until its components are joined.

Components come from alternating large-star and small-star steps on tables.

A pair at the threshold agrees in none of ``bands`` bands of ``rows`` rows with
a probability of (1 - t**rows)**bands: 2e-5 for 40 bands of 5 at 0.75. Equal
sets and words are told by hashes of 128 and 64 bits.

Defined results: null, empty and blank texts have the empty set and no link;
texts of fewer words than a shingle have one shingle; equal sets are linked.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import wordhash
from millrace.llm.runtime import cut, discard, free_shuffles, prepare, tidy

#: Fixed parameters of the second permutation: multiply, fold, multiply.
PI = (np.uint32(0x7FEB352D), np.uint32(15), np.uint32(0x846CA68B))
SIGMA = (np.uint32(16), np.uint32(0x21F0AAAD), np.uint32(15), np.uint32(0x735A2D97), np.uint32(15))


@dataclass(frozen=True)
class Banding:
    bands: int = 40
    rows: int = 5
    numerator: int = 75  # a link: 100 * intersection >= numerator * union
    width: int = 5
    chunk: int = 256  # members of a bucket that one task holds at a time
    node_bits: int = 64


def circulant_signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Signatures, one row of ``size`` coordinates for each non-empty set."""
    lengths = np.fromiter(map(len, sets), "i8", len(sets))
    out = np.empty((len(sets), size), np.uint32)
    first = 0
    while first < len(sets):  # runs of about 16,384 shingles, to stay in the cache
        last, total = first, 0
        while last < len(sets) and (last == first or total + lengths[last] <= 16384):
            total += lengths[last]
            last += 1
        x = np.concatenate(sets[first:last])
        x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        x ^= x >> SIGMA[0]
        x *= SIGMA[1]
        x ^= x >> SIGMA[2]
        x *= SIGMA[3]
        x ^= x >> SIGMA[4]
        x *= PI[0]  # pi(sigma + k) begins with a product, which the shift by k only moves
        starts = np.concatenate([[0], np.cumsum(lengths[first : last - 1])])
        y, z = np.empty_like(x), np.empty_like(x)
        for k in range(size):
            np.add(x, np.uint32(k * int(PI[0]) & 0xFFFFFFFF), out=y)
            np.right_shift(y, PI[1], out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, PI[2], out=y)
            out[first:last, k] = np.minimum.reduceat(y, starts)
        first = last
    return out


def band_keys(signatures: np.ndarray, banding: Banding) -> np.ndarray:
    """A 64-bit bucket for each band."""
    cells = signatures.reshape(len(signatures), banding.bands, banding.rows).astype(np.uint64)
    weights = wordhash._PLACES[: banding.rows]
    return wordhash.mix((cells * weights).sum(axis=2, dtype=np.uint64) + wordhash.mix(np.arange(banding.bands, dtype=np.uint64) + np.uint64(1))).view("i8")


def node_of(items: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Node of a set and a check: two numbers of 64 bits from the digest of all its shingles; ``bits`` makes nodes smaller, for tests."""
    node, check = struct.unpack("<qq", hashlib.blake2b(items.tobytes(), digest_size=16).digest())
    return (node if bits == 64 else node % (1 << bits)), check


def told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` without their ``check``, where nodes that several sets have are told apart by it.

    Among 1e11 sets some hundreds have the 64 bits of another one. Only they get
    new nodes, from node and check, so sets are told by 128 bits.
    """
    shared = rows.where("node is not null").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    shared = cut(shared.where("low < high").select(F.col("node").alias("_shared")), "shared-nodes")
    if not shared.isEmpty():
        rows = rows.join(shared, F.col("node") == F.col("_shared"), "left")
        rows = rows.withColumn("node", F.when(F.col("_shared").isNotNull(), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("_shared")
    return rows.drop("check")


def sign(texts: list[str | None], banding: Banding):
    """(set size, node, check, buckets) of each text, as lists; None for empty sets."""
    sizes, nodes, checks, keys = [], [], [], []
    for _, _, run in wordhash.buffers(texts):
        sets = wordhash.shingles(wordhash.words(run, wordhash.WHITE), banding.width)
        full = [s for s in sets if len(s)]
        found = iter(band_keys(circulant_signatures(full, banding.bands * banding.rows), banding) if full else ())
        for s in sets:
            sizes.append(len(s))
            node, check = node_of(s, banding.node_bits) if len(s) else (None, None)
            nodes.append(node)
            checks.append(check)
            keys.append(next(found) if len(s) else None)
    return sizes, nodes, checks, keys


def signatures(rows: DataFrame, banding: Banding) -> DataFrame:
    """``rows`` with its last column, the text, replaced by ``n_shingles``, ``node``, ``check`` and ``buckets``. No shuffle."""
    prepare(rows.sparkSession)
    keys = rows.schema.fields[:-1]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", n_shingles long, node long, check long, buckets array<long>"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, nodes, checks, found = sign(part.column(len(keys)).to_pylist(), banding)
                cols = [part.column(i) for i in range(len(keys))]
                cols += [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, [*(f.name for f in keys), "n_shingles", "node", "check", "buckets"])
        tidy()

    return rows.mapInArrow(run, schema)


def verified(pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame], banding: Banding) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold. ``fetch`` gives (role columns..., text) for rows with a ``node``."""
    spark = pairs.sparkSession
    group = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("salts"))
    members = pairs.join(group, "a").select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("node"))
    heads = group.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("node"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    roles = fetch(members.unionByName(heads)).select("a", "salt", "role", "node", "text")
    roles = roles.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "role")
    share = banding.numerator

    def run(batches):
        head = head_set = None
        for batch in batches:
            out = []
            a, role, node, text = (batch.column(i) for i in (0, 2, 3, 4))
            a, role, node, at = a.to_pylist(), role.to_pylist(), node.to_pylist(), 0
            for first, last, buffer in wordhash.buffers(text.to_pylist()):
                for s in wordhash.shingles(wordhash.words(buffer, wordhash.WHITE), banding.width):
                    if role[at] == 0:
                        head, head_set = a[at], s
                    elif head == a[at]:
                        n, m = len(s), len(head_set)
                        if 100 * min(n, m) >= share * max(n, m):
                            common = len(np.intersect1d(s, head_set, assume_unique=True))
                            if 100 * common >= share * (n + m - common):
                                out.append((head, node[at]))
                    at += 1
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
        tidy()

    return roles.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges``; the label is the smallest node of its component."""

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def ordered(u, v):
        return F.least(u, v).alias("a"), F.greatest(u, v).alias("b")

    now = cut(edges.where("a <> b").select(*ordered(F.col("a"), F.col("b"))).distinct(), "edges")
    seen = state(now)
    while True:
        # large star: larger neighbours of a node go to the smallest of its neighbourhood
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")  # sides of their own, so that Spark can split the joins where a node is a hub
        large = both.where("v > u").join(least, "u").select(*ordered(F.col("v"), F.col("m"))).where("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        large = cut(large, "large")
        low = cut(large.groupBy("b").agg(F.min("a").alias("m")), "low")
        small = large.join(low, "b")
        small = small.select(*ordered(F.col("a"), F.col("m"))).union(small.select(*ordered(F.col("b"), F.col("m")))).where("a <> b").distinct()
        after = cut(small, "edges")
        found = state(after)
        for done in (now, least, large, low):
            discard(done)
        now = after
        if found == seen:
            break
        seen = found
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(now.select("a", "a").distinct())


def compared(open_: DataFrame, nodes: DataFrame, fetch: Callable[[DataFrame], DataFrame], banding: Banding) -> DataFrame:
    """Links between nodes of different components that share a bucket of ``open_`` (bucket, node, label).

    A bucket's members are dealt into chunks; the members outside the bucket's
    largest component stream past every chunk. A pair is compared in the first
    bucket it shares, and only while its components are not joined in the chunk.
    """
    spark = open_.sparkSession
    by_label = open_.groupBy("bucket", "label").count()
    largest = by_label.groupBy("bucket").agg(F.max(F.struct("count", "label"))["label"].alias("largest"), F.ceil(F.sum("count") / banding.chunk).cast("int").alias("chunks"))
    largest = cut(largest, "largest")  # a side of its own, as in `link`
    rows = open_.join(largest, "bucket").select("bucket", "node", "label", "chunks", (F.col("label") != F.col("largest")).alias("minor"))
    held = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int")).withColumn("passing", F.lit(False))
    passing = rows.where("minor and chunks > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("passing", F.lit(True))
    roles = fetch(held.unionByName(passing).join(nodes.select("node", "buckets"), "node"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["bucket", "chunk", "passing"]
    roles = roles.select(*order, "minor", "node", "label", "chunks", "buckets", "text").repartition(parts, "bucket", "chunk").sortWithinPartitions(*order, "node")
    share = banding.numerator

    def run(batches):
        group, members, keys, parent = None, [], None, {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        def against(node, label, minor, own, items, earlier):
            """Links of one node with the members held."""
            first = (keys[:earlier] == own).argmax(axis=1)
            for i in np.flatnonzero((keys[np.arange(earlier), first] == group[0]) & (own[first] == group[0])).tolist():
                other, other_label, other_minor, other_items = members[i]
                if root(label) == root(other_label) or not (minor or other_minor) or (minor and other_minor and node <= other):
                    continue
                n, m = len(items), len(other_items)
                if 100 * min(n, m) >= share * max(n, m):
                    common = len(np.intersect1d(items, other_items, assume_unique=True))
                    if 100 * common >= share * (n + m - common):
                        parent[root(label)] = root(other_label)
                        yield (other, node)

        for batch in batches:
            out = []
            cols = {n: batch.column(n) for n in batch.schema.names}
            plain = [cols[n].to_pylist() for n in ("bucket", "chunk", "passing", "minor", "node", "label", "chunks")]
            at = 0
            for _, _, buffer in wordhash.buffers(cols["text"].to_pylist()):
                for items in wordhash.shingles(wordhash.words(buffer, wordhash.WHITE), banding.width):
                    bucket, chunk, passes, minor, node, label, chunks = (c[at] for c in plain)
                    own = np.asarray(cols["buckets"][at].values)
                    at += 1
                    if group != (bucket, chunk):
                        group, members, keys, parent = (bucket, chunk), [], np.empty((64, len(own)), "i8"), {}
                    if not passes:  # members of a chunk come in rising order of nodes
                        if members and chunks == 1:
                            out += against(node, label, minor, own, items, len(members))
                        if len(members) == len(keys):
                            keys = np.concatenate([keys, np.empty_like(keys)])
                        keys[len(members)] = own
                        members.append((node, label, minor, items))
                    else:
                        out += against(node, label, minor, own, items, len(members))
            yield pa.RecordBatch.from_pydict({"a": pa.array([min(x) for x in out], pa.int64()), "b": pa.array([max(x) for x in out], pa.int64())})
        tidy()

    return roles.mapInArrow(run, "a long, b long")


def link(nodes: DataFrame, fetch: Callable[[DataFrame], DataFrame], banding: Banding) -> DataFrame:
    """(node, label) of all nodes that have a link. ``nodes`` has a row for each ``node``, with ``buckets``."""
    rows = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("bucket")
    shared = cut(shared, "shared")  # a side of its own, so that Spark can split the join where a bucket is hot
    free_shuffles(nodes.sparkSession)
    met = cut(rows.join(shared, "bucket"), "buckets")
    free_shuffles(nodes.sparkSession)
    # a bucket's pivot is the member that meets the most nodes over all of its buckets
    size = cut(met.groupBy("bucket").agg(F.count("*").alias("n")), "sizes")  # as with `shared`
    meets = met.join(size, "bucket").groupBy("node").agg(F.sum("n").alias("meets"))
    pivots = cut(met.join(meets, "node").groupBy("bucket").agg(F.max(F.struct("meets", "node"))["node"].alias("pivot")), "pivots")
    pairs = met.join(pivots, "bucket").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    edges = cut(verified(cut(pairs, "pairs"), fetch, banding), "links")
    free_shuffles(nodes.sparkSession)
    labels = cut(components(edges), "labels")
    # a bucket whose nodes are in one component has nothing left to compare
    held = cut(met.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "held")
    several = cut(held.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket"), "several")
    more = cut(compared(cut(held.join(several, "bucket"), "open"), nodes, fetch, banding), "links")
    return labels if more.isEmpty() else cut(components(edges.union(more)), "labels")


def near_duplicates(docs: DataFrame, banding: Banding = Banding(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) of each row.

    A row is kept if it has the smallest id that links reach. Null ids count as
    larger than all others; a row with a null id stays if nothing else is in
    its component. Repeated rows are decided alike.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed = told_apart(cut(signatures(base, banding), "signatures"))
    full = signed.where("node is not null")
    nodes = cut(
        full.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("rep"), F.first("buckets").alias("buckets")), "nodes"
    )

    def fetch(roles: DataFrame) -> DataFrame:
        where = roles.join(nodes.select("node", "rep.doc_id", "rep.text_hash"), "node")
        texts = base.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
        return where.join(texts, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")))

    labels = link(nodes.select("node", "buckets"), fetch, banding)
    smallest = nodes.join(labels, "node", "left").select("node", "rep.doc_id", F.coalesce("label", "node").alias("label"))
    ids = cut(smallest.groupBy("label").agg(F.min("doc_id").alias("component_id")), "ids")
    ids = cut(smallest.join(ids, "label").select("node", "component_id"), "component-ids")
    out = signed.select("doc_id", "text_hash", "n_shingles", "node").join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
