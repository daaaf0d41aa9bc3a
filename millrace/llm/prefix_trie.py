"""A prefix trie of conversations, merged from small tries of families.

Conversations are rebuilt first: conversation c begins with the first h turns of
its base conversation c - c % 20, h being the CRC-32 of c's decimal digits modulo
4, and goes on with its own turns after the first h. A node of depth d is a
distinct sequence of d rebuilt turns (role and text), and the conversations that
begin with it are its members.

A node's key is 128 bits and its depth: exclusive ors of a hash of each turn and
its place, so a key follows from any two parts of a prefix. Texts are hashed
where they are read and never move.

Families first: the turns of a family (all conversations of one base id) meet
the first turns of the base in a cogroup, where conversations are rebuilt and
the family's trie is built. Families then exchange combined nodes alone. A node
of one family only is final as it is, with all that is below it; only nodes that
several families have are merged. What is below those is summed by doubling:
each round adds the sums of the nodes 2**k levels down, so that any depth takes
its logarithm in rounds.

Bounds: conversations of more than ``section`` turns do not enter a family; they
go in sections of ranked turns, each a family of its own, whose first keys come
from the keys of whole sections before. So a family has at most 39 * ``section``
small rows. Ids that end at one node are gathered up to ``ends``; where there are
more, they are ranked over range partitions, joined to texts of ``ends`` ids,
and these stream in order through one running hash.

Defined results: turns are in order of ``turn``, nulls first, ties by a hash of
role and text; null roles and texts are empty; repeated rows are repeated turns;
% follows the sign of c, as in SQL; rows without an id are one conversation that
is not rebuilt, counts as a member, and has no decimal to list; an empty table
has no node.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import wordhash
from millrace.llm.runtime import cut, numbered, prepare

U = np.uint64
FAMILY, SHARED = 20, 4  # ids of a family; fewer turns than this come from the base
KEY = ["k1", "k2", "depth"]
SECTION, ENDS = 128, 1024
NODE = "k1 long, k2 long, depth long, p1 long, p2 long, conv_id long, parent_conv_id long, n_convs long, words long, n_children long, n_leaves long, saved long, ends array<long>"
NAMES = [c.split()[0] for c in NODE.split(", ")]


def shared_turns(conv_id: int | None) -> int:
    """How many first turns a conversation has from its base."""
    return 0 if conv_id is None else zlib.crc32(str(conv_id).encode()) % SHARED


def base_of(conv_id):
    """The id of the base conversation, as a column."""
    return conv_id - F.expr(f"conv_id % {FAMILY}")


def placed(h1: np.ndarray, h2: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each turn at its place (from 0)."""
    at = wordhash.mix(places.astype(U) + U(1))
    return wordhash.mix(h1.view(U) ^ at), wordhash.mix(h2.view(U) + at)


def narrow(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, h1, h2, words): what the trie needs of each row."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    return conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.length(role), F.reverse(text), role).alias("h2"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def family_trie(convs: list[tuple[int | None, list[tuple[int, int, int]]]]) -> list[tuple]:
    """The nodes of rebuilt conversations, each (id, turns as (h1, h2, words))."""
    known, nones = sorted((c for c in convs if c[0] is not None), key=lambda c: c[0]), [c for c in convs if c[0] is None]
    nodes: dict[tuple, list] = {}  # key: parent's key, words, members, smallest, children, ends
    for conv_id, turns in known + nones:
        node = nodes.setdefault((0, 0, 0), [None, 0, 0, conv_id, 0, []])
        key = (0, 0, 0)
        node[2] += 1
        if turns:
            t = np.array([x[:2] for x in turns], "i8")
            a, b = placed(t[:, 0].copy(), t[:, 1].copy(), np.arange(len(turns)))
            keys = zip(np.bitwise_xor.accumulate(a).view("i8").tolist(), np.bitwise_xor.accumulate(b).view("i8").tolist(), range(1, len(turns) + 1))
            for own, (_, _, words) in zip(keys, turns):
                child = nodes.get(own)
                if child is None:
                    child = nodes[own] = [key, words, 0, conv_id, 0, []]
                    node[4] += 1
                child[2] += 1
                node, key = child, own
        if conv_id is not None:
            node[5].append(conv_id)
    below = {k: [int(not v[4]), (v[2] - 1) * v[1]] for k, v in nodes.items()}
    for k in sorted(nodes, key=lambda k: -k[2]):
        if (parent := nodes[k][0]) is not None:
            for i in (0, 1):
                below[parent][i] += below[k][i]
    out = []
    for k, (parent, words, members, smallest, children, ends) in nodes.items():
        up = parent or (None, None)
        out.append((*k, up[0], up[1], smallest, nodes[parent][3] if parent else None, members, words, children, *below[k], ends))
    return out


def rebuilt(conv_id: int | None, own: list, base: list) -> list:
    h = shared_turns(conv_id)
    return base[:h] + own[h:]


def families(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """Nodes of the tries of families. ``heads`` has the first turns of all base conversations."""

    def build(head: pa.Table, rows: pa.Table) -> pa.Table:
        lists: dict = {}
        for t in sorted(zip(*(rows.column(n).to_pylist() for n in ("conv_id", "turn", "h1", "h2", "words"))), key=lambda t: (t[1] is not None, t[1] or 0, t[2], t[3])):
            lists.setdefault(t[0], []).append(t[2:])
        base = [t[1:] for t in sorted(zip(*(head.column(n).to_pylist() for n in ("place", "h1", "h2", "words"))))]
        nodes = family_trie([(c, rebuilt(c, own, base)) for c, own in lists.items()])
        return pa.table([pa.array(c, k) for c, k in zip(zip(*nodes), KINDS)] if nodes else [pa.array([], k) for k in KINDS], names=NAMES)

    left = heads.select(base_of(F.col("conv_id")).alias("base"), "place", "h1", "h2", "words")
    right = turns.select(base_of(F.col("conv_id")).alias("base"), "*")
    return left.groupBy("base").cogroup(right.groupBy("base")).applyInArrow(build, NODE)


KINDS = [pa.list_(pa.int64()) if c == "ends" else pa.int64() for c in NAMES]


def long_conversations(turns: DataFrame, heads: DataFrame, section: int) -> DataFrame:
    """Nodes of conversations of any length, each node with this one member."""
    ranked = numbered(turns, "conv_id", "turn", "h1", "h2").select(F.col("conv_id").alias("c"), "rank", "h1", "h2", "words")
    firsts = cut(ranked.groupBy("c").agg(F.min("rank").alias("first")), "firsts")
    ids = F.arrow_udf(_shared, "int")
    firsts = cut(firsts.withColumn("h", ids("c")), "firsts")
    bases = heads.groupBy(F.col("conv_id").alias("b")).agg(F.max("place").alias("n"))
    firsts = firsts.join(bases, F.expr(f"c - c % {FAMILY}") == F.col("b"), "left").select(F.col("c").alias("f"), "first", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("shared"))
    firsts = cut(firsts, "firsts")  # a side of its own, so that Spark can split the join where a conversation is hot
    own = ranked.join(firsts, F.col("c").eqNullSafe(F.col("f"))).where(F.col("rank") - F.col("first") >= F.col("h"))
    own = own.select("c", (F.col("rank") - F.col("first") - F.col("h") + F.col("shared")).alias("at"), "h1", "h2", "words")
    given = firsts.join(heads, F.expr(f"f - f % {FAMILY}") == F.col("conv_id")).where(F.col("place") <= F.col("shared"))
    rows = own.unionByName(given.select(F.col("f").alias("c"), (F.col("place") - 1).cast("long").alias("at"), "h1", "h2", "words"))
    rows = rows.withColumn("section", F.floor(F.col("at") / section)).select("c", "section", "at", "h1", "h2", "words")

    def fold(table: pa.Table, start: tuple[int, int]):
        order = np.argsort(np.asarray(table.column("at")), kind="stable")
        at, h1, h2 = (np.asarray(table.column(n))[order] for n in ("at", "h1", "h2"))
        a, b = placed(h1, h2, at)
        keys = [np.bitwise_xor.accumulate(x) ^ U(s & 0xFFFFFFFFFFFFFFFF) for x, s in zip((a, b), start)]
        return at, np.asarray(table.column("words"))[order], [k.view("i8") for k in keys]

    def whole(table: pa.Table) -> pa.Table:
        at, _, (a, b) = fold(table, (0, 0))
        return pa.table([table.column("c").slice(0, 1), table.column("section").slice(0, 1), pa.array(a[-1:]), pa.array(b[-1:])], names=["c", "section", "x1", "x2"])

    sums = cut(rows.groupBy("c", "section").applyInArrow(whole, "c long, section long, x1 long, x2 long"), "sections")
    before = Window.partitionBy("c").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("c").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sums.select("c", "section", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(s) for x, s in (("x1", "s1"), ("x2", "s2"))], F.max("section").over(last).alias("last"))

    def nodes(start: pa.Table, table: pa.Table) -> pa.Table:
        conv = table.column("c")[0].as_py()
        at, words, (a, b) = fold(table, (start.column("s1")[0].as_py(), start.column("s2")[0].as_py()))
        n, end = len(at), start.column("section")[0].as_py() == start.column("last")[0].as_py()
        up = [np.concatenate([[start.column(s)[0].as_py()], k[:-1]]) for s, k in (("s1", a), ("s2", b))]
        goes_on, ends = np.ones(n, "i8"), [[] for _ in range(n)]
        if end:
            goes_on[-1] = 0
            ends[-1] = [] if conv is None else [conv]
        one = np.ones(n, "i8")
        cols = [a, b, at + 1, *up, [conv] * n, [conv] * n, one, words, goes_on, one, one * 0, ends]
        return pa.table([pa.array(c, k) for c, k in zip(cols, KINDS)], names=NAMES)

    found = starts.groupBy("c", "section").cogroup(rows.groupBy("c", "section")).applyInArrow(nodes, NODE)
    root = {"conv_id": F.col("f"), "n_convs": F.lit(1), "words": F.lit(0), "n_children": F.lit(1), "n_leaves": F.lit(1), "saved": F.lit(0), "k1": F.lit(0), "k2": F.lit(0), "depth": F.lit(0), "ends": F.array()}
    kinds = dict(c.split() for c in NODE.split(", "))
    return found.unionByName(firsts.select(*[root.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in NAMES]))


def _shared(ids: pa.Array) -> pa.Array:
    return pa.array([shared_turns(i) for i in ids.to_pylist()], pa.int32())


def text_of(ids):
    """Decimal ids in rising order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), ",")


def on(left: list[str], right: list[str]):
    condition = F.lit(True)
    for a, b in zip(left, right):
        condition &= F.col(a) == F.col(b)
    return condition


def summed_below(nodes: DataFrame) -> DataFrame:
    """``nodes`` (key, key of the parent as u1, u2, up, leaves, saved) with sums over all that is below; rounds of doubling."""
    names = [*KEY, "u1", "u2", "up"]
    state = cut(nodes.select(*names, "leaves", "saved"), "below")
    deepest, step = state.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        added = state.where("up is not null").groupBy(F.col("u1").alias("a1"), F.col("u2").alias("a2"), F.col("up").alias("a3")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = state.where("depth > 0").select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("depth").alias("b3"), F.col("u1").alias("n1"), F.col("u2").alias("n2"), F.col("up").alias("n3"))
        added, above = cut(added, "added"), cut(above, "above")  # sides of their own, so that Spark can split the joins where a node has many below it
        rows = state.join(added, on(KEY, ["a1", "a2", "a3"]), "left").join(above, on(["u1", "u2", "up"], ["b1", "b2", "b3"]), "left")
        state = cut(
            rows.select(
                *KEY, F.col("n1").alias("u1"), F.col("n2").alias("u2"), F.col("n3").alias("up"),
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            ), "below",
        )
        step *= 2
    return state.select(*KEY, "leaves", "saved")


def hashed_ends(ends: DataFrame, bound: int) -> DataFrame:
    """(key, ends_sha256) of rows (key, n_ends, id)."""
    few = ends.where(F.col("n_ends") <= bound).groupBy(*KEY).agg(F.sha2(text_of(F.collect_list("id")), 256).alias("ends_sha256"))
    many = cut(ends.where(F.col("n_ends") > bound).select(*KEY, "id"), "many-ends")
    if many.isEmpty():
        return few
    ranked = numbered(many, *KEY, "id")
    firsts = cut(ranked.groupBy(*[F.col(k).alias(f"f_{k}") for k in KEY]).agg(F.min("rank").alias("first")), "firsts")
    ranked = ranked.join(firsts, on(KEY, [f"f_{k}" for k in KEY])).withColumn("chunk", F.floor((F.col("rank") - F.col("first")) / bound))
    texts = ranked.groupBy(*KEY, "chunk").agg(text_of(F.collect_list("id")).alias("text"))
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.repartition(parts, *KEY).sortWithinPartitions(*KEY, "chunk")

    def run(batches):
        key = digest = None
        for batch in batches:
            out = []
            for *own, text in zip(*(batch.column(n).to_pylist() for n in (*KEY, "text"))):
                if own != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in out], k) for i, (n, k) in enumerate(zip([*KEY, "ends_sha256"], [pa.int64()] * 3 + [pa.string()]))})
        if key:
            yield pa.RecordBatch.from_pydict({n: [x] for n, x in zip([*KEY, "ends_sha256"], [*key, digest.hexdigest()])})

    return few.unionByName(texts.mapInArrow(run, "k1 long, k2 long, depth long, ends_sha256 string"))


def trie(
    conversations: DataFrame, section: int = SECTION, ends: int = ENDS, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """A row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    if section < SHARED:
        raise ValueError("a section holds all turns that a base conversation gives")
    spark = conversations.sparkSession
    prepare(spark)
    turns = cut(narrow(conversations, id_col, turn_col, role_col, text_col), "turns")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2")
    heads = turns.where(f"conv_id % {FAMILY} = 0").withColumn("place", F.row_number().over(order)).where(F.col("place") < SHARED)
    heads = cut(heads.select("conv_id", "place", "h1", "h2", "words"), "heads")
    long_ = cut(turns.groupBy("conv_id").count().where(F.col("count") > section).select(F.col("conv_id").alias("c")), "long")
    if long_.isEmpty():
        found = families(turns, heads)
    else:
        of = F.col("conv_id").eqNullSafe(F.col("c"))
        found = families(turns.join(long_, of, "left_anti"), heads).unionByName(long_conversations(turns.join(long_, of, "left_semi"), heads, section))
    found = cut(found, "nodes")

    merged = found.groupBy(*KEY).agg(
        F.count("*").alias("families"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("words").alias("words"),
        F.sum(F.size("ends")).alias("n_ends"),
    )
    merged = cut(merged.where("families > 1").drop("families"), "merged")
    parents = merged.select(*[F.col(k).alias(f"m_{k}") for k in KEY], F.col("conv_id").alias("m_conv_id"), F.lit(True).alias("m"))
    of_parent = on(["p1", "p2", "above"], [f"m_{k}" for k in KEY])
    above, parent = F.col("depth") - 1, F.when(F.col("m"), F.col("m_conv_id"))
    alone = cut(found.join(merged.select(*KEY), KEY, "left_anti").withColumn("above", above).join(parents, of_parent, "left"), "alone")
    # what hangs below merged nodes
    tops = alone.where("m").groupBy(F.col("p1").alias("t1"), F.col("p2").alias("t2"), F.col("above").alias("t3")).agg(F.count("*").alias("tops"), F.sum("n_leaves").alias("top_leaves"), F.sum("saved").alias("top_saved"))
    inner = merged.where("depth > 0").groupBy(F.col("p1").alias("i1"), F.col("p2").alias("i2"), (F.col("depth") - 1).alias("i3")).agg(F.count("*").alias("inner"))
    rows = merged.join(tops, on(KEY, ["t1", "t2", "t3"]), "left").join(inner, on(KEY, ["i1", "i2", "i3"]), "left")
    rows = rows.withColumn("n_children", F.coalesce("tops", F.lit(0)) + F.coalesce("inner", F.lit(0)))
    rows = rows.withColumn("leaves", F.coalesce("top_leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long"))
    rows = rows.withColumn("saved", F.coalesce("top_saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words"))
    rows = rows.withColumns({"u1": F.col("p1"), "u2": F.col("p2"), "up": F.when(F.col("depth") > 0, F.col("depth") - 1)})
    rows = cut(rows.drop("t1", "t2", "t3", "i1", "i2", "i3", "top_leaves", "top_saved", "tops", "inner"), "merged")
    below = summed_below(rows)
    ended = found.where(F.size("ends") > 0).join(merged.where("n_ends > 0").select(*KEY, "n_ends"), KEY).select(*KEY, "n_ends", F.explode("ends").alias("id"))
    digests = hashed_ends(ended, ends)
    rows = rows.drop("leaves", "saved").join(below, KEY).join(digests, KEY, "left").withColumn("above", above).join(parents, of_parent, "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    rows = rows.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
    own_parent = F.when(F.col("m"), F.col("m_conv_id")).otherwise(F.col("parent_conv_id"))
    alone = alone.select("conv_id", "depth", own_parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.sha2(text_of("ends"), 256).alias("ends_sha256"))
    return alone.unionByName(rows)


#: The same in DuckDB; the CRC goes bit by bit, as it has no function for it.
SQL = """
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) as i from conversations),
own as (select conv_id, list({'role': role, 'text': text} order by i) as turns from t group by conv_id),
crc as (select *, xor(4294967295, list_reduce(list_prepend(4294967295::ubigint, flatten(list_transform(regexp_extract_all(conv_id::varchar, '.'), lambda ch: list_transform(range(8), lambda b: ((ascii(ch) >> b) & 1)::ubigint)))),
  lambda x, bit: xor(x >> 1, 3988292384::ubigint * xor(x & 1, bit)))) % 4 as h from own),
conv as (select c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) as turns from crc c left join own b on b.conv_id = c.conv_id - c.conv_id % 20),
prefix as (select conv_id, len(turns) as n, d as depth, turns[1:d] as p, turns[1:d - 1] as up from (select *, unnest(range(len(turns) + 1)) as d from conv)),
node as (select depth, p, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '')) as ends_sha256,
  case when depth > 0 then (count(*) - 1) * len(regexp_extract_all(p[depth].text, '[^\x20\x09-\x0D]+')) else 0 end as saved from prefix group by depth, p),
kids as (select up, count(*) as n from node where depth > 0 group by up),
known as (select node.*, coalesce(kids.n, 0) as n_children from node left join kids on kids.up = node.p),
below as (select q.p, sum(k.saved) as saved, count(*) filter (k.n_children = 0) as leaves from known k, (select distinct p as q, unnest(range(depth + 1)) as d from node) a, node q where a.q = k.p and q.p = a.q[1:a.d] group by q.p)
select k.conv_id, k.depth, u.conv_id as parent_conv_id, k.n_convs, k.n_children, b.leaves as n_leaves, b.saved::bigint as saved_tokens, k.ends_sha256
from known k join below b on b.p = k.p left join node u on u.p = k.up and k.depth > 0
"""
