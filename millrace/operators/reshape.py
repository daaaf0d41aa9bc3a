"""Operators that make several rows or elements of one, joins and set-like operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.canonical import row_key
from millrace.operators.normalize import message, prepend_once
from millrace.sources.workers import written


def split_turns(df: DataFrame, key: str = "id", messages: str = "messages", prefix: str = "<video><audio>\n") -> DataFrame:
    """A row for each (user, assistant) pair.

    One-turn rows stay whole, rows without a pair vanish, an odd tail is
    dropped; pairs are counted from the first message, whatever its role.
    """
    n = F.floor(F.size(messages) / 2).cast("int")
    pair = lambda i: F.array(message(F.get(messages, 2 * i)["role"], prepend_once(F.get(messages, 2 * i)["content"], prefix)), F.get(messages, 2 * i + 1))
    whole = F.transform(messages, lambda m, i: F.when(i == 0, message(m["role"], prepend_once(m["content"], prefix))).otherwise(m))
    turns = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 1), pair)).when(n == 1, F.array(whole))
    rows = df.withColumn("_n", n).select("*", F.posexplode(turns).alias("turn", "_pair"))
    rows = rows.withColumn(messages, F.col("_pair")).withColumn(key, F.when(F.col("_n") > 1, F.concat(F.col(key).cast("string"), F.lit("_turn"), F.col("turn") + 1)).otherwise(F.col(key).cast("string")))
    return rows.drop("_pair", "_n")


def classification_pair(df: DataFrame, question: str, human: str, machine: str) -> DataFrame:
    """Two rows for each: a human's and a machine's answer with their labels."""
    both = F.array(F.struct(F.lit("Human").alias("label"), F.col(human).alias("answer")), F.struct(F.lit("ChatGPT").alias("label"), F.col(machine).alias("answer")))
    return df.select(question, F.explode(both).alias("_x")).select(question, "_x.*")


def json_messages(text: Column, role: str = "tool") -> Column:
    """The elements of a JSON array as messages."""
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    return F.transform(items, lambda v: message(role, F.to_json(v)))


def chunks(tokens: Column, longest: int) -> Column:
    """Chunks of a token array."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(longest))
    return F.when(F.size(tokens) > 0, F.transform(starts, lambda i: F.slice(tokens, i, longest)))


def time_captions(text: Column) -> Column:
    """(start, end, caption) of every time tag with a caption behind it; a single number is both ends."""
    pattern = r"(?s)<time>\s*([0-9.]+)\s*(?:-\s*([0-9.]+)\s*)?</time>\s*<caption>(.*?)</caption>"
    group = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    rows = F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c"))
    number = lambda c: c.try_cast("double")
    return F.transform(rows, lambda r: F.struct(number(r["a"]).alias("start"), F.coalesce(number(r["b"]), number(r["a"])).alias("end"), r["c"].alias("caption")))


def react_calls(text: Column) -> Column:
    """(tool, input) of every call written as Action and Action Input lines."""
    pattern = r"(?d)Action:\s*(.*?)\s*\nAction Input:\s*(.*?)\s*(?:\n|\z)"
    group = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    return F.transform(F.arrays_zip(group(1).alias("tool"), group(2).alias("input")), lambda r: F.struct(r["tool"].alias("tool"), r["input"].alias("input")))


def dialogue_pairs(text: Column, pattern: str = r"\n\n(?=Human:|Assistant:)") -> Column:
    """Alternating parts of a written dialogue as messages."""
    parts = F.filter(F.split(F.trim(text), pattern), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: message(F.when(F.startswith(p, F.lit("Human:")), "user").otherwise("assistant"), F.trim(F.regexp_replace(p, "^(Human|Assistant):", ""))))


def find_all(tokens: Column, part: Column) -> Column:
    """Places (from 0) where a token array has another inside."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - F.size(part), F.lit(0)))
    return F.filter(starts, lambda i: (F.size(part) > 0) & (F.slice(tokens, i + 1, F.size(part)) == part))


# --- joins -----------------------------------------------------------------


def cached_join(df: DataFrame, cache: DataFrame, fields: list[str], wanted: int, key: str = "row_md5", count: str = "n_choices") -> tuple[DataFrame, DataFrame]:
    """(rows with what the cache has for them, rows that still need work), by the identity of ``fields``.

    The cache has a row for each ``key``; rows with fewer than ``wanted`` choices are worked on again.
    """
    keyed, cache = written(df.withColumn(key, row_key(*fields)), "keyed"), written(cache, "cache")  # keys are dear, and both results need them
    done = cache.where(F.col(count) >= wanted).select(key)
    return keyed.join(cache, key, "left"), keyed.join(done, key, "left_anti")


def with_existing(df: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Rows whose file is in a listing."""
    return df.join(listing.select(F.col("path").alias(path)).distinct(), path, "left_semi")


def all_exist(df: DataFrame, listing: DataFrame, key: str, paths: str) -> DataFrame:
    """Rows all of whose paths are in a listing; empty lists and empty paths pass."""
    each = df.select(key, F.explode(paths).alias("path")).where(F.coalesce(F.col("path"), F.lit("")) != "")
    lost = each.join(listing.select("path").distinct(), "path", "left_anti").select(key).distinct()
    return df.join(lost, key, "left_anti")


def media_present(df: DataFrame, listing: DataFrame, media: str) -> DataFrame:
    """Rows with media (an array of paths) all of which are in a listing; rows without any, or with a null among them, go.

    Lists are looked up once each, so a list that many rows share is no hot group.
    """
    lists = df.select(media).where(F.size(media) > 0).distinct()
    lost = lists.select(media, F.explode(media).alias("path")).join(listing.select("path").distinct(), "path", "left_anti").select(media).distinct()
    return df.where(F.size(media) > 0).join(lost, media, "left_anti").select(df.columns)


def results_to_rows(rows: DataFrame, results: DataFrame, request: str = "request_id") -> DataFrame:
    """Request-level results on all rows of the request."""
    return rows.join(results, request)


def looked_up(code: Column, names: list[str]) -> Column:
    """The name of a class number, null out of range."""
    return F.get(F.array(*map(F.lit, names)), code.cast("int"))


def option_letter(index: Column) -> Column:
    return F.char(index + 65)


def outputs_to_inputs(outputs: DataFrame, inputs: DataFrame, order: str, request: str = "request_id") -> DataFrame:
    """Outputs with their inputs, the first input of a request counting; an output without one is an error."""
    others = [c for c in inputs.columns if c != request]
    first = inputs.groupBy(request).agg(F.min_by(F.struct(*others), order).alias("_i"))
    joined = outputs.join(first, request, "left")
    known = F.when(F.col("_i").isNotNull(), F.col("_i")).otherwise(F.raise_error(F.lit("an output without its input")))
    return joined.withColumn("_i", known.cast(first.schema["_i"].dataType)).select(*outputs.columns, *[F.col(f"_i.{c}").alias(c) for c in others if c not in outputs.columns])


# --- set-like --------------------------------------------------------------


def union_all(*frames: DataFrame) -> DataFrame | None:
    """Columns by name, missing ones null; none for none."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def source_of(place: Column, edges: list[float], seed: int) -> Column:
    """The source that the draw of a place gives; arithmetic on its number."""
    from millrace.operators.sampling import PRIME, draw

    u = draw(place, seed) / float(PRIME)
    source = F.lit(len(edges) - 1)
    for k in range(len(edges) - 2, -1, -1):
        source = F.when(u < edges[k], F.lit(k)).otherwise(source)
    return source


def draws_by_block(spark, source: Column, low: int, high: int, blocks: int = 1024) -> tuple[int, dict[int, dict[int, int]]]:
    """(width of a block, draws of each source by block) of the places from ``low`` to ``high`` - 1."""
    width = max(1, -(-(high - low) // blocks))
    rows = spark.range(low, high).groupBy(source.alias("s"), F.floor((F.col("id") - low) / width).alias("b")).count().collect()
    out: dict[int, dict[int, int]] = {}
    for r in rows:
        out.setdefault(r["s"], {})[r["b"]] = r["count"]
    return width, out


def last_place(spark, source: Column, shares: list[float], sizes: list[int], stop: str) -> int:
    """Where a source (``first_exhausted``) or all of them have been drawn as often as they have rows.

    Places are drawn up to a little more than the shares let expect, and twice as
    many where that is too few; then counts by block lead to the place. The
    driver sees at most 1,024 counts of a source at a time.
    """
    pick = min if stop == "first_exhausted" else max
    length = int(1.1 * pick(n / w for n, w in zip(sizes, shares))) + 64
    while True:
        width, counts = draws_by_block(spark, source, 0, length)
        reached = [k for k, n in enumerate(sizes) if sum(counts.get(k, {}).values()) >= n]
        if reached and (pick is min or len(reached) == len(sizes)):
            break
        length *= 2

    def place(k: int, low: int, high: int, width: int, counts: dict[int, int], n: int) -> int:
        """The place of the n-th draw of source k."""
        for b in sorted(counts):
            if counts[b] >= n:
                low, high = low + b * width, min(low + (b + 1) * width, high)
                break
            n -= counts[b]
        if width == 1:
            return low
        width, inner = draws_by_block(spark, source, low, high)
        return place(k, low, high, width, inner[k], n)

    return pick(place(k, 0, length, width, counts[k], sizes[k]) for k in reached)


def interleave(frames: list[DataFrame], weights: list[float], ordinal: str, seed: int = 42, stop: str = "first_exhausted", sizes: list[int] | None = None) -> DataFrame:
    """Rows in an order drawn by weights, with their place in ``position``.

    The draw of a place is arithmetic on its number, so it is made where the row
    is, and counts of draws say where to stop: as many places are drawn as rows
    are given out. An exhausted source begins again under ``all_exhausted``.
    Every source has rows, and every weight is above 0.
    """
    from millrace.operators.sampling import ranked

    spark = frames[0].sparkSession
    sizes = sizes or [f.count() for f in frames]
    if not all(sizes) or not all(w > 0 for w in weights):
        raise ValueError("sources have rows, and weights are above 0")
    shares = [w / sum(weights) for w in weights]
    edges, total = [], 0.0
    for w in shares:
        total += w
        edges.append(total)
    source = source_of(F.col("id"), edges, seed)
    last = last_place(spark, source, shares, sizes, stop)
    places = spark.range(last + 1).select(F.col("id").alias("position"), source.alias("source"))
    out = []
    for k, f in enumerate(frames):
        takes = ranked(places.where(F.col("source") == k), "position", "_take")
        rows = takes.withColumn("_row", F.col("_take") % sizes[k]).join(ranked(f, ordinal, "_row"), "_row").drop("_row", "_take")
        out.append(rows)
    return union_all(*out)


def distinct_paths(df: DataFrame, paths: str) -> DataFrame:
    return df.select(F.explode(paths).alias("path")).distinct().orderBy("path")


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of arrays with multiplicity: equal ones 1, an empty one 0."""
    times = lambda arr, v: F.size(F.filter(arr, lambda x: x == v))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, v: acc + F.least(times(a, v), times(b, v)))
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def cycle(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
