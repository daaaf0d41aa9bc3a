"""Filters and validation: every rejected row keeps the first rule that it broke."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.normalize import ROLES


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule whose condition holds; null for rows that pass."""
    out = None
    for name, broken in rules:
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return out


def split_by_reason(df: DataFrame, rules: list[tuple[str, Column]], reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rejected rows with their reason)."""
    marked = df.withColumn(reason, first_reason(rules))
    return marked.where(F.col(reason).isNull()).drop(reason), marked.where(F.col(reason).isNotNull())


def truthy(flag: Column) -> Column:
    """True for true, 'true', 'True', 1 and '1'."""
    return F.coalesce(flag.cast("string").isin("true", "True", "1"), F.lit(False))


def quality_rules(accuracy: Column, logic: Column, composite: Column, should_filter: Column, video_ok: Column | None = None, audio_ok: Column | None = None, format_error: Column | None = None):
    """The quality cascade in the order that owns rejected rows; missing accuracy counts as -1, other scores as 0."""
    rules = [(n, ~ok) for n, ok in (("video_path", video_ok), ("audio_path", audio_ok)) if ok is not None]
    if format_error is not None:
        rules.append(("format", format_error.isNotNull()))
    number = lambda c, d: F.coalesce(c.try_cast("double"), F.lit(float(d)))
    return rules + [
        ("answer_accuracy", number(accuracy, -1) != 10),
        ("question_logic", number(logic, 0) < 8),
        ("composite", number(composite, 0) < 7),
        ("should_filter", truthy(should_filter)),
    ]


def variant_score(v: Column, field: str, default: float) -> Column:
    """A nested score of a parsed record, the default for null, missing and non-numeric."""
    return F.coalesce(F.try_variant_get(v, f"$.quality_evaluation.scores.{field}", "double"), F.lit(float(default)))


def variant_kind(v: Column, path: str) -> Column:
    """Type name at a path: ARRAY, OBJECT, STRING, VOID and so on; null where it is missing."""
    return F.regexp_extract(F.schema_of_variant(F.variant_get(v, path, "variant")), r"^(\w+)", 1)


def format_error(v: Column) -> Column:
    """First format error of a record, null for none; a missing quality block is fine."""
    kind = lambda p: F.coalesce(variant_kind(v, p), F.lit("MISSING"))
    scores = [f"$.quality_evaluation.scores.{s}" for s in ("answer_accuracy_score", "question_logic_score", "composite_score")]
    bad = lambda p: ~kind(p).isin("MISSING", "VOID") & F.try_variant_get(v, p, "double").isNull()
    rules = [(f"no {f}", kind(f"$.{f}") == "MISSING") for f in ("messages", "videos", "audios")]
    rules += [(f"{f} is no list", kind(f"$.{f}") != "ARRAY") for f in ("messages", "videos", "audios")]
    rules.append(("quality_evaluation is no object", ~kind("$.quality_evaluation").isin("MISSING", "VOID", "OBJECT")))
    rules.append(("score is no number", reduce(lambda a, b: a | b, map(bad, scores))))
    return first_reason(rules)


REQUIRED = ("id", "Type", "messages", "problem", "solution", "videos", "audios")


def entry_error(v: Column) -> Column:
    """First error of a curated record under the strict rules."""
    kind = lambda p: F.coalesce(variant_kind(v, p), F.lit("MISSING"))
    messages = F.try_variant_get(v, "$.messages", "array<struct<role:string,content:string>>")
    size = lambda f: F.size(F.try_variant_get(v, f"$.{f}", "array<variant>"))
    rules = [("no object", kind("$") != "OBJECT")] + [(f"no {f}", kind(f"$.{f}") == "MISSING") for f in REQUIRED]
    rules += [(f"{f} is no list", kind(f"$.{f}") != "ARRAY") for f in ("messages", "videos", "audios")]
    rules += [(f"{f} is empty", size(f) == 0) for f in ("messages", "videos", "audios")]
    rules.append(("message without role and content", messages.isNull() | F.exists(messages, lambda m: m["role"].isNull() | m["content"].isNull())))
    rules.append(("unknown role", F.exists(messages, lambda m: ~m["role"].isin("user", "assistant", "system"))))
    rules += [(f"{f} is no text", ~kind(f"$.{f}").isin("STRING", "VOID")) for f in ("problem", "solution")]
    return first_reason(rules)


def validation_counts(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row: all lines, blank ones too, valid ones, format errors and parse errors; a line that is JSON but no object counts as both errors."""
    v = F.try_parse_json(F.col(value))
    blank = F.trim(value) == ""
    rows = lines.select(blank.alias("blank"), v.isNull().alias("broken"), entry_error(v).alias("error"))
    count = lambda c: F.count_if(c)
    seen = ~F.col("blank")
    return rows.agg(
        F.count("*").alias("total"),
        count(seen & ~F.col("broken") & F.col("error").isNull()).alias("valid"),
        count(seen & ~F.col("broken") & F.col("error").isNotNull()).alias("invalid_format"),
        count(seen & (F.col("broken") | (F.col("error") == "no object"))).alias("parse_error"),
    )


def valid_messages(messages: Column) -> Column:
    """Not empty, known roles, no null content."""
    ok = F.forall(messages, lambda m: m["role"].isin(*ROLES) & m["content"].isNotNull())
    return F.coalesce((F.size(messages) > 0) & ok, F.lit(False))


def valid_rejected(messages: Column, rejected: Column) -> Column:
    return F.coalesce(rejected.isNotNull() & (F.element_at(messages, -1)["content"] != rejected), F.lit(False))


def checked(df: DataFrame, ok: Column, strict: bool = False) -> DataFrame:
    """Rows for which a check holds; with ``strict`` another row is an error. For functions of rows see :mod:`millrace.operators.rows`."""
    good = F.coalesce(ok, F.lit(False))
    return df.where(F.when(good, True).otherwise(F.raise_error(F.lit("a row broke the check")).cast("boolean"))) if strict else df.where(good)


def free_of_words(messages: Column, words: list[str]) -> Column:
    """No message has one of the words, whatever the case."""
    low = lambda m: F.lower(m["content"])
    return ~F.exists(messages, lambda m: reduce(lambda a, b: a | b, [F.contains(low(m), F.lit(w.lower())) for w in words]))


def has_overlap(spans: Column) -> Column:
    """Whether sorted (start, end) spans meet."""
    s = F.array_sort(spans)
    pairs = F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1)))
    return (F.size(s) > 1) & F.exists(pairs, lambda i: F.get(s, i)[0] < F.get(s, i - 1)[1])


def fit_length(tokens: Column, longest: int, how: str, protected: int | None = None) -> Column:
    """Over-long token arrays cut to the left or right (protected ids stay), split into chunks, or null for dropping."""
    fits = F.size(tokens) <= longest
    if how == "raise":
        return F.when(fits, tokens)
    if how == "split":
        starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(longest))
        return F.transform(starts, lambda i: F.slice(tokens, i + 1, longest))
    if protected is None:
        return F.when(fits, tokens).otherwise(F.slice(tokens, 1, longest) if how == "right" else F.slice(tokens, -longest, longest))
    n_protected = F.size(F.filter(tokens, lambda t: t == protected))
    room = F.greatest(F.lit(longest) - n_protected, F.lit(0))
    places = F.transform(tokens, lambda t, i: F.struct((t == protected).alias("p"), i.alias("i"), t.alias("t")))
    others = F.filter(places, lambda x: ~x["p"])
    kept = F.slice(others, 1, room) if how == "right" else F.reverse(F.slice(F.reverse(others), 1, room))
    whole = F.array_sort(F.transform(F.concat(F.filter(places, lambda x: x["p"]), kept), lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"))))
    return F.when(fits, tokens).otherwise(F.transform(whole, lambda x: x["t"]))


def all_single_turn(messages: Column) -> Column:
    """Half the number of messages, rounded down, is one."""
    return F.floor(F.size(messages) / 2) == 1


def without_truncated(df: DataFrame, truncated: str = "truncated") -> DataFrame:
    return df.where(~F.col(truncated))


def resample_failed(rows: DataFrame, reserve: DataFrame, ok: str = "ok", slot: str = "ordinal") -> DataFrame:
    """Failing rows replaced by good rows of a reserve, in order; the columns are those of ``rows``.

    Slots are matched by rank, ranks by prefix sums over ranges of ordinals.
    """
    from millrace.operators.sampling import ranked

    bad = ranked(rows.where(~F.col(ok)), slot, "_rank").select(F.col(slot).alias("_slot"), "_rank")
    good = ranked(reserve.where(F.col(ok)), slot, "_rank")
    others = [c for c in rows.columns if c != slot]
    fill = bad.join(good, "_rank").select(F.col("_slot").alias(slot), *others)
    return rows.where(F.col(ok)).select(slot, *others).unionByName(fill)


def off_policy_keep(old: Column, new: Column, mask: Column, advantage: Column, delta: float) -> Column:
    """False where the masked mean of old minus new log-probabilities is beyond delta and the advantage is negative."""
    n = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m)
    drift = F.aggregate(F.zip_with(F.zip_with(old, new, lambda o, p: o - p), mask, lambda d, m: d * m), F.lit(0.0), lambda a, x: a + x)
    return ~((drift / F.greatest(n, F.lit(1.0)) > delta) & (advantage < 0))
