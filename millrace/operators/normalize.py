"""Row-to-row operators: renames, conversation layouts, media columns, messages.

Messages are ``array<struct<role, content, loss>>``. Builders work on columns
where the layout is fixed and on DataFrames where it depends on which columns
are there.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip

MESSAGES = "array<struct<role:string,content:string,loss:double>>"
ROLES = ("system", "user", "tool_call", "tool_response", "tool", "assistant")
MEDIA = ("images", "videos", "audios")

#: Other names of the standard columns.
MEDIA_ALIASES = {"image": "images", "video": "videos", "audio": "audios"}
RESPONSE_ALIASES = {
    **dict.fromkeys(["system", "system_prompt"], "system"),
    **dict.fromkeys(["query", "prompt", "input", "instruction", "question", "problem"], "query"),
    **dict.fromkeys(["response", "answer", "output", "targets", "target", "answer_key", "answers", "solution", "text", "completion", "content"], "response"),
}
MESSAGES_ALIASES = dict.fromkeys(["conversation", "conversations", "messages"], "messages")
PREFIXES = ("rejected_", "positive_", "negative_", "chosen_")
STANDARD = (
    ["messages", "rejected_messages", "positive_messages", "negative_messages", "rejected_response", "label", "channel", "margin", "tools", "objects", *MEDIA, "solution"]
    + [f"{p}{c}" for p in ("rejected_", "positive_", "negative_") for c in (*MEDIA, "tools", "objects")]
)

USER, ASSISTANT, TOOL = ("user", "human"), ("assistant", "gpt", "bot"), ("tool", "tool_response", "observation")


def message(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"), F.lit(None).cast("double").alias("loss"))


def conversations_to_messages(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row for each conversation, its turns in order."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(ordered.alias("m")).select(key, F.transform("m", lambda m: message(m["role"], m["content"])).alias("messages"))


# --- columns ---------------------------------------------------------------


def constant(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def rename_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Case-insensitive renames; where two columns claim one name neither gets it, and a column that has the name counts."""
    lower = {k.lower(): v for k, v in aliases.items()}
    claims: dict[str, list[str]] = {}
    for c in df.columns:
        if c.lower() in lower:
            claims.setdefault(lower[c.lower()], []).append(c)
    return df.withColumnsRenamed({cs[0]: to for to, cs in claims.items() if len(cs) == 1 and cs[0] != to and to not in df.columns})


def keep_standard(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c in STANDARD])


def drop_fields(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """``prefix + k`` becomes ``k`` if there is none yet; the prefixed column goes in any case."""
    for c in [c for c in df.columns if c.startswith(prefix)]:
        name = c[len(prefix) :]
        df = df.drop(c) if name in df.columns else df.withColumnRenamed(c, name)
    return df


def cast_media(df: DataFrame) -> DataFrame:
    """A string, a struct or an array of them becomes an array; images become structs of bytes and path."""
    kinds = dict(df.dtypes)
    image = lambda c: F.struct(F.lit(None).cast("binary").alias("bytes"), c.alias("path"))
    for c in [c for c in df.columns if c.removeprefix("rejected_").removeprefix("positive_").removeprefix("negative_") in MEDIA]:
        col = F.col(c)
        if not kinds[c].startswith("array"):
            col = F.when(col.isNotNull(), F.array(col))
        if c.endswith("images") and "struct" not in kinds[c]:
            col = F.transform(col, image)
        df = df.withColumn(c, col)
    return df


def prune_messages(messages: Column) -> Column:
    """Only role, content and loss of each message."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["loss"].alias("loss")))


def order_boxes(boxes: Column) -> Column:
    """Corners in rising order; points stay; other lengths are an error."""

    def fix(b: Column) -> Column:
        box = F.array(F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3]))
        return F.when(F.size(b) == 4, box).when(F.size(b) == 2, b).otherwise(F.raise_error(F.lit("a box has 2 or 4 numbers")))

    return F.transform(boxes, fix)


def normalise_boxes(boxes: Column, width: Column, height: Column, kind: Column, to_real: bool = False) -> Column:
    """Real or unit boxes to whole numbers of 1000 (or to real sizes), rounded half to even."""

    def scale(b: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            side = F.when(i % 2 == 0, width).otherwise(height)
            unit = F.when(kind == "norm1", x).otherwise(x / side)
            return F.bround(unit * side if to_real else unit * 1000).cast("long")

        return F.transform(b, one)

    return F.transform(boxes, scale)


# --- layouts ---------------------------------------------------------------


def response_to_messages(system: Column, query: Column, response: Column, history: Column | None = None) -> Column:
    """System, history pairs, query and response as messages, nulls left out."""
    parts = [F.when(system.isNotNull(), F.array(message("system", system)))]
    if history is not None:
        parts.append(F.flatten(F.transform(history, lambda h: F.array(message("user", h[0]), message("assistant", h[1])))))
    parts.append(F.array(message("user", query), message("assistant", response)))
    whole = F.concat(*[F.coalesce(p, F.array().cast(MESSAGES)) for p in parts])
    return F.filter(whole, lambda m: m["content"].isNotNull())


def messages_to_history(messages: Column) -> Column:
    """(system, history, query, response); a missing last answer is null."""
    leading = F.element_at(messages, 1)["role"] == "system"
    rest = F.when(leading, F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    n = F.floor((F.size(rest) + 1) / 2).cast("int")
    pair = lambda i: F.array(F.get(rest, 2 * i)["content"], F.get(rest, 2 * i + 1)["content"])
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), pair)).otherwise(F.array().cast("array<array<string>>"))
    last = F.try_element_at(pairs, F.lit(-1))
    history = F.slice(pairs, 1, F.greatest(n - 1, F.lit(0)))
    return F.struct(
        F.when(leading, F.element_at(messages, 1)["content"]).alias("system"), history.alias("history"), F.get(last, F.lit(0)).alias("query"), F.get(last, F.lit(1)).alias("response")
    )


def alpaca_query(instruction: Column, given: Column) -> Column:
    """Instruction and input on two lines where both have text, else the one that has."""
    has = lambda c: c.isNotNull() & (c != "")
    return F.when(has(instruction) & has(given), F.concat(instruction, F.lit("\n"), given)).when(has(instruction), instruction).otherwise(given)


def alpaca_to_messages(instruction: Column, given: Column, output: Column, system: Column | None = None) -> Column:
    return response_to_messages(F.lit(None).cast("string") if system is None else system, alpaca_query(instruction, given), output)


def standard_role(role: Column) -> Column:
    tool = F.replace(role, F.lit("-"), F.lit("_"))
    return F.when(role.isin(*USER), "user").when(role.isin(*ASSISTANT), "assistant").when(tool.isin(*TOOL), "tool").when(tool.isin("function_call", "tool_call"), "tool_call").otherwise(role)


def standard_messages(messages: Column, role: str = "role", content: str = "content", system: Column | None = None) -> Column:
    """Role and key synonyms to the standard ones; a system text goes in front."""
    std = F.transform(messages, lambda m: message(standard_role(m[role]), m[content]))
    if system is None:
        return std
    first_is_system = F.element_at(std, 1)["role"] == "system"
    return F.when(system.isNotNull() & ~F.coalesce(first_is_system, F.lit(False)), F.concat(F.array(message("system", system)), std)).otherwise(std)


def sharegpt_to_messages(pairs: Column, system: Column | None = None, user: str = "human", assistant: str = "assistant") -> Column:
    flat = F.flatten(F.transform(pairs, lambda p: F.array(message("user", p[user]), message("assistant", p[assistant]))))
    return flat if system is None else F.concat(F.coalesce(F.when(system.isNotNull(), F.array(message("system", system))), F.array().cast(MESSAGES)), flat)


def literal_conversations(text: Column, schema: str = "array<struct<from:string,value:string>>") -> Column:
    """Conversations written as a Python literal, also without commas between their braces; null where they are not one."""
    import ast
    import re

    @F.pandas_udf("string")
    def repair(rows: pd.Series) -> pd.Series:
        def one(t):
            import json

            for fixed in (t, re.sub(r"\}\s*\{", "}, {", t or "")):
                try:
                    return json.dumps(ast.literal_eval(fixed), ensure_ascii=False)
                except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                    continue
            return None

        return rows.map(one)

    return F.from_json(repair(text), schema)


def class_label(label: Column) -> Column:
    return label.cast("int")


def auto_messages(df: DataFrame) -> DataFrame:
    """Messages from whichever layout the columns show: conversations, instruction and input, or query and response."""
    names = {c.lower() for c in df.columns}
    if names & {"conversation", "conversations", "messages"}:
        df = rename_aliases(df, MESSAGES_ALIASES)
        fields = [f.name for f in df.schema["messages"].dataType.elementType.fields]
        system = F.col("system") if "system" in df.columns else None
        if "human" in fields:
            return df.withColumn("messages", sharegpt_to_messages(F.col("messages"), system))
        return df.withColumn("messages", standard_messages(F.col("messages"), "from" if "from" in fields else "role", "value" if "value" in fields else "content", system))
    system = F.col("system") if "system" in names else F.lit(None).cast("string")
    if {"instruction", "input"} <= names:
        return df.withColumn("messages", alpaca_to_messages(F.col("instruction"), F.col("input"), F.col("output"), system))
    df = rename_aliases(df, RESPONSE_ALIASES)
    query = F.col("query") if "query" in df.columns else F.lit(None).cast("string")
    return df.withColumn("messages", response_to_messages(system, query, F.col("response"), F.col("history") if "history" in df.columns else None))


def fill_prompt(template: str, query: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{{QUERY}}"), query)


def class_prompt(task: str, labels: list[str], sentence: Column, label: Column, second: Column | None = None) -> tuple[Column, Column]:
    """(query, response) that asks for one of the labels; the response is null for null labels."""
    given = F.concat(F.lit("Sentence: "), sentence) if second is None else F.concat(F.lit("Sentence1: "), sentence, F.lit("\nSentence2: "), second)
    query = F.concat(F.lit(f"Task: {task}\n"), given, F.lit(f"\nCategory: {', '.join(labels)}\nOutput:"))
    return query, F.get(F.array(*map(F.lit, labels)), label)


def pick(seed: int, key: Column, choices: list[str]) -> Column:
    """A choice by a hash of the key: the same on every run, whatever the partitions."""
    return F.get(F.array(*map(F.lit, choices)), (_draw(seed, key) % len(choices)).cast("int"))


def _draw(seed: int, key: Column) -> Column:
    """A number from 0 to 2**31 - 1 from an integer key, in arithmetic that every engine shares."""
    x = (key.cast("long") % 1000003 * 48271 + seed) % 2147483647
    return (x * 69621 + 11) % 2147483647


# --- curation layouts ------------------------------------------------------


def video_messages(turns: Column) -> Column:
    """human is user, anything else assistant; image tags stand for video and audio."""
    tags = lambda c: F.replace(c, F.lit("<image>"), F.lit("<video><audio>"))
    return F.transform(turns, lambda t: message(F.when(t["from"] == "human", "user").otherwise("assistant"), tags(t["value"])))


def problem_and_solution(turns: Column) -> tuple[Column, Column]:
    """First human text before the first answer, with tags replaced, and the first answer."""
    answer = F.array_position(F.transform(turns, lambda t: t["from"]), "gpt").cast("int")
    human = F.array_position(F.transform(turns, lambda t: t["from"]), "human").cast("int")
    seen = (human > 0) & ((answer == 0) | (human < answer))
    problem = F.replace(F.get(turns, human - 1)["value"], F.lit("<image>"), F.lit("<video><audio>"))
    return F.when(seen, problem), F.when(answer > 0, F.get(turns, answer - 1)["value"])


def vista_messages(turns: Column) -> Column:
    """Only human and gpt turns; image tags stand for video."""
    known = F.filter(turns, lambda t: t["from"].isin("human", "gpt"))
    return F.transform(known, lambda t: message(F.when(t["from"] == "human", "user").otherwise("assistant"), F.replace(t["value"], F.lit("<image>"), F.lit("<video>"))))


def audio_path(video: Column, video_base: str, audio_base: str) -> Column:
    """The audio file beside a video: other base, ``.mp3`` for ``.mp4``."""
    return F.regexp_replace(F.replace(video, F.lit(video_base), F.lit(audio_base)), r"\.mp4\z", ".mp3")


def audio_path_in(video: Column, folder: str) -> Column:
    """The audio file of a video's name in another folder."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_replace(F.regexp_extract(video, r"([^/]*)\z", 1), r"\.mp4\z", ".mp3"))


def add_audio(df: DataFrame, folder: str) -> DataFrame:
    """``video`` becomes ``videos`` and ``audios``; video tags get an audio tag in messages, problem and solution."""
    tags = lambda c: F.replace(c, F.lit("<video>"), F.lit("<video><audio>"))
    return df.withColumns(
        {
            "videos": F.array("video"),
            "audios": F.array(audio_path_in(F.col("video"), folder)),
            "messages": F.transform("messages", lambda m: message(m["role"], tags(m["content"]))),
            "problem": tags(F.col("problem")),
            "solution": tags(F.col("solution")),
        }
    ).drop("video")


def append_once(c: Column, suffix: str) -> Column:
    return F.when(F.endswith(c, F.lit(suffix)), c).otherwise(F.concat(c, F.lit(suffix)))


def prepend_once(c: Column, prefix: str = "<video><audio>\n") -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), c).otherwise(F.concat(F.lit(prefix), c))


def instruct_users(messages: Column, suffix: str) -> Column:
    """A suffix on every user message that lacks it."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "user", append_once(m["content"], suffix)).otherwise(m["content"]).alias("content"), m["loss"].alias("loss")))


def instruct_last_user(messages: Column, suffix: str) -> Column:
    """A suffix on the last user message alone."""
    at = F.size(messages) - F.array_position(F.reverse(F.transform(messages, lambda m: m["role"])), "user").cast("int")
    return F.transform(messages, lambda m, i: F.when((i == at) & (m["role"] == "user"), message(m["role"], F.concat(m["content"], F.lit(suffix)))).otherwise(m))


def replace_paths(line: Column, paths: dict[str, str]) -> tuple[Column, Column]:
    """A raw line with paths replaced in keys and values alike, and whether it changed."""
    new = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), paths.items(), line)
    return new, new != line


def replace_in_values(line: Column, old: str, new: str) -> Column:
    """A JSON line with text replaced in values only; a line that is no JSON comes back stripped, a blank one as null."""
    import json

    def walk(v):
        if isinstance(v, str):
            return v.replace(old, new)
        if isinstance(v, list):
            return [walk(x) for x in v]
        if isinstance(v, dict):
            return {k: walk(x) for k, x in v.items()}
        return v

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        def one(t):
            t = t.strip() if t is not None else ""
            if not t:
                return None
            try:
                return json.dumps(walk(json.loads(t)), ensure_ascii=False)
            except ValueError:
                return t

        return rows.map(one)

    return run(line)


# --- inputs of templates ---------------------------------------------------


def tool_messages(messages: Column) -> tuple[Column, Column]:
    """(system text of a leading system message, the rest with tool replies under one role)."""
    leading = F.coalesce(F.element_at(messages, 1)["role"] == "system", F.lit(False))
    rest = F.when(leading, F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    rest = F.transform(rest, lambda m: message(F.when(m["role"] == "tool_response", "tool").otherwise(m["role"]), m["content"]))
    return F.when(leading, F.element_at(messages, 1)["content"]), rest


def flatten_content(parts: Column) -> tuple[Column, Column]:
    """Content parts (type, text, url) to one text with media tags, and the list of media values."""
    kind = lambda p: F.regexp_replace(p["type"], "_url$", "")
    text = F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", p["text"]).otherwise(F.concat(F.lit("<"), kind(p), F.lit(">")))), "")
    return text, F.transform(F.filter(parts, lambda p: p["type"] != "text"), lambda p: F.coalesce(p["url"], p["text"]))


def unflatten_variants(df: DataFrame) -> DataFrame:
    """Prefixed columns to structs; what a rejected row lacks it takes from the chosen one."""
    chosen = [c for c in df.columns if not c.startswith(PREFIXES)]
    rejected = [F.coalesce(F.col(f"rejected_{c}"), F.col(c)).alias(c) if f"rejected_{c}" in df.columns else F.col(c) for c in chosen]
    return df.select(F.struct(*chosen).alias("chosen"), F.struct(*rejected).alias("rejected"))


def rejected_messages(messages: Column, rejected: Column) -> Column:
    """Messages up to the last user or tool turn and then the rejected answer, which must differ from the given one."""
    turn = lambda m: m["role"].isin("user", "tool", "tool_response")
    n = F.size(messages) - F.array_position(F.reverse(F.transform(messages, turn)), True).cast("int") + 1
    same = F.element_at(messages, -1)["content"] == rejected
    whole = F.concat(F.slice(messages, 1, n), F.array(message("assistant", rejected)))
    return F.when(F.coalesce(same, F.lit(False)), F.raise_error(F.lit("the rejected answer is the given one")).cast(MESSAGES)).otherwise(whole)


def remove_response(messages: Column) -> tuple[Column, Column]:
    """(messages without a trailing answer, that answer)."""
    last = F.try_element_at(messages, F.lit(-1))
    answers = F.coalesce(last["role"] == "assistant", F.lit(False))
    return F.when(answers, F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages), F.when(answers, last["content"])


def merge_tool_calls(messages: Column) -> Column:
    """Runs of tool calls become one assistant message, calls on lines of their own."""

    def fold(acc: Column, m: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(message("tool_call", F.concat(last["content"], F.lit("\n"), m["content"]))))
        both = (F.size(acc) > 0) & (last["role"] == "tool_call") & (m["role"] == "tool_call")
        return F.when(both, joined).otherwise(F.concat(acc, F.array(message(m["role"], m["content"]))))

    merged = F.aggregate(messages, F.array().cast(MESSAGES), fold)
    return F.transform(merged, lambda m: message(F.when(m["role"] == "tool_call", "assistant").otherwise(m["role"]), m["content"]))


def inline_images(text: Column) -> tuple[Column, Column]:
    """Text with ``<img>path</img>`` as image tags, and the paths."""
    pattern = r"(?s)<img>(.+?)</img>"
    return F.regexp_replace(text, pattern, "<image>"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def add_missing_tags(text: Column, media: Column, tag: str) -> Column:
    """Tags in front so that there are as many as media."""
    n = F.size(F.coalesce(media, F.array().cast("array<string>"))) - F.regexp_count(text, F.lit(f"<{tag}>"))
    return F.concat(F.repeat(F.lit(f"<{tag}>"), F.greatest(n, F.lit(0))), text)


def without_modality(messages: Column, tag: str) -> Column:
    """Messages without a modality's tags, texts stripped."""
    return F.transform(messages, lambda m: message(m["role"], strip(F.replace(m["content"], F.lit(f"<{tag}>"), F.lit("")))))


def clean_question(problem: Column, suffix: str = "") -> Column:
    """The question of a problem: no media tags, no instruction, no blanks around."""
    bare = F.replace(F.replace(problem, F.lit("<video>"), F.lit("")), F.lit("<audio>"), F.lit(""))
    return strip(F.replace(bare, F.lit(suffix), F.lit("")) if suffix else bare)


def printable(c: Column, name: str = "") -> Column:
    """Long texts masked for display, but not contents and texts."""
    return c if name in ("content", "text") else F.when(F.length(c) >= 1000, F.concat(F.lit("<<<"), F.substring(c, 1, 16), F.lit(">>>"))).otherwise(c)


def self_cognition(text: Column, name: tuple[str, str], author: tuple[str, str], language: Column) -> Column:
    """Placeholders filled with the (Chinese, English) names by the language tag."""
    by = lambda p: F.when(language == "zh", F.lit(p[0])).otherwise(F.lit(p[1]))
    return F.replace(F.replace(text, F.lit("{{NAME}}"), by(name)), F.lit("{{AUTHOR}}"), by(author))


def reasoning_wrapper(thought: Column, answer: Column) -> Column:
    return F.concat(F.lit("<think>"), thought, F.lit("</think>\n\n<answer>"), answer, F.lit("</answer>"))


def sanitise(df: DataFrame) -> DataFrame:
    """Bytes masked and columns named like tokens nulled, before rows are logged."""
    out = {}
    for name, kind in df.dtypes:
        if "_token" in name:
            out[name] = F.lit(None).cast(kind)
        elif kind == "binary":
            out[name] = F.concat(F.lit("<"), F.length(name), F.lit(" bytes>"))
    return df.withColumns(out)
