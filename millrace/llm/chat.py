"""Chat formatting by perspective rotation; DataFrame functions only.

A dialogue with several participants becomes one training text for each of
them: that speaker's turns are the assistant's, everyone else's are named user
turns, and system turns stay what they are. Only the assistant's words and
their end marks are learned from; ``mask`` says so for each turn, and
``spans`` gives the places of those words in the text.

    <|im_start|>user name=alice\\n ... <|im_end|>\\n

Bounds: a conversation is rendered in sections of ``section`` turns by rank, so
one of any length is never gathered in a row or a task; a section knows its first
place in the whole text from prefix sums over section lengths. Ordinary
conversations are one section; only the turns of longer ones are ranked, over
range partitions.

Defined results: turns are in order of ``turn``, ties by role and text, nulls
first; a null text is empty; a null role is the participant ``unknown``;
conversations of system turns alone have no perspective; marks inside a text
are broken by a space, and in a role by their code, so that no turn can end
early; a role's name has ``_`` for a blank and codes for other white space, ``_``
and ``%``, so that two roles never have one name; repeated rows are repeated
turns; rows with a null conversation id are one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.runtime import cut, numbered

START, END = "<|im_start|>", "<|im_end|>"
SECTION = 512


def plain(text: Column) -> Column:
    """Text that holds no turn marks."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


#: What stands for a character or mark in a role's name, in this order.
NAME = [("%", "%25"), ("_", "%5F"), (" ", "_"), ("\t", "%09"), ("\n", "%0A"), ("\x0b", "%0B"), ("\f", "%0C"), ("\r", "%0D"), ("<|", "%3C|")]


def name_of(role: Column) -> Column:
    for a, b in NAME:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def sectioned(turns: DataFrame, section: int) -> tuple[DataFrame, bool]:
    """``turns`` with the ``section`` of each, and whether any conversation has more than one."""
    long_ = cut(turns.groupBy("conv_id").count().where(F.col("count") > section).select(F.col("conv_id").alias("c")), "long")
    if long_.isEmpty():
        return turns.withColumn("section", F.lit(0).cast("long")), False
    of = F.col("conv_id").eqNullSafe(F.col("c"))
    ranked = numbered(turns.join(long_, of, "left_semi"), "conv_id", "turn", "role", "text")
    firsts = cut(ranked.groupBy(F.col("conv_id").alias("c")).agg(F.min("rank").alias("first")), "firsts")
    ranked = ranked.join(firsts, of).withColumn("section", F.floor((F.col("rank") - F.col("first")) / section).cast("long"))
    short = turns.join(long_, of, "left_anti").withColumn("section", F.lit(0).cast("long"))
    return ranked.select(*short.columns).unionByName(short), True


def rotate(conversations: DataFrame, section: int = SECTION, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation, participant and section."""
    turns = conversations.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), plain(F.col(text_col)).alias("text")
    )
    turns, several = sectioned(turns, section)
    speakers = turns.where("role <> 'system'").select("conv_id", F.col("role").alias("speaker")).distinct()
    sections = turns.groupBy("conv_id", "section").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    views = sections.join(speakers.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    def head(t: Column) -> Column:
        role = F.when(t["role"] == "system", "system").when(t["role"] == F.col("speaker"), "assistant").otherwise(F.concat(F.lit("user name="), name_of(t["role"])))
        return F.concat(F.lit(START), role, F.lit("\n"))

    tail = F.lit(f"{END}\n")
    views = views.withColumn("heads", F.transform("turns", head))
    views = views.withColumn("parts", F.zip_with("heads", "turns", lambda h, t: F.concat(h, t["text"], tail)))
    views = views.withColumn("learned", F.transform("turns", lambda t: (t["role"] == F.col("speaker")).cast("int")))
    # where each part begins: running sums of lengths
    ends = F.aggregate("parts", F.array(F.lit(0).cast("long")), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))
    views = views.withColumn("ends", ends).withColumn("chars", F.element_at("ends", -1))
    if several:  # prefix sums over a row of numbers for each section
        views = cut(views, "views")
        before = Window.partitionBy("c", "s").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        lengths = views.select(F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("section").alias("k"), "chars")
        lengths = lengths.select("c", "s", "k", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("first_char"))
        views = views.join(lengths, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & (F.col("section") == F.col("k")))
    else:
        views = views.withColumn("first_char", F.lit(0).cast("long"))
    span = F.transform(
        "turns",
        lambda t, i: F.when(
            F.get("learned", i) == 1, F.concat_ws("-", F.col("first_char") + F.get("ends", i) + F.length(F.get("heads", i)), F.col("first_char") + F.get("ends", i + 1) - 1)
        ),
    )
    return views.select(
        "conv_id",
        "speaker",
        "section",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join("parts", "").alias("text"),
        F.array_join("learned", ",").alias("mask"),
        F.array_join(span, ",").alias("spans"),
        F.col("first_char").cast("long").alias("first_char"),
    )


def _sql_name(role: str) -> str:
    for a, b in NAME:
        role = f"replace({role}, {f"'{a}'" if a.isprintable() else f'chr({ord(a)})'}, '{b}')"
    return role


#: The same in DuckDB, for sections of 512 turns.
SQL = f"""
with named as (select conv_id, turn, coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') as text from conversations),
turns as (select *, (row_number() over (partition by conv_id order by turn nulls first, role, text) - 1) // 512 as section from named),
speakers as (select distinct conv_id, role as speaker from turns where role <> 'system'),
parts as (
  select t.conv_id, speaker, section, turn, role, text, cast(role = speaker as int) as learned,
    '<|im_start|>' || case when role = 'system' then 'system' when role = speaker then 'assistant' else 'user name=' || {_sql_name('role')} end || chr(10) as head
  from turns t join speakers s on t.conv_id is not distinct from s.conv_id),
placed as (
  select *, head || text || '<|im_end|>' || chr(10) as part,
    coalesce(sum(length(head || text || '<|im_end|>' || chr(10))) over (partition by conv_id, speaker order by section, turn nulls first, role, text rows between unbounded preceding and 1 preceding), 0) as place
  from parts)
select conv_id, speaker, section, count(*) as n_turns, string_agg(part, '' order by turn nulls first, role, text) as text,
  string_agg(cast(learned as varchar), ',' order by turn nulls first, role, text) as mask,
  coalesce(string_agg(case when learned = 1 then cast(place + length(head) as varchar) || '-' || cast(place + length(part) - 1 as varchar) end, ',' order by turn nulls first, role, text), '') as spans,
  cast(min(place) as bigint) as first_char
from placed group by conv_id, speaker, section
"""
