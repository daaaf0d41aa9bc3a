"""Registry of queries with their SQL, and the tables that scalar operators run over.

The SQL is DuckDB's and is written independently of the Spark side; both give
scalars, with doubles rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.normalize import conversations_to_messages
from millrace.sources.workers import let_workers_import

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SAMPLES = """(select d.doc_id as id, d.source as category_name, d.lang as type, d.n_chars,
  cast((d.doc_id*7) % 11 as int) as video_dependency_score,
  cast((d.doc_id*5 + d.n_chars) % 11 as int) as audio_dependency_score,
  cast((d.doc_id*3 + d.n_chars) % 11 as int) as composite_score,
  cast(case when l.quality is null then null when l.quality = 1 then 10 else 6 end as int) as answer_accuracy_score,
  cast(4 + (d.doc_id*13) % 7 as int) as question_logic_score,
  coalesce(l.toxic, 0) = 1 as should_filter
from documents d left join labels l on d.doc_id = l.doc_id)"""

COMPLETIONS = """(select conv_id, turn, text,
  '<time>' || turn || '.0-' || (turn+1) || '.5</time><caption>' || text || '</caption>' ||
  case when turn % 4 = 3 then '' else '<thinking>t</thinking>' end ||
  '<answer> ' || chr(cast(65 + (conv_id + turn) % 4 as int)) || '. x</answer>' as completion,
  chr(cast(65 + conv_id % 4 as int)) || '. y' as solution
from conversations where role = 'assistant')"""

CONVS = "(select conv_id, list({'role': role, 'content': text} order by turn) as messages from conversations group by conv_id)"

PAIRS = """(select conv_id, turn, role, text, case when role = 'user' then 'human' when role = 'assistant' then 'gpt' else role end as "from",
  case when turn = 0 then '<image>' || text else text end as value from conversations)"""

RAW = f"""(select conv_id, list({{'from': "from", 'value': value}} order by turn) as turns from {PAIRS} group by conv_id)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id")
    rows = d.join(q, d.doc_id == q.l_id, "left")
    return rows.selectExpr(
        "doc_id as id", "source as category_name", "lang as type", "n_chars",
        "cast((doc_id*7) % 11 as int) as video_dependency_score", "cast((doc_id*5 + n_chars) % 11 as int) as audio_dependency_score",
        "cast((doc_id*3 + n_chars) % 11 as int) as composite_score",
        "cast(case when quality is null then null when quality = 1 then 10 else 6 end as int) as answer_accuracy_score",
        "cast(4 + (doc_id*13) % 7 as int) as question_logic_score", "coalesce(toxic, 0) = 1 as should_filter",
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr(
        "conv_id", "turn", "text",
        """concat('<time>', cast(turn as string), '.0-', cast(turn+1 as string), '.5</time><caption>', text, '</caption>',
           case when turn % 4 = 3 then '' else '<thinking>t</thinking>' end, '<answer> ', chr(cast(65 + (conv_id + turn) % 4 as int)), '. x</answer>') as completion""",
        "concat(chr(cast(65 + conv_id % 4 as int)), '. y') as solution",
    )


def convs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations_to_messages(read(spark, sf_dir, "conversations"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in the layout of raw files: from and value."""
    t = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    value = F.when(F.col("turn") == 0, F.concat(F.lit("<image>"), "text")).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", kind.alias("from"), value.alias("value"))))
    return t.groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("turns"))


TABLES = {
    "completions": (completions, COMPLETIONS, ["conv_id", "turn"]),
    "convs": (convs, CONVS, ["conv_id"]),
    "raw": (raw, RAW, ["conv_id"]),
    "samples": (samples, SAMPLES, ["id"]),
    "documents": (lambda s, d: read(s, d, "documents"), "documents", ["doc_id"]),
    "pages": (lambda s, d: read(s, d, "pages"), "pages", ["page_id"]),
    "turns": (lambda s, d: read(s, d, "conversations"), "conversations", ["conv_id", "turn"]),
    "embeddings": (lambda s, d: read(s, d, "embeddings"), "embeddings", ["vec_id"]),
}


def scalar(name: str, table: str, columns: dict[str, tuple[Callable[[], Column], str | None]]) -> None:
    """A query of columns over a table: each is (a function that builds the column, its SQL)."""
    frame, source, keys = TABLES[table]
    sql = None
    if all(s for _, s in columns.values()):
        sql = f"select {', '.join(keys)}, {', '.join(f'{s} as {n}' for n, (_, s) in columns.items())} from {source} t"

    @query(name, sql)
    def run(spark, sf_dir):
        return frame(spark, sf_dir).select(*keys, *[c().alias(n) for n, (c, _) in columns.items()])


def flat(messages: Column) -> Column:
    """Messages as text: a line for each."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def sql_flat(messages: str) -> str:
    return f"coalesce(array_to_string([m.role || ': ' || coalesce(m.content, '') for m in {messages}], chr(10)), '')"


def six(c: Column) -> Column:
    return F.round(c, 6) + 0.0


def python_string(text: str) -> str:
    """SQL: a text as Python's json.dumps writes it."""
    code, low = "unicode(ch)", "(unicode(ch) - 65536)"
    short = " ".join(f"when ch = chr({ord(a)}) then '\\{b}'" for a, b in [('"', '"'), ("\\", "\\"), ("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")])
    pair = f"printf('\\u%04x', 55296 + ({low} >> 10)) || printf('\\u%04x', 56320 + ({low} & 1023))"
    one = f"case {short} when {code} between 32 and 126 then ch when {code} < 65536 then printf('\\u%04x', {code}) else {pair} end"
    return f"""'"' || coalesce(array_to_string(list_transform(regexp_extract_all({text}, '(?s).'), lambda ch: {one}), ''), '') || '"'"""
