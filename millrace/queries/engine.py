"""Sources, sinks, plans, the registry and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from millrace.operators import normalize, reshape
from millrace.operators.aggregates import Aggregate, ExactMean, aggregated
from millrace.operators.rows import RowFunction
from millrace.plans import curation, loading
from millrace.queries.base import CONVS, SAMPLES, query, read, samples
from millrace.queries.tables import REASON, draw_sql
from millrace.sources import jsonl
from millrace.sources.indexed import read_indexed, write_indexed
from millrace.sources.registry import Meta, Source, Subset, register, register_json, select_subsets
from millrace.sources.listing import write_files
from millrace.sources.workers import shared_folder
from millrace.streaming import jobs

FLAG = f"""with m as (select conv_id, [x for x in messages if x.role <> 'system'] as messages from {CONVS}), c as (select *, len(messages) // 2 as n from m),
  e as (select conv_id as conv, conv_id::varchar || case when n > 1 then '_turn' || i else '' end as id, '<video><audio>' || chr(10) || messages[2*i-1].content as question,
    [w for w in regexp_split_to_array(lower(messages[2*i].content), '\\s+') if w <> ''] as w from c, lateral (select unnest(range(1, n + 1)) as i) k),
  g as (select *, [array_to_string(w[j:j+2], ' ') for j in range(1, len(w) - 1)] as grams from e),
  r as (select conv, id, question, case when len(w) < 3 then 0.0 else (1 - len(list_distinct(grams))::double / len(grams)) * -1.0 end as reward from g)
select conv, id, question, round(reward, 6) + 0.0 as reward, round((reward - avg(reward) over (partition by conv)) / (coalesce(stddev_samp(reward) over (partition by conv), 0) + 1e-4), 6) + 0.0 as advantage from r"""


@query("flagship", FLAG)
def flagship(spark, sf_dir):
    return curation.flagship(read(spark, sf_dir, "conversations")).withColumn("reward", F.col("reward") + 0.0)


@query(
    "curation_chain",
    f"""with k as (select * from {SAMPLES} t where ({REASON}) is null), s as (select *, count(*) over (partition by type) as n from k), l as (select * from s where n >= 10),
      c as (select type, count(*) as n, row_number() over (order by count(*) desc, type) as r from l group by 1),
      b as (select *, row_number() over (partition by type order by case when video_dependency_score = 10 and audio_dependency_score = 10 then 0 else 1 end, composite_score desc, id) as rn from l),
      e as (select * from b where type <> (select type from c where r = 1) or (select count(*) from c) < 2 or rn <= 3 * (select n from c where r = 2)), t as (select * from e where video_dependency_score >= 7 or audio_dependency_score >= 7)
    select id, type, case when row_number() over (partition by type order by {draw_sql('id')}, id) <= greatest(floor(count(*) over (partition by type) * 0.1), 1) then 'test' else 'train' end as split from t""",
)
def chain(spark, sf_dir):
    return curation.curate(samples(spark, sf_dir)).select("id", "type", "split")


def lines(spark, sf_dir, broken: bool = False):
    """Documents as JSON lines in the shared folder, some of them broken."""
    path = shared_folder(spark, "lines")
    body = F.to_json(F.struct("doc_id", "lang"))
    if broken:
        body = F.when(F.col("doc_id") % 11 == 0, F.lit("{oops")).when(F.col("doc_id") % 13 == 0, F.lit("")).otherwise(body)
    read(spark, sf_dir, "documents").select(body.alias("value")).write.text(path)
    return path


@query("S1_scan_strict", "select doc_id, lang from documents")
def scan_strict(spark, sf_dir):
    v = jsonl.scan_strict(spark, lines(spark, sf_dir))
    return v.select(F.variant_get("v", "$.doc_id", "long").alias("doc_id"), F.variant_get("v", "$.lang", "string").alias("lang"))


@query("S2_scan_tolerant", "select count(*) filter (doc_id % 11 <> 0 and doc_id % 13 <> 0) as good, count(*) filter (doc_id % 11 = 0) as bad from documents")
def scan_tolerant(spark, sf_dir):
    good, bad = jsonl.scan_tolerant(spark, lines(spark, sf_dir, True))
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("bad")))  # one row each


@query("S3_read_typed", "select doc_id, lang from documents")
def read_typed(spark, sf_dir):
    return jsonl.read_typed(spark, lines(spark, sf_dir), "doc_id long, lang string")


@query("S4_write_lines", "select doc_id, lang, case when doc_id % 3 <> 0 then source end as source from documents")
def write_lines(spark, sf_dir):
    path = shared_folder(spark, "out")
    jsonl.write_lines(read(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source")), path)
    return jsonl.read_typed(spark, path, "doc_id long, lang string, source string")


@query("S5_append_lines", "select doc_id, null::varchar as access_token from documents union all select doc_id, null from documents")
def append_lines(spark, sf_dir):
    path = shared_folder(spark, "out")
    for _ in range(2):
        jsonl.write_lines(read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("access_token")), path, append=True, safe=True)
    return jsonl.read_typed(spark, path, "doc_id long, access_token string")


@query("S6_array_file", "select conv_id, text from conversations where turn = 0")
def array_file(spark, sf_dir):
    path = shared_folder(spark, "arrays")
    rows = read(spark, sf_dir, "conversations").where("turn = 0").groupBy((F.col("conv_id") % 8).alias("k")).agg(F.collect_list(F.struct("conv_id", "text")).alias("a"))
    rows.select(F.to_json("a").alias("value"), "k").write.partitionBy("k").text(path)  # a file with one array for each k
    return jsonl.read_array_file(spark, path, "conv_id long, text string").select("conv_id", "text")


@query("S7_scan_folders", "select doc_id, lang as folder, 'part-' || (doc_id // 1000) as stem from documents where lang <> 'es'")
def scan_folders(spark, sf_dir):
    """Array files of the ids of a language, a thousand in each, which executors write into a folder of the language."""
    base = shared_folder(spark, "tree")
    ids = read(spark, sf_dir, "documents").groupBy("lang", F.floor(F.col("doc_id") / 1000).alias("k")).agg(F.to_json(F.collect_list(F.struct("doc_id"))).alias("ids"))
    write_files(ids.withColumn("path", F.concat("lang", F.lit("/part-"), "k", F.lit(".json"))), base, "path", "ids")
    return jsonl.scan_folders(spark, base, "es", "doc_id long").select("doc_id", "folder", "stem")


@query("S8_by_extension", "select doc_id, case when doc_id % 3 = 0 then '' else lang end as lang from documents")
def by_extension(spark, sf_dir):
    path = shared_folder(spark, "table") + ".csv"
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("lang"))
    docs.write.option("header", True).option("emptyValue", "").csv(path)
    return jsonl.read_by_extension(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "lang")


@query("S9_subsets", "select doc_id from documents where lang in ('en', 'fr')")
def subsets(spark, sf_dir):
    base = shared_folder(spark, "subsets")
    for lang in ("en", "fr", "de"):
        read(spark, sf_dir, "documents").where(F.col("lang") == lang).select("doc_id").write.parquet(f"{base}/{lang}/train")
    return jsonl.read_subsets(spark, base, ["en", "fr"], ["train"])


@query("S11_source_language", "select * from (values ('hf', 'a/b', 'x/y', 500), (null, 'c', 'default', null), (null, '/tmp/f.jsonl', '', 3)) t(hub, name, subsets, \"count\")")
def source_language(spark, sf_dir):
    parsed = [Source.parse(t) for t in ("hf::a/b:x/y#500", "c:default", "/tmp/f.jsonl#3")]
    return spark.createDataFrame([(s.hub, s.name, "/".join(s.subsets), s.count) for s in parsed], "hub string, name string, subsets string, count int")


@query("S12_registry", "select 'ms/sql' as id, 'prompt' as renamed, 2 as subsets")
def registry(spark, sf_dir):
    found = register_json(json.dumps([{"ms_dataset_id": "ms/sql", "columns": {"prompt": "query"}, "subsets": ["a", {"name": "b", "is_weak_subset": True}]}]))[0]
    return spark.createDataFrame([(found.ms_id, next(iter(found.columns)), len(found.subsets))], "id string, renamed string, subsets int")


@query("S13_lookup", "select 'ms/sql' as by_suffix, '/x/y.jsonl' as as_path")
def lookup_(spark, sf_dir):
    from millrace.sources.registry import lookup

    register(Meta(ms_id="ms/sql", path="p"), exist_ok=True)
    return spark.createDataFrame([(lookup(Source.parse("SQL")).ms_id, lookup(Source.parse("/x/y.jsonl")).path)], "by_suffix string, as_path string")


@query("S14_subset_selection", "select 'a' as only_one, 'default' as by_default, 'a,default' as not_weak")
def subset_selection(spark, sf_dir):
    many = Meta(path="p", subsets=[Subset("a"), Subset("default"), Subset("w", weak=True)])
    names = lambda w, m: ",".join(s.name for s in select_subsets(w, m))
    return spark.createDataFrame([(names((), Meta(path="p", subsets=[Subset("a")])), names((), many), names(("all",), many))], "only_one string, by_default string, not_weak string")


@query("S15_S16_cached_source", "select doc_id, n_chars as length from documents where n_chars <= 1000")
def cached_source(spark, sf_dir):
    path = shared_folder(spark, "cache")
    jsonl.write_cache(read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("length")), path)
    return jsonl.read_cache(spark, path, 1000)


@query("S17_S18_indexed", "with r as (select doc_id, lang, md5(text) as text, row_number() over (order by doc_id) - 1 as _row, count(*) over () as n from documents) select _row, doc_id, lang, text, false as scan from r where _row in (3, 77, 150, n - 1) union all select _row, doc_id, lang, text, true from r")
def indexed_rows(spark, sf_dir):
    """Rows 3, 77, 150 and the last one by number, and a scan."""
    path = shared_folder(spark, "indexed")
    write_indexed(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path, "doc_id", shard_bytes=1 << 20)
    parts = [read_indexed(spark, path, rows).withColumn("scan", F.lit(rows is None)) for rows in ([3, 77, 150, -1], None)]
    return reshape.union_all(*parts).withColumn("text", F.md5("text"))


@query("S20_union_dicts", "select doc_id, lang, null::bigint as page_id from documents union all select null, null, page_id from pages")
def union_dicts(spark, sf_dir):
    return jsonl.union_dicts([read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "pages").select("page_id")])


@query("S21_two_sinks", "select 'high' as place, id from (select doc_id as id, n_chars from documents) where n_chars > 500 union all select 'low', doc_id from documents where n_chars <= 500")
def two_sinks(spark, sf_dir):
    high, low = shared_folder(spark, "high"), shared_folder(spark, "low")
    jsonl.write_two(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars"), F.col("n_chars") > 500, high, low, ("n_chars",))
    return jsonl.read_typed(spark, high, "id long").select(F.lit("high").alias("place"), "id").union(jsonl.read_typed(spark, low, "id long").select(F.lit("low"), "id"))


@query("S22_validation_report", f"select reason, count(*) as n from (select {REASON} as reason from {SAMPLES} t) where reason is not null group by 1")
def validation_report(spark, sf_dir):
    path = shared_folder(spark, "report")
    kept, rejected = curation.quality_filter(samples(spark, sf_dir))
    jsonl.validation_report(rejected, kept.agg(F.count("*").alias("kept")), path)
    return jsonl.read_typed(spark, f"{path}/rejected", "id long, reason string").groupBy("reason").agg(F.count("*").alias("n"))


@query("S24_S25_result_sink", "select conv_id, count(*) as n from conversations where role = 'assistant' group by 1")
def result_sink(spark, sf_dir):
    path = shared_folder(spark, "results")
    jsonl.write_lines(read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn"), path)
    return jsonl.read_typed(spark, path, "conv_id long, turn long").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("load_dataset", "select 'train' as part, count(*) - greatest(floor(count(*) * 0.1), 1)::bigint as n from documents union all select 'val', greatest(floor(count(*) * 0.1), 1)::bigint from documents")
def load_dataset(spark, sf_dir):
    path = shared_folder(spark, "raw") + ".jsonl"
    read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("instruction"), F.col("lang").alias("input"), F.col("source").alias("output")).write.json(path)
    train, val = loading.load_dataset(spark, [path], ratio=0.1)
    return reshape.union_all(*[df.agg(F.lit(n).alias("part"), F.count("*").alias("n")) for n, df in (("train", train), ("val", val))])


# --- streams ---------------------------------------------------------------


@query("T1_stream_source", "select lang, count(*) as n from documents group by 1")
def stream_source(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    out, mark = shared_folder(spark, "stream"), shared_folder(spark, "mark")
    rows = jobs.read_stream(spark, sf_dir, "documents.parquet", docs.schema).select("lang")
    return jobs.run_to_table(rows, out, mark).groupBy("lang").agg(F.count("*").alias("n"))


@query("T2_stream_preprocess", "select doc_id, 2::int as messages from documents where n_chars > 100")
def stream_preprocess(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = jobs.read_stream(spark, sf_dir, "documents.parquet", docs.schema).where("n_chars > 100")
    rows = rows.select("doc_id", F.size(normalize.alpaca_to_messages(F.col("source"), F.col("lang"), F.col("text"))).alias("messages"))
    return jobs.run_to_table(rows, shared_folder(spark, "stream"), shared_folder(spark, "mark"))


@query("T3_stream_shuffle", "select lane, count(*) as n, count(distinct doc_id) as ids, sum(doc_id)::bigint as total, (count(*) - 1)::bigint as last_place, true as moved from (select doc_id, doc_id % 3 as lane from documents) group by 1")
def stream_shuffle(spark, sf_dir):
    """Every row comes out once, in another order than it came in."""
    folder = shared_folder(spark, "feed")
    rows = read(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("lane"), F.to_json(F.struct("doc_id", "text")).alias("row"))
    rows.write.parquet(folder)
    rows.select("lane").distinct().select("lane", F.lit(None).cast("string").alias("row")).coalesce(1).write.mode("append").parquet(folder)
    out, mark = shared_folder(spark, "stream"), shared_folder(spark, "mark")
    files = jobs.read_stream(spark, folder, "*.parquet", rows.schema, 1)
    mixed = jobs.run_to_table(jobs.shuffle_stream(files, "lane", "row", 50), out, mark)
    doc = F.get_json_object("row", "$.doc_id").cast("long")
    return mixed.groupBy("lane").agg(
        F.count("*").alias("n"), F.countDistinct(doc).alias("ids"), F.sum(doc).alias("total"), F.max("place").alias("last_place"), (F.sum((doc != 3 * F.col("place") + F.col("lane")).cast("int")) > F.count("*") / 2).alias("moved")
    )


@query("T4_stream_packing", "select count(*) as items, sum(n_chars % 1000 + 1)::bigint as filled, true as fits from documents")
def stream_packing(spark, sf_dir):
    folder = shared_folder(spark, "feed")
    rows = read(spark, sf_dir, "documents").select(F.lit(0).cast("long").alias("shard"), "doc_id", (F.col("n_chars") % 1000 + 1).alias("length"))
    rows.where("doc_id % 2 = 0").coalesce(1).write.parquet(folder)
    rows.where("doc_id % 2 = 1").union(spark.range(1).select(F.lit(0).cast("long"), "id", F.lit(-1).cast("long"))).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.read_stream(spark, folder, "*.parquet", rows.schema, 1)
    packed = jobs.run_to_table(jobs.pack_stream(stream, "shard", "doc_id", "length", 4096), shared_folder(spark, "stream"), shared_folder(spark, "mark"))
    return packed.agg(F.sum(F.size("items")).alias("items"), F.sum("filled").alias("filled"), (F.max("filled") <= 4096).alias("fits"))


@query("T5_stream_sessions", "with s as (select user_id, sum((event_type = 'signup')::int) over (partition by user_id order by ts, event_id)::bigint as session from events) select user_id as key, session, count(*) as n from s group by 1, 2")
def stream_sessions(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("event_type") == "signup").alias("begins"), F.col("value").cast("double").alias("value"))
    folder = shared_folder(spark, "feed")
    events.coalesce(1).write.parquet(folder)
    ends = events.select("user_id").distinct().select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("timestamp").alias("ts"), "user_id", F.lit(True).alias("begins"), F.lit(None).cast("double").alias("value"))
    ends.coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.read_stream(spark, folder, "*.parquet", events.schema)
    return jobs.run_to_table(jobs.session_stream(stream, "user_id", ["ts", "event_id"], "begins", "value"), shared_folder(spark, "stream"), shared_folder(spark, "mark")).select("key", "session", "n")


@query("T6_T7_resumable", "select count(*) as n, 1::bigint as batches from documents")
def resumable(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    out, mark = shared_folder(spark, "batches"), shared_folder(spark, "mark")
    work = lambda df, k: df.select("doc_id").write.mode("overwrite").parquet(f"{out}/batch={k}")
    for _ in range(2):  # the second run finds nothing left to do
        jobs.run_batches(jobs.read_stream(spark, sf_dir, "documents.parquet", docs.schema, None), work, mark)
    return spark.read.parquet(out).agg(F.count("*").alias("n"), F.countDistinct("batch").alias("batches"))


def spoken(row: dict):
    """A row function as users write them: the words of a turn as rows, system turns none, empty turns an error."""
    if row["role"] == "system":
        return None
    words = row["text"].split()
    if not words:
        raise ValueError("no words")
    return [{"role": row["role"], "word": w, "place": i} for i, w in enumerate(words)]


@query("D1_transform", "select conv_id || ':' || turn as key, role, len(w) as words, md5(array_to_string(w, ' ')) as text from (select *, regexp_extract_all(text, '\\S+') as w from conversations where role <> 'system') where len(w) > 0")
def transform(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    results, _ = RowFunction(spoken, "role string, word string, place int", ("role", "text"))(turns, "key")
    words = results.groupBy(F.col("_key").alias("key"), "role").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))  # a turn's words
    return words.select("key", "role", F.size("w").cast("long").alias("words"), F.md5(F.array_join(F.col("w.word"), " ")).alias("text"))


class MeanOfRows(Aggregate):
    """The exact mean of a column and the number of all rows, those with nulls too."""

    result = "found struct<mean: double, n: bigint>"

    def __init__(self, column: str):
        self.mean = ExactMean(column)

    def zero(self):
        return self.mean.zero(), 0

    def update(self, state, row):
        return self.mean.update(state[0], row), state[1] + 1

    def merge(self, a, b):
        return self.mean.merge(a[0], b[0]), a[1] + b[1]

    def finish(self, state):
        return {"mean": self.mean.finish(state[0]), "n": state[1]}


@query("D3_metric", "select event_type, round(avg(value), 6) as mean, count(*) as n from events group by 1")
def metric(spark, sf_dir):
    found = aggregated(read(spark, sf_dir, "events"), ["event_type"], MeanOfRows("value"), ["value"])
    return found.select("event_type", (F.round("found.mean", 6) + 0.0).alias("mean"), "found.n")


@query("D5_custom_loader", "select lang as channel, count(*) as n from documents group by 1")
def custom_loader(spark, sf_dir):
    from millrace.sources.registry import load_one

    load = lambda session, meta, subset: read(session, sf_dir, "documents").select(F.col("lang").alias("channel"))
    register(Meta(ms_id="own/loader", load=load, preprocess=lambda df: df), exist_ok=True)
    return load_one(spark, "own/loader").groupBy("channel").agg(F.count("*").alias("n"))


@query("D7_agent_text", "select doc_id, 'Action: ' || lang || chr(10) || 'Action Input: {}' || chr(10) || 'Observation:' || source || chr(10) as react, '<tool_call>' || chr(10) || '{\"name\": \"' || lang || '\", \"arguments\": {}}' || chr(10) || '</tool_call>' as hermes from documents")
def agent_text(spark, sf_dir):
    from millrace.functions.agents import tool_call_text, tool_result_text

    call, result = tool_call_text(F.col("lang"), F.lit("{}")), tool_result_text(F.col("source"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(call, result).alias("react"), tool_call_text(F.col("lang"), F.lit("{}"), "hermes").alias("hermes"))


CALL = """'{"n": ' || n_chars || ', "of": "' || source || '"}'"""


@query(
    "D7_agent_formats",
    f"""with d as (select doc_id, lang as a, source as b, {CALL} as j, n_chars::varchar as n, chr(10) as nl from documents) select doc_id,
      'Action: ' || a || nl || 'Action Input: ' || j || nl || 'Action: ' || b || nl || 'Action Input: {{}}' || nl || 'Observation:' as react_en,
      '✿FUNCTION✿: ' || a || nl || '✿ARGS✿: ' || j || nl || '✿FUNCTION✿: ' || b || nl || '✿ARGS✿: {{}}' || nl || '✿RESULT✿:' as qwen_en,
      '<tool_call>' || nl || '<function=' || a || '>' || nl || '<parameter=n>' || nl || n || nl || '</parameter>' || nl || '<parameter=of>' || nl || b || nl || '</parameter>' || nl || '</function>' || nl || '</tool_call>' || nl
        || '<tool_call>' || nl || '<function=' || b || '>' || nl || '</function>' || nl || '</tool_call>' as qwen3_coder,
      '<tool_calls>' || nl || '<tool_call>' || nl || '{{"name": "' || a || '", "arguments": ' || j || '}}' || nl || '</tool_call>' || nl || '<tool_call>' || nl || '{{"name": "' || b || '", "arguments": {{}}}}' || nl || '</tool_call>' || nl || '</tool_calls>' as hunyuan_hermes,
      a || nl || j || '<|assistant|>' || b || nl || '{{}}<|observation|>' as glm4,
      '<tool_call>' || a || nl || '<arg_key>n</arg_key>' || nl || '<arg_value>' || n || '</arg_value>' || nl || '<arg_key>of</arg_key>' || nl || '<arg_value>' || b || '</arg_value>' || nl || '</tool_call>' || nl || '<tool_call>' || b || nl || '</tool_call><|observation|>' as glm4_5,
      '{{"name": "' || a || '", "parameters": ' || j || '}}' || nl || '{{"name": "' || b || '", "parameters": {{}}}}' as llama3,
      '<｜tool▁calls▁begin｜><｜tool▁call▁begin｜>' || a || '<｜tool▁sep｜>' || j || '<｜tool▁call▁end｜><｜tool▁call▁begin｜>' || b || '<｜tool▁sep｜>{{}}<｜tool▁call▁end｜><｜tool▁calls▁end｜>' as deepseek_v3_1,
      '<seed:tool_call>' || nl || '<function=' || a || '>' || nl || '<parameter=n>' || n || '</parameter>' || nl || '<parameter=of>' || b || '</parameter>' || nl || '</function>' || nl || '</seed:tool_call>' || nl || '<seed:tool_call>' || nl || '<function=' || b || '>' || nl || '</function>' || nl || '</seed:tool_call>' as seed_oss,
      '[TOOL_CALLS][' || nl || '{{"name": "' || a || '", "arguments": ' || j || '}}' || nl || '{{"name": "' || b || '", "arguments": {{}}}}' || nl || ']</s>' as mistral
    from d""",
)
def agent_formats(spark, sf_dir):
    from millrace.functions.agents import tool_calls_text

    given = F.concat(F.lit('{"n": '), "n_chars", F.lit(', "of": "'), "source", F.lit('"}'))
    calls = F.array(F.struct(F.col("lang").alias("name"), given.alias("arguments")), F.struct(F.col("source").alias("name"), F.lit("{}").alias("arguments")))
    forms = ("react_en", "qwen_en", "qwen3_coder", "hunyuan_hermes", "glm4", "glm4_5", "llama3", "deepseek_v3_1", "seed_oss", "mistral")
    return read(spark, sf_dir, "documents").withColumn("calls", calls).select("doc_id", *[tool_calls_text(F.col("calls"), k).alias(k) for k in forms])


READ_FORMS = ("react_en", "qwen_en", "qwen3_coder", "hermes", "hunyuan_hermes", "glm4", "glm4_5", "llama3", "deepseek_v3_1", "seed_oss", "mistral")


@query(
    "D7_calls_read",
    "with d as (select doc_id, '[' || lang || '{\"n\":' || n_chars || ',\"of\":\"' || source || '\"}, ' || source || '{}]' as calls, case when doc_id % 2 = 0 then '[]' else '[' || lang || '{\"n\":1}]' end as other from documents) select doc_id, "
    + ", ".join(f"calls as {k}" for k in READ_FORMS) + ", other as broken from d",
)
def calls_read(spark, sf_dir):
    """Calls written in each form between whole texts, and read back; broken ones are none, or ReAct."""
    from millrace.functions.agents import read_calls, tool_calls_text

    given = F.concat(F.lit('{"n": '), "n_chars", F.lit(', "of": "'), "source", F.lit('"}'))
    calls = F.array(F.struct(F.col("lang").alias("name"), given.alias("arguments")), F.struct(F.col("source").alias("name"), F.lit("{}").alias("arguments")))
    shown = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.to_json(x["arguments"]))), ", "), F.lit("]"))
    docs = read(spark, sf_dir, "documents").withColumn("calls", calls)
    before = {k: F.lit("") if k in ("glm4", "llama3") else F.col("text") for k in READ_FORMS}  # in these two, text before a call is part of it
    texts = docs.select("doc_id", "lang", *[F.concat(before[k], F.lit("\n") if k not in ("glm4",) else F.lit(""), tool_calls_text(F.col("calls"), k)).alias(k) for k in READ_FORMS])
    react = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("\nAction: "), "lang", F.lit('\nAction Input: {"n": 1}\nObservation:'))).otherwise("")
    broken = read_calls(F.concat(F.lit('<tool_call>{"name": "x", "arguments": {oops</tool_call>'), react), "hermes")
    return texts.select("doc_id", *[shown(read_calls(F.col(k), k)).alias(k) for k in READ_FORMS], shown(broken).alias("broken"))


@query(
    "D7_agent_results",
    """with d as (select doc_id, coalesce(text, '') as a, lang || chr(10) as b, chr(10) as nl from documents) select doc_id,
      md5(a || case when a like '%' || nl then '' else nl end || 'Observation:' || b) as react_en, md5('<tool_response>' || nl || a || nl || '</tool_response>' || nl || '<tool_response>' || nl || b || nl || '</tool_response>') as hermes,
      md5('<tool_responses><tool_response>' || a || '</tool_response>' || nl || '<tool_response>' || b || '</tool_response></tool_responses>') as hunyuan_hermes,
      md5('<｜end▁of▁sentence｜><｜tool▁output▁begin｜>' || a || '<｜tool▁output▁end｜><｜tool▁output▁begin｜>' || b || '<｜tool▁output▁end｜>') as deepseek_v3_1, md5('<seed:eos><seed:bos>tool' || nl || a || '<seed:eos><seed:bos>tool' || nl || b || '<seed:eos><seed:bos>assistant' || nl) as seed_oss
    from d""",
)
def agent_results(spark, sf_dir):
    """Whole texts as results."""
    from millrace.functions.agents import tool_results_text

    results = F.array(F.coalesce("text", F.lit("")), F.concat("lang", F.lit("\n")))
    return read(spark, sf_dir, "documents").select("doc_id", *[F.md5(tool_results_text(results, k)).alias(k) for k in ("react_en", "hermes", "hunyuan_hermes", "deepseek_v3_1", "seed_oss")])
