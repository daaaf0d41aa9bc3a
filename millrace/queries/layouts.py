"""Row-to-row operators over conversations, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import normalize as N
from millrace.operators import reshape, validate
from millrace.queries.base import CONVS, RAW, convs, flat, query, raw, read, scalar, sql_flat

m = lambda: F.col("messages")
turns = lambda: F.col("turns")
nul = lambda: F.lit(None).cast("string")
PAIR = "[([x for x in messages if x.role <> 'system'])[i:i+1] for i in range(1, len([x for x in messages if x.role <> 'system']) + 1, 2)]"
REST = "[x for x in messages if x.role <> 'system']"

scalar("P1_constant", "pages", {"data_source": (lambda: F.lit("videovista"), "'videovista'")})


@query("P2_rename_aliases", "select doc_id, text as response, lang as Lang, source from documents")
def rename(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("OutPut"), F.col("lang").alias("Lang"), "source")
    return N.rename_aliases(df, N.RESPONSE_ALIASES)


@query("P3_alias_tables", "select page_id, url as images, html as query from pages")
def aliases(spark, sf_dir):
    df = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("Image"), F.col("html").alias("Question"))
    return N.rename_aliases(N.rename_aliases(df, N.MEDIA_ALIASES), N.RESPONSE_ALIASES)


@query("P4_keep_standard", "select lang as channel, text as solution from documents")
def prune(spark, sf_dir):
    return N.keep_standard(read(spark, sf_dir, "documents").select(F.col("lang").alias("channel"), "doc_id", F.col("text").alias("solution")))


@query("P5_drop_fields", "select doc_id, text from documents")
def drop(spark, sf_dir):
    return N.drop_fields(read(spark, sf_dir, "documents"), "lang", "source", "n_chars", "quality_evaluation")


@query("P6_strip_prefix", "select doc_id, lang, source from documents")
def prefix(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("rejected_source"), F.col("text").alias("rejected_lang"))
    return N.strip_prefix(df, "rejected_")


@query("P7_rows_to_batches", "select floor(doc_id / 100)::bigint as batch, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1")
def batches(spark, sf_dir):
    df = read(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 100).alias("batch")).agg(F.collect_list(F.struct("doc_id", "n_chars")).alias("rows"))
    return df.select("batch", F.inline("rows")).groupBy("batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("P8_cast_media", "select page_id, url as image_path, true as no_bytes, url as video from pages")
def media(spark, sf_dir):
    df = N.cast_media(read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("images"), F.col("url").alias("videos")))
    return df.select("page_id", F.col("images")[0]["path"].alias("image_path"), F.col("images")[0]["bytes"].isNull().alias("no_bytes"), F.col("videos")[0].alias("video"))


scalar("P9_prune_messages", "convs", {"value": (lambda: flat(N.prune_messages(m())), sql_flat("messages"))})
box = lambda: F.array(*[(F.col("vec_id") * k % 97).cast("double") for k in (31, 17, 5, 77)])
BX = [f"(vec_id * {k} % 97)::double" for k in (31, 17, 5, 77)]
scalar("P10_order_boxes", "embeddings", {f"x{i}": ((lambda i=i: N.order_boxes(F.array(box()))[0][i]), s) for i, s in enumerate((f"least({BX[0]}, {BX[2]})", f"least({BX[1]}, {BX[3]})", f"greatest({BX[0]}, {BX[2]})", f"greatest({BX[1]}, {BX[3]})"))})
scalar("P39_normalise_boxes", "embeddings", {f"x{i}": ((lambda i=i: N.normalise_boxes(F.array(box()), F.lit(97.0), F.lit(200.0), F.lit("real"))[0][i]), f"round_even({BX[i]} / {97.0 if i % 2 == 0 else 200.0}::double * 1000, 0)::bigint") for i in range(4)})
scalar("P11_response", "documents", {"value": (lambda: flat(N.response_to_messages(F.when(F.col("lang") == "en", F.col("lang")), F.col("source"), F.col("text"), F.array(F.array(F.lit("h"), F.lit("r"))))), "case when lang = 'en' then 'system: en' || chr(10) else '' end || 'user: h' || chr(10) || 'assistant: r' || chr(10) || 'user: ' || source || chr(10) || 'assistant: ' || text")})
hist = lambda: N.messages_to_history(m())
scalar(
    "P12_history", "convs",
    {
        "system": (lambda: hist()["system"], "case when messages[1].role = 'system' then messages[1].content end"),
        "pairs": (lambda: F.size(hist()["history"]).cast("long"), f"greatest(ceil(len({REST}) / 2.0) - 1, 0)::bigint"),
        "query": (lambda: hist()["query"], f"({REST})[(ceil(len({REST}) / 2.0) * 2 - 1)::int].content"),
        "response": (lambda: hist()["response"], f"({REST})[(ceil(len({REST}) / 2.0) * 2)::int].content"),
    },
)
scalar("P13_alpaca", "documents", {"value": (lambda: N.alpaca_query(F.when(F.col("doc_id") % 5 != 0, F.col("lang")), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))), "case when doc_id % 5 <> 0 and doc_id % 3 <> 0 then lang || chr(10) || source when doc_id % 5 <> 0 then lang when doc_id % 3 = 0 then '' else source end")})
scalar("P14_standard_messages", "raw", {"value": (lambda: flat(N.standard_messages(turns(), "from", "value", F.lit("sys"))), "case when turns[1].\"from\" = 'system' then '' else 'system: sys' || chr(10) end || array_to_string([case x.\"from\" when 'human' then 'user' when 'gpt' then 'assistant' else x.\"from\" end || ': ' || x.value for x in turns], chr(10))")})
scalar("P15_sharegpt", "documents", {"value": (lambda: flat(N.sharegpt_to_messages(F.array(F.struct(F.col("source").alias("human"), F.col("lang").alias("assistant"))), F.lit("s"))), "'system: s' || chr(10) || 'user: ' || source || chr(10) || 'assistant: ' || lang")})
scalar("P16_literal", "documents", {"value": (lambda: F.array_join(F.transform(N.literal_conversations(F.concat(F.lit("[{'from': 'human', 'value': '"), "source", F.lit("'} {'from': 'gpt', 'value': None}]"))), lambda x: F.concat(x["from"], F.lit("="), F.coalesce(x["value"], F.lit("-")))), ";"), "'human=' || source || ';gpt=-'")})
scalar("P17_class_label", "documents", {"value": (lambda: N.class_label((F.col("doc_id") % 7).cast("string")), "(doc_id % 7)::int")})


@query("P18_auto_dispatch", f"select 'conversations' as layout, count(*) as n, sum(len(turns))::bigint as messages from {RAW} union all select 'alpaca', count(*), count(*) * 2 from documents union all select 'response', count(*), count(*) * 2 from documents")
def auto(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    frames = {
        "conversations": raw(spark, sf_dir).withColumnRenamed("turns", "conversations"),
        "alpaca": docs.select(F.col("source").alias("instruction"), F.col("lang").alias("input"), F.col("text").alias("output")),
        "response": docs.select(F.col("source").alias("prompt"), F.col("text").alias("answer")),
    }
    return reshape.union_all(*[N.auto_messages(f).agg(F.lit(k).alias("layout"), F.count("*").alias("n"), F.sum(F.size("messages")).alias("messages")) for k, f in frames.items()])


scalar("P19_fill_prompt", "documents", {"value": (lambda: N.fill_prompt("Say {{QUERY}} now", F.col("source")), "'Say ' || source || ' now'")})
cls = lambda: N.class_prompt("sentiment", ["bad", "good"], F.col("source"), F.when(F.col("doc_id") % 3 != 2, (F.col("doc_id") % 3).cast("int")))
scalar("P20_class_prompt", "documents", {"query": (lambda: cls()[0], "'Task: sentiment' || chr(10) || 'Sentence: ' || source || chr(10) || 'Category: bad, good' || chr(10) || 'Output:'"), "response": (lambda: cls()[1], "case doc_id % 3 when 0 then 'bad' when 1 then 'good' end")})
scalar("P21_pick", "documents", {"value": (lambda: N.pick(7, F.col("doc_id"), ["a", "b", "c"]), "['a', 'b', 'c'][((((doc_id % 1000003) * 48271 + 7) % 2147483647 * 69621 + 11) % 2147483647 % 3 + 1)::int]")})
scalar("P22_video_messages", "raw", {"value": (lambda: flat(N.video_messages(turns())), "array_to_string([case x.\"from\" when 'human' then 'user' else 'assistant' end || ': ' || replace(x.value, '<image>', '<video><audio>') for x in turns], chr(10))")})
FIRST_HUMAN = "([x.value for x in turns if x.\"from\" = 'human'])[1]"
scalar(
    "P23_problem_solution", "raw",
    {"problem": (lambda: N.problem_and_solution(turns())[0], f"replace({FIRST_HUMAN}, '<image>', '<video><audio>')"), "solution": (lambda: N.problem_and_solution(turns())[1], "([x.value for x in turns if x.\"from\" = 'gpt'])[1]")},
)
scalar("P24_vista_messages", "raw", {"value": (lambda: flat(N.vista_messages(turns())), "array_to_string([case x.\"from\" when 'human' then 'user' else 'assistant' end || ': ' || replace(x.value, '<image>', '<video>') for x in turns if x.\"from\" in ('human', 'gpt')], chr(10))")})
video = lambda: F.concat(F.lit("/v/"), "source", F.lit("/"), "doc_id", F.lit(".mp4"))
scalar("P25_audio_path", "documents", {"a": (lambda: N.audio_path(video(), "/v/", "/a/"), "'/a/' || source || '/' || doc_id || '.mp3'"), "b": (lambda: N.audio_path_in(video(), "/x/"), "'/x/' || doc_id || '.mp3'")})


@query("P26_add_audio", "select doc_id, '/a/' || doc_id || '.mp3' as audio, 'user: <video><audio>' || source as messages, '<video><audio>' || lang as problem from documents")
def add_audio(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", video().alias("video"), F.array(N.message("user", F.concat(F.lit("<video>"), "source"))).alias("messages"), F.concat(F.lit("<video>"), "lang").alias("problem"), F.col("lang").alias("solution"))
    return N.add_audio(docs, "/a").select("doc_id", F.col("audios")[0].alias("audio"), flat(F.col("messages")).alias("messages"), "problem")


scalar("P27_suffix_once", "convs", {"value": (lambda: flat(N.instruct_users(N.instruct_users(m(), " Think."), " Think.")), "array_to_string([x.role || ': ' || x.content || case when x.role = 'user' then ' Think.' else '' end for x in messages], chr(10))")})
scalar("P28_prefix_once", "turns", {"value": (lambda: N.prepend_once(N.prepend_once(F.col("text"))), "'<video><audio>' || chr(10) || text")})
scalar("P29_replace_paths", "pages", {"value": (lambda: N.replace_paths(F.col("url"), {"https://": "/data/", "http://": "/data/"})[0], "replace(replace(url, 'https://', '/data/'), 'http://', '/data/')"), "changed": (lambda: N.replace_paths(F.col("url"), {"https://": "/data/", "http://": "/data/"})[1], "contains(url, 'https://') or contains(url, 'http://')")})
scalar("P30_replace_values", "documents", {"value": (lambda: F.get_json_object(N.replace_in_values(F.to_json(F.struct(F.col("source").alias("src"), F.array("lang", "source").alias("l"))), "src", "S"), "$.l[1]"), "replace(source, 'src', 'S')")})
scalar("P31_tool_messages", "convs", {"system": (lambda: N.tool_messages(m())[0], "case when messages[1].role = 'system' then messages[1].content end"), "rest": (lambda: flat(N.tool_messages(m())[1]), f"array_to_string([x.role || ': ' || x.content for x in {REST}], chr(10))")})
parts = lambda: F.array(F.struct(F.lit("image_url").alias("type"), nul().alias("text"), F.col("url").alias("url")), F.struct(F.lit("text").alias("type"), F.lit("what?").alias("text"), nul().alias("url")))
scalar("P32_flatten_content", "pages", {"value": (lambda: N.flatten_content(parts())[0], "'<image>what?'"), "media": (lambda: N.flatten_content(parts())[1][0], "url")})


@query("P33_variants", "select doc_id as chosen_id, lang as chosen_lang, source as rejected_lang, doc_id as rejected_id from documents")
def variants(spark, sf_dir):
    df = N.unflatten_variants(read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("rejected_lang")))
    return df.select(F.col("chosen.doc_id").alias("chosen_id"), F.col("chosen.lang").alias("chosen_lang"), F.col("rejected.lang").alias("rejected_lang"), F.col("rejected.doc_id").alias("rejected_id"))


LAST_USER = "list_max([i for i in range(1, len(messages) + 1) if messages[i].role = 'user'])"
scalar("P34_rejected_messages", "convs", {"value": (lambda: flat(N.rejected_messages(m(), F.lit("no"))), f"array_to_string([x.role || ': ' || x.content for x in messages[1:{LAST_USER}]], chr(10)) || chr(10) || 'assistant: no'")})
scalar("P35_remove_response", "convs", {"n": (lambda: F.size(N.remove_response(m())[0]).cast("long"), "len(messages) - case when messages[-1].role = 'assistant' then 1 else 0 end"), "label": (lambda: N.remove_response(m())[1], "case when messages[-1].role = 'assistant' then messages[-1].content end")})
calls = lambda: F.concat(F.array(N.message("user", F.col("lang")), N.message("tool_call", F.lit("a")), N.message("tool_call", F.col("source")), N.message("tool", F.lit("r")), N.message("tool_call", F.lit("b"))))
scalar("P36_merge_tool_calls", "documents", {"value": (lambda: flat(N.merge_tool_calls(calls())), "'user: ' || lang || chr(10) || 'assistant: a' || chr(10) || source || chr(10) || 'tool: r' || chr(10) || 'assistant: b'")})
img = lambda: F.concat(F.lit("see <img>"), "url", F.lit("</img> and <img>b.png</img>"))
scalar("P37_inline_images", "pages", {"value": (lambda: N.inline_images(img())[0], "'see <image> and <image>'"), "paths": (lambda: F.array_join(N.inline_images(img())[1], ","), "url || ',b.png'")})
scalar("P38_missing_tags", "pages", {"value": (lambda: N.add_missing_tags(F.lit("<image>x"), F.array_repeat("url", 1 + (F.col("page_id") % 3).cast("int")), "image"), "repeat('<image>', (page_id % 3)::int) || '<image>x'")})
scalar("P40_without_modality", "raw", {"value": (lambda: flat(N.without_modality(N.vista_messages(turns()), "video")), "array_to_string([case x.\"from\" when 'human' then 'user' else 'assistant' end || ': ' || trim(replace(x.value, '<image>', ''), chr(32) || chr(9) || chr(10) || chr(13)) for x in turns if x.\"from\" in ('human', 'gpt')], chr(10))")})
scalar("P41_instruct_last_user", "convs", {"value": (lambda: flat(N.instruct_last_user(m(), " Now.")), f"array_to_string([messages[i].role || ': ' || messages[i].content || case when i = {LAST_USER} then ' Now.' else '' end for i in range(1, len(messages) + 1)], chr(10))")})
scalar("P42_clean_question", "turns", {"value": (lambda: N.clean_question(F.concat(F.lit("<video><audio>\n"), "text", F.lit(" Think.")), " Think."), "trim(text, chr(32) || chr(9) || chr(10) || chr(13))")})
scalar("P43_printable", "documents", {"value": (lambda: N.printable(F.col("text"), "html"), "case when length(text) >= 1000 then '<<<' || substring(text, 1, 16) || '>>>' else text end")})


@query("S5_sanitised_rows", "select doc_id, null::varchar as access_token, '<' || strlen(source) || ' bytes>' as raw from documents")
def sanitised(spark, sf_dir):
    return N.sanitise(read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("access_token"), F.col("source").cast("binary").alias("raw")))


# --- one row to several ----------------------------------------------------

@query(
    "E1_split_turns",
    f"""with c as (select *, len(messages) // 2 as n from {CONVS})
    select conv_id::varchar || case when n > 1 then '_turn' || i else '' end as id, case when n > 1 then 'p' else 'w' end as kind,
      '<video><audio>' || chr(10) || messages[2*i-1].content as question, messages[2*i].content as answer from c, lateral (select unnest(range(1, n + 1)) as i) k""",
)
def split_turns(spark, sf_dir):
    rows = reshape.split_turns(convs(spark, sf_dir).select(F.col("conv_id").alias("id"), "messages"))
    return rows.select("id", F.when(F.contains("id", F.lit("_turn")), "p").otherwise("w").alias("kind"), m()[0]["content"].alias("question"), m()[1]["content"].alias("answer"))


@query("E2_two_answers", "select source, 'Human' as label, lang as answer from documents union all select source, 'ChatGPT', text from documents")
def two_answers(spark, sf_dir):
    return reshape.classification_pair(read(spark, sf_dir, "documents"), "source", "lang", "text")


scalar("E3_json_messages", "documents", {"value": (lambda: flat(reshape.json_messages(F.concat(F.lit('[{"a":'), "doc_id", F.lit('},{"b":2}]')))), "'tool: {\"a\":' || doc_id || '}' || chr(10) || 'tool: {\"b\":2}'")})


@query("E4_chunks", "select doc_id, count(*) as n, max(k) as last_length from (select doc_id, least(300, n_chars - 300 * i) as k, i from documents, (select unnest(range(0, 1000)) as i) r where 300 * i < n_chars) group by doc_id having true")
def chunked(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", F.explode(reshape.chunks(F.sequence(F.lit(1), F.col("n_chars").cast("int")), 300)).alias("c"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.size("c").cast("long")).alias("last_length"))


scalar("E7_dialogue_pairs", "documents", {"value": (lambda: flat(reshape.dialogue_pairs(F.concat(F.lit("\n\nHuman: "), "source", F.lit("\n\nAssistant: "), "lang", F.lit("\n\nHuman: bye")))), "'user: ' || source || chr(10) || 'assistant: ' || lang || chr(10) || 'user: bye'")})


@query("E8_replicate", f"select conv_id, i::int as generation from {CONVS}, (select unnest(range(0, 4)) as i) r")
def replicate(spark, sf_dir):
    from millrace.operators.windows import repeated

    return repeated(convs(spark, sf_dir).select("conv_id"), 4)


# --- filters over messages -------------------------------------------------

scalar("F10_valid_messages", "convs", {"ok": (lambda: validate.valid_messages(m()), "len(messages) > 0 and len([x for x in messages if x.role not in ('system', 'user', 'assistant', 'tool', 'tool_call', 'tool_response')]) = 0")})
scalar("F11_valid_rejected", "convs", {"ok": (lambda: validate.valid_rejected(m(), F.when(F.col("conv_id") % 3 == 0, F.element_at(m(), -1)["content"]).when(F.col("conv_id") % 3 == 1, "x")), "conv_id % 3 = 1")})
scalar("F15_word_blacklist", "convs", {"ok": (lambda: validate.free_of_words(m(), ["Human:", "tiont"]), "len([x for x in messages if contains(lower(x.content), 'human:') or contains(lower(x.content), 'tiont')]) = 0")})
scalar("F17_overlap", "embeddings", {"v": (lambda: validate.has_overlap(F.array(F.array(F.lit(0), F.lit(10)), F.array((F.col("vec_id") % 20).cast("int"), F.lit(30)))), "case when vec_id % 20 = 0 then true else vec_id % 20 < 10 end")})
tokens = lambda: F.sequence(F.lit(1), (F.col("doc_id") % 40 + 1).cast("int"))
scalar(
    "F19_fit_length", "documents",
    {
        "dropped": (lambda: validate.fit_length(tokens(), 20, "raise").isNull(), "doc_id % 40 + 1 > 20"),
        "left": (lambda: F.array_join(validate.fit_length(tokens(), 20, "left"), ","), "array_to_string(range(greatest(doc_id % 40 + 1 - 19, 1), doc_id % 40 + 2), ',')"),
        "right": (lambda: F.array_join(validate.fit_length(tokens(), 20, "right", 30), ","), "array_to_string([x for x in range(1, doc_id % 40 + 2) if x <= case when doc_id % 40 + 1 <= 20 then 40 when doc_id % 40 + 1 >= 30 then 19 else 20 end or x = 30], ',')"),
        "chunks": (lambda: F.size(validate.fit_length(tokens(), 20, "split")).cast("long"), "ceil((doc_id % 40 + 1) / 20.0)::bigint"),
    },
)
scalar("F20_media_lists", "pages", {"ok": (lambda: F.forall(F.array("url"), lambda u: u.isNotNull() & (u != "")), "url <> ''")})
scalar("F21_single_turn", "convs", {"ok": (lambda: validate.all_single_turn(m()), "len(messages) // 2 = 1")})
