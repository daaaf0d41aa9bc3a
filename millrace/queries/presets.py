"""Named layouts: the messages they make of documents, compared text by text."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import reshape
from millrace.plans.presets import GROUNDING, PRESETS, grounding_prompt
from millrace.queries.base import flat, python_string, query, read
from millrace.queries.tables import draw_sql, page_folder
from millrace.sources.listing import list_files

c, lit = F.col, F.lit
NL = "chr(10)"


def turns(*pairs: tuple[str, str]) -> str:
    """SQL of messages as text."""
    return f" || {NL} || ".join(f"'{role}: ' || {text}" for role, text in pairs)


def layouts(name: str, rows: dict, more: str | None = None):
    """A query of several layouts: each is (a frame of documents in that layout, SQL of the text, SQL of further columns, a SQL condition)."""
    sql = " union all ".join(f"select '{n}' as name, md5({text}) as text, ({extra or 'null'})::varchar as extra from documents where {where or 'true'}" for n, (_, text, extra, where, _) in rows.items())

    @query(name, sql)
    def run(spark, sf_dir):
        docs = read(spark, sf_dir, "documents")
        out = []
        for n, (frame, _, _, _, extra) in rows.items():
            made = PRESETS[n](frame(docs))
            out.append(made.select(lit(n).alias("name"), F.md5(flat(c("messages"))).alias("text"), (extra() if extra else lit(None)).cast("string").alias("extra")))
        return reshape.union_all(*out)


def text_of(n):
    return F.array_join(F.transform(n, lambda m: F.array_join(F.transform(m, lambda x: x["content"]), "|")), ";")


layouts(
    "presets_texts",
    {
        "dolly_15k": (lambda d: d.select(F.when(c("doc_id") % 3 > 0, F.when(c("doc_id") % 3 == 1, c("source")).otherwise("")).alias("context"), c("lang").alias("instruction"), c("text").alias("response")), turns(("user", f"case when doc_id % 3 = 1 then 'Here gives some useful information:' || {NL} || source || {NL} else '' end || lang"), ("assistant", "text")), None, None, None),
        "tigerbot_law": (lambda d: d.select(c("lang").alias("type"), c("source").alias("title"), lit("ch1 ").alias("chapter1"), F.when(c("doc_id") % 2 == 0, "ch2 ").alias("chapter2"), lit(None).cast("string").alias("chapter3"), c("text").alias("response")), f"'assistant: ' || lang || {NL} || source || {NL} || 'ch1 ' || case when doc_id % 2 = 0 then 'ch2 ' else '' end || text", None, None, None),
        "leetcode_python": (lambda d: d.select(F.concat(F.when(c("doc_id") % 2 == 0, "# ").otherwise(""), c("text"), lit("\n```python\npass\n```\n ")).alias("code_with_problem"), c("lang").alias("explanation_only")), turns(("user", f"case when doc_id % 2 = 1 and text[:2] = '# ' then text[3:] else text end || {NL}"), ("assistant", f"'```python' || {NL} || 'pass' || {NL} || '```' || {NL} || {NL} || lang")), None, None, None),
        "ruozhiba": (lambda d: d.select(F.when(c("doc_id") % 5 > 0, F.concat(lit("第"), "doc_id", lit("、"), "lang")).alias("title"), c("lang").alias("content"), F.when(c("doc_id") % 2 == 0, c("source")).alias("abs")), "'assistant: ' || lang || case when doc_id % 2 = 0 then '，' || source else '' end", None, None, None),
        "blossom_math": (lambda d: d.select(c("source").alias("query"), c("text").alias("output"), c("lang").alias("answer")), turns(("user", "source"), ("assistant", f"text || {NL} || {NL} || 'Answer: ' || lang")), None, None, None),
        "long_alpaca": (lambda d: d.select(c("source").alias("instruction"), lit("").alias("input"), F.concat(F.when(c("doc_id") % 2 == 0, "Answer:  ").otherwise(""), "lang").alias("output")), turns(("user", "source"), ("assistant", "lang")), None, None, None),
        "countdown": (lambda d: d.select(F.array(c("doc_id"), c("doc_id") + 1).alias("nums"), (c("doc_id") * 2).alias("target")), "'user: Using the numbers [' || doc_id || ', ' || doc_id + 1 || '], create an equation that equals ' || doc_id * 2 || '.' || chr(10) || 'You can use basic arithmetic operations (+, -, *, /) and each number can only be used once.' || chr(10) || 'Show your work in <think> </think> tags. And return the final equation and answer in <answer> </answer> tags, for example <answer> (1 + 2) / 3 * 4 = 4 </answer>.'", "doc_id * 2", None, lambda: c("target")),
        "dureader": (lambda d: d.select(F.concat("lang", F.when(c("doc_id") % 7 > 0, "[SEP]").otherwise(""), "source").alias("text1"), c("text").alias("text2")), turns(("user", f"'Task: Question Generation' || {NL} || 'Context: ' || source || {NL} || 'Answer: ' || lang || {NL} || 'Question:'"), ("assistant", "text")), None, "doc_id % 7 > 0", None),
    },
)

SIMILAR = f"'Task: Based on the given two sentences, provide a similarity score between 0.0 and 1.0.' || {NL} || 'Sentence 1: ' || lang || {NL} || 'Sentence 2: ' || source || {NL} || 'Similarity score: '"
pairs = lambda d: d.select((c("doc_id") % 5 / 4).alias("score"), c("lang").alias("sentence1"), c("source").alias("sentence2"))
WRITTEN = lambda marks: F.concat(lit(f"\n\n{marks[0]}: "), "lang", lit("\n\nAssistant: "), "source", lit(f"\n\n{marks[1]}: more \n\nAssistant: "), F.trim("text"), F.when(c("doc_id") % 2 == 0, "\n\nHuman: odd").otherwise(""))
layouts(
    "presets_pairs",
    {
        "stsb": (pairs, "'user: ' || lang", "source || ':' || doc_id % 5 / 4", None, lambda: F.concat(text_of("positive_messages"), lit(":"), "label")),
        "stsb_positive": (pairs, "'user: ' || lang", "source || ':' || doc_id % 5 / 4", "doc_id % 5 / 4 >= 0.75", lambda: F.concat(text_of("positive_messages"), lit(":"), "label")),
        "stsb_generate": (lambda d: pairs(d).withColumn("score", F.round("score")), turns(("user", SIMILAR), ("assistant", "printf('%.1f', round(doc_id % 5 / 4))")), None, None, None),
        "stsb_regression": (pairs, f"'user: ' || {SIMILAR}", "(doc_id % 5 / 4)::double", None, lambda: c("label")),
        "hh_rlhf": (lambda d: d.select(WRITTEN(("Human", "Hum")).alias("chosen"), WRITTEN(("Human", "Human")).alias("rejected")), turns(("user", "lang"), ("assistant", "source"), ("user", "'more'"), ("assistant", "trim(text, ' ' || chr(9) || chr(10) || chr(13))")), "4", None, lambda: F.size("rejected_messages")),
        "guanaco": (
            lambda d: d.select(F.when(c("doc_id") % 4 == 0, "").when(c("doc_id") % 4 == 1, F.concat(lit("User:"), "lang", lit("Asssistent:"), "source")).when(c("doc_id") % 4 == 2, F.concat(lit("Assistant:"), "lang")).otherwise(F.concat(lit("User："), "lang", lit("Assistenz:"))).alias("instruction"), F.concat(lit("User: "), "source", lit(" ")).alias("input"), c("text").alias("output")),
            f"case when doc_id % 4 = 1 then 'user: ' || lang || {NL} || 'assistant: ' || source || {NL} else '' end || " + turns(("user", "source"), ("assistant", "text")), None, "doc_id % 4 < 2", None,
        ),
        "multi_role_agent": (
            lambda d: d.select(F.array(F.struct(F.when(c("doc_id") % 3 == 0, "user").otherwise("system").alias("from"), c("source").alias("value")), F.struct(c("lang").alias("from"), c("text").alias("value"))).alias("conversations")),
            turns(("system", "''"), ("user", "source"), ("assistant", "text")), None, "doc_id % 3 = 0", None,
        ),
        "toolbench": (lambda d: d.select(F.array(F.struct(F.when(c("doc_id") % 2 == 0, "caller").otherwise("user").alias("from"), c("source").alias("value")), F.struct(F.when(c("doc_id") % 2 == 0, "caller").otherwise("conclusion").alias("from"), c("text").alias("value"))).alias("conversations")), f"case when doc_id % 2 = 0 then 'caller' else 'user' end || ': ' || source || {NL} || 'assistant: ' || text", None, None, None),
        "function_call_chatml": (
            lambda d: d.select(F.transform(F.array(lit("system"), lit("user"), lit("system")), lambda r: F.struct(r.alias("role"), F.concat(r, lit("!")).alias("content"), lit(None).cast("double").alias("loss"))).alias("messages"), F.when(c("doc_id") % 2 == 0, F.concat("lang", lit("\n\n"), "source")).otherwise("").alias("function_description")),
            turns(("user", "'user!'"), ("system", "'system!'")), "case when doc_id % 2 = 0 then lang || '|' || source end", None, lambda: F.array_join("tools", "|"),
        ),
    },
)

layouts(
    "presets_media",
    {
        "gpt4v": (lambda d: d.select(c("text").alias("response"), F.array("source").alias("images")), turns(("user", "'What is the caption of this image?'"), ("assistant", "text")), "source", None, lambda: F.array_join("images", ",")),
        "garbage": (lambda d: d.select(c("doc_id").alias("label"), F.array("source").alias("images")), "'user: Task: Classify household waste.'", "doc_id", None, lambda: c("label")),
        "textcaps": (lambda d: d.select(c("text").alias("response")), turns(("user", "'What is the caption of this image?'"), ("assistant", "text")), None, None, None),
        "clevr": (lambda d: d.select(c("lang").alias("query"), c("text").alias("response")), turns(("user", "lang || ' Output the thinking process in <think> </think> and final answer (number) in <answer> </answer> tags.'"), ("assistant", "text")), None, None, None),
        "geometry3k": (lambda d: d.select(c("lang").alias("query"), c("text").alias("response")), turns(("user", "lang"), ("assistant", "text")), "text", None, lambda: c("solution")),
        "aishell1": (lambda d: d.select("text", c("source").alias("audio")), turns(("user", "'语音转文本'"), ("assistant", "replace(text, ' ', '')")), "source", None, lambda: c("audios")[0]),
        "emo_schema": (lambda d: d.select(c("source").alias("query"), F.array(F.concat(lit("A. "), "lang"), lit("B. x")).alias("option"), (c("doc_id") % 5).cast("string").alias("response"), c("source").alias("video")), turns(("user", f"source || {NL} || 'A. ' || lang || {NL} || 'B. x'"), ("assistant", "chr((65 + doc_id % 5)::int)")), None, None, None),
        "emo_schema_cls": (lambda d: d.select(c("source").alias("query"), F.array(lit("A. x"), lit("B. x")).alias("option"), (c("doc_id") % 5).cast("string").alias("response"), c("source").alias("video")), f"'user: ' || source || {NL} || 'A. x' || {NL} || 'B. x'", "doc_id % 5", None, lambda: c("label")),
        "coco": (lambda d: d.select(F.array("source").alias("images"), F.struct(F.array((c("doc_id") % 4) * 20, lit(79)).alias("category"), lit(1).alias("bbox")).alias("objects")), turns(("user", "'Task: Object Detection'"), ("assistant", f"'<ref-object><bbox>' || {NL} || '<ref-object><bbox>'")), "['person', 'elephant', 'wine glass', 'dining table'][doc_id % 4 + 1] || ',toothbrush'", None, lambda: F.array_join("objects.ref", ",")),
        "voc2007_multilabel": (
            lambda d: d.select(F.array("source").alias("images"), F.transform(F.sequence(lit(0), lit(19)), lambda i: (i % 7 == c("doc_id") % 7).cast("int")).alias("npy")),
            "'user: 多标签分类，类别包括：[''aeroplane'', ''bicycle'', ''bird'', ''boat'', ''bottle'', ''bus'', ''car'', ''cat'', ''chair'', ''cow'', ''diningtable'', ''dog'', ''horse'', ''motorbike'', ''person'', ''pottedplant'', ''sheep'', ''sofa'', ''train'', ''tvmonitor'']'",
            "array_to_string([i for i in range(20) if i % 7 = doc_id % 7], ',')", None, lambda: F.array_join("label", ","),
        ),
    },
)

PROMPT = "('Classification Task: Are the following responses from a human or from ChatGPT?' || chr(10) || 'Question: ' || source || chr(10) || 'Answer: ' || answer || chr(10) || 'Category: Human, ChatGPT' || chr(10) || 'Output:')"
HUMAN = f"(select doc_id, source, [lang, source, 'x'][({draw_sql('doc_id')} % 3 + 1)::int] as answer, 'Human' as label, 0 as n from documents union all select doc_id, source, [text, lang][({draw_sql('doc_id', 43)} % 2 + 1)::int], 'ChatGPT', 1 from documents)"


@query("presets_hc3", f"select 'hc3' as name, md5('user: ' || {PROMPT} || chr(10) || 'assistant: ' || label) as text, null::int as label from {HUMAN} union all select 'hc3_cls', md5('user: ' || {PROMPT}), n::int from {HUMAN}")
def hc3(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(c("doc_id").alias("key"), c("source").alias("question"), F.array("lang", "source", lit("x")).alias("human_answers"), F.array("text", "lang").alias("chatgpt_answers"))
    made = [PRESETS[n](docs) for n in ("hc3", "hc3_cls")]
    return reshape.union_all(*[m.select(lit(n).alias("name"), F.md5(flat(c("messages"))).alias("text"), (c("label") if "label" in m.columns else lit(None)).cast("int").alias("label")) for n, m in zip(("hc3", "hc3_cls"), made)])


def drawn_sql(task: str, side: int) -> str:
    forms = {lang: "[" + ", ".join(f"'{p[side]}'" for p in rows) + "]" for lang, rows in GROUNDING[task].items()}
    at = {lang: f"({draw_sql('doc_id', 43)} % {len(rows)} + 1)::int" for lang, rows in GROUNDING[task].items()}
    return f"case when {draw_sql('doc_id')} < {int(0.8 * 2147483647)} then {forms['en']}[{at['en']}] else {forms['zh']}[{at['zh']}] end"


@query("P21_grounding", " union all ".join(f"select doc_id, '{t}' as task, {drawn_sql(t, 0)} as question, {drawn_sql(t, 1)} as answer from documents" for t in GROUNDING))
def grounding(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return reshape.union_all(*[docs.select("doc_id", lit(t).alias("task"), *[x.alias(n) for n, x in zip(("question", "answer"), grounding_prompt(t, c("doc_id")))]) for t in GROUNDING])


# phrases at two places of a text; those of every fifth document overlap, and every seventh has none
SPANS = "(select *, doc_id % 3 as a, doc_id % 3 + 4 as b, case when doc_id % 5 = 0 then doc_id % 3 + 2 else 8 end as x, 12 as y from documents where doc_id % 7 > 0)"


def phrased(task: str) -> str:
    question, answer = ("'what is the proper caption of this image?'", "text") if task == "vqa" else (drawn_sql(task, 0), drawn_sql(task, 1))
    return (
        f"select 'grit_{task}' as name, doc_id, md5({turns(('user', question), ('assistant', answer))}) as text, substring(text, x + 1, y - x) || '|' || substring(text, a + 1, b - a) as refs, '0.25,0.5,0.75,1.0' as box,"
        f" md5(text[:a] || '<ref-object><bbox>' || text[b + 1:x] || '<ref-object><bbox>' || text[y + 1:]) as tagged from {SPANS} where doc_id % 5 > 0"
    )


@query("presets_grit", " union all ".join(map(phrased, ("grounding", "caption", "vqa"))))
def grit(spark, sf_dir):
    def ref(a, b):
        return F.array(*[x.cast("double") for x in (a, b)], *map(lit, (0.25, 0.5, 0.75, 1.0, 0.9)))

    k = c("doc_id") % 3
    second = ref(F.when(c("doc_id") % 5 == 0, k + 2).otherwise(8), lit(12))
    none = F.array().cast("array<array<double>>")
    rows = read(spark, sf_dir, "documents").select(
        c("doc_id").alias("key"), F.array(c("doc_id").cast("string")).alias("images"), c("text").alias("caption"), F.when(c("doc_id") % 7 == 0, none).otherwise(F.array(second, ref(k, k + 4))).alias("ref_exps")
    )
    out = []
    for task in ("grounding", "caption", "vqa"):
        made = PRESETS[f"grit_{task}"](rows)
        out.append(made.select(lit(f"grit_{task}").alias("name"), c("images")[0].cast("long").alias("doc_id"), F.md5(flat(c("messages"))).alias("text"), F.array_join("objects.ref", "|").alias("refs"), F.array_join(c("objects.bbox")[0], ",").alias("box"), F.md5("tagged").alias("tagged")))
    return reshape.union_all(*out)


@query("presets_refcoco", " union all ".join(f"select '{t}' as task, doc_id, md5({turns(('user', drawn_sql(t, 0)), ('assistant', drawn_sql(t, 1)))}) as text, lang || ':' || doc_id || ',3,4,' || round_even((doc_id + 0.5)::double, 0)::int as found from documents" for t in ("grounding", "caption")))
def refcoco(spark, sf_dir):
    box = F.array(c("doc_id").cast("double"), lit(2.6), lit(4.4), c("doc_id") + lit(0.5))
    rows = read(spark, sf_dir, "documents").select(c("doc_id").alias("key"), F.array("lang", "source").alias("captions"), box.alias("bbox"), c("doc_id").cast("string").alias("image"))
    made = {t: PRESETS[f"refcoco_{t}"](rows) for t in ("grounding", "caption")}
    found = F.concat(c("objects.ref")[0], lit(":"), F.array_join(c("objects.bbox")[0], ","))
    return reshape.union_all(*[m.select(lit(t).alias("task"), c("images")[0].cast("long").alias("doc_id"), F.md5(flat(c("messages"))).alias("text"), found.alias("found")) for t, m in made.items()])


@query("presets_xlam_grpo", f"select doc_id, md5('user: ' || text || chr(10) || 'assistant: Action: ' || ['f', 'g'][({draw_sql('doc_id')} % 2 + 1)::int] || chr(10) || 'Action Input: ' || case when {draw_sql('doc_id')} % 2 = 0 then '{{\"a\": 1.0, \"b\": ' || {python_string('source')} || '}}' else '{{}}' end) as text from documents")
def xlam(spark, sf_dir):
    call = lambda name, args: F.struct(lit(name).alias("name"), args.alias("arguments"))
    first = F.to_json(F.to_variant_object(call("f", F.struct(c("source").alias("b"), lit(1.0).alias("a")))))
    rows = read(spark, sf_dir, "documents").select(c("doc_id").alias("key"), c("text").alias("query"), F.concat(lit("["), first, lit(',{"name":"g","arguments":{}}]')).alias("answers"), c("doc_id").cast("string").alias("tools"))
    return PRESETS["xlam_grpo"](rows).select(c("tools")[0].cast("long").alias("doc_id"), F.md5(flat(c("messages"))).alias("text"))


@query(
    "presets_in_folders",
    f"""with p as (select *, (page_id % 7) || '/' || (page_id % 3) || '/p.' || page_id || case when page_id % 2 = 0 then '.mp4' else '.HTML' end as path from pages where page_id % 3 <> 0)
    select 'sharegpt4o' as name, page_id, 'user: ' || url as text, path as media from p union all
    select 'video_chatgpt', page_id, 'user: ' || url || {NL} || 'assistant: ' || page_id, path from p where page_id % 2 = 0 and page_id % 5 <> 0""",
)
def presets_in_folders(spark, sf_dir):
    """Layouts whose rows stay only with their media: those of a real folder tree, as listed."""
    pages, base = page_folder(spark, sf_dir)
    listing = list_files(spark, base).withColumn("path", F.concat(lit("media/"), "path"))
    said = F.array(F.struct(lit("human").alias("from"), c("url").alias("value")))
    images = pages.select(lit("media").alias("root"), F.array("path").alias("images"), said.alias("conversations"))
    asked = F.when(c("page_id") % 5 == 0, "None").otherwise(c("url"))
    films = pages.select(lit("media").alias("root"), asked.alias("query"), lit(None).cast("string").alias("question_1"), c("page_id").cast("string").alias("response"), F.regexp_replace("path", r"\.[^.]*$", "").alias("video_name"))
    out = []
    for name, rows, media in (("sharegpt4o", images, "images"), ("video_chatgpt", films, "videos")):
        kept = reshape.media_present(PRESETS[name](rows), listing, media)
        path = F.substring(c(media)[0], 7, 1000)
        out.append(kept.select(lit(name).alias("name"), F.regexp_extract(path, r"p\.(\d+)", 1).cast("long").alias("page_id"), F.trim(flat(c("messages"))).alias("text"), path.alias("media")))
    return reshape.union_all(*out)
