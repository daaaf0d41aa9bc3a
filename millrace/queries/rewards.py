"""Rewards, parsers and text functions over assistant turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import rewards as R
from millrace.functions.canonical import row_key
from millrace.functions.parts import loss_scale, media_type, message_scales, split_parts, strategy_scales
from millrace.operators import reshape
from millrace.operators.normalize import reasoning_wrapper
from millrace.operators.normalize import self_cognition as fill
from millrace.queries.base import COMPLETIONS, completions, python_string, query, read, scalar, six

c, s, t = (lambda: F.col("completion")), (lambda: F.col("solution")), (lambda: F.col("text"))
ANSWER = "trim(regexp_extract(completion, '(?s)<answer>(.*?)</answer>', 1))"


def one(name, build, sql=None, table="completions"):
    scalar(name, table, {"value": (build, sql)})


one("R1_mc_acc", lambda: R.choice_accuracy(c(), s()), f"case when regexp_matches(substring({ANSWER}, 1, 1), '^[A-Z]$') and substring({ANSWER}, 1, 1) = substring(trim(solution), 1, 1) then 1.0::double else 0.0::double end")
one("R2_mc_acc_a_to_g", lambda: R.choice_accuracy_a_to_g(c(), s()), f"case when regexp_matches(substring({ANSWER}, 1, 1), '^[A-G]$') and substring({ANSWER}, 1, 1) = substring(trim(solution), 1, 1) then 1.0::double else 0.0::double end")
one("R3_think_answer_format", lambda: R.think_answer_format(c()), r"case when regexp_matches(completion, '(?s)<thinking>.*?</thinking>\s*<answer>.*?</answer>') then 1.0::double else 0.0::double end")
one(
    "R4_tcta_format",
    lambda: R.time_caption_format(c()),
    r"""case when len(regexp_extract_all(completion, '(?s)<time>.*?</time>\s*<caption>.*?</caption>')) >= 1
      and len(regexp_extract_all(completion, '(?s)<time>.*?</time>')) = len(regexp_extract_all(completion, '(?s)<caption>.*?</caption>'))
      and contains(completion, '<thinking>') and contains(completion, '<answer>') then 1.0::double else 0.0::double end""",
)
one(
    "R5_modality_attention",
    lambda: R.modality_attention(c(), F.when(F.col("turn") % 2 == 1, F.replace(c(), F.lit("<answer> "), F.lit("<answer> Z"))).otherwise(c()), F.lit("<answer>B</answer>"), s()),
    f"""case when (case when substring({ANSWER}, 1, 1) = substring(solution, 1, 1) then 1 else 0 end) >= (case when turn % 2 = 0 and substring({ANSWER}, 1, 1) = substring(solution, 1, 1) then 1 else 0 end)
      and (case when substring({ANSWER}, 1, 1) = substring(solution, 1, 1) then 1 else 0 end) >= (case when substring(solution, 1, 1) = 'B' then 1 else 0 end) then 0.3::double else 0.0::double end""",
)
one("R6_answer_text_accuracy", lambda: R.answer_text_accuracy(c(), F.concat(F.lit("<answer>"), F.substring(s(), 1, 1), F.lit(". x</answer>"))), f"case when {ANSWER} = substring(solution, 1, 1) || '. x' then 1.0::double else 0.0::double end")
judgement = lambda: F.concat(F.lit("I rate it. Score: 0."), F.col("turn"), F.lit(" of 1"))
one("R7_judge_score", lambda: six(R.judge_score(judgement())), "round(least(('0.' || turn)::double, 1.0), 6)")
one("R8_query_intent", lambda: six(R.query_intent(F.array(F.col("turn") / 10, F.lit(0.5)), F.lit(0.25))), "round(((turn / 10.0 + 0.5) / 2 + 0.25) / 2, 6)::double")
one("R9_judge_json", lambda: six(R.judge_json(F.concat(F.lit('```json\n{"score": 0.'), F.col("turn"), F.lit(', "why": "x"}\n```')))), "('0.' || turn)::double")
one("R10_think_answer", lambda: R.think_then_answer(F.replace(F.regexp_replace(c(), "(?s)^.*(<thinking>)", "$1"), F.lit("thinking>"), F.lit("think>"))), "case when turn % 4 <> 3 then 1.0::double else 0.0::double end")
react = lambda: F.concat(F.lit("<think>t</think>\nAction: look\nAction Input: {\"a\": "), F.col("turn"), F.lit("}\n"))
one("R11_react_format", lambda: R.react_format(F.when(F.col("turn") % 4 == 3, c()).otherwise(react())), "case when turn % 4 = 3 then 0.0::double else 1.0::double end")
WORDS = "[w for w in regexp_split_to_array(lower(text), '\\s+') if w <> '']"
GRAMS = f"[array_to_string(({WORDS})[i:i+2], ' ') for i in range(1, len({WORDS}) - 1)]"
one("R12_repetition", lambda: six(R.repetition(t())), f"round(case when len({WORDS}) < 3 then 0.0 else (1 - len(list_distinct({GRAMS}))::double / len({GRAMS})) * -1.0 end, 6) + 0.0")
one("R13_soft_overlong", lambda: six(R.soft_overlong(F.length("text"), 1000, 200)), "round(least(-(length(text) - 800) / 200.0::double, 0.0::double), 6) + 0.0")
one(
    "R14_cosine",
    lambda: six(R.cosine_length(F.length("text"), R.choice_accuracy(c(), s()))),
    f"""round(case when substring({ANSWER}, 1, 1) = substring(solution, 1, 1) then 1.0 - (1.0 - 0.5) * (1 - cos(length(text) * pi() / 1000)) / 2
      else -0.5 - (-0.5 - 0.0) * (1 - cos(length(text) * pi() / 1000)) / 2 end, 6) + 0.0""",
)
one("R15_toolbench", lambda: R.toolbench(react(), F.concat(F.lit("Action: look\nAction Input: {\"a\": "), F.col("conv_id") % 4, F.lit("}"))), "case when turn = conv_id % 4 then 1.0::double else 0.0::double end")
one("R16_math", lambda: R.math_text(F.concat(F.lit("so \\boxed{"), F.col("turn"), F.lit(" + 1}")), F.concat(F.lit("\\boxed{"), F.col("conv_id") % 8, F.lit("+1}"))), "case when turn = conv_id % 8 then 1.0::double else 0.0::double end")
one("R17_math_accuracy", lambda: R.math_accuracy(c(), F.concat(F.substring(s(), 1, 1), F.lit(". x"))), f"case when {ANSWER} = substring(solution, 1, 1) || '. x' then 1.0::double else 0.0::double end")
one("R18_countdown", lambda: R.countdown(F.concat(F.lit("<answer>("), F.col("turn"), F.lit(" + 2) * 3 = x</answer>")), F.col("conv_id") % 30, F.array(F.col("turn"), F.lit(2), F.lit(3))), "case when (turn + 2) * 3 = conv_id % 30 then 1.0::double else 0.0::double end")
one("R20_last_code_block", lambda: R.last_code_block(F.concat(F.lit("a\n```python\nx = 1\n```\nb\n```python\ny = "), F.col("turn"), F.lit("\n```\n"))), "'y = ' || turn || chr(10)")
one("R21_code_format", lambda: R.code_format(F.concat(F.lit("<think>a</think>\n<answer>\n```"), F.when(F.col("turn") % 2 == 1, "python").otherwise("c++"), F.lit("\nx\n```\n</answer>")), F.lit("c++")), "case when turn % 2 = 1 then 0.0::double else 1.0::double end")
tool = lambda: F.concat(F.lit("<think>go on</think>\n<tool_call>\n{\"name\": \"f\", \"parameters\": {\"a\": "), F.col("turn"), F.lit("}}\n</tool_call>"))
truth = lambda: F.concat(F.lit("<tool_call>\n{\"name\": \"f\", \"parameters\": {\"a\": "), F.col("conv_id") % 4, F.lit("}}\n</tool_call>"))
one("R23_tool_format", lambda: R.tool_format(F.when(F.col("turn") % 4 == 3, c()).otherwise(tool()), truth()), "case when turn % 4 = 3 then 0.0::double else 1.0::double end")
one("R24_tool_length", lambda: six(R.tool_length(F.concat(F.lit("<think>"), t(), F.lit("</think>")))), "least(round_even(len([w for w in regexp_split_to_array(text, '\\s+') if w <> '']) / 512.0::double, 2), 1.0::double)")
one("R25_tool_correctness", lambda: six(R.tool_correctness(tool(), truth())), "case when turn = conv_id % 4 then 3.0::double else 1.0::double end")
scalar(
    "R25_tool_modes", "completions",
    {
        "refined": (lambda: six(R.tool_correctness(tool(), truth(), detail="refined")), "case when turn = conv_id % 4 then 3.0::double else 1.0::double end"),
        "intermediate": (lambda: six(R.tool_correctness(tool(), truth(), detail="intermediate")), "case when turn = conv_id % 4 then 3.0::double else 0.0::double end"),
        "coarse": (lambda: six(R.tool_correctness(tool(), truth(), detail="coarse")), "case when turn = conv_id % 4 then 3.0::double else -3.0::double end"),
        "two_stage": (lambda: six(R.tool_correctness(tool(), truth(), *R.tool_range(15, schedule="two_stage"))), "case when turn = conv_id % 4 then 1.0::double else round(1 / 3.0, 6)::double end"),
        "linear": (lambda: six(R.tool_correctness(tool(), truth(), *R.tool_range(75, schedule="linear"))), "case when turn = conv_id % 4 then 2.5::double else round(5 * 2 / 3.0 - 2.5, 6)::double end"),
    },
)
one("R26_judge_yes_no", lambda: R.judge_yes_no(F.when(F.col("turn") % 4 == 1, F.lit("well [yes]")).otherwise(F.lit("[NO]"))), "case when turn % 4 = 1 then 1.0::double else 0.0::double end")
one(
    "R27_deepeyes",
    lambda: six(R.deepeyes(c(), F.lit(1), F.col("turn"))),
    "round(0.8 + case when turn > 1 then 1.2 else 0.0 end, 6)::double",
)
one("R28_last_answer", lambda: R.last_answer(F.concat(c(), F.lit("<answer>"), F.col("turn"), F.lit("</answer>"))), "turn::varchar")
one("R29_calculator", lambda: R.calculator(F.concat(F.lit("("), F.col("turn"), F.lit(" + 1) * 2"))), "((turn + 1) * 2)::varchar")
scalar("R30_react_action", "completions", {"action": (lambda: R.react_action(react())[0], "'look'"), "given": (lambda: R.react_action(react())[1], "'{\"a\": ' || turn || '}'")})
one("R19_thinking_tips", lambda: R.thinking_tips(R.choice_accuracy(c(), s())), f"case when substring({ANSWER}, 1, 1) = substring(solution, 1, 1) then 1.0::double else 0.0::double end")
one("X4_media_type", lambda: media_type(F.concat(F.lit("a/b."), F.get(F.array(*map(F.lit, ("MP4", "wav", "png"))), (F.col("turn") % 3).cast("int")))), "case turn % 3 when 0 then 'video' when 1 then 'audio' else 'image' end")
one(
    "X5_row_key",
    lambda: row_key("turn", "text", "conv_id", F.struct(F.lit(None).cast("int").alias("none"), (F.col("turn") / 2).alias("half"), F.array("solution", F.lit("é")).alias("list")).alias("meta"), "choices"),
    f"""md5('{{"conv_id": ' || conv_id || ', "meta": {{"half": ' || (turn / 2)::double || ', "list": [' || {python_string('solution')} || ', "\\u00e9"], "none": null}}, "text": ' || {python_string('text')} || ', "turn": ' || turn || '}}')""",
)
one("X6_find_all", lambda: F.array_join(reshape.find_all(F.transform(F.sequence(F.lit(0), F.col("turn")), lambda x: (x % 2).cast("int")), F.array(F.lit(1), F.lit(0))), ","), "array_to_string([i for i in range(1, turn, 2)], ',')")
one("X8_reasoning_wrapper", lambda: reasoning_wrapper(t(), s()), "'<think>' || text || '</think>' || chr(10) || chr(10) || '<answer>' || solution || '</answer>'")


PARTS = r"with s as (select doc_id, regexp_extract_all(coalesce(text, ''), 'de |la|\.') as k, regexp_split_to_array(coalesce(text, ''), 'de |la|\.') as c from documents)"


@query(
    "X1_split_parts",
    PARTS + """, p as (select doc_id, list_concat(case when c[1] = '' then [] else ['=' || c[1]] end, [k[i] || '=' || c[i + 1] for i in range(1, len(k) + 1)]) as p from s)
    select doc_id, len(p)::bigint as parts, md5(coalesce(array_to_string(p, '|'), '')) as digest from p""",
)
def parts_of_texts(spark, sf_dir):
    """Whole texts at three literals."""
    rows = read(spark, sf_dir, "documents").select("doc_id", split_parts(t(), ["de ", "la", "."]).alias("p"))
    joined = F.array_join(F.transform("p", lambda p: F.concat(p["key"], F.lit("="), p["content"])), "|")
    return rows.select("doc_id", F.size("p").cast("long").alias("parts"), F.md5(joined).alias("digest"))


@query(
    "X2_loss_scale",
    PARTS + """ select doc_id, (length(c[1]) + coalesce(list_sum([case k[i] when 'de ' then 6 + 2 * length(c[i + 1]) when 'la' then 2 + 3 * length(c[i + 1]) else 0.5 end for i in range(1, len(k) + 1)]), 0))::double as total from s""",
)
def weighted_texts(spark, sf_dir):
    """Characters of whole texts by weight."""
    pieces = loss_scale(F.lit("q"), t(), {"de ": [2.0, 2.0], "la": [1.0, 3.0], ".": [0.5, 0.0]})
    total = F.aggregate(pieces, F.lit(0.0), lambda a, p: a + F.length(p["content"]) * p["weight"])
    return read(spark, sf_dir, "documents").select("doc_id", total.alias("total"))


@query(
    "R12_repetition_documents",
    """with w as (select doc_id, [w for w in regexp_split_to_array(lower(text), '\\s+') if w <> ''] as w from documents), g as (select doc_id, [array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)] as g from w)
    select doc_id, round(case when len(g) = 0 then 0.0 else (1 - len(list_distinct(g))::double / len(g)) * -1.0 end, 6) + 0.0 as value from g""",
)
def repetition_of_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", six(R.repetition(t())).alias("value"))


AGENT = {
    "react": ("Thought: {}\nAction: look\nAction Input: {}\nObservation: {}", "8 + n + 2 + 2 * (length('Action:') + 6 + length('Action Input:')) + 2 * (n + 2) + 2 * length('Observation:')"),
    "qwen": ("✿FUNCTION✿: look\n✿ARGS✿: {}\n✿RESULT✿: {}\n✿RETURN✿: {}", "2 * (length('✿FUNCTION✿:') + 6 + length('✿ARGS✿:') + n + 2 + length('✿RESULT✿:')) + length('✿RETURN✿:') + n + 1"),
    "hermes": ("{}<tool_call>\n{}\n</tool_call>{}", "2 * n + 2 * (n + 2 + length('<tool_call></tool_call>'))"),
    "agentflan": ("{}Command{}Observation:{}", "n + length('Command') + 3 * n + 2 * length('Observation:')"),
    "alpha_umi": ("{}Next: {}Observation:{}", "2 * n + length('Next: ') + 2 * length('Observation:')"),
    "ignore_empty_think": ("<think>\n\n</think>\n\n{}{}{}", "3 * n"),
    "last_round_with_ignore_empty_think": ("<think>\n\n</think>\n\n{}{}{}", "case when last then 3 * n else 0 end"),
    "last_round": ("{}{}{}", "case when last then 3 * n else 0 end"),
    "default": ("{}{}{}", "3 * n"),
}


@query(
    "X3_agent_strategies",
    f"with a as (select conv_id, turn, length(text) as n, turn = max(turn) over (partition by conv_id) as last from {COMPLETIONS}) select conv_id, turn, {', '.join(f'({e})::double as {k}' for k, (_, e) in AGENT.items())}, (3 * (3 * n + length('CommandObservation:')))::double as agentflan_by_query from a",
)
def agent_strategies(spark, sf_dir):
    """Characters by weight of whole texts in the forms of agents, under every named strategy."""
    rows = completions(spark, sf_dir)
    rows = rows.join(rows.groupBy("conv_id").agg(F.max("turn").alias("last")), "conv_id")

    def total(form: str, query: str = "q"):
        pieces = AGENT[form][0].split("{}")
        text = F.concat(F.lit(pieces[0]), *[x for p in pieces[1:] for x in (t(), F.lit(p))])
        return F.aggregate(strategy_scales(form, F.lit(query), text, F.col("turn") == F.col("last")), F.lit(0.0), lambda a, p: a + F.length(p["content"]) * p["weight"])

    return rows.select("conv_id", "turn", *[total(k).alias(k) for k in AGENT], total("agentflan", "What is the value of x?").alias("agentflan_by_query"))


@query("X3_loss_strategies", "select conv_id, turn, case when role = 'assistant' then 1.0::double else 0.0::double end as default_scale, case when role = 'assistant' and turn = (select max(turn) from conversations c where c.conv_id = t.conv_id and role = 'assistant') then 1.0::double else 0.0::double end as last_round, 1.0::double as all_scale from conversations t")
def loss_strategies(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return rows.join(rows.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last")), "conv_id", "left").select(
        "conv_id", "turn", message_scales("default", F.col("role"), F.col("turn"), F.col("last")).alias("default_scale"), message_scales("last_round", F.col("role"), F.col("turn"), F.col("last")).alias("last_round"), message_scales("all", F.col("role"), F.col("turn"), F.col("last")).alias("all_scale")
    )


@query("X7_self_cognition", "select doc_id, case when lang = 'en' then 'I am Mill by Race' else 'I am 磨 by 水' end as value from documents")
def self_cognition(spark, sf_dir):
    lang = F.when(F.col("lang") == "en", "en").otherwise("zh")
    return read(spark, sf_dir, "documents").select("doc_id", fill(F.lit("I am {{NAME}} by {{AUTHOR}}"), ("磨", "Mill"), ("水", "Race"), lang).alias("value"))


@query("E5_time_captions", f"select conv_id, turn, turn::double as start_s, turn + 1.5::double as end_s, text as caption, 1.5::double as duration from {COMPLETIONS}")
def time_captions(spark, sf_dir):
    rows = completions(spark, sf_dir).select("conv_id", "turn", F.explode(reshape.time_captions(F.col("completion"))).alias("p"))
    return rows.select("conv_id", "turn", F.col("p.start").alias("start_s"), F.col("p.end").alias("end_s"), "p.caption", (F.col("p.end") - F.col("p.start")).alias("duration"))


@query("E6_tool_calls", f"select conv_id, turn, 'look' as tool, '{{\"a\": ' || turn || '}}' as input from {COMPLETIONS}")
def tool_calls(spark, sf_dir):
    return completions(spark, sf_dir).select("conv_id", "turn", F.inline(reshape.react_calls(react())))


@query("D2_reward_registry", f"select count(*) as n, sum(case when substring({ANSWER}, 1, 1) = substring(solution, 1, 1) then 1.0 else 0.0 end)::double as total from {COMPLETIONS}")
def reward_registry(spark, sf_dir):
    return completions(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(R.REWARDS["mc_acc"](c(), s())).alias("total"))

