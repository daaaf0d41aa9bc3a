"""Text forms of tool calls and their results, by agent format."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.parts import split_parts
from millrace.functions.text import bound, strip


@dataclass(frozen=True)
class Form:
    """Pieces of a format. ``{name}``, ``{arguments}`` (JSON), ``{result}``, ``{key}`` and ``{value}`` are filled in.

    With ``argument`` every argument has a text of its own, which ``call`` has in place of ``{arguments}``.
    """

    call: str
    between_calls: str = ""
    calls: str = "{all}"
    argument: str | None = None
    result: str = "{result}"
    between_results: str = ""
    results: str = "{all}"
    escape_result: bool = False  # results are JSON strings


#: What the formats look like.
REACT = Form("Action: {name}\nAction Input: {arguments}\n", calls="{all}Observation:", result="{result}\n", between_results="Observation:")
QWEN = Form("✿FUNCTION✿: {name}\n✿ARGS✿: {arguments}\n", calls="{all}✿RESULT✿:", result="{result}\n", between_results="✿RESULT✿:")
HERMES = Form('<tool_call>\n{"name": "{name}", "arguments": {arguments}}\n</tool_call>', "\n", result="<tool_response>\n{result}\n</tool_response>", between_results="\n")
LLAMA = Form('{"name": "{name}", "parameters": {arguments}}', "\n")
FORMS: dict[str, Form] = {
    "react_en": REACT,
    "react_zh": REACT,
    "react_grpo": REACT,
    "toolbench": REACT,
    "qwen_en": QWEN,
    "qwen_zh": QWEN,
    "qwen_en_parallel": QWEN,
    "qwen_zh_parallel": QWEN,
    "qwen3_coder": Form(
        "<tool_call>\n<function={name}>\n{arguments}</function>\n</tool_call>", "\n", argument="<parameter={key}>\n{value}\n</parameter>\n", result="<tool_response>\n{result}\n</tool_response>\n"
    ),
    "hermes": HERMES,
    "hunyuan_hermes": Form(HERMES.call, "\n", "<tool_calls>\n{all}\n</tool_calls>", result="<tool_response>{result}</tool_response>", between_results="\n", results="<tool_responses>{all}</tool_responses>"),
    "glm4": Form("{name}\n{arguments}", "<|assistant|>", "{all}<|observation|>"),
    "glm4_5": Form("<tool_call>{name}\n{arguments}</tool_call>", "\n", "{all}<|observation|>", argument="<arg_key>{key}</arg_key>\n<arg_value>{value}</arg_value>\n"),
    "llama3": LLAMA,
    "llama4": LLAMA,
    "deepseek_v3_1": Form(
        "<｜tool▁call▁begin｜>{name}<｜tool▁sep｜>{arguments}<｜tool▁call▁end｜>", calls="<｜tool▁calls▁begin｜>{all}<｜tool▁calls▁end｜>", result="<｜tool▁output▁begin｜>{result}<｜tool▁output▁end｜>", results="<｜end▁of▁sentence｜>{all}"
    ),
    "seed_oss": Form(
        "<seed:tool_call>\n<function={name}>\n{arguments}</function>\n</seed:tool_call>", "\n", argument="<parameter={key}>{value}</parameter>\n",
        result="<seed:bos>tool\n{result}<seed:eos>", results="<seed:eos>{all}<seed:bos>assistant\n",
    ),
    "mistral": Form('{"name": "{name}", "arguments": {arguments}}', "\n", "[TOOL_CALLS][\n{all}\n]</s>", result='[TOOL_RESULTS]{"content": {result}}[/TOOL_RESULTS]', between_results="\n", escape_result=True),
}


def _filled(template: str, **values: Column) -> Column:
    """The template with its places filled; other braces are text."""
    parts, rest = [], template
    while True:
        places = [(rest.index(f"{{{n}}}"), n) for n in values if f"{{{n}}}" in rest]
        if not places:
            return F.concat(*parts, F.lit(rest))
        at, name = min(places)
        parts += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2 :]


def form_of(name: str) -> Form:
    if name not in FORMS:
        raise ValueError(f"unknown agent format {name}")
    return FORMS[name]


def tool_calls_text(calls: Column, form: str) -> Column:
    """An array of (name, arguments) calls, whose arguments are JSON objects, as an assistant writes them."""
    f = form_of(form)

    def one(call: Column) -> Column:
        arguments = call["arguments"]
        if f.argument:
            pairs = F.map_entries(F.coalesce(F.from_json(arguments, "map<string,string>"), F.create_map().cast("map<string,string>")))
            arguments = F.array_join(F.transform(pairs, lambda e: _filled(f.argument, key=e["key"], value=F.coalesce(e["value"], F.lit("null")))), "")
        return _filled(f.call, name=call["name"], arguments=arguments)

    return _filled(f.calls, all=F.array_join(F.transform(calls, one), f.between_calls))


def tool_results_text(results: Column, form: str) -> Column:
    """An array of results as the model reads them; where the format ends lines, a result that ends with one gets no other."""
    f = form_of(form)

    def one(result: Column) -> Column:
        if f.result == "{result}\n":
            return F.when(F.endswith(result, F.lit("\n")), result).otherwise(F.concat(result, F.lit("\n")))
        if f.escape_result:
            result = F.regexp_extract(F.to_json(F.struct(result.alias("r"))), r'(?s)^\{"r":(.*)\}$', 1)
        return _filled(f.result, result=result)

    return bound(results, lambda r: _filled(f.results, all=F.array_join(F.transform(r, one), f.between_results)))


def tool_call_text(name: Column, arguments: Column, form: str = "react_en") -> Column:
    """One call, without what follows all calls."""
    return _filled(form_of({"react": "react_en"}.get(form, form)).call, name=name, arguments=arguments)


def tool_result_text(result: Column, form: str = "react_en") -> Column:
    """One result; react has its keyword in front."""
    form = {"react": "react_en"}.get(form, form)
    text = tool_results_text(F.array(result), form)
    return F.concat(F.lit("Observation:"), text) if form_of(form) is REACT else text


# --- reading ---------------------------------------------------------------


@dataclass(frozen=True)
class Scan:
    """How calls are found in a text: ``block`` has a part with one call in its group.

    A block is a JSON object with a name and ``arguments`` under the key given
    (kind ``object``), two groups, name and JSON (``pair``), or a name and fields,
    a group for each key and value (``fields``). ``within`` narrows the text first.
    """

    kind: str
    block: str
    arguments: str = "arguments"
    name: str = ""
    field: str = ""
    within: str | None = None


#: Marks of the formats, as patterns. Keywords stand for Action, Action Input and Observation.
KEYWORDS = {"react": ("Action:", "Action Input:", "Observation:"), "qwen": ("✿FUNCTION✿:", "✿ARGS✿:", "✿RESULT✿:")}
HERMES_SCAN = Scan("object", r"(?s)<tool_call>(.+?)</tool_call>")
LLAMA_SCAN = Scan("object", r'(?s)(\{[^{]*?"name":.*?"parameters":\s*?\{.*?\}\s*?\})', "parameters")
PARAMETER = r"(?s)<parameter=([^>]+)>\n?(.*?)\n?</parameter>"
SCANS: dict[str, list[Scan]] = {
    "hermes": [HERMES_SCAN],
    "hunyuan_hermes": [Scan("pair", r"(?s)<tool_call>(.+?)\n```json(.+?)```</tool_call>"), HERMES_SCAN],
    "qwen3_coder": [Scan("fields", r"(?s)<tool_call>(.*?)</tool_call>", name=r"<function=([^>]+)>", field=PARAMETER)],
    "seed_oss": [Scan("fields", r"(?s)<seed:tool_call>(.+?)</seed:tool_call>", name=r"<function=([^>]+)>", field=PARAMETER)],
    "glm4": [Scan("pair", r"(?s)(?:\A|<\|assistant\|>)\s*([^\n{]+)\n\s*(\{.*?)\s*(?=<\|assistant\|>|<\|observation\|>|\z)")],
    "glm4_5": [Scan("fields", r"(?s)<tool_call>(.*?)</tool_call>", name=r"(?s)\A\s*([^\n<]+)", field=r"(?s)<arg_key>(.*?)</arg_key>\s*<arg_value>(.*?)</arg_value>")],
    "llama3": [LLAMA_SCAN],
    "llama4": [LLAMA_SCAN],
    "deepseek_v3_1": [Scan("pair", r"(?s)<｜tool▁call▁begin｜>(.*?)<｜tool▁sep｜>(.*?)<｜tool▁call▁end｜>")],
    "mistral": [Scan("object", r"(?m)^\s*(\{.*\}),?\s*$", within=r"(?s)\[TOOL_CALLS\]\[(.*?)\]</s>")],
}


def _call(name: Column, arguments: Column) -> Column:
    return F.struct(name.alias("name"), arguments.alias("arguments"))


def _json_or_text(text: Column) -> Column:
    """JSON as it is, other text as a string."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


def _scanned(text: Column, scan: Scan) -> Column:
    if scan.within:
        text = F.regexp_extract(text, scan.within, 1)
    group = lambda t, pattern, g: F.regexp_extract_all(t, F.lit(pattern), F.lit(g))
    if scan.kind == "pair":
        pairs = F.arrays_zip(group(text, scan.block, 1).alias("n"), group(text, scan.block, 2).alias("a"))
        found = F.transform(pairs, lambda p: _call(strip(p["n"]), F.try_parse_json(strip(p["a"]))))
    elif scan.kind == "object":
        objects = F.transform(group(text, scan.block, 1), lambda b: F.try_parse_json(strip(b)))
        found = F.transform(objects, lambda v: _call(F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, f"$.{scan.arguments}", "variant")))
    else:

        def fields(block: Column) -> Column:
            entries = F.arrays_zip(group(block, scan.field, 1).alias("key"), group(block, scan.field, 2).alias("value"))
            last = F.map_from_entries(F.transform(entries, lambda e: F.struct(strip(e["key"]), _json_or_text(e["value"]))))
            return _call(F.nullif(strip(F.regexp_extract(block, scan.name, 1)), F.lit("")), F.to_variant_object(last))

        found = F.transform(group(text, scan.block, 1), fields)
    return F.filter(found, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


def _by_keywords(text: Column, keywords: tuple[str, str, str]) -> Column:
    """Calls written as an action and its input, each after its keyword."""

    def calls(parts: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0))), lambda i: (F.get(parts, i)["key"] == keywords[0]) & (F.get(parts, i + 1)["key"] == keywords[1]))
        return F.transform(at, lambda i: _call(strip(F.get(parts, i)["content"]), _json_or_text(strip(F.get(parts, i + 1)["content"]))))

    return bound(split_parts(text, [keywords[1], keywords[0], keywords[2]]), calls)


def read_calls(text: Column, form: str) -> Column:
    """The calls in a model's text, array<struct<name, arguments: variant>>; a text without any in its form is read as ReAct.

    Calls whose JSON is broken or has no name or arguments are none; values of
    fields that are no JSON are strings; null and empty texts have no call.
    """
    form_of(form)
    text = F.coalesce(text, F.lit(""))
    tries = [_scanned(text, s) for s in SCANS.get(form, [])]
    if form.startswith("qwen_"):
        tries.append(_by_keywords(text, KEYWORDS["qwen"]))
    out = _by_keywords(text, KEYWORDS["react"])
    for found in reversed(tries):
        out = _or_else(found, out)
    return out


def _or_else(found: Column, rest: Column) -> Column:
    return bound(found, lambda f: F.when(F.size(f) > 0, f).otherwise(rest))
