"""Rule rewards as Column builders; a registry by name; and parsers of model judgements.

Rewards that need a model, a sandbox or symbolic algebra take its verdict as a
column: the shell here turns verdicts into scores.
"""

from __future__ import annotations

import ast
import json
import math
import operator
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import between, bound, clamp, count_of, found, ngrams, strip, tag, words

REWARDS: dict[str, Callable[..., Column]] = {}


def reward(name: str):
    """Register a builder; a plugin may add its own."""

    def add(build: Callable[..., Column]) -> Callable[..., Column]:
        if name in REWARDS:
            raise ValueError(f"reward {name} is registered already")
        REWARDS[name] = build
        return build

    return add


def score(condition: Column, value: float = 1.0) -> Column:
    """``value`` where the condition holds, else 0, also for null."""
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


@reward("mc_acc")
def choice_accuracy(completion: Column, solution: Column, letters: str = "A-Z") -> Column:
    """The answer tag's first letter equals the solution's."""
    answer = strip(tag(completion, "answer"))
    letter = F.substring(answer, 1, 1)
    return score(letter.rlike(f"^[{letters}]$") & (letter == F.substring(strip(solution), 1, 1)))


@reward("mc_acc_a_to_g")
def choice_accuracy_a_to_g(completion: Column, solution: Column) -> Column:
    return choice_accuracy(completion, solution, "A-G")


@reward("think_answer_format")
def think_answer_format(completion: Column) -> Column:
    return score(completion.rlike(r"(?sU)<thinking>.*?</thinking>\s*<answer>.*?</answer>"))


TIME_CAPTION = r"(?s)<time>(.*?)</time>(?U:\s*)<caption>(.*?)</caption>"


@reward("tcta_format")
def time_caption_format(completion: Column) -> Column:
    """Times and captions all come in pairs, at least one, with a thought and an answer."""
    pairs = F.regexp_count(completion, F.lit(TIME_CAPTION))
    times = F.regexp_count(completion, F.lit(r"(?s)<time>.*?</time>"))
    captions = F.regexp_count(completion, F.lit(r"(?s)<caption>.*?</caption>"))
    whole = completion.rlike(r"(?s)<thinking>.*?</thinking>") & completion.rlike(r"(?s)<answer>.*?</answer>")
    return score((pairs >= 1) & (pairs == times) & (pairs == captions) & whole)


@reward("modality_attention")
def modality_attention(original: Column, no_video: Column, no_audio: Column, solution: Column) -> Column:
    """0.3 where the full input does at least as well as either ablation; 0 without ablations."""
    full, video, audio = (choice_accuracy(c, solution) for c in (original, no_video, no_audio))
    return score(no_video.isNotNull() & no_audio.isNotNull() & (full >= video) & (full >= audio), 0.3)


@reward("external_r1v_acc")
def answer_text_accuracy(completion: Column, solution: Column, verified: Column | None = None) -> Column:
    """A symbolic verdict if given, or the answer texts are equal."""
    truth = strip(F.coalesce(tag(solution, "answer", dotall=False), solution))
    given = strip(F.coalesce(tag(completion, "answer", dotall=False), completion))
    same = given == truth
    return score(same if verified is None else F.coalesce(verified, F.lit(False)) | same)


def judge_score(text: Column) -> Column:
    """A judge's ``score: x``, else its first number, from 0 to 1; 0 where there is none."""
    number = r"([0-9]*\.?[0-9]+)"
    stated = F.coalesce(found(F.lower(text), r"score\s*[:=]?\s*" + number), found(text, number))
    return clamp(F.coalesce(stated.try_cast("double"), F.lit(0.0)))


@reward("soft_mc_acc")
def soft_choice_accuracy(judgement: Column) -> Column:
    return judge_score(judgement)


def judge_json(text: Column) -> Column:
    """JSON with a score (fenced, whole or embedded), a bare number, a first number, or 0; from 0 to 1."""
    plain = strip(F.regexp_replace(text, r"```(?:json)?", ""))
    score_of = lambda c: F.try_variant_get(F.try_parse_json(c), "$.score", "double")
    embedded = F.regexp_extract(plain, r'(?s)\{[^{}]*"score"[^{}]*\}', 0)
    first = F.regexp_extract(plain, r"[0-9]*\.?[0-9]+", 0)
    value = F.coalesce(score_of(plain), score_of(embedded), plain.try_cast("double"), first.try_cast("double"), F.lit(0.0))
    return clamp(value)


@reward("query_intent")
def query_intent(caption_scores: Column, relevance: Column) -> Column:
    """Mean of the mean caption score and the relevance; judges give both."""
    mean = F.aggregate(caption_scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(caption_scores), F.lit(0))
    return (F.coalesce(mean, F.lit(0.0)) + F.coalesce(relevance, F.lit(0.0))) / 2


@reward("format")
def think_then_answer(completion: Column) -> Column:
    return score(completion.rlike(r"(?sU)\A<think>.*?</think>\s*<answer>.*?</answer>\z"))


@reward("react_format")
def react_format(completion: Column) -> Column:
    return score(completion.rlike(r"(?msd)\A<think>.*?</think>(?U:\s*)Action:.*?Action Input:.*?$"))


@reward("repetition")
def repetition(completion: Column, n: int = 3, worst: float = -1.0) -> Column:
    def share(grams: Column) -> Column:
        return F.when(F.size(grams) > 0, (1 - F.size(F.array_distinct(grams)) / F.size(grams)) * F.lit(worst)).otherwise(F.lit(0.0)) + 0.0

    return bound(ngrams(completion, n), share)


@reward("soft_overlong")
def soft_overlong(length: Column, longest: int, cache: int) -> Column:
    if cache >= longest:
        raise ValueError("the cache must be shorter than the longest length")
    return F.least(-(length - F.lit(longest - cache)) / F.lit(float(cache)), F.lit(0.0))


@reward("cosine")
def cosine_length(length: Column, accuracy: Column, longest: int = 1000, wrong: tuple = (-0.5, 0.0), right: tuple = (1.0, 0.5)) -> Column:
    """Half a cosine from the value of short answers to that of long ones; ``wrong`` and ``right`` are (short, long)."""

    def curve(short: float, long_: float) -> Column:
        return F.lit(short) - F.lit(short - long_) * (1 - F.cos(length * math.pi / longest)) / 2

    return F.when(accuracy >= 1, curve(*right)).otherwise(curve(*wrong))


def react_action(text: Column) -> tuple[Column, Column]:
    """(action, input) of the last call; ``none`` and ``{}`` where there is none."""
    given = F.when(F.contains(text, F.lit("Action Input:")), strip(F.substring_index(text, "Action Input:", -1))).otherwise(F.lit("{}"))
    last = F.substring_index(text, "Action:", -1)
    action = strip(F.substring_index(strip(last), "Action Input:", 1))
    return F.when(F.contains(text, F.lit("Action:")), action).otherwise(F.lit("none")), given


def _call_f1(want: str | None, have: str | None) -> float:
    def load(text):
        try:
            return True, json.loads(text)
        except (TypeError, ValueError):
            return False, text

    (want_json, w), (have_json, h) = load(want), load(have)
    if not (want_json and have_json):
        return 0.0  # free text never reaches the threshold
    if not isinstance(w, dict) or not isinstance(h, dict):
        return 0.0
    if not w:
        return float(not h)
    hits = sum((1.0 if h[k] == v else 0.5) for k, v in w.items() if k in h)
    return 2 * hits / (len(w) + len(h))


@reward("toolbench")
def toolbench(completion: Column, solution: Column) -> Column:
    """1 where the last action and all arguments agree."""

    @F.pandas_udf("double")
    def f1(want: pd.Series, have: pd.Series) -> pd.Series:
        return pd.Series([_call_f1(w, h) for w, h in zip(want, have)], dtype=float)

    (action, given), (true_action, wanted) = react_action(completion), react_action(solution)
    return score((action == true_action) & (f1(wanted, given) == 1.0))


def boxed(text: Column, last: bool = True) -> Column:
    """Content of a ``\\boxed{}``, one level of braces deep."""
    all_ = F.regexp_extract_all(text, F.lit(r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"), F.lit(1))
    return F.try_element_at(all_, F.lit(-1 if last else 1))


@reward("math")
def math_text(completion: Column, truth: Column, verified: Column | None = None) -> Column:
    """The boxed texts are equal without blanks, or a symbolic verdict says so."""
    tidy = lambda c: F.regexp_replace(c, r"(?U)\s|\\[,;! ]|\$", "")
    given = F.coalesce(boxed(completion), F.element_at(F.split(completion, "# Answer"), -1))
    same = tidy(given) == tidy(F.coalesce(boxed(truth), truth))
    return score(same if verified is None else F.coalesce(verified, F.lit(False)) | same)


@reward("accuracy")
def math_accuracy(completion: Column, solution: Column, verified: Column | None = None) -> Column:
    """Answer tag or boxed text against the solution's; an empty solution gives 0."""
    truth = strip(F.coalesce(tag(solution, "answer"), boxed(solution), solution))
    given = strip(F.coalesce(tag(completion, "answer"), boxed(completion)))
    same = given == truth
    return score((truth != "") & (same if verified is None else F.coalesce(verified, F.lit(False)) | same))


_ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos}


def evaluate(expression: str) -> float:
    """Value of an arithmetic expression; only numbers, signs, the four operations and brackets."""

    def value(node):
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.UnaryOp) and type(node.op) in _ARITHMETIC:
            return _ARITHMETIC[type(node.op)](value(node.operand))
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            return _ARITHMETIC[type(node.op)](value(node.left), value(node.right))
        raise ValueError("not arithmetic")

    return value(ast.parse(expression.strip(), mode="eval").body)


def _countdown(text: str | None, target: float, numbers) -> float:
    import re

    try:
        m = re.search(r"<answer>(.*?)</answer>", text or "")
        equation = m[1].strip().split("=")[0]
        if sorted(map(int, re.findall(r"\d+", equation))) != sorted(map(int, numbers)) or not re.fullmatch(r"[\d+\-*/().\s]+", equation):
            return 0.0
        return float(abs(evaluate(equation) - float(target)) < 1e-5)
    except (TypeError, ValueError, SyntaxError, ZeroDivisionError, RecursionError, OverflowError, MemoryError):
        return 0.0


@reward("countdown")
def countdown(completion: Column, target: Column, numbers: Column) -> Column:
    """The answer uses exactly the numbers and comes to the target."""

    @F.pandas_udf("double")
    def judge(text: pd.Series, goal: pd.Series, nums: pd.Series) -> pd.Series:
        return pd.Series([_countdown(*r) for r in zip(text, goal, nums)], dtype=float)

    return judge(completion, target.cast("double"), numbers)


def calculator_text(expression: str | None) -> str:
    """A tool's answer: the value, or an error in words."""
    import re

    text = (expression or "").strip()
    if not text or not re.fullmatch(r"[0-9+\-*/().\s]+", text):
        return "Error: invalid characters in expression"
    if text.count("(") != text.count(")"):
        return "Error: mismatched parentheses"
    try:
        return str(evaluate(text))
    except ZeroDivisionError:
        return "Error: division by zero"
    except (ValueError, SyntaxError, RecursionError, OverflowError):
        return "Error: invalid expression"


def calculator(expression: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(calculator_text)

    return run(expression)


@reward("thinking_tips")
def thinking_tips(last_turn_accuracy: Column) -> Column:
    return F.coalesce(last_turn_accuracy.cast("double"), F.lit(0.0))


def last_code_block(completion: Column, language: str = "python") -> Column:
    """The last fenced block of a language; empty where there is none."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(completion, F.lit(rf"(?s)```{language}\n(.*?)```"), F.lit(1)), F.lit(-1)), F.lit(""))


@reward("code_reward")
def code_reward(passed: Column, total: Column) -> Column:
    """Share of test cases a sandbox says have passed."""
    return F.coalesce(F.try_divide(passed.cast("double"), total), F.lit(0.0))


@reward("code_format")
def code_format(completion: Column, language: Column) -> Column:
    pattern = F.concat(F.lit(r"(?s)\A<think>.*?</think>(?U:\s*)<answer>.*?```\Q"), language, F.lit(r"\E.*?```.*?</answer>(?![\s\S])"))
    return score(F.regexp_like(completion, pattern))


@reward("tooluse_format")
def tool_format(completion: Column, solution: Column, best: float = 1.0, worst: float = 0.0) -> Column:
    """The solution's tags say which of four shapes is due, each tag once."""
    shape = lambda *tags: r"(?s)\A<think>.*?</think>" + "".join(rf"(?U:\s*)<{t}>.*?</{t}>" for t in tags) + r"\n?\z"
    once = lambda t: (count_of(completion, f"<{t}>") == 1) & (count_of(completion, f"</{t}>") == 1)
    says, calls = F.contains(solution, F.lit("<response>")), F.contains(solution, F.lit("<tool_call>"))
    ok = (
        F.when(says & ~calls, completion.rlike(shape("response")) & once("response"))
        .when(~says & calls, completion.rlike(shape("tool_call")) & once("tool_call"))
        .when(says & calls, completion.rlike(shape("tool_call", "response")) & once("tool_call") & once("response"))
        .otherwise(completion.rlike(shape()))
    )
    return F.when(ok, F.lit(best)).otherwise(F.lit(worst))


def scheduled_bounds(step: int, best: float = 1.0, worst: float = 0.0, two_stage: bool = False, schedule: bool = False) -> tuple[float, float]:
    """Bounds of the format reward at a training step."""
    if two_stage and step >= 30:
        best, worst = best / 2, worst / 2
    if schedule:
        best, worst = max(2 - (2 - best) * step / 150, 1.0), min(-2 + (2 + worst) * step / 150, -1.0)
    return best, worst


@reward("tooluse_length")
def tool_length(completion: Column, longest: float = 512.0) -> Column:
    """Words of the last thought against a length, rounded half to even, at most 1."""
    thought = strip(between(completion, "<think>", "</think>"))
    has = F.contains(completion, F.lit("<think>")) & F.contains(completion, F.lit("</think>"))
    return F.when(has, F.least(F.bround(F.size(words(thought)) / longest, 2), F.lit(1.0))).otherwise(F.lit(0.0))


def multiset_similarity(a: list, b: list, strict: bool = False) -> float:
    """Jaccard similarity of multisets; equal lists are 1, and with ``strict`` all others 0."""
    if a == b:
        return 1.0
    if not a or not b or strict:
        return 0.0
    common = sum((Counter(a) & Counter(b)).values())
    return common / (len(a) + len(b) - common)


TOOL_DETAILS = ("full", "refined", "intermediate", "coarse")


def tool_calls_score(want: list[dict], have: list[dict], best: float = 3.0, worst: float = -3.0, detail: str = "full") -> float:
    """Names as multisets, then for each wanted call the best unused call of its name by argument names and values.

    ``refined`` takes names that are not all equal for nothing; ``intermediate``
    counts whole calls in place of their arguments; ``coarse`` knows right and wrong.
    """
    if want == have:
        return best
    if detail == "coarse":
        return worst
    strict, whole = detail == "refined", detail == "intermediate"
    total, reach, unused = multiset_similarity([c["name"] for c in want], [c["name"] for c in have], strict), 1.0, list(range(len(have)))

    def rating(call: dict, other: dict) -> float:
        if whole:
            return float(call == other)
        args, given = call["parameters"], other["parameters"]
        return multiset_similarity(list(args), list(given), strict) + sum(1.0 for k, v in args.items() if k in given and given[k] == v)

    for call in want:
        reach += 1.0 + (0 if whole else len(call["parameters"]))
        top, at = max([(rating(call, have[i]), -i) for i in unused if have[i]["name"] == call["name"]], default=(0.0, 0))
        if top > 0:
            unused.remove(-at)
            total += top
    return (best - worst) * total / reach + worst


def tool_range(step: int, best: float = 3.0, worst: float = -3.0, schedule: str | None = None) -> tuple[float, float]:
    """(best, worst) at a training step: a third of them before step 30 (``two_stage``), or growing from 2 with the step (``linear``), at most 3."""
    if schedule == "two_stage":
        return (best / 3, worst / 3) if step < 30 else (best, worst)
    if schedule == "linear":
        return min((best - 2) * step / 150 + 2, 3.0), max((worst + 2) * step / 150 - 2, -3.0)
    return best, worst


def _tools(text: str) -> list[dict]:
    return [json.loads(line) for line in text.split("<tool_call>")[1].split("</tool_call>")[0].strip().split("\n")]


def _tool_reward(completion: str | None, solution: str | None, best: float, worst: float, detail: str = "full") -> float:
    if "<tool_call>" not in (solution or ""):
        return 0.0
    want = _tools(solution)
    try:
        if "</tool_call>" not in completion:
            return worst
        return tool_calls_score(want, _tools(completion), best, worst, detail)
    except (ValueError, IndexError, TypeError):
        return worst


@reward("tooluse_correctness")
def tool_correctness(completion: Column, solution: Column, best: float = 3.0, worst: float = -3.0, detail: str = "full") -> Column:
    if detail not in TOOL_DETAILS:
        raise ValueError(f"unknown detail {detail}")

    @F.pandas_udf("double")
    def judge(given: pd.Series, truth: pd.Series) -> pd.Series:
        return pd.Series([_tool_reward(g, t, best, worst, detail) for g, t in zip(given, truth)], dtype=float)

    return judge(completion, solution)


@reward("judge_yes_no")
def judge_yes_no(text: Column) -> Column:
    return score(F.contains(F.upper(text), F.lit("[YES]")))


@reward("deepeyes")
def deepeyes(completion: Column, verdict: Column, n_images: Column) -> Column:
    """0.8 accuracy + 0.2 format + 1.2 tool use, given a judge's 0/1 verdict."""
    uneven = lambda c, t: count_of(c, f"<{t}>") != count_of(c, f"</{t}>")
    after = strip(F.element_at(F.split(completion, "</think>"), -1))
    long_ = F.length(strip(between(completion, "<answer>", "</answer>"))) >= 1000
    broken = uneven(completion, "think") | uneven(completion, "tool_call") | uneven(after, "answer") | long_
    accuracy = F.when(long_, F.lit(0.0)).otherwise(F.coalesce(verdict.cast("double"), F.lit(0.0)))
    tool = score((n_images > 1) & (accuracy > 0.5))
    return 0.8 * accuracy + F.when(broken, F.lit(-0.2)).otherwise(F.lit(0.0)) + 1.2 * tool


def last_answer(text: Column, name: str = "answer") -> Column:
    """Content of the last element of a name, null where there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(f"(?s)<{name}>(.*?)</{name}>"), F.lit(1)), F.lit(-1))
