"""Parsers for semi-structured model output; plain functions, wrapped once as Arrow UDFs.

Each returns canonical JSON or null and never raises. Canonical JSON sorts keys,
trims strings and writes numbers so that 1, 1.0 and True are equal, as they are
for the scorer.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)
TAGS = re.compile(r"<(tool_call|answer|output)>(.*?)(?:</\1>|$)", re.DOTALL)
CALL = re.compile(r"^\s*(?:(\w+)\s*=\s*)?([A-Za-z_][\w.]*)\((.*)\)\s*$", re.DOTALL)


def normalise(value: object) -> object:
    """Strings trimmed, keys sorted, booleans and whole floats as integers; order of lists stays."""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, dict):
        return {str(k): normalise(value[k]) for k in sorted(value, key=str)}
    if isinstance(value, (list, tuple)):
        return [normalise(x) for x in value]
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def canonical(value: object) -> str:
    return json.dumps(normalise(value), ensure_ascii=False, separators=(",", ":"), default=str)


def _try(parse: Callable[[str], object], text: str) -> object | None:
    try:
        return parse(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


def first_object(text: str) -> dict | None:
    """The first object that decodes from any opening brace."""
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            if isinstance(value, dict):
                return value
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


def balanced_spans(text: str, closes: str = "}]") -> list[str]:
    """Outermost bracketed spans, aware of strings; a truncated last one is closed."""
    spans, stack, start, quote, skip = [], [], -1, "", False
    for i, ch in enumerate(text):
        if quote:
            if skip:
                skip = False
            elif ch == "\\":
                skip = True
            elif ch == quote:
                quote = ""
        elif ch == '"' and stack:
            quote = ch
        elif ch in "{[":
            if not stack:
                start = i
            stack.append("}" if ch == "{" else "]")
        elif stack and ch == stack[-1]:
            stack.pop()
            if not stack:
                spans.append(text[start : i + 1])
    if stack:
        spans.append(text[start:] + quote + "".join(reversed(stack)))
    return spans


def embedded(text: str | None) -> list[str]:
    """Every object embedded in a text, arrays flattened to their items, bad spans passed over."""
    out = []
    for span in balanced_spans(text or ""):
        value = jsonish(span)
        out += [canonical(x) for x in (value if isinstance(value, list) else [value]) if x is not None]
    return out


def fenced(text: str) -> object | None:
    m = FENCE.search(text)
    if m:
        return _try(json.loads, m[1])
    a, b = text.find("{"), text.rfind("}")
    return _try(json.loads, text[a : b + 1]) if 0 <= a < b else None


def jsonish(text: str | None) -> object | None:
    """Python literal, then JSON, then a fenced block, then outer braces."""
    if text is None or not text.strip():
        return None
    for parse in (ast.literal_eval, json.loads):
        value = _try(parse, text.strip())
        if value is not None:
            return value
    return fenced(text)


def decode_answer(text: str | None) -> object | None:
    """At most two passes over a literal that was encoded twice."""
    value = jsonish(text)
    return jsonish(value) if isinstance(value, str) else value


def quote_bare_keys(text: str) -> str:
    """Names before a colon get quotes, where they stand outside strings and open an item."""
    out, at, quote, opens = [], 0, "", False
    while at < len(text):
        ch = text[at]
        if quote:
            step = 2 if ch == "\\" else 1
            quote = "" if ch == quote else quote
            out.append(text[at : at + step])
            at += step
            continue
        name = re.compile(r"[A-Za-z_]\w*").match(text, at) if opens else None
        if name and text[name.end() :].lstrip().startswith(":"):
            out.append(f'"{name[0]}"')
            at, opens = name.end(), False
            continue
        quote = ch if ch in "\"'" else ""
        opens = ch in "{[," or (opens and ch.isspace())
        out.append(ch)
        at += 1
    return "".join(out)


def coerce(token: str) -> object:
    value = _try(ast.literal_eval, token)
    return {"true": True, "false": False, "null": None, "none": None}.get(token.lower(), token) if value is None else value


def split_arguments(text: str) -> list[str]:
    """Cut at commas outside brackets and quotes."""
    parts, depth, quote, now = [], 0, "", ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        if ch == "," and not depth and not quote:
            parts.append(now)
            now = ""
        else:
            now += ch
    return [p.strip() for p in [*parts, now] if p.strip()]


def assign(values: list[str], names: list[str]) -> dict:
    """Named pairs first, then positional leftovers in the order of the free names."""
    named = {m[1]: coerce(m[2].strip()) for v in values if (m := re.match(r"^(\w+)\s*[=:]\s*(.*)$", v, re.DOTALL))}
    rest = [v for v in values if not re.match(r"^(\w+)\s*[=:]", v)]
    free = [n for n in names if n not in named] or [f"arg{i}" for i in range(len(rest))]
    return named | {n: coerce(v) for n, v in zip(free, rest)}


def parse_call(line: str) -> dict | None:
    """``result1 = f(a=1, "x")`` as plan, arguments and the name it is bound to."""
    m = CALL.match(line)
    if not m:
        return None
    return {"result": m[1], "plan": m[2], "arguments": assign(split_arguments(m[3]), [])}


def parse_calls(text: str | None) -> list[str]:
    return [canonical(c) for line in (text or "").splitlines() if (c := parse_call(line))]


def normalise_plan(plan: str, candidates: list[str]) -> str:
    """Exact, then case-insensitive, then without an ``action_`` prefix, else unchanged."""
    low = {c.lower(): c for c in reversed(candidates)}
    bare = {c.lower().removeprefix("action_"): c for c in reversed(candidates)}
    return plan if plan in candidates else low.get(plan.lower()) or bare.get(plan.lower().removeprefix("action_")) or plan


def as_call(value: object) -> dict | None:
    if isinstance(value, dict) and ("plan" in value or "name" in value):
        return {"plan": value.get("plan", value.get("name")), "arguments": value.get("arguments", value.get("parameters", {}))}
    return None


def _keyed(text: str) -> dict | None:
    m = re.match(r"^\s*([A-Za-z_][\w.]*)\s*:\s*([{\[].*)$", text, re.DOTALL)
    if not m:
        return None
    value = jsonish(m[2]) if jsonish(m[2]) is not None else _try(json.loads, quote_bare_keys(m[2]))
    if isinstance(value, dict):
        return {"plan": m[1], "arguments": value}
    if m[2].startswith("["):
        return {"plan": m[1], "arguments": assign(split_arguments(m[2].strip()[1:-1]), [])}
    return None


def _yaml(text: str) -> dict | None:
    pairs = dict(m.groups() for m in re.finditer(r"^(\w+)\s*:\s*(.+?)\s*$", text, re.MULTILINE))
    if "plan" not in pairs:
        return None
    plan = pairs.pop("plan")
    given = jsonish(pairs.pop("arguments", None))
    return {"plan": plan, "arguments": given if isinstance(given, dict) else {k: coerce(v) for k, v in pairs.items()}}


def parse_generation(text: str | None) -> tuple[str | None, str]:
    """Canonical {plan, arguments} and the name of the first strategy that reads it."""
    raw = (text or "").strip()
    m = TAGS.search(raw)
    steps: list[tuple[str, Callable[[], object]]] = [
        ("tags", lambda: as_call(jsonish(m[2])) if m else None),
        ("literal", lambda: as_call(jsonish(raw))),
        ("markdown", lambda: as_call(fenced(raw))),
        ("call", lambda: as_call(parse_call(raw))),
        ("keyed", lambda: _keyed(raw)),
        ("yaml", lambda: _yaml(raw)),
        ("closed", lambda: next((c for s in balanced_spans(raw) if (c := as_call(jsonish(s) or _try(json.loads, quote_bare_keys(s))))), None)),
    ]
    for name, step in steps:
        found = step() if raw else None
        if found:
            return canonical(found), name
    return None, "none"


def parses(text: str | None) -> bool:
    """Whether any strategy reads a call."""
    return parse_generation(text)[0] is not None


# Names that a prediction's parts go by, and codes of what is wrong with it.
REWRITE_NAMES, CALL_NAMES = ("rewritten_query", "rewrited_query", "query"), ("name", "plan")
CONTRACTS: dict[str, list[tuple[str, Callable[[dict, bool], bool]]]] = {
    "rewrite": [
        ("missing_rewritten_query", lambda x, strict: not said(x, REWRITE_NAMES)),
        ("missing_confirmed_arguments", lambda x, strict: strict and x.get("confirmed_arguments") is None),
        ("confirmed_arguments_not_object", lambda x, strict: not isinstance(x.get("confirmed_arguments"), (dict, type(None)))),
    ],
    "call": [
        ("missing_name", lambda x, strict: not said(x, CALL_NAMES)),
        ("arguments_not_object", lambda x, strict: not isinstance(x.get("arguments", {}), dict)),
    ],
}


def said(value: dict, names: tuple[str, ...]) -> str | None:
    """The text under the first of the names that has anything; null if that is blank or no text."""
    found = next(filter(None, map(value.get, names)), None)
    return found if isinstance(found, str) and found.strip() else None


def model_output(text: str | None, mode: str, strict: bool = False) -> tuple[str, str | None]:
    """(error code or ok, canonical value) of a prediction, by the first rule of its contract that it breaks.

    A ``rewrite`` goes by any of three names, with confirmed arguments if there
    are any (and always if ``strict``); any other mode is a call.
    """
    value = first_object(text or "")
    if value is None:
        return "no_json_object_found", None
    contract = mode if mode in CONTRACTS else "call"
    broken = [code for code, rule in CONTRACTS[contract] if rule(value, strict)]
    if broken:
        return broken[0], None
    if contract == "call":
        return "ok", canonical({"name": said(value, CALL_NAMES), "arguments": value.get("arguments", {})})
    confirmed = value.get("confirmed_arguments")
    return "ok", canonical({"rewritten_query": said(value, REWRITE_NAMES)} | ({} if confirmed is None else {"confirmed_arguments": confirmed}))


def answer_plan(text: str | None) -> str:
    """The plan that an answer names, or a sentinel that says why there is none."""
    if text is None:
        return "MISSING_ANSWER"
    if not text.strip():
        return "EMPTY_ANSWER"
    try:
        value = ast.literal_eval(text.strip())
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return "INVALID_ANSWER"
    if not isinstance(value, dict):
        return "NON_DICT_ANSWER"
    return "MISSING_PLAN" if value.get("plan") is None else str(value["plan"]).strip() or "EMPTY_PLAN"


def history_items(text: str | None) -> list[tuple[int, str]]:
    """(turn id, text) of a history written as a literal list, as JSON or as plain text.

    The id is the number in the turn's label, else its place from 1.
    """
    raw = (text or "").strip()
    items: list = [raw] if raw else []
    for parse in (ast.literal_eval, json.loads):
        value = _try(parse, raw) if raw else None
        if value is not None:
            items = value if isinstance(value, list) else [value]
            break
    kept = [x for x in map(str, items) if x.strip()]
    labels = [re.search(r"\bturn\s+(\d+)\s*:", x, re.IGNORECASE) for x in kept]
    return [(int(m[1]) if m else i, x) for i, (m, x) in enumerate(zip(labels, kept), 1)]


def assign_list(values: list, names: list[str]) -> dict | None:
    """Arguments of a flat list in which a name may be followed by its value.

    What stands alone fills the names that are still free, in their order.
    Attachments are always a list.
    """
    named, alone, waiting = {}, [], None
    for x in values:
        if x in names:
            waiting = x
        elif waiting is not None:
            named[waiting], waiting = x, None
        else:
            alone.append(x)
    found = named | dict(zip((n for n in names if n not in named), alone))
    return {k: [v] if k == "attachments" and v is not None and not isinstance(v, list) else v for k, v in found.items()} or None


def without_required(tool: object) -> object:
    """A tool's schema without the list of required parameters, at any depth of nested parameters."""
    if isinstance(tool, list):
        return [without_required(x) for x in tool]
    if not isinstance(tool, dict):
        return tool
    return {k: without_required({n: x for n, x in v.items() if n != "required"} if k == "parameters" and isinstance(v, dict) else v) for k, v in tool.items()}


def argument_items(text: str | None) -> set[tuple[str, str]]:
    value = _try(json.loads, text) if text else None
    return {(str(k), canonical(v)) for k, v in value.items()} if isinstance(value, dict) else set()


def oneshot(value: object) -> dict | None:
    """The three keys of a one-shot payload; arguments have to be an object."""
    if not isinstance(value, dict) or not isinstance(value.get("arguments"), dict):
        return None
    return {k: value.get(k) for k in ("rewrited_query", "plan", "arguments")}


def _json(f: Callable[[str | None], object | None]):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if (v := f(x)) is None else canonical(v), na_action=None)

    return run


parse_literal = _json(decode_answer)
extract_markdown = _json(lambda x: fenced(x) if x else None)
extract_first = _json(lambda x: first_object(x) if x else None)
normalise_oneshot = _json(lambda x: oneshot(jsonish(x)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def extract_embedded(s: pd.Series) -> pd.Series:
    return s.map(embedded, na_action=None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def extract_calls(s: pd.Series) -> pd.Series:
    return s.map(parse_calls, na_action=None)


@F.pandas_udf(T.StructType([T.StructField("call", T.StringType()), T.StructField("parser", T.StringType())]))
def read_generation(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_generation(x) for x in s], columns=["call", "parser"], index=s.index)


plan_of_answer = F.pandas_udf(lambda s: s.map(answer_plan, na_action=None), T.StringType())


@F.pandas_udf(T.StructType([T.StructField("code", T.StringType()), T.StructField("value", T.StringType())]))
def check_output(text: pd.Series, mode: pd.Series, strict: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([model_output(*x) for x in zip(text, mode, strict)], columns=["code", "value"], index=text.index)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("turn_id", T.LongType()), T.StructField("text", T.StringType())])))
def parse_history(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [{"turn_id": i, "text": t} for i, t in history_items(x)], na_action=None)


@F.pandas_udf(T.StringType())
def assign_values(values: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([None if (v := assign_list(list(a), list(b))) is None else canonical(v) for a, b in zip(values, names)], dtype=object)


drop_required = _json(lambda x: without_required(json.loads(x)) if x else None)


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("gold", "pred", "matched")]))
def count_arguments(gold: pd.Series, pred: pd.Series) -> pd.DataFrame:
    sets = [(argument_items(a), argument_items(b)) for a, b in zip(gold, pred)]
    return pd.DataFrame([(len(a), len(b), len(a & b)) for a, b in sets], columns=["gold", "pred", "matched"], index=gold.index)
