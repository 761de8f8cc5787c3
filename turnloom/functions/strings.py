"""String predicates, extractors and clock arithmetic in built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of phone numbers, addresses of people and pages; of a street address its kind is taken.
PHONE = r"\b\d{2,3}-\d{3,4}-\d{4}\b"
EMAIL = r"[\w\.-]+@[\w\.-]+\.\w+"
URI = r"https?://\S+"
STREET = r"(?i)\d{1,5}\s+[A-Za-z0-9.\s]+\s+(Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Drive|Dr)\b"
KINDS = {"image": ("png", "jpg", "jpeg", "gif", "webp"), "pdf": ("pdf",), "text": ("txt", "md", "doc", "docx"), "sheet": ("csv", "tsv", "xls", "xlsx"), "slides": ("ppt", "pptx"), "code": ("py", "js", "java", "html", "json")}


def normalise_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cut_at_markers(text: Column, markers: Sequence[str]) -> Column:
    """Up to the first of any stop marker, trimmed; unchanged without markers."""
    if not markers:
        return text
    places = [F.nullif(F.locate(m, text), F.lit(0)) for m in markers]
    first = F.least(*places) if len(places) > 1 else places[0]
    return F.trim(F.when(first.isNull(), text).otherwise(F.substring(text, F.lit(1), first - 1)))


def within_edits(a: Column, b: Column, most: int = 3) -> Column:
    return F.levenshtein(a, b, most) >= 0


def entities(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern if pattern == STREET else f"({pattern})"), F.lit(1)))


# Signs of broken JSON and the classes that they tell.
SPLIT_OBJECTS, NUMBER_QUOTE, WORD_QUOTE = r"\}\s*,\s*\{", r'"[A-Za-z0-9_]+"\s*:\s*-?\d+"', r'"[A-Za-z0-9_]+"\s*:\s*(true|false|null)"'
ERRORS = ("empty_raw", "two_json_objects_newline", "two_objects_comma_split", "truncated_missing_%d_brace", "extra_%d_closing_brace", "number_then_stray_quote", "bool_or_null_then_stray_quote", "other_malformed_json")


def raw_error(raw: Column) -> Column:
    """What keeps a model's output from being one JSON object, by the first rule that holds."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")
    missing = F.length(F.regexp_replace(text, r"[^{]", "")) - F.length(F.regexp_replace(text, r"[^}]", ""))
    signs = [text == "", text.contains("\n{"), text.rlike(SPLIT_OBJECTS), missing > 0, missing < 0, text.rlike(NUMBER_QUOTE), text.rlike(WORD_QUOTE)]
    told = [F.format_string(name, F.abs(missing)) if "%d" in name else F.lit(name) for name in ERRORS]
    return F.coalesce(*(F.when(sign, name) for sign, name in zip(signs, told)), told[-1])


# How an alarm is written, between quotation marks and without them, and its label and time if it has none.
QUOTED_ALARM, PLAIN_ALARM = r"'(alarm_id:\s*\d+\s*-\s*[^']+)'", r"(alarm_id:\s*\d+\s*-\s*[^.,]+(?:,[^.,]+)?)"
NO_LABEL, NO_TIME = "Updated Alarm", "that time"


def alarm_descriptor(text: Column) -> Column:
    """'alarm_id: N - time, label' as a text quotes it, or up to the second comma or a full stop; else empty."""
    quoted = F.regexp_extract(text, QUOTED_ALARM, 1)
    return F.when(quoted != "", quoted).otherwise(F.trim(F.regexp_extract(text, PLAIN_ALARM, 1)))


def alarm_label(descriptor: Column) -> Column:
    parts = F.split(descriptor, ",")
    return F.when(F.size(parts) > 1, F.btrim(F.trim(F.get(parts, 1)), F.lit("'"))).otherwise(NO_LABEL)


def alarm_time(descriptor: Column) -> Column:
    found = F.trim(F.regexp_extract(descriptor, r"-\s*([^,]+)", 1))
    return F.when(found != "", found).otherwise(NO_TIME)


#: What names a running time in a list of timers, with the words that tie it to a label, and what opens a label.
MINUTES = r"(?i)(\d+)\s*min(?:ute)?s?\b"
TIED_MINUTES = r"(?i)(?:\b(?:with|at)\b|-)?\s*\d+\s*min(?:ute)?s?\b(?:\s*(?:remaining|to go|left))?(?:\s*(?:-|\bon\b|\bfor\b))?"
LABEL_OPENING = r"(?i)^\s*(?:\d+\)\s*)?(?:(?:the|your)\s+)?"


def timer_items(turn: Column) -> Column:
    """(minutes, label) of each timer that the assistant's part of a turn lists, each once.

    The list is cut at commas, stops, colons and at an ``and`` before another time;
    a label is what a piece holds besides its time. Pieces without either are
    passed over, and labels that differ in case only are the same.
    """
    spoken = F.element_at(F.split(F.coalesce(turn, F.lit("")), "->", 2), -1)
    plain = F.translate(F.regexp_replace(spoken, "[\u2013\u2014]", "-"), "[]", "")
    pieces = F.split(F.element_at(F.split(plain, ":", 2), -1), r"[,.;:]|\s+and\s+(?=[^,.;:]*\d+\s*min)")
    timed = F.filter(pieces, lambda x: x.rlike(MINUTES))
    label = lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, TIED_MINUTES, " ")), LABEL_OPENING, ""))
    found = F.transform(timed, lambda x: F.struct(F.regexp_extract(x, MINUTES, 1).try_cast("long").alias("minutes"), label(x).alias("label")))
    named = F.filter(found, lambda x: x["label"] != "")
    same = lambda x, y: (x["minutes"] == y["minutes"]) & (F.lower(x["label"]) == F.lower(y["label"]))
    return F.aggregate(named, F.slice(named, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda y: same(x, y)), kept).otherwise(F.concat(kept, F.array(x))))


def suffix_kind(uri: Column) -> Column:
    suffix = F.lower(F.regexp_extract(uri, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(suffix == "", "generic")
    for kind, suffixes in KINDS.items():
        out = out.when(suffix.isin(*suffixes), kind)
    return out.otherwise("other")


def model_slug(name: Column, ladder: Sequence[tuple[str, str]]) -> Column:
    low = F.lower(name)
    out = None
    for part, slug in ladder:
        out = F.when(low.contains(part), slug) if out is None else out.when(low.contains(part), slug)
    return out.otherwise(F.regexp_replace(low, "[^a-z0-9]+", "-"))


def shift_minutes(minutes: Column, by: Column | int) -> Column:
    return F.pmod(minutes + by, F.lit(1440))


def clock_12h(minutes: Column) -> Column:
    hour = F.floor(minutes / 60)
    shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.format_string("%d:%02d %s", shown.cast("long"), (minutes % 60).cast("long"), F.when(hour < 12, "AM").otherwise("PM"))


# How each kind of report reads the turn out of a file's name.
FILE_TURNS = {"search": r"it(\d+)", "anchored": r"^it(\d+)_", "turn": r"^turn(\d+)"}
PREFIX_TURNS = ("it2", "it3", "it4", "it5")


def file_turn(name: Column, rule: str) -> Column:
    """The turn in a file's name by one of the rules; ``prefixed`` knows turns 2 to 5 only. Null where there is none."""
    if rule == "prefixed":
        found = F.substring(name, 3, 1)
        return F.when(F.substring(name, 1, 3).isin(*PREFIX_TURNS), found).try_cast("int")
    return F.nullif(F.regexp_extract(name, FILE_TURNS[rule], 1), F.lit("")).try_cast("int")


def file_order(name: Column, rule: str) -> list[Column]:
    """What files sort by: ``rising`` and ``falling`` go by turn (unknown: 999), complex files first by their number; ``plain_first`` puts nonNR files first, whatever their turn."""
    number = F.nullif(F.regexp_extract(name, r"complex_(\d+)", 1), F.lit("")).try_cast("int")
    turn = F.coalesce(file_turn(name, "search"), F.lit(999))
    if rule == "plain_first":
        plain = name.contains("nonNR")
        return [F.when(plain, 0).when(number.isNotNull(), 1).otherwise(2), F.when(~plain, number), name]
    if rule not in ("rising", "falling"):
        raise ValueError(f"unknown order of files: {rule}")
    return [turn, number.isNull(), number if rule == "rising" else -number, name]


def bad_verdict(response: Column) -> Column:
    """Whether a judge's response, as JSON text, takes its record out.

    It does if it isn't an object, if any of its values isn't one, or if any has
    the status Fail. N/A, an empty object and other statuses keep the record.
    """
    text = F.trim(response)
    fields = F.from_json(text, "map<string,string>")
    failed = F.exists(F.map_values(fields), lambda v: F.coalesce(~F.ltrim(v).startswith("{") | (F.get_json_object(v, "$.status") == "Fail"), v.isNull()))
    return F.when(text.isin("N/A", '"N/A"'), False).otherwise(F.coalesce(failed, F.lit(True)))


def masked_labels(ids: Column, prefix_ids: Column, most: int, mask: int = -100) -> Column:
    """(input_ids, labels): the first ``most`` tokens, and the same with those of the prompt's prefix masked."""
    kept = F.slice(ids, 1, most)
    start = F.least(F.size(prefix_ids), F.size(kept))
    labels = F.transform(kept, lambda x, i: F.when(i < start, F.lit(mask).cast("long")).otherwise(x))
    return F.struct(kept.alias("input_ids"), labels.alias("labels"))


def word_ids(text: Column) -> Column:
    """A stand-in tokenizer: words between white space, each numbered by the first seven digits of its md5."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long"))
