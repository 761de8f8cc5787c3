"""Harder versions of records: mutators by plan that rewrite the query, its history and nested arguments, in JVM code."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import strings

#: What a mutator may change of a record. Arguments are JSON text outside, map<string,variant> inside.
PARTS = ("query", "rewrited_query", "history", "arguments")


@dataclass(frozen=True)
class Change:
    """A template's name and what it puts in place of a record's parts; arguments by name, as JSON text.

    A ``fallback`` has no turn of its own: it stands in where no other change holds.
    """

    template: str
    query: Column
    rewrite: Column
    first_turn: Column | None = None
    arguments: dict[str, Column] = field(default_factory=dict)
    fallback: bool = False

    def applied(self) -> Column:
        old = F.col("__arguments")
        fresh = F.col("arguments") if not self.arguments else F.to_json(F.map_concat(
            F.map_filter(old, lambda k, _: ~k.isin(*self.arguments)), F.create_map(*(x for k, v in self.arguments.items() for x in (F.lit(k), F.parse_json(v))))
        ))
        turns = F.col("history") if self.first_turn is None else F.concat(F.array(self.first_turn), F.slice("history", 2, F.greatest(F.size("history") - 1, F.lit(0))))
        return F.struct(self.query.alias("query"), self.rewrite.alias("rewrited_query"), turns.alias("history"), fresh.alias("arguments"), F.lit(self.template).alias("template"))


#: A mutator gives the changes of a plan, of which a record's index takes one in turn, with a condition on each (null: always).
Mutator = Callable[[Column], Sequence[tuple[Column | None, Change]]]


def quoted(value: Column) -> Column:
    """A text as JSON."""
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")


def number(name: str) -> Column:
    return F.try_variant_get(F.try_element_at(F.col("__arguments"), F.lit(name)), "$", "int")


def text(name: str) -> Column:
    return F.coalesce(F.try_variant_get(F.try_element_at(F.col("__arguments"), F.lit(name)), "$", "string"), F.lit(""))


def shift_alarm(index: Column) -> Sequence[tuple[Column | None, Change]]:
    """An alarm moves by 35, 45 or 55 minutes and gets a second field: days, silence or a label."""
    now = F.coalesce(number("hour"), F.lit(7)) * 60 + F.coalesce(number("minute"), F.lit(0))
    new = strings.shift_minutes(now, F.pmod(index, F.lit(3)) * 10 + 35)
    was, at = strings.clock_12h(now), strings.clock_12h(new)
    clock = {"hour": F.floor(new / 60).cast("string"), "minute": (new % 60).cast("string")}
    label = F.concat(text("label"), F.lit(" again"))
    said = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    return [
        (None, Change("alarm_days", said("Put it at ", at, " on weekdays"), said("Put the ", was, " alarm at ", at, " on weekdays"), arguments={**clock, "days": F.lit("[2,3,4,5,6]")})),
        (None, Change("alarm_silent", said("That one at ", at, ", without sound"), said("The ", was, " alarm at ", at, ", without sound"), arguments={**clock, "sound": F.lit("false")})),
        (None, Change("alarm_label", said("Move it to ", at, " and call it ", label), said("Move the ", was, " alarm to ", at, " and call it ", label), arguments={**clock, "label": quoted(label)})),
    ]


def name_a_file(index: Column) -> Sequence[tuple[Column | None, Change]]:
    """A tone is chosen by the id of a file that the first turn lists, or as the tune that was heard there."""
    uri, key = text("uri"), (index + 100).cast("string")
    listed = F.concat(F.lit("turn 1: What tones are there? -> File "), key, F.lit(" is "), uri)
    return [
        (None, Change("tone_by_id", F.concat(F.lit("Take file "), key), F.concat(F.lit("Take file "), key, F.lit(" as my tone")), first_turn=listed)),
        (None, Change("tone_heard", F.lit("Take that one for calls"), F.concat(F.lit("Take "), uri, F.lit(" for calls")), first_turn=listed)),
    ]


def go_there(index: Column) -> Sequence[tuple[Column | None, Change]]:
    """A place that the history names becomes there."""
    ways = ("Take me", "Show the way", "Start the route")
    return [(None, Change("place_there", F.lit(f"{way} there"), F.concat(F.lit(f"{way} to "), text("place")))) for way in ways]


def like_another_timer(index: Column) -> Sequence[tuple[Column | None, Change]]:
    """A timer like the last or the second one that the first turn lists, or after the last; ten minutes where none is listed."""
    timers = strings.timer_items(F.try_element_at(F.col("history"), F.lit(1)))
    minutes = lambda k: F.try_element_at(timers, F.lit(k))["minutes"].cast("string")
    label = lambda k: F.initcap(F.try_element_at(timers, F.lit(k))["label"])
    some, two = F.size(timers) > 0, F.size(timers) > 1
    as_text = lambda m: F.concat(F.lit('"'), m, F.lit(' minutes"'))
    last = Change("timer_last", F.lit("Another one like the last"), F.concat(F.lit("Another timer of "), minutes(-1), F.lit(" minutes like "), label(-1)), arguments={"duration": as_text(minutes(-1))})
    second = Change("timer_second", F.lit("Another one like the second"), F.concat(F.lit("Another timer of "), minutes(2), F.lit(" minutes like "), label(2)), arguments={"duration": as_text(minutes(2))})
    after = Change("timer_after", F.concat(F.lit("Ten minutes more after "), label(-1)), F.concat(F.lit("A timer of 10 minutes after "), label(-1)), arguments={"duration": F.lit('"10 minutes"'), "silent": F.lit("true")})
    none = Change("timer_none", F.lit("Another one, a short one"), F.lit("Another timer of 10 minutes"), arguments={"duration": F.lit('"10 minutes"')}, fallback=True)
    return [(some, last), (two, second), (some, after), (None, none)]


def stop_after(index: Column) -> Sequence[tuple[Column | None, Change]]:
    """A recording ends by itself."""
    return [(None, Change("stop_after", F.lit(f"Record for {s} seconds"), F.lit(f"Record a video and stop it after {s} seconds"))) for s in (10, 15, 30, 45)]


#: Mutators by plan.
MUTATORS: dict[str, Mutator] = {"edit_alarm": shift_alarm, "set_tone": name_a_file, "navigate": go_there, "set_timer": like_another_timer, "record_video": stop_after}


def harden_rows(df: DataFrame, plan: str, index: str, mutators: dict[str, Mutator] = MUTATORS) -> DataFrame:
    """Rows of plans with a mutator get its change: parts anew, ``template`` tells which; others keep theirs, with null.

    ``df`` has ``PARTS``, arguments as JSON text of an object (else none). A row's index takes the
    mutator's changes in turn; one whose condition fails gives way to the first of
    them whose condition holds. All is in one projection: nothing is shuffled.
    """
    none = F.create_map().cast("map<string,variant>")
    ready = df.withColumn("__arguments", F.coalesce(F.from_json("arguments", "map<string,variant>"), none))
    chosen = None
    for name, mutator in mutators.items():
        changes = list(mutator(F.col(index)))
        turns = [c for c in changes if not c[1].fallback]
        place = F.pmod(F.col(index), F.lit(len(turns)))
        out = None
        for k, (when, change) in enumerate(turns):
            holds = (place == k) & (F.lit(True) if when is None else when)
            out = F.when(holds, change.applied()) if out is None else out.when(holds, change.applied())
        for when, change in changes:
            out = out.when(F.lit(True) if when is None else when, change.applied())
        chosen = F.when(F.col(plan) == name, out) if chosen is None else chosen.when(F.col(plan) == name, out)
    kept = F.struct(*(F.col(p).alias(p) for p in PARTS), F.lit(None).cast("string").alias("template"))
    made = ready.withColumn("__made", F.coalesce(chosen, kept))
    others = [c for c in df.columns if c not in PARTS]
    return made.select(*others, *(F.col(f"__made.{p}").alias(p) for p in (*PARTS, "template")))


def mutation_report(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """template, rows and how many of them changed in each part, from both versions of each record."""
    old = before.select(key, *(F.col(p).alias(f"__{p}") for p in PARTS))
    both = after.join(old, key)
    changed = [F.count_if(~F.col(p).eqNullSafe(F.col(f"__{p}"))).alias(p) for p in PARTS]
    return both.groupBy("template").agg(F.count(F.lit(1)).alias("rows"), *changed)
