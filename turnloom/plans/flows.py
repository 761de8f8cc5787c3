"""Windows over events, resumption, turn loops and evaluation flows (STR, OR, SNK)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import literals, strings
from turnloom.operators import generation, ranking, turns
from turnloom.operators.joins import bag_join, last_wins_join
from turnloom.plans.base import r9
from turnloom.registry import Tables, query
from turnloom.sources import readers, sinks
from turnloom.streaming import events as streams


@dataclass
class Pipeline:
    """Named frame-to-frame stages with skips; ``plan`` is the dry run."""

    stages: list[tuple[str, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)

    def run(self, df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
        for name, stage in self.stages:
            if name not in skip:
                df = stage(df)
        return df

    def preview(self, skip: Sequence[str] = ()) -> list[tuple[int, str, bool]]:
        """What a run would do: (place, stage, whether it runs). An unknown stage to skip raises."""
        unknown = set(skip) - {name for name, _ in self.stages}
        if unknown:
            raise ValueError(f"unknown stages {sorted(unknown)}")
        return [(i, name, name not in skip) for i, (name, _) in enumerate(self.stages)]

    def plan(self, df: DataFrame, skip: Sequence[str] = ()) -> str:
        out = self.run(df, skip)
        return out._jdf.queryExecution().toString()


@query("STR5 STR1", "select event_type, time_bucket(interval 1 day, ts)::TIMESTAMP as start, count(*)::BIGINT as n, round(sum(value), 6) as v from events group by 1, 2")
def str5_tumbling(t: Tables) -> DataFrame:
    out = streams.windowed_counts(t.events, "1 day")
    return out.select("event_type", "start", "n", F.round("v", 6).alias("v"))


@query("STR5", """with o as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hours then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as sid from o) select user_id, min(ts) as start, count(*)::BIGINT as n from s group by user_id, sid""")
def str5_sessions(t: Tables) -> DataFrame:
    return streams.sessions(t.events, "6 hours").select("user_id", "start", "n")


@query("STR2 ST5", "with w as (select source, count(*) as n from documents where doc_id % 2 = 0 group by 1) select s.source, (30 - coalesce(n, 0))::BIGINT as missing from (select distinct source from documents) s left join w using (source) where coalesce(n, 0) < 30")
def str2_resume(t: Tables) -> DataFrame:
    return streams.remaining(t.documents.select("source").distinct(), t.documents.filter("doc_id % 2 = 0"), "source", 30)


@query("STR4 WN7", "select event_id, event_type from (select *, row_number() over (partition by event_type order by event_id) as rn from events) where rn <= 40")
def str4_running_quota(t: Tables) -> DataFrame:
    return ranking.head_n(t.events.select("event_id", "event_type"), ["event_type"], ["event_id"], 40)


@query("SNK4 SNK10", """with k as (select c_custkey, c_mktsegment = 'BUILDING' as old, 'C-' || (c_custkey // 10) || '-' || (100 + c_custkey % 3) as id from customer),
m as (select *, rn > 1 or id in (select id from k where old) as clash from (select *, row_number() over (partition by id order by c_custkey) as rn from k where not old)),
u as (select id from k where old union all select id from m where not clash),
top as (select regexp_replace(id, '-[0-9]+$', '') as stem, max(regexp_extract(id, '-([0-9]+)$', 1)::BIGINT) as top from u group by 1),
j as (select m.*, regexp_replace(id, '-[0-9]+$', '') as stem from m)
select c_custkey, case when clash then stem || '-' || (greatest(coalesce(top + 1, 100), 100) + row_number() over (partition by stem, clash order by c_custkey) - 1) else id end as id from j left join top using (stem)""")
def snk4_fresh_keys(t: Tables) -> DataFrame:
    key = F.concat(F.lit("C-"), F.floor(F.col("c_custkey") / 10).cast("string"), F.lit("-"), (F.col("c_custkey") % 3 + 100).cast("string")).alias("id")
    old = t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey", key)
    new = t.customer.filter("c_mktsegment <> 'BUILDING'").select("c_custkey", key)
    return sinks.fresh_keys(new, old, "id", ["c_custkey"])


@query("SNK8 SC10", "select lang, case when avg(case when quality = 0 then n_chars end) is null then 'N/A' else printf('%.2f', avg(case when quality = 0 then n_chars end)) end as mean from documents join labels using (doc_id) group by lang")
def snk8_formatted(t: Tables) -> DataFrame:
    means = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id").groupBy("lang").agg(F.avg(F.when(F.col("quality") == 0, F.col("n_chars"))).alias("mean"))
    return sinks.formatted(means, ["mean"])


def _events_stream(t: Tables) -> DataFrame:
    # a pattern, as Spark takes a plain path for a folder and this may be a file
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/[e]vents.parquet")


@query("STR1 STR2", "select distinct event_id, event_type from events")
def str1_stream_sink(t: Tables) -> DataFrame:
    """Events as a stream into a folder, each id once; a second run from the same checkpoint adds nothing."""
    path, checkpoint = sinks.scratch(t.spark, "stream"), sinks.scratch(t.spark, "stream-checkpoint")
    for _ in range(2):
        out = streams.run_to_end(streams.unseen(_events_stream(t).select("event_id", "event_type"), "event_id"), path, checkpoint)
    return out


@query("STR4 WN7", "select event_type, least(count(*), 40)::BIGINT as n, true as own from events group by event_type")
def str4_stream_quota(t: Tables) -> DataFrame:
    """The first 40 events of each type that a stream brings; which those are depends on the order of arrival."""
    path, checkpoint = sinks.scratch(t.spark, "quota"), sinks.scratch(t.spark, "quota-checkpoint")
    taken = streams.run_to_end(streams.quota_stream(_events_stream(t), "event_type", 40), path, checkpoint)
    known = taken.join(t.events.select("event_id", F.lit(True).alias("known")).distinct(), "event_id", "left")
    return known.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("known", F.lit(False))).alias("own"))


_ARRIVED = """with a as (select *, event_id % 10 = 3 as held from events),
m as (select max(case when not held then ts end) - interval 1 day as first, max(ts) - interval 1 day as final from a),
w as (select event_type, start, start + interval {width} as stop, held, value from a, lateral (select unnest(generate_series(time_bucket(interval {slide}, ts) - interval {width} + interval {slide}, time_bucket(interval {slide}, ts), interval {slide})) as start))
select event_type, start::TIMESTAMP as start, count(*)::BIGINT as n, round(sum(value), 6) as v from w, m where stop <= final and not (held and stop <= first) group by event_type, start"""


def _late_windows(t: Tables, width: str, slide: str | None = None) -> DataFrame:
    """Windows that a stream closes when a tenth of the events come late, after the others' watermark, a day behind, has closed most of theirs."""
    late = F.coalesce(F.col("event_id") % 10 == 3, F.lit(False))
    source, path, checkpoint = (sinks.scratch(t.spark, x) for x in ("arrivals", "windows", "windows-checkpoint"))
    flow = lambda stream: streams.windowed_counts(stream, width, slide, "1 day")
    out = streams.run_arrivals([t.events.filter(~late), t.events.filter(late)], flow, source, path, checkpoint)
    return out.select("event_type", "start", "n", F.round("v", 6).alias("v"))


@query("STR5 STR2", _ARRIVED.format(width="1 day", slide="1 day"))
def str5_stream_tumbling(t: Tables) -> DataFrame:
    return _late_windows(t, "1 day")


@query("STR5 STR2", _ARRIVED.format(width="6 hours", slide="2 hours"))
def str5_stream_sliding(t: Tables) -> DataFrame:
    return _late_windows(t, "6 hours", "2 hours")


@query("STR4 UD2")
def str4_stream_dedup(t: Tables) -> DataFrame:
    """``ud2_rouge_dedup`` on a stream that stops after half of the conversations and starts again from its checkpoint."""
    rows = t.conversations.select("role", "conv_id", "turn", "text")
    middle = rows.agg(F.percentile_approx("conv_id", 0.5).alias("m"))
    halves = [rows.crossJoin(F.broadcast(middle)).filter(half).select(*rows.columns) for half in ("conv_id <= m", "conv_id > m")]
    source, path, checkpoint = (sinks.scratch(t.spark, x) for x in ("turns", "kept-turns", "kept-checkpoint"))
    with streams.rocks_state(t.spark):
        out = streams.run_arrivals(halves, lambda stream: streams.greedy_stream(stream, "role", ["conv_id", "turn"], "text", 0.7), source, path, checkpoint)
    return out.select("role", "conv_id", "turn")


@query("OR2", "select * from (values (0::BIGINT, 'empty', true, (select count(*) from conversations where trim(text) <> '')), (1, 'short', false, null), (2, 'system', true, (select count(*) from conversations where trim(text) <> '' and role <> 'system'))) v(place, stage, runs, n)")
def or2_dry_run(t: Tables) -> DataFrame:
    """The stages that a run with a skipped one would take, and the rows after each that it takes."""
    flow = Pipeline([("empty", lambda df: df.filter(F.trim("text") != "")), ("short", lambda df: df.filter(F.length("text") > 20)), ("system", lambda df: df.filter("role <> 'system'"))])
    skip = ["short"]
    stages = flow.preview(skip)
    counts = [Pipeline(flow.stages[: i + 1]).run(t.conversations, skip).agg(F.lit(i).cast("long").alias("place"), F.count(F.lit(1)).alias("n")) for i, _, runs in stages if runs]
    return t.spark.createDataFrame(stages, "place long, stage string, runs boolean").join(reduce(DataFrame.unionByName, counts), "place", "left")


@query("OR4", "select lang, count(*)::BIGINT as n from documents where lang in ('de', 'fr') group by lang")
def or4_test_keys(t: Tables) -> DataFrame:
    known = [r["lang"] for r in t.documents.select("lang").distinct().collect()]
    keys = readers.parse_test_keys("fr, de,fr", known)
    return t.documents.filter(F.col("lang").isin(keys)).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("OR1 STR3 JN1 JN3 WN2 SC20")
def or1_generation_turn(t: Tables) -> DataFrame:
    """One turn of the generation loop over user turns, with the deterministic generator."""
    start = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"), F.concat_ws("-", F.lit("user"), "conv_id").alias("unique_idx"))

    def respond(df: DataFrame) -> DataFrame:
        return generation.generate(df.withColumn("prompt", generation.render("Respond: %s", ["query"])), "prompt", generation.stub, literals.parses)

    def parsed(df: DataFrame) -> DataFrame:
        return df.select("conv_id", "turn", "query", "unique_idx", literals.read_generation(F.col("output")).alias("r")).select("conv_id", "turn", "query", "unique_idx", F.get_json_object("r.call", "$.plan").alias("plan"))

    def joined(df: DataFrame) -> DataFrame:
        back = last_wins_join(df.select("query", "plan", "conv_id", "turn"), start.select("query", "unique_idx", F.col("conv_id").alias("c")), ["query"], ["c"])
        return bag_join(back, back.select("query", F.col("conv_id").alias("b")), ["query"], ["conv_id", "turn"], ["b"])

    def deduped(df: DataFrame) -> DataFrame:
        return ranking.keep_first_exempt(df, ["query"], ["conv_id", "turn"], F.col("unique_idx").endswith("_NR"))

    flow = Pipeline([("respond", respond), ("parse", parsed), ("join", joined), ("dedup", deduped)])
    return flow.run(start).select("conv_id", "turn", "plan", "unique_idx", "u_key")


def turn_loop(t: Tables, folder: str, n: int, backend: Callable[[str, float], str] = generation.stub, name: str = "stub") -> tuple[turns.StageTables, DataFrame]:
    """``n`` turns from user turns as seeds and the assistant's as spare ones; a folder that was used before is gone on with."""
    tables = turns.StageTables(t.spark, folder)
    said = {"c": tables.source(t.conversations)}
    plan = F.concat(F.lit("plan_"), (F.col("conv_id") % 5).cast("string"))
    key = F.concat_ws("_", "conv_id", "turn")
    of = lambda role: lambda c: turns.seed_records(c.filter(F.col("role") == role).select(key.alias("key"), "text", plan.alias("plan")), "key", "text", "plan")
    seeds, spare = (tables.run(f"seeds-{role}", of(role), said) for role in ("user", "assistant"))
    return tables, turns.TurnLoop(tables, backend, least=20, name=name).run(seeds, spare, n).df


@query("OR1 STR3 JN3 JN8 WN2 SMP15")
def or1_turn_loop(t: Tables) -> DataFrame:
    """Records after three turns of all ten stages."""
    _, out = turn_loop(t, sinks.scratch(t.spark, "turns"), 3)
    return out.select("unique_idx", "query", "rewrited_query", "plan", F.size("history").cast("long").alias("turns"))


@query("OR5 SC49 SC60")
def or5_two_stage_evaluation(t: Tables) -> DataFrame:
    """Rewrite, then plan, for turns whose rewrite succeeded; accuracy by turn."""
    rows = t.conversations.filter("role = 'user'").select("conv_id", "turn", "text").withColumn("gold", F.concat(F.lit("plan_"), F.col("conv_id") % 5))

    def rewrite(df: DataFrame) -> DataFrame:
        out = generation.generate(df.withColumn("p1", generation.render("Rewrite: %s", ["text"])), "p1", generation.stub, lambda x: x.startswith("{"))
        return out.select("conv_id", "turn", "text", "gold", F.when(~F.col("valid"), F.lit("invalid")).alias("rewrite_error"))

    def plan(df: DataFrame) -> DataFrame:
        out = generation.generate(df.withColumn("p2", generation.render("Plan: %s", ["text"])), "p2", generation.stub, lambda x: x.startswith("{"))
        return out.select("conv_id", "turn", "gold", F.get_json_object("output", "$.plan").alias("plan"))

    done, _ = generation.two_stage(rows, rewrite, plan, "rewrite_error")
    return done.groupBy("turn").agg(F.count(F.lit(1)).alias("n"), r9(F.avg((F.col("plan") == F.col("gold")).cast("double"))).alias("acc"))


@query("SNK7 SC9", """select '[' || event_type || '] : ' || event_type || ': ' || count(*) as line, null::BIGINT as event_id from events where event_type = 'error' group by event_type
union all select '[error] : plan_count: 1, total_lens: ' || count(*), null from events where event_type = 'error' having count(*) > 0
union all select 'other_malformed_json', event_id from events where event_type = 'error'""")
def snk7_error_log(t: Tables) -> DataFrame:
    """Error events go to a log with the time and class of each, in two appends, and their counts to another; both are read back."""
    bad = t.events.filter("event_type = 'error'").select("event_id", "event_type", strings.raw_error(F.col("props")).alias("kind"))
    events, counts = (sinks.scratch(t.spark, x) for x in ("error-events", "error-counts"))
    middle = bad.agg(F.avg("event_id").alias("m"))
    for half in ("event_id <= m", "event_id > m"):
        sinks.log_events(bad.crossJoin(F.broadcast(middle)).filter(half).select("event_id", "kind"), events)
    sinks.log_counts(bad, "event_type", "error", counts)
    logged = readers.read_jsonl(t.spark, events, "timestamp_utc string, event_id long, kind string")
    return t.spark.read.text(counts).select(F.col("value").alias("line"), F.lit(None).cast("long").alias("event_id")).unionByName(logged.filter("to_timestamp(timestamp_utc) is not null").select(F.col("kind").alias("line"), "event_id"))
