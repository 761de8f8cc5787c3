"""Calls against a catalog, serialisers, splits in two streams, and hardened records (PRJ20, SC12, SC48, SC50, SC61, SC62, SMP3, SNK5, SNK10, UD12).

The stand-in of model output is made from ``part``: a call's plan is a brand, its
arguments are named by the words of a name, and its type says how it was
written down: as JSON, as a Python literal, encoded twice, in a fenced block, cut off, or with a list for arguments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import history as H
from turnloom.functions import literals, strings
from turnloom.operators import hardening, sampling, schema
from turnloom.plans.base import HISTORY, history
from turnloom.plans.relational import _md5
from turnloom.registry import Tables, query
from turnloom.sources import sinks

_CALLS = """with c as (select p_partkey, p_brand as plan, p_type, p_size, split_part(p_name, ' ', 1) as w1, split_part(p_name, ' ', 2) as w2 from part),
x as (select *, '"' || w1 || '":' || p_size as a, '"' || w2 || '":"p' || p_partkey || '"' as b from c),
j as (select *, case when w1 < w2 then a || ',' || b else b || ',' || a end as args, [least(w1, w2), greatest(w1, w2)] as keys, p_type <> 'SMALL' as parse_ok, p_type not in ('SMALL', 'STANDARD') as is_object from x),
k as (select p_brand as plan, unnest(string_split(p_name, ' ')) as w from part), cat as (select plan, list_sort(list(distinct w)) as arg_keys from k where substr(md5(plan || w), 1, 1) < 'c' and substr(md5(plan), 1, 1) >= '3' group by plan),
g as (select p_type, p_size - 1 as p_size, list_sort(list(distinct p_brand)) as candidates from part group by p_type, p_size)
"""


def _catalog(t: Tables) -> DataFrame:
    """plan, arg_keys: a seeded choice of the words of each brand's names; some brands have no entry."""
    words = t.part.select(F.col("p_brand").alias("plan"), F.explode(F.split("p_name", " ")).alias("w"))
    digit = lambda c: F.substring(F.md5(c), 1, 1)
    known = words.filter((digit(F.concat("plan", "w")) < "c") & (digit(F.col("plan")) >= "3"))
    return known.groupBy("plan").agg(F.array_sort(F.collect_set("w")).alias("arg_keys"))


def _calls(t: Tables) -> DataFrame:
    """p_partkey, raw and decoded output, and the candidates: the brands of the type's next size."""
    lit, w = F.lit, F.split("p_name", " ")
    first, second = F.element_at(w, 1), F.element_at(w, 2)
    json = F.concat(lit('{"plan": " '), "p_brand", lit('", "arguments": {"'), first, lit('": '), "p_size", lit(', "'), second, lit('": "p'), "p_partkey", lit('"}}'))
    listed = F.concat(lit('{"plan": "'), "p_brand", lit('", "arguments": ["'), first, lit('", '), "p_size", lit("]}"))
    raw = (
        F.when(F.col("p_type") == "LARGE", F.concat(lit('"'), F.replace(json, lit('"'), lit('\\"')), lit('"')))
        .when(F.col("p_type") == "MEDIUM", F.translate(json, '"', "'"))
        .when(F.col("p_type") == "PROMO", F.concat(lit("Sure:\n```json\n"), json, lit("\n```")))
        .when(F.col("p_type") == "SMALL", json.substr(lit(1), F.length(json) - 2))
        .when(F.col("p_type") == "STANDARD", listed)
        .otherwise(json)
    )
    nearby = t.part.groupBy("p_type", (F.col("p_size") - 1).alias("p_size")).agg(F.array_sort(F.collect_set("p_brand")).alias("candidates"))
    rows = t.part.select("p_partkey", "p_type", "p_size", raw.alias("raw")).join(nearby, ["p_type", "p_size"], "left")
    return rows.select("p_partkey", "raw", literals.parse_literal("raw").alias("decoded"), "candidates")


@query("SC48", _CALLS + """select p_partkey, case when is_object then '{"arguments":{' || args || '},"plan":"' || plan || '"}' when parse_ok then '{"arguments":["' || w1 || '",' || p_size || '],"plan":"' || plan || '"}' end as decoded from j""")
def sc48_double_encoded(t: Tables) -> DataFrame:
    return _calls(t).select("p_partkey", "decoded")


@query("SC44 SC40 SC28", _CALLS + """select conv_id, turn, case when p_type = 'STANDARD' then '{"arguments":["' || w1 || '",' || p_size || '],"plan":"' || plan || '"}' else '{"arguments":{' || args || '},"plan":"' || plan || '"}' end as call
from j join conversations on conv_id = p_partkey where p_type <> 'LARGE'""")
def sc44_calls_in_texts(t: Tables) -> DataFrame:
    """What is written down of a call among a turn's own words: between them, or cut off at their end. A call encoded twice is no object there."""
    said = t.conversations.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).join(_calls(t).withColumnRenamed("p_partkey", "conv_id"), "conv_id")
    cut_off = F.col("decoded").isNull()
    raw = F.concat("text", F.lit(" "), "raw", F.when(cut_off, "").otherwise(F.concat(F.lit(" "), "text")))
    return said.select("conv_id", "turn", F.explode(literals.extract_embedded(raw)).alias("call"))


@query("SC46 SC11", _CALLS + """select conv_id, turn, '{"arguments":{' || case when w1 < 'arg0' then '"' || w1 || '":' || p_size || ',"arg0":"' || w2 || '"' else '"arg0":"' || w2 || '","' || w1 || '":' || p_size end || '},"plan":"' || p_type || '","result":' || case when p_size % 2 = 0 then '"r' || p_size || '"' else 'null' end || '}' as call
from c join conversations on conv_id = p_partkey""")
def sc46_code_calls(t: Tables) -> DataFrame:
    """A line of code between the lines of a turn, bound to a name or not, with a named and an unnamed argument."""
    w = F.split("p_name", " ")
    bound = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("r"), "p_size", F.lit(" = "))).otherwise("")
    line = F.concat(bound, "p_type", F.lit("('"), F.element_at(w, 2), F.lit("', "), F.element_at(w, 1), F.lit("="), "p_size", F.lit(")"))
    said = t.conversations.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).join(t.part.select(F.col("p_partkey").alias("conv_id"), line.alias("line")), "conv_id")
    return said.select("conv_id", "turn", F.explode(literals.extract_calls(F.concat("text", F.lit("\n"), "line", F.lit("\n"), "text"))).alias("call"))


@query("SC61 SC62", _CALLS + """, m as (select j.*, cat.plan is not null and parse_ok as known, arg_keys, candidates from j left join cat using (plan) left join g on g.p_type = j.p_type and g.p_size = j.p_size),
i as (select *, case when is_object then list_filter(keys, lambda w: not coalesce(list_contains(arg_keys, w), false)) else [] end as bad from m)
select p_partkey, parse_ok, case when parse_ok then plan else '' end as predicted_plan, is_object as arguments_is_object, known as plan_allowed, array_to_string(bad, '|') as invalid_keys, is_object and len(bad) = 0 as keys_subset,
known and is_object and len(bad) = 0 as compliant, coalesce(parse_ok and list_contains(candidates, plan), false) as in_candidates, coalesce(known and is_object and len(bad) = 0 and list_contains(candidates, plan), false) as schema_valid from i""")
def sc62_compliance(t: Tables) -> DataFrame:
    out = schema.compliance(_calls(t), "decoded", _catalog(t), candidates="candidates")
    return out.drop("raw", "decoded", "candidates").withColumn("invalid_keys", F.array_join("invalid_keys", "|"))


@query("SC50", _CALLS + """select p_partkey, case when is_object then plan || '(' || replace(replace(args, '"' || w1 || '":', w1 || '='), '"' || w2 || '":', w2 || '=').replace(',', ', ') || ')' when parse_ok then plan || '()' end as code,
'{' || case when parse_ok then '"name":"' || plan || '",' else '' end || '"arguments":{' || case when is_object then args else '' end || '}}' as json from j""")
def sc50_serialised(t: Tables) -> DataFrame:
    call = F.col("decoded")
    return _calls(t).select("p_partkey", schema.as_code(call).alias("code"), schema.as_json(call).alias("json"))


@query("SC50", _CALLS + """, a as (select p_partkey, unnest(candidates) as plan from c join g using (p_type, p_size))
select p_partkey, string_agg(plan || '(' || array_to_string(list_transform(arg_keys, lambda w: w || '=?'), ', ') || ')', chr(10) order by plan) as docs from a join cat using (plan) group by p_partkey""")
def sc50_candidate_docs(t: Tables) -> DataFrame:
    return schema.tool_docs(_calls(t), "p_partkey", "candidates", _catalog(t))


@query("PRJ20", _CALLS + """select p_partkey, array_to_string(list_transform(list_filter(case when is_object then keys else [] end, lambda w: list_contains(arg_keys, w)), lambda w: w || '=' || plan || ' ' || w || '/1'), '|') as kept from j join cat using (plan) where parse_ok""")
def prj20_given_keys(t: Tables) -> DataFrame:
    """Of the catalog's specification of a call's plan what the call gives, without types and defaults."""
    fields = lambda k: F.create_map(F.lit("description"), F.concat("plan", F.lit(" "), k), F.lit("type"), F.lit("string"), F.lit("default"), F.lit("x"))
    specs = _catalog(t).select("plan", F.map_from_entries(F.transform("arg_keys", lambda k: F.struct(k, fields(k)))).alias("spec"))
    met = _calls(t).withColumn("plan", F.get_json_object("decoded", "$.plan")).join(specs, "plan")
    shown = F.transform(F.map_entries(schema.pruned_spec(F.col("spec"), F.col("decoded"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]["description"], F.lit("/"), F.size(e["value"]).cast("string")))
    return met.select("p_partkey", F.array_join(F.array_sort(shown), "|").alias("kept"))


@query("SC12", HISTORY + r"select conv_id, idx::BIGINT as idx, split_part(regexp_replace(h[idx + 1], '^turn [0-9]+: ', ''), ' -> ', 1) as user, md5(regexp_extract(h[idx + 1], '(?s)^.*? -> (.*)$', 1)) as device from history, range(0, 1000) r(idx) where idx < len(h)")
def sc12_all_turns(t: Tables) -> DataFrame:
    turns = history(t).select("conv_id", F.posexplode("h").alias("idx", "turn"))
    return turns.select("conv_id", F.col("idx").cast("long").alias("idx"), H.user_part(F.col("turn")).alias("user"), F.md5(H.device_part(F.col("turn"))).alias("device"))


_STREAMS = f"""with d as (select doc_id, source, ends_with(text, '.') as nr, text = trim(regexp_replace(text, '[\t\n\x0b\f\r ]+', ' ', 'g')) as same from documents),
a as (select doc_id, source, case when nr then 'NR' else 'nonNR' end as stream from d where nr or not same),
r as (select *, row_number() over (partition by stream, source order by {_md5('3', 'doc_id')}, doc_id) as rn, count(*) over (partition by stream, source) as n from a),
s as (select *, case when n = 1 then 0 else floor(n * 0.7::DOUBLE)::BIGINT end as train from r),
p as (select doc_id, source, stream, case when rn <= least(train, case stream when 'NR' then 10 else 25 end) then 'train' when rn > train and (train <= case stream when 'NR' then 10 else 25 end or rn <= train + case stream when 'NR' then 10 else 25 end) then 'test' end as part from s)
"""


def _streams(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "source", F.col("text").endswith(".").alias("nr"), F.col("text").eqNullSafe(strings.normalise_blanks(F.col("text"))).alias("same"))
    return sampling.two_streams(docs, "source", "doc_id", F.col("nr"), F.col("same"), 0.7, {"NR": 10, "nonNR": 25}, 3).select("doc_id", "source", "stream", "part")


@query("SMP3", _STREAMS + "select * from p")
def smp3_two_streams(t: Tables) -> DataFrame:
    return _streams(t)


@query("SNK10 SMP3 SNK3", _STREAMS + "select stream, part, count(*)::BIGINT as rows, count(distinct source)::BIGINT as plans from p where part is not null group by stream, part")
def snk10_manifest(t: Tables) -> DataFrame:
    """What the written splits hold, read back from their folders."""
    path = sinks.scratch(t.spark, "splits")
    sinks.write_partitioned(_streams(t).filter("part is not null"), path, ["stream", "part"])
    return sinks.manifest(t.spark.read.parquet(path), ["stream", "part"], "source")


@query("SNK5 WN1", "with r as (select *, row_number() over (partition by text order by doc_id) = 1 as first from documents) select case when first then 'kept' else 'redundant' end as side, count(*)::BIGINT as n, sum(doc_id)::BIGINT as ids from r group by 1")
def snk5_split_files(t: Tables) -> DataFrame:
    """First texts to one folder, their copies to another."""
    kept, rest = (sinks.scratch(t.spark, x) for x in ("kept", "redundant"))
    texts = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    least = texts.groupBy("h").agg(F.min("doc_id").alias("least"))
    sinks.write_split(texts.join(least, texts["h"].eqNullSafe(least["h"])).select("doc_id", (F.col("doc_id") == F.col("least")).alias("first")), "first", kept, rest)
    both = t.spark.read.parquet(kept).withColumn("side", F.lit("kept")).unionByName(t.spark.read.parquet(rest).withColumn("side", F.lit("redundant")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


_ROWS = """with b as (select event_id, value, user_id as u, event_type as e, json_extract_string(props, '$.k') as k, hour(ts) as h, (hour(ts) * 60 + minute(ts))::BIGINT as now,
  'turn 1: ' || case when value > 10 then 'Which timers run? -> Timers: ' || json_extract_string(props, '$.k') || ' minutes - ' || event_type || ', user ' || user_id || ' at ' || hour(ts) || ' min' when value > 5 then 'A timer? -> Timers: ' || json_extract_string(props, '$.k') || ' minutes - ' || event_type else 'hello -> Hi' end as t1,
  '{"hour":' || hour(ts) || ',"minute":' || minute(ts) || ',' as clock, '"label":"user ' || user_id || '",' as label, '"place":"zone ' || json_extract_string(props, '$.k') || '","uri":"content://' || json_extract_string(props, '$.k') || '",' as place,
  '"duration":"1 minutes",' as duration, '"extra":{"k":' || json_extract_string(props, '$.k') || ',"tags":["' || event_type || '",null]}' as extra from events),
n as (select *, (now + 35 + 10 * (event_id % 3)) % 1440 as new, case when value > 10 then h::VARCHAR else k end as lm, case when value > 10 then 'User ' || u else upper(e[1]) || e[2:] end as ll from b),
c as (select *, (case when (new // 60) % 12 = 0 then 12 else (new // 60) % 12 end) || ':' || lpad((new % 60)::VARCHAR, 2, '0') || ' ' || case when new < 720 then 'AM' else 'PM' end as due,
  (case when (now // 60) % 12 = 0 then 12 else (now // 60) % 12 end) || ':' || lpad((now % 60)::VARCHAR, 2, '0') || ' ' || case when now < 720 then 'AM' else 'PM' end as was,
  case e when 'click' then ['alarm_days', 'alarm_silent', 'alarm_label'][event_id % 3 + 1] when 'signup' then ['tone_by_id', 'tone_heard'][event_id % 2 + 1] when 'view' then 'place_there'
  when 'purchase' then case when value <= 5 then 'timer_none' when event_id % 3 = 2 then 'timer_after' when event_id % 3 = 1 and value > 10 then 'timer_second' else 'timer_last' end when 'error' then 'stop_after' end as template from n)
"""


def _records(t: Tables) -> DataFrame:
    """Events as records of five plans, with nested arguments and histories that list timers or don't."""
    lit, k, e = F.lit, F.get_json_object("props", "$.k"), F.col("event_type")
    plan = F.element_at(F.create_map(*(lit(x) for pair in zip(("click", "signup", "view", "purchase", "error"), ("edit_alarm", "set_tone", "navigate", "set_timer", "record_video")) for x in pair)), e)
    timers = F.concat(k, lit(" minutes - "), e)
    listed = F.when(F.col("value") > 10, F.concat(lit("Which timers run? -> Timers: "), timers, lit(", user "), "user_id", lit(" at "), F.hour("ts"), lit(" min"))).when(F.col("value") > 5, F.concat(lit("A timer? -> Timers: "), timers)).otherwise("hello -> Hi")
    args = F.struct(
        F.hour("ts").alias("hour"), F.minute("ts").alias("minute"), F.concat(lit("user "), "user_id").alias("label"), F.concat(lit("zone "), k).alias("place"), F.concat(lit("content://"), k).alias("uri"),
        lit("1 minutes").alias("duration"), F.struct(k.cast("int").alias("k"), F.array(e, lit(None)).alias("tags")).alias("extra"),
    )
    return t.events.select("event_id", plan.alias("plan"), F.concat(lit("do "), e).alias("query"), F.concat(lit("do "), e, lit(" for "), "user_id").alias("rewrited_query"), F.array(F.concat(lit("turn 1: "), listed), lit("turn 2: ok -> done")).alias("history"), F.to_json(args).alias("arguments"))


@query("UD12", _ROWS + """select event_id, template, case template when 'alarm_days' then 'Put it at ' || due || ' on weekdays' when 'alarm_silent' then 'That one at ' || due || ', without sound' when 'alarm_label' then 'Move it to ' || due || ' and call it user ' || u || ' again'
  when 'tone_by_id' then 'Take file ' || (event_id + 100) when 'tone_heard' then 'Take that one for calls' when 'place_there' then ['Take me', 'Show the way', 'Start the route'][event_id % 3 + 1] || ' there' when 'timer_last' then 'Another one like the last'
  when 'timer_second' then 'Another one like the second' when 'timer_after' then 'Ten minutes more after ' || ll when 'timer_none' then 'Another one, a short one' when 'stop_after' then 'Record for ' || [10, 15, 30, 45][event_id % 4 + 1] || ' seconds' else 'do ' || e end as query,
case template when 'alarm_days' then 'Put the ' || was || ' alarm at ' || due || ' on weekdays' when 'alarm_silent' then 'The ' || was || ' alarm at ' || due || ', without sound' when 'alarm_label' then 'Move the ' || was || ' alarm to ' || due || ' and call it user ' || u || ' again'
  when 'tone_by_id' then 'Take file ' || (event_id + 100) || ' as my tone' when 'tone_heard' then 'Take content://' || k || ' for calls' when 'place_there' then ['Take me', 'Show the way', 'Start the route'][event_id % 3 + 1] || ' to zone ' || k
  when 'timer_last' then 'Another timer of ' || lm || ' minutes like ' || ll when 'timer_second' then 'Another timer of ' || lm || ' minutes like ' || ll when 'timer_after' then 'A timer of 10 minutes after ' || ll when 'timer_none' then 'Another timer of 10 minutes'
  when 'stop_after' then 'Record a video and stop it after ' || [10, 15, 30, 45][event_id % 4 + 1] || ' seconds' else 'do ' || e || ' for ' || u end as rewrited_query,
case when template in ('tone_by_id', 'tone_heard') then 'turn 1: What tones are there? -> File ' || (event_id + 100) || ' is content://' || k else t1 end || '|turn 2: ok -> done' as history,
case when template in ('alarm_days', 'alarm_silent') then '{' || label || place || duration || extra || ',"hour":' || new // 60 || ',"minute":' || new % 60 || case template when 'alarm_days' then ',"days":[2,3,4,5,6]}' else ',"sound":false}' end
  when template = 'alarm_label' then '{' || place || duration || extra || ',"hour":' || new // 60 || ',"minute":' || new % 60 || ',"label":"user ' || u || ' again"}'
  when template in ('timer_last', 'timer_second') then clock || label || place || extra || ',"duration":"' || lm || ' minutes"}' when template = 'timer_after' then clock || label || place || extra || ',"duration":"10 minutes","silent":true}'
  when template = 'timer_none' then clock || label || place || extra || ',"duration":"10 minutes"}' else clock || label || place || duration || extra || '}' end as arguments from c""")
def ud12_mutators(t: Tables) -> DataFrame:
    out = hardening.harden_rows(_records(t), "plan", "event_id")
    return out.select("event_id", "template", "query", "rewrited_query", F.array_join("history", "|").alias("history"), "arguments")


@query("UD12", _ROWS + """select template, count(*)::BIGINT as rows, count(template)::BIGINT as query, count(template)::BIGINT as rewrited_query, count_if(template in ('tone_by_id', 'tone_heard'))::BIGINT as history, count_if(contains(template, 'alarm') or contains(template, 'timer'))::BIGINT as arguments from c group by template""")
def ud12_report(t: Tables) -> DataFrame:
    before = _records(t)
    return hardening.mutation_report(before, hardening.harden_rows(before, "plan", "event_id"), "event_id")
