"""Scalar functions over strings, histories, literals and vectors (SC, UD)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import history as H
from turnloom.functions import literals, strings, tokens
from turnloom.operators import generation, matching, retrieval, similarity
from turnloom.plans.base import HISTORY, history
from turnloom.registry import Tables, query
from turnloom.shared import stored


def joined(c) -> F.Column:
    return F.array_join(c, "|")


@query("SC1", r"select doc_id, md5(trim(regexp_replace(text, '[\t\n\x0b\f\r ]+', ' ', 'g'))) as h from documents")
def sc1_blanks(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(strings.normalise_blanks(F.col("text"))).alias("h"))


@query("SC2", HISTORY + r"select conv_id, array_to_string(list_transform(h, lambda x, i: 'turn ' || i || ': ' || regexp_replace(x, '(?i)^\s*turn\s+\d+\s*:\s*', '')), '|') as h from (select conv_id, list_reverse(h) as h from history)")
def sc2_relabel(t: Tables) -> DataFrame:
    return history(t).select("conv_id", joined(H.relabel(F.reverse("h"))).alias("h"))


@query("SC3", "select doc_id, md5(trim(case when p is null then text else substr(text, 1, p - 1) end)) as h from (select doc_id, text, least(nullif(instr(text, chr(10)), 0), nullif(instr(text, '. '), 0)) as p from documents)")
def sc3_stop_markers(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(strings.cut_at_markers(F.col("text"), ["\n", ". "])).alias("h"))


@query("SC4", "select a.p_partkey as a, b.p_partkey as b from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey where levenshtein(a.p_name, b.p_name) <= 3")
def sc4_levenshtein(t: Tables) -> DataFrame:
    """Parts of a brand and size whose names differ little: near names first, then the parts that have them."""
    a = t.part.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("an"), "p_brand", "p_size")
    b = a.toDF("b", "bn", "p_brand", "p_size")
    near = matching.edit_join(t.part, "p_name", 3).select(F.col("a").alias("an"), F.col("b").alias("bn"))
    same = t.part.select(F.col("p_name").alias("an"), F.col("p_name").alias("bn")).distinct()
    both = near.unionByName(near.select(F.col("bn").alias("an"), F.col("an").alias("bn"))).unionByName(same)
    return a.join(both, "an").join(b, ["bn", "p_brand", "p_size"]).filter(F.col("a") < F.col("b")).select("a", "b")


@query("SC4", """with n as (select distinct p_name as w from part) select least((length(x.w), x.w), (length(y.w), y.w))[2] as a, greatest((length(x.w), x.w), (length(y.w), y.w))[2] as b, levenshtein(x.w, y.w)::INT as distance
from n x join n y on x.w < y.w where levenshtein(x.w, y.w) <= 3""")
def sc4_edit_join(t: Tables) -> DataFrame:
    return matching.edit_join(t.part, "p_name", 3)


# letters of one byte only, as the twin's edit distance is one of bytes
_LONG_WORDS = "regexp_extract_all(lower(text), '[a-z]{6,}')"


@query("SC4", f"""with n as (select distinct unnest({_LONG_WORDS}) as w from conversations) select least((length(x.w), x.w), (length(y.w), y.w))[2] as a, greatest((length(x.w), x.w), (length(y.w), y.w))[2] as b, levenshtein(x.w, y.w)::INT as distance
from n x join n y on x.w < y.w and abs(length(x.w) - length(y.w)) <= 1 where levenshtein(x.w, y.w) <= 1""")
def sc4_edit_words(t: Tables) -> DataFrame:
    words = t.conversations.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("w"))
    return matching.edit_join(words, "w", 1)


def _set(text: str, pattern: str, group: int = 0) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({text}, '{pattern}', {group})))"


def _sets(x: str) -> str:
    names = f"list_sort(list_distinct(list_transform(regexp_extract_all({x}, '{matching.INNER_CAPITAL}', 1), lambda w: lower(w))))"
    return "[" + ", ".join([_set(x, strings.PHONE), _set(x, strings.URI), _set(x, strings.EMAIL), _set(x, strings.STREET, 1), names]) + "]"


@query("SC4 SC5", f"""with p as (select x.conv_id, x.turn, coalesce(x.text, '') as a, coalesce(y.text, '') as b from conversations x join conversations y on y.conv_id = x.conv_id and y.turn = x.turn + 2),
m as (select conv_id, turn, levenshtein(a, b) <= 3 as close, {_sets("a")} = {_sets("b")} as same_entities from p) select *, close or same_entities as correct from m""")
def sc4_rewrite_match(t: Tables) -> DataFrame:
    """Each turn against the speaker's next one as its rewrite."""
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("a"))
    b = t.conversations.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", matching.rewrite_match(F.col("a"), F.col("b")).alias("m")).select("conv_id", "turn", "m.*")


def _found(text: str, pattern: str, group: int = 0) -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all({text}, '{pattern}', {group}))), '|')"


@query("SC5", rf"""select doc_id, {_found("text", strings.EMAIL)} as emails, {_found("text", strings.PHONE)} as phones, {_found("text", strings.URI)} as uris from documents""")
def sc5_entities(t: Tables) -> DataFrame:
    found = {"emails": strings.EMAIL, "phones": strings.PHONE, "uris": strings.URI}
    return t.documents.select("doc_id", *(joined(F.array_sort(strings.entities(F.col("text"), p))).alias(n) for n, p in found.items()))


_POST = "c_custkey || ' ' || c_mktsegment || ' Street, then ' || (c_custkey % 900) || ' Old Elm ave; tel 02-555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || ' or https://x.org/' || c_custkey"


@query("SC5", rf"""select c_custkey, {_found("s", strings.STREET, 1)} as streets, {_found("s", strings.PHONE)} as phones, {_found("s", strings.URI)} as uris from (select c_custkey, {_POST} as s from customer)""")
def sc5_streets(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    s = F.concat(key, F.lit(" "), "c_mktsegment", F.lit(" Street, then "), key % 900, F.lit(" Old Elm ave; tel 02-555-"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit(" or https://x.org/"), key)
    found = {"streets": strings.STREET, "phones": strings.PHONE, "uris": strings.URI}
    return t.customer.select("c_custkey", *(joined(F.array_sort(strings.entities(s, p))).alias(n) for n, p in found.items()))


@query("SC6", r"""select page_id, case s when '' then 'generic' when 'png' then 'image' when 'html' then 'code' when 'pdf' then 'pdf' when 'txt' then 'text' else 'other' end as kind, split_part(url, '/', 3) as host from (select *, lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) as s from pages)""")
def sc6_uri_kind(t: Tables) -> DataFrame:
    return t.pages.select("page_id", strings.suffix_kind(F.col("url")).alias("kind"), F.element_at(F.split("url", "/"), 3).alias("host"))


@query("SC7 SC8", "select distinct event_type, case event_type when 'click' then 'action_CLICK' when 'view' then 'View' else event_type end as plan, case when contains(event_type, 'purch') then 'buy' else event_type end as slug from events")
def sc7_plan_names(t: Tables) -> DataFrame:
    cands = F.array(F.lit("action_CLICK"), F.lit("View"), F.lit("signup"))
    exact = F.filter(cands, lambda c: c == F.col("event_type"))
    caseless = F.filter(cands, lambda c: F.lower(c) == F.lower("event_type"))
    bare = F.filter(cands, lambda c: F.regexp_replace(F.lower(c), "^action_", "") == F.regexp_replace(F.lower("event_type"), "^action_", ""))
    plan = F.coalesce(F.get(exact, 0), F.get(caseless, 0), F.get(bare, 0), F.col("event_type"))
    return t.events.select("event_type").distinct().select("event_type", plan.alias("plan"), strings.model_slug(F.col("event_type"), [("purch", "buy")]).alias("slug"))


@query("SC10", "select lang, printf('%.2f%%', count(*)::DOUBLE * 100 / (select count(*) from documents)) as pct from documents group by lang")
def sc10_percent(t: Tables) -> DataFrame:
    total = t.documents.agg(F.count(F.lit(1)).alias("all"))
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("lang", F.format_string("%.2f%%", F.col("n").cast("double") * 100 / F.col("all")).alias("pct"))


@query("SC12", HISTORY + "select conv_id, len(h)::BIGINT as n, split_part(regexp_replace(h[1], '^turn [0-9]+: ', ''), ' -> ', 1) as user, regexp_extract(h[1], '(?s)^.*? -> (.*)$', 1) as device from history")
def sc12_user_device(t: Tables) -> DataFrame:
    first = F.element_at("h", 1)
    return history(t).select("conv_id", F.size("h").cast("long").alias("n"), H.user_part(first).alias("user"), H.device_part(first).alias("device"))


@query("SC20", HISTORY + "select conv_id, array_to_string(h || ['turn ' || (len(h) + 1) || ': more -> done'], '|') as h from history")
def sc20_append(t: Tables) -> DataFrame:
    return history(t).select("conv_id", joined(H.append(F.col("h"), F.lit("more"), F.lit("done"))).alias("h"))


@query("SC21", HISTORY + "select conv_id, array_to_string(h[-2:], '|') as last2, array_to_string(h[-99:], '|') as every, '' as none from history")
def sc21_last_k(t: Tables) -> DataFrame:
    return history(t).select("conv_id", joined(H.last_k(F.col("h"), 2)).alias("last2"), joined(H.last_k(F.col("h"), 99)).alias("every"), joined(H.last_k(F.col("h"), 0)).alias("none"))


@query("SC22 JN18", HISTORY + "select a.conv_id, array_to_string(a.h[1:1] || b.h[2:], '|') as h from history a join history b on b.conv_id = a.conv_id + 1")
def sc22_splice(t: Tables) -> DataFrame:
    a = history(t)
    b = a.select((F.col("conv_id") - 1).alias("conv_id"), F.col("h").alias("other"))
    return a.join(b, "conv_id").select("conv_id", joined(H.splice(F.col("h"), F.col("other"), 1)).alias("h"))


@query("SC23", HISTORY + "select conv_id, array_to_string(list_transform(h, lambda x, i: case when i = 2 then 'turn 2: new' else x end), '|') as h from history")
def sc23_replace(t: Tables) -> DataFrame:
    return history(t).select("conv_id", joined(H.replace_at(F.col("h"), 1, F.lit("turn 2: new"))).alias("h"))


@query("SC24", HISTORY + r"select conv_id, array_to_string(list_transform(['turn 0: x -> y'] || h[1:1] || ['turn 0: v -> w'] || h[2:], lambda x, i: 'turn ' || i || ': ' || regexp_replace(x, '^turn \d+: ', '')), '|') as h from history")
def sc24_insert(t: Tables) -> DataFrame:
    return history(t).select("conv_id", joined(H.insert_at(F.col("h"), [1, 3], [F.lit("turn 0: x -> y"), F.lit("turn 0: v -> w")])).alias("h"))


@query("SC25", HISTORY + r"select conv_id, array_to_string(list_transform((['turn 1: a -> b', 'turn 2: c -> d', 'turn 3: e -> f'])[:greatest(3 - len(h), 0)] || h[-3:], lambda x, i: 'turn ' || i || ': ' || regexp_replace(x, '^turn \d+: ', '')), '|') as h from history")
def sc25_resize(t: Tables) -> DataFrame:
    template = F.array(*(F.lit(x) for x in ("turn 1: a -> b", "turn 2: c -> d", "turn 3: e -> f")))
    return history(t).select("conv_id", joined(H.resize(F.col("h"), 3, template)).alias("h"))


@query("SC26", HISTORY + "select conv_id, idx::BIGINT as idx, h[idx + 1] as turn from history, range(0, 50) r(idx) where idx < len(h) - 1")
def sc26_prior_turns(t: Tables) -> DataFrame:
    return history(t).select("conv_id", F.posexplode(F.slice("h", F.lit(1), F.greatest(F.size("h") - 1, F.lit(0)))).alias("idx", "turn")).withColumn("idx", F.col("idx").cast("long"))


@query("SC27 PRJ1", "select o_orderkey, c.c_mktsegment as plan, o.o_custkey::VARCHAR as id from orders o join customer c on o_custkey = c_custkey")
def sc27_lineage(t: Tables) -> DataFrame:
    u = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").select("o_orderkey", F.concat_ws("-", F.lit("ROOT"), F.lit("0"), "c_mktsegment", "o_custkey").alias("u"))
    last = F.element_at(H.lineage(F.col("u")), -1)
    return u.select("o_orderkey", last["plan"].alias("plan"), last["id"].alias("id"))


@query("SC66", "select event_id, ((m - 95) % 1440 + 1440) % 1440 as shifted, (case when (m // 60) % 12 = 0 then 12 else (m // 60) % 12 end) || ':' || lpad((m % 60)::VARCHAR, 2, '0') || ' ' || case when m < 720 then 'AM' else 'PM' end as clock from (select event_id, (hour(ts) * 60 + minute(ts))::BIGINT as m from events)")
def sc66_clock(t: Tables) -> DataFrame:
    m = t.events.select("event_id", (F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("m"))
    return m.select("event_id", strings.shift_minutes(F.col("m"), -95).alias("shifted"), strings.clock_12h(F.col("m")).alias("clock"))


@query("SC67", "select event_type, round(quantile_cont(value, 0.025), 9) as lo, round(quantile_cont(value, 0.975), 9) as hi from events group by event_type")
def sc67_percentile(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.025)), 9).alias("lo"), F.round(F.percentile("value", F.lit(0.975)), 9).alias("hi"))


@query("SC60", """with p as (select event_id, json_extract_string(props, '$.k')::BIGINT as k from events)
select event_id, k % 2 = 0 as plan, k % 3 = 0 as arguments, k % 6 = 0 as all_pass from p""")
def sc60_exact_match(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = t.events.select("event_id", k.alias("k")).withColumn("gold", F.to_json(F.struct(F.lit("p0").alias("plan"), F.lit(0).alias("n")))).withColumn("pred", F.to_json(F.struct(F.concat(F.lit("p"), (F.col("k") % 2).cast("string")).alias("plan"), (F.col("k") % 3).cast("int").alias("n"))))
    plan = F.get_json_object("gold", "$.plan") == F.get_json_object("pred", "$.plan")
    args = F.get_json_object("gold", "$.n") == F.get_json_object("pred", "$.n")
    return e.select("event_id", plan.alias("plan"), args.alias("arguments"), (plan & args).alias("all_pass"))


@query("SC65 UD8", """with q as (select vec_id, embedding from embeddings where vec_id % 20 = 0),
s as (select q.vec_id as query, e.vec_id as item, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 9) as score from q, embeddings e where q.vec_id <> e.vec_id)
select query, item, round(score, 6) as score, rk::BIGINT as rank from (select *, row_number() over (partition by query order by score desc, item) as rk from s) where rk <= 5""")
def sc65_top_k(t: Tables) -> DataFrame:
    out = retrieval.top_k(t.embeddings.filter("vec_id % 20 = 0"), t.embeddings, "vec_id", "vec_id", "embedding", 5)
    return out.withColumn("score", F.round("score", 6))


@query("UD8")
def ud8_inverted_lists(t: Tables) -> DataFrame:
    """Ten neighbours of every vector whose id is divisible by 20, by an index over all; tests hold the recall at 0.9 or more."""
    index = retrieval.build_index(t.embeddings, "vec_id", "embedding", 10)
    return retrieval.search(index, t.embeddings.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10).withColumn("score", F.round("score", 6))


_CHOSEN = r"""with w as (select conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from conversations),
g as (select conv_id, turn, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as gram from w),
tf as (select conv_id, turn, gram, count(*)::DOUBLE as tf from g group by all), df as (select gram, count(*)::DOUBLE as df from tf group by gram),
v as (select conv_id, turn, gram, (1 + ln(tf)) * (1 + ln((1 + (select count(*) from conversations))::DOUBLE / (1 + df))) as weight from tf join df using (gram)),
n as (select conv_id, turn, sqrt(sum(weight * weight)) as norm from v group by all), e as (select conv_id, max(turn) as last from conversations group by conv_id),
q as (select v.conv_id, gram, weight / norm as want from v join n using (conv_id, turn) join e on e.conv_id = v.conv_id and e.last = v.turn),
c as (select v.conv_id, v.turn, sum(weight / norm * want) as cosine from v join n using (conv_id, turn) join q on q.conv_id = v.conv_id and q.gram = v.gram group by all),
s as (select x.conv_id, x.turn, text, round(coalesce(cosine, 0) + 0.1::DOUBLE * case when last = 1 then 1.0::DOUBLE else x.turn::DOUBLE / (last - 1) end, 9) as score
      from conversations x join e on e.conv_id = x.conv_id left join c on c.conv_id = x.conv_id and c.turn = x.turn where x.turn < last),
r as (select *, row_number() over (partition by conv_id order by score desc, turn) as by_score from s),
b as (select *, row_number() over (partition by conv_id order by turn) as place from r where by_score <= 2)
"""


@query("SC65", _CHOSEN + "select conv_id, turn::BIGINT as turn, round(score, 6) as score, by_score::BIGINT as by_score, place::BIGINT as place from b")
def sc65_history_cosine(t: Tables) -> DataFrame:
    """The two earlier turns of every conversation that are most like its last one, by score and in their own order."""
    chosen = retrieval.select_history(t.conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "text"), 2, 0.1)
    return chosen.select("conv_id", "turn", F.round("score", 6).alias("score"), "by_score", "place")


@query("SC65", _CHOSEN + """select conv_id, md5(string_agg('turn ' || place || ': ' || coalesce(text, ''), '|' order by place)) as original,
md5(string_agg('turn ' || (turn + 1) || ': ' || coalesce(text, ''), '|' order by by_score)) as by_score from b group by conv_id""")
def sc65_select_turns(t: Tables) -> DataFrame:
    """The chosen turns as histories: in their own order with new numbers, and by score with their own."""
    turns = t.conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    chosen = retrieval.select_history(turns, 2, 0.1)
    original = retrieval.formatted_history(chosen, turns, "original", renumber=True).select("conv_id", F.md5(joined("history")).alias("original"))
    by_score = retrieval.formatted_history(chosen, turns, "score").select("conv_id", F.md5(joined("history")).alias("by_score"))
    return original.join(by_score, "conv_id")


def _prompted(t: Tables) -> DataFrame:
    prompts = t.conversations.filter("role = 'user'").select("conv_id", "turn", generation.render("Plan for: %s", ["text"]).alias("prompt"))
    return generation.generate(prompts, "prompt", generation.stub, literals.parses)


@query("UD4 UD5 UD7 UD11 SC45")
def ud4_generate(t: Tables) -> DataFrame:
    out = _prompted(t)
    read = literals.read_generation(F.col("output"))
    return out.select("conv_id", "turn", "attempts", "valid", "error", read.alias("r")).select("conv_id", "turn", "attempts", "valid", "error", "r.call", "r.parser")


_H = "('0x' || substr(h, {}, 16))::UBIGINT::HUGEINT"
_MOD = f"((({_H.format(1)} % {{m}}) * (18446744073709551616 % {{m}}) + {_H.format(17)} % {{m}}) % {{m}})"


@query("UD5 UD6 UD4 UD7", f"""with p as (select conv_id, turn, md5('Ask: ' || coalesce(text, '')) as h from conversations where role = 'user')
select conv_id, turn, case when {_MOD.format(m=9)} = 0 then 2 else 1 end::INT as attempts, 'plan_' || {_MOD.format(m=5)} as plan, {_MOD.format(m=100)}::BIGINT as n from p""")
def ud6_watched_run(t: Tables) -> DataFrame:
    """Four prompts of each task in flight, written by a run that a quota error would cancel."""
    watch = generation.QuotaWatch(t.spark)
    prompts = t.conversations.filter("role = 'user'").select("conv_id", "turn", generation.render("Ask: %s", ["text"]).alias("prompt"))
    asked = generation.generate(prompts, "prompt", generation.stub, literals.parses, in_flight=4, watch=watch)
    out = watch.run(lambda: stored(asked, "watched-run"))
    return out.select("conv_id", "turn", "attempts", F.get_json_object("output", "$.plan").alias("plan"), F.get_json_object("output", "$.arguments.n").cast("long").alias("n"))


@query("SC40 SC44 SC48 SC28", """select event_id, '{"arguments":{"k":' || json_extract_string(props, '$.k') || ',"n":null,"v":1},"plan":"' || event_type || '"}' as parsed from events""")
def sc44_literals(t: Tables) -> DataFrame:
    return _literals(t.events)


def _literals(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    raw = F.concat(F.lit("noise [{'plan': ' "), "event_type", F.lit("', 'arguments': {'v': True, 'n': None, 'k': "), k, F.lit("}}] tail"))
    return events.select("event_id", F.explode(literals.extract_embedded(raw)).alias("parsed"))


@query("SC41 SC42 SC43", """select event_id, '{"k":' || json_extract_string(props, '$.k') || '}' as fenced, '{"k":' || json_extract_string(props, '$.k') || '}' as first from events""")
def sc41_markdown(t: Tables) -> DataFrame:
    return _markdown(t.events)


def _markdown(events: DataFrame) -> DataFrame:
    e = events.select("event_id", "props")
    return e.select("event_id", literals.extract_markdown(F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).alias("fenced"), literals.extract_first(F.concat(F.lit("{bad "), "props", F.lit("}"))).alias("first"))


@query("SC46 SC11", """select event_id, '{"arguments":{"arg0":"' || event_type || '","n":' || json_extract_string(props, '$.k') || '},"plan":"act","result":"result1"}' as call from events""")
def sc46_calls(t: Tables) -> DataFrame:
    return _calls(t.events)


def _calls(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    raw = F.concat(F.lit("result1 = act(n="), k, F.lit(", '"), "event_type", F.lit("')"))
    return events.select("event_id", F.explode(literals.extract_calls(raw)).alias("call"))


def _variant(*options) -> F.Column:
    """One of the given texts per event, in turn."""
    return F.get(F.array(*(x if isinstance(x, F.Column) else F.lit(x) for x in options)), (F.col("event_id") % len(options)).cast("int"))


_RAW = """select event_id, trim(case event_id % 9 when 0 then ' ' when 1 then props || chr(10) || props when 2 then props || ' , ' || props when 3 then '{' || props when 4 then props || '}}'
when 5 then '{"k": -1"}' when 6 then '{"k": null"}' when 7 then '{"a": {' else event_type end) as raw from events"""


@query("SC9", rf"""with r as ({_RAW}), m as (select *, length(raw) - length(replace(raw, '{{', '')) - length(raw) + length(replace(raw, '}}', '')) as missing from r)
select case when raw = '' then 'empty_raw' when contains(raw, chr(10) || '{{') then 'two_json_objects_newline' when regexp_matches(raw, '\}}\s*,\s*\{{') then 'two_objects_comma_split'
when missing > 0 then 'truncated_missing_' || missing || '_brace' when missing < 0 then 'extra_' || (-missing) || '_closing_brace' when regexp_matches(raw, '"[A-Za-z0-9_]+"\s*:\s*-?\d+"') then 'number_then_stray_quote'
when regexp_matches(raw, '"[A-Za-z0-9_]+"\s*:\s*(true|false|null)"') then 'bool_or_null_then_stray_quote' else 'other_malformed_json' end as kind, count(*)::BIGINT as n from m group by 1""")
def sc9_error_classes(t: Tables) -> DataFrame:
    p = F.col("props")
    raw = _variant(" ", F.concat(p, F.lit("\n"), p), F.concat(p, F.lit(" , "), p), F.concat(F.lit("{"), p), F.concat(p, F.lit("}}")), '{"k": -1"}', '{"k": null"}', '{"a": {', F.col("event_type"))
    return t.events.select(strings.raw_error(raw).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SC13", """select event_id, d as descriptor, case when d = '' then 'Updated Alarm' else event_type end as label, case when d = '' then 'that time' else '7:05 AM' end as time, k || ':' || event_type || '|' || k || ':tea' as timers
from (select *, case event_id % 3 when 0 then 'alarm_id: ' || event_id || ' - 7:05 AM, ' || event_type || ', daily' when 1 then 'alarm_id: ' || event_id || ' - 7:05 AM, ' || event_type else '' end as d, json_extract_string(props, '$.k') as k from events)""")
def sc13_descriptors(t: Tables) -> DataFrame:
    key, kind, k = F.col("event_id").cast("string"), F.col("event_type"), F.get_json_object("props", "$.k")
    alarm = F.concat(F.lit("alarm_id: "), key, F.lit(" - 7:05 AM, "), kind)
    text = _variant(F.concat(F.lit("Set '"), alarm, F.lit(", daily' again.")), F.concat(F.lit("Move "), alarm, F.lit(". Thanks, all.")), "no alarm")
    turn = F.concat(F.lit("turn 1: Which timers? -> Timers: "), k, F.lit(" minutes – "), kind, F.lit("; the tea with "), k, F.lit(" minutes to go, ["), k, F.lit(" min - "), F.upper(kind), F.lit("]"))
    d = strings.alarm_descriptor(text)
    out = t.events.select("event_id", d.alias("descriptor"), strings.alarm_label(d).alias("label"), strings.alarm_time(d).alias("time"), strings.timer_items(turn).alias("found"))
    return out.select("event_id", "descriptor", "label", "time", joined(F.transform("found", lambda x: F.concat(x["minutes"], F.lit(":"), x["label"]))).alias("timers"))


@query("SC29", """select event_id, '{"attachments":["' || event_type || '"],"k":"' || json_extract_string(props, '$.k') || '","name":"free"}' as arguments from events""")
def sc29_list_arguments(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    values = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("free"), F.lit("k"), k, F.lit("attachments"), "event_type")).otherwise(F.array(F.lit("attachments"), F.col("event_type"), F.lit("free"), F.lit("k"), k))
    names = F.array(*(F.lit(x) for x in ("name", "k", "attachments")))
    return t.events.select("event_id", literals.assign_values(values, names).alias("arguments"))


@query("SC30", HISTORY + """select conv_id, case conv_id % 4 when 2 then 1 when 3 then 0 else len(h) end::BIGINT as n, case conv_id % 4 when 2 then '1' when 3 then '' else array_to_string(list_transform(h, lambda x, i: i::VARCHAR), ',') end as ids,
md5(case conv_id % 4 when 2 then 'said' when 3 then '' else array_to_string(h, '|') end) as texts from history""")
def sc30_history_items(t: Tables) -> DataFrame:
    listed = F.to_json("h")
    quoted = F.concat(F.expr("substring(to_json(h), 1, length(to_json(h)) - 1)"), F.lit(", ' ']"))
    raw = F.get(F.array(listed, quoted, F.lit(" said "), F.lit("  ")), (F.col("conv_id") % 4).cast("int"))
    out = history(t).select("conv_id", literals.parse_history(raw).alias("x"))
    return out.select("conv_id", F.size("x").cast("long").alias("n"), F.array_join(F.transform("x", lambda x: x["turn_id"].cast("string")), ",").alias("ids"), F.md5(joined(F.transform("x", lambda x: x["text"]))).alias("texts"))


@query("SC47", """select event_id, case event_id % 9 when 0 then 'no_json_object_found' when 1 then 'ok' when 2 then 'missing_rewritten_query' when 3 then 'missing_confirmed_arguments' when 4 then 'confirmed_arguments_not_object' when 5 then 'ok' when 6 then 'missing_name' when 7 then 'arguments_not_object' else 'ok' end as code,
case event_id % 9 when 1 then '{"rewritten_query":"q"}' when 5 then '{"confirmed_arguments":{"k":' || json_extract_string(props, '$.k') || '},"rewritten_query":"q"}' when 8 then '{"arguments":{"k":' || json_extract_string(props, '$.k') || '},"name":"' || event_type || '"}' end as value from events""")
def sc47_output_contract(t: Tables) -> DataFrame:
    props = F.col("props")
    raw = _variant("none", 'so {"rewritten_query": " q "}', '{"query": "  "}', '{"rewrited_query": "q"}', '{"rewritten_query": "q", "confirmed_arguments": [1]}', F.concat(F.lit('{"query": "q", "confirmed_arguments": '), props, F.lit("}")), '{"arguments": {}}', '{"name": "n", "arguments": 3}', F.concat(F.lit('{"plan": " '), "event_type", F.lit(' ", "arguments": '), props, F.lit("}")))
    place = F.col("event_id") % 9
    out = t.events.select("event_id", literals.check_output(raw, F.when(place < 6, "rewrite").otherwise("call"), place == 3).alias("r"))
    return out.select("event_id", "r.code", "r.value")


@query("SC63", """with e as (select event_id, event_id % 7 <> 0 as parse_ok, event_id % 3 <> 0 as same_name, 3 as gold, 3 - (event_id % 4 = 0)::INT + (event_id % 5 = 0)::INT as pred, 1 + (event_id % 2 = 0)::INT + (event_id % 4 <> 0)::INT as matched from events),
m as (select *, matched::DOUBLE / pred as p, matched::DOUBLE / gold as r, matched = gold and pred = gold as exact from e)
select event_id, parse_ok and same_name as api_correct, exact as arg_exact_match, round(2 * p * r / (p + r), 9) as arg_f1, parse_ok and same_name and exact as final_exact from m""")
def sc63_argument_metrics(t: Tables) -> DataFrame:
    """Argument scores count whether or not the output parsed; the API and the whole call only if it did."""
    key, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    gold = F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("t"), F.lit(1).alias("c")))
    pred = F.to_json(F.struct(F.when(key % 2 == 0, k).otherwise(k + 1).alias("k"), F.concat(F.lit(" "), "event_type").alias("t"), F.when(key % 4 != 0, F.lit(True)).alias("c"), F.when(key % 5 == 0, 0).alias("x")))
    e = t.events.select("event_id", (key % 7 != 0).alias("parse_ok"), (key % 3 != 0).alias("same"), literals.count_arguments(gold, pred).alias("n"))
    return similarity.call_scores(e, "n", F.col("same"), F.col("parse_ok")).select("event_id", "api_correct", "arg_exact_match", F.round("arg_f1", 9).alias("arg_f1"), "final_exact")


@query("SC49", """select event_id, '{"arguments":{"k":' || json_extract_string(props, '$.k') || '},"plan":"p","rewrited_query":"' || event_type || '"}' as payload from events""")
def sc49_oneshot(t: Tables) -> DataFrame:
    return _oneshot(t.events)


def _oneshot(events: DataFrame) -> DataFrame:
    raw = F.concat(F.lit('{"rewrited_query": "'), "event_type", F.lit('", "plan": "p", "extra": 1, "arguments": '), "props", F.lit("}"))
    return events.select("event_id", literals.normalise_oneshot(raw).alias("payload"))


@query("SC50", "select n_nationkey, n_name || '(' || string_agg(r_name || '=?', ', ' order by r_name) || ')' as doc from nation, region where r_regionkey <> n_regionkey group by n_nationkey, n_name")
def sc50_tool_docs(t: Tables) -> DataFrame:
    args = t.nation.join(F.broadcast(t.region), F.col("r_regionkey") != F.col("n_regionkey")).groupBy("n_nationkey", "n_name").agg(F.array_sort(F.collect_list("r_name")).alias("a"))
    return args.select("n_nationkey", F.concat("n_name", F.lit("("), F.array_join(F.transform("a", lambda x: F.concat(x, F.lit("=?"))), ", "), F.lit(")")).alias("doc"))


@query("SC64 UD2")
def ud2_rouge_dedup(t: Tables) -> DataFrame:
    rows = t.conversations.select("role", "conv_id", "turn", "text")
    return similarity.greedy_dedup(rows, "role", ["conv_id", "turn"], "text", 0.7).select("role", "conv_id", "turn")


@query("UD1 PRJ14 SNK5", """select coalesce(case when trim(text) = '' then 'empty' when length(text) <= 20 then 'short' when role = 'system' then 'role' end, 'kept') as step, count(*)::BIGINT as n from conversations group by 1""")
def ud1_filter_chain(t: Tables) -> DataFrame:
    chain = generation.FilterChain().add("empty", F.trim("text") != "").add("short", F.length("text") > 20).add("role", F.col("role") != "system")
    return chain.apply(t.conversations).groupBy(F.coalesce("rejected_by", F.lit("kept")).alias("step")).agg(F.count(F.lit(1)).alias("n"))


@query("UD12", """select o_orderkey, case o_orderpriority when '1-URGENT' then 'now: ' || o_orderstatus when '5-LOW' then lower(o_orderstatus) else o_orderstatus end as o_orderstatus, o_orderpriority in ('1-URGENT', '5-LOW') as changed from orders""")
def ud12_harden(t: Tables) -> DataFrame:
    rules = {"1-URGENT": F.concat(F.lit("now: "), "o_orderstatus"), "5-LOW": F.lower("o_orderstatus")}
    return generation.harden(t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus"), "o_orderpriority", rules, "o_orderstatus").select("o_orderkey", "o_orderstatus", "changed")


@query("UD9", "select conv_id, turn, length(trim(text)) as n from conversations where role <> 'system' and trim(text) <> ''")
def ud9_map_rows(t: Tables) -> DataFrame:
    made = {"n": F.when((F.col("role") != "system") & (F.trim("text") != ""), F.length(F.trim("text")).cast("long"))}
    return generation.map_rows(t.conversations, made, remove=["role", "text"])


_WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


@query("SC68", f"""with w as (select conv_id, turn, {_WORDS.format("role || ' says ' || text")} as t, len({_WORDS.format("role || ' says'")}) as prefix from conversations),
i as (select conv_id, turn, least(prefix, len(t), 12) as start, list_transform(t[1:12], lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) as ids from w)
select conv_id, turn, array_to_string(ids, ',') as input_ids, array_to_string(list_transform(ids, lambda x, i: case when i <= start then -100 else x end), ',') as labels from i""")
def sc68_masked_labels(t: Tables) -> DataFrame:
    """Prompts of at most 12 tokens; the labels of the part before the answer are masked."""
    prompt, prefix = F.concat("role", F.lit(" says "), "text"), F.concat("role", F.lit(" says"))
    out = t.conversations.select("conv_id", "turn", strings.masked_labels(strings.word_ids(prompt), strings.word_ids(prefix), 12).alias("x"))
    return out.select("conv_id", "turn", *(F.array_join(F.transform(f"x.{c}", lambda v: v.cast("string")), ",").alias(c) for c in ("input_ids", "labels")))


#: The setting that names the file of a byte-pair vocabulary, and the file without it.
VOCABULARY, PUBLIC_VOCABULARY = "spark.turnloom.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _encode(t: Tables):
    return tokens.encoder(t.spark, t.spark.conf.get(VOCABULARY, PUBLIC_VOCABULARY))


@query("SC68")
def sc68_token_labels(t: Tables) -> DataFrame:
    """Token ids of every turn as a prompt, at most 512, and its labels with those of the part before the text masked; tests hold them to plain merges."""
    encode = _encode(t)
    ids = t.conversations.select("conv_id", "turn", encode(F.concat("role", F.lit(": "), "text")).alias("ids"), encode(F.concat("role", F.lit(":"))).alias("prefix"))
    out = ids.select("conv_id", "turn", F.size("ids").cast("long").alias("n_tokens"), strings.masked_labels(F.col("ids").cast("array<bigint>"), F.col("prefix").cast("array<bigint>"), 512).alias("x"))
    return out.select("conv_id", "turn", "n_tokens", "x.input_ids", "x.labels")


@query("AG20 SC68")
def ag20_prompt_tokens(t: Tables) -> DataFrame:
    """Tokens of each role's turns as the vocabulary cuts them: rows, sum, least, most, mean."""
    counted = tokens.token_counts(t.conversations.select("conv_id", "turn", "role", "text"), _encode(t), {"n": F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))})
    totals = counted.groupBy("role").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"))
    return totals


@query("UD13", "select lang, round(avg(case when quality = 0 then 1.0::DOUBLE else 0.0::DOUBLE end), 9) as bad_ratio from documents join labels using (doc_id) group by lang")
def ud13_bad_ratio(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang").agg(F.round(F.avg((F.col("quality") == 0).cast("double")), 9).alias("bad_ratio"))
