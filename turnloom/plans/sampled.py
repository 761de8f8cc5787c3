"""Ranking windows, samples and splits (WN, SMP)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators import generation, ranking, sampling
from turnloom.operators.ranking import hash_order
from turnloom.plans.base import SCORED, scored
from turnloom.plans.relational import _md5
from turnloom.registry import Tables, query


@query("WN1", "select doc_id, lang from (select *, row_number() over (partition by text order by doc_id) as rn from documents) where rn = 1")
def wn1_keep_first(t: Tables) -> DataFrame:
    return ranking.keep_first(t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("text")), ["text"], ["doc_id"]).select("doc_id", "lang")


@query("WN2", "select doc_id from (select *, lang = 'en' as free, row_number() over (partition by text, lang = 'en' order by doc_id) as rn from documents) where free or rn = 1")
def wn2_keep_first_exempt(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("text"))
    return ranking.keep_first_exempt(rows, ["text"], ["doc_id"], F.col("lang") == "en").select("doc_id")


@query("WN4", f"with d as (select *, row_number() over (partition by text order by {_md5('42', 'doc_id')}, doc_id) as rn from documents) select len(text) // 1000 as bin, count(*)::BIGINT as n, sum(doc_id)::BIGINT as ids from d where rn = 1 group by 1")
def wn4_shuffled_dedup(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.length("text").alias("size"), F.sha2("text", 256).alias("text"))
    first = ranking.keep_first(rows, ["text"], [hash_order(42, "doc_id"), F.col("doc_id")])
    return first.groupBy(F.floor(F.col("size") / 1000).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("WN5", "select source, doc_id from (select *, row_number() over (partition by source order by doc_id) as rn from documents) where rn <= 5")
def wn5_head_n(t: Tables) -> DataFrame:
    return ranking.head_n(t.documents.select("source", "doc_id"), ["source"], ["doc_id"], 5)


_LADDER = "case when n > 800 then 0.04::DOUBLE when n > 500 then 0.05::DOUBLE when n > 250 then 0.1::DOUBLE when n > 150 then 0.2::DOUBLE when n > 100 then 0.1::DOUBLE end"
_QUOTAS = f"""with p as (select event_type as plan, count(*) as n from events group by 1), g as (select event_type as plan, user_id, count(*) as c, min(event_id) as first_pos from events group by 1, 2),
f as (select g.*, greatest(1, floor(c * {_LADDER}))::BIGINT as f_cnt from g join p using (plan) where n > 100),
q as (select plan, user_id, first_pos, f_cnt, case when coalesce(sum(f_cnt) over (partition by plan order by first_pos rows between unbounded preceding and 1 preceding), 0) > 50 then 0 else f_cnt end::BIGINT as quota from f)
"""


def quotas(t: Tables) -> DataFrame:
    sizes = t.events.groupBy(F.col("event_type").alias("plan")).agg(F.count(F.lit(1)).alias("n")).filter("n > 100")
    groups = t.events.groupBy(F.col("event_type").alias("plan"), "user_id").agg(F.count(F.lit(1)).alias("c"), F.min("event_id").alias("first_pos"))
    share = F.greatest(F.lit(1), F.floor(F.col("c") * ranking.quota_ladder(F.col("n")))).cast("long")
    return ranking.budgeted(groups.join(sizes, "plan").withColumn("f_cnt", share), "plan", "first_pos", "f_cnt", 50).select("plan", "user_id", "first_pos", "f_cnt", "quota")


@query("WN7", _QUOTAS + "select * from q")
def wn7_running_budget(t: Tables) -> DataFrame:
    return quotas(t)


@query("WN8 SNK5", _QUOTAS + """, r as (select event_id, event_type as plan, user_id, row_number() over (partition by event_type, user_id order by event_id) as rn from events)
select event_id, quota is null or rn <= quota as kept from r left join q using (plan, user_id)""")
def wn8_consume_quota(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.col("event_type").alias("plan"), "user_id")
    return ranking.consume_quota(rows, ["plan", "user_id"], ["event_id"], quotas(t)).select("event_id", "kept")


@query("WN13 WN14", "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 20")
def wn14_top_k(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


@query("WN15 WN18", "select (row_number() over (order by o_orderkey))::BIGINT as serial, o_orderkey, 'S' || o_custkey || '-' || row_number() over (partition by o_custkey order by o_orderkey) || '_NR' as unique_idx from orders where o_orderpriority = '1-URGENT'")
def wn18_serials(t: Tables) -> DataFrame:
    rows = ranking.ranked(t.orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], "k")
    return ranking.serials(rows, F.col("o_orderkey"), ["o_orderkey"], "serial").select("serial", "o_orderkey", F.concat(F.lit("S"), "o_custkey", F.lit("-"), "k", F.lit("_NR")).alias("unique_idx"))


@query("WN16", "with n as (select c_nationkey, c_custkey, (row_number() over (partition by c_nationkey order by c_custkey) - 1) // 10 as chunk from customer) select c_nationkey, chunk::BIGINT as chunk, string_agg(c_custkey::VARCHAR, ',' order by c_custkey) as ids from n group by c_nationkey, chunk")
def wn16_chunks(t: Tables) -> DataFrame:
    out = ranking.chunks(t.customer.select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], 10, "c_custkey")
    return out.select("c_nationkey", "chunk", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("ids"))


@query("WN17", "select l_partkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as rn from lineitem) where rn <= 61")
def wn17_prompt_cap(t: Tables) -> DataFrame:
    return ranking.head_n(t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber"), ["l_partkey"], ["l_orderkey", "l_linenumber"], 61)


@query("WN19", SCORED + "select plan, lang, count(*)::BIGINT as n from scored group by plan, lang having count(*) <= 3")
def wn19_low_support(t: Tables) -> DataFrame:
    return scored(t).groupBy("plan", "lang").agg(F.count(F.lit(1)).alias("n")).filter("n <= 3")


_SPLIT = f"""with r as (select doc_id, source, row_number() over (partition by source order by {_md5('3', 'doc_id')}, doc_id) as rn, count(*) over (partition by source) as n from documents),
s as (select *, case when n = 1 then 0 else floor(n * 0.7::DOUBLE)::BIGINT end as train from r)
"""


@query("SMP1 SMP3", _SPLIT + "select doc_id, source, case when rn <= least(train, 25) then 'train' when rn > train and (train <= 25 or rn <= train + 25) then 'test' end as part from s")
def smp1_stratified_split(t: Tables) -> DataFrame:
    return sampling.stratified_split(t.documents.select("doc_id", "source"), "source", "doc_id", 0.7, 25, 3)


@query("SMP2", _SPLIT.replace("documents)", "documents where lang <> 'en')") + "select doc_id, case when rn <= least(train, case when source < 'src2' then 5 else 10 end) then 'train' when rn > train then 'test' end as part from s where source is not null")
def smp2_weighted_split(t: Tables) -> DataFrame:
    rows = t.documents.filter("lang <> 'en'").select("doc_id", "source")
    small = sampling.stratified_split(rows.filter("source < 'src2'"), "source", "doc_id", 0.7, 5, 3)
    large = sampling.stratified_split(rows.filter("source >= 'src2'"), "source", "doc_id", 0.7, 10, 3)
    full = sampling.stratified_split(rows, "source", "doc_id", 0.7, 10**9, 3).select("doc_id", F.col("part").alias("full"))
    both = small.unionByName(large).join(full, "doc_id")
    return both.select("doc_id", F.when(F.col("part") == "train", "train").when(F.col("full") == "test", "test").alias("part"))


@query("SMP4", f"select doc_id from (select *, row_number() over (partition by source order by {_md5('9', 'doc_id')}, doc_id) as rn, count(*) over (partition by source) as n from documents) where n <= 50 or rn <= round_even(n * 0.25::DOUBLE, 0)")
def smp4_fraction(t: Tables) -> DataFrame:
    return sampling.fraction_sample(t.documents.select("doc_id", "source"), ["source"], "doc_id", 0.25, 50, 9).select("doc_id")


@query("SMP5", f"select lang, doc_id from (select *, row_number() over (partition by lang order by {_md5('5', 'doc_id')}, doc_id) as rn from documents) where rn <= 7")
def smp5_fixed_n(t: Tables) -> DataFrame:
    return sampling.capped_sample(t.documents.select("lang", "doc_id"), ["lang"], "doc_id", 7, 5)


@query("SMP6", f"""with a as (select lang, source, doc_id, row_number() over (partition by lang, source order by {_md5('6', 'doc_id')}, doc_id) as rn from documents),
b as (select *, row_number() over (partition by lang order by {_md5('6', 'doc_id')}, doc_id) as r2 from a where rn <= 3) select lang, source, doc_id from b where r2 <= 20""")
def smp6_two_stage_quota(t: Tables) -> DataFrame:
    first = sampling.capped_sample(t.documents.select("lang", "source", "doc_id"), ["lang", "source"], "doc_id", 3, 6)
    return sampling.capped_sample(first, ["lang"], "doc_id", 20, 6)


@query("SMP7 WN19", """with c as (select source as plan, count(*) as n from documents group by 1), f as (select *, least(n, 4)::BIGINT as fl, n - least(n, 4) as room from c),
k as (select *, (120 - sum(fl) over ()) as remaining, sum(room) over () as rooms from f), e as (select *, (remaining * room)::DOUBLE / rooms as exact from k), g as (select *, floor(exact)::BIGINT as base, exact - floor(exact) as frac from e),
h as (select *, row_number() over (order by frac desc, n desc, plan) as rk, remaining - sum(base) over () as rest from g)
select plan, (fl + base + case when rk <= rest then 1 else 0 end)::BIGINT as alloc from h""")
def smp7_apportion(t: Tables) -> DataFrame:
    counts = t.documents.groupBy(F.col("source").alias("plan")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.apportion(counts, "plan", 120, 4)


@query("SMP8", f"select source, doc_id from (select source, doc_id, row_number() over (partition by source order by {_md5('8', 'doc_id')}, doc_id) as rn from documents) order by rn, source limit 50")
def smp8_round_robin(t: Tables) -> DataFrame:
    return ranking.round_robin(t.documents.select("source", "doc_id"), "source", [hash_order(8, "doc_id"), F.col("doc_id")], 50)


@query("SMP8", f"""with s as (select source, count(*) as k, ceil(500.0::DOUBLE / count(*) over ())::BIGINT as turns from documents group by source),
p as (select d.source, d.doc_id, r.pass, s.k, s.turns from documents d join s using (source), range(0, 500) r(pass) where r.pass * s.k < s.turns),
x as (select *, pass * k + row_number() over (partition by source, pass order by md5('18:' || pass || ':' || doc_id), doc_id) as turn from p)
select source, doc_id, turn from x where turn <= turns order by turn, source limit 500""")
def smp8_round_robin_reuse(t: Tables) -> DataFrame:
    return ranking.round_robin_reuse(t.documents.select("source", "doc_id"), "source", "doc_id", 500, 18)


_PLANS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "OCEANIA", "ARCTIC"]


@query("SMP9 JN20", f"""with p(x) as (values {", ".join(f"('{x}')" for x in _PLANS)}), g as (select n_nationkey, r_name as gold from nation join region on n_regionkey = r_regionkey),
o as (select n_nationkey, gold, x, {_md5('1', 'n_nationkey', 'x')} as h, row_number() over (partition by n_nationkey order by {_md5('1', 'n_nationkey', 'x')}) as rn from g, p where x <> gold),
a as (select n_nationkey, x, h from o where rn <= 4 union all select n_nationkey, gold, {_md5('1', 'n_nationkey', 'gold')} from g)
select n_nationkey, string_agg(x, ',' order by h) as candidates from a group by 1""")
def smp9_candidates(t: Tables) -> DataFrame:
    gold = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("gold"))
    return sampling.distractors(gold, "gold", "n_nationkey", _PLANS, 4, 1).select("n_nationkey", F.array_join("candidates", ",").alias("candidates"))


_TOOLS = {x: f"Serves {x.lower()}.\nMore on it." for x in _PLANS}


def _picks(prompt: str, temperature: float) -> str:
    """A stand-in generator: two tools by the length of the request, and one that isn't known."""
    n = len(prompt.rpartition("\nRequest: ")[2])
    return json.dumps([_PLANS[n % 7], "NOWHERE", _PLANS[(n + 1) % 7]])


@query("UD8", f"""with p(place, x) as (values {", ".join(f"({i}, '{x}')" for i, x in enumerate(_PLANS))}), g as (select conv_id, turn, length(text) as n, conv_id * 1000 + turn as k from conversations),
o as (select conv_id, turn, string_agg(x, ',' order by h) as others from (select g.*, x, h, row_number() over (partition by k order by h) as rn from (select g.*, x, {_md5('19', 'k', 'x')} as h from g, p where place <> n % 7) g) where rn <= 3 group by 1, 2)
select conv_id, turn, a.x || ',' || others as fake, a.x || ',' || b.x as model from g join o using (conv_id, turn) join p a on a.place = n % 7 join p b on b.place = (n + 1) % 7""")
def ud8_retrievers(t: Tables) -> DataFrame:
    """Four tools with the gold one among them, and those a generator picks from the catalog."""
    gold = F.array(F.get(F.array(*map(F.lit, _PLANS)), F.length("text") % 7))
    rows = t.conversations.select("conv_id", "turn", "text", gold.alias("gold"), (F.col("conv_id") * 1000 + F.col("turn")).alias("k"))
    fake = sampling.gold_and_others(rows, "gold", "k", _PLANS, 4, 19).withColumnRenamed("tools", "fake")
    return generation.model_retrieve(fake, "text", _TOOLS, 2, _picks).select("conv_id", "turn", F.array_join("fake", ",").alias("fake"), F.array_join("tools", ",").alias("model"))


@query("SMP10", f"""with g as (select conv_id, row_number() over (order by {_md5('11', 'conv_id')}, conv_id) as rn, count(*) over () as n from (select distinct conv_id from conversations))
select c.conv_id, c.turn, case when rn <= round_even(n * 0.8::DOUBLE, 0) then 'train' when rn <= round_even(n * 0.8::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) then 'valid' else 'test' end as part from conversations c join g using (conv_id)""")
def smp10_group_split(t: Tables) -> DataFrame:
    return sampling.group_split(t.conversations.select("conv_id", "turn"), "conv_id", 0.8, 0.1, 11)


_MIX = {"de": 0.25, "fr": 0.25, "en": 0.5}


@query("SMP11", f"""with p(lang, n) as (values ('de', round_even(42 * 0.25::DOUBLE, 0)), ('fr', round_even(42 * 0.25::DOUBLE, 0)), ('en', 42 - 2 * round_even(42 * 0.25::DOUBLE, 0))),
r as (select lang, doc_id, row_number() over (partition by lang order by {_md5('17', 'doc_id')}, doc_id) as rn from documents) select lang, doc_id from r join p using (lang) where rn <= n""")
def smp11_mixture(t: Tables) -> DataFrame:
    return sampling.mixture(t.documents.select("lang", "doc_id"), "lang", "doc_id", 42, _MIX, 17)


@query("SMP12", f"""with a as (select doc_id, row_number() over (order by doc_id) as rn from documents where lang = 'de'), b as (select event_id, row_number() over (order by {_md5('12', 'event_id')}, event_id) as rn from events)
select doc_id, event_id from a join b using (rn)""")
def smp12_without_replacement(t: Tables) -> DataFrame:
    rows = t.documents.filter("lang = 'de'").select("doc_id")
    return sampling.take_in_turn(rows, F.col("doc_id"), ["doc_id"], t.events.select("event_id"), "event_id", 12)


@query("SMP13", f"""with s as (select lang, count(*) as n from documents group by 1), w as (select lang, n, draw from s, range(1, 11) r(draw)),
d as (select lang, draw, (('0x' || substr({_md5('13', 'lang', 'draw')}, 1, 12))::BIGINT % n) + 1 as rn from w), r as (select lang, doc_id, row_number() over (partition by lang order by {_md5('13', 'doc_id')}, doc_id) as rn from documents)
select lang, draw::INT as draw, doc_id from d join r using (lang, rn)""")
def smp13_with_replacement(t: Tables) -> DataFrame:
    return sampling.with_replacement(t.documents.select("lang", "doc_id"), ["lang"], "doc_id", 10, 13)


@query("SMP14", f"""with r as (select lang, doc_id, row_number() over (partition by lang order by {_md5('14', 'doc_id')}, doc_id) as rn from documents where lang in ('de', 'fr'))
select lang, doc_id, round(rn / case lang when 'de' then 0.25::DOUBLE else 0.75::DOUBLE end, 9) as time from r""")
def smp14_interleave(t: Tables) -> DataFrame:
    rows = t.documents.filter(F.col("lang").isin("de", "fr")).select("lang", "doc_id")
    return sampling.interleave(rows, "lang", "doc_id", {"de": 0.25, "fr": 0.75}, 14).withColumn("time", F.round("time", 9))


@query("SMP15", f"""with c as (select source, count(*) as n from documents group by 1), need as (select source, 60 - n as want from c where n < 60),
s as (select source, k from need, range(1, 61) r(k) where k <= want), s1 as (select source, row_number() over (order by crc32(source), source, k) as rn from s), s2 as (select event_id, row_number() over (order by {_md5('15', 'event_id')}, event_id) as rn from events)
select source as plan, event_id from s1 join s2 using (rn)""".replace("crc32(source), ", ""))
def smp15_fill_deficits(t: Tables) -> DataFrame:
    """Slots are few: at most 60 for each source that has fewer rows."""
    want = t.documents.groupBy(F.col("source").alias("plan")).agg((F.lit(60) - F.count(F.lit(1))).cast("int").alias("want")).filter("want > 0")
    slots = want.select("plan", F.explode(F.sequence(F.lit(1), "want")).alias("k"))
    return sampling.take_in_turn(slots, F.lit(0).cast("long"), ["plan", "k"], t.events.select("event_id"), "event_id", 15).select("plan", "event_id")


@query("SMP16", "with r as (select event_id, (row_number() over (order by event_id) - 1) // 7 as w from events) select w as \"window\", count(*) as n, string_agg(event_id, ',' order by event_id) as ids from r group by w")
def smp16_line_windows(t: Tables) -> DataFrame:
    windows = ranking.line_windows(t.events.select("event_id"), F.col("event_id"), ["event_id"], 7, "event_id")
    return windows.select("window", F.size("values").cast("long").alias("n"), F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("ids"))


@query("SMP16", f"select doc_id from documents order by {_md5('16', 'doc_id')}, doc_id limit 25")
def smp16_list_sampler(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").orderBy(hash_order(16, "doc_id"), "doc_id").limit(25)
