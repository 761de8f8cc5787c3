"""Joins, set operations, projections and predicates (JN, ST, PRJ)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.functions import literals, strings
from turnloom.operators import joins
from turnloom.operators.ranking import keep_last
from turnloom.plans.base import BUCKETS, SCORED, scored
from turnloom.registry import Tables, query

#: nation to region as plan-to-next-plan edges; region counts as wanted rows.
EDGES = "with edges as (select n_name as source, r_name as next from nation join region on n_regionkey = r_regionkey)"


def edges(t: Tables) -> DataFrame:
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("next"))


@query("JN1 WN3", """with b as (select o_custkey as c_custkey, o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders) where rn = 1)
select c_custkey, c_name, o_orderkey, o_orderpriority from customer join b using (c_custkey)""")
def jn1_last_wins_join(t: Tables) -> DataFrame:
    build = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    return joins.last_wins_join(t.customer.select("c_custkey", "c_name"), build, ["c_custkey"], ["o_orderkey"])


@query("JN2", "select o.o_orderkey, c.c_mktsegment as prev_plan, c.c_custkey || '-' || c.c_mktsegment || '-' || o.o_orderpriority as unique_idx from orders o join customer c on o.o_custkey = c.c_custkey where o.o_orderpriority is not null and o.o_orderstatus <> ''")
def jn2_next_turn_join(t: Tables) -> DataFrame:
    nxt = t.orders.filter("o_orderpriority is not null and o_orderstatus <> ''").select("o_orderkey", "o_custkey", "o_orderpriority")
    joined = nxt.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", F.col("c_mktsegment").alias("prev_plan"), F.concat_ws("-", "c_custkey", "c_mktsegment", "o_orderpriority").alias("unique_idx"))


@query("JN3", """with b as (select o_custkey as k, o_orderkey as b, row_number() over (partition by o_custkey order by o_orderkey) as rn, count(*) over (partition by o_custkey) as c from orders),
p as (select l_suppkey as k, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as rn from lineitem)
select p.k, l_orderkey, l_linenumber, b.b, b.rn::VARCHAR as u_key from p join b on p.k = b.k and p.rn = b.c - b.rn + 1""")
def jn3_bag_join_lifo(t: Tables) -> DataFrame:
    build = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("b"))
    probe = t.lineitem.select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber")
    return joins.bag_join(probe, build, ["k"], ["l_orderkey", "l_linenumber"], ["b"])


@query("JN4 JN16 JN22", "select d.doc_id, d.lang, coalesce(l.quality::VARCHAR, '') as quality from documents d left join (select doc_id, max(quality) as quality from labels group by 1) l using (doc_id)")
def jn22_write_back(t: Tables) -> DataFrame:
    last = keep_last(t.labels.select("doc_id", "quality"), ["doc_id"], ["quality"])
    return t.documents.select("doc_id", "lang").join(last, "doc_id", "left").select("doc_id", "lang", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("quality"))


@query("JN5", "select c_custkey, o_orderkey, case when o_orderkey is null then 'left_only' else 'both' end as merge, count(o_orderkey) over (partition by c_custkey)::BIGINT as fanout from customer left join orders on c_custkey = o_custkey")
def jn5_left_indicator(t: Tables) -> DataFrame:
    right = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.indicator_join(t.customer.select("c_custkey"), right, ["c_custkey"])


@query("JN8", "select doc_id, source from documents where doc_id not in (select doc_id from labels where quality = 0)")
def jn8_anti_verdict(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels.filter("quality = 0").select("doc_id"), "doc_id", "left_anti")


@query("PRJ13 JN8", "select doc_id, source from documents where doc_id % 9 not in (2, 3, 4, 5, 8)")
def prj13_failed_verdicts(t: Tables) -> DataFrame:
    said = ['"N/A"', '{"a": {"status": "Pass"}, "b": {"status": "Pass"}}', '{"a": {"status": "Pass"}, "b": {"status": "Fail"}}', '{"a": {"status": "Pass"}, "b": 3}', '[{"status": "Pass"}]', "no object", "{}", '{"a": {"status": "Unsure"}, "b": {}}']
    response = F.get(F.array(*map(F.lit, said)), (F.col("doc_id") % 9).cast("int"))
    verdicts = t.documents.select("doc_id", response.alias("response"))
    return joins.drop_failed(t.documents.select("doc_id", "source"), verdicts, "doc_id", strings.bad_verdict(F.col("response")))


@query("JN8", "select o_orderkey, o_custkey from orders where (o_custkey, o_orderpriority) in (select c_custkey, '1-URGENT' from customer where c_acctbal > 0)")
def jn17_semi_match_keys(t: Tables) -> DataFrame:
    keys = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"))
    return t.orders.select("o_orderkey", "o_custkey", "o_orderpriority").join(keys, ["o_custkey", "o_orderpriority"], "left_semi").select("o_orderkey", "o_custkey")


@query("JN17", """with r as (select distinct o_orderstatus, o_custkey, o_orderpriority, o_orderdate from orders where o_totalprice > 100000 and o_orderpriority in ('1-URGENT', '2-HIGH'))
select o_orderkey, o_orderstatus from orders o where exists (select 1 from r where r.o_orderstatus = o.o_orderstatus and r.o_custkey = o.o_custkey and r.o_orderpriority = o.o_orderpriority and r.o_orderdate = o.o_orderdate)""")
def jn17_matches_per_file(t: Tables) -> DataFrame:
    """Orders of two priorities (the plans) that a dear order of the same status (the file) equals in customer, priority and date."""
    results = t.orders.filter("o_totalprice > 100000")
    found = joins.matching_rows(t.orders, results, "o_orderstatus", ["o_custkey", "o_orderpriority", "o_orderdate"], "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return found.select("o_orderkey", "o_orderstatus")


# The categories of a record by its status in two runs.
_CATEGORY = """case when b = 'fail' and o = 'fail' then 'fail_common' when b = 'fail' and o = 'success' then 'fail_baseline_only' when b = 'success' and o = 'fail' then 'fail_ours_only'
when b = 'success' and o = 'success' then 'success' when b is null and o is not null then 'ours_only' when o is null and b is not null then 'baseline_only' else 'unknown' end"""
_NAMED = "case when rn = 1 then u when rn = 2 then u || '_duplicated' else u || '_duplicated_' || (rn - 1) end"


@query("JN9 SC60", f"""with b as (select {_NAMED} as unique_idx, b from (select 'u' || c_nationkey as u, case when c_mktsegment <> 'BUILDING' then case when c_acctbal > 3000 then 'success' else 'fail' end end as b, row_number() over (partition by c_nationkey order by c_custkey) as rn from customer)),
o as (select {_NAMED} as unique_idx, o from (select 'u' || s_nationkey as u, case when s_acctbal > 3000 then 'success' when s_acctbal > -500 then 'fail' end as o, row_number() over (partition by s_nationkey order by s_suppkey) as rn from supplier))
select unique_idx, {_CATEGORY} as error_category from b full join o using (unique_idx)""")
def jn9_full_outer_category(t: Tables) -> DataFrame:
    base = joins.named_apart(t.customer.withColumn("u", F.concat(F.lit("u"), "c_nationkey")), "u", ["c_custkey"])
    ours = joins.named_apart(t.supplier.withColumn("u", F.concat(F.lit("u"), "s_nationkey")), "u", ["s_suppkey"])
    b = F.when(F.col("c_mktsegment") != "BUILDING", F.when(F.col("c_acctbal") > 3000, "success").otherwise("fail"))
    o = F.when(F.col("s_acctbal") > 3000, "success").when(F.col("s_acctbal") > -500, "fail")
    both = base.select(F.col("u").alias("unique_idx"), b.alias("b")).join(ours.select(F.col("u").alias("unique_idx"), o.alias("o")), "unique_idx", "full")
    return both.select("unique_idx", F.expr(_CATEGORY).alias("error_category"))


@query("JN10 JN11", """with i as (select doc_id, 0 as s from documents where doc_id % 2 = 0 union all select doc_id, 1 from labels), f as (select doc_id, min(s) as s from i group by 1)
select f.doc_id, f.s as first_source, d.lang, case when l.quality = 1 then l.toxic end as usable from f left join (select * from documents where doc_id % 2 = 0) d using (doc_id) left join labels l using (doc_id)""")
def jn10_audit_join(t: Tables) -> DataFrame:
    d = t.documents.filter("doc_id % 2 = 0").select("doc_id", "lang").withColumn("_pos", F.col("doc_id"))
    l = t.labels.withColumn("_pos", F.col("doc_id"))
    out = joins.audit_join([("d", d), ("l", l)], "doc_id", "_pos")
    return out.select("doc_id", F.col("first_seen.__s").alias("first_source"), F.col("d.lang").alias("lang"), F.when(F.col("l.quality") == 1, F.col("l.toxic")).alias("usable"))


@query("JN12", """with s as (select doc_id, source from documents), l as (select doc_id, case when doc_id % 11 = 0 then 'x' else source end as source from documents where doc_id % 7 <> 0 union all select doc_id, source from documents where doc_id % 50 = 1)
select doc_id, 'duplicate' as error from l group by doc_id having count(*) > 1 union all select doc_id, 'missing' from s where doc_id not in (select doc_id from l) union all
select distinct s.doc_id, 'mismatch' from s join l using (doc_id) where s.source is distinct from l.source""")
def jn12_integrity(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", "source")
    changed = s.filter("doc_id % 7 <> 0").withColumn("source", F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.col("source")))
    return joins.integrity_errors(s, changed.unionByName(s.filter("doc_id % 50 = 1")), "doc_id", "source")


@query("JN13", EDGES + " select c_custkey, n_name as plan, next from customer join nation on c_nationkey = n_nationkey join edges on source = n_name where next <> 'ASIA'")
def jn13_edge_fanout(t: Tables) -> DataFrame:
    data = t.customer.select("c_custkey", "c_nationkey").join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("plan"))
    catalog = edges(t).groupBy(F.col("source").alias("plan")).agg(F.collect_set("next").alias("nexts"))
    return data.join(catalog, "plan").select("c_custkey", "plan", F.explode("nexts").alias("next")).filter("next <> 'ASIA'")


def _md5(seed: str, *keys: str) -> str:
    return "md5('" + seed + "' || " + " || ".join(f"':' || {k}" for k in keys) + ")"


@query("JN14 JN19", f"""with a as (select c_nationkey as k, c_custkey, row_number() over (partition by c_nationkey order by {_md5('7', 'c_custkey')}, c_custkey) as place from customer),
b as (select s_nationkey as k, s_suppkey, row_number() over (partition by s_nationkey order by {_md5('7', 's_suppkey')}, s_suppkey) as place from supplier)
select k, place::BIGINT as place, c_custkey, s_suppkey from a join b using (k, place)""")
def jn14_zip_join(t: Tables) -> DataFrame:
    a, b = t.customer.select(F.col("c_nationkey").alias("k"), "c_custkey"), t.supplier.select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return joins.shuffled_zip(a, b, ["k"], "c_custkey", "s_suppkey", 7)


@query("JN15", """with s as (select s_nationkey as k, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) as rn from supplier),
c as (select c_nationkey as k, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as rn from customer)
select c.k, c_custkey, s_suppkey, case when s_suppkey is not null then 'paired' when c.k not in (select k from s) then 'skipped_missing' else 'skipped_exhausted' end as status from c left join s on c.k = s.k and c.rn = s.rn""")
def jn15_cursor_join(t: Tables) -> DataFrame:
    target = t.customer.select(F.col("c_nationkey").alias("k"), "c_custkey")
    source = t.supplier.select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return joins.cursor_join(target, source, ["k"], ["c_custkey"], ["s_suppkey"], "s_suppkey")


@query("JN18", """with a as (select o_custkey as k, o_orderpriority as old, row_number() over (partition by o_custkey order by o_orderkey) as place from orders where o_orderkey % 3 <> 0),
b as (select o_custkey as k, case when o_orderkey % 4 = 0 then 'X' else o_orderpriority end as new, row_number() over (partition by o_custkey order by o_orderkey) as place from orders where o_orderkey % 5 <> 0)
select k, place::BIGINT as place, old, new, case when old is null then 'insert' when new is null then 'remove' when old = new then 'same' else 'replace' end as change from a full join b using (k, place)""")
def jn18_positional_diff(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_orderpriority").alias("v"))
    after = o.filter("o_orderkey % 5 <> 0").withColumn("v", F.when(F.col("o_orderkey") % 4 == 0, "X").otherwise(F.col("v")))
    return joins.positional_diff(o.filter("o_orderkey % 3 <> 0"), after, ["k"], ["o_orderkey"], "v")


@query("JN20", "select r_name, n_name from region cross join nation where n_regionkey <> r_regionkey")
def jn20_plan_distractors(t: Tables) -> DataFrame:
    return t.region.join(F.broadcast(t.nation), F.col("n_regionkey") != F.col("r_regionkey")).select("r_name", "n_name")


@query("JN21", EDGES + ", w as (select r_name as plan, case when r_name <> 'ASIA' then length(r_name) end as wanted from region where r_name <> 'EUROPE') select source, sum(coalesce(wanted, 1))::BIGINT as cap from edges join w on next = plan group by source")
def jn21_predecessor_counts(t: Tables) -> DataFrame:
    wanted = t.region.filter("r_name <> 'EUROPE'").select(F.col("r_name").alias("plan"), F.when(F.col("r_name") != "ASIA", F.length("r_name")).alias("wanted"))
    return joins.predecessor_counts(edges(t), wanted)


@query("JN23", EDGES + " select source, string_agg(next, ',' order by next) as nexts from edges where (source || ' - ' || next) in (select n_name || ' - ' || r_name from nation, region where length(n_name) > 5) group by source")
def jn23_edge_filter(t: Tables) -> DataFrame:
    listed = edges(t).filter(F.length("source") > 5).select("source", "next").distinct()
    return edges(t).join(listed, ["source", "next"], "left_semi").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("next")), ",").alias("nexts"))


@query("ST1", "select 'c' as kind, c_name as name, c_acctbal as acctbal, c_mktsegment as segment from customer union all select 's', s_name, s_acctbal, null from supplier")
def st1_union_schema(t: Tables) -> DataFrame:
    c = t.customer.select(F.lit("c").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(t.supplier.select(F.lit("s").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal")), allowMissingColumns=True)


@query("ST2", SCORED + "select plan from scored group by plan having count(distinct bucket) = 4")
def st2_intersect_plans(t: Tables) -> DataFrame:
    rows = scored(t)
    out = rows.filter(F.col("bucket") == BUCKETS[0]).select("plan")
    for b in BUCKETS[1:]:
        out = out.intersect(rows.filter(F.col("bucket") == b).select("plan"))
    return out


_SIG = "plan || ':' || lang"


@query("ST3", SCORED + f""", a as (select distinct {_SIG} as sig from scored where turn = 2), b as (select distinct {_SIG} as sig from scored where turn = 5)
select sig, case when b.sig is null then 'first_only' when a.sig is null then 'last_only' else 'shared' end as side from a full join b using (sig)""")
def st3_signature_sides(t: Tables) -> DataFrame:
    sig = scored(t).select("turn", F.concat_ws(":", "plan", "lang").alias("sig"))
    a, b = (sig.filter(F.col("turn") == k).select("sig").distinct().withColumn(n, F.lit(1)) for k, n in ((2, "__a"), (5, "__b")))
    side = F.when(F.col("__b").isNull(), "first_only").when(F.col("__a").isNull(), "last_only").otherwise("shared")
    return a.join(b, "sig", "full").select("sig", side.alias("side"))


@query("ST4 ST6", "select source as plan, min(doc_id)::BIGINT as first_pos from documents group by source union select 'none', -1")
def st4_ordered_union(t: Tables) -> DataFrame:
    groups = t.documents.groupBy(F.col("source").alias("plan")).agg(F.min("doc_id").alias("first_pos"))
    return groups.union(t.spark.createDataFrame([("none", -1)], "plan string, first_pos long")).distinct()


@query("ST5", "with c as (select source, count(*) as n from documents where doc_id % 3 = 0 group by 1) select s.source as plan, (50 - coalesce(n, 0))::BIGINT as deficit from (select distinct source from documents) s left join c using (source) where coalesce(n, 0) < 50")
def st5_deficits(t: Tables) -> DataFrame:
    made = t.documents.filter("doc_id % 3 = 0").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    short = F.lit(50) - F.coalesce("n", F.lit(0))
    return t.documents.select("source").distinct().join(made, "source", "left").filter(short > 0).select(F.col("source").alias("plan"), short.cast("long").alias("deficit"))


@query("ST7 SC61 SC62", "select event_id, len(json_keys(props)) > 0 and len(list_filter(json_keys(props), lambda x: x not in ('k', 'plan'))) = 0 as schema_valid from events")
def st7_schema_subset(t: Tables) -> DataFrame:
    keys = F.json_object_keys("props")
    return t.events.select("event_id", ((F.size(keys) > 0) & (F.size(F.array_except(keys, F.array(F.lit("k"), F.lit("plan")))) == 0)).alias("schema_valid"))


@query("PRJ2 PRJ3", """select event_id, case event_id % 8 when 0 then 'MISSING_ANSWER' when 1 then 'EMPTY_ANSWER' when 2 then 'INVALID_ANSWER' when 3 then 'NON_DICT_ANSWER' when 4 then 'MISSING_PLAN' when 5 then 'EMPTY_PLAN' when 6 then event_type else json_extract_string(props, '$.k') end as plan from events""")
def prj2_sentinel_plan(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    options = [F.lit(None).cast("string"), F.lit("  "), F.lit("{'plan': "), F.lit("['plan']"), F.concat(F.lit("{'arguments': "), "props", F.lit("}")), F.lit("{'plan': '  '}"), F.concat(F.lit(" {'plan': ' "), "event_type", F.lit(" '}")), F.concat(F.lit("{'plan': "), k, F.lit("}"))]
    return t.events.select("event_id", literals.plan_of_answer(F.get(F.array(*options), (F.col("event_id") % 8).cast("int"))).alias("plan"))


@query("PRJ5", SCORED + """select distinct file, try_cast(nullif(regexp_extract(file, '^it([0-9]+)_', 1), '') as BIGINT) as turn_no, case when regexp_matches(file, 'complex_[0-9]') then regexp_extract(file, 'complex_[0-9]') when contains(file, 'nonNR') then 'nonNR' end as file_bucket,
(row_number() over (order by try_cast(nullif(regexp_extract(file, '^it([0-9]+)_', 1), '') as BIGINT), case when contains(file, 'nonNR') then 0 else 1 end, file))::BIGINT as place from (select distinct file from scored)""")
def prj4_file_keys(t: Tables) -> DataFrame:
    turn = F.expr("try_cast(nullif(regexp_extract(file, '^it([0-9]+)_', 1), '') as bigint)")
    bucket = F.when(F.col("file").rlike("complex_[0-9]"), F.regexp_extract("file", "complex_[0-9]", 0)).when(F.col("file").contains("nonNR"), "nonNR")
    keyed = scored(t).select("file").distinct().withColumn("turn_no", turn).withColumn("file_bucket", bucket)
    order = Window.orderBy(F.coalesce("turn_no", F.lit(999)), F.when(F.col("file_bucket") == "nonNR", 0).otherwise(1), "file")
    return keyed.withColumn("place", F.row_number().over(order).cast("long"))


_NAMES = """with n as (select distinct case doc_id % 6 when 0 then 'it' || (doc_id % 13) || '_nonNR_tc.tsv' when 1 then 'it' || (doc_id % 13) || '_complex_' || (doc_id % 11) || '_tc.tsv' when 2 then 'turn' || (doc_id % 13) || '.tsv'
when 3 then 'old_it' || (doc_id % 13) || '.tsv' when 4 then 'complex_' || (doc_id % 11) || '.tsv' else 'other.tsv' end as file from documents)
"""


def _names(t: Tables) -> DataFrame:
    turn, number = (F.col("doc_id") % 13).cast("string"), (F.col("doc_id") % 11).cast("string")
    made = [("it", turn, "_nonNR_tc.tsv"), ("it", turn, "_complex_", number, "_tc.tsv"), ("turn", turn, ".tsv"), ("old_it", turn, ".tsv"), ("complex_", number, ".tsv"), ("other.tsv",)]
    name = F.get(F.array(*(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)) for parts in made)), (F.col("doc_id") % 6).cast("int"))
    return t.documents.select(name.alias("file")).distinct()


@query("PRJ4", _NAMES + """select file, nullif(regexp_extract(file, 'it([0-9]+)', 1), '')::INT as search, coalesce('turn' || nullif(regexp_extract(file, '^it([0-9]+)_', 1), ''), 'unknown') as anchored,
nullif(regexp_extract(file, '^turn([0-9]+)', 1), '')::INT as turn, case when file[1:3] in ('it2', 'it3', 'it4', 'it5') then file[3:3]::INT end as prefixed from n""")
def prj4_turn_rules(t: Tables) -> DataFrame:
    turns = {rule: strings.file_turn(F.col("file"), rule).alias(rule) for rule in ("search", "turn", "prefixed")}
    anchored = F.coalesce(F.concat(F.lit("turn"), strings.file_turn(F.col("file"), "anchored")), F.lit("unknown"))
    return _names(t).select("file", anchored.alias("anchored"), *turns.values())


@query("PRJ6", _NAMES + """, k as (select file, coalesce(nullif(regexp_extract(file, 'it([0-9]+)', 1), '')::INT, 999) as turn, nullif(regexp_extract(file, 'complex_([0-9]+)', 1), '')::INT as c, contains(file, 'nonNR') as plain from n)
select file, row_number() over (order by turn, c is null, c, file) as rising, row_number() over (order by turn, c is null, -c, file) as falling,
row_number() over (order by case when plain then 0 when c is not null then 1 else 2 end, c, file) as plain_first from k""")
def prj6_file_orders(t: Tables) -> DataFrame:
    """Places of the files in the three orders of reports; a report lists few files."""
    places = (F.row_number().over(Window.orderBy(*strings.file_order(F.col("file"), rule))).cast("long").alias(rule) for rule in ("rising", "falling", "plain_first"))
    return _names(t).select("file", *places)


@query("PRJ8 PRJ9", "select lang, count_if(text = trim(text))::BIGINT as same, count_if(ends_with(text, '.'))::BIGINT as stopped, count_if(contains(split_part(text, ' ', 1), 'the'))::BIGINT as the_first from documents group by lang")
def prj8_identity_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count_if(F.col("text").eqNullSafe(F.trim("text"))).alias("same"), F.count_if(F.col("text").endswith(".")).alias("stopped"), F.count_if(F.element_at(F.split("text", " "), 1).contains("the")).alias("the_first"))


@query("PRJ10 PRJ24", "select o_orderkey, o_orderpriority, case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 end as ord from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_totalprice between 1000 and 50000 and o_orderstatus = 'O'")
def prj10_filters(t: Tables) -> DataFrame:
    ordinal = t.spark.createDataFrame([("1-URGENT", 0), ("2-HIGH", 1)], "o_orderpriority string, ord int")
    rows = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_totalprice").between(1000, 50000) & (F.col("o_orderstatus") == "O"))
    return rows.select("o_orderkey", "o_orderpriority").join(F.broadcast(ordinal), "o_orderpriority")


@query("PRJ11", "select doc_id from documents where (length(text) - length(replace(text, '. ', ''))) // 2 = 1")
def prj11_exactly_one(t: Tables) -> DataFrame:
    return t.documents.filter(F.regexp_count("text", F.lit(r"\. ")) == 1).select("doc_id")


@query("PRJ12", "select regexp_extract(id, '^(.*)_([^_]*)_([^_]*)$', 1) as data_type, regexp_extract(id, '^(.*)_([^_]*)_([^_]*)$', 2) as conversation_id, regexp_extract(id, '^(.*)_([^_]*)_([^_]*)$', 3)::BIGINT as turn_id from (select role || '_x_' || conv_id || '_' || turn as id from conversations)")
def prj12_sample_id(t: Tables) -> DataFrame:
    ids = t.conversations.select(F.concat("role", F.lit("_x_"), "conv_id", F.lit("_"), "turn").alias("id"))
    part = [F.regexp_extract("id", "^(.*)_([^_]*)_([^_]*)$", k) for k in (1, 2, 3)]
    whole = F.when(F.col("id").rlike("^.*_[^_]*_[0-9]+$"), part[2].cast("long")).otherwise(F.raise_error(F.concat(F.lit("malformed sample id: "), "id")).cast("long"))
    return ids.select(part[0].alias("data_type"), part[1].alias("conversation_id"), whole.alias("turn_id"))


@query("PRJ15 PRJ16 PRJ17", """select p_partkey, coalesce(map {'brand#11': 'eleven', 'brand#22': 'twenty-two'}[regexp_replace(trim(lower(p_brand)), '\\s+', ' ', 'g')], p_brand) as brand, try_cast(rtrim(p_size || '%', '%') as DOUBLE) as score, split_part(p_type, ' ', 1) as kind from part""")
def prj16_aliases(t: Tables) -> DataFrame:
    alias = F.create_map(F.lit("brand#11"), F.lit("eleven"), F.lit("brand#22"), F.lit("twenty-two"))
    norm = F.regexp_replace(F.trim(F.lower("p_brand")), r"\s+", " ")
    return t.part.select("p_partkey", F.coalesce(F.try_element_at(alias, norm), "p_brand").alias("brand"), F.expr("try_cast(rtrim('%', concat(p_size, '%')) as double)").alias("score"), F.element_at(F.split("p_type", " "), 1).alias("kind"))


@query("PRJ18 PRJ19", SCORED + "select doc_id, case when bucket like 'complex_%' then right(bucket, 1)::BIGINT else greatest(turn - 1, 1) end as reference_turn, coalesce(nullif(trim(case when plan_ok then lang end), ''), nullif(trim(plan), '')) as rewrite, case when plan_ok and trim(lang) <> '' then 'column' else 'generation' end as origin from scored")
def prj18_reference_turn(t: Tables) -> DataFrame:
    ref = F.when(F.col("bucket").startswith("complex_"), F.regexp_extract("bucket", r"(\d+)$", 1).cast("long")).otherwise(F.greatest(F.col("turn") - 1, F.lit(1)))
    first = F.nullif(F.trim(F.when(F.col("plan_ok"), F.col("lang"))), F.lit(""))
    return scored(t).select("doc_id", ref.alias("reference_turn"), F.coalesce(first, F.nullif(F.trim("plan"), F.lit(""))).alias("rewrite"), F.when(first.isNotNull(), "column").otherwise("generation").alias("origin"))


@query("PRJ20 PRJ22", "select event_id, '[' || array_to_string(list_filter(json_keys(props), lambda a: a <> 'required'), ', ') || ']' as kept from events")
def prj20_argument_keys(t: Tables) -> DataFrame:
    spec = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: k != "required")
    return t.events.select("event_id", F.concat(F.lit("["), F.array_join(F.map_keys(spec), ", "), F.lit("]")).alias("kept"))


@query("PRJ21", """select event_id, '{"name":"' || event_type || '","parameters":{"properties":{"p":{"parameters":{},"required":1},"required":{"k":' || json_extract_string(props, '$.k') || '}}}}' as tool from events""")
def prj21_without_required(t: Tables) -> DataFrame:
    """The list of required parameters goes, a parameter that is named so stays."""
    tool = F.concat(F.lit('{"name": "'), "event_type", F.lit('", "parameters": {"required": ["p"], "properties": {"p": {"required": true, "parameters": {"required": []}}, "required": '), "props", F.lit("}}}"))
    return t.events.select("event_id", literals.drop_required(tool).alias("tool"))


@query("PRJ14 PRJ23", "select conv_id, count(*)::BIGINT as full_turns, max(case when turn = m then role end) as last_role, '' as history from (select *, max(turn) over (partition by conv_id) as m from conversations) group by conv_id having count(*) >= 2")
def prj23_last_turn_only(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("full_turns"), F.max_by("role", "turn").alias("last_role")).filter("full_turns >= 2").withColumn("history", F.lit(""))
