"""Aggregations, pivots and offender reports over scored rows (AG, PV, WN9-WN12, WN20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators import metrics
from turnloom.operators.ranking import head_n, lag_delta
from turnloom.plans.base import BUCKETS, SCORED, one, r9, scored
from turnloom.registry import Tables, query

TURNS = [2, 3, 4, 5]
#: Curriculum weights of buckets by turn, and the reversed ones.
WEIGHTS = [(2, "nonNR", 1), (2, "complex_1", 1), (3, "nonNR", 3), (3, "complex_1", 7), (4, "nonNR", 2), (4, "complex_1", 3), (4, "complex_2", 5), (5, "nonNR", 1), (5, "complex_1", 2), (5, "complex_2", 3), (5, "complex_3", 4)]


@query("AG4 PV1", SCORED + f"""select {", ".join(f"round(avg(case when turn = {k} then a end), 9) as turn_{k}" for k in TURNS)}
from (select turn, plan, avg({one('all_ok')}) as a from scored group by all)""")
def macro_by_turn_pivot(t: Tables) -> DataFrame:
    cells = scored(t).groupBy("turn", "plan").agg(metrics.share(F.col("all_ok")).alias("a"))
    wide = cells.groupBy().pivot("turn", TURNS).agg(F.avg("a"))
    return wide.select(*(r9(F.col(str(k))).alias(f"turn_{k}") for k in TURNS))


@query("AG1 PRJ1", "select source as plan, count(*)::BIGINT as n, count(distinct lang)::BIGINT as langs from documents group by source")
def ag1_count_per_plan(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.col("source").alias("plan")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs"))


@query("AG2", "select lang, count(*)::BIGINT as n, round(count(*)::DOUBLE * 100 / sum(count(*)) over (), 6) as pct from documents group by lang")
def ag2_frequency_percent(t: Tables) -> DataFrame:
    counts = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.crossJoin(F.broadcast(total)).select("lang", "n", F.round(F.col("n").cast("double") * 100 / F.col("all"), 6).alias("pct"))


@query("AG3 PRJ7", SCORED + f"select file, round(avg({one('plan_ok')}), 9) as plan_acc, round(avg({one('args_ok')}), 9) as args_acc, round(avg({one('all_ok')}), 9) as all_acc from scored group by file")
def ag3_micro_accuracy(t: Tables) -> DataFrame:
    return scored(t).groupBy("file").agg(*(r9(metrics.share(F.col(f"{c}_ok"))).alias(f"{c}_acc") for c in ("plan", "args", "all")))


@query("AG4", SCORED + f"select turn, round(avg(a), 9) as plan_macro from (select turn, plan, avg({one('all_ok')}) as a from scored where plan is not null group by all) group by turn")
def ag4_plan_macro(t: Tables) -> DataFrame:
    return metrics.plan_macro(scored(t), F.col("all_ok"), by=["turn"]).withColumn("plan_macro", r9("plan_macro"))


@query("AG5", SCORED + f"""select prefix, round(avg(f), 9) as file_macro from (
  select file, split_part(file, '_', 1) as prefix, avg(a) as f from (select file, plan, avg({one('all_ok')}) as a from scored group by all) group by file) group by prefix""")
def ag5_file_macro(t: Tables) -> DataFrame:
    per_file = metrics.plan_macro(scored(t), F.col("all_ok"), by=["file"])
    return per_file.groupBy(F.substring_index("file", "_", 1).alias("prefix")).agg(r9(F.avg("plan_macro")).alias("file_macro"))


@query("AG6", SCORED + f"select turn, round((avg({one('plan_ok')}) + avg({one('args_ok')}) + avg({one('all_ok')})) / 3, 9) as triple_mean from scored group by turn")
def ag6_triple_mean(t: Tables) -> DataFrame:
    parts = [metrics.share(F.col(f"{c}_ok")) for c in ("plan", "args", "all")]
    return scored(t).groupBy("turn").agg(r9((parts[0] + parts[1] + parts[2]) / 3).alias("triple_mean"))


_W = ", ".join(f"({a}, '{b}', {c})" for a, b, c in WEIGHTS)


@query("AG7", SCORED + f""", m as (select turn, bucket, avg(a) as b from (select turn, bucket, plan, avg({one('all_ok')}) as a from scored group by all) group by turn, bucket),
w(turn, bucket, w) as (values {_W})
select turn, round(sum(w * b) / sum(w), 9) as weighted from m join w using (turn, bucket) group by turn""")
def ag7_weighted_turn_macro(t: Tables) -> DataFrame:
    macros = metrics.plan_macro(scored(t), F.col("all_ok"), by=["turn", "bucket"])
    weights = t.spark.createDataFrame(WEIGHTS, "turn long, bucket string, w int")
    return metrics.weighted_turn_macro(macros, weights).withColumn("weighted", r9("weighted"))


@query("AG8 JN7", SCORED + f"select plan, turn, round(avg({one('all_ok')}), 9) as acc, count(*)::BIGINT as support, count_if(all_ok)::BIGINT as hits, (count(*) - count_if(all_ok))::BIGINT as incorrect from scored group by plan, turn")
def ag8_support_table(t: Tables) -> DataFrame:
    return metrics.support_table(scored(t), F.col("all_ok"), ["plan", "turn"]).withColumn("acc", r9("acc"))


@query("AG9", SCORED + f""", c as (select plan, turn, avg({one('all_ok')}) as a from scored group by all),
k as (select plan from c group by plan having count(*) = 4)
select turn, round(avg(a), 9) as common_macro, count(*)::BIGINT as plans from c join k using (plan) group by turn""")
def ag9_common_plan_macro(t: Tables) -> DataFrame:
    cells = scored(t).groupBy("plan", "turn").agg(metrics.share(F.col("all_ok")).alias("a"))
    common = cells.groupBy("plan").agg(F.count(F.lit(1)).alias("n")).filter("n = 4").select("plan")
    return cells.join(common, "plan").groupBy("turn").agg(r9(F.avg("a")).alias("common_macro"), F.count(F.lit(1)).alias("plans"))


@query("AG10", SCORED + """select grouping_id(bucket, turn, file, plan)::BIGINT as scope, bucket, turn, file, plan, count(*)::BIGINT as n, round(count(*)::DOUBLE / (select count(*) from scored), 9) as ratio
from scored group by grouping sets ((), (bucket), (turn), (file), (plan))""")
def ag10_scope_summary(t: Tables) -> DataFrame:
    rows = scored(t)
    sets = rows.groupingSets([[], ["bucket"], ["turn"], ["file"], ["plan"]], "bucket", "turn", "file", "plan").agg(F.grouping_id().cast("long").alias("scope"), F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("all"))
    return sets.crossJoin(F.broadcast(total)).select("scope", "bucket", "turn", "file", "plan", "n", r9(F.col("n").cast("double") / F.col("all")).alias("ratio"))


@query("AG11", SCORED + f"select case grouping_id(lang, file) when 3 then 'overall' when 1 then 'lang' else 'file' end as scope, lang, file, count(*)::BIGINT as n, round(avg({one('args_ok')}), 9) as compliance from scored group by rollup (lang, file)")
def ag11_compliance_rollup(t: Tables) -> DataFrame:
    scope = F.when(F.grouping_id() == 3, "overall").when(F.grouping_id() == 1, "lang").otherwise("file")
    return scored(t).rollup("lang", "file").agg(scope.alias("scope"), F.count(F.lit(1)).alias("n"), r9(metrics.share(F.col("args_ok"))).alias("compliance")).select("scope", "lang", "file", "n", "compliance")


@query("AG12", SCORED + "select file, plan, count_if(not all_ok)::BIGINT as wrong, round(count_if(not all_ok)::DOUBLE * 100 / sum(count(*)) over (partition by file), 9) as pct_of_file from scored group by file, plan")
def ag12_wrong_of_file(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    cells = scored(t).groupBy("file", "plan").agg(F.count_if(~F.col("all_ok")).alias("wrong"), F.count(F.lit(1)).alias("n"))
    return cells.select("file", "plan", "wrong", r9(F.col("wrong").cast("double") * 100 / F.sum("n").over(Window.partitionBy("file"))).alias("pct_of_file"))


@query("AG13", SCORED + """, v as (select plan, 'plan' as criterion, plan_ok as ok from scored union all select plan, 'arguments', args_ok from scored union all select plan, 'Overall Pass', all_ok from scored)
select plan, round(avg(case when criterion = 'Overall Pass' then ok::INT::DOUBLE end), 9) as overall_pass, round(avg(case when criterion = 'arguments' then ok::INT::DOUBLE end), 9) as arguments, round(avg(case when criterion = 'plan' then ok::INT::DOUBLE end), 9) as plan_name from v group by plan""")
def ag13_verdict_pass_rates(t: Tables) -> DataFrame:
    verdicts = F.create_map(F.lit("plan"), "plan_ok", F.lit("arguments"), "args_ok", F.lit("Overall Pass"), "all_ok")
    long = scored(t).select("plan", F.explode(verdicts).alias("criterion", "ok"))
    wide = long.groupBy("plan").pivot("criterion", ["Overall Pass", "arguments", "plan"]).agg(metrics.share(F.col("ok")))
    return wide.toDF("plan", "overall_pass", "arguments", "plan_name").select("plan", *(r9(c).alias(c) for c in ("overall_pass", "arguments", "plan_name")))


_FAILS = SCORED + """, f as (select *, case when not plan_ok then 'wrong_plan' else 'wrong_arguments' end as label, case when plan_ok then 'args' when args_ok then 'plan' else 'both' end as subtype from scored where not all_ok)"""


def failures(t: Tables) -> DataFrame:
    label = F.when(~F.col("plan_ok"), "wrong_plan").otherwise("wrong_arguments")
    subtype = F.when(F.col("plan_ok"), "args").when(F.col("args_ok"), "plan").otherwise("both")
    return scored(t).filter(~F.col("all_ok")).withColumn("label", label).withColumn("subtype", subtype)


@query("AG14", _FAILS + " select label, subtype, count(*)::BIGINT as n, round(count(*)::DOUBLE / sum(count(*)) over (), 4) as ratio from f group by label, subtype")
def ag14_failure_patterns(t: Tables) -> DataFrame:
    cells = failures(t).groupBy("label", "subtype").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("all"))
    return cells.crossJoin(F.broadcast(total)).select("label", "subtype", "n", F.round(F.col("n").cast("double") / F.col("all"), 4).alias("ratio"))


@query("AG15 JN6", _FAILS + """, s as (select turn, bucket, count(*) as support from scored group by all)
select f.turn, f.bucket, label, count(*)::BIGINT as n, any_value(support)::BIGINT as support, round(count(*)::DOUBLE / sum(count(*)) over (partition by f.turn, f.bucket), 9) as ratio
from f join s on f.turn = s.turn and f.bucket is not distinct from s.bucket group by f.turn, f.bucket, label""")
def ag15_turn_bucket_labels(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    support = scored(t).groupBy("turn", F.col("bucket").alias("b")).agg(F.count(F.lit(1)).alias("support"))
    cells = failures(t).groupBy("turn", "bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    joined = cells.join(support, (cells["turn"] == support["turn"]) & cells["bucket"].eqNullSafe(support["b"])).drop(support["turn"]).drop("b")
    return joined.withColumn("ratio", r9(F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("turn", "bucket"))))


_SLOTS = """with o as (select l_orderkey as k, list(distinct l_returnflag || '=' || l_linestatus) as gold, list(distinct l_returnflag || '=' || case when l_linenumber % 3 = 0 then 'X' else l_linestatus end) as pred from lineitem group by 1),
m as (select k, len(list_intersect(gold, pred)) as matched, len(gold) as ng, len(pred) as np from o),
x as (select k, matched, matched::DOUBLE / np as p, matched::DOUBLE / ng as r from m)
"""


def slots(t: Tables) -> DataFrame:
    gold = F.collect_set(F.concat("l_returnflag", F.lit("="), "l_linestatus"))
    pred = F.collect_set(F.concat("l_returnflag", F.lit("="), F.when(F.col("l_linenumber") % 3 == 0, "X").otherwise(F.col("l_linestatus"))))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(gold.alias("gold"), pred.alias("pred"))
    matched, p, r, f1 = metrics.slot_metrics(F.col("gold"), F.col("pred"))
    return rows.select("k", matched.cast("long").alias("matched"), p.alias("p"), r.alias("r"), f1.alias("f1"))


@query("AG16", _SLOTS + "select k, matched::BIGINT as matched, round(p, 9) as p, round(r, 9) as r, round(case when p + r = 0 then 0.0::DOUBLE else 2 * p * r / (p + r) end, 9) as f1 from x")
def ag16_slot_f1(t: Tables) -> DataFrame:
    return slots(t).select("k", "matched", r9("p").alias("p"), r9("r").alias("r"), r9("f1").alias("f1"))


@query("AG17", SCORED + f"select lang, count(*)::BIGINT as n, round(avg({one('plan_ok')}), 9) as parse_rate, round(coalesce(avg(case when plan_ok then {one('args_ok')} end), 0), 9) as acc_parsed, round(avg({one('all_ok')}), 9) as exact from scored group by rollup (lang)")
def ag17_run_summary(t: Tables) -> DataFrame:
    parsed = F.avg(F.when(F.col("plan_ok"), F.col("args_ok").cast("int").cast("double")))
    return scored(t).rollup("lang").agg(F.count(F.lit(1)).alias("n"), r9(metrics.share(F.col("plan_ok"))).alias("parse_rate"), r9(F.coalesce(parsed, F.lit(0.0))).alias("acc_parsed"), r9(metrics.share(F.col("all_ok"))).alias("exact"))


@query("AG18 SC67")
def ag18_bootstrap_ci(t: Tables) -> DataFrame:
    counts = scored(t).groupBy("plan").agg(F.count(F.lit(1)).alias("n"), F.count_if("all_ok").alias("hits"))
    return metrics.bootstrap_ci(counts)


@query("AG19", SCORED + f"select bucket, turn, round(avg(a), 9) as mean_score from (select bucket, plan, turn, avg({one('all_ok')}) as a from scored group by all) group by bucket, turn")
def ag19_mean_of_means(t: Tables) -> DataFrame:
    return scored(t).groupBy("bucket", "plan", "turn").agg(metrics.share(F.col("all_ok")).alias("a")).groupBy("bucket", "turn").agg(r9(F.avg("a")).alias("mean_score"))


@query("AG20 SC68", "select lang, min(n)::BIGINT as least, max(n)::BIGINT as most, round(avg(n), 9) as mean, count(*)::BIGINT as docs from (select lang, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as n from documents) group by lang")
def ag20_token_summary(t: Tables) -> DataFrame:
    n = t.documents.select("lang", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n"))
    return n.groupBy("lang").agg(F.min("n").alias("least"), F.max("n").alias("most"), r9(F.avg("n")).alias("mean"), F.count(F.lit(1)).alias("docs"))


@query("AG21", "select role, count(distinct conv_id)::BIGINT as convs, count(*)::BIGINT as turns from conversations group by role")
def ag21_distinct_conversations(t: Tables) -> DataFrame:
    return t.conversations.groupBy("role").agg(F.count_distinct("conv_id").alias("convs"), F.count(F.lit(1)).alias("turns"))


@query("AG22", "select count(*)::BIGINT as dup_groups, coalesce(sum(n), 0)::BIGINT as dup_rows from (select text, count(*) as n from documents group by text having count(*) > 1)")
def ag22_duplicate_stats(t: Tables) -> DataFrame:
    groups = t.documents.groupBy("text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("dup_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("dup_rows"))


@query("AG23 WN14", _FAILS + """, c as (select plan, bucket, count(*)::BIGINT as score from f group by plan, bucket having count(*) >= 2)
select plan, string_agg(bucket, ',' order by bucket) as models, count(*)::BIGINT as n_models, sum(score)::BIGINT as total from c group by plan order by n_models desc, total desc, plan limit 10""")
def ag23_common_offenders(t: Tables) -> DataFrame:
    cells = failures(t).groupBy("plan", "bucket").agg(F.count(F.lit(1)).alias("score")).filter("score >= 2").withColumn("ord", F.col("bucket"))
    out = metrics.common_offenders(cells, "plan", "bucket", "score", "ord")
    return out.orderBy(F.desc("n_models"), F.desc("total"), "plan").limit(10)


@query("AG24", SCORED + f""", c as (select plan, turn, avg({one('all_ok')}) as a from scored group by all),
o as (select plan, round(avg(case when plan in ('src1', 'src2') then case when turn > 3 then a end else a end), 9) as score from c group by plan)
select plan, score, 0 as is_macro from o union all select 'MACRO', round(avg(score), 9), 1 from o""")
def ag24_override_macro(t: Tables) -> DataFrame:
    cells = scored(t).groupBy("plan", "turn").agg(metrics.share(F.col("all_ok")).alias("a"))
    listed = F.col("plan").isin("src1", "src2")
    per = cells.groupBy("plan").agg(r9(F.avg(F.when(~listed | (F.col("turn") > 3), F.col("a")))).alias("score")).withColumn("is_macro", F.lit(0))
    return per.unionByName(per.agg(F.lit("MACRO").alias("plan"), r9(F.avg("score")).alias("score"), F.lit(1).alias("is_macro")))


@query("AG25", """with p(event_type, pin, pout) as (values ('view', 0.0011, 0.0044), ('click', 0.002, 0.008), ('purchase', 0.00015, 0.0006))
select event_type, count(*)::BIGINT as calls, round(sum((user_id::DOUBLE / 1000) * pin::DOUBLE + ((event_id % 100)::DOUBLE / 1000) * pout::DOUBLE), 4) as usd from events join p using (event_type) group by event_type""")
def ag25_cost_by_model(t: Tables) -> DataFrame:
    prices = t.spark.createDataFrame([("view", 0.0011, 0.0044), ("click", 0.002, 0.008), ("purchase", 0.00015, 0.0006)], "event_type string, pin double, pout double")
    usd = F.col("user_id") / 1000 * F.col("pin") + F.col("event_id") % 100 / 1000 * F.col("pout")
    return t.events.join(F.broadcast(prices), "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(usd), 4).alias("usd"))


@query("AG26", SCORED + f""", a as (select doc_id, plan_ok as x from scored where lang <> 'de'), b as (select doc_id, args_ok as y from scored where lang <> 'fr')
select count(*)::BIGINT as total, round(avg({one('x')}), 9) as baseline, round(avg({one('y')}), 9) as ours, round(avg({one('x and y')}), 9) as common from a full join b using (doc_id)""")
def ag26_run_agreement(t: Tables) -> DataFrame:
    """Accuracy of two runs and of both at once over all their records; one that a run lacks is wrong in it."""
    a = scored(t).filter("lang <> 'de'").select("doc_id", F.col("plan_ok").alias("x"))
    b = scored(t).filter("lang <> 'fr'").select("doc_id", F.col("args_ok").alias("y"))
    x, y = (F.coalesce(F.col(c), F.lit(False)) for c in "xy")
    return a.join(b, "doc_id", "full").agg(F.count(F.lit(1)).alias("total"), r9(metrics.share(x)).alias("baseline"), r9(metrics.share(y)).alias("ours"), r9(metrics.share(x & y)).alias("common"))


@query("AG27", SCORED + f"select plan, count(*)::BIGINT as total, count_if(plan_ok)::BIGINT as tool_true, count_if(args_ok)::BIGINT as args_true, round(avg({one('plan_ok and args_ok')}), 9) as both_true from scored group by plan")
def ag27_flag_counts(t: Tables) -> DataFrame:
    return scored(t).groupBy("plan").agg(F.count(F.lit(1)).alias("total"), F.count_if("plan_ok").alias("tool_true"), F.count_if("args_ok").alias("args_true"), r9(metrics.share(F.col("plan_ok") & F.col("args_ok"))).alias("both_true"))


_WIDE = SCORED + f""", c as (select plan, turn, avg({one('all_ok')}) as a, count(*) as n from scored group by all),
w as (select plan, {", ".join(f"round(max(case when turn = {k} then a end), 9) as acc_{k}, max(case when turn = {k} then n end)::BIGINT as n_{k}" for k in TURNS)} from c group by plan)
"""


def wide(t: Tables) -> DataFrame:
    cells = scored(t).groupBy("plan", "turn").agg(r9(metrics.share(F.col("all_ok"))).alias("acc"), F.count(F.lit(1)).alias("n"))
    out = cells.groupBy("plan").pivot("turn", TURNS).agg(F.first("acc").alias("acc"), F.first("n").alias("n"))
    return out.select("plan", *(F.col(f"{k}_{c}").alias(f"{c}_{k}") for k in TURNS for c in ("acc", "n")))


@query("PV1", _WIDE + "select * from w")
def pv1_plan_turn_pivot(t: Tables) -> DataFrame:
    return wide(t)


@query("PV2", _WIDE + f"select plan, {', '.join(f'coalesce(acc_{k}, 0) as acc_{k}' for k in TURNS)}, round(({' + '.join(f'coalesce(acc_{k}, 0)' for k in TURNS)}) / 4, 9) as row_mean from w")
def pv2_fill_zero_mean(t: Tables) -> DataFrame:
    filled = wide(t).select("plan", *(f"acc_{k}" for k in TURNS)).na.fill(0.0)
    return filled.withColumn("row_mean", r9(sum((F.col(f"acc_{k}") for k in TURNS[1:]), F.col("acc_2")) / 4))


@query("PV3 PV6", SCORED + f""", c as (select turn, bucket, plan, avg({one('all_ok')}) as a from scored group by all), m as (select turn, bucket, avg(a) as b from c group by all)
select turn::VARCHAR as turn, {", ".join(f"round(max(case when bucket = '{b}' then b end), 9) as {b}" for b in BUCKETS)} from m group by turn
union all select 'TOTAL', {", ".join(f"round(avg(case when bucket = '{b}' then b end), 9)" for b in BUCKETS)} from m""")
def pv6_turn_bucket_summary(t: Tables) -> DataFrame:
    macros = metrics.plan_macro(scored(t), F.col("all_ok"), by=["turn", "bucket"])
    rows = macros.groupBy(F.col("turn").cast("string").alias("turn")).pivot("bucket", BUCKETS).agg(F.first("plan_macro"))
    total = macros.groupBy().pivot("bucket", BUCKETS).agg(F.avg("plan_macro")).withColumn("turn", F.lit("TOTAL"))
    return rows.unionByName(total, allowMissingColumns=True).select("turn", *(r9(b).alias(b) for b in BUCKETS))


@query("PV4", SCORED + f""", c as (select lang, bucket, avg({one('all_ok')}) as a from scored group by all)
select lang, {", ".join(f"round(max(case when bucket = '{b}' then a end), 9) as {b}" for b in BUCKETS)}, round(avg(a), 9) as row_mean from c group by lang""")
def pv4_method_model_pivot(t: Tables) -> DataFrame:
    cells = scored(t).groupBy("lang", "bucket").agg(metrics.share(F.col("all_ok")).alias("a"))
    means = cells.groupBy("lang").agg(r9(F.avg("a")).alias("row_mean"))
    return cells.groupBy("lang").pivot("bucket", BUCKETS).agg(r9(F.first("a"))).join(means, "lang")


@query("PV5 PV7", _WIDE + "select plan, axis, acc from w unpivot (acc for axis in (acc_2, acc_3, acc_4, acc_5))")
def pv5_unpivot(t: Tables) -> DataFrame:
    return wide(t).unpivot("plan", [f"acc_{k}" for k in TURNS], "axis", "acc").filter("acc is not null")


@query("WN9 WN20", _WIDE + "select plan, round(acc_5 - acc_2, 9) as delta, not (acc_2 >= acc_3 and acc_3 >= acc_4 and acc_4 >= acc_5) as offender from w where n_2 >= 2 and n_3 >= 2 and n_4 >= 2 and n_5 >= 2")
def wn9_trend_offenders(t: Tables) -> DataFrame:
    out = metrics.trend_offenders(wide(t), [f"acc_{k}" for k in TURNS], [f"n_{k}" for k in TURNS], 2)
    return out.select("plan", r9("delta").alias("delta"), "offender")


@query("WN10", SCORED + f""", c as (select plan, bucket, avg({one('all_ok')}) as a from scored group by all),
w as (select plan, max(case when bucket = 'complex_1' then a end) as c1, max(case when bucket = 'complex_2' then a end) as c2, max(case when bucket = 'complex_3' then a end) as c3, max(case when bucket = 'nonNR' then a end) as c4 from c group by plan)
select plan, round(least(c2 - c1, c3 - c2, c4 - c3), 9) as worst from w where c1 is not null and c2 is not null and c3 is not null and c4 is not null and not (c1 <= c2 and c2 <= c3 and c3 <= c4)""")
def wn10_bucket_offenders(t: Tables) -> DataFrame:
    cells = scored(t).groupBy("plan").pivot("bucket", BUCKETS).agg(metrics.share(F.col("all_ok"))).na.drop()
    order = ["complex_1", "complex_2", "complex_3", "nonNR"]
    deltas = [F.col(b) - F.col(a) for a, b in zip(order, order[1:])]
    worst = F.least(*deltas)
    return cells.filter(worst < 0).select("plan", r9(worst).alias("worst"))


@query("WN11", SCORED + f", c as (select plan, turn, avg({one('all_ok')}) as a from scored group by all) select plan, turn, round(a - lag(a) over (partition by plan order by turn), 9) as delta from c")
def wn11_turn_delta(t: Tables) -> DataFrame:
    cells = scored(t).groupBy("plan", "turn").agg(metrics.share(F.col("all_ok")).alias("a"))
    return lag_delta(cells, ["plan"], ["turn"], "a").select("plan", "turn", r9("delta").alias("delta"))


@query("WN6 WN12", _FAILS + """, c as (select plan, label || ':' || subtype as sig, count(*)::BIGINT as n from f group by all)
select plan, sig, n from (select *, row_number() over (partition by plan order by n desc, sig) as rn from c) where rn = 1""")
def wn6_dominant_signature(t: Tables) -> DataFrame:
    cells = failures(t).groupBy("plan", F.concat_ws(":", "label", "subtype").alias("sig")).agg(F.count(F.lit(1)).alias("n"))
    return head_n(cells, ["plan"], [F.desc("n"), F.col("sig")], 1)
