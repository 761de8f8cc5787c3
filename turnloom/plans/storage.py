"""Round trips through the sources and sinks (SRC, SNK): what is written is read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators import generation
from turnloom.registry import Tables, query
from turnloom.shared import shared_dir, stored
from turnloom.sources import readers, sheets, sinks


@query("SRC1 SRC2 SNK1", "select event_id, user_id, event_type, props from events")
def src1_jsonl(t: Tables) -> DataFrame:
    path = sinks.scratch(t.spark, "jsonl")
    sinks.write_jsonl(t.events.select("event_id", "user_id", "event_type", "props"), path)
    return readers.read_jsonl(t.spark, path, "event_id long, user_id long, event_type string, props string")


@query("SRC3 SRC4 SNK2 SNK6", "select conv_id::VARCHAR as conv_id, turn::VARCHAR as turn, role, text from conversations")
def src3_tsv(t: Tables) -> DataFrame:
    path = sinks.scratch(t.spark, "tsv")
    sinks.write_tsv(t.conversations, path, ["role", "text", "conv_id", "turn"])
    return readers.read_tsv(t.spark, path, ["conv_id", "turn", "role", "text"])


@query("SRC5", "select n_nationkey::VARCHAR as n_nationkey, n_name from nation")
def src5_byte_order_mark(t: Tables) -> DataFrame:
    """The first header of a file that begins with a byte order mark is read without it."""
    path = sinks.scratch(t.spark, "bom")
    head = t.spark.createDataFrame([(0, readers.BOM + "n_nationkey\tn_name")], "o int, value string")
    body = t.nation.select(F.lit(1).alias("o"), F.concat_ws("\t", "n_nationkey", "n_name").alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return readers.read_tsv(t.spark, path, ["n_nationkey", "n_name"])


@query("SRC6", "select 'r' || n_regionkey as split, n_nationkey::VARCHAR as n_nationkey, n_name from nation")
def src6_file_splits(t: Tables) -> DataFrame:
    path = sinks.scratch(t.spark, "splits")
    names = [f"r{r['n_regionkey']}" for r in t.nation.select("n_regionkey").distinct().collect()]
    for name in names:
        sinks.write_tsv(t.nation.filter(F.concat(F.lit("r"), "n_regionkey") == name), f"{path}/{name}.tsv", ["n_nationkey", "n_name"])
    splits = readers.read_tsv_splits(t.spark, readers.list_files(t.spark, path, "*.tsv"), ["n_nationkey", "n_name"])
    parts = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    return reduce(DataFrame.unionByName, parts).select("split", "n_nationkey", "n_name")


@query("SRC7 PRJ22", "select r_name as plan, string_agg(n_name, ',' order by n_name) as arg_keys from nation join region on n_regionkey = r_regionkey group by r_name")
def src7_json_map(t: Tables) -> DataFrame:
    rows = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("n"))
    whole = rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "n")))).alias("value"))
    path = sinks.scratch(t.spark, "map")
    whole.write.text(path)
    return readers.read_json_map(t.spark, path).select("plan", F.array_join("arg_keys", ",").alias("arg_keys"))


@query("SRC8 JN13", "select n_name as source, r_name as next, 'r' || n_regionkey as reason from nation join region on n_regionkey = r_regionkey")
def src8_catalog_edges(t: Tables) -> DataFrame:
    joined = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    nxt = F.array(F.struct(F.col("r_name").alias("plan"), F.concat(F.lit("r"), "n_regionkey").alias("reason")))
    path = sinks.scratch(t.spark, "catalog")
    sinks.write_jsonl(joined.select(F.col("n_name").alias("plan"), nxt.alias("next_turn_plans")), path)
    return readers.catalog_edges(readers.read_catalog(t.spark, path, edges=True))


@query("SRC9 SRC10 SRC11 SNK3", "select o_orderstatus, count(*)::BIGINT as n, sum(o_orderkey)::BIGINT as keys from orders where o_orderstatus <> 'P' group by o_orderstatus")
def src9_file_groups(t: Tables) -> DataFrame:
    path = sinks.scratch(t.spark, "groups")
    sinks.write_partitioned(t.orders.select("o_orderkey", "o_orderstatus"), path, ["o_orderstatus"])
    files = readers.file_group(readers.list_files(t.spark, path, "o_orderstatus=*/*.parquet"), exclude="o_orderstatus=P")
    rows = readers.with_provenance(t.spark.read.option("basePath", path).parquet(*files))
    return rows.groupBy("o_orderstatus").agg(F.count("source_file").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SRC12 SNK10", "select lang as label, 'all' as bucket, 'n' as file, count(*)::DOUBLE as value from documents group by lang union all select lang, 'all', 'chars', sum(n_chars)::DOUBLE from documents group by lang")
def src12_matrix(t: Tables) -> DataFrame:
    body = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c")).select(F.concat_ws("\t", "lang", "n", "c").alias("value"))
    head = t.spark.createDataFrame([("\tall\tall",), ("\tn\tchars",)], "value string")
    path = sinks.scratch(t.spark, "matrix")
    head.withColumn("o", F.lit(0)).union(body.withColumn("o", F.lit(1))).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return readers.read_matrix(t.spark, path)


@query("SRC14 SC1", r"select item_id::VARCHAR as source_id, 1 as turn_index, 'u' as user, trim(regexp_replace(text, '[\t\n\x0b\f\r ]+', ' ', 'g')) as assistant from benchmark where trim(text) <> ''")
def src14_dirty_pairs(t: Tables) -> DataFrame:
    record = F.to_json(F.struct(F.col("item_id").cast("string").alias("source_id"), F.lit(1).alias("turn_index"), F.lit(" u ").alias("user"), F.col("text").alias("assistant")))
    path = sinks.scratch(t.spark, "dirty")
    t.benchmark.select(F.concat(F.lit("noise "), record).alias("value")).union(t.spark.createDataFrame([("no object",)], "value string")).write.text(path)
    return readers.read_dirty_pairs(t.spark, path)


@query("SRC15 SRC16", "select 'it2_nonNR' as file, source as plan, count(*)::INT as wanted from documents group by source")
def src15_deficits(t: Tables) -> DataFrame:
    path = sinks.scratch(t.spark, "deficits")
    t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws(" ", F.lit("it2_nonNR"), "source", "n").alias("value")).coalesce(1).write.text(path)
    return readers.require_columns(readers.read_deficits(t.spark, path, turn=2, mode="nonNR"), ["file", "plan", "wanted"])


@query("SNK9", r"""select 0::BIGINT as place, '| r_regionkey | r_name |' as line union all select 1, '| --- | --- |' union all select 2 + row_number() over (order by r_regionkey) - 1, '| ' || r_regionkey || ' | ' || r_name || ' |' from region
union all select 100, '\begin{tabular}{ll}' union all select 101, 'r_regionkey & r_name \\ \hline' union all select 102 + row_number() over (order by r_regionkey) - 1, r_regionkey || ' & ' || r_name || ' \\' from region union all select 102 + count(*), '\end{tabular}' from region""")
def snk9_markdown(t: Tables) -> DataFrame:
    table = t.region.select("r_regionkey", "r_name").orderBy("r_regionkey")
    rows = [*enumerate(sinks.markdown(table).splitlines()), *enumerate(sinks.latex(table).splitlines(), 100)]
    return t.spark.createDataFrame(rows, "place long, line string")


@query("UD3 UD6", "select distinct source as plan, 4::BIGINT as n from documents")
def ud3_collect(t: Tables) -> DataFrame:
    """Each round makes up to three of the missing rows, so a plan needs two rounds for four."""
    shared_dir(t.spark)
    plans = t.documents.select(F.col("source").alias("plan")).distinct()

    def produce(short: DataFrame, n: int) -> DataFrame:
        return short.select("plan", F.explode(F.sequence(F.lit(1), F.least("missing", F.lit(3)).cast("int"))).alias("_pos"))

    return generation.collect_until(plans, "plan", 4, produce).groupBy("plan").agg(F.count(F.lit(1)).alias("n"))


@query("SRC13", """select (s_suppkey // 2000)::VARCHAR as book, s_nationkey::VARCHAR as sheet, (1 + row_number() over (partition by s_suppkey // 2000, s_nationkey order by s_suppkey))::BIGINT as row, s_suppkey::VARCHAR as key, s_name as name from supplier""")
def src13_sheets(t: Tables) -> DataFrame:
    """Suppliers in workbooks of at most 2,000, a sheet for each nation, read back from the stored bytes; headers are left out."""
    rows = t.supplier.select(F.floor(F.col("s_suppkey") / 2000).cast("string").alias("book"), "s_nationkey", "s_suppkey", "s_name")
    books = stored(sheets.workbooks(rows, "book", "s_nationkey"), "workbooks")
    cells = sheets.workbook_rows(books).filter("row > 1")
    return cells.select(F.col("path").alias("book"), "sheet", "row", F.get("cells", 0).alias("key"), F.get("cells", 1).alias("name"))
