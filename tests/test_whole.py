"""Queries over whole tables leave no row out."""

from pyspark.sql import functions as F

from turnloom import registry

QUERIES = registry.load()


def test_parsers_read_every_event(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    for name in ("sc44_literals", "sc41_markdown", "sc46_calls", "sc49_oneshot"):
        assert QUERIES[name].run(spark, sf).select("event_id").distinct().count() == events, name


def test_top_k_answers_every_twentieth_id(spark, sf):
    want = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 20 = 0").collect()}
    got = QUERIES["sc65_top_k"].run(spark, sf).groupBy("query").count().collect()
    assert {r["query"] for r in got} == want and all(r["count"] == 5 for r in got)


def test_fresh_keys_of_all_new_customers_are_new(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet").collect()
    old = [c.c_custkey for c in customers if c.c_mktsegment == "BUILDING"]
    got = QUERIES["snk4_fresh_keys"].run(spark, sf).collect()
    assert len(got) + len(old) == len(customers) and len({r.id for r in got}) == len(got)
    assert not {r.id for r in got} & {f"C-{k // 10}-{100 + k % 3}" for k in old}


def test_histories_hold_whole_texts(spark, sf):
    said = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"))
    h = QUERIES["sc20_append"].run(spark, sf)
    assert said.join(h, "conv_id").filter("length(h) < n").count() == 0
