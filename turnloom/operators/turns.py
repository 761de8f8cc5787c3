"""The turn loop: ten stages a turn, each a table keyed by what it was made from, so that a rerun starts where the last one stopped."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import literals
from turnloom.operators import generation, joins, ranking, sampling
from turnloom.streaming.events import remaining


def digest(*parts: object) -> str:
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()[:32]


def source_print(df: DataFrame) -> str:
    """A fingerprint of a table's files: names, sizes and times, summed up by Spark, so that no list of them is held."""
    files = df.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")).distinct()
    found = files.agg(F.expr("bit_xor(h)").alias("x"), F.count(F.lit(1)).alias("n")).first()
    return digest("files", found["x"], found["n"])


@dataclass(frozen=True)
class Stage:
    """A table and the fingerprint of all that it was made from."""

    df: DataFrame
    print: str


@dataclass
class StageTables:
    """Tables of stages in a folder. A table whose success mark is there isn't made again.

    A stage's fingerprint holds its name, its parameters and the fingerprints of its inputs,
    so a change of any of them makes it, and what follows from it, anew. A table
    that was being written when a run died has no mark and is written over.
    ``made`` names the stages that this object has run.
    """

    spark: SparkSession
    folder: str
    made: list[str] = field(default_factory=list)

    def source(self, df: DataFrame) -> Stage:
        """A table as it is read from its files."""
        return Stage(df, source_print(df))

    def done(self, path: str) -> bool:
        mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(mark)

    def run(self, name: str, make: Callable[..., DataFrame], inputs: Mapping[str, Stage], **params: object) -> Stage:
        key = digest(name, sorted(params.items()), *(f"{k}={inputs[k].print}" for k in sorted(inputs)))
        path = f"{self.folder}/{name}-{key}"
        if not self.done(path):
            make(**{k: s.df for k, s in inputs.items()}, **params).write.mode("overwrite").parquet(path)
            self.made.append(name)
        return Stage(self.spark.read.parquet(path), key)


RECORD = ["unique_idx", "query", "rewrited_query", "plan", "history"]


@dataclass
class TurnLoop:
    """Conversations that grow a turn at a time from seed records (``RECORD``'s columns), with a generator behind every stage that asks one.

    Stages of a turn, in order: respond (the device answers the query), index
    (answers are joined back by query, the k-th from the end to the k-th), follow (the next
    query and its plan), place (joined back by lineage), dedup (a query stays
    once; records without references, marked ``_NR``, are exempt), rewrite (the
    query without references), act (the plan of the rewrite), fill (records of
    spare seeds for plans below ``least``), balance (each origin's share of
    plans above a hundred rows is cut by ``quota_ladder``) and filter (what a judge fails goes).
    Records keep their lineage in ``unique_idx``: the origin's, the plan, and a
    number.
    """

    tables: StageTables
    backend: Callable[[str, float], str] = generation.stub
    least: int = 50
    name: str = "stub"

    def ask(self, df: DataFrame, template: str, columns: Sequence[str], out: str) -> DataFrame:
        """The rows whose answer was read, with the plan that it names as ``out``."""
        asked = generation.generate(df.withColumn("__prompt", generation.render(template, columns)), "__prompt", self.backend, literals.parses, in_flight=4)
        read = asked.filter("valid").withColumn(out, F.get_json_object(literals.read_generation(F.col("output"))["call"], "$.plan"))
        return read.select(*df.columns, out)

    def respond(self, seeds: DataFrame) -> DataFrame:
        return self.ask(seeds.select("query", "unique_idx"), "Respond: %s", ["query"], "response").select("query", "response", F.col("unique_idx").alias("asked_for"))

    def index(self, seeds: DataFrame, answers: DataFrame) -> DataFrame:
        met = joins.bag_join(seeds, answers, ["query"], ["unique_idx"], ["asked_for"])
        said = F.concat(F.lit("turn "), (F.size("history") + 1).cast("string"), F.lit(": "), "query", F.lit(" -> "), "response")
        return met.select("unique_idx", F.concat("history", F.array(said)).alias("history"), F.col("query").alias("asked"), "response", "plan")

    def follow(self, turns: DataFrame) -> DataFrame:
        return self.ask(turns.select("unique_idx", "asked", "response"), "Follow %s after %s", ["asked", "response"], "plan").select(F.col("unique_idx").alias("origin"), F.concat(F.lit("then "), "plan", F.lit(" as "), "asked").alias("query"), "plan")

    def place(self, turns: DataFrame, follows: DataFrame) -> DataFrame:
        met = turns.select("unique_idx", "history").join(follows.withColumnRenamed("origin", "unique_idx"), "unique_idx")
        return ranking.ranked(met, ["unique_idx", "plan"], ["query"], "__n").select(F.concat_ws("-", "unique_idx", "plan", F.col("__n").cast("string")).alias("unique_idx"), "query", "plan", "history")

    def dedup(self, placed: DataFrame) -> DataFrame:
        return ranking.keep_first_exempt(placed, ["query"], ["unique_idx"], F.col("unique_idx").endswith("_NR"))

    def rewrite(self, kept: DataFrame) -> DataFrame:
        return self.ask(kept, "Rewrite: %s", ["query"], "said").select("unique_idx", "query", F.concat("query", F.lit(" / "), "said").alias("rewrited_query"), "history")

    def act(self, rewrites: DataFrame) -> DataFrame:
        return self.ask(rewrites, "Act: %s", ["rewrited_query"], "plan").select(*RECORD)

    def fill(self, records: DataFrame, spare: DataFrame, turns: DataFrame) -> DataFrame:
        short = remaining(spare.select("plan").distinct(), records, "plan", self.least)
        fresh = joins.zip_join(spare.select("plan", F.col("query").alias("fresh"), "unique_idx"), turns.select("plan", "history", F.col("unique_idx").alias("origin")), ["plan"], ["unique_idx"], ["origin"])
        taken = fresh.join(short, "plan").filter("place <= missing")
        return taken.select(F.concat_ws("-", "origin", "plan", F.concat(F.col("place").cast("string"), F.lit("_NR"))).alias("unique_idx"), F.col("fresh").alias("query"), F.col("fresh").alias("rewrited_query"), "plan", "history")

    def balance(self, records: DataFrame, filled: DataFrame) -> DataFrame:
        every = ranking.keep_first(records.unionByName(filled), ["unique_idx"], ["query"])
        parts = F.split("unique_idx", "-")
        keyed = every.withColumn("origin", F.element_at(parts, 2))
        counts = keyed.groupBy("plan", "origin").agg(F.count(F.lit(1)).alias("of"))
        totals = counts.groupBy("plan").agg(F.sum("of").alias("total"))
        share = F.greatest(F.floor(F.col("of") * ranking.quota_ladder(F.col("total"))), F.lit(1))
        quotas = counts.join(totals, "plan").select("plan", "origin", share.cast("long").alias("quota")).filter("quota is not null")
        kept = sampling.capped_sample(keyed.join(quotas, ["plan", "origin"], "left"), ["plan", "origin"], "unique_idx", F.coalesce("quota", F.lit(2**62)), "balance")
        return kept.select(*RECORD)

    def judge(self, records: DataFrame) -> DataFrame:
        verdicts = self.ask(records.select("unique_idx", "query"), "Judge: %s", ["query"], "verdict")
        return joins.drop_failed(records, verdicts, "unique_idx", F.col("verdict") == "plan_4")

    def run(self, seeds: Stage, spare: Stage, turns: int) -> Stage:
        """Records after so many turns."""
        run = lambda name, make, **inputs: self.tables.run(f"{at}-{name}", make, inputs, backend=self.name)
        made = lambda make: lambda backend, **frames: make(**frames)
        now = seeds
        for n in range(1, turns + 1):
            at = f"turn{n}"
            answers = run("respond", made(self.respond), seeds=now)
            indexed = run("index", made(self.index), seeds=now, answers=answers)
            follows = run("follow", made(self.follow), turns=indexed)
            placed = run("place", made(self.place), turns=indexed, follows=follows)
            kept = run("dedup", made(self.dedup), placed=placed)
            rewrites = run("rewrite", made(self.rewrite), kept=kept)
            acted = run("act", made(self.act), rewrites=rewrites)
            filled = self.tables.run(f"{at}-fill", lambda backend, least, **frames: self.fill(**frames), {"records": acted, "spare": spare, "turns": indexed}, backend=self.name, least=self.least)
            balanced = run("balance", made(self.balance), records=acted, filled=filled)
            now = run("filter", made(self.judge), records=balanced)
        return now


def seed_records(rows: DataFrame, key: str, query: str, plan: str) -> DataFrame:
    """Seeds of a loop (``RECORD``'s columns): no history yet, the query stands for itself, lineage by plan and key."""
    idx = F.concat_ws("-", F.lit("seed"), F.col(plan), F.col(key).cast("string"))
    return rows.select(idx.alias("unique_idx"), F.col(query).alias("query"), F.col(query).alias("rewrited_query"), F.col(plan).alias("plan"), F.array().cast("array<string>").alias("history"))
