"""The seam for generators: a callable over prompts, with retries, errors as rows, a bounded number in flight and a stop on quota errors.

Nothing here calls a network; ``stub`` is a deterministic generator for tests and
dry runs. Results carry ``_pos``, so order can be restored.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Temperatures of the retry ladder.
LADDER = (0.0, 0.2, 0.5)
#: The error of prompts that were not asked because the quota was used up before.
NOT_ASKED = "not asked: quota exceeded"

A, B = TypeVar("A"), TypeVar("B")


class QuotaExceeded(RuntimeError):
    """Raised by a backend whose quota is used up; further calls are of no use."""


def stub(prompt: str, temperature: float = 0.0) -> str:
    """A call whose plan and argument follow from the prompt's md5; every ninth prompt needs a retry."""
    h = int(hashlib.md5(prompt.encode()).hexdigest(), 16)
    if temperature == 0.0 and h % 9 == 0:
        return "I cannot answer that."
    return json.dumps({"plan": f"plan_{h % 5}", "arguments": {"n": h % 100}})


def in_order(pool: ThreadPoolExecutor, call: Callable[[A], B], items: Iterable[A], most: int) -> Iterator[B]:
    """Results in the items' order, with ``most`` calls under way or waiting to be taken at any time."""
    waiting: deque = deque()
    for item in items:
        waiting.append(pool.submit(call, item))
        if len(waiting) >= most:
            yield waiting.popleft().result()
    while waiting:
        yield waiting.popleft().result()


class QuotaWatch:
    """Ends a run once a backend's quota is used up, without any task being tried again.

    A task that meets the error raises nothing, as Spark would run it anew and
    ask the backend up to ``spark.task.maxFailures`` times more. It asks no further
    prompts, says so in an accumulator, and ends. ``run`` tags the jobs of an action;
    a thread sees the accumulator and cancels them by the tag, so that no further
    task begins. Spark looks after cancelled Python workers every two seconds and
    ends them ``spark.python.task.killTimeout`` later; until then those on other
    machines may go on with their next prompts.
    """

    def __init__(self, spark: SparkSession, every_s: float = 0.05):
        self.spark, self.every_s = spark, every_s
        self.errors = spark.sparkContext.accumulator(0)

    def run(self, action: Callable[[], A]) -> A:
        """What the action returns; QuotaExceeded if any of its prompts met the quota's end."""
        sc, tag, done = self.spark.sparkContext, f"quota-{uuid.uuid4().hex}", threading.Event()

        def cancel_when_told() -> None:
            while not done.wait(self.every_s):
                if self.errors.value:
                    sc.cancelJobsWithTag(tag)

        sc.addJobTag(tag)
        listener = threading.Thread(target=cancel_when_told, daemon=True)
        listener.start()
        try:
            out = action()
        except Exception as e:
            if self.errors.value:
                raise QuotaExceeded("the quota was used up; the run's jobs were cancelled") from e
            raise
        finally:
            done.set()
            listener.join()
            sc.removeJobTag(tag)
        if self.errors.value:
            raise QuotaExceeded("the quota was used up in the last tasks of the run")
        return out


def generate(df: DataFrame, prompt: str, backend: Callable[[str, float], str], valid: Callable[[str], bool], tasks: int | None = None, in_flight: int = 1, watch: QuotaWatch | None = None) -> DataFrame:
    """Add output, attempts, valid, error and ``_pos``: the ladder is climbed until an output is valid.

    ``in_flight`` prompts of a task are asked at the same time, and ``tasks`` bounds
    the tasks. Rows keep their order within a task; ``_pos`` (kept if there is one)
    rises with the input's order over all. Exceptions become error rows. After
    QuotaExceeded the rest of the task's prompts aren't asked and say so; with a
    ``watch`` its ``run`` ends the other tasks too.
    """
    errors = watch.errors if watch else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = threading.Event()

        def climb(text: str | None) -> tuple[str | None, int, bool, str | None]:
            out, error, ok, n = None, None, False, 0
            for n, temperature in enumerate(LADDER, 1):
                if stopped.is_set():
                    return None, n - 1, False, NOT_ASKED
                try:
                    out, error = backend(text or "", temperature), None
                    ok = valid(out)
                except Exception as e:  # noqa: BLE001  a row's failure is that row's result
                    error = f"{type(e).__name__}: {e}"
                    # by name: a class that travelled by value isn't the one that the backend's module has
                    if any(c.__name__ == QuotaExceeded.__name__ for c in type(e).__mro__):
                        stopped.set()
                        return None, n, False, error
                if ok:
                    break
            return out, n, ok, error

        with ThreadPoolExecutor(in_flight) as pool:
            for pdf in frames:
                rows = list(in_order(pool, climb, pdf[prompt], in_flight))
                yield pdf.assign(**{name: [r[k] for r in rows] for k, name in enumerate(("output", "attempts", "valid", "error"))})
        if errors is not None and stopped.is_set():
            errors.add(1)

    placed = df if "_pos" in df.columns else df.withColumn("_pos", F.monotonically_increasing_id())
    dealt = placed.repartition(tasks) if tasks else placed
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    return dealt.mapInPandas(run, f"{schema}, output string, attempts int, valid boolean, error string")


def model_retrieve(df: DataFrame, query: str, catalog: dict[str, str], n: int, backend: Callable[[str, float], str]) -> DataFrame:
    """Add ``tools``: the names that a generator picks for the query from a catalog (name to description), unknown ones left out.

    The prompt lists every name with the first line of its description. An
    answer that is no JSON list of strings gives no tools.
    """
    listed = "\n".join(f"{name}: {about.strip().splitlines()[0] if about.strip() else ''}" for name, about in catalog.items())
    head = f"Tools:\n{listed}\nAnswer with a JSON list of the names of {n} tools that suit the request.\nRequest: "
    asked = df.withColumn("__prompt", F.concat(F.lit(head), F.coalesce(query, F.lit(""))))
    out = generate(asked, "__prompt", backend, lambda x: x.lstrip().startswith("["))
    known = F.array(*map(F.lit, catalog))
    names = F.coalesce(F.from_json("output", "array<string>"), F.array().cast("array<string>"))
    return out.withColumn("tools", F.filter(names, lambda x: F.array_contains(known, F.coalesce(x, F.lit(""))))).select(*df.columns, "tools")


def two_stage(df: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], error: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose first stage failed skip the second: (second stage's rows, failed rows)."""
    done = first(df)
    return second(done.filter(F.col(error).isNull())), done.filter(F.col(error).isNotNull())


@dataclass
class FilterChain:
    """Named steps of preprocess (frame to frame) and validate (predicate); rejected rows tell the step."""

    steps: list[tuple[str, Callable[[DataFrame], DataFrame], Column | None]] = field(default_factory=list)

    def add(self, name: str, keep: Column | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> FilterChain:
        self.steps.append((name, prepare, keep))
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        """All rows with ``rejected_by``: the first step that rejects them, or null."""
        df = df.withColumn("rejected_by", F.lit(None).cast("string"))
        for name, prepare, keep in self.steps:
            df = prepare(df)
            if keep is not None:
                df = df.withColumn("rejected_by", F.coalesce("rejected_by", F.when(~F.coalesce(keep, F.lit(False)), name)))
        return df


def render(template: str, columns: Sequence[str]) -> Column:
    """A prompt from a format string with %s for each column; nulls render as empty."""
    return F.format_string(template, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def map_rows(df: DataFrame, made: dict[str, Column], remove: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Add or replace columns, pass over rows for which any of them is null, take columns away; ``limit`` reads only so many results."""
    out = df.withColumns(made)
    for name in made:
        out = out.filter(F.col(name).isNotNull())
    out = out.drop(*remove)
    return out if limit is None else out.limit(limit)


def harden(df: DataFrame, plan: str, rules: dict[str, Column], target: str) -> DataFrame:
    """Rewrite ``target`` by the rule of the row's plan; ``before`` keeps the old value."""
    out = F.col(target)
    for name, rule in rules.items():
        out = F.when(F.col(plan) == name, rule).otherwise(out)
    return df.withColumn("before", F.col(target)).withColumn(target, out).withColumn("changed", ~F.col("before").eqNullSafe(F.col(target)))


def collect_until(targets: DataFrame, key: str, wanted: int, produce: Callable[[DataFrame, int], DataFrame], rounds: int = 3) -> DataFrame:
    """Rounds of production for keys that still lack accepted rows; ``produce`` gets (key, missing) and the round.

    Surplus rows of a key are dropped in their order ``_pos``. Each round is cut by
    a checkpoint, so the plan doesn't grow with the rounds.
    """
    from turnloom.operators.ranking import head_n

    got: DataFrame | None = None
    for n in range(rounds):
        have = targets.select(key) if got is None else targets.select(key).join(got.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), key, "left")
        missing = F.lit(wanted) if got is None else F.lit(wanted) - F.coalesce("__n", F.lit(0))
        short = have.withColumn("missing", missing).filter("missing > 0").select(key, "missing")
        made = produce(short, n).withColumn("__round", F.lit(n))
        got = made if got is None else got.unionByName(made)
        got = head_n(got, [key], ["__round", "_pos"], wanted).checkpoint()
        if got.count() >= targets.count() * wanted:
            break
    return got.drop("__round")
