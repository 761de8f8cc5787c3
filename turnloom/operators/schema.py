"""Calls as JSON text against a catalog of tools: compliance, pruned specifications, serialisers, documents of candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arguments_of(call: Column) -> Column:
    """The arguments of a call as map<string,variant>, in their order; null if they are no object."""
    return F.from_json(F.get_json_object(call, "$.arguments"), "map<string,variant>")


def compliance(rows: DataFrame, call: str, catalog: DataFrame, none_plans: Sequence[str] = ("", "none"), allow_none: bool = False, candidates: str | None = None) -> DataFrame:
    """Adds parse_ok, predicted_plan, arguments_is_object, plan_allowed, invalid_keys, keys_subset and compliant.

    ``call`` holds decoded calls as JSON text (null: none could be read), the
    catalog a row for each plan with its ``arg_keys``. A plan is allowed if the
    catalog has it, or if it is none and ``allow_none``. Keys that the plan
    doesn't have are invalid, in the call's order. With ``candidates`` (an array of
    plans) ``in_candidates`` and ``schema_valid`` are added: the plan is among
    them and in the catalog, the arguments are an object and no key is invalid.
    Spark joins the catalog by plan, and broadcasts it only if it is small.
    """
    plan = F.trim(F.coalesce(F.get_json_object(call, "$.plan"), F.lit("")))
    arguments = arguments_of(F.col(call))
    read = rows.withColumns({
        "parse_ok": F.coalesce(F.ltrim(call).startswith("{"), F.lit(False)), "predicted_plan": plan,
        "arguments_is_object": arguments.isNotNull(), "__keys": F.coalesce(F.map_keys(arguments), F.array().cast("array<string>")),
    })
    known = catalog.select(F.col("plan").alias("__plan"), F.coalesce("arg_keys", F.array().cast("array<string>")).alias("__allowed"))
    met = read.join(known, F.col("predicted_plan") == F.col("__plan"), "left")
    none = F.lower("predicted_plan").isin(*none_plans)
    invalid = F.array_except("__keys", F.when(none | F.col("__allowed").isNull(), F.array().cast("array<string>")).otherwise(F.col("__allowed")))
    out = met.withColumn("plan_allowed", F.col("__plan").isNotNull() | (none & F.lit(allow_none))).withColumn("invalid_keys", invalid)
    out = out.withColumn("keys_subset", F.col("arguments_is_object") & (F.size("invalid_keys") == 0))
    out = out.withColumn("compliant", F.col("parse_ok") & F.col("plan_allowed") & F.col("keys_subset"))
    if candidates:
        among = F.coalesce(F.array_contains(candidates, F.col("predicted_plan")), F.lit(False))
        out = out.withColumn("in_candidates", among).withColumn("schema_valid", F.col("compliant") & among & F.col("__plan").isNotNull() & ~none)
    return out.drop("__keys", "__plan", "__allowed")


def pruned_spec(spec: Column, call: Column, dropped: Sequence[str] = ("default", "type")) -> Column:
    """Of a specification (name to its fields) the arguments that a call gives, without the fields ``dropped``."""
    given = F.coalesce(F.map_keys(arguments_of(call)), F.array().cast("array<string>"))
    kept = F.map_filter(spec, lambda name, _: F.array_contains(given, name))
    return F.transform_values(kept, lambda _, fields: F.map_filter(fields, lambda field, __: ~field.isin(*dropped)))


def as_code(call: Column) -> Column:
    """``plan(name=value, ...)`` with values as JSON."""
    given = F.transform(F.map_entries(arguments_of(call)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.to_json(e["value"]), F.lit("null"))))
    return F.concat(F.get_json_object(call, "$.plan"), F.lit("("), F.array_join(F.coalesce(given, F.array().cast("array<string>")), ", "), F.lit(")"))


def as_json(call: Column) -> Column:
    """``{"name": plan, "arguments": {...}}`` with no arguments where they are no object."""
    none = F.create_map().cast("map<string,variant>")
    return F.to_json(F.struct(F.get_json_object(call, "$.plan").alias("name"), F.coalesce(arguments_of(call), none).alias("arguments")))


def tool_docs(rows: DataFrame, key: str, candidates: str, catalog: DataFrame) -> DataFrame:
    """key, docs: a line ``plan(name=?, ...)`` for each candidate that the catalog has, in the candidates' order.

    Candidates of a row are few; they meet the catalog one by one, so a plan that
    a third of all rows have among theirs is Spark's to split.
    """
    asked = rows.select(key, F.posexplode(candidates).alias("__at", "plan"))
    line = F.concat("plan", F.lit("("), F.array_join(F.transform(F.array_sort("arg_keys"), lambda k: F.concat(k, F.lit("=?"))), ", "), F.lit(")"))
    lines = asked.join(catalog.select("plan", line.alias("line")), "plan")
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "line"))), lambda x: x["line"]), "\n").alias("docs"))
