"""Scans: JSONL, TSV with literal cells, catalogs, file groups, dirty lines, matrices, deficit lists."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BOM = "﻿"


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One record per line, blank lines passed over; a malformed line raises, or with strict off is dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(paths if isinstance(paths, str) else list(paths))


def read_tsv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """All-string TSV with a header and quoted cells that may span lines; a byte order mark is stripped."""
    df = spark.read.csv(paths if isinstance(paths, str) else list(paths), sep="\t", header=True, quote='"', escape='"', multiLine=True, enforceSchema=False)
    df = df.toDF(*[c.removeprefix(BOM) for c in df.columns])
    return df.select(*columns) if columns else df


def read_tsv_splits(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """One table per file or folder, by the name of it without its suffix; two of the same name raise."""
    names = [path.rstrip("/").rpartition("/")[2].partition(".")[0] for path in paths]
    if len(set(names)) < len(names):
        raise ValueError(f"two files give one split: {sorted(names)}")
    return {name: read_tsv(spark, path, columns) for name, path in zip(names, paths)}


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of name to list of names, as (plan, arg_keys) rows."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("plan", "arg_keys"))


CATALOG = "plan string, description string, arguments map<string,struct<description:string,type:string,required:boolean,default:string>>, next_turn_plans array<struct<plan:string,reason:string,example:string>>"


def read_catalog(spark: SparkSession, path: str, edges: bool = False) -> DataFrame:
    """The tool catalog, last entry of a plan wins; without ``edges`` the next plans are dropped."""
    lines = spark.read.text(path).withColumn("_pos", F.monotonically_increasing_id())
    parsed = lines.select("_pos", F.from_json("value", CATALOG).alias("c")).filter("c.plan is not null").select("_pos", "c.*")
    last = Window.partitionBy("plan").orderBy(F.desc("_pos"))
    kept = parsed.withColumn("__rn", F.row_number().over(last)).filter("__rn = 1").drop("__rn", "_pos")
    return kept if edges else kept.drop("next_turn_plans")


def catalog_keys(catalog: DataFrame) -> DataFrame:
    return catalog.select("plan", F.array_sort(F.map_keys("arguments")).alias("arg_keys"))


def catalog_edges(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.col("plan").alias("source"), F.explode("next_turn_plans").alias("n")).select("source", F.col("n.plan").alias("next"), F.col("n.reason").alias("reason"))


def natural_key(path: str) -> list:
    """Digits compare as numbers: it2 before it10."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", path) if x]


def file_group(paths: Sequence[str], include: str = "", exclude: str = "", extra: Sequence[str] = ()) -> list[str]:
    """Matching paths in natural order without repeats, then the extra ones."""
    chosen = sorted({p for p in paths if re.search(include, p) and not (exclude and re.search(exclude, p))}, key=natural_key)
    return list(dict.fromkeys([*chosen, *extra]))


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> list[str]:
    """Names that match, through the file system that the path belongs to."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{glob}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted((s.getPath().toString() for s in found or []), key=natural_key)


def with_provenance(df: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Add source_file, and the columns of a registry keyed by it."""
    named = df.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return named.join(registry, "source_file", "left") if registry is not None else named


def parse_test_keys(given: str, known: Sequence[str]) -> list[str]:
    """Comma list in its order without repeats; unknown keys raise."""
    keys = list(dict.fromkeys(k.strip() for k in given.split(",") if k.strip()))
    unknown = [k for k in keys if k not in known]
    if unknown or not keys:
        raise ValueError(f"unknown test keys {unknown}, known are {sorted(known)}")
    return keys


def read_dirty_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of user/assistant pairs with noise before the object; pairs with an empty side go."""
    line = F.substring(F.col("value"), F.locate("{", F.col("value")), F.length("value"))
    rows = spark.read.text(path).filter(F.col("value").contains("{")).select(F.from_json(line, "source_id string, turn_index int, user string, assistant string").alias("r")).select("r.*")
    clean = [F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")).alias(c) for c in ("user", "assistant")]
    return rows.select("source_id", "turn_index", *clean).filter("user <> '' and assistant <> ''")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A headerless matrix: row 0 has buckets, row 1 files, column 0 labels; long form (label, bucket, file, value)."""
    raw = spark.read.csv(path, sep="\t", header=False).withColumn("_pos", F.monotonically_increasing_id())
    cells = [c for c in raw.columns if c not in ("_c0", "_pos")]
    bucket, file = raw.orderBy("_pos").limit(2).collect()
    names = F.create_map(*[x for c in cells for x in (F.lit(c), F.struct(F.lit(bucket[c]).alias("bucket"), F.lit(file[c]).alias("file")))])
    body = raw.filter(~F.col("_pos").isin(bucket["_pos"], file["_pos"])).unpivot("_c0", cells, "column", "value")
    named = body.withColumn("n", names[F.col("column")])
    return named.select(F.col("_c0").alias("label"), "n.bucket", "n.file", F.expr("try_cast(value as double)").alias("value")).filter("value is not null")


def read_deficits(spark: SparkSession, path: str, turn: int | None = None, mode: str | None = None) -> DataFrame:
    """Lines 'file plan [count]'; the first line of a plan wins, filtered by the file's turn and mode."""
    rows = spark.read.text(path).withColumn("_pos", F.monotonically_increasing_id()).withColumn("p", F.split(F.trim("value"), r"\s+")).filter(F.size("p") >= 2)
    cut = rows.select("_pos", F.get("p", 0).alias("file"), F.get("p", 1).alias("plan"), F.expr("try_cast(get(p, 2) as int)").alias("wanted"))
    if turn is not None:
        cut = cut.filter(F.regexp_extract("file", r"it(\d+)", 1) == str(turn))
    if mode:
        cut = cut.filter(F.col("file").contains(mode))
    first = Window.partitionBy("plan").orderBy("_pos")
    return cut.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").drop("__rn", "_pos")


def require_columns(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing or (exact and list(df.columns) != list(columns)):
        raise ValueError(f"columns {missing or list(df.columns)} don't meet {list(columns)}")
    return df
