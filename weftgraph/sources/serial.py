"""Programs and results on disk: tables as JSON, results and their field objects as text, versioned results, listings of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import read_points_to, write_points_to

# The columns of a program's tables.
TABLES = {
    "var": "node_id long, kind string, is_ptr boolean, base long, fld long, is_const boolean, is_blackhole boolean, storage string, is_array boolean, max_fld long, fun string",
    "stmt": "edge_id long, kind string, src long, dst long, off long, variant boolean, op_pos int, icfg long, cs long, fun string, path string, line int",
    "call_edge": "caller long, callee long, callsite long, kind string, is_indirect boolean",
}


def write_program(tables: dict[str, DataFrame], path: str) -> None:
    """JSON lines, a folder for each table; columns that a table lacks are null when read."""
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"not a table of a program: {name}")
        df.write.json(f"{path}/{name}")


def read_program(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """The named tables with their fixed columns; a line that is no JSON object is an error."""
    return {n: spark.read.schema(TABLES[n]).option("mode", "FAILFAST").json(f"{path}/{n}") for n in names or TABLES}


def write_results(pts: DataFrame, fields: DataFrame, insensitive: DataFrame, path: str) -> None:
    """The three parts of a result, a folder each: `var -> { objects }`, `base offset field object`, `object 0|1`."""
    write_points_to(pts, f"{path}/sets")
    fields.select(F.concat_ws(" ", "base", "off", "obj").alias("value")).write.text(f"{path}/fields")
    insensitive.select(F.concat_ws(" ", "obj", F.col("insensitive").cast("int")).alias("value")).write.text(f"{path}/insensitive")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pts (var, obj), fields (base, off, obj) and insensitive (obj, insensitive)."""
    t = F.split(F.trim("value"), r"\s+")
    fields = spark.read.text(f"{path}/fields").select(*[t[i].cast("long").alias(n) for i, n in enumerate(("base", "off", "obj"))])
    flags = spark.read.text(f"{path}/insensitive").select(t[0].cast("long").alias("obj"), (t[1] == "1").alias("insensitive"))
    return read_points_to(spark, f"{path}/sets"), fields, flags


def write_versions(vpts: DataFrame, path: str) -> None:
    """`object version -> { targets }` lines, targets ascending."""
    sets = vpts.groupBy("obj", "version").agg(F.array_join(F.sort_array(F.collect_set("target")), " ").alias("t"))
    sets.select(F.concat(F.concat_ws(" ", "obj", "version"), F.lit(" -> { "), F.col("t"), F.lit(" }")).alias("value")).write.text(path)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """(obj, version, target)."""
    form = r"^\s*(\d+)\s+(-?\d+)\s*->\s*\{\s*([\d\s]*?)\s*\}"
    parts = spark.read.text(path).select(*[F.regexp_extract("value", form, i).alias(n) for i, n in enumerate(("obj", "version", "t"), 1)]).where("obj <> '' and t <> ''")
    return parts.select(F.col("obj").cast("long").alias("obj"), F.col("version").cast("long").alias("version"), F.explode(F.split("t", r"\s+").cast("array<long>")).alias("target"))


def write_changes(rows: DataFrame, path: str) -> None:
    """A listing of changed statements (op '+' or '-', kind, src, dst): `+ src kind dst`."""
    rows.select(F.concat_ws(" ", "op", "src", "kind", "dst").alias("value")).write.text(path)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    t = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(t[0].alias("op"), t[2].alias("kind"), t[1].cast("long").alias("src"), t[3].cast("long").alias("dst"))


def show(df: DataFrame, *by: str, rows: int = 20) -> None:
    """The first rows in order, printed."""
    (df.orderBy(*by) if by else df).show(rows, truncate=False)
