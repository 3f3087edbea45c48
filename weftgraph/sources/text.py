"""Readers and writers of the text formats: program text, labelled graphs, line diffs, points-to results, Graphviz."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.cfl import NONE

# The statement kinds of the program text.
KINDS = ("addr", "copy", "load", "store", "gep", "variant-gep", "call", "ret", "cmp", "binary-op", "unary-op")


def program(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, statements) of a program text: lines `id v|o` and `src kind dst offset`; any other line is an error."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t")).where("t[0] <> ''")
    bad = F.raise_error(F.concat(F.lit("not a node or statement: "), F.array_join("t", " ")))
    n = F.size("t")
    good = ((n == 2) & F.col("t")[1].isin("v", "o")) | ((n == 4) & F.col("t")[1].isin(*KINDS))
    lines = lines.where(F.when(good, F.lit(True)).otherwise(bad))
    nodes = lines.where("size(t) = 2").select(F.col("t")[0].cast("long").alias("node"), F.col("t")[1].alias("type"))
    stmt = lines.where("size(t) = 4").select(F.col("t")[1].alias("kind"), F.col("t")[0].cast("long").alias("src"), F.col("t")[2].cast("long").alias("dst"), F.col("t")[3].cast("long").alias("off"))
    return nodes, stmt


def _labelled(label) -> list:
    """sym and attr of a label: `x_12` is `x_i` with attribute 12."""
    number = F.regexp_extract(label, r"_(\d+)$", 1)
    return [F.when(number != "", F.concat(F.regexp_extract(label, r"^(.*)_\d+$", 1), F.lit("_i"))).otherwise(label).alias("sym"), F.when(number != "", number.cast("long")).otherwise(NONE).alias("attr")]


def labelled_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, sym, attr) of a tab-separated file `src dst label`."""
    rows = spark.read.csv(path, sep="\t", schema="src long, dst long, label string").where("label is not null")
    return rows.select("src", "dst", *_labelled(F.trim("label")))


def labelled_dot(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, sym, attr) of Graphviz lines `Node<hex> -> Node<hex>[...label=L...]`."""
    found = r"Node(?:0x)?([0-9a-fA-F]+)\s*->\s*Node(?:0x)?([0-9a-fA-F]+)\s*\[.*label=\"?([^,\]\"]+)"
    parts = spark.read.text(path).select(*[F.regexp_extract("value", found, i).alias(n) for i, n in ((1, "s"), (2, "d"), (3, "label"))]).where("s <> ''")
    hexed = lambda c: F.conv(c, 16, 10).cast("long")
    return parts.select(hexed("s").alias("src"), hexed("d").alias("dst"), *_labelled(F.trim("label")))


def labelled_json(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, sym, attr) of JSON lines {src, dst, label}."""
    rows = spark.read.schema("src long, dst long, label string").json(path)
    return rows.select("src", "dst", *_labelled(F.col("label")))


def line_diff(spark: SparkSession, path: str) -> DataFrame:
    """(op, path, row_start, row_end) of a normal-format diff: op 1 for added rows of the new file, 2 for deleted ones of the old.

    A `diff` line names the files of the hunks after it, so lines are numbered in file order: diffs are read as one text a file.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"), F.input_file_name().alias("file"))
    head = F.when(F.col("line").startswith("diff "), F.element_at(F.split(F.trim("line"), r"\s+"), -1))
    named = lines.withColumn("path", F.last(head, ignorenulls=True).over(Window.partitionBy("file").orderBy("at")))
    hunk = r"^(\d+)(?:,(\d+))?([acd])(\d+)(?:,(\d+))?$"
    parts = named.select("path", *[F.regexp_extract("line", hunk, i).alias(n) for i, n in enumerate(("a", "b", "how", "c", "d"), 1)]).where("how <> ''")
    end = lambda x, y: F.when(F.col(y) == "", F.col(x)).otherwise(F.col(y)).cast("int")
    added = parts.where("how in ('a', 'c')").select(F.lit(1).alias("op"), "path", F.col("c").cast("int").alias("row_start"), end("c", "d").alias("row_end"))
    deleted = parts.where("how in ('d', 'c')").select(F.lit(2).alias("op"), "path", F.col("a").cast("int").alias("row_start"), end("a", "b").alias("row_end"))
    return added.unionByName(deleted)


def write_points_to(pts: DataFrame, path: str) -> None:
    """`var -> { o1 o2 }` lines, objects ascending."""
    sets = pts.groupBy("var").agg(F.array_join(F.sort_array(F.collect_set("obj")), " ").alias("objs"))
    sets.select(F.concat(F.col("var").cast("string"), F.lit(" -> { "), F.col("objs"), F.lit(" }")).alias("value")).write.text(path)


def read_points_to(spark: SparkSession, path: str) -> DataFrame:
    """(var, obj) of `var -> { o1 o2 }` lines."""
    form = r"^\s*(\d+)\s*->\s*\{\s*([\d\s]*?)\s*\}"
    parts = spark.read.text(path).select(F.regexp_extract("value", form, 1).alias("var"), F.regexp_extract("value", form, 2).alias("objs")).where("var <> '' and objs <> ''")
    return parts.select(F.col("var").cast("long").alias("var"), F.explode(F.split("objs", r"\s+").cast("array<long>")).alias("obj"))


def write_dot(edges: DataFrame, path: str, label: str | None = None) -> None:
    """Edges (src, dst) as Graphviz lines; put between `digraph {` and `}` they are a graph."""
    tail = F.concat(F.lit(' [label="'), F.col(label).cast("string"), F.lit('"]')) if label else F.lit("")
    edges.select(F.concat(F.lit("Node"), F.lower(F.hex("src")), F.lit(" -> Node"), F.lower(F.hex("dst")), tail, F.lit(";")).alias("value")).write.text(path)
