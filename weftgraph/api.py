"""The library's front: analyses by name over program tables, and the questions one asks of their results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cfl, inclusion, incremental, sets, slices
from .plans import local
from .plans.scratch import table
from .sources import serial, text


@dataclass
class Options:
    """What can be set from outside; a name that isn't here is refused."""

    #: Fields of an object kept apart; further ones start again at the first.
    field_limit: int = 8
    #: Call sites a context remembers.
    max_context: int = 3
    #: Rounds after which a solver gives up.
    most_rounds: int = 100_000
    #: Statements of a unit that one task may solve; 0: everything by rounds of joins.
    most_local: int = local.MOST_STATEMENTS
    #: How results of several analyses are combined: veto (any "no alias" wins) or conservative (any "may alias" wins).
    alias_rule: str = "veto"
    #: A grammar text for the reachability analysis.
    grammar: str = cfl.VALUE_FLOW

    @classmethod
    def of(cls, given: dict[str, str]) -> Options:
        kinds = {f.name: type(f.default) for f in fields(cls)}
        unknown = sorted(set(given) - set(kinds))
        if unknown:
            raise ValueError(f"unknown options: {', '.join(unknown)}")
        return cls(**{n: kinds[n](v) for n, v in given.items()})


def inclusion_based(stmt: DataFrame, options: Options) -> DataFrame:
    return inclusion.solve(stmt, most_local=options.most_local)["pts"].select("var", "obj")


def unification_based(stmt: DataFrame, options: Options) -> DataFrame:
    return inclusion.unify(stmt, most_local=options.most_local).select("var", "obj")


def field_sensitive(stmt: DataFrame, options: Options) -> DataFrame:
    return inclusion.points_to_fields(stmt, options.field_limit, options.most_local)


#: Whole-program analyses of statements (kind, src, dst, off).
ANALYSES: dict[str, Callable[[DataFrame, Options], DataFrame]] = {"inclusion": inclusion_based, "unification": unification_based, "fields": field_sensitive}


def analyse(name: str, stmt: DataFrame, options: Options | None = None) -> DataFrame:
    if name not in ANALYSES:
        raise ValueError(f"no analysis {name}: there are {', '.join(sorted(ANALYSES))}")
    return ANALYSES[name](stmt, options or Options())


def points_to(pts: DataFrame, var: int) -> DataFrame:
    """The objects (obj) that a variable may point to."""
    return pts.where(F.col("var") == var).select("obj").distinct()


def alias(pts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, result) for each pair (a, b)."""
    return sets.alias_query(pts, pairs)


def combined_alias(results: list[DataFrame], pairs: DataFrame, options: Options | None = None) -> DataFrame:
    """(a, b, result) by several results: one that denies an alias wins under `veto`, one that allows it under `conservative`."""
    said = sets.alias_query(results[0], pairs)
    for pts in results[1:]:
        said = said.unionByName(sets.alias_query(pts, pairs))
    may = F.col("result") == "MayAlias"
    rule = F.bool_and(may) if (options or Options()).alias_rule == "veto" else F.bool_or(may)
    return said.groupBy("a", "b").agg(F.when(rule, "MayAlias").otherwise("NoAlias").alias("result"))


def reachable(edges: DataFrame, start: DataFrame, options: Options | None = None) -> DataFrame:
    """(source, node): along edges (src, dst), with calls and returns matched where they have a sym and an attr."""
    if "sym" not in edges.columns:
        return slices.forward(edges, start)
    return slices.contexts(edges, start, (options or Options()).max_context).select("source", "node").distinct()


def by_grammar(edges: DataFrame, options: Options | None = None) -> DataFrame:
    """(src, dst) that the grammar's start symbol joins."""
    rules = cfl.parse((options or Options()).grammar)
    return cfl.reach(edges, rules).where(F.col("sym") == rules.start).select("src", "dst").distinct()


def answered(name: str, stmt: DataFrame, path: str, options: Options | None = None) -> DataFrame:
    """A kept result if there is one at the path, else the analysis's, which is then kept there."""
    spark = stmt.sparkSession
    try:
        return spark.read.parquet(f"{path}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    analyse(name, stmt, options).write.parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/{name}")


def changed(stmt: DataFrame, diff: DataFrame, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """(pts, changes) after a diff (op '+' or '-', kind, src, dst): the maintained result and what it differs by."""
    limit = (options or Options()).most_local
    stmt = table(stmt.select("kind", "src", "dst").distinct())
    old = inclusion.solve(stmt, most_local=limit)
    gone, come = (diff.where(F.col("op") == op).select("kind", "src", "dst") for op in "-+")
    new = incremental.apply(stmt, old["pts"], old["copy"], gone, come, most_local=0)[1]["pts"]
    return new, incremental.changes(old["pts"].select("var", "obj"), new.select("var", "obj"))


def program(spark: SparkSession, path: str) -> DataFrame:
    """Statements (kind, src, dst, off) of a program text, or of a folder of JSON tables."""
    try:
        return text.program(spark, path)[1] if not path.endswith("/") else serial.read_program(spark, path.rstrip("/"), "stmt")["stmt"].select("kind", "src", "dst", "off")
    except Exception as e:
        raise ValueError(f"no program at {path}: {str(e)[:200]}") from e
