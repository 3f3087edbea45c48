"""`python -m weftgraph TOOL INPUT [--out FOLDER] [--set name=value ...]`: the engine's tools from the command line.

Tools: inclusion, unification, fields (points-to of a program: a text, or a folder of JSON tables with a slash at its end), grammar
(reachability over a labelled graph), changes (the effect of a listing of changed statements, given with --diff).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from . import api
from .sources import serial, text

GRAPHS = {"dot": text.labelled_dot, "json": text.labelled_json, "text": text.labelled_graph}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("tool", choices=[*sorted(api.ANALYSES), "grammar", "changes"])
    p.add_argument("input")
    p.add_argument("--out", help="folder for the result as Parquet; printed without one")
    p.add_argument("--diff", help="listing of changed statements for the tool changes")
    p.add_argument("--format", choices=sorted(GRAPHS), default="text", help="of a labelled graph")
    p.add_argument("--grammar-file", help="a grammar text; the matched calls and returns of value flow without one")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="an option of weftgraph.api.Options")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    given = dict(s.split("=", 1) for s in args.set)
    if args.grammar_file:
        with open(args.grammar_file) as f:
            given["grammar"] = f.read()
    options = api.Options.of(given)
    if args.tool == "grammar":
        return api.by_grammar(GRAPHS[args.format](spark, args.input), options)
    stmt = api.program(spark, args.input)
    if args.tool == "changes":
        if not args.diff:
            raise SystemExit("the tool changes needs --diff")
        return api.changed(stmt, serial.read_changes(spark, args.diff), options)[1]
    return api.analyse(args.tool, stmt, options)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    out = run(spark, args)
    if args.out:
        out.write.parquet(args.out)
    else:
        serial.show(out, *out.columns)


if __name__ == "__main__":
    main()
