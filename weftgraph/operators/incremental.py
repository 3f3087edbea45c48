"""Incremental maintenance of points-to results under deleted and inserted statements, and diffs of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import local
from ..plans.fixpoint import Relations, fixpoint, split, units
from ..plans.scratch import table
from .inclusion import Block, derived_copies, flow, solve, solved


def apply(stmt: DataFrame, pts: DataFrame, copy: DataFrame, deleted: DataFrame, inserted: DataFrame, most_local: int = local.MOST_STATEMENTS, block: Block = None, most_kept: int = local.MOST_STATEMENTS) -> tuple[DataFrame, Relations]:
    """The new statements and their solution, from the old ones and their solution (pts, copy).

    Delete and rederive: first everything that some derivation from a deleted fact leads to is taken away (over-deletion),
    then the rules run on from what is left together with the inserted facts. The result equals solving the new statements.
    Only weak components (of old and new statements) that a change touches are looked at; those of at most `most_local`
    statements are solved anew, as one task is quicker than maintenance there. The others are maintained: those of at most `most_kept`
    statements in a task each, larger ones by rounds of joins.
    """
    names = ["kind", "src", "dst"]
    stmt = table(stmt.select(*names))
    gone = table(deleted.select(*names).distinct().join(stmt, names, "left_semi"))
    now = table(stmt.join(gone, names, "left_anti").unionByName(inserted.select(*names)).distinct())
    if now.count() <= most_local:
        return now, solve(now, most_local=most_local, block=block)
    placed = table(units(table(stmt.unionByName(now).distinct()), block))
    unit = placed.select(F.explode(F.array("src", "dst")).alias("node"), F.col("unit").alias("rep")).distinct()
    changed = gone.unionByName(inserted.select(*names)).select(F.col("src").alias("node")).distinct()
    touched = unit.join(changed, "node", "left_semi").select("rep").distinct()
    sizes = placed.groupBy(F.col("unit").alias("rep")).agg(F.count(F.lit(1)).alias("n"))
    touched = table(sizes.join(touched, "rep", "left_semi").select("rep", (F.col("n") <= most_local).alias("small")))
    where = table(unit.join(touched, "rep").select("node", "small"))

    def part(df: DataFrame, key: str, small: bool | None) -> DataFrame:
        """Rows of touched units that are small, or not, or (None) of the units that no change touches."""
        those = where.select(F.col("node").alias(key), "small")
        return df.join(those, key, "left_anti") if small is None else df.join(those.where(F.col("small") == small), key, "left_semi")

    same = {"pts": part(pts.select("var", "obj"), "var", None), "copy": part(copy.select("src", "dst"), "src", None)}
    anew = solve(part(now, "src", True), most_local=most_local, block=block) if most_local else None
    rest = part(now, "src", False)
    if not most_local or not touched.where("not small").isEmpty():
        old = part(stmt, "src", False), part(pts, "var", False), part(copy, "src", False), part(gone, "src", False)
        kept = _kept(rest, *old, block, most_kept)
        same = {k: same[k].unionByName(kept[k]) for k in same}
    return now, {k: table(same[k].unionByName(anew[k]) if anew else same[k]) for k in same}


def _kept(now: DataFrame, stmt: DataFrame, pts: DataFrame, copy: DataFrame, gone: DataFrame, block: Block = None, most_kept: int = 0) -> Relations:
    """The solution of the statements now, from that of stmt, of which gone are deleted."""
    now, stmt, pts, copy, gone = (table(df) for df in (now, stmt, pts, copy, gone))
    if most_kept:
        small, large = split(table(stmt.unionByName(now).distinct()), most_kept, block)
        unit = table(small.select(F.explode(F.array("src", "dst")).alias("a"), "unit").distinct())
        facts = [df.select(F.lit(tag).alias("tag"), kind.alias("kind"), F.col(a).alias("a"), F.col(b).alias("b")) for df, tag, kind, a, b in (
            (stmt, "old", F.col("kind"), "src", "dst"), (now, "now", F.col("kind"), "src", "dst"), (pts, "", F.lit("p"), "var", "obj"), (copy, "", F.lit("c"), "src", "dst"))]
        rows = facts[0].unionByName(facts[1]).unionByName(facts[2]).unionByName(facts[3]).join(unit, "a").select("tag", "kind", "a", "b", "unit")
        kept = solved(local.by_unit(rows, local.maintained_rows, "k string, a long, b long"))
        if large is None:
            return kept
        rest = _kept(*(df.join(unit.select(F.col("a").alias(k)), k, "left_anti") for df, k in ((now, "src"), (stmt, "src"), (pts, "var"), (copy, "src"), (gone, "src"))))
        return {k: kept[k].unionByName(rest[k]) for k in kept}
    kinds = {k: gone.where(F.col("kind") == k).select("src", "dst") for k in ("addr", "copy", "load", "store")}
    load, store = (stmt.where(F.col("kind") == k).select("src", "dst") for k in ("load", "store"))
    seed_pts = kinds["addr"].select(F.col("dst").alias("var"), F.col("src").alias("obj"))
    seed_copy = kinds["copy"].unionByName(derived_copies(pts, kinds["load"], kinds["store"]))

    def step(full: Relations, delta: Relations) -> Relations:
        # whatever uses a doubtful fact on one side, and any old fact on the other, is doubtful
        out = flow(delta["pts"], copy).unionByName(flow(pts, delta["copy"])).join(pts, ["var", "obj"], "left_semi")
        return {"pts": out, "copy": derived_copies(delta["pts"], load, store).join(copy, ["src", "dst"], "left_semi")}

    doubt = fixpoint({"pts": seed_pts, "copy": seed_copy}, step)
    kept_pts = table(pts.join(doubt["pts"], ["var", "obj"], "left_anti"))
    kept_copy = table(copy.join(doubt["copy"], ["src", "dst"], "left_anti"))
    # one round over the survivors rederives what they still support; the fixpoint goes on from there
    seen = flow(kept_pts, kept_copy.unionByName(now.where("kind = 'copy'").select("src", "dst")))
    again = derived_copies(kept_pts, *(now.where(F.col("kind") == k).select("src", "dst") for k in ("load", "store")))
    return solve(now, kept_pts.unionByName(seen).distinct(), kept_copy.unionByName(again).distinct())


def solved_changes(stmt: DataFrame, deleted: DataFrame, inserted: DataFrame, same: bool = True, block: Block = None, most_kept: int = local.MOST_STATEMENTS) -> DataFrame:
    """(op, var, obj): facts that only the statements' solution has ('-'), only that of the changed statements ('+'), or both ('=', if same).

    The old statements are solved and their solution is maintained, as in apply: units of at most `most_kept` statements of both programs in
    one task each, which hands on no copies; larger ones by rounds of joins.
    """
    names = ["kind", "src", "dst"]
    flag = lambda df, *at: df.select(*names, *[F.lit(i in at).alias(n) for i, n in enumerate(("old", "gone", "come"))])
    said = flag(stmt, 0).unionByName(flag(deleted, 1)).unionByName(flag(inserted, 2)).groupBy(*names).agg(*[F.max(n).alias(n) for n in ("old", "gone", "come")])
    now = (F.col("old") & ~F.col("gone")) | F.col("come")
    side = F.when(F.col("old") & now, 0).when(F.col("old"), 1).when(now, 2).cast("long")
    return _maintained(table(said.select(*names, side.alias("side")).where("side is not null")), same, block, most_kept)


def _maintained(both: DataFrame, same: bool, block: Block, most_kept: int) -> DataFrame:
    """solved_changes of the statements (kind, src, dst, side) of both programs (side: see local.changed_rows)."""
    names = ["kind", "src", "dst"]
    small, large = split(both, most_kept, block)
    found = table(local.by_unit(small.select(*names, "side", "unit"), lambda f: local.changed_rows(f, same), "op string, var long, obj long"))
    if large is None:
        return found
    large = table(large)
    old = large.where("side < 2").select(*names)
    solved_ = solve(old, most_local=0)
    after = apply(old, solved_["pts"], solved_["copy"], large.where("side = 1"), large.where("side = 2"), most_local=0, most_kept=0)[1]["pts"]
    rest = changes(solved_["pts"], after)
    if same:
        rest = rest.unionByName(after.join(solved_["pts"], ["var", "obj"], "left_semi").select(F.lit("=").alias("op"), "var", "obj"))
    return found.unionByName(rest)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """op ('-' or '+') and the row, for rows of one result and not of the other."""
    names = old.columns
    minus = old.join(new, names, "left_anti").withColumn("op", F.lit("-"))
    plus = new.select(*names).join(old, names, "left_anti").withColumn("op", F.lit("+"))
    return minus.unionByName(plus).select("op", *names)


def changed_lines(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of lines (path, line, ...) that lie in a range (path, row_start, row_end) of the same path.

    Ranges of a path are few and short beside its lines: each is cut into blocks of lines, so the join is an equi-join on
    (path, block) and a long range is spread over many keys.
    """
    width = 64
    cut = ranges.select("path", "row_start", "row_end", F.explode(F.sequence(F.floor(F.col("row_start") / width), F.floor(F.col("row_end") / width))).alias("block"))
    at = lines.withColumn("block", F.floor(F.col("line") / width))
    hit = (F.col("l.path") == F.col("r.path")) & (F.col("l.block") == F.col("r.block")) & F.col("l.line").between(F.col("r.row_start"), F.col("r.row_end"))
    return at.alias("l").join(cut.alias("r"), hit, "left_semi").drop("block")
