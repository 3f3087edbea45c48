"""Sharding (operator 8): balanced label propagation, DataFrame operations only.

Documents with equal texts are linked. Each document starts with the label of a shard by hash. Linked documents move together: a
group that fits a shard is one unit, a larger one is cut into units of a sixteenth of a shard, linked with each other. In each
round an unsettled unit asks the shard that most of its members and of its neighbours' members (the other units of its group, settled or
not) are labelled with, of those with room for all of it; a shard takes the units, larger ones first, whose running sum of sizes stays
within its room; their members take its label, and the others ask again with the labels as they are then. So the units of a
large group gather in as few shards as have room, one after the other.

Groups of more than a quarter of a shard settle first, then the units of groups larger than a shard, then the smaller groups, each until
none that is left fits any shard: only those are cut. Documents without links then fill the rest, so shard counts differ
by one at most (the law `rows`). Rounds grow with the number of shards, not with the rows.

Row numbers and running sums come from sums of hash blocks, never from one ordered task. Only one count a shard goes to the driver.
Defined cases: null text has no bytes and equals no empty text's size, but is linked like an empty text; repeated rows are
copies; ties go by hash, then id, then the rows' places in their files; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), at + 1)


def numbered(df: DataFrame, by: list[str], block_rows: int, rows: int, name: str) -> DataFrame:
    """Adds a number from 0 within `by`, by hash blocks: a row's number is that in its block plus the rows of earlier blocks."""
    blocks = max(1, math.ceil(rows / block_rows))
    df = df.withColumn("_block", F.pmod(F.xxhash64("rid", F.lit(5)), F.lit(blocks)).cast("int"))
    counts = df.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_n"))
    over = (Window.partitionBy(*by) if by else Window).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "_block", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*by, "_block").orderBy("doc_id", "rid")) - 1
    return df.withColumn("_within", within).join(counts, [*by, "_block"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_block", "_within", "_before")


def admitted(asks: DataFrame, room: list[int], block_rows: int, units: int) -> DataFrame:
    """(unit, grp, n, to) of the asks (unit, grp, n, to) that each shard takes: whole units in order of size while their running sum fits."""
    blocks = max(1, math.ceil(units / block_rows))
    df = asks.withColumn("_class", F.floor(F.log2("n"))).withColumn("_block", F.pmod(F.xxhash64("unit", F.lit(6)), F.lit(blocks)).cast("int"))
    sums = df.groupBy("to", "_class", "_block").agg(F.sum("n").alias("_n"))
    over = Window.partitionBy("to").orderBy(F.desc("_class"), "_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("to", "_class", "_block", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    within = F.sum("n").over(Window.partitionBy("to", "_class", "_block").orderBy(F.desc("n"), "unit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_within", within).join(sums, ["to", "_class", "_block"]).where(F.col("_before") + F.col("_within") <= _pick(room, F.col("to"))).select("unit", "grp", "n", "to")


def pulls(units: DataFrame) -> DataFrame:
    """Units (unit, grp, n, votes, done) with the votes of all members of their groups: each unit is joined with its neighbours' labels."""
    labels = units.select("grp", F.explode("votes").alias("v")).groupBy("grp", F.col("v.shard").alias("shard")).agg(F.sum("v.c").alias("c"))
    return units.drop("votes").join(labels.groupBy("grp").agg(F.collect_list(F.struct("c", "shard")).alias("votes")), "grp")


def _settle(units: DataFrame, room: list[int], block_rows: int, turn: int, settled: list[DataFrame]) -> list[int]:
    """Rounds of asks and admissions of units (unit, grp, n, votes) until none fits; adds (unit, grp, n, to) to settled, returns the room left.

    Turn 1 has groups of several units, which are joined with their neighbours' labels in each round. A shard has some 16 units
    and at most 34, so there are at most 34 units a shard, whatever the rows: one task holds them.
    """
    cut = turn == 1
    left, count, rounds = units, units.count(), 0
    if cut and count:
        left = common.materialise(units.withColumn("done", F.lit(False)).coalesce(1), "left")
    while count:
        free = F.filter(F.array(*[F.struct(F.lit(r).alias("room"), F.lit(s).alias("shard")) for s, r in enumerate(room)]), lambda x: x["room"] >= F.col("n"))
        tie = [F.lit(turn), F.lit(rounds)]
        best = F.array_max(F.transform(F.filter("votes", lambda v: _pick(room, v["shard"]) >= F.col("n")), lambda v: F.struct(v["c"].alias("c"), F.xxhash64("grp", v["shard"], *tie).alias("tie"), v["shard"].alias("shard"))))
        # a unit none of whose shards has room tries one that has, by hash; the units of a group the same
        other = F.element_at("free", (F.pmod(F.xxhash64("grp", *tie), F.size("free")) + 1).cast("int"))["shard"]
        asks = pulls(left.coalesce(1)).where("not done") if cut else left
        asks = asks.withColumn("free", free).where(F.size("free") > 0).select("unit", "grp", "n", F.coalesce(best["shard"], other).alias("to"))
        took = common.materialise(admitted(asks, room, block_rows, count), "took")
        sums = {r["to"]: r["n"] for r in took.groupBy("to").agg(F.sum("n").alias("n")).collect()}
        if not sums:  # the first ask of any shard fits, so nobody asked
            common.discard(took)
            break
        settled.append(took)
        room, rounds = [r - sums.get(s, 0) for s, r in enumerate(room)], rounds + 1
        if cut:  # the settled stay, with their new label, as neighbours
            moved = left.join(took.select("unit", "to"), "unit", "left")
            votes = F.when(F.col("to").isNull(), F.col("votes")).otherwise(F.array(F.struct(F.col("n").alias("c"), F.col("to").alias("shard"))))
            now = common.materialise(moved.select("unit", "grp", "n", votes.alias("votes"), (F.col("done") | F.col("to").isNotNull()).alias("done")).coalesce(1), "left")
        else:
            now = common.materialise(left.join(took.select("unit"), "unit", "left_anti"), "left")
        if left is not units:
            common.discard(left)
        left = now
    return room


def shard(df: DataFrame, shards: int = 40, block_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = df[text_col].cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    rows = df.select(df[id_col].cast("long").alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("key"), F.monotonically_increasing_id().alias("rid"))
    docs = common.materialise(rows, "rows")
    total = docs.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    most = max(1, quota[0])
    quarter, piece = max(1, most // 4), max(1, most // 16)
    groups = common.materialise(docs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    unit = F.xxhash64("key", F.pmod(F.xxhash64("rid"), F.when(F.col("n") <= most, 1).otherwise(F.ceil(F.col("n") / piece))))
    start = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int")
    turn_of = F.when(F.col("n") > most, 1).when(F.col("n") > quarter, 0).otherwise(2)
    linked = common.join_hot(docs, groups, "key", "n", total).select("rid", unit.alias("unit"), F.xxhash64("key").alias("grp"), turn_of.alias("turn"), start.alias("shard"))
    linked = common.materialise(linked, "linked")
    labels = linked.groupBy("unit", "grp", "turn", "shard").agg(F.count(F.lit(1)).alias("c")).groupBy("unit", "grp", "turn")
    units = common.materialise(labels.agg(F.sum("c").alias("n"), F.collect_list(F.struct("c", "shard")).alias("votes")), "units")

    room, settled = list(quota), []
    for turn in range(3):
        room = _settle(units.where(F.col("turn") == turn).drop("turn"), room, block_rows, turn, settled)

    whole = reduce(DataFrame.unionByName, settled).select("unit", F.col("to").alias("shard")) if settled else linked.select("unit", "shard").limit(0)
    placed = numbered(linked.select("rid", "unit").join(whole, "unit").join(docs, "rid"), ["shard"], block_rows, total, "slot")
    placed = common.materialise(placed.select("doc_id", "size", "text_crc32", "shard", "slot", "rid"), "placed")
    load = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    free = numbered(docs.join(placed.select("rid"), "rid", "left_anti"), [], block_rows, total, "at")
    ends, sum_ = [], 0
    for s in range(shards):
        sum_ += quota[s] - load.get(s, 0)
        ends.append(sum_)
    to = sum(((F.col("at") >= e).cast("int") for e in ends[:-1]), F.lit(0))
    first = _pick([0, *ends[:-1]], F.col("shard"))
    filled = free.withColumn("shard", to).withColumn("slot", F.col("at") - first + _pick([load.get(s, 0) for s in range(shards)], F.col("shard")))
    names = ["doc_id", "size", "text_crc32", "shard", "slot"]
    return placed.select(*names).unionByName(filled.select(*names)).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
