"""Points-to sets: reverse lookups, statistics, alias queries by shared set ids, normalisation, mod-ref and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import Relations, closure, fixpoint
from ..plans.scratch import table


def reverse(pts: DataFrame) -> DataFrame:
    """obj and how many variables point to it."""
    return pts.groupBy("obj").agg(F.count(F.lit(1)).alias("n_vars"), F.min("var").alias("first_var"), F.max("var").alias("last_var"))


def statistics(pts: DataFrame) -> DataFrame:
    """One row: pointers, facts, mean and largest set."""
    sizes = pts.groupBy("var").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_pointers"), F.sum("n").alias("n_facts"), F.avg("n").alias("avg_size"), F.max("n").alias("max_size"))


def shared_sets(pts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(var, set_id) and (set_id, obj): equal sets are kept once, named by their sorted members."""
    named = pts.groupBy("var").agg(F.sort_array(F.collect_set("obj")).alias("objs")).withColumn("set_id", F.xxhash64("objs"))
    named = table(named)
    sets = named.select("set_id", "objs").dropDuplicates(["set_id"]).select("set_id", F.explode("objs").alias("obj"))
    return named.select("var", "set_id"), sets


def aliases(pts: DataFrame) -> DataFrame:
    """(a, b), a < b, of variables whose sets meet: sets are compared once each, then expanded to their variables."""
    of, sets = shared_sets(pts)
    sets = table(sets)
    meet = sets.alias("p").join(sets.alias("q"), "obj").where("p.set_id <= q.set_id").select(F.col("p.set_id").alias("s"), F.col("q.set_id").alias("t")).distinct()
    pairs = meet.join(of.select(F.col("set_id").alias("s"), F.col("var").alias("x")), "s").join(of.select(F.col("set_id").alias("t"), F.col("var").alias("y")), "t").where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def alias_query(pts: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair (a, b): MayAlias if their sets meet, else NoAlias."""
    pairs = pairs.select("a", "b").distinct()
    hit = pairs.join(pts.select(F.col("var").alias("a"), "obj"), "a").join(pts.select(F.col("var").alias("b"), "obj"), ["b", "obj"], "left_semi").select("a", "b").distinct().withColumn("hit", F.lit(True))
    return pairs.join(hit, ["a", "b"], "left").select("a", "b", F.when(F.col("hit"), "MayAlias").otherwise("NoAlias").alias("result"))


def normalise(pts: DataFrame, bases: DataFrame) -> DataFrame:
    """Objects that are fields of an insensitive base (obj, base) give way to the base."""
    return pts.join(bases, "obj", "left").select("var", F.coalesce("base", "obj").alias("obj")).distinct()


def local_effects(stmt: DataFrame, pts: DataFrame) -> DataFrame:
    """(fun, obj, effect) of loads ('ref') and stores ('mod') in the functions themselves."""
    loads = stmt.where("kind = 'load'").join(pts, stmt["src"] == pts["var"]).select("fun", "obj", F.lit("ref").alias("effect"))
    stores = stmt.where("kind = 'store'").join(pts, stmt["dst"] == pts["var"]).select("fun", "obj", F.lit("mod").alias("effect"))
    return loads.unionByName(stores).distinct()


def effects(local: DataFrame, calls: DataFrame) -> DataFrame:
    """(fun, obj, effect) of functions with those of all they call, directly or not.

    The call graph is closed first; effects then flow once along the closure, however long its paths are.
    """
    reach = table(closure(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))))
    below = reach.join(local, reach["dst"] == local["fun"]).select(F.col("src").alias("fun"), "obj", "effect")
    return local.unionByName(below).distinct()


def effect_kinds(local: DataFrame, calls: DataFrame) -> DataFrame:
    """(fun, effect) of functions with those of all they call: whether, not on what. Only kinds go up the calls, at most two a function."""
    up = table(calls.select(F.col("callee").alias("fun"), "caller").distinct())

    def step(full: Relations, delta: Relations) -> Relations:
        return {"at": delta["at"].join(up, "fun").select(F.col("caller").alias("fun"), "effect")}

    return fixpoint({"at": local.select("fun", "effect")}, step)["at"]


def effect_sizes(local: DataFrame, calls: DataFrame) -> DataFrame:
    """(fun, effect, n_objs, first_obj, last_obj, sum_obj) of effects(): 32 neighbouring objects are the lower bits of one word, whose sign stays free."""
    bit = F.expr("shiftleft(1L, cast(pmod(obj, 32) as int))")
    words = table(local.groupBy("fun", "effect", F.expr("(obj - pmod(obj, 32)) div 32").alias("word")).agg(F.bit_or(bit).alias("bits")))
    reach = table(closure(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))))
    below = reach.join(words, reach["dst"] == words["fun"]).select(F.col("src").alias("fun"), "effect", "word", "bits")
    every = words.unionByName(below).groupBy("fun", "effect", "word").agg(F.bit_or("bits").alias("bits"))
    down, n = "bits", F.bit_count("bits").cast("long")
    for k in (1, 2, 4, 8, 16):  # all bits below the highest
        every = every.withColumn("_down", F.expr(f"{down} | shiftrightunsigned({down}, {k})"))
        down = "_down"
    # the places of a word's bits add up to those of each binary digit of a place
    masks = [sum(1 << i for i in range(32) if i >> j & 1) for j in range(5)]
    places = sum((F.bit_count(F.col("bits").bitwiseAND(F.lit(m))) * (1 << j) for j, m in enumerate(masks)), F.lit(0)).cast("long")
    first, last = F.expr("cast(bit_count((bits & -bits) - 1) as bigint)"), F.bit_count("_down").cast("long") - 1
    base = F.col("word") * 32
    return every.groupBy("fun", "effect").agg(F.sum(n).alias("n_objs"), F.min(base + first).alias("first_obj"), F.max(base + last).alias("last_obj"), F.sum(base * n + places).alias("sum_obj"))


def mod_ref(all_effects: DataFrame, calls: DataFrame) -> DataFrame:
    """For each call site (site, callee): ModRef, Mod, Ref or NoModRef."""
    kinds = all_effects.groupBy(F.col("fun").alias("callee")).agg(F.bool_or(F.col("effect") == "mod").alias("m"), F.bool_or(F.col("effect") == "ref").alias("r"))
    out = calls.select("site", "callee").distinct().join(kinds, "callee", "left")
    m, r = F.coalesce("m", F.lit(False)), F.coalesce("r", F.lit(False))
    return out.select("site", "callee", F.when(m & r, "ModRef").when(m, "Mod").when(r, "Ref").otherwise("NoModRef").alias("result"))


def regions(effect_sets: DataFrame, within: list[str]) -> DataFrame:
    """The coarsest disjoint partition of objects such that every set (of `within`, set_id) is a union of parts.

    Objects that occur in exactly the same sets are one region, named by its least object: one aggregation, no refinement loop.
    """
    signed = effect_sets.groupBy(*within, "obj").agg(F.sort_array(F.collect_set("set_id")).alias("sets"))
    return signed.groupBy(*within, "sets").agg(F.min("obj").alias("region"), F.count(F.lit(1)).alias("n_objs"), F.max("obj").alias("last_obj")).select(*within, "region", "n_objs", "last_obj", F.size("sets").alias("n_sets"))


def def_use(stmt: DataFrame) -> DataFrame:
    """Direct value-flow edges (def, use) between statements' ids: a variable's definitions to its uses."""
    defs = stmt.where("kind <> 'store'").select(F.col("id").alias("def"), F.col("dst").alias("v"))
    used = stmt.where("kind <> 'addr'").select(F.col("id").alias("use"), F.col("src").alias("v"))
    pointers = stmt.where("kind = 'store'").select(F.col("id").alias("use"), F.col("dst").alias("v"))
    return defs.join(used.unionByName(pointers), "v").select("def", "use").distinct()


def indirect_flow(stmt: DataFrame, pts: DataFrame) -> DataFrame:
    """Indirect value-flow edges (store, load, n_objs): statements that may touch common objects."""
    writes = stmt.where("kind = 'store'").join(pts, stmt["dst"] == pts["var"]).select(F.col("id").alias("store"), "obj")
    reads = stmt.where("kind = 'load'").join(pts, stmt["src"] == pts["var"]).select(F.col("id").alias("load"), "obj")
    return writes.join(reads, "obj").groupBy("store", "load").agg(F.count(F.lit(1)).alias("n_objs"))


def region_of(local: DataFrame) -> DataFrame:
    """(obj, region): objects that the same functions touch are one region, named by its least object."""
    signed = table(local.groupBy("obj").agg(F.sort_array(F.collect_set("fun")).alias("funs")))
    return signed.join(signed.groupBy("funs").agg(F.min("obj").alias("region")), "funs").select("obj", "region")


def annotations(stmt: DataFrame, pts: DataFrame, region: DataFrame) -> DataFrame:
    """(fun, annotation, region, n_sites): how many loads may read ('mu') and stores may write ('chi') each region."""
    reads = stmt.where("kind = 'load'").select("fun", "src", "dst", F.col("src").alias("var"), F.lit("mu").alias("annotation"))
    writes = stmt.where("kind = 'store'").select("fun", "src", "dst", F.col("dst").alias("var"), F.lit("chi").alias("annotation"))
    sites = reads.unionByName(writes).join(pts, "var").join(region, "obj").select("fun", "annotation", "region", "src", "dst").distinct()
    return sites.groupBy("fun", "annotation", "region").agg(F.count(F.lit(1)).alias("n_sites"))


def superset_regions(members: DataFrame) -> DataFrame:
    """(fun, set_id, region): sets (fun, set_id, obj) that are equal are one, named by the least; each is in the region of the largest
    set of its function that contains it (ties: the least name).

    Containment is counted over common members, so only sets that share an object of one function are paired.
    """
    named = members.distinct().groupBy("fun", "set_id").agg(F.sort_array(F.collect_list("obj")).alias("objs"))
    one = table(named.groupBy("fun", "objs").agg(F.min("set_id").alias("set_id")).select("fun", "set_id", "objs", F.size("objs").alias("n")))
    flat = one.select("fun", "set_id", "n", F.explode("objs").alias("obj"))
    other = flat.select("fun", "obj", F.col("set_id").alias("region"), F.col("n").alias("m")).alias("o")
    common = flat.join(other, ["fun", "obj"]).where("m >= n").groupBy("fun", "set_id", "region", "n", "m").agg(F.count(F.lit(1)).alias("c")).where("c = n")
    return common.groupBy("fun", "set_id").agg(F.min(F.struct(-F.col("m"), F.col("region"))).alias("best")).select("fun", "set_id", F.col("best.region").alias("region"))
