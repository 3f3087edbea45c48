"""Queries on abstract values: interval arithmetic on bits, comparisons, states merged by key, transfer to a fixpoint, set algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import interval as iv
from ..functions import values
from ..operators import inclusion, states
from ..sources import facts
from .registry import PTS, WITH, _solution, query
from .scratch import table

RANGES = "box AS (SELECT l_partkey AS part, min(l_quantity) - 5 AS al, max(l_quantity) - 5 AS au, min(l_linenumber)::DOUBLE AS bl, max(l_linenumber)::DOUBLE AS bu FROM lineitem GROUP BY l_partkey)"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    span = lambda c: F.struct(F.min(c).cast("double").alias("lb"), F.max(c).cast("double").alias("ub"))
    return lines.groupBy(F.col("l_partkey").alias("part")).agg(span(F.col("l_quantity") - 5).alias("a"), span(F.col("l_linenumber")).alias("b"))


def _ends(df: DataFrame, names: tuple[str, ...], *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(f"{n}.{e}").alias(f"{n}_{e}") for n in names for e in ("lb", "ub")])


ONES = "CASE WHEN greatest(au, bu) <= 0 THEN 0.0 ELSE power(2.0, length(bin(greatest(au, bu)::BIGINT))) - 1 END"
POINT = "al = au AND bl = bu"


@query(f"""WITH {RANGES} SELECT part,
  CASE WHEN {POINT} THEN al % bl WHEN al >= 0 THEN 0.0 ELSE -least(-al, bu - 1) END AS rem_lb, CASE WHEN {POINT} THEN al % bl WHEN au <= 0 THEN 0.0 ELSE least(au, bu - 1) END AS rem_ub,
  least(al * power(2.0, bl), al * power(2.0, bu)) AS left_lb, greatest(au * power(2.0, bl), au * power(2.0, bu)) AS left_ub,
  least(floor(al / power(2.0, bl)), floor(al / power(2.0, bu))) AS right_lb, greatest(floor(au / power(2.0, bl)), floor(au / power(2.0, bu))) AS right_ub,
  CASE WHEN {POINT} THEN (al::BIGINT & bl::BIGINT)::DOUBLE ELSE 0.0 END AS and_lb, CASE WHEN {POINT} THEN (al::BIGINT & bl::BIGINT)::DOUBLE WHEN al >= 0 THEN least(au, bu) ELSE bu END AS and_ub,
  CASE WHEN {POINT} THEN (al::BIGINT | bl::BIGINT)::DOUBLE WHEN al >= 0 THEN greatest(al, bl) ELSE '-infinity'::DOUBLE END AS or_lb, CASE WHEN {POINT} THEN (al::BIGINT | bl::BIGINT)::DOUBLE WHEN al >= 0 THEN {ONES} ELSE 'infinity'::DOUBLE END AS or_ub,
  CASE WHEN {POINT} THEN xor(al::BIGINT, bl::BIGINT)::DOUBLE WHEN al >= 0 THEN 0.0 ELSE '-infinity'::DOUBLE END AS xor_lb, CASE WHEN {POINT} THEN xor(al::BIGINT, bl::BIGINT)::DOUBLE WHEN al >= 0 THEN {ONES} ELSE 'infinity'::DOUBLE END AS xor_ub,
  least(al / bl, al / bu) AS div_lb, greatest(au / bl, au / bu) AS div_ub FROM box""")
def interval_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    made = _ranges(spark, sf_dir).select("part", iv.remainder(a, b).alias("rem"), iv.shift_left(a, b).alias("left"), iv.shift_right(a, b).alias("right"), iv.bit_and(a, b).alias("and"), iv.bit_or(a, b).alias("or"), iv.bit_xor(a, b).alias("xor"), iv.divide(a, b).alias("div"))
    return _ends(made, ("rem", "left", "right", "and", "or", "xor", "div"), "part")


def _said(name: str, sure: str, never: str) -> str:
    return f"CASE WHEN {sure} THEN 1.0 ELSE 0.0 END::DOUBLE AS {name}_lb, CASE WHEN {never} THEN 0.0 ELSE 1.0 END::DOUBLE AS {name}_ub"


@query(f"""WITH {RANGES} SELECT part, {_said("gt", "al > bu", "au <= bl")}, {_said("ge", "al >= bu", "au < bl")}, {_said("le", "au <= bl", "al > bu")}, {_said("ne", "au < bl OR bu < al", f"{POINT} AND al = bl")}, {_said("eq", f"{POINT} AND al = bl", "au < bl OR bu < al")}, {_said("lt", "au < bl", "al >= bu")} FROM box""")
def interval_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    how = {"gt": iv.greater, "ge": iv.at_least, "le": iv.at_most, "ne": iv.unequal, "eq": iv.equal, "lt": iv.less}
    return _ends(_ranges(spark, sf_dir).select("part", *[f(a, b).alias(n) for n, f in how.items()]), tuple(how), "part")


STATE = "SELECT l_suppkey AS supp, l_partkey % 7 AS loc, min({v}) AS lb, max({v}) AS ub FROM lineitem WHERE l_returnflag = '{f}' GROUP BY ALL"


def _state(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_returnflag") == flag)
    return lines.groupBy(F.col("l_suppkey").alias("supp"), (F.col("l_partkey") % 7).alias("loc")).agg(F.struct(F.min("l_quantity").alias("lb"), F.max("l_quantity").alias("ub")).alias("value"))


@query(f"""WITH x AS ({STATE.format(v="l_quantity", f="A")}), y AS ({STATE.format(v="l_quantity", f="R")}), b AS (SELECT coalesce(x.supp, y.supp) AS supp, coalesce(x.loc, y.loc) AS loc, x.lb AS xl, x.ub AS xu, y.lb AS yl, y.ub AS yu, x.supp IS NOT NULL AND y.supp IS NOT NULL AS two, x.supp IS NULL AS nox, y.supp IS NULL AS noy FROM x FULL JOIN y ON x.supp = y.supp AND x.loc = y.loc)
SELECT supp, loc, least(xl, yl) AS join_lb, greatest(xu, yu) AS join_ub, CASE WHEN two AND greatest(xl, yl) <= least(xu, yu) THEN greatest(xl, yl) END AS meet_lb, CASE WHEN two AND greatest(xl, yl) <= least(xu, yu) THEN least(xu, yu) END AS meet_ub,
  CASE WHEN nox THEN yl WHEN noy THEN xl WHEN yl < xl THEN '-infinity'::DOUBLE ELSE xl END AS wide_lb, CASE WHEN nox THEN yu WHEN noy THEN xu WHEN yu > xu THEN 'infinity'::DOUBLE ELSE xu END AS wide_ub,
  CASE WHEN two THEN CASE WHEN yl < xl THEN yl ELSE xl END END AS narrow_lb, CASE WHEN two THEN CASE WHEN yu > xu THEN yu ELSE xu END END AS narrow_ub, coalesce(xl = yl AND xu = yu, false) AS same FROM b""")
def interval_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states, some of whose keys the other lacks, under every operation; narrowing goes back from their widening."""
    narrow = lambda x, y: F.when(x.isNotNull() & y.isNotNull(), iv.narrow(iv.widen(x, y), iv.join(x, y)))
    made = states.merged(_state(spark, sf_dir, "A"), _state(spark, sf_dir, "R"), ["supp", "loc"], join=iv.join, meet=iv.meet, wide=iv.widen, narrow=narrow, same=iv.same)
    return _ends(made.withColumn("s", F.col("same")), ("join", "meet", "wide", "narrow"), "supp", "loc", "same")


CONST = "SELECT l_partkey AS var, CASE WHEN min({v}) = max({v}) THEN min({v})::DOUBLE END AS value, min({v}) <> max({v}) AS top FROM lineitem WHERE l_returnflag = '{f}' GROUP BY l_partkey"


@query(f"""WITH x AS ({CONST.format(v="l_linenumber", f="A")}), y AS ({CONST.format(v="l_linenumber", f="R")}), b AS (SELECT coalesce(x.var, y.var) AS var, x.value AS xv, y.value AS yv, x.top AS xt, y.top AS yt FROM x FULL JOIN y ON x.var = y.var)
SELECT var, CASE WHEN xt IS NULL THEN yt WHEN yt IS NULL THEN xt ELSE xt OR yt OR xv <> yv END AS join_top, CASE WHEN xt IS NULL THEN yv WHEN yt IS NULL THEN xv WHEN NOT xt AND NOT yt AND xv = yv THEN xv END AS join_value,
  CASE WHEN xt AND yt THEN true WHEN xt IS NULL OR yt IS NULL OR (NOT xt AND NOT yt AND xv <> yv) THEN NULL ELSE false END AS meet_top, CASE WHEN xt THEN yv WHEN yt OR xv = yv THEN xv END AS meet_value,
  CASE WHEN xt IS NOT NULL AND yt IS NOT NULL THEN xt OR yt END AS sum_top, xv + yv AS sum_value FROM b""")
def constant_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x, y = (lines.where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("var")).agg(values.folded(F.col("l_linenumber").cast("double")).alias("value")) for f in ("A", "R"))
    made = states.merged(x, y, ["var"], join=values.join, meet=values.meet, sum=lambda a, b: values.operate(a, b, lambda p, q: p + q))
    return made.select("var", *[F.col(f"{n}.{e}").alias(f"{n}_{e}") for n in ("join", "meet", "sum") for e in ("top", "value")])


ADDRESSES = "SELECT l_partkey AS var, list(DISTINCT l_suppkey) AS s FROM lineitem WHERE l_returnflag = '{f}' GROUP BY l_partkey"


@query(f"""WITH x AS ({ADDRESSES.format(f="A")}), y AS ({ADDRESSES.format(f="R")}), b AS (SELECT coalesce(x.var, y.var) AS var, coalesce(x.s, []) AS p, coalesce(y.s, []) AS q FROM x FULL JOIN y ON x.var = y.var)
SELECT var, len(list_distinct(list_concat(p, q))) AS n_join, len(list_intersect(p, q)) AS n_meet, coalesce(list_sum(list_distinct(list_concat(p, q))), 0)::BIGINT AS sum_join, coalesce(list_sum(list_intersect(p, q)), 0)::BIGINT AS sum_meet, len(p) - len(list_intersect(p, q)) AS n_minus,
  len(list_intersect(p, q)) > 0 AS overlap, len(p) = len(list_intersect(p, q)) AS contained, list_contains(p, var % 100) AS has FROM b""")
def address_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of addresses joined, met, taken away and compared, key by key."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x, y = (lines.where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("var")).agg(F.collect_set("l_suppkey").alias("value")) for f in ("A", "R"))
    set_ = lambda c: F.coalesce(c, F.array().cast("array<long>"))
    both = states.merged(x, y, ["var"], p=lambda a, b: set_(a), q=lambda a, b: set_(b))
    p, q = F.col("p"), F.col("q")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, v: n + v)
    union, meet = F.array_union(p, q), F.array_intersect(p, q)
    long = lambda c: c.cast("long")
    return both.select("var", long(F.size(union)).alias("n_join"), long(F.size(meet)).alias("n_meet"), total(union).alias("sum_join"), total(meet).alias("sum_meet"), long(F.size(F.array_except(p, q))).alias("n_minus"), F.arrays_overlap(p, q).alias("overlap"), (F.size(F.array_except(p, q)) == 0).alias("contained"), F.array_contains(p, F.col("var") % 100).alias("has"))


@query(f"""{WITH}, {_solution()}, seed AS (SELECT DISTINCT l_orderkey // 16 * {facts.VARS} + (l_suppkey * 3 + l_linenumber) % {facts.VARS} AS node, l_quantity AS v FROM lineitem WHERE (l_partkey + l_suppkey + l_linenumber) % 10 < 3),
val(node, v) AS (SELECT node, v FROM seed UNION SELECT c.b, val.v FROM val JOIN r c ON c.k = 'c' AND c.a = val.node) SELECT node, min(v) AS lb, max(v) AS ub FROM val GROUP BY node""")
def interval_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities stored by address statements, carried by copies, loads and stores to every variable and object."""
    stmt = table(facts.statements(spark, sf_dir))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("(l_partkey + l_suppkey + l_linenumber) % 10 < 3")
    node = F.expr(f"l_orderkey div 16 * {facts.VARS} + (l_suppkey * 3 + l_linenumber) % {facts.VARS}")
    seed = lines.select(node.alias("node"), F.struct(F.col("l_quantity").alias("lb"), F.col("l_quantity").alias("ub")).alias("value"))
    state = states.propagate(inclusion.solve(stmt)["copy"], seed, states.spans)
    return state.select("node", F.col("value.lb").alias("lb"), F.col("value.ub").alias("ub"))


@query(f"""{PTS}, shared AS (SELECT DISTINCT obj FROM pts WHERE obj % 8 = 0), esc(obj) AS (SELECT obj FROM shared UNION SELECT p.obj FROM esc JOIN pts p ON p.var = esc.obj) SELECT obj, obj IN (SELECT obj FROM shared) AS is_global FROM esc""")
def escaped_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global objects and all that can be reached from them through memory."""
    from ..operators import slices

    pts = table(inclusion.points_to(facts.statements(spark, sf_dir)))
    roots = table(pts.where("obj % 8 = 0").select(F.col("obj").alias("node")).distinct())
    reach = slices.spread(pts.select(F.col("var").alias("src"), F.col("obj").alias("dst")), roots)
    return reach.join(roots.withColumn("is_global", F.lit(True)), "node", "left").select(F.col("node").alias("obj"), F.coalesce("is_global", F.lit(False)).alias("is_global"))


@query("""WITH s AS (SELECT l_orderkey AS set_id, l_orderkey // 16 AS fun, list_sort(list(DISTINCT l_suppkey)) AS objs FROM lineitem GROUP BY ALL), d AS (SELECT fun, objs, min(set_id) AS id FROM s GROUP BY fun, objs)
SELECT a.fun, a.id AS set_id, (SELECT min(struct_pack(n := -len(b.objs), i := b.id)) FROM d b WHERE b.fun = a.fun AND len(list_intersect(a.objs, b.objs)) = len(a.objs)).i AS region FROM d a""")
def regions_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each set of objects belongs to the region of the largest set of its function that contains it."""
    from ..operators import sets

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return sets.superset_regions(lines.select(F.expr("l_orderkey div 16").alias("fun"), F.col("l_orderkey").alias("set_id"), F.col("l_suppkey").alias("obj")))
