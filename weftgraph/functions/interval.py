"""Interval values as columns: structs {lb double, ub double}, null for bottom, infinities for no bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def interval(lb: Column, ub: Column) -> Column:
    return F.when(lb <= ub, F.struct(lb.cast("double").alias("lb"), ub.cast("double").alias("ub")))


def top() -> Column:
    return interval(F.lit(-INF), F.lit(INF))


def join(a: Column, b: Column) -> Column:
    """The least interval that holds both; bottom is neutral."""
    both = interval(F.least(a["lb"], b["lb"]), F.greatest(a["ub"], b["ub"]))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def meet(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), interval(F.greatest(a["lb"], b["lb"]), F.least(a["ub"], b["ub"])))


def leq(a: Column, b: Column) -> Column:
    return a.isNull() | (b.isNotNull() & (a["lb"] >= b["lb"]) & (a["ub"] <= b["ub"]))


def widen(old: Column, new: Column) -> Column:
    """Bounds that grew are given up."""
    both = interval(F.when(new["lb"] < old["lb"], -INF).otherwise(old["lb"]), F.when(new["ub"] > old["ub"], INF).otherwise(old["ub"]))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(both)


def narrow(old: Column, new: Column) -> Column:
    """Bounds that had been given up are taken from new."""
    both = interval(F.when(old["lb"] == -INF, new["lb"]).otherwise(old["lb"]), F.when(old["ub"] == INF, new["ub"]).otherwise(old["ub"]))
    return F.when(old.isNull() | new.isNull(), None).otherwise(both)


def add(a: Column, b: Column) -> Column:
    return _both(a, b, interval(a["lb"] + b["lb"], a["ub"] + b["ub"]))


def subtract(a: Column, b: Column) -> Column:
    return _both(a, b, interval(a["lb"] - b["ub"], a["ub"] - b["lb"]))


def _product(x: Column, y: Column) -> Column:
    """0 times an infinity is 0 here."""
    return F.when((x == 0) | (y == 0), F.lit(0.0)).otherwise(x * y)


def multiply(a: Column, b: Column) -> Column:
    ends = [_product(a[p], b[q]) for p in ("lb", "ub") for q in ("lb", "ub")]
    return _both(a, b, interval(F.least(*ends), F.greatest(*ends)))


def divide(a: Column, b: Column) -> Column:
    """Any value if the divisor may be 0."""
    ends = [F.when(b[q] == 0, F.lit(0.0)).otherwise(a[p] / F.when(b[q] != 0, b[q])) for p in ("lb", "ub") for q in ("lb", "ub")]
    sure = interval(F.least(*ends), F.greatest(*ends))
    return _both(a, b, F.when((b["lb"] <= 0) & (b["ub"] >= 0), top()).otherwise(sure))


def _both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def less(a: Column, b: Column) -> Column:
    """[1,1] if surely a < b, [0,0] if surely not, else [0,1]."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return _both(a, b, F.when(a["ub"] < b["lb"], interval(one, one)).when(a["lb"] >= b["ub"], interval(zero, zero)).otherwise(interval(zero, one)))


def equal(a: Column, b: Column) -> Column:
    one, zero = F.lit(1.0), F.lit(0.0)
    point = (a["lb"] == a["ub"]) & (b["lb"] == b["ub"]) & (a["lb"] == b["lb"])
    return _both(a, b, F.when(point, interval(one, one)).when((a["ub"] < b["lb"]) | (b["ub"] < a["lb"]), interval(zero, zero)).otherwise(interval(zero, one)))


def _verdict(sure: Column, never: Column) -> Column:
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.when(sure, interval(one, one)).when(never, interval(zero, zero)).otherwise(interval(zero, one))


def greater(a: Column, b: Column) -> Column:
    return _both(a, b, _verdict(a["lb"] > b["ub"], a["ub"] <= b["lb"]))


def at_least(a: Column, b: Column) -> Column:
    return _both(a, b, _verdict(a["lb"] >= b["ub"], a["ub"] < b["lb"]))


def at_most(a: Column, b: Column) -> Column:
    return _both(a, b, _verdict(a["ub"] <= b["lb"], a["lb"] > b["ub"]))


def unequal(a: Column, b: Column) -> Column:
    point = (a["lb"] == a["ub"]) & (b["lb"] == b["ub"]) & (a["lb"] == b["lb"])
    return _both(a, b, _verdict((a["ub"] < b["lb"]) | (b["ub"] < a["lb"]), point))


def _point(a: Column, b: Column) -> Column:
    return (a["lb"] == a["ub"]) & (b["lb"] == b["ub"])


def remainder(a: Column, b: Column) -> Column:
    """Of whole numbers, with the sign of the dividend; any value if the divisor may be 0."""
    most = F.greatest(F.abs(b["lb"]), F.abs(b["ub"])) - 1
    sure = interval(F.when(a["lb"] >= 0, 0.0).otherwise(-F.least(-a["lb"], most)), F.when(a["ub"] <= 0, 0.0).otherwise(F.least(a["ub"], most)))
    exact = interval(a["lb"] % b["lb"], a["lb"] % b["lb"])
    return _both(a, b, F.when((b["lb"] <= 0) & (b["ub"] >= 0), top()).when(_point(a, b), exact).otherwise(sure))


def _shiftable(b: Column) -> Column:
    return (b["lb"] >= 0) & (b["ub"] <= 63)


def shift_left(a: Column, b: Column) -> Column:
    """Any value if the shift may be negative or above 63."""
    powers = F.struct(F.pow(F.lit(2.0), b["lb"]).alias("lb"), F.pow(F.lit(2.0), b["ub"]).alias("ub"))
    return _both(a, b, F.when(_shiftable(b), multiply(a, powers)).otherwise(top()))


def shift_right(a: Column, b: Column) -> Column:
    """Arithmetic; logical shifts follow the same rule."""
    ends = [F.floor(a[p] / F.pow(F.lit(2.0), b[q])).cast("double") for p in ("lb", "ub") for q in ("lb", "ub")]
    return _both(a, b, F.when(_shiftable(b), interval(F.least(*ends), F.greatest(*ends))).otherwise(top()))


def _ones(x: Column) -> Column:
    """The largest number with as many binary digits."""
    return F.when(x <= 0, 0.0).when(x == INF, INF).otherwise(F.pow(F.lit(2.0), F.length(F.bin(x.cast("long")))) - 1)


def _bitwise(a: Column, b: Column, name: str, natural: Column) -> Column:
    exact = getattr(a["lb"].cast("long"), name)(b["lb"].cast("long"))
    return _both(a, b, F.when(_point(a, b), interval(exact, exact)).when((a["lb"] >= 0) & (b["lb"] >= 0), natural).otherwise(top()))


def bit_and(a: Column, b: Column) -> Column:
    one_sign = F.when(a["lb"] >= 0, interval(F.lit(0.0), a["ub"])).when(b["lb"] >= 0, interval(F.lit(0.0), b["ub"])).otherwise(top())
    both = interval(F.lit(0.0), F.least(a["ub"], b["ub"]))
    return F.when((a["lb"] < 0) != (b["lb"] < 0), F.when(_point(a, b), _bitwise(a, b, "bitwiseAND", both)).otherwise(_both(a, b, one_sign))).otherwise(_bitwise(a, b, "bitwiseAND", both))


def bit_or(a: Column, b: Column) -> Column:
    return _bitwise(a, b, "bitwiseOR", interval(F.greatest(a["lb"], b["lb"]), _ones(F.greatest(a["ub"], b["ub"]))))


def bit_xor(a: Column, b: Column) -> Column:
    return _bitwise(a, b, "bitwiseXOR", interval(F.lit(0.0), _ones(F.greatest(a["ub"], b["ub"]))))


def same(a: Column, b: Column) -> Column:
    """Whether two values are equal, bottom to bottom too."""
    return F.coalesce((a["lb"] == b["lb"]) & (a["ub"] == b["ub"]), a.isNull() & b.isNull())
