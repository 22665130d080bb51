"""The six aggregates over one column of bindings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflow import values as V
from strataflow.values import Kind, Val

WHOLE = Kind("num", "", False, True)


def distinct_key(v: Val) -> Column:
    """What distinct values are counted by; null for absent values and empty text."""
    if v.kind.name == "any":
        return F.when((v.col["k"] > 0) & ~((v.col["k"] == 2) & (v.col["s"] == "")), V.boxed_key(v.col))
    return F.when(v.col != "", v.col) if v.kind.name == "text" else v.col


def one_unit(v: Val, out: Column) -> Val:
    """out as a boxed value with the group's unit, or absent if its numbers have several."""
    units = F.collect_set(F.when((v.col["k"] == 1) & (v.col["u"] != ""), v.col["u"]))
    made = F.struct(F.lit(1).cast("tinyint").alias("k"), out.cast("double").alias("n"), F.lit(None).cast("string").alias("s"), F.coalesce(F.get(units, F.lit(0)), F.lit("")).alias("u"))
    return Val(F.when((F.size(units) <= 1) & out.isNotNull(), made), V.ANY)


def exact_sum(x: Column) -> Column:
    """The true sum rounded once, in whatever order and by however many tasks it is added: three whole numbers a value, its
    units, the next 40 bits and the next 60, are summed as decimals. What a value has beyond 2^-100 is left out; if some
    value isn't finite, or reaches 2^62, the sum is Spark's."""
    d = x.cast("double")
    fine = F.abs(d) < float(1 << 62)
    y = F.when(fine, d)
    a = y.cast("long")
    f = (y - a.cast("double")) * float(1 << 40)
    b = f.cast("long")
    c = ((f - b.cast("double")) * float(1 << 60)).cast("long")
    whole = lambda v: F.sum(v.cast("decimal(19,0)"))
    bits = lambda n: F.lit(1 << n).cast("decimal(20,0)")
    over = lambda v, n: F.call_function("div", v, bits(n))
    zero = F.lit(0).cast("decimal(20,0)")
    wide = lambda v: v.cast("decimal(38,0)")
    # What is below the last place that a double takes decides ties only, as one more bit.
    tied = lambda v, more: (F.try_multiply(wide(v), F.lit(2)) + F.when(more, 1).otherwise(0)).cast("double")
    parts = lambda u, m, n: F.struct(wide(u).alias("u"), wide(m).alias("m"), wide(n).alias("n"))

    def carried(s: Column) -> Column:
        return V.let(parts(s["u"], s["m"] + over(s["n"], 60), s["n"] % bits(60)), lambda t: parts(t["u"] + over(t["m"], 40), t["m"] % bits(40), t["n"]))

    def borrowed(s: Column) -> Column:
        """The two lower parts positive."""
        one = lambda c: F.when(c < 0, 1).otherwise(0)
        up = lambda c, n: F.when(c < 0, c + bits(n)).otherwise(c)
        return V.let(parts(s["u"], s["m"] - one(s["n"]), up(s["n"], 60)), lambda t: parts(t["u"] - one(t["m"]), up(t["m"], 40), t["n"]))

    def turned(s: Column) -> Column:
        """All three of one sign where the sum is below zero: its size, which is told with the sign."""
        below = parts(-s["u"] - 1, bits(40) - s["m"] - F.when(s["n"] > 0, 1).otherwise(0), F.when(s["n"] > 0, bits(60) - s["n"]).otherwise(zero))
        return F.when((s["u"] < 0) & ((s["m"] > 0) | (s["n"] > 0)), F.struct(below.alias("s"), F.lit(-1.0).alias("sign"))).otherwise(F.struct(s.alias("s"), F.lit(1.0).alias("sign")))

    def value(t: Column) -> Column:
        s = t["s"]
        upper = F.try_add(F.try_multiply(s["u"], bits(40)), s["m"])
        every = lambda v: F.try_add(F.try_multiply(wide(v), bits(60)), s["n"]).cast("double") / float(1 << 100)
        small = V.let(upper, lambda v: F.when(v >= bits(54), tied(v, s["n"] > 0) / float(1 << 41)).otherwise(every(v)))
        return t["sign"] * F.when(F.abs(s["u"]) >= bits(53), tied(s["u"], (s["m"] > 0) | (s["n"] > 0)) / 2.0).otherwise(small)

    exact = V.let(parts(whole(a), whole(b), whole(c)), lambda s: V.let(carried(s), lambda t: V.let(borrowed(t), lambda w: V.let(turned(w), value))))
    return F.when(F.max(~fine), F.sum(d)).otherwise(exact)


def total(v: Val, x: Column) -> Column:
    return F.sum(x) if v.kind.whole or v.kind.decimal else exact_sum(x)


def reduced(func: str, distinct: bool, v: Val) -> Val:
    if func == "count":
        return Val(F.count_distinct(distinct_key(v)) if distinct else F.count(F.lit(1)), WHOLE)
    if func == "present":  # bindings that aren't absent; front ends use it
        return Val(F.count(F.when(~V.is_absent(v), 1)), WHOLE)
    if func == "list":
        return Val(listed(v, distinct), Kind("text", "", False))
    if v.kind.name not in ("num", "any", "text") and func in ("min", "max"):
        return Val(F.min(v.col) if func == "min" else F.max(v.col), v.kind.may)
    if v.kind.name not in ("num", "any"):
        x = F.lit(None).cast("double")
    else:
        x = V.numeric(v)
    if func == "sum":
        col = F.coalesce(F.sum_distinct(x) if distinct else total(v, x), F.lit(0))
        kind = Kind("num", v.kind.unit if v.kind.name == "num" else "", False, v.kind.whole)
    elif func == "avg":
        col = F.avg(x) if v.kind.decimal else total(v, x) / F.count(x) if not distinct else F.sum_distinct(x) / F.count_distinct(x)
        kind = Kind("num", v.kind.unit if v.kind.name == "num" else "")
    else:
        least = F.min(x) if func == "min" else F.max(x)
        if v.kind.name == "num" and not v.kind.whole:
            # Spark's min passes over NaN; here it poisons either extreme.
            least = F.when(F.max(F.isnan(x.cast("double"))), F.lit(float("nan"))).otherwise(least)
        col, kind = least, Kind("num", v.kind.unit if v.kind.name == "num" else "", True, v.kind.whole)
    return one_unit(v, col) if v.kind.name == "any" else Val(col, kind)


def reason(func: str, v: Val) -> Column:
    """Why the aggregate of a group is absent; null if it isn't."""
    none = F.lit(None).cast("string")
    if func in ("count", "present", "list"):
        return none
    out = F.when(F.count(V.numeric(v)) == 0, "no numbers") if func != "sum" else none
    if v.kind.name == "any":
        units = F.array_sort(F.collect_set(F.when((v.col["k"] == 1) & (v.col["u"] != ""), v.col["u"])))
        out = F.coalesce(F.when(F.size(units) > 1, F.concat(F.lit("mixed units: "), F.array_join(units, ", "))), out)
    return F.coalesce(F.when(F.count(F.lit(1)) == 0, "no rows") if func != "sum" else none, out)


def listed(v: Val, distinct: bool) -> Column:
    """The values in default order as a JSON list; a group's list is one value, so it must fit in memory."""
    gather = F.collect_set if distinct else F.collect_list
    if v.kind.name == "num":
        return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(gather(v.col)), V.format_number), ","), F.lit("]"))
    if v.kind.name == "any":
        boxes = F.array_sort(F.filter(gather(v.col), lambda b: b["k"] > 0))
        return F.concat(F.lit("["), F.array_join(F.transform(boxes, lambda b: F.when(b["k"] == 1, V.format_number(b["n"])).otherwise(json_text(b["s"]))), ","), F.lit("]"))
    return F.to_json(F.array_sort(gather(v.col.cast("string"))))


def json_text(s: Column) -> Column:
    quoted = F.to_json(F.array(s))
    return quoted.substr(F.lit(2), F.length(quoted) - 2)


def empty(func: str) -> Column | None:
    """What an aggregate is over nothing; None for absent."""
    return {"count": F.lit(0), "sum": F.lit(0), "list": F.lit("[]")}.get(func)
