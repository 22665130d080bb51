"""Values as Spark columns: kinds, equality, comparison, default order and text forms.

A column of one kind is a plain Spark column in which null stands for an absent value. Where numbers
and text meet in one column, or units differ from row to row, values are boxed as
struct<k, n, s, u>: 0 absent, 1 number, 2 text; the number; its spelling or the text; its unit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = "struct<k:tinyint,n:double,s:string,u:string>"


@dataclass(frozen=True)
class Kind:
    """num, text, any (boxed), or the name of a Spark type that is passed through as it is."""

    name: str
    unit: str = ""
    nullable: bool = True
    whole: bool = False  # num of an integer type: no NaN
    decimal: bool = False  # num of a decimal type: sums are exact

    @property
    def may(self) -> Kind:
        return replace(self, nullable=True)


NUM, TEXT, ANY = Kind("num"), Kind("text"), Kind("any")


@dataclass(frozen=True)
class Val:
    """A column and its kind."""

    col: Column
    kind: Kind


def kind_of(t: T.DataType, nullable: bool = True, unit: str = "") -> Kind:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Kind("num", unit, nullable, True)
    if isinstance(t, T.NumericType):
        return Kind("num", unit, nullable, False, isinstance(t, T.DecimalType))
    if isinstance(t, T.StringType):
        return Kind("text", "", nullable)
    if isinstance(t, T.StructType) and t.names == ["k", "n", "s", "u"]:
        return Kind("any", "", nullable)
    return Kind(t.simpleString(), "", nullable)


def constant(value: object, unit: str = "") -> Val:
    if value is None:
        return Val(F.lit(None).cast("string"), TEXT)
    if isinstance(value, str):
        return Val(F.lit(value), Kind("text", nullable=False))
    return Val(F.lit(value), Kind("num", unit, False, isinstance(value, int)))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once for a row."""
    return F.transform(F.array(value), then)[0]


def format_number(x: Column) -> Column:
    """The shortest digits that read back as the number, with an exponent from 1e+06 and below 1e-04."""
    d = x.cast("double")

    def parts(s: Column) -> Column:
        mantissa = F.regexp_extract(s, r"^([0-9.]+)", 1)
        power = F.coalesce(F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        digits = F.regexp_replace(F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "^0+", ""), "0+$", "")
        lead = F.length(F.regexp_extract(mantissa, r"^0\.(0*)", 1))
        exponent = F.when(mantissa.startswith("0."), -lead - 1).otherwise(F.instr(mantissa, ".") - 2) + power
        return F.struct(digits.alias("d"), exponent.alias("e"))

    def body(p: Column) -> Column:
        digits, e = p["d"], p["e"]
        rest = F.when(F.length(digits) > 1, F.concat(F.lit("."), digits.substr(F.lit(2), F.length(digits)))).otherwise("")
        size = F.abs(e).cast("string")
        power = F.concat(F.when(e < 0, "-").otherwise("+"), F.lpad(size, F.greatest(F.lit(2), F.length(size)), F.lit("0")))
        sci = F.concat(F.substring(digits, 1, 1), rest, F.lit("e"), power)
        padded = F.rpad(digits, F.greatest(e + 1, F.length(digits)), F.lit("0"))
        tail = F.when(F.length(digits) > e + 1, F.concat(F.lit("."), padded.substr(e + 2, F.length(padded)))).otherwise("")
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        return F.when((e < -4) | (e >= 6), sci).when(e < 0, small).otherwise(F.concat(padded.substr(F.lit(1), e + 1), tail))

    special = F.when(F.isnan(d), "NaN").when(F.abs(d) == float("inf"), F.when(d > 0, "+Inf").otherwise("-Inf")).when(d == 0, "0")
    plain = let(F.abs(d).cast("string"), lambda s: let(parts(s), body))
    return F.when(x.isNotNull(), F.coalesce(special, F.concat(F.when(d < 0, "-").otherwise(""), plain)))


def box(v: Val) -> Column:
    if v.kind.name == "any":
        return v.col
    none, unit = F.lit(None), F.lit(v.kind.unit)
    if v.kind.name == "num":
        made = F.struct(F.lit(1).cast("tinyint").alias("k"), v.col.cast("double").alias("n"), none.cast("string").alias("s"), unit.alias("u"))
    else:
        made = F.struct(F.lit(2).cast("tinyint").alias("k"), none.cast("double").alias("n"), v.col.cast("string").alias("s"), F.lit("").alias("u"))
    absent = F.struct(F.lit(0).cast("tinyint").alias("k"), none.cast("double").alias("n"), none.cast("string").alias("s"), F.lit("").alias("u"))
    return F.when(v.col.isNull(), absent).otherwise(made).cast(BOX)


def boxed_key(b: Column) -> Column:
    """What boxed values are equal by: units and spellings don't count, and -0 is 0."""
    return F.struct(b["k"].alias("k"), (b["n"] + 0.0).alias("n"), F.when(b["k"] == 2, b["s"]).alias("s"))


def key(v: Val) -> Column:
    return boxed_key(v.col) if v.kind.name == "any" else v.col


def numeric(v: Val) -> Column:
    """The number, or null where there is none."""
    return v.col["n"] if v.kind.name == "any" else v.col if v.kind.name == "num" else F.lit(None).cast("double")


def text(v: Val) -> Column:
    """The text form; null where absent."""
    if v.kind.name == "any":
        return F.when(v.col["k"] == 2, v.col["s"]).when(v.col["k"] == 1, F.coalesce(v.col["s"], F.concat(format_number(v.col["n"]), v.col["u"])))
    if v.kind.name == "num":
        t = format_number(v.col)
        return F.concat(t, F.lit(v.kind.unit)) if v.kind.unit else t
    return v.col if v.kind.name == "text" else v.col.cast("string")


def is_absent(v: Val) -> Column:
    return (v.col["k"] == 0) | v.col.isNull() if v.kind.name == "any" else v.col.isNull() if v.kind.nullable else F.lit(False)


def same(a: Val, b: Val) -> Column:
    """Whether two values join: absent equals absent, a number never equals text."""
    if "any" in (a.kind.name, b.kind.name):
        return boxed_key(box(a)).eqNullSafe(boxed_key(box(b)))
    if a.kind.name != b.kind.name:
        return a.col.isNull() & b.col.isNull()
    return a.col.eqNullSafe(b.col) if a.kind.nullable and b.kind.nullable else a.col == b.col


def nan_free(v: Val) -> Column | None:
    return None if v.kind.whole or v.kind.name != "num" else ~F.isnan(v.col.cast("double"))


def compare(op: str, a: Val, b: Val, filtering: bool = False) -> Column:
    """A comparison that is never null, or with `filtering` may be null for false, so that it reaches the scan.
    Absent values are equal to each other and have no order."""
    if op == "!=":
        return ~compare("=", a, b)
    if op == "=":
        out = same(a, b)
        guard = nan_free(a) if a.kind.name == b.kind.name == "num" else None
        if guard is not None:
            out = out & (F.coalesce(guard, F.lit(True)) if a.kind.nullable else guard)
        return out if filtering else F.coalesce(out, F.lit(False))
    names = {a.kind.name, b.kind.name}
    test = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if "any" in names:
        x, y = box(a), box(b)
        numbers = (x["k"] == 1) & (y["k"] == 1) & ((x["u"] == "") | (y["u"] == "") | (x["u"] == y["u"])) & ~F.isnan(x["n"]) & ~F.isnan(y["n"]) & test(x["n"], y["n"])
        return F.coalesce(numbers | ((x["k"] == 2) & (y["k"] == 2) & test(x["s"], y["s"])), F.lit(False))
    if len(names) > 1 and not (names & {"date", "timestamp", "timestamp_ntz"} and "text" in names):
        return F.lit(False)
    if a.kind.unit and b.kind.unit and a.kind.unit != b.kind.unit:
        return F.lit(False)
    out = test(a.col, b.col)
    for guard in (nan_free(a), nan_free(b)):
        if guard is not None:
            out = out & guard
    return out if filtering or not (a.kind.nullable or b.kind.nullable) else F.coalesce(out, F.lit(False))


def order_keys(v: Val, descending: bool = False) -> list[Column]:
    """Sort keys of the default order: absent, numbers by value with NaN first, text by bytes."""
    if v.kind.name == "any":
        b = v.col
        keys = [F.coalesce(b["k"], F.lit(0)), ~F.isnan(b["n"]), b["n"], b["s"]]
    elif v.kind.name == "num" and not v.kind.whole:
        keys = [v.col.isNotNull(), ~F.isnan(v.col.cast("double")), v.col]
    else:
        keys = [v.col]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]


def after(values: list[Val], given: list[Val], descending: list[bool]) -> Column:
    """Whether a row comes strictly after the given one in this order."""
    out = F.lit(False)
    for v, g, d in reversed(list(zip(values, given, descending, strict=True))):
        x, y = F.struct(*rank(v)), F.struct(*rank(g))
        out = ((x < y) if d else (x > y)) | (x.eqNullSafe(y) & out)
    return out


def rank(v: Val) -> list[Column]:
    if v.kind.name == "any":
        return [F.coalesce(v.col["k"], F.lit(0)).cast("int").alias("a"), F.coalesce(v.col["n"], F.lit(0.0)).alias("b"), F.coalesce(v.col["s"], F.lit("")).alias("c")]
    if v.kind.name == "num":
        d = v.col.cast("double")
        return [F.when(d.isNull(), 0).when(F.isnan(d), 1).otherwise(2).alias("a"), F.coalesce(F.when(~F.isnan(d), d), F.lit(0.0)).alias("b")]
    return [F.when(v.col.isNull(), 0).otherwise(1).alias("a"), v.col.alias("b")]


def common(kinds: list[Kind]) -> Kind:
    """The kind that values of all these kinds can be held in."""
    first = kinds[0]
    nullable, whole = any(k.nullable for k in kinds), all(k.whole for k in kinds)
    if any(k.name == "any" for k in kinds) or len({(k.name, k.unit) for k in kinds}) > 1:
        return Kind("any", "", nullable)
    return Kind(first.name, first.unit, nullable, whole, all(k.decimal for k in kinds))


def held(v: Val, kind: Kind) -> Column:
    return box(v) if kind.name == "any" and v.kind.name != "any" else v.col


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)
