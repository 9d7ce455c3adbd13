"""Typed column values: numbers are exact unless a double takes part.

Whole numbers and finite decimals use Spark's own types.  A quotient of exact numbers is kept as a pair of
38-digit whole numbers through arithmetic and comparison, and only becomes a double (or a reduced ``n/d``
string) on output.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError

WIDE = T.DecimalType(38, 0)
NUMBERS = ("int", "dec", "exact", "float")


@dataclass(frozen=True)
class Value:
    """kind: int, dec, exact (``pair``), float, string, bool, date, naive, utc, array, struct, map, json, nil,
    atom, regex.  ``nonnull``: proven never to be null."""

    col: Column | None
    kind: str
    nonnull: bool = False
    pair: tuple[Column, Column] | None = None
    type: T.DataType | None = None
    literal: object = None
    path: tuple = ()

    def but(self, **changes) -> Value:
        return replace(self, **changes)


def kind_of(t: T.DataType) -> str:
    match t:
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return "int"
        case T.DecimalType():
            return "int" if t.scale == 0 else "dec"
        case T.FloatType() | T.DoubleType():
            return "float"
        case T.StringType():
            return "string"
        case T.BooleanType():
            return "bool"
        case T.DateType():
            return "date"
        case T.TimestampNTZType():
            return "naive"
        case T.TimestampType():
            return "utc"
        case T.ArrayType():
            return "array"
        case T.StructType():
            return "struct"
        case T.MapType():
            return "map"
        case T.VariantType():
            return "json"
        case T.NullType():
            return "nil"
    return t.typeName()


def number(x) -> Value:
    """An exact number as a literal."""
    x = Fraction(x)
    if x.denominator == 1:
        n = int(x)
        big = not -(2**63) <= n < 2**63
        return Value(F.lit(Decimal(n)).cast(WIDE) if big else F.lit(n).cast("long"), "int", True, type=WIDE if big else T.LongType(), literal=x)
    rest = x.denominator
    for p in (2, 5):
        while rest % p == 0:
            rest //= p
    if rest == 1:
        d = Decimal(x.numerator) / Decimal(x.denominator)
        scale = -d.as_tuple().exponent
        t = T.DecimalType(max(len(d.as_tuple().digits), scale) + 1, scale)
        return Value(F.lit(d).cast(t), "dec", True, type=t, literal=x)
    return Value(None, "exact", True, (F.lit(x.numerator).cast(WIDE), F.lit(x.denominator).cast(WIDE)), literal=x)


def as_pair(v: Value) -> tuple[Column, Column]:
    if v.kind == "exact":
        return v.pair
    if v.kind == "int":
        return v.col.cast(WIDE), F.lit(1).cast(WIDE)
    scale = v.type.scale
    ten = F.lit(Decimal(10) ** scale).cast(WIDE)
    return (v.col.cast(T.DecimalType(38, scale)) * F.lit(Decimal(10) ** scale).cast(T.DecimalType(scale + 1, 0))).cast(WIDE), ten


def as_double(v: Value) -> Column:
    if v.kind == "exact":
        return v.pair[0].cast("double") / v.pair[1].cast("double")
    return v.col.cast("double")


def is_null(v: Value) -> Column:
    return v.pair[0].isNull() | v.pair[1].isNull() if v.kind == "exact" else v.col.isNull()


def reduced(pair: tuple[Column, Column]) -> tuple[Column, Column]:
    """Numerator and denominator without their common divisor, by Euclid's steps (38 digits need at most 190)."""
    n, d = pair
    state = F.struct(F.abs(n).alias("a"), F.abs(d).alias("b"))

    def step(s, _):
        return F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, F.lit(1).cast(WIDE)).otherwise(s["b"])).cast(WIDE).alias("b")))

    g = F.aggregate(F.sequence(F.lit(1), F.lit(190)), state, step)["a"]
    g = F.when(g == 0, F.lit(1).cast(WIDE)).otherwise(g)
    return (n / g).cast(WIDE), (d / g).cast(WIDE)


def binary_fraction(x: Column) -> tuple[Column, Column]:
    """The very value of a double as a reduced fraction, to 60 binary places; magnitudes from 2^63 on are an error.

    The whole part and the rest times 2^60 are whole doubles, so both convert without rounding.
    """
    high = F.floor(x)
    low = ((x - high) * F.lit(2.0**60)).cast("long")
    step = F.when(low == 0, F.lit(1 << 60)).otherwise(low.bitwiseAND(-low))
    whole = F.lit(Decimal(1 << 60)).cast(T.DecimalType(19, 0))
    n = (high.cast("long").cast(T.DecimalType(19, 0)) * whole).cast(WIDE) + low.cast(WIDE)
    return ((n / step.cast(WIDE)).cast(WIDE), (whole.cast(WIDE) / step.cast(WIDE)).cast(WIDE))


def float_text(x: Column) -> Column:
    """The shortest digits that give the double back, without an exponent below 10^16."""
    plain = F.regexp_replace(F.regexp_replace(x.cast("string").cast("decimal(38,15)").cast("string"), "0+$", ""), r"\.$", ".0")
    large = (F.abs(x) >= 1e7) & (F.abs(x) < 1e16)
    return F.when(large, plain).otherwise(F.lower(x.cast("string")))


def as_text(v: Value) -> Column:
    """``n/d``, or ``n`` for whole numbers."""
    n, d = reduced(v.pair)
    return F.when(d == 1, n.cast("string")).otherwise(F.concat(n.cast("string"), F.lit("/"), d.cast("string")))


def output(v: Value, exact: str = "double") -> Column:
    if v.kind == "exact":
        if exact == "string":
            return as_text(v)
        if exact == "struct":
            n, d = reduced(v.pair)
            return F.struct(n.alias("n"), d.alias("d"))
        return as_double(v)
    if v.kind == "json":
        return json_get(v, "string")
    if v.kind == "nil":
        return F.lit(None).cast("string")
    return v.col


def json_get(v: Value, type_name: str) -> Column:
    return F.try_variant_get(v.col, "$" + "".join(f".{p}" for p in v.path), type_name)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    for v in (a, b):
        if v.kind not in NUMBERS:
            raise QueryError("arithmetic_needs_numbers", op, v.kind)
    safe = a.nonnull and b.nonnull
    if op == "**":
        return power(a, b)
    if "float" in (a.kind, b.kind):
        x, y = as_double(a), as_double(b)
        return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y}[op](), "float", safe, type=T.DoubleType())
    if op == "/":
        (an, ad), (bn, bd) = as_pair(a), as_pair(b)
        if b.literal is not None and b.literal == 0:
            raise QueryError("division_by_zero")
        if b.literal is None:
            bn = F.when(bn == 0, F.raise_error(F.lit("division by zero")).cast(WIDE)).otherwise(bn)
        sign = F.when(bn < 0, F.lit(-1)).otherwise(F.lit(1)).cast(WIDE)
        return Value(None, "exact", safe, ((an * bd * sign).cast(WIDE), (ad * F.abs(bn)).cast(WIDE)))
    if "exact" in (a.kind, b.kind):
        (an, ad), (bn, bd) = as_pair(a), as_pair(b)
        if op == "*":
            n, d = an * bn, ad * bd
        else:
            n = (an * bd).cast(WIDE) + (bn * ad).cast(WIDE) if op == "+" else (an * bd).cast(WIDE) - (bn * ad).cast(WIDE)
            d = ad * bd
        return Value(None, "exact", safe, (n.cast(WIDE), d.cast(WIDE)))
    if a.kind == b.kind == "int" and isinstance(a.type, T.IntegralType) and isinstance(b.type, T.IntegralType):
        x, y, t = a.col.cast("long"), b.col.cast("long"), T.LongType()
    else:
        x, y = a.col, b.col
        sa, sb = (v.type.scale if isinstance(v.type, T.DecimalType) else 0 for v in (a, b))
        t = T.DecimalType(38, min(38, sa + sb if op == "*" else max(sa, sb)))
    col = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op]()
    return Value(col if isinstance(t, T.LongType) else col.cast(t), "int" if not getattr(t, "scale", 0) else "dec", safe, type=t)


def power(a: Value, b: Value) -> Value:
    if b.literal is None:
        if b.kind != "int":
            raise QueryError("exponent must be an integer")
        safe = a.nonnull and b.nonnull
        if a.kind == "float":
            return Value(F.pow(as_double(a), b.col), "float", safe, type=T.DoubleType())
        n, d = (_whole_power(x, F.abs(b.col.cast("long"))) for x in as_pair(a))
        under = b.col < 0
        n0 = F.when(under & (n == 0), F.raise_error(F.lit("division by zero")).cast(WIDE)).otherwise(n)
        sign = F.when(n < 0, F.lit(-1)).otherwise(F.lit(1)).cast(WIDE)
        return Value(None, "exact", safe, (F.when(under, (d * sign).cast(WIDE)).otherwise(n), F.when(under, F.abs(n0)).otherwise(d).cast(WIDE)))
    if b.literal.denominator != 1:
        raise QueryError("exponent must be an integer")
    n = int(b.literal)
    if n == 0:
        return number(1) if a.kind != "float" else Value(F.lit(1.0), "float", True, type=T.DoubleType())
    out = a
    for _ in range(abs(n) - 1):
        out = arithmetic("*", out, a)
    return out if n > 0 else arithmetic("/", number(1), out)


def _whole_power(x: Column, k: Column) -> Column:
    """x to the k-th, k >= 0, by multiplication; beyond 38 digits is an overflow error.  Of -1, 0 and 1 only k's
    parity counts, and any other number to the 128th has more digits than that."""
    times = F.when(F.abs(x) <= 1, F.when(k == 0, 0).when(k % 2 == 1, 1).otherwise(2)).otherwise(F.least(k, F.lit(128))).cast("int")
    one = F.lit(1).cast(WIDE)
    return F.when(times == 0, one).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), times)), one, lambda a, _: (a * x).cast(WIDE)))


def negated(v: Value) -> Value:
    if v.kind == "exact":
        return v.but(pair=(-v.pair[0], v.pair[1]), literal=None)
    if v.kind not in NUMBERS:
        raise QueryError("arithmetic_needs_numbers", "-", v.kind)
    return number(-v.literal) if v.literal is not None else v.but(col=-v.col)


_MOMENTS = ("date", "naive", "utc")


def compared(op: str, a: Value, b: Value) -> Column:
    """a op b for operands that aren't null; op one of = not= < > <= >=."""
    if a.kind == "json" or b.kind == "json":
        a, b = (_from_json(x, y) for x, y in ((a, b), (b, a)))
    numeric = a.kind in NUMBERS and b.kind in NUMBERS
    if numeric and "float" in (a.kind, b.kind):
        x, y = as_double(a), as_double(b)
    elif numeric and "exact" in (a.kind, b.kind):
        (an, ad), (bn, bd) = as_pair(a), as_pair(b)
        x, y = (an * bd).cast(WIDE), (bn * ad).cast(WIDE)
    elif numeric or a.kind == b.kind:
        x, y = a.col, b.col
    elif a.kind in _MOMENTS and b.kind in _MOMENTS:
        # A literal adapts to the column, so that a filter on the column reaches the scan.
        x, y = a.col, b.col
        if b.literal is not None:
            y = y.cast(_moment_type(a.kind))
        elif a.literal is not None:
            x = x.cast(_moment_type(b.kind))
    elif op in ("=", "not="):
        return F.lit(op == "not=")
    else:
        raise QueryError("incomparable", a.kind, b.kind)
    return {"=": lambda: x == y, "not=": lambda: x != y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y}[op]()


def _moment_type(kind: str) -> str:
    return {"date": "date", "naive": "timestamp_ntz", "utc": "timestamp"}[kind]


def _from_json(v: Value, other: Value) -> Value:
    if v.kind != "json":
        return v
    t = {"int": "bigint", "dec": "double", "exact": "double", "float": "double", "bool": "boolean"}.get(other.kind, "string")
    kind = {"bigint": "int", "double": "float", "boolean": "bool"}.get(t, "string")
    return Value(json_get(v, t), kind, False, type={"int": T.LongType(), "float": T.DoubleType()}.get(kind))
