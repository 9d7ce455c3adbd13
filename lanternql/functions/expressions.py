"""Expressions and predicates of a plan as Spark columns.

Comparisons are strict: a null operand is an error, not an unknown.  Where a column is proven non-null, by
its declaration or by an earlier test in the same predicate, the plain comparison is emitted, which Spark
pushes to the scan; elsewhere the test stands before it in a ``CASE``.  ``strict=False`` gives SQL's
behaviour everywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..plans import ast
from . import values as V
from .values import Value

AGGREGATES = ("sum", "avg", "count", "min", "max", "var_pop", "var_samp", "stddev_pop", "stddev_samp", "percentile", "rate")
CASTS = ("string", "int", "exact", "inexact", "json", "dxn", "dxnb")
RANKINGS = ("row_number", "rank", "first_value", "last_value")
RESERVED = frozenset((*AGGREGATES, *CASTS, *RANKINGS))
#: Casts whose codec is no part of the language: they run what is registered under their name.
DECODERS = frozenset(("dxn", "dxnb"))

NULL_COMPARED = "comparing a nullable field against a typed value encountered a nil value"


class Functions:
    """Functions beyond the built-in ones: a name and a callable from columns to a column."""

    def __init__(self):
        self.table: dict[str, Callable[..., Column]] = {}

    def register(self, name: str, f: Callable[..., Column]) -> None:
        if name in RESERVED - DECODERS:
            raise QueryError("reserved_function", name)
        self.table[name] = f


@dataclass
class Options:
    params: dict = field(default_factory=dict)
    strict: bool = True
    exact: str = "double"
    ordered: bool = False
    functions: Functions = field(default_factory=Functions)


NOTHING: frozenset = frozenset()


class Scope:
    """What names mean: the columns of a frame.

    ``nonnull`` has the top-level columns proven non-null; ``outer`` maps a correlated (parent, field) to the
    column that carries it.
    """

    def __init__(self, schema: T.StructType, options: Options, nonnull=NOTHING, outer=None, source: str | None = None, prefix: str = ""):
        self.schema, self.options = schema, options
        self.nonnull = frozenset(nonnull)
        self.outer = outer or {}
        self.source = source
        self.prefix = prefix

    # -- names
    def field(self, path: tuple[str, ...], facts=NOTHING) -> Value:
        if path[:2] in self.outer:
            v = self.outer[path[:2]]
            for name in path[2:]:
                v = self.inside(v, name)
            return v
        if path[0] not in self.schema.names and len(path) > 1 and path[0] == self.source:
            path = path[1:]
        if path[0] not in self.schema.names:
            raise QueryError("no_such_column", ".".join(path))
        f = self.schema[path[0]]
        known = path[0] in self.nonnull or not f.nullable
        v = Value(F.col(f"`{self.prefix}{path[0]}`"), V.kind_of(f.dataType), known, type=f.dataType)
        for name in path[1:]:
            v = self.inside(v, name)
        return v.but(nonnull=True) if path in facts else v

    def inside(self, v: Value, name: str) -> Value:
        if isinstance(v.type, T.StructType):
            if name not in v.type.names:
                raise QueryError("no_such_column", name)
            t = v.type[name].dataType
            return Value(v.col.getField(name), V.kind_of(t), False, type=t)
        if isinstance(v.type, T.MapType):
            t = v.type.valueType
            return Value(F.element_at(v.col, F.lit(name)), V.kind_of(t), False, type=t)
        if v.kind == "json":
            return v.but(path=(*v.path, name), nonnull=False)
        raise QueryError("not_a_map", name)

    # -- expressions
    def value(self, e, facts=NOTHING) -> Value:
        match e:
            case ast.Lit():
                return self.literal(e)
            case ast.Param(name):
                return self.literal(self.param(name))
            case ast.Field(path):
                return self.field(path, facts)
            case ast.Arith("&" | "|" as op, a, b):
                x, y = self.value(a, facts), self.value(b, facts)
                if x.kind != "int" or y.kind != "int":
                    raise QueryError(f"bitwise {'band' if op == '&' else 'bor'} requires two integer operands")
                both = x.col.cast("long").bitwiseAND(y.col.cast("long")) if op == "&" else x.col.cast("long").bitwiseOR(y.col.cast("long"))
                return Value(both, "int", x.nonnull and y.nonnull, type=T.LongType())
            case ast.Arith(op, a, b):
                return V.arithmetic(op, self.value(a, facts), self.value(b, facts))
            case ast.Unary("-", a):
                return V.negated(self.value(a, facts))
            case ast.Unary("!", a):
                v = self.value(a, facts)
                if v.kind != "int":
                    raise QueryError("bitwise ! requires an integer operand")
                return v.but(col=F.bitwise_not(v.col.cast("long")), literal=None, type=T.LongType())
            case ast.When(branches, default):
                return self.when(branches, default, facts)
            case ast.Dot(base, path):
                v = self.value(base, facts)
                for name in path:
                    v = self.inside(v, name)
                return v
            case ast.Call():
                return self.call(e, facts)
            case ast.Over():
                raise QueryError("a window function is only valid in a select body")
            case ast.Scoped():
                raise QueryError("body_item_where_requires_aggregate")
            case ast.Variant(tag):
                raise QueryError("unresolved_variant", tag)
        raise QueryError("unsupported_expression", type(e).__name__)

    def param(self, name: str) -> ast.Lit:
        if name not in self.options.params:
            raise QueryError(f'missing external parameter: "{name}"')
        return literal_of(self.options.params[name])

    def literal(self, e: ast.Lit) -> Value:
        match e:
            case ast.Lit(x, "int" | "exact"):
                return V.number(x)
            case ast.Lit(x, "float"):
                return Value(F.lit(float(x)), "float", True, type=T.DoubleType())
            case ast.Lit(x, "string"):
                return Value(F.lit(x), "string", True, type=T.StringType(), literal=x)
            case ast.Lit(x, "atom"):
                return Value(F.lit(x), "atom", True, type=T.StringType(), literal=x)
            case ast.Lit(x, "bool"):
                return Value(F.lit(x), "bool", True, type=T.BooleanType(), literal=x)
            case ast.Lit(_, "nil"):
                return Value(F.lit(None), "nil", False, type=T.NullType())
            case ast.Lit(x, "regex"):
                return Value(F.lit(x), "regex", True, literal=x)
            case ast.Lit(x, "date"):
                return Value(F.lit(x), "date", True, type=T.DateType(), literal=x)
            case ast.Lit(x, "naive"):
                return Value(F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz"), "naive", True, type=T.TimestampNTZType(), literal=x)
            case ast.Lit(x, "utc"):
                return Value(F.lit(x), "utc", True, type=T.TimestampType(), literal=x)
            case ast.Lit(xs, "list"):
                cols = [V.output(self.value(x)) for x in xs]
                return Value(F.array(*cols), "array", True, type=T.ArrayType(T.StringType()), literal=xs)
        raise QueryError("unsupported_literal", e.kind)

    def when(self, branches, default, facts) -> Value:
        results, conditions, seen = [], [], facts
        for p, e in branches:
            c, _, yes, no = self.test(p, seen)
            conditions.append(c)
            results.append(self.value(e, seen | yes))
            seen = seen | no
        results.append(self.value(default, seen))
        kinds = {v.kind for v in results} - {"nil"}
        if kinds <= {"int"}:
            cols, kind, t = [v.col.cast("long") for v in results], "int", T.LongType()
        elif kinds <= set(V.NUMBERS) and "float" not in kinds:
            pairs = [V.as_pair(v) if v.kind != "nil" else (F.lit(None).cast(V.WIDE), F.lit(None).cast(V.WIDE)) for v in results]
            both = [self.choose(conditions, [p[i] for p in pairs]) for i in (0, 1)]
            return Value(None, "exact", all(v.nonnull for v in results), tuple(both))
        elif kinds <= set(V.NUMBERS):
            cols, kind, t = [V.as_double(v) if v.kind != "nil" else F.lit(None).cast("double") for v in results], "float", T.DoubleType()
        else:
            cols, kind = [V.output(v) for v in results], next(iter(kinds), "nil")
            t = next((v.type for v in results if v.kind == kind), T.StringType())
        return Value(self.choose(conditions, cols), kind, all(v.nonnull for v in results), type=t)

    @staticmethod
    def choose(conditions, cols) -> Column:
        out = F
        for c, x in zip(conditions, cols):
            out = out.when(c, x)
        return out.otherwise(cols[-1])

    def call(self, e: ast.Call, facts) -> Value:
        if e.name in AGGREGATES:
            raise QueryError(f"aggregate {e.name}(...) is only valid inside GROUP BY or HAVING")
        if e.distinct:
            raise QueryError("count alone takes DISTINCT")
        if e.name in RANKINGS:
            raise QueryError("unknown or unsupported function", e.name)
        if e.name in CASTS:
            if len(e.args) != 1:
                raise QueryError(f"wrong number of arguments for {e.name}/1: {len(e.args)}")
            return self.cast(e.name, self.value(e.args[0], facts))
        if f := self.options.functions.table.get(e.name):
            col = f(*[V.output(self.value(a, facts)) for a in e.args])
            return Value(col, *self.typed(col))
        raise QueryError(f'unknown or unsupported function: "{e.name}"')

    def typed(self, col: Column):
        """(kind, nonnull, pair, type) of a column that a registered function made."""
        from pyspark.sql import SparkSession

        empty = SparkSession.active().createDataFrame([], self.schema)
        t = empty.select(col.alias("x")).schema["x"].dataType
        return V.kind_of(t), False, None, t

    def cast(self, name: str, v: Value) -> Value:
        fail = lambda: QueryError(f"{name}(...) does not support this value", v.kind)
        if v.kind == "json" and name != "json":
            v = Value(V.json_get(v, "string"), "string", False, type=T.StringType())
        if name == "inexact":
            if v.kind not in V.NUMBERS:
                raise fail()
            return Value(V.as_double(v), "float", v.nonnull, type=T.DoubleType())
        if name == "exact":
            if v.kind == "float":
                return Value(None, "exact", v.nonnull, V.binary_fraction(v.col.cast("double")))
            if v.kind not in V.NUMBERS:
                raise fail()
            return v
        if name == "int":
            if v.kind == "int":
                return v
            if v.kind == "exact":
                n, d = v.pair
                # A quotient of decimals is rounded, so the remainder (of the dividend's sign) goes first.
                return Value(((n - n % d) / d).cast("long"), "int", v.nonnull, type=T.LongType())
            if v.kind in ("dec", "float"):
                return Value(v.col.cast("long"), "int", v.nonnull, type=T.LongType())
            if v.kind == "string":
                bad = F.raise_error(F.concat(F.lit("int(...) could not parse "), v.col)).cast("long")
                return Value(F.when(v.col.rlike(r"^[+-]?[0-9]+$"), v.col.cast("long")).when(v.col.isNull(), F.lit(None).cast("long")).otherwise(bad), "int", v.nonnull, type=T.LongType())
            raise fail()
        if name == "string":
            if v.kind in ("array", "struct", "map", "regex"):
                raise fail()
            if v.kind == "exact":
                col = V.as_text(v)
            elif v.kind == "dec":
                col = V.as_text(v.but(pair=V.as_pair(v)))
            elif v.kind in ("utc", "naive"):
                col = F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
                col = F.regexp_replace(F.regexp_replace(col, r"0+$", ""), r"\.$", "")
                col = F.concat(col, F.lit("Z")) if v.kind == "utc" else col
            elif v.kind == "float":
                col = V.float_text(v.col.cast("double"))
            else:
                col = v.col.cast("string")
            return Value(F.coalesce(col, F.lit("nil")), "string", True, type=T.StringType())
        if name == "json":
            if v.kind != "string":
                raise QueryError("json(...) only applies to a String value", v.kind)
            return Value(F.parse_json(v.col), "json", v.nonnull, type=T.VariantType())
        if f := self.options.functions.table.get(name):
            col = f(v.col)
            return Value(col, *self.typed(col))
        raise QueryError("unsupported", f"{name}(...) needs a decoder: register a function of that name")

    # -- predicates
    def predicate(self, p) -> Column:
        return self.test(p, NOTHING)[0]

    def test(self, p, facts):
        """(column, can raise, fields known non-null if it holds, and if it doesn't)."""
        match p:
            case ast.And(a, b):
                x, xr, xy, xn = self.test(a, facts)
                y, yr, yy, yn = self.test(b, facts | xy)
                col = F.when(x, y).otherwise(F.lit(False)) if xr or yr else x & y
                return col, xr or yr, xy | yy, xn & (xy | yn)
            case ast.Or(a, b):
                x, xr, xy, xn = self.test(a, facts)
                y, yr, yy, yn = self.test(b, facts | xn)
                col = F.when(x, F.lit(True)).otherwise(y) if xr or yr else x | y
                return col, xr or yr, xy & (xn | yy), xn | yn
            case ast.Not(a):
                x, xr, xy, xn = self.test(a, facts)
                return ~x, xr, xn, xy
            case ast.Cmp("=" | "not=" as op, a, ast.Lit(_, "nil")):
                v = self.value(a, facts)
                known = frozenset([a.path]) if isinstance(a, ast.Field) else NOTHING
                null = V.is_null(v)
                return (null, False, NOTHING, known) if op == "=" else (~null, False, known, NOTHING)
            case ast.Cmp("in", a, b):
                return self.membership(a, b, facts), False, NOTHING, NOTHING
            case ast.Cmp("subset" | "subset_eq" | "superset" | "superset_eq" as op, a, b):
                return self.sets(op, a, b, facts), False, NOTHING, NOTHING
            case ast.Cmp(op, a, b):
                return self.comparison(op, a, b, facts)
            case ast.Variant(tag):
                raise QueryError("unresolved_variant", tag)
            case ast.Field() | ast.Lit(_, "bool"):
                return self.value(p, facts).col, False, NOTHING, NOTHING
            case ast.Param():
                return F.lit(bool(self.param(p.name).value)), False, NOTHING, NOTHING
        raise QueryError("unsupported_predicate", type(p).__name__)

    def comparison(self, op, a, b, facts):
        x, y = self.value(a, facts), self.value(b, facts)
        if "nil" in (x.kind, y.kind):
            raise QueryError(NULL_COMPARED, op)
        if op == "~":
            if y.kind != "regex":
                raise QueryError("~ expects a regex")
            col = x.col.rlike(y.literal)
        else:
            col = V.compared(op, x, y)
        known = frozenset(e.path for e in (a, b) if isinstance(e, ast.Field))
        nulls = [V.is_null(v) if v.kind != "json" else V.json_get(v, "string").isNull() for v in (x, y) if not v.nonnull]
        if not nulls or not self.options.strict:
            return col, False, known if self.options.strict else NOTHING, known if self.options.strict else NOTHING
        any_null = nulls[0] if len(nulls) == 1 else nulls[0] | nulls[1]
        return F.when(any_null, F.raise_error(F.lit(NULL_COMPARED)).cast("boolean")).otherwise(col), True, known, known

    def membership(self, a, b, facts) -> Column:
        x = self.value(a, facts)
        if isinstance(b, ast.Param):
            b = self.param(b.name)
        if isinstance(b, ast.Lit):
            if b.kind != "list":
                raise QueryError("in ... expects a list value")
            options = [self.param(e.name) if isinstance(e, ast.Param) else e for e in b.value]
            nil = any(isinstance(o, ast.Lit) and o.kind == "nil" for o in options)
            tests = [self.value(o) for o in options if not (isinstance(o, ast.Lit) and o.kind == "nil")]
            if all(t.kind == x.kind and x.kind in ("int", "string", "bool", "date") for t in tests) and tests:
                found = x.col.isin(*[t.literal if x.kind != "int" else int(t.literal) for t in tests if t.literal is not None])
                tests = [t for t in tests if t.literal is None]
            else:
                found = F.lit(False)
            for t in tests:
                found = found | V.compared("=", x, t)
            if x.nonnull:
                return found
            found = F.coalesce(found, F.lit(False))
            null = V.json_get(x, "string").isNull() if x.kind == "json" else V.is_null(x)
            return found | null if nil else found
        y = self.value(b, facts)
        if y.kind == "json":
            t = {"int": "bigint", "float": "double", "dec": "double", "bool": "boolean"}.get(x.kind, "string")
            y = Value(V.json_get(y, f"array<{t}>"), "array", False, type=T.ArrayType(T.StringType()))
        if y.kind != "array":
            raise QueryError("in ... expects a list value")
        found = F.coalesce(F.array_contains(y.col, x.col), F.lit(False))
        if y.nonnull or not self.options.strict:
            return found
        return F.when(y.col.isNull(), F.raise_error(F.lit("in ... expects a list value")).cast("boolean")).otherwise(found)

    def sets(self, op, a, b, facts) -> Column:
        x, y = self.value(a, facts), self.value(b, facts)
        if x.kind == "json" or y.kind == "json":
            x, y = (Value(V.json_get(v, "array<string>"), "array") if v.kind == "json" else v for v in (x, y))
        if x.kind != "array" or y.kind != "array":
            raise QueryError(f"{op.removesuffix('_eq')} requires two list operands")
        if op.startswith("superset"):
            x, y = y, x
        # Literal lists are made of the other side's element type.
        inside = F.size(F.array_except(x.col, y.col)) == 0
        return inside if op.endswith("_eq") else inside & (F.size(F.array_except(y.col, x.col)) > 0)


def literal_of(x) -> ast.Lit:
    """A Python value as a literal."""
    from datetime import date, datetime
    from decimal import Decimal

    match x:
        case ast.Lit():
            return x
        case None:
            return ast.Lit(None, "nil")
        case bool():
            return ast.Lit(x, "bool")
        case int():
            return ast.Lit(x, "int")
        case Fraction() | Decimal():
            return ast.Lit(Fraction(x), "exact")
        case float():
            return ast.Lit(x, "float")
        case str():
            return ast.Lit(x, "string")
        case datetime():
            return ast.Lit(x, "utc" if x.tzinfo else "naive")
        case date():
            return ast.Lit(x, "date")
        case list() | tuple() | set():
            return ast.Lit(tuple(map(literal_of, x)), "list")
    raise QueryError("unsupported_parameter", type(x).__name__)
