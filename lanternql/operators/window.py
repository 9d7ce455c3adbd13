"""Window functions.  The default frame is the whole partition, also with ORDER BY.

Frames that hold the current row are Spark's own.  Of the others both ends are clamped into the partition, which only
matters where a frame lies beyond it: there it is the partition's first or last row.  Percentiles and numbers of
distinct values of whole partitions are grouped once and joined; over other frames, they list the frame's values.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import QueryError
from ..functions import values as V
from ..functions.expressions import AGGREGATES, RANKINGS, Scope
from ..functions.values import Value
from ..plans import ast
from .aggregate import ROW, matched, micros, per_time, rank_table, ranked
from .order import key

_WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


class WindowScope(Scope):
    """A scope in which ``OVER`` may be used.  ``carried`` are key columns that part every partition."""

    def __init__(self, base: Scope, carried: list[str], time_field=None):
        super().__init__(base.schema, base.options, base.nonnull, base.outer, base.source)
        self.carried, self.time_field = carried, time_field
        self.prepared: dict[str, Column] = {}
        self.tables: list = []

    def value(self, e, facts=frozenset()) -> Value:
        return self.over(e) if isinstance(e, ast.Over) else super().value(e, facts)

    def over(self, e: ast.Over) -> Value:
        name, args = e.call.name, e.call.args
        if name not in AGGREGATES and name not in RANKINGS:
            raise QueryError(f"{name}(...) can't stand before OVER")
        if name in ("row_number", "rank") and args:
            raise QueryError(f"wrong number of arguments for {name}/0: {len(args)}")
        if name not in ("row_number", "rank", "percentile") and len(args) != 1:
            raise QueryError(f"wrong number of arguments for {name}/1: {len(args)}")
        if name == "percentile" and len(args) != 2:
            raise QueryError(f"wrong number of arguments for percentile/2: {len(args)}")
        if e.call.distinct and name != "count":
            raise QueryError("count alone takes DISTINCT")
        parts = [F.col(f"`{k}`") for k in self.carried] + [V.output(self.value(p)) for p in e.partition]
        order = [key(self.value(o.expr), o.desc) for o in e.order]
        base = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
        rows = base.orderBy(*order, F.col(ROW))
        if name == "row_number":
            return Value(F.row_number().over(rows).cast("long"), "int", True, type=T.LongType())
        if name == "rank":
            col = F.rank().over(base.orderBy(*order)).cast("long") if order else F.lit(1).cast("long")
            return Value(col, "int", True, type=T.LongType())
        v = self.value(args[0])
        if name == "rate":
            return self.rate(v, e, rows)
        if v.kind == "exact":
            v = Value(V.as_double(v), "float", v.nonnull, type=T.DoubleType())
        x = v.col
        if name in AGGREGATES and not v.nonnull and self.options.strict:
            x = F.when(x.isNull(), F.raise_error(F.lit(f"aggregate {name}(...) encountered a nil value")).cast(v.type)).otherwise(x)
        low, high = self.bounds(e.frame)
        listing = name == "percentile" or e.call.distinct
        share = self.share(args[1]) if name == "percentile" else None
        if listing and (low, high) == _WHOLE and (share is None or share.literal is not None):
            return self.looked_up(v, x, parts, share)
        if name in ("first_value", "last_value"):
            return v.but(col=self.at(x, low if name == "first_value" else high, rows), nonnull=False, literal=None)
        # An unordered whole partition needs no sort.
        w = base if (low, high) == _WHOLE and not listing else rows

        def applied(over):
            if listing:
                values = over(F.collect_list(x))
                return Value(F.size(F.array_distinct(values)).cast("long"), "int", True, type=T.LongType()) if share is None else v.but(col=ranked(values, share), nonnull=False, literal=None)
            return self.applied(name, v, x, over)

        inside = applied(lambda c: c.over(w.rowsBetween(low, high))) if low <= high and high != _WHOLE[0] and low != _WHOLE[1] else None
        if low <= 0 <= high:
            return inside
        return self.clamped(name, e.call.distinct, v, x, rows, low, high, inside)

    def share(self, e) -> Value:
        p = self.value(e)
        if p.literal is not None and not 0 <= p.literal <= 1:
            raise QueryError("the share of a percentile lies between 0 and 1")
        return p

    def looked_up(self, v: Value, x: Column, parts: list[Column], share: Value | None) -> Value:
        """Percentile or number of distinct values of the whole partition: grouped once and joined, so that no row
        carries its partition's values."""
        name = f"__w{len(self.tables)}"
        self.prepared[f"{name}_x"] = x
        if share is None:
            self.tables.append((parts, lambda rows, names: rows.groupBy(*names).agg(F.count_distinct(f"{name}_x").alias(name))))
            return Value(F.col(name), "int", True, type=T.LongType())
        self.tables.append((parts, lambda rows, names: rank_table(rows, names, f"{name}_x", [(Fraction(share.literal), name)])))
        return v.but(col=F.col(name), nonnull=False, literal=None)

    def ready(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns that values of this scope look up."""
        df = df.withColumns(self.prepared) if self.prepared else df
        source = df
        for parts, table in self.tables:
            df = matched(df, parts, table, source)
        return df

    def bounds(self, frame) -> tuple[int, int]:
        """First and last row of the frame, counted from the current one."""
        if frame is None:
            return _WHOLE
        at = {"unbounded_preceding": lambda n: _WHOLE[0], "preceding": lambda n: -n, "current": lambda n: 0, "following": lambda n: n, "unbounded_following": lambda n: _WHOLE[1]}
        (a, m), (b, n) = frame
        return at[a](m), at[b](n)

    @staticmethod
    def beyond(k: int, rows) -> tuple[Column, Column]:
        """Whether the k-th row from the current one lies before the partition's first, or after its last."""
        here = F.row_number().over(rows)
        size = F.count(F.lit(1)).over(rows.rowsBetween(*_WHOLE))
        unbounded = {_WHOLE[0]: (True, False), _WHOLE[1]: (False, True)}.get(k)
        return tuple(map(F.lit, unbounded)) if unbounded else (here + k < 1, here + k > size)

    def at(self, x: Column, k: int, rows) -> Column:
        """The value of the k-th row from the current one; beyond the partition, of its first or last."""
        first, last = (f(x).over(rows.rowsBetween(*_WHOLE)) for f in (F.first, F.last))
        if k in _WHOLE:
            return first if k == _WHOLE[0] else last
        if k == 0:
            return x
        before, after = self.beyond(k, rows)
        return F.when(before, first).when(after, last).otherwise(F.first(x).over(rows.rowsBetween(k, k)))

    def clamped(self, name: str, distinct: bool, v: Value, x: Column, rows, low: int, high: int, inside: Value | None) -> Value:
        """A frame without the current row, or inverted: if both its ends lie beyond the same end of the partition
        it is the one row there, else, inverted, it is empty."""
        low_before, low_after = self.beyond(low, rows)
        high_before, high_after = self.beyond(high, rows)
        here = F.row_number().over(rows)
        size = F.count(F.lit(1)).over(rows.rowsBetween(*_WHOLE))
        first, last = (f(x).over(rows.rowsBetween(*_WHOLE)) for f in (F.first, F.last))
        at_end = (low_after | (here + low == size if low not in _WHOLE else F.lit(False))) & (high_after | (here + high == size if high not in _WHOLE else F.lit(False)))
        at_start = (low_before | (here + low == 1 if low not in _WHOLE else F.lit(False))) & (high_before | (here + high == 1 if high not in _WHOLE else F.lit(False)))
        only = F.when(at_end, last).when(at_start, first)  # the one row's value
        single = at_end | at_start
        if inside is not None:
            single = (low_after | high_before) & single

        def joined(one: Column, many: Column | None) -> Column:
            return F.when(single, one) if many is None else F.when(single, one).otherwise(many)

        if name == "count":
            some = F.when(only.isNull(), 0).otherwise(1).cast("long")
            return Value(F.coalesce(joined(some, inside and inside.col), F.lit(0).cast("long")), "int", True, type=T.LongType())
        if name in ("min", "max", "percentile"):
            return v.but(col=joined(only, inside and inside.col), nonnull=False, literal=None)
        if v.kind not in V.NUMBERS:
            raise QueryError(f"aggregate {name}(...) needs numbers", v.kind)
        t = T.LongType() if isinstance(v.type, T.IntegralType) else T.DoubleType() if v.kind == "float" else T.DecimalType(38, v.type.scale)
        if name == "sum":
            return Value(joined(only.cast(t), inside and inside.col).cast(t), v.kind, type=t)
        if name == "avg" and v.kind != "float":
            n, d = V.as_pair(Value(only, v.kind, type=v.type))
            return Value(None, "exact", pair=(joined(n, inside and inside.pair[0]).cast(V.WIDE), joined(d, inside and inside.pair[1]).cast(V.WIDE)))
        one = only.cast("double") if name == "avg" else F.when(only.isNotNull(), F.lit(0.0 if name.endswith("pop") else None).cast("double"))
        return Value(joined(one, inside and inside.col), "float", type=T.DoubleType())

    def applied(self, name: str, v: Value, x: Column, over) -> Value:
        match name:
            case "count":
                return Value(over(F.count(x)), "int", True, type=T.LongType())
            case "min" | "max":
                return v.but(col=over(getattr(F, name)(x)), nonnull=False, literal=None)
        if v.kind not in V.NUMBERS:
            raise QueryError(f"aggregate {name}(...) needs numbers", v.kind)
        if name == "sum":
            t = T.LongType() if isinstance(v.type, T.IntegralType) else T.DoubleType() if v.kind == "float" else T.DecimalType(38, v.type.scale)
            return Value(over(F.sum(x)).cast(t), v.kind, type=t)
        if name == "avg" and v.kind != "float":
            t = V.WIDE if v.kind == "int" else T.DecimalType(38, v.type.scale)
            n, d = V.as_pair(Value(over(F.sum(x.cast(t))).cast(t), v.kind, type=t))
            return Value(None, "exact", pair=(n, (d * F.nullif(over(F.count(x)), F.lit(0)).cast(V.WIDE)).cast(V.WIDE)))
        return Value(over(getattr(F, name)(x.cast("double"))), "float", type=T.DoubleType())

    def rate(self, d: Value, e: ast.Over, rows) -> Value:
        if not self.time_field:
            raise QueryError("rate(...) has no time column: give one by LAST, or as time_field")
        at = micros(self.field(self.time_field))
        low, high = self.bounds(e.frame)
        if low > high or high == _WHOLE[0] or low == _WHOLE[1]:  # a row at most, in no time
            return per_time(F.lit(0).cast("long"), F.lit(None).cast("long"), d)
        # Where the frame is clamped to one row no time passes: null, as over the empty frame.
        w = rows.rowsBetween(low, high)
        return per_time(F.count(at).over(w), F.max(at).over(w) - F.min(at).over(w), d)


def has_window(e) -> bool:
    return isinstance(e, ast.Over) or any(map(has_window, ast.children(e)))
