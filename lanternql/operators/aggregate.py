"""Aggregates: a group's values from hash aggregation, any expression over them included."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import QueryError
from ..functions import values as V
from ..functions.expressions import AGGREGATES, NOTHING, Scope
from ..functions.values import Value
from ..plans import ast

ROW = "__row"


def has_aggregate(e) -> bool:
    """Does the expression call an aggregate, not counting those of windows?"""
    match e:
        case ast.Over():
            return False
        case ast.Call(name, _, _) if name in AGGREGATES:
            return True
    return any(map(has_aggregate, ast.children(e)))


class GroupScope(Scope):
    """Names in a grouped query: group keys as they are, other columns by the group's first row, and
    aggregate calls over the group's rows.

    ``keys`` are the columns that are the same in all rows of a group, ``prepared`` collects columns that must stand in the frame before it is grouped.
    """

    def __init__(self, rows: Scope, keys: tuple, time_field=None, group_nonnull=NOTHING):
        super().__init__(rows.schema, rows.options, rows.nonnull, rows.outer, rows.source)
        self.rows, self.keys, self.time_field = rows, set(keys), time_field
        self.prepared: dict[str, Column] = {}
        #: (prepared column, share, name of the column with its value of that rank)
        self.ranks: list[tuple[str, Fraction, str]] = []
        self.plain = True
        self.needs_row = False
        self.filter = None

    def field(self, path, facts=NOTHING) -> Value:
        v = self.rows.field(path, facts)
        if path[:2] in self.outer:
            return v
        if path in self.keys:  # the same in every row of the group
            return v.but(col=F.first(v.col))
        # Under ROLLUP and CUBE also a key has its first row's value here, where the bare item is blank.
        self.needs_row = True
        return v.but(col=F.min_by(v.col, F.col(ROW)))

    def value(self, e, facts=NOTHING) -> Value:
        if isinstance(e, ast.Scoped):
            before, self.filter = self.filter, e.where
            try:
                return self.value(e.expr, facts)
            finally:
                self.filter = before
        return super().value(e, facts)

    def call(self, e: ast.Call, facts) -> Value:
        return self.aggregate(e) if e.name in AGGREGATES else super().call(e, facts)

    def checked(self, e: ast.Call):
        arity = 2 if e.name == "percentile" else 1
        if len(e.args) != arity:
            raise QueryError(f"wrong number of arguments for {e.name}/{arity}: {len(e.args)}")
        if e.distinct and e.name != "count":
            raise QueryError("count alone takes DISTINCT")
        if any(map(has_aggregate, e.args)):
            raise QueryError(f"{e.name}(...) of an aggregate")

    def strict(self, name: str, col: Column, v: Value, t) -> Column:
        """The argument; a null among the rows that count is an error."""
        if not v.nonnull and self.options.strict:
            col = F.when(col.isNull(), F.raise_error(F.lit(f"aggregate {name}(...) encountered a nil value")).cast(t)).otherwise(col)
        if self.filter is not None:
            col = F.when(self.rows.predicate(self.filter), col)
        return col

    def aggregate(self, e: ast.Call) -> Value:
        self.checked(e)
        v = self.rows.value(e.args[0])
        if e.name == "rate":
            return self.rate(v)
        if v.kind == "exact":
            v = Value(V.as_double(v), "float", v.nonnull, type=T.DoubleType())
        if v.kind == "json":
            v = Value(V.json_get(v, "string"), "string", type=T.StringType())
        x = self.strict(e.name, v.col, v, v.type)
        if e.name == "count":
            return Value(F.count_distinct(x) if e.distinct else F.count(x), "int", True, type=T.LongType())
        if e.name in ("min", "max"):
            return v.but(col=getattr(F, e.name)(x), nonnull=False, literal=None)
        if e.name == "percentile":
            return self.percentile(e, v, x)
        if v.kind not in V.NUMBERS:
            raise QueryError(f"aggregate {e.name}(...) needs numbers", v.kind)
        if e.name == "sum":
            if v.kind == "int" and isinstance(v.type, T.IntegralType):
                return Value(F.sum(x), "int", type=T.LongType())
            t = T.DoubleType() if v.kind == "float" else T.DecimalType(38, v.type.scale)
            return Value(F.sum(x).cast(t), v.kind, type=t)
        if e.name == "avg":
            if v.kind == "float":
                return Value(F.avg(x), "float", type=T.DoubleType())
            t = V.WIDE if v.kind == "int" else T.DecimalType(38, v.type.scale)
            total = Value(F.sum(x.cast(t)).cast(t), v.kind, type=t)
            n, d = V.as_pair(total)
            return Value(None, "exact", pair=(n, (d * F.nullif(F.count(x), F.lit(0)).cast(V.WIDE)).cast(V.WIDE)))
        return Value(getattr(F, e.name)(x.cast("double")), "float", type=T.DoubleType())

    def share(self, e: ast.Call) -> Value:
        p = self.value(e.args[1])
        if p.literal is not None and not 0 <= Fraction(p.literal) <= 1:
            raise QueryError("the share of a percentile lies between 0 and 1")
        return p

    def percentile(self, e: ast.Call, v: Value, x: Column) -> Value:
        """Nearest rank.  In plain groups it is looked up in a table of ranks; under ROLLUP and CUBE, and for shares
        that are no literal, among the group's sorted values."""
        p = self.share(e)
        if p.literal is not None and self.plain:
            name = f"__p{len(self.prepared)}"
            self.prepared[name] = x
            self.ranks.append((name, Fraction(p.literal), f"{name}_rank"))
            return v.but(col=F.first(F.col(f"{name}_rank")), nonnull=False, literal=None)
        return v.but(col=ranked(F.collect_list(x), p), nonnull=False, literal=None)

    def rate(self, d: Value) -> Value:
        if not self.time_field:
            raise QueryError("rate(...) has no time column: give one by LAST, or as time_field")
        t = self.rows.field(self.time_field)
        at = micros(t)
        at = self.strict("rate", at, t, T.LongType())
        return per_time(F.count(at), F.max(at) - F.min(at), d)


def micros(t: Value) -> Column:
    """A point in time as whole microseconds; numbers count seconds."""
    if t.kind in ("utc", "naive", "date"):
        return F.unix_micros(t.col.cast("timestamp"))
    return (t.col * 1_000_000).cast("long")


def per_time(n: Column, span: Column, d: Value) -> Value:
    """n * d / span, null for no rows and for no time."""
    span = F.when(span > 0, span).cast(V.WIDE)
    if d.kind == "float":
        return Value(n * V.as_double(d) / (span.cast("double") / 1e6), "float", type=T.DoubleType())
    dn, dd = V.as_pair(d)
    return Value(None, "exact", pair=((n.cast(V.WIDE) * dn * V.number(1_000_000).col.cast(V.WIDE)).cast(V.WIDE), (span * dd).cast(V.WIDE)))


def ranked(values: Column, p: Value) -> Column:
    """The element of nearest rank in an array of values."""
    n = F.size(values)
    if p.literal is not None:
        share = Fraction(p.literal)
        rank = F.ceil(n.cast("decimal(20,0)") * F.lit(share.numerator).cast("decimal(18,0)") / F.lit(share.denominator).cast("decimal(18,0)"))
    else:
        rank = F.ceil(n * V.as_double(p) * F.lit(1 - 2.0**-50))
    return F.get(F.sort_array(values), F.greatest(F.lit(1), F.least(rank.cast("int"), n)) - 1)


def matched(df: DataFrame, by: list[Column], table, source: DataFrame | None = None) -> DataFrame:
    """``df`` with the columns of ``table(source with the keys, key names)``, which has one row for each value of the keys
    ``by``; ``source`` is ``df`` as it was before other tables were joined to it."""
    names = [f"__by{i}" for i in range(len(by))]
    keyed = lambda x: x.withColumns(dict(zip(names, by))) if by else x
    found = table(keyed(df if source is None else source), names)
    if not by:
        return df.crossJoin(F.broadcast(found))  # one row
    found = found.withColumnsRenamed({n: f"{n}_of" for n in names})
    same = [F.col(n).eqNullSafe(F.col(f"{n}_of")) for n in names]
    return keyed(df).join(found, same, "left").drop(*names, *[f"{n}_of" for n in names])


def rank_table(rows: DataFrame, names: list[str], value: str, picks: list[tuple[Fraction, str]]) -> DataFrame:
    """The values of nearest rank by the keys ``names``.  Equal values are counted first, with partial aggregation; what
    is sorted are a key's distinct values, and sorting spills."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*names, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    upto = F.sum("__n").over(whole.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select(*names, "__v", upto.alias("__upto"))

    def rank(p: Fraction) -> Column:  # p * all, rounded up, and at least 1
        over, d = (F.sum("__n").cast(V.WIDE) * F.lit(p.numerator).cast(V.WIDE)).cast(V.WIDE), F.lit(p.denominator).cast(V.WIDE)
        up = (over + d - F.lit(1).cast(V.WIDE)).cast(V.WIDE)
        return F.greatest(F.lit(1).cast("long"), ((up - up % d) / d).cast("long"))

    ranks = counts.groupBy(*names).agg(*[rank(p).alias(f"{r}_at") for p, r in picks])
    if names:
        of = ranks.withColumnsRenamed({n: f"{n}_rank" for n in names})
        placed = placed.join(of, [F.col(n).eqNullSafe(F.col(f"{n}_rank")) for n in names])
    else:
        placed = placed.crossJoin(F.broadcast(ranks))
    return placed.groupBy(*names).agg(*[F.min(F.when(F.col("__upto") >= F.col(f"{r}_at"), F.col("__v"))).alias(r) for _, r in picks])


def grouped(df: DataFrame, keys: list[str], group_cols: list[tuple[str, Column]], grouping: str, aggs: list[Column], scope: GroupScope) -> DataFrame:
    """Group by the carried keys and the group columns; ROLLUP and CUBE keep their grand total on empty input."""
    for name, col in scope.prepared.items():
        df = df.withColumn(name, col)
    if grouping != "plain" and keys:
        raise QueryError("unsupported", f"{grouping} inside a correlated nested select")
    source = df
    for value in dict.fromkeys(v for v, _, _ in scope.ranks):
        picks = [(p, r) for v, p, r in scope.ranks if v == value]
        df = matched(df, [F.col(f"`{k}`") for k in keys] + [c for _, c in group_cols], lambda rows, names: rank_table(rows, names, value, picks), source)  # noqa: B023
    by = [F.col(f"`{k}`") for k in keys] + [c.alias(n) for n, c in group_cols]
    if grouping == "plain":
        return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    out = getattr(df, grouping)(*by).agg(*aggs)
    empty = df.agg(*aggs, F.count(F.lit(1)).alias("__n")).where("__n = 0").drop("__n")
    blank = [F.lit(None).cast(out.schema[n].dataType).alias(n) for n, _ in group_cols]
    return out.unionByName(empty.select(*blank, *empty.columns))
