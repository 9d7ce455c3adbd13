"""Queries as DataFrames: filters, projections, groups, nested lists, set operations and WITH.

A query is lowered as a whole; Catalyst plans it.  A nested select becomes one list aggregate by its
correlation and a left join, never a query for each outer row: where it is tied to its parent by
equalities alone, the inner columns are the keys; otherwise the parent's distinct values are joined to
the inner rows on the predicate first.  All steps of the inner query then run by key.

Source order is kept where it shows (ties of sorted limits, first rows of groups, DISTINCT, lists) by a row
number that is added after the filter, so the filter still reaches the scan.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import QueryError
from ..functions import values as V
from ..functions.expressions import NULL_COMPARED, Options, Scope
from ..functions.values import Value
from ..plans import ast
from ..plans.typecheck import nullable
from ..sources.catalog import Catalog
from ..sources.shared import materialized
from .aggregate import ROW, GroupScope, grouped, has_aggregate
from .order import key
from .setops import combine
from .window import WindowScope, has_window

POSITION = "__pos"
MAX_ITERATIONS = 10_000
#: Rounds after which what is found so far is written as one table, so that no plan reads more tables than that.
FOLD = 16


def conjuncts(p) -> list:
    return conjuncts(p.left) + conjuncts(p.right) if isinstance(p, ast.And) else [p]


def conjoined(ps: list):
    out = None
    for p in ps:
        out = p if out is None else ast.And(out, p)
    return out


def fields(e) -> set:
    """The paths of all fields in an expression or predicate."""
    own = {e.path} if isinstance(e, ast.Field) else set()
    return own.union(*map(fields, ast.children(e)))


def is_aggregate(q: ast.Query) -> bool:
    if q.group_by:
        return True
    exprs = [i.expr for i in q.select if isinstance(i, ast.Item)]
    return any(map(has_aggregate, [*exprs, *q.havings]))


class Lowering:
    def __init__(self, catalog: Catalog, options: Options, withs: dict | None = None, time_field=None, types: dict | None = None):
        self.catalog, self.options, self.withs, self.types = catalog, options, withs or {}, types or {}
        self.time_field = tuple(time_field) if time_field else None
        self.bound: dict[str, DataFrame] = {}
        self.running: list[str] = []
        self.serial = count()

    # -- documents
    def run(self, node) -> DataFrame:
        if isinstance(node, ast.Combined):
            return combine(node.op, self.run(node.left), self.run(node.right))
        df, names = self.select(node, *self.source(node))
        return df.select(*[F.col(f"`{n}`") for n in names])

    def source(self, q: ast.Query) -> tuple[DataFrame, frozenset]:
        if q.variant is not None:
            raise QueryError("unresolved_variant", q.variant)
        if len(q.source) == 1 and q.source[0] in self.withs:
            return self.binding(q.source[0]), frozenset()
        if q.goal_args is not None:
            empty = Scope(T.StructType([]), self.options)
            return self.catalog.call(q.source, [self.python(a, empty) for a in q.goal_args]), frozenset()
        df = self.catalog.table(q.source)
        return df, self.catalog.nonnull(q.source, df) | self.declared(q, df)

    def declared(self, q: ast.Query, df: DataFrame) -> frozenset:
        """Columns that a TYPE declaration says hold no nulls."""
        t = self.types.get(q.source[0]) if len(q.source) == 1 else None
        return frozenset(n for n, e in t.fields.items() if n in df.columns and not nullable(e)) if t else frozenset()

    def python(self, e, scope: Scope):
        """A goal argument as a Python value: a literal, a parameter, or a name."""
        if isinstance(e, ast.Param):
            e = scope.param(e.name)
        if isinstance(e, ast.Lit):
            return e.value
        if isinstance(e, ast.Field):
            return ".".join(e.path)
        raise QueryError("unsupported", "this goal argument")

    def binding(self, name: str) -> DataFrame:
        if name not in self.bound:
            if name in self.running:
                raise QueryError("with_cycle", [*self.running, name])
            self.running.append(name)
            value = self.withs[name]
            self.bound[name] = self.recursive(name, value.query) if isinstance(value, ast.Recursive) else self.run(value)
            self.running.pop()
        return self.bound[name]

    def recursive(self, name: str, q) -> DataFrame:
        """Rounds over the last round's new rows until there are none; each is written, so plans stay short."""
        if not isinstance(q, ast.Combined) or q.op not in ("union", "union_all"):
            raise QueryError("recursive_with_requires_union", name)
        distinct = q.op == "union"
        base = self.run(q.left)
        current, _ = materialized(base.distinct() if distinct else base, "round")
        everything = current
        for n in range(1, MAX_ITERATIONS + 1):
            if current.isEmpty():
                return everything
            step = Lowering(self.catalog, self.options, self.withs, self.time_field, self.types)
            step.bound = self.bound | {name: current}
            new = step.run(q.right)
            if set(new.columns) != set(everything.columns):
                raise QueryError("mismatched_columns", everything.columns, new.columns)
            new = new.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in everything.schema])
            if distinct:
                new = new.subtract(everything)  # which makes it distinct
            current, _ = materialized(new, "round")
            everything = everything.union(current)
            if n % FOLD == 0:
                everything, _ = materialized(everything, "rounds")
        raise QueryError("recursive_with_iteration_limit", name, MAX_ITERATIONS)

    # -- one select
    def select(self, q: ast.Query, df: DataFrame, nonnull=frozenset(), keys=(), outer=None, listed=False) -> tuple[DataFrame, list[str]]:
        """Lower one select over its source's rows.  ``keys`` are columns that the result carries and every step
        runs by; with ``listed`` the result has each row's position in ``POSITION``."""
        df, rest = self.memberships(q, df, nonnull)
        scope = Scope(df.schema, self.options, nonnull, outer, q.name)
        if rest is not None:
            df = df.where(scope.predicate(rest))
        items = self.body(q)
        nested = [i for i in items if isinstance(i, ast.Query)]
        plain = [i for i in items if isinstance(i, ast.Item)]
        return (self.grouped if is_aggregate(q) else self.flat)(q, df, scope, list(keys), plain, nested, listed)

    def body(self, q: ast.Query) -> list:
        """The items that show, a name's last use only."""
        last: dict = {}
        for i in q.select:
            if isinstance(i, ast.Item):
                if i.when_param is not None:
                    if is_aggregate(q):
                        raise QueryError("unsupported_grouped_body_item", i.alias)
                    p = Scope(T.StructType([]), self.options).param(i.when_param)
                    if p.kind == "nil" or p.value is False:
                        continue
                last.pop(i.alias, None)
                last[i.alias] = i
            elif isinstance(i, ast.Query):
                last.pop(i.name, None)
                last[i.name] = i
            else:
                raise QueryError("unsupported_body_item", i)
        if not last:
            raise QueryError("empty_body")
        return list(last.values())

    def memberships(self, q: ast.Query, df: DataFrame, nonnull):
        """``x in name.field`` over a WITH binding becomes a semi join, under NOT an anti join."""
        rest = []
        for p in [c for w in q.wheres for c in conjuncts(w)]:
            inner = p.arg if isinstance(p, ast.Not) else p
            match inner:
                case ast.Cmp("in", left, ast.Field((name, sub))) if name in self.withs and name not in df.columns:
                    x = Scope(df.schema, self.options, nonnull, None, q.name).value(left)
                    values = self.binding(name).select(F.col(f"`{sub}`").alias("__in")).distinct()
                    df = df.join(values, x.col.eqNullSafe(F.col("__in")), "left_anti" if inner is not p else "left_semi")
                case _:
                    rest.append(p)
        return df, conjoined(rest)

    def flat(self, q, df, scope, keys, plain, nested, listed):
        if q.havings:
            raise QueryError("having_without_aggregate", "HAVING needs GROUP BY or an aggregate")
        for i in plain:
            if i.where is not None:
                raise QueryError("body_item_where_requires_aggregate", i.alias)
        windows = any(has_window(i.expr) for i in plain)
        row = listed or windows or bool(q.order_by) or self.options.ordered or (q.distinct and (q.limit is not None or q.offset is not None))
        if row:
            df = self.numbered(df)
        if windows:
            scope = WindowScope(scope, keys, q.time_field or self.time_field)
        names = [i.alias for i in plain]
        cols = [F.col(f"`{k}`") for k in keys] + [V.output(scope.value(i.expr), self.options.exact).alias(i.alias) for i in plain]
        sorts = []
        for n, o in enumerate(q.order_by):
            v = scope.value(o.expr)
            cols.append(V.output(v).alias(f"__s{n}"))
            sorts.append((v.but(col=F.col(f"__s{n}"), kind="float" if v.kind == "exact" else v.kind, pair=None), o.desc))
        links = self.links(q, nested)
        cols += [self.link(scope.field((f,)), scope, f).alias(f"__c_{f}") for f in links]
        if row:
            cols.append(F.col(ROW))
        if windows:
            df = scope.ready(df)
        return self.finish(q, df.select(*cols), names, keys, sorts, nested, row, listed)

    def grouped(self, q, df, scope, keys, plain, nested, listed):
        windows = [i for i in plain if has_window(i.expr)]
        if windows and q.grouping != "plain":
            raise QueryError("unsupported", "a window over groups of ROLLUP/CUBE")
        for i in windows:
            if i.where is not None or has_aggregate(i.expr):
                raise QueryError("unsupported", f"{i.alias}: a window over a group's rows; name the aggregate first")
        g = GroupScope(scope, q.group_by if q.grouping == "plain" else (), q.time_field or self.time_field)
        g.plain = q.grouping == "plain"
        group_cols, blanked = [], {}
        for n, path in enumerate(q.group_by):
            v = scope.field(path)
            group_cols.append((f"__g{n}", V.output(v)))
            blanked[path] = f"__g{n}"
        first = bool(windows) or listed or q.distinct or bool(q.order_by) or self.options.ordered
        aggs, names = [], []
        for i in plain:
            if i in windows:
                continue
            names.append(i.alias)
            if i.plain and i.expr.path in blanked:
                continue
            expr = i.expr if i.where is None else ast.Scoped(i.where, i.expr)
            aggs.append(V.output(g.value(expr), self.options.exact).alias(i.alias))
        for n, h in enumerate(q.havings):
            aggs.append(g.predicate(self.having(h, plain)).alias(f"__h{n}"))
        links = self.links(q, nested)
        for f in links:
            if (f,) not in blanked:
                aggs.append(self.link(g.field((f,)), scope, f).alias(f"__c_{f}"))
        if g.needs_row or first:
            df = self.numbered(df)
        if first or not aggs:
            aggs.append(F.min(ROW).alias(ROW) if first else F.count(F.lit(1)).alias("__n"))
        df = grouped(df, keys, group_cols, q.grouping, aggs, g)
        for n in range(len(q.havings)):
            df = df.where(F.col(f"__h{n}"))
        made = {i.alias: F.col(blanked[i.expr.path]) if i.plain and i.expr.path in blanked else F.col(f"`{i.alias}`") for i in plain if i not in windows}
        cols = [F.col(f"`{k}`") for k in keys] + [made[n].alias(n) for n in names]
        cols += [F.col(blanked[(f,)] if (f,) in blanked else f"__c_{f}").alias(f"__c_{f}") for f in links]
        df = df.select(*cols, *([F.col(ROW)] if first else []))
        if windows:
            w = WindowScope(Scope(df.schema, self.options), keys, None)
            made = [V.output(w.value(i.expr), self.options.exact).alias(i.alias) for i in windows]
            df = w.ready(df).select(*df.columns, *made)
            names = [i.alias for i in plain]
        out = Scope(df.schema, self.options)
        sorts = [(out.value(o.expr), o.desc) for o in q.order_by]
        return self.finish(q, df, names, keys, sorts, nested, first, listed)

    @staticmethod
    def numbered(df: DataFrame) -> DataFrame:
        """df with its rows' places in source order, which a join with the parents has kept."""
        return df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())

    def having(self, p, items):
        """Names of computed items stand for their expressions, once, and not inside calls."""
        table = {i.alias: i for i in items if not i.plain}

        def swap(e):
            if isinstance(e, ast.Call | ast.Over):
                return e
            if isinstance(e, ast.Field) and len(e.path) == 1 and e.path[0] in table:
                i = table[e.path[0]]
                return i.expr if i.where is None else ast.Scoped(i.where, i.expr)
            return ast.rebuilt(e, swap)

        return swap(p)

    # -- nested selects
    def links(self, q: ast.Query, nested: list[ast.Query]) -> list[str]:
        """The fields of q that its nested selects' predicates name."""
        found = {p[1] for n in nested for w in n.wheres for p in fields(w) if len(p) == 2 and p[0] == q.name}
        return sorted(found)

    def link(self, v: Value, scope: Scope, name: str):
        if v.nonnull or not self.options.strict:
            return V.output(v)
        col = V.output(v)
        return F.when(col.isNull(), F.raise_error(F.lit(NULL_COMPARED)).cast(v.type)).otherwise(col)

    def attach(self, q: ast.Query, df: DataFrame, n: ast.Query) -> DataFrame:
        """df with the list column of one nested select."""
        inner, nonnull = self.source(n)
        preds = [c for w in n.wheres for c in conjuncts(w)]
        tied = [p for p in preds if any(f[0] == q.name and len(f) == 2 for f in fields(p))]
        free = [p for p in preds if p not in tied]
        serial = next(self.serial)
        if not tied:
            rows, names = self.select(n, inner, nonnull, listed=True)
            return df.crossJoin(self.collected(rows, names, [], n.name))
        pairs = [self.equality(p, q.name) for p in tied]
        keys = [f"__k{serial}_{i}" for i in range(len(pairs))]
        if all(pairs):
            scope = Scope(inner.schema, self.options, nonnull, None, n.name)
            tie = [self.link(scope.field(mine), scope, mine[0]).alias(k) for k, (mine, _) in zip(keys, pairs)]
            inner = inner.select("*", *tie)
            n2 = n.but(wheres=tuple(free))
            rows, names = self.select(n2, inner, nonnull, keys, listed=True)
            links = [(f"__c_{theirs}", k) for k, (_, theirs) in zip(keys, pairs)]
        else:
            used = sorted({f[1] for p in tied for f in fields(p) if f[0] == q.name and len(f) == 2})
            keys = [f"__k{serial}_{f}" for f in used]
            parents = df.select(*[F.col(f"__c_{f}").alias(k) for f, k in zip(used, keys)]).distinct()
            outer = {(q.name, f): Value(F.col(k), V.kind_of(parents.schema[k].dataType), not self.options.strict, type=parents.schema[k].dataType) for f, k in zip(used, keys)}
            scope = Scope(inner.schema, self.options, nonnull, outer, n.name)
            if free:
                inner = inner.where(scope.predicate(conjoined(free)))
            inner = self.numbered(inner).join(parents, scope.predicate(conjoined(tied)))
            rows, names = self.select(n.but(wheres=()), inner, nonnull, keys, outer, listed=True)
            links = [(f"__c_{f}", k) for f, k in zip(used, keys)]
        lists = self.collected(rows, names, keys, n.name)
        on = None
        for mine, theirs in links:
            same = F.col(mine) == F.col(theirs) if all(pairs) else F.col(mine).eqNullSafe(F.col(theirs))
            on = same if on is None else on & same
        out = df.join(lists, on, "left").drop(*keys)
        kind = lists.schema[n.name].dataType
        if is_aggregate(n) and not n.group_by:
            # An aggregate without groups has a row also where nothing matches.
            none = n.but(wheres=(), select=tuple(i for i in n.select if not isinstance(i, ast.Query)))
            lone, names = self.select(none, self.source(n)[0].where(F.lit(False)), nonnull, listed=True)
            if names == lists.schema[n.name].dataType.elementType.names:
                lone = self.collected(lone, names, [], "__none")
                out = out.crossJoin(F.broadcast(lone)).withColumn(n.name, F.coalesce(F.col(f"`{n.name}`"), F.col("__none").cast(kind))).drop("__none")
        return out.withColumn(n.name, F.coalesce(F.col(f"`{n.name}`"), F.array().cast(kind)))

    def equality(self, p, parent: str):
        match p:
            case ast.Cmp("=", ast.Field(a), ast.Field(b)) if len(b) == 2 and b[0] == parent and not (len(a) == 2 and a[0] == parent):
                return a, b[1]
            case ast.Cmp("=", ast.Field(b), ast.Field(a)) if len(b) == 2 and b[0] == parent and not (len(a) == 2 and a[0] == parent):
                return a, b[1]
        return None

    def collected(self, rows: DataFrame, names: list[str], keys: list[str], name: str) -> DataFrame:
        pair = F.struct(F.col(POSITION), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
        ordered = F.array_sort(F.collect_list(pair), lambda a, b: F.when(a[POSITION] < b[POSITION], -1).when(a[POSITION] > b[POSITION], 1).otherwise(0))
        agg = F.transform(ordered, lambda x: x["row"]).alias(name)
        return rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(agg) if keys else rows.agg(agg)

    # -- what comes after the projection
    def finish(self, q, df, names, keys, sorts, nested, row, listed):
        order = [key(v, d) for v, d in sorts]
        ties = [F.col(ROW)] if row else []
        limited = q.limit is not None or q.offset is not None
        names = list(names)

        def top(df, by):
            df = df.orderBy(*by) if by else df
            df = df.offset(q.offset) if q.offset else df
            return df.limit(q.limit) if q.limit is not None else df

        early = bool(nested) and limited and not keys and not q.distinct and not any(n.required for n in nested)
        if early:  # lists are only made for the rows that stay
            df, _ = top(df, [*order, *ties]), None
        for n in nested:
            df = self.attach(q, df, n)
            names.append(n.name)
            if n.required:
                df = df.where(F.size(f"`{n.name}`") > 0)
        own = [F.col(f"`{c}`") for c in (*keys, *names)]
        if q.distinct:
            if row:
                first = Window.partitionBy(*own).orderBy(*order, *ties)
                df = df.withColumn("__d", F.row_number().over(first)).where("__d = 1").drop("__d")
            else:
                df = df.select(*own).distinct()
        if listed:
            by = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]) if keys else Window.partitionBy(F.lit(0))
            if order or limited:
                df = df.withColumn(POSITION, F.row_number().over(by.orderBy(*order, *ties)))
            else:
                df = df.withColumn(POSITION, F.col(ROW))
            if limited:
                low = q.offset or 0
                df = df.where(F.col(POSITION) > low)
                df = df.where(F.col(POSITION) <= low + q.limit) if q.limit is not None else df
        elif early:
            df = df.orderBy(*order, *ties) if order or self.options.ordered else df
        elif order or limited or self.options.ordered:
            df = top(df, [*order, *ties] if order or self.options.ordered or (row and q.distinct) else [])
        return df.select(*own, *([F.col(POSITION)] if listed else [])), names
