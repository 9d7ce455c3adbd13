"""UNION, UNION ALL, INTERSECT and EXCEPT, by column name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import QueryError


def combine(op: str, left: DataFrame, right: DataFrame) -> DataFrame:
    if set(left.columns) != set(right.columns):
        raise QueryError("mismatched_columns", sorted(left.columns), sorted(right.columns))
    right = right.select(*[f"`{c}`" for c in left.columns])
    match op:
        case "union_all":
            return left.union(right)
        case "union":
            return left.union(right).distinct()
        case "intersect":
            return left.intersect(right)
        case "except":
            return left.subtract(right)
    raise QueryError("unsupported", op)
