"""Sources of queries: names to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..errors import QueryError


class Catalog:
    """Dotted names and what they stand for.

    ``not_null`` declares columns that hold no nulls (``"*"``: all of them); comparisons on those need no test
    and are pushed to the scan.  Call-shaped sources (``SELECT f(1) { ... }``) are functions to a DataFrame.
    """

    def __init__(self, spark: SparkSession, fall_back_to_tables: bool = False):
        self.spark = spark
        self.tables: dict[tuple[str, ...], DataFrame | Callable[[], DataFrame]] = {}
        self.known: dict[tuple[str, ...], frozenset[str]] = {}
        self.calls: dict[str, Callable[..., DataFrame]] = {}
        self.fall_back = fall_back_to_tables

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame], not_null: Iterable[str] | str = ()) -> Catalog:
        path = tuple(name.split("."))
        self.tables[path] = df
        self.known[path] = frozenset([not_null] if isinstance(not_null, str) else not_null)
        return self

    def register_rows(self, name: str, rows: list, schema) -> Catalog:
        return self.register(name, self.spark.createDataFrame(rows, schema))

    def register_parquet(self, name: str, path: str, not_null: Iterable[str] | str = ()) -> Catalog:
        """The files are looked at when a query first reads them."""
        return self.register(name, lambda: self.spark.read.parquet(path), not_null)

    def register_call(self, name: str, f: Callable[..., DataFrame]) -> Catalog:
        self.calls[name] = f
        return self

    def table(self, path: tuple[str, ...]) -> DataFrame:
        found = self.tables.get(path)
        if found is None and self.fall_back and self.spark.catalog.tableExists(".".join(path)):
            return self.spark.table(".".join(path))
        if found is None:
            raise QueryError("no_such_source", list(path))
        if not isinstance(found, DataFrame):
            found = self.tables[path] = found()
        return found

    def nonnull(self, path: tuple[str, ...], df: DataFrame) -> frozenset[str]:
        known = self.known.get(path, frozenset())
        return frozenset(df.columns) if "*" in known else known

    def call(self, path: tuple[str, ...], args: list) -> DataFrame:
        f = self.calls.get(".".join(path))
        if f is None:
            raise QueryError("unsupported", f"call-shaped source {'.'.join(path)}")
        return f(*args)

    def describe(self, name: str):
        """The schema of a source."""
        return self.table(tuple(name.split("."))).schema

    def capabilities(self) -> frozenset[str]:
        return frozenset({"where", "group_by", "rollup", "cube", "having", "window", "order_by", "distinct", "limit", "nested", "set_operations", "with", "recursive", "json"})
