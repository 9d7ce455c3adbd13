"""Rows of a result, pulled one at a time: partitions are fetched as they are needed."""

from __future__ import annotations

import re

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row

from ..errors import QueryError


def plain(x):
    """A row as a dictionary, nested rows too."""
    if isinstance(x, Row):
        return {k: plain(v) for k, v in x.asDict(recursive=False).items()}
    return [plain(v) for v in x] if isinstance(x, list) else x


def reason(e: Exception) -> str:
    """What was raised on an executor, by a query's own checks or by Spark, or the first line."""
    m = re.search(r"\[USER_RAISED_EXCEPTION\] (.*?) SQLSTATE", str(e)) or re.search(r"(\[[A-Z_]+(?:\.[A-Z_]+)*\] .*?)(?: SQLSTATE|\n|$)", str(e))
    return m[1] if m else str(e).split("\n")[0]


class Cursor:
    """An iterator of dictionaries; ``close`` stops it, and a closed or drained one stays done."""

    def __init__(self, df: DataFrame):
        self.df, self._rows, self._done = df, None, False

    def __iter__(self):
        return self

    def __next__(self) -> dict:
        if self._done:
            raise StopIteration
        try:
            if self._rows is None:
                self._rows = self.df.toLocalIterator()
            return plain(next(self._rows))
        except StopIteration:
            self.close()
            raise
        except (PySparkException, Py4JError) as e:
            self.close()
            raise QueryError("execution", reason(e)) from e

    def take(self, n: int) -> list[dict]:
        out = []
        while len(out) < n and (row := next(self, None)) is not None:
            out.append(row)
        return out

    def skip(self, n: int) -> Cursor:
        self.take(n)
        return self

    def to_list(self) -> list[dict]:
        return list(self)

    def close(self) -> None:
        self._done, self._rows = True, None
