"""What the training-data operators share: words, table access and shared storage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, exists, hadoop_path, materialized, shared_dir, shared_path

__all__ = ["WORD", "discard", "exists", "hadoop_path", "materialized", "Numbers", "identity", "per_worker", "releasing", "shared_dir", "shared_path", "spread_join", "table", "text_of", "to_python", "word_count"]

#: A word: a run of anything but space, tab, newline, vertical tab, form feed and return.
#: ``bytes.split()`` splits on exactly these six, which the Python parts rely on.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identity(text: Column) -> Column:
    """128 bits that tell texts apart, null as empty: at 10^11 texts the chance that any two meet is below 10^-16."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def word_count(text: Column) -> Column:
    """Number of words (long); null text has none.

    Every word is replaced by one character and the rest by nothing, so no array of words is built.
    """
    shrunk = F.regexp_replace(F.regexp_replace(text, WORD, "x"), r"[\x20\x09-\x0D]+", "")
    return F.coalesce(F.length(shrunk), F.lit(0)).cast("long")


#: The most keys that ``spread_join`` sends to all executors.
HOT_KEYS = 4096


def spread_join(rows: DataFrame, sides: DataFrame, on: str, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``sides``, which has one row a ``key`` and in ``weight`` how many of the ``total`` rows have it.

    Keys of more than 1 / ``HOT_KEYS`` of all rows are fewer than ``HOT_KEYS``, so their sides go to all executors and
    their rows stay where they are; the others are joined by hash, and none is more than that part of the rows.
    ``key`` and ``weight`` are dropped.  Rows without a side are left out.
    """
    hot = F.col(weight) * F.lit(HOT_KEYS) > F.lit(total)
    few = sides.where(hot).drop(weight)
    same = F.col(on) == F.col(key)
    here = rows.join(F.broadcast(few), same).drop(key)
    rest = rows.join(F.broadcast(few.select(key)), same, "left_anti").join(sides.where(~hot).drop(weight), same).drop(key)
    return here.unionByName(rest)


#: Bytes of a batch of rows on its way to Python.
BATCH_BYTES = 8 << 20


def to_python(df: DataFrame) -> DataFrame:
    """``df``, with the session's batches to Python bounded in bytes: texts may be long, and a batch stands
    several times in a task's memory.  A smaller bound that is set already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    now = conf.get(name).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def releasing(run: Callable) -> Callable:
    """``run`` over a task's batches, after which freed memory goes back to the system: workers outlive their tasks, and
    what one keeps without need the others on its machine lack."""

    def whole(batches):
        import ctypes

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return whole


def per_worker(key: tuple, make: Callable[[], object]):
    """What a Python worker keeps from task to task, such as a loaded model.  Functions travel by value, so
    their own globals would be made anew for every task.  Only the last thing asked for is kept: workers
    outlive stages, and their memory is not to grow with the number of operators."""
    kept = sys.modules.setdefault("_lanternql_kept", types.ModuleType("_lanternql_kept")).__dict__
    if kept.get("key") != key:
        kept.pop("value", None)
        kept["key"], kept["value"] = key, make()
    return kept["value"]


def text_of(column: pa.Array) -> pa.Array:
    """A column of UTF-8 bytes or text as text; null is empty, bytes that aren't UTF-8 are replaced."""
    if not pa.types.is_string(column.type):
        try:
            column = column.cast(pa.string())
        except pa.ArrowInvalid:
            column = pa.array([None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()], pa.string())
    return column.fill_null("")


class Numbers:
    """Numbers strings as they are met, so that what is worked out for each can stand in arrays.

    Strings are told apart by Arrow, batch by batch.  What is kept of them is bounded by their number and bytes: beyond
    that all are forgotten, which costs time and changes no result.
    """

    def __init__(self, limit: int, size: int):
        self.limit, self.size = limit, size
        self.known = pa.array([], pa.string())

    def __call__(self, strings: pa.Array) -> tuple[np.ndarray, pa.Array, bool]:
        """The number of each string, the strings that are new (numbered in their order), and whether the earlier
        ones are forgotten."""
        anew = len(self.known) > self.limit or self.known.nbytes > self.size
        if anew:
            self.known = self.known[:0]
        distinct = strings.dictionary_encode()
        place = pc.index_in(distinct.dictionary, value_set=self.known)
        at = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
        missing = place.is_null()
        new = distinct.dictionary.filter(missing)
        if len(new):
            at[missing.to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(self.known) + len(new))
            self.known = pa.concat_arrays([self.known, new])
        return at[distinct.indices.to_numpy(zero_copy_only=False)], new, anew
