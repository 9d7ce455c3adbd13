"""``python -m lanternql query TEXT`` or ``--file F``, and ``python -m lanternql repl``.

``--data NAME=PATH`` registers a Parquet file or folder, ``--dir D`` every ``*.parquet`` of a folder.  ``--config``
names a JSON file of backends, ``{"default": "a", "backends": {"a": {"dir": ..., "data": {...}, "strict_nulls": true,
"exact_output": "double"}}}``, of which ``--backend`` chooses one.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from .engine import Engine, parse
from .errors import ParseError, QueryError
from .sources.catalog import Catalog


def catalog_of(spark: SparkSession, data: list[str], folder: str | None) -> Catalog:
    catalog = Catalog(spark, fall_back_to_tables=True)
    if folder:
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for s in fs.listStatus(fs_path):
            name = s.getPath().getName()
            if name.endswith(".parquet"):
                catalog.register_parquet(name.removesuffix(".parquet"), s.getPath().toString())
    for pair in data:
        name, _, path = pair.partition("=")
        catalog.register_parquet(name, path)
    return catalog


def backend(config: dict, name: str | None) -> dict:
    """The chosen backend of a configuration: the one named, the default, or the only one."""
    backends = config.get("backends", {})
    name = name or config.get("default") or (next(iter(backends)) if len(backends) == 1 else None)
    if name is None:
        raise QueryError("backend_needed", sorted(backends))
    if name not in backends:
        raise QueryError("unknown_backend", name, sorted(backends))
    return backends[name]


def show(engine: Engine, text: str, params: dict, limit: int | None, write: Callable[[str], object]) -> bool:
    try:
        rows = engine.rows(text, params)
        for row in rows if limit is None else rows.take(limit):
            write(json.dumps(row, default=str, ensure_ascii=False) + "\n")
    except QueryError as e:
        write(f"error: {e}\n")
        return False
    return True


def repl(engine: Engine, lines, write: Callable[[str], object], limit: int | None = 50) -> None:
    """Lines pile up until they parse; an empty line runs them as they are."""
    held: list[str] = []
    for line in lines:
        if line.strip() or not held:
            held.append(line)
        text = "".join(held).strip()
        if not text:
            held.clear()
            continue
        if text in ("exit", "quit"):
            return
        try:
            parse(text, engine.extensions)
        except ParseError:
            if line.strip():
                continue
        except QueryError:
            pass
        show(engine, text, {}, limit, write)
        held.clear()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lanternql", description=__doc__)
    p.add_argument("--data", action="append", default=[], metavar="NAME=PATH")
    p.add_argument("--dir")
    p.add_argument("--config")
    p.add_argument("--backend")
    p.add_argument("--lenient", action="store_true", help="nulls compare as in SQL")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query")
    q.add_argument("text", nargs="?")
    q.add_argument("--file")
    q.add_argument("--param", action="append", default=[], metavar="NAME=JSON")
    q.add_argument("--limit", type=int)
    sub.add_parser("repl")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lanternql").getOrCreate()
    chosen: dict = {}
    if a.config:
        with open(a.config) as f:
            chosen = backend(json.load(f), a.backend)
    data = [*(f"{k}={v}" for k, v in chosen.get("data", {}).items()), *a.data]
    catalog = catalog_of(spark, data, a.dir or chosen.get("dir"))
    engine = Engine(catalog, strict_nulls=chosen.get("strict_nulls", True) and not a.lenient, exact_output=chosen.get("exact_output", "double"))
    if a.command == "repl":
        repl(engine, sys.stdin, sys.stdout.write)
        return 0
    text = a.text
    if a.file:
        with open(a.file) as f:
            text = f.read()
    if not text:
        p.error("a query or --file is needed")
    params = {k: json.loads(v) for k, _, v in (x.partition("=") for x in a.param)}
    return 0 if show(engine, text, params, a.limit, sys.stdout.write) else 1
