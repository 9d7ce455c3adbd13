"""Small tables for the tests of the language."""

from datetime import datetime, timedelta
from decimal import Decimal

from lanternql.sources.catalog import Catalog

START = datetime(2026, 1, 1)
TABLES = {
    "users": ("name string, age long, status string", [("Ann", 30, "active"), ("Bob", 17, "active"), ("Cy", 65, "gone")]),
    "accounts": ("name string, tier string, score long", [("d", "b", 4), ("a", "a", 9), ("c", "b", 9), ("b", "a", 4)]),
    "customers": ("id long, name string", [(1, "Ann"), (2, "Bob"), (3, "Cy")]),
    "orders": ("id long, customer_id long, total long", [(10, 1, 50), (11, 1, 75), (12, 3, 20)]),
    "items": ("id long, order_id long, sku string", [(1, 10, "a"), (2, 10, "b"), (3, 12, "a")]),
    "prices": ("price decimal(10,2), quantity long", [(Decimal("3"), 2), (Decimal("1.5"), 3)]),
    "team_a": ("name string", [("x",), ("x",), ("y",)]),
    "team_b": ("name string", [("y",), ("z",)]),
    "tickets": ("id long, metadata string", [(1, '{"color":"red","tags":["a","b"],"n":{"k":3}}'), (2, '{"color":"blue","tags":["c"]}')]),
    "cards": ("id long, metadata struct<tags:array<string>>", [(1, (["a", "b"],)), (2, ([],)), (3, (["b"],))]),
    "measurements": ("id long, v long", list(enumerate([2, 4, 4, 4, 5, 5, 7, 9]))),
    "employees": ("name string, department string, salary long", [("Al", "x", 100), ("Bob", "x", 120), ("Carol", "x", 120), ("Dan", "y", 90), ("Eve", "y", 110)]),
    "sales": ("region string, quarter string, amount long", [("e", "q1", 100), ("e", "q2", 150), ("w", "q1", 200), ("w", "q2", 50)]),
    "articles": ("id long, tags array<string>", [(1, ["a"]), (2, ["a", "b"]), (3, ["z"])]),
    "org_chart": ("id long, name string, manager_id long", [(1, "CEO", None), (2, "A", 1), (3, "B", 1), (4, "C", 2), (5, "D", 2), (6, "E", 3), (7, "F", 4)]),
    "edges": ("id long, manager_id long", [(1, 2), (2, 1)]),
    "nullable_users": ("name string, age long", [("Ann", 30), ("Bob", None), ("Cy", 65)]),
    "requests": ("service string, status long, errors long", [("a", 200, 1), ("a", 500, 2), ("b", 200, 3), ("a", 503, 4), ("b", 500, 5)]),
    "rate_events": ("service string, at timestamp", [("a", START + timedelta(seconds=40 * i)) for i in range(4)] + [("b", START + timedelta(seconds=30 * i)) for i in range(3)]),
    "moments": ("id long, at timestamp_ntz, day date", [(1, START, START.date()), (2, START + timedelta(days=40), (START + timedelta(days=40)).date())]),
    "flags": ("id long, f boolean, n long, s string", [(1, True, 2, "b"), (2, None, None, None), (3, False, 1, "a")]),
}


def catalog(spark) -> Catalog:
    c = Catalog(spark)
    for name, (schema, rows) in TABLES.items():
        c.register(name, spark.createDataFrame(rows, schema).coalesce(1))
    c.register("empty", spark.createDataFrame([], "a string, b string, v long"))
    return c
