import pytest

from lanternql.engine import Engine, parse
from lanternql.errors import QueryError
from tests.fixtures import catalog

T = "TYPE users { name: String, age: ?Int, meta: JSON<{ color: String, sub: { k: Int } }>, free: JSON, any: Int | String } "


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("SELECT users WHERE name = 3 { name }", "type_mismatch"),
        ("SELECT users WHERE age = 'x' { name }", "type_mismatch"),
        ("SELECT users WHERE any = true { name }", "type_mismatch"),
        ("SELECT users { meta.size }", "unknown_structured_field"),
        ("SELECT users WHERE meta.sub.z = 1 { name }", "unknown_structured_field"),
        ("SELECT users WHERE age > 3 { name }", "unguarded_null_comparison"),
        ("SELECT users WHERE age > 3 AND age not= nil { name }", "unguarded_null_comparison"),
        ("SELECT users WHERE age not= nil OR age > 3 { name }", "unguarded_null_comparison"),
        ("SELECT users WHERE age not= nil GROUP BY age HAVING age > 3 { age }", "unguarded_null_comparison"),
        ("SELECT t { x, SELECT users WHERE age > 3 { name } }", "unguarded_null_comparison"),
        ("SELECT t { x } UNION SELECT users WHERE name = 1 { x: name }", "type_mismatch"),
        ("WITH w = SELECT users WHERE name = 1 { name } SELECT w { name }", "type_mismatch"),
    ],
)
def test_rejected(text, reason):
    with pytest.raises(QueryError) as e:
        parse(T + text)
    assert e.value.reason == reason


@pytest.mark.parametrize(
    "text",
    [
        "SELECT users WHERE any = 3 OR any = 'x' { name, meta.color, meta.sub.k, free.what.ever }",
        "SELECT users WHERE age not= nil AND age > 3 { name }",
        "SELECT users WHERE NOT (age = nil) AND age > 3 { name }",
        "SELECT users WHERE age = nil OR age > 3 { name }",
        "SELECT users WHERE age = nil OR age = nil OR NOT (age < 3) { name }",
        "SELECT users WHERE age in [1, nil] { name }",
        "SELECT users WHERE age > $p { name }",
        "SELECT a.users WHERE name = 3 { name }",
    ],
)
def test_accepted(text):
    parse(T + text)


def test_kinds():
    with pytest.raises(QueryError, match="kind_category_mismatch"):
        parse("TYPE f : graph { a: Int } SELECT f(1) { a }")
    parse("TYPE f : logic { a: Int } SELECT f(1) { a }")


def test_live_schemas(spark):
    e = Engine(catalog(spark))
    with pytest.raises(QueryError, match="unguarded_null_comparison"):
        e.check("SELECT nullable_users WHERE age > 3 { name }")
    with pytest.raises(QueryError, match="type_mismatch"):
        e.check("SELECT users WHERE age = 'x' { name }")
    e.check("SELECT nullable_users WHERE age not= nil AND age > 3 { name }")
    e.check("WITH users = SELECT nullable_users { name } SELECT users WHERE name = 'x' { name }".replace("name = 'x'", "name in ['x']"))
