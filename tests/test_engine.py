from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lanternql.engine import Engine
from lanternql.errors import QueryError
from lanternql.plans import ast
from lanternql.plans.parser import Extensions
from tests.fixtures import catalog


@pytest.fixture(scope="module")
def run(spark):
    c = catalog(spark)

    def f(text, params=None, time_field=None, **options):
        return Engine(c, **options).rows(text, params, time_field).to_list()

    return f


def col(rows, name):
    return [r[name] for r in rows]


def test_filters(run):
    assert col(run("SELECT users WHERE age > 18 { name }"), "name") == ["Ann", "Cy"]
    assert col(run("SELECT users WHERE age > $a AND status = 'active' { name }", {"a": 20}), "name") == ["Ann"]
    assert col(run("SELECT users WHERE name ~ @r/^A|b$/ { name }"), "name") == ["Ann", "Bob"]
    assert col(run("SELECT users WHERE status = :active { name }"), "name") == []
    assert col(run("SELECT users WHERE NOT (age in [17, $x]) { name }", {"x": 30}), "name") == ["Cy"]
    assert col(run("SELECT users WHERE users.age = 17 { name }"), "name") == ["Bob"]
    with pytest.raises(QueryError, match="missing external parameter"):
        run("SELECT users WHERE age > $nope { name }")
    with pytest.raises(QueryError, match="no_such_source"):
        run("SELECT nowhere { x }")
    with pytest.raises(QueryError, match="no_such_column"):
        run("SELECT users { x }")


def test_nulls(run):
    with pytest.raises(QueryError, match="nil value"):
        run("SELECT nullable_users WHERE age > 3 { name }")
    assert col(run("SELECT nullable_users WHERE age > 3 { name }", strict_nulls=False), "name") == ["Ann", "Cy"]
    assert col(run("SELECT nullable_users WHERE age = nil { name }"), "name") == ["Bob"]
    assert col(run("SELECT nullable_users WHERE age not= nil AND age > 40 { name }"), "name") == ["Cy"]
    assert col(run("SELECT nullable_users WHERE age = nil OR age > 40 { name }"), "name") == ["Bob", "Cy"]
    assert col(run("SELECT nullable_users WHERE age in [nil, 30] { name }"), "name") == ["Ann", "Bob"]
    assert col(run("SELECT nullable_users WHERE NOT (age in [30]) { name }"), "name") == ["Bob", "Cy"]
    with pytest.raises(QueryError, match="nil value"):
        run("SELECT nullable_users WHERE age > 3 AND age not= nil { name }")
    with pytest.raises(QueryError, match="aggregate sum"):
        run("SELECT nullable_users { s: sum(age) }")


def test_null_order(run):
    assert col(run("SELECT flags ORDER BY n { id }"), "id") == [3, 1, 2]
    assert col(run("SELECT flags ORDER BY n DESC { id }"), "id") == [2, 1, 3]
    assert col(run("SELECT flags ORDER BY s { id }"), "id") == [2, 3, 1]
    assert col(run("SELECT flags ORDER BY f { id }"), "id") == [3, 2, 1]


def test_exact_numbers(run):
    assert run("SELECT users WHERE age = 30 { a: age / 4 + 1/6, b: 10/5, c: (age - 31) ** -1 }") == [{"a": pytest.approx(7.5 + 1 / 6), "b": 2, "c": -1.0}]
    assert run("SELECT users WHERE age = 30 { a: 3/4 + 1/6, b: age / 9, c: age / 10 }", exact_output="string") == [{"a": "11/12", "b": "10/3", "c": "3"}]
    assert col(run("SELECT users WHERE age / 3 = 10 { name }"), "name") == ["Ann"]
    assert col(run("SELECT users WHERE age * 2/3 > 20.5 { name }"), "name") == ["Cy"]
    assert run("SELECT prices ORDER BY quantity { t: price * quantity, s: string(price) }") == [{"t": 6, "s": "3"}, {"t": 4.5, "s": "3/2"}]
    with pytest.raises(QueryError, match="division by zero"):
        run("SELECT users { x: 1 / (age - 30) }")
    with pytest.raises(QueryError, match="exponent"):
        run("SELECT users { x: age ** 1.5 }")
    with pytest.raises(QueryError, match="band"):
        run("SELECT users { x: age & 1.5 }")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(1, 30), st.integers(-50, 50), st.integers(1, 30)), min_size=1, max_size=5))
def test_rationals_against_fractions(spark, run, rows):
    e = Engine(catalog(spark).register("q", spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, a long, b long, c long, d long")), exact_output="string")
    got = e.rows("SELECT q ORDER BY i { s: a / b + c / d, m: a / b * (c / d), less: WHEN a / b < c / d THEN 1 ELSE 0 }").to_list()
    for r, (a, b, c, d) in zip(got, rows):
        assert (Fraction(r["s"]), Fraction(r["m"]), r["less"]) == (Fraction(a, b) + Fraction(c, d), Fraction(a, b) * Fraction(c, d), int(Fraction(a, b) < Fraction(c, d)))


def test_projection(run):
    assert run("SELECT users WHERE age = 30 { name, name, age IF $on, status IF $off }", {"on": True, "off": False}) == [{"name": "Ann", "age": 30}]
    assert run("SELECT cards WHERE id = 1 { metadata.tags }") == [{"tags": ["a", "b"]}]
    assert col(run("SELECT users { w: WHEN age < 18 THEN 'minor' WHEN age > 60 THEN 'senior' ELSE 'adult' }"), "w") == ["adult", "minor", "senior"]
    with pytest.raises(QueryError, match="body_item_where_requires_aggregate"):
        run("SELECT users { x: age WHERE age > 3 }")
    with pytest.raises(QueryError, match="missing external parameter"):
        run("SELECT users { name IF $on }")


def test_casts(run):
    assert run("SELECT users WHERE age = 30 { a: string(age), b: int('42'), c: int(7/2), d: inexact(1/4), e: string(1.5), f: string(nil), g: int(0 - 7/2), h: exact(inexact(0.5)) }") == [{"a": "30", "b": 42, "c": 3, "d": 0.25, "e": "3/2", "f": "nil", "g": -3, "h": 0.5}]
    assert run("SELECT moments WHERE id = 1 { at: string(at), day: string(day) }") == [{"at": "2026-01-01T00:00:00", "day": "2026-01-01"}]
    with pytest.raises(QueryError, match="could not parse"):
        run("SELECT users { x: int(name) }")
    for text in ("x: nope(age)", "x: string(age, age)", "x: sum(sum(age))", "x: avg(distinct age)"):
        with pytest.raises(QueryError):
            run(f"SELECT users {{ {text} }}")


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(2**-8, 1e15).map(lambda x: x if x % 2 > 1 else -x), min_size=1, max_size=6))
def test_doubles_become_exact(spark, xs):
    e = Engine(catalog(spark).register("f", spark.createDataFrame(list(enumerate(xs)), "i long, x double")), exact_output="string")
    got = e.rows("SELECT f ORDER BY i { e: exact(x), s: string(x) }").to_list()
    assert [Fraction(r["e"]) for r in got] == [Fraction(x) for x in xs]
    assert [float(r["s"]) for r in got] == xs


def test_float_texts(run):
    assert run("SELECT users WHERE age = 17 { a: string(inexact(123456789)), b: string(inexact(1/4)), c: string(inexact(10) ** 20) }") == [{"a": "123456789.0", "b": "0.25", "c": "1.0e20"}]


def test_json(run):
    assert run("SELECT tickets WHERE json(metadata).color = 'red' { id, k: json(metadata).n.k, gone: json(metadata).none }") == [{"id": 1, "k": "3", "gone": None}]
    assert col(run("SELECT tickets WHERE 'c' in json(metadata).tags { id }"), "id") == [2]
    with pytest.raises(QueryError):
        run("SELECT tickets { x: json(id) }")


def test_lists(run):
    assert col(run("SELECT cards WHERE 'b' in metadata.tags { id }"), "id") == [1, 3]
    assert col(run("SELECT articles WHERE tags ⊂ ['a', 'b'] { id }"), "id") == [1]
    assert col(run("SELECT articles WHERE tags subset or equal to ['b', 'a', 'a'] { id }"), "id") == [1, 2]
    assert col(run("SELECT articles WHERE tags superset of ['a'] { id }"), "id") == [2]
    with pytest.raises(QueryError, match="two list operands"):
        run("SELECT articles WHERE id ⊆ ['a'] { id }")


def test_moments(run):
    assert col(run("SELECT moments WHERE at > 2026-01-15T00:00:00 { id }"), "id") == [2]
    assert col(run("SELECT moments WHERE day <= 2026-01-15 AND at < 2026-01-02 { id }"), "id") == [1]
    assert col(run("SELECT rate_events WHERE at >= 2026-01-01T02:01:00+02:00 { service }"), "service") == ["a", "a", "b"]


def test_order_and_limits(run):
    assert col(run("SELECT accounts ORDER BY tier, score DESC { name }"), "name") == ["a", "b", "c", "d"]
    assert col(run("SELECT accounts ORDER BY score LIMIT 2 { name }"), "name") == ["d", "b"]
    assert col(run("SELECT accounts ORDER BY score DESC LIMIT 1 { name }"), "name") == ["a"]
    assert col(run("SELECT accounts LIMIT 2 OFFSET 1 { name }"), "name") == ["a", "c"]
    assert col(run("SELECT accounts ORDER BY score * -1, name LIMIT 3 OFFSET 1 { name }"), "name") == ["c", "b", "d"]
    assert run("SELECT accounts ORDER BY name LIMIT 0 { name }") == []
    assert run("SELECT accounts LIMIT 9 OFFSET 9 { name }") == []
    assert col(run("SELECT accounts DISTINCT ORDER BY score DESC { tier }"), "tier") == ["a", "b"]
    assert sorted(col(run("SELECT accounts DISTINCT { tier }"), "tier")) == ["a", "b"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), max_size=30), st.integers(0, 10), st.integers(0, 10), st.booleans())
def test_top_k_against_sorting(spark, values, limit, offset, desc):
    e = Engine(catalog(spark).register("t", spark.createDataFrame(list(enumerate(values)), "i long, v long")))
    got = e.rows(f"SELECT t ORDER BY v{' DESC' * desc} LIMIT {limit} OFFSET {offset} {{ i, v }}").to_list()
    want = sorted(enumerate(values), key=lambda r: -r[1] if desc else r[1])[offset : offset + limit]
    assert [(r["i"], r["v"]) for r in got] == want


def test_aggregates(run):
    assert run("SELECT orders { n: count(id), s: sum(total), a: avg(total), lo: min(total), hi: max(total) }") == [{"n": 3, "s": 145, "a": pytest.approx(145 / 3), "lo": 20, "hi": 75}]
    assert run("SELECT orders { a: avg(total) }", exact_output="string") == [{"a": "145/3"}]
    assert run("SELECT orders WHERE total > 1000 { n: count(id), s: sum(total), a: avg(total), p: percentile(total, 0.5) }") == [{"n": 0, "s": None, "a": None, "p": None}]
    got = run("SELECT measurements { vp: var_pop(v), vs: var_samp(v), sp: stddev_pop(v), a: percentile(v, 0), b: percentile(v, 0.5), c: percentile(v, 1), t: percentile(string(v), 0.5), d: count(distinct v) }")[0]
    assert (got["vp"], got["vs"], got["sp"]) == (pytest.approx(4), pytest.approx(32 / 7), pytest.approx(2))
    assert (got["a"], got["b"], got["c"], got["t"], got["d"]) == (2, 4, 9, "4", 5)
    assert run("SELECT measurements WHERE id = 0 { vs: var_samp(v) }") == [{"vs": None}]
    for text, reason in [("percentile(v, 2)", "between 0 and 1"), ("percentile(v)", "percentile/2"), ("sum(v, v)", "sum/1"), ("rate(1s)", "LAST")]:
        with pytest.raises(QueryError, match=reason):
            run(f"SELECT measurements {{ x: {text} }}")
    with pytest.raises(QueryError, match="only valid inside GROUP BY"):
        run("SELECT measurements WHERE sum(v) > 3 { v }")


@pytest.mark.parametrize("p", ["0.07", "0.14", "0.28", "0.55", "0.56", "0.99", "1", "0"])
def test_percentile_ranks(spark, p):
    e = Engine(catalog(spark).register("t", spark.range(1, 101).withColumnRenamed("id", "v")))
    want = max(1, -(-Fraction(p) * 100 // 1))
    assert e.rows(f"SELECT t {{ p: percentile(v, {p}) }}").to_list() == [{"p": want}]


def test_groups(run):
    assert run("SELECT orders GROUP BY customer_id HAVING n > 1 { customer_id, n: count(id), first: total, big: sum(total) WHERE total > 60 }") == [{"customer_id": 1, "n": 2, "first": 50, "big": 75}]
    assert run("SELECT requests GROUP BY service HAVING bad > 4 ORDER BY service { service, bad: sum(errors) WHERE status >= 500 }") == [{"service": "a", "bad": 6}, {"service": "b", "bad": 5}]
    assert run("SELECT requests GROUP BY service ORDER BY share DESC { service, share: sum(errors) / count(errors) }") == [{"service": "b", "share": 4.0}, {"service": "a", "share": pytest.approx(7 / 3)}]
    assert run("SELECT org_chart GROUP BY manager_id ORDER BY manager_id { manager_id, n: count(id) }")[-1] == {"manager_id": None, "n": 1}
    with pytest.raises(QueryError, match="having_without_aggregate"):
        run("SELECT users HAVING age > 3 { name }")
    with pytest.raises(QueryError):
        run("SELECT requests GROUP BY service ORDER BY sum(errors) { service }")
    with pytest.raises(QueryError, match="unsupported_grouped_body_item"):
        run("SELECT requests GROUP BY service { service IF $p }", {"p": True})


def test_rollup_and_cube(run):
    key = lambda r: (str(r["region"]), str(r["quarter"]))
    got = sorted(run("SELECT sales GROUP BY ROLLUP(region, quarter) { region, quarter, t: sum(amount) }"), key=key)
    assert [(r["region"], r["quarter"], r["t"]) for r in got] == [(None, None, 500), ("e", None, 250), ("e", "q1", 100), ("e", "q2", 150), ("w", None, 250), ("w", "q1", 200), ("w", "q2", 50)]
    assert len(run("SELECT sales GROUP BY CUBE(region, quarter) { region, quarter, t: sum(amount) }")) == 9
    assert run("SELECT empty GROUP BY CUBE(a, b) { a, b, n: count(v) }") == [{"a": None, "b": None, "n": 0}]
    with pytest.raises(QueryError, match="ROLLUP/CUBE"):
        run("SELECT sales GROUP BY ROLLUP(region) { region, r: rank() OVER ORDER BY region }")


def test_rate(run):
    assert run("SELECT rate_events GROUP BY service ORDER BY service { service, r: rate(30s) }", time_field=("at",)) == [{"service": "a", "r": 1.0}, {"service": "b", "r": 1.5}]


def test_rate_over_frames(run):
    q = "SELECT rate_events WHERE service = 'a' ORDER BY at { r: rate(40s) OVER ORDER BY at ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING, t: rate(40s) OVER ORDER BY at }"
    rows = run(q, time_field=("at",))
    assert col(rows, "r") == [2.0, 2.0, None, None] and col(rows, "t") == [pytest.approx(4 / 3)] * 4


def test_windows(run):
    q = "SELECT employees ORDER BY name { name, rn: row_number() OVER PARTITION BY department ORDER BY salary DESC, rk: rank() OVER PARTITION BY department ORDER BY salary DESC, s: sum(salary) OVER PARTITION BY department ORDER BY salary ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW, t: sum(salary) OVER PARTITION BY department ORDER BY salary, flat: rank() OVER PARTITION BY department, off: salary - avg(salary) OVER PARTITION BY department }"
    rows = run(q)
    assert col(rows, "rn") == [3, 1, 2, 2, 1] and col(rows, "rk") == [3, 1, 1, 2, 1]
    assert col(rows, "s") == [100, 220, 340, 90, 200] and col(rows, "t") == [340, 340, 340, 200, 200]
    assert col(rows, "flat") == [1] * 5 and rows[3]["off"] == -10.0
    assert run("SELECT employees GROUP BY department ORDER BY department { department, t: sum(salary), r: rank() OVER ORDER BY t DESC }") == [{"department": "x", "t": 340, "r": 1}, {"department": "y", "t": 200, "r": 2}]
    for text in ("r: name() OVER ORDER BY salary", "r: row_number(1) OVER ORDER BY salary", "r: first_value() OVER ORDER BY salary", "r: string(salary) OVER ORDER BY salary"):
        with pytest.raises(QueryError):
            run(f"SELECT employees {{ {text} }}")


BOUNDS = ["UNBOUNDED PRECEDING", "2 PRECEDING", "1 PRECEDING", "CURRENT ROW", "1 FOLLOWING", "2 FOLLOWING", "UNBOUNDED FOLLOWING"]


@pytest.mark.parametrize("low", BOUNDS)
def test_frames_are_clamped(run, low):
    values = [2, 4, 4, 4, 5, 5, 7, 9]
    n = len(values)

    def place(bound, i):
        k, _, side = bound.partition(" ")
        at = {"UNBOUNDED": 0 if side == "PRECEDING" else n - 1, "CURRENT": i}.get(k)
        return max(0, min(n - 1, i + int(k) * (1 if side == "FOLLOWING" else -1) if at is None else at))

    items = ", ".join(f"s{j}: sum(v) OVER ORDER BY id ROWS BETWEEN {low} AND {high}, l{j}: last_value(v) OVER ORDER BY id ROWS BETWEEN {low} AND {high}" for j, high in enumerate(BOUNDS))
    got = run(f"SELECT measurements ORDER BY id {{ {items} }}")
    for i, r in enumerate(got):
        for j, high in enumerate(BOUNDS):
            a, z = place(low, i), place(high, i)
            assert r[f"s{j}"] == (sum(values[a : z + 1]) if z >= a else None), (low, high, i)
            assert r[f"l{j}"] == values[z]


def test_nested(run):
    q = "SELECT customers ORDER BY id { name, SELECT orders WHERE customer_id = customers.id ORDER BY total DESC LIMIT 1 { total } }"
    assert run(q) == [{"name": "Ann", "orders": [{"total": 75}]}, {"name": "Bob", "orders": []}, {"name": "Cy", "orders": [{"total": 20}]}]
    assert col(run("SELECT customers ORDER BY id { name, SELECT orders WHERE customer_id = customers.id REQUIRED { id } }"), "name") == ["Ann", "Cy"]
    assert run("SELECT customers LIMIT 1 { SELECT orders { total } }") == [{"orders": [{"total": 50}, {"total": 75}, {"total": 20}]}]
    got = run("SELECT customers ORDER BY id { SELECT orders WHERE customer_id = customers.id { n: count(id), s: sum(total) } }")
    assert col(got, "orders") == [[{"n": 2, "s": 125}], [{"n": 0, "s": None}], [{"n": 1, "s": 20}]]
    got = run("SELECT customers ORDER BY id { SELECT orders WHERE customer_id > customers.id AND total > 1 { id } }")
    assert [[x["id"] for x in r["orders"]] for r in got] == [[12], [12], []]
    got = run("SELECT customers ORDER BY id { id IF $p, SELECT orders WHERE customer_id = customers.id { id, SELECT items WHERE order_id = orders.id REQUIRED { sku } } }", {"p": True})
    assert got[0] == {"id": 1, "orders": [{"id": 10, "items": [{"sku": "a"}, {"sku": "b"}]}]}
    got = run("SELECT orders GROUP BY customer_id ORDER BY customer_id { customer_id, n: count(id), SELECT customers WHERE id = orders.customer_id { name } }")
    assert got[0] == {"customer_id": 1, "n": 2, "customers": [{"name": "Ann"}]}
    got = run("SELECT customers ORDER BY id LIMIT 1 { id, SELECT orders WHERE customer_id = customers.id AND id not= customers.id { total, r: row_number() OVER ORDER BY total DESC } }")
    assert got == [{"id": 1, "orders": [{"r": 2, "total": 50}, {"r": 1, "total": 75}]}]
    with pytest.raises(QueryError):  # only the immediate parent can be named
        run("SELECT customers { id, SELECT orders { id, SELECT items WHERE id = customers.id { sku } } }")


def test_source_order(run):
    ordered = lambda text: run(text, preserve_order=True)
    assert col(ordered("SELECT customers { name, SELECT orders WHERE customer_id = customers.id { id } }"), "name") == ["Ann", "Bob", "Cy"]
    assert col(ordered("SELECT requests GROUP BY service, status { service, status }"), "status") == [200, 500, 200, 503, 500]
    assert col(ordered("SELECT accounts DISTINCT { tier }"), "tier") == ["b", "a"]
    assert col(ordered("SELECT customers LIMIT 2 OFFSET 1 { name, SELECT orders WHERE customer_id = customers.id { id } }"), "name") == ["Bob", "Cy"]


def test_nested_null_link(run):
    with pytest.raises(QueryError, match="nil value"):
        run("SELECT org_chart { SELECT customers WHERE id = org_chart.manager_id { name } }")


def test_sets_and_bindings(run):
    names = lambda text: sorted(col(run(text), "name"))
    assert names("SELECT team_a { name } UNION SELECT team_b { name }") == ["x", "y", "z"]
    assert len(names("SELECT team_a { name } UNION ALL SELECT team_b { name }")) == 5
    assert names("SELECT team_a { name } INTERSECT SELECT team_b { name }") == ["y"]
    assert names("SELECT team_a { name } EXCEPT SELECT team_b { name }") == ["x"]
    assert names("WITH team_b = SELECT team_a { name } SELECT team_b WHERE name = 'x' { name }") == ["x", "x"]
    assert names("WITH all = SELECT team_a { name } UNION SELECT team_b { name } SELECT all ORDER BY name LIMIT 2 { name }".replace("all ", "both ").replace("WITH all", "WITH both")) == ["x", "y"]
    with pytest.raises(QueryError, match="mismatched_columns"):
        run("SELECT team_a { name } UNION SELECT team_b { other: name }")


def test_recursion(run):
    base = "SELECT org_chart WHERE manager_id = 1 { id }".replace("manager_id = 1", "manager_id not= nil AND manager_id = 1")
    q = f"WITH RECURSIVE below = {base} UNION SELECT org_chart WHERE manager_id in below.id {{ id }} SELECT below ORDER BY id {{ id }}"
    assert col(run(q), "id") == [2, 3, 4, 5, 6, 7]
    loop = "WITH RECURSIVE r = SELECT edges WHERE id = 1 { id, manager_id } UNION SELECT edges WHERE id in r.manager_id { id, manager_id } SELECT r ORDER BY id { id }"
    assert col(run(loop), "id") == [1, 2]
    count = "WITH RECURSIVE c = SELECT users WHERE age = 17 { n: age } UNION ALL SELECT c WHERE n < 20 { n: n + 1 } SELECT c ORDER BY n { n }"
    assert col(run(count), "n") == [17, 18, 19, 20]
    with pytest.raises(QueryError, match="recursive_with_requires_union"):
        run("WITH RECURSIVE r = SELECT edges { id } SELECT r { id }")


def test_shared_storage(spark):
    from lanternql.sources import shared

    df, path = shared.materialized(spark.range(5), "test")
    assert df.count() == 5 and shared.exists(spark, path) and path.startswith(shared.application_dir(spark))
    shared.discard(spark, path)
    assert not shared.exists(spark, path)


def test_declared_types_push_filters(spark):
    e = Engine(catalog(spark))
    plan = lambda q: e.run(q)._jdf.queryExecution().optimizedPlan().toString()
    assert "raise_error" in plan("SELECT users WHERE age > 3 { name }")
    assert "raise_error" not in plan("TYPE users { age: Int } SELECT users WHERE age > 3 { name }")


def test_cursor(spark):
    rows = Engine(catalog(spark)).rows("SELECT measurements ORDER BY id { id }")
    assert rows.take(2) == [{"id": 0}, {"id": 1}]
    assert next(rows.skip(3)) == {"id": 5}
    rows.close()
    assert rows.to_list() == [] and next(rows, None) is None


def test_functions(spark):
    from pyspark.sql import functions as F

    e = Engine(catalog(spark))
    e.functions.register("text.up", F.upper)
    assert col(e.rows("SELECT users WHERE text.up(name) = 'BOB' { n: text.up(name) }").to_list(), "n") == ["BOB"]
    with pytest.raises(QueryError, match="reserved_function"):
        e.functions.register("sum", F.upper)
    with pytest.raises(QueryError, match="decoder"):
        e.run("SELECT users { x: dxn(name) }")
    e.functions.register("dxn", lambda c: F.parse_json(F.concat(F.lit('{"n": "'), c, F.lit('"}'))))
    assert col(e.rows("SELECT users WHERE dxn(name).n = 'Bob' { n: dxn(name).n }").to_list(), "n") == ["Bob"]


def test_variants_must_be_lowered_before_they_run(spark):
    x = Extensions()
    x.add("modifiers", "NEAREST", lambda parser: ast.Variant("nearest", (parser.need("ident").value, parser.need("ident").value)))
    x.add("items", "SAMPLE", lambda parser: ast.Variant("sample", (parser.need("ident").value, parser.need("int").value)))
    x.add("infixes", "SEARCH", lambda parser, left: ast.Variant("search", (left, parser.need("ident").value, parser.need("string").value)))
    e = Engine(catalog(spark), extensions=x)
    for text, reason in [("SELECT users NEAREST point { name }", "unresolved_variant"), ("SELECT users WHERE name SEARCH 'x' { name }", "unresolved_variant"), ("SELECT users { name, SAMPLE 5 }", "unsupported_body_item")]:
        with pytest.raises(QueryError, match=reason):
            e.run(text)


def test_catalog_describes_itself(spark):
    c = catalog(spark)
    assert [f.name for f in c.describe("users")] == ["name", "age", "status"] and {"where", "window", "recursive"} <= c.capabilities()


def test_percentiles_beyond_doubles(spark):
    big = 9007199254740992
    rows = [(k, big + v) for k, vs in {"a": (1, 3, 5), "b": (2, 2, 7, 9)}.items() for v in vs]
    e = Engine(catalog(spark).register("t", spark.createDataFrame(rows, "k string, v long")))
    assert e.rows("SELECT t GROUP BY k ORDER BY k { k, p: percentile(v, 0.5), q: percentile(v, 0.76) }").to_list() == [{"k": "a", "p": big + 3, "q": big + 5}, {"k": "b", "p": big + 2, "q": big + 9}]
    assert e.rows("SELECT t GROUP BY ROLLUP(k) ORDER BY k { k, p: percentile(v, 1) }").to_list()[0]["p"] in (big + 5, big + 9)
    got = e.rows("SELECT t ORDER BY v { p: percentile(v, 0.5) OVER PARTITION BY k, d: count(distinct v) OVER PARTITION BY k, low: percentile(v, 0) OVER ORDER BY v }").to_list()
    assert {(r["p"], r["d"], r["low"]) for r in got} == {(big + 3, 3, big + 1), (big + 2, 3, big + 1)}


def test_powers_and_whole_parts_of_columns(spark):
    rows = [(3, -1, 99999999), (3, 40, -99999999), (2, 64, 100000000), (-1, 10**9 + 1, -100000001), (0, 0, 0), (-2, -3, 5)]
    e = Engine(catalog(spark).register("t", spark.createDataFrame(rows, "b long, e long, x long")))
    got = e.rows("SELECT t ORDER BY x { p: string(b ** e), i: int(x / 100000000) }").to_list()
    want = {x: (str(Fraction(b) ** e) if e < 10**6 else str(b**(e % 2)), int(Fraction(x, 10**8))) for b, e, x in rows}
    assert [(r["p"], r["i"]) for r in got] == [want[x] for x in sorted(want)]
    for text in ("b ** e", "(b + 0) ** (0 - 1)"):
        bad = Engine(catalog(spark).register("t", spark.createDataFrame([(0, -1)] if "0 - 1" in text else [(7, 50)], "b long, e long")))
        with pytest.raises(Exception, match="division by zero|overflow|OVERFLOW|out of range|OUT_OF_RANGE"):
            bad.rows(f"SELECT t {{ x: {text} }}").to_list()


@pytest.mark.parametrize("low", BOUNDS)
def test_other_aggregates_over_clamped_frames(run, low):
    values = [2, 4, 4, 4, 5, 5, 7, 9]
    n = len(values)

    def place(bound, i):
        k, _, side = bound.partition(" ")
        at = {"UNBOUNDED": 0 if side == "PRECEDING" else n - 1, "CURRENT": i}.get(k)
        return max(0, min(n - 1, i + int(k) * (1 if side == "FOLLOWING" else -1) if at is None else at))

    frames = [(low, high) for high in BOUNDS[1:4]]
    calls = {"c": "count(v)", "a": "avg(v)", "v": "var_pop(v)", "d": "count(distinct v)", "p": "percentile(v, 0.5)", "m": "max(v)"}
    items = ", ".join(f"{k}{j}: {c} OVER ORDER BY id ROWS BETWEEN {a} AND {z}" for j, (a, z) in enumerate(frames) for k, c in calls.items())
    for i, r in enumerate(run(f"SELECT measurements ORDER BY id {{ {items} }}")):
        for j, (a, z) in enumerate(frames):
            here = sorted(values[place(a, i) : place(z, i) + 1])
            mean = sum(here) / len(here) if here else None
            assert (r[f"c{j}"], r[f"d{j}"]) == (len(here), len(set(here)))
            assert r[f"a{j}"] == (pytest.approx(mean) if here else None) and r[f"m{j}"] == (max(here) if here else None)
            assert r[f"v{j}"] == (pytest.approx(sum((x - mean) ** 2 for x in here) / len(here)) if here else None)
            assert r[f"p{j}"] == (here[(len(here) - 1) // 2] if here else None), (a, z, i)
