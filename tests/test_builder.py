import pytest

from lanternql.cli import backend, main, repl, show
from lanternql.engine import Engine, parse
from lanternql.errors import QueryError
from lanternql.plans import ast
from lanternql.plans.builder import col, fn, from_, item, param, when
from tests.fixtures import catalog


def test_same_plan_as_text():
    q = from_("orders").where((col("total") > 10) & ~(col("id") == None)).group_by("customer_id").having(fn.count(col("id")) > 1).order_by(col("n").desc()).limit(3).offset(1).select("customer_id", n=fn.count(col("id")), s=item(fn.sum(col("total")), col("total") < 60))  # noqa: E711
    text = parse("SELECT orders WHERE total > 10 AND NOT (id = nil) GROUP BY customer_id HAVING count(id) > 1 ORDER BY n DESC LIMIT 3 OFFSET 1 { customer_id, n: count(id), s: sum(total) WHERE total < 60 }")
    assert q.plan() == text


def test_expressions():
    assert (1 + col("a") * 2).node == ast.Arith("+", ast.Lit(1, "int"), ast.Arith("*", ast.Field(("a",)), ast.Lit(2, "int")))
    assert fn.row_number().over(partition_by=["d"], order_by=[col("s").desc()]).node.order[0].desc
    assert col("a").isin([1, param("p")]).node.right.kind == "list"
    assert when((col("a") > 1, "x"), otherwise="y").node.default.value == "y"
    with pytest.raises(TypeError):
        bool(col("a") > 1)
    with pytest.raises(QueryError, match="nested_key_mismatch"):
        from_("a").select(x=from_("b").select("y"))


def test_where_accumulates_others_replace():
    q = from_("t").where(col("a") > 1).where(col("b") > 1).limit(1).limit(2).plan()
    assert len(q.wheres) == 2 and q.limit == 2


def test_run(spark):
    e = Engine(catalog(spark))
    nested = from_("orders").where(col("customer_id") == col("customers.id")).select("total")
    rows = e.rows(from_("customers").order_by("id").select("name", nested)).to_list()
    assert rows[0] == {"name": "Ann", "orders": [{"total": 50}, {"total": 75}]}
    both = from_("team_a").select("name").union(from_("team_b").select("name"))
    assert sorted(r["name"] for r in e.rows(both).to_list()) == ["x", "y", "z"]
    assert e.rows(from_("both").with_("both", both).order_by("name").select("name")).take(1) == [{"name": "x"}]


def test_command_line(spark):
    e, out = Engine(catalog(spark)), []
    assert show(e, "SELECT users WHERE age = 17 { name }", {}, None, out.append)
    assert not show(e, "SELECT nowhere { name }", {}, None, out.append)
    assert out[0] == '{"name": "Bob"}\n' and out[1].startswith("error: no_such_source")
    out.clear()
    repl(e, ["SELECT users\n", "WHERE age = 17\n", "{ name }\n", "SELECT nope\n", "\n", "quit\n", "SELECT users { name }\n"], out.append)
    assert out[0] == '{"name": "Bob"}\n' and out[1].startswith("error") and len(out) == 2


def test_backends(spark, tmp_path, capsys):
    config = {"default": "a", "backends": {"a": {"dir": str(tmp_path)}, "b": {}}}
    assert backend(config, None) == {"dir": str(tmp_path)} and backend(config, "b") == {}
    for name, c in [("c", config), (None, {"backends": {"a": {}, "b": {}}})]:
        with pytest.raises(QueryError):
            backend(c, name)
    spark.range(3).write.parquet(str(tmp_path / "numbers.parquet"))
    file = tmp_path / "config.json"
    file.write_text(__import__("json").dumps(config))
    assert main(["--config", str(file), "query", "SELECT numbers WHERE id > $n { id } ".replace("WHERE id > $n", "WHERE id not= nil AND id > $n"), "--param", "n=1"]) == 0
    assert capsys.readouterr().out == '{"id": 2}\n'
