from fractions import Fraction

import pytest

from lanternql.engine import parse
from lanternql.errors import ParseError, QueryError
from lanternql.plans import ast
from lanternql.plans.parser import Extensions, Parser


def body(text):
    return parse(f"SELECT t {{ x: {text} }}").select[0].expr


@pytest.mark.parametrize(
    ("text", "value"),
    [("30", 30), ("0x1F", 31), ("0o17", 15), ("0b101", 5), ("1.5", Fraction(3, 2)), ("4.0", 4), ("2/3", Fraction(2, 3)), ("500ms", Fraction(1, 2)), ("1.5h", 5400), ("10MB", 10**7), ("10MiB", 10 * 2**20), ("'a\\'b'", "a'b"), ('"""x"y"""', 'x"y'), ("'\\u0041\\q'", "A\\q"), ("true", True), ("NIL", None)],
)
def test_literals(text, value):
    assert body(text).value == value


def test_dates_are_checked():
    assert body("2026-01-01T14:00:00+02:00").value.hour == 12
    with pytest.raises(ParseError):
        body("2026-02-30")


def test_precedence():
    assert body("1 + 2 * 3 ** 2") == ast.Arith("+", ast.Lit(1, "int"), ast.Arith("*", ast.Lit(2, "int"), ast.Arith("**", ast.Lit(3, "int"), ast.Lit(2, "int"))))
    assert body("a & b + c").op == "&"
    assert body("a - b - c").left.op == "-"
    assert body("x ** 2/3").right == ast.Lit(Fraction(2, 3), "exact")


def test_predicates():
    q = parse("SELECT t WHERE a = 1 OR b = 2 AND NOT c = 3 { a }")
    assert isinstance(q.wheres[0], ast.Or) and isinstance(q.wheres[0].right.right, ast.Not)
    assert parse("SELECT t WHERE (a = 1 OR b = 2) AND (c + 1) * 2 > 3 { a }").wheres[0].right.left.op == "*"
    assert parse("SELECT t WHERE a superset or equal to b { a }").wheres[0].op == "superset_eq"
    assert parse("SELECT t WHERE a ⊂ b { a }").wheres[0].op == "subset"


def test_clauses_stand_in_order():
    q = parse("select a.b where x = 1 group by k having n > 1 distinct order by k desc, n limit 3 offset 2 required { k, n: count(x) }")
    assert (q.source, q.distinct, q.limit, q.offset, q.required) == (("a", "b"), True, 3, 2, True)
    assert [o.desc for o in q.order_by] == [True, False]
    with pytest.raises(ParseError):
        parse("SELECT t LIMIT 1 WHERE a = 1 { a }")


def test_body_separators():
    assert len(parse("SELECT t {\n a\n b, c,\n}").select) == 3
    assert len(parse("SELECT t {\n a\n b IF $p\n}").select) == 2
    with pytest.raises(ParseError, match="comma required"):
        parse("SELECT t { a b }")


def test_comments_and_escapes():
    q = parse(";with x = SELECT y { z, SELECT w { v } }\n# more\nSELECT t # inline\n{ `select` }")
    assert q.select[0].alias == "select" and not q.withs


def test_window_syntax():
    w = body("sum(v) OVER PARTITION BY a, b ORDER BY c DESC ROWS BETWEEN 2 PRECEDING AND UNBOUNDED FOLLOWING")
    assert w.frame == (("preceding", 2), ("unbounded_following", 0)) and len(w.partition) == 2


def test_sets_are_left_associative():
    q = parse("SELECT a { x } EXCEPT SELECT b { x } UNION ALL SELECT c { x }")
    assert (q.op, q.left.op) == ("union_all", "except")


def test_call_sources_and_sigils():
    assert parse('SELECT ancestor(X, "bob") WHERE age(X) > 30 { X }').goal_args[1].value == "bob"
    assert parse("SELECT flag() { ok }").goal_args == ()
    assert parse("SELECT t WHERE a ~ @r|x\\|y| { a }").wheres[0].right.value == "x|y"
    with pytest.raises(QueryError, match="unsupported_sigil_tag"):
        parse("SELECT t WHERE a ~ @q/x/ { a }")


def test_fragments():
    q = parse("FRAGMENT a { x, ...b } FRAGMENT b { y } SELECT t { ...a, z }")
    assert [i.alias for i in q.select] == ["x", "y", "z"]
    for text, reason in [
        ("SELECT t { ...nope }", "undefined_fragment"),
        ("FRAGMENT a { ...b } FRAGMENT b { ...a } SELECT t { x }", "fragment_cycle"),
        ("FRAGMENT a { x } FRAGMENT a { y } SELECT t { x }", "duplicate_fragment"),
        ("WITH a = SELECT b { x } WITH b = SELECT a { x } SELECT a { x }", "with_cycle"),
        ("WITH a = SELECT a { x } SELECT a { x }", "with_cycle"),
        ("WITH a = SELECT t { x } WITH a = SELECT t { x } SELECT a { x }", "duplicate_with"),
        ("TYPE t { a: Int } TYPE t { a: Int } SELECT t { a }", "duplicate_type"),
    ]:
        with pytest.raises(QueryError, match=reason):
            parse(text)
    parse("WITH RECURSIVE a = SELECT t { x } UNION SELECT a { x } SELECT a { x }")


def test_types():
    q = parse("TYPE t : olap { a: ?Int | String, b: JSON<{ c: String, d: [Int] }> } SELECT t { a }")
    t = q.types["t"]
    assert t.kind == "olap" and t.fields["a"] == ast.Union((ast.Nullable(ast.Named("Int")), ast.Named("String")))
    assert dict(t.fields["b"].param.fields)["d"] == ast.ListOf(ast.Named("Int"))


def test_extensions():
    x = Extensions()

    def search(parser, left):
        parser.need("ident")
        return ast.Variant("search", (left, parser.need("string").value))

    x.add("infixes", "SEARCH", search)
    q = Parser("SELECT t WHERE a SEARCH 'x' { a }", x).document()[0]
    assert q.wheres[0].tag == "search"
    with pytest.raises(QueryError, match="extension_collision"):
        x.add("infixes", "search", search)


def test_extensions_of_headers_and_bodies():
    x = Extensions()
    x.add("modifiers", "NEAREST", lambda parser: ast.Variant("nearest", (parser.need("ident").value, parser.need("ident").value)))
    x.add("items", "SAMPLE", lambda parser: ast.Variant("sample", (parser.need("ident").value, parser.need("int").value)))
    q = Parser("SELECT t NEAREST point WHERE a > 1 { a, SAMPLE 5 }", x).document()[0]
    assert q.variant.tag == "nearest" and any(isinstance(i, ast.Variant) and i.tag == "sample" for i in q.select)
    with pytest.raises(ParseError):
        Parser("SELECT t NEAREST point { a }").document()
