"""The registered queries: a text in the query language each, and its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .plans.builder import col, fn, from_, item
from .sources.catalog import Catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    """An engine over the tables of a folder.  Their columns hold no nulls, so comparisons are plain."""
    catalog = Catalog(spark)
    for t in TABLES:
        catalog.register_parquet(t, f"{sf_dir}/{t}.parquet", "*")
    # A hierarchy: every nation's parent has half its key.
    catalog.register("hierarchy", lambda: catalog.table(("nation",)).select(F.col("n_nationkey").alias("id"), F.expr("case when n_nationkey > 0 then n_nationkey div 2 end").alias("parent").cast("int"), F.col("n_name").alias("name")))
    # Tables whose columns hold nulls or lists; nothing is declared about them, so every comparison tests for nulls.
    sparse = "o_orderkey AS id", "CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END AS priority", "CASE WHEN o_custkey % 5 > 0 THEN o_custkey END AS cust"
    catalog.register("sparse", lambda: catalog.table(("orders",)).selectExpr(*sparse))
    catalog.register("tagged", lambda: catalog.table(("part",)).selectExpr("p_partkey", "split(p_name, ' ') AS words", "named_struct('words', split(p_name, ' ')) AS meta"))
    catalog.register_call("numbers", lambda low, high: spark.range(int(low), int(high) + 1).withColumnRenamed("id", "n"))
    e = Engine(catalog, **options)
    e.functions.register("text.upper", F.upper)
    return e


def text(query: str, then: Callable[[DataFrame], DataFrame] | None = None, params: dict | None = None, time_field=None, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir, **options).run(query, params, time_field)
        return then(df) if then else df

    return run


def built(make: Callable[[], object]):
    return lambda spark, sf_dir: engine(spark, sf_dir).run(make())


def rounded(*names: str, digits: int = 4):
    """Sums of doubles depend on the order of their terms; they are compared rounded."""

    def then(df: DataFrame) -> DataFrame:
        return df.withColumns({n: F.round(F.col(n), digits) for n in names})

    return then


def exploded(name: str):
    """One row for each element of a nested list, rows without elements left out."""
    return lambda df: df.select(*[c for c in df.columns if c != name], F.explode(name).alias("x")).select(*[c for c in df.columns if c != name], "x.*")


SPARSE = "(SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END AS priority, CASE WHEN o_custkey % 5 > 0 THEN o_custkey END AS cust FROM orders)"

PAIRS: dict[str, tuple[Callable, str | None]] = {
    "sc1_scan": (text("SELECT region { r_regionkey, r_name }"), "SELECT r_regionkey, r_name FROM region"),
    "sc5_with_source": (text("WITH big = SELECT customer WHERE c_acctbal > 9000 { c_custkey, c_acctbal } SELECT big WHERE c_acctbal < 9500 { c_custkey }"), "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 AND c_acctbal < 9500"),
    "sc6_call_source": (text("SELECT numbers(3, 7) WHERE n > 4 { n }"), "SELECT CAST(range AS BIGINT) AS n FROM range(5, 8)"),
    "pr1_fields": (text("SELECT lineitem WHERE l_quantity > 40 { l_orderkey, l_linenumber, l_quantity }"), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40"),
    "pr2_computed": (text("SELECT lineitem WHERE l_quantity > 45 { l_orderkey, l_linenumber, rev: l_extendedprice * (1 - l_discount) }"), "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS rev FROM lineitem WHERE l_quantity > 45"),
    "pr3_if": (text("SELECT nation { n_name, n_nationkey IF $on, n_regionkey IF $off }", params={"on": True, "off": None}), "SELECT n_name, n_nationkey FROM nation"),
    "pr4_item_where": (text("SELECT orders GROUP BY o_orderstatus { o_orderstatus, n: count(o_orderkey), urgent: count(o_orderkey) WHERE o_orderpriority = '1-URGENT', top: max(o_totalprice) WHERE o_totalprice < 100000 }"), "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, max(o_totalprice) FILTER (WHERE o_totalprice < 100000) AS top FROM orders GROUP BY o_orderstatus"),
    "pr6_fragment": (text("FRAGMENT who { c_custkey, c_name } FRAGMENT more { ...who, c_mktsegment } SELECT customer WHERE c_nationkey = 3 { ...more }"), "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_nationkey = 3"),
    "fl2_comparisons": (text("SELECT part WHERE p_size >= 10 AND p_size <= 20 AND p_size not= 15 AND p_retailprice < 1500 { p_partkey, p_size }"), "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_size <> 15 AND p_retailprice < 1500"),
    "fl3_nil": (text("SELECT hierarchy WHERE parent = nil OR parent > 9 { id, name }"), "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey = 0 OR n_nationkey // 2 > 9"),
    "fl4_regex": (text("SELECT documents WHERE text ~ @r/[Ll]icense/ { doc_id }"), "SELECT doc_id FROM documents WHERE regexp_matches(text, '[Ll]icense')"),
    "fl5_in_list": (text("SELECT customer WHERE c_mktsegment in ['BUILDING', $other] AND NOT (c_nationkey in [1, 2, 3]) { c_custkey, c_mktsegment }", params={"other": "MACHINERY"}), "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)"),
    "fl6_in_path": (text("SELECT embeddings WHERE 0 in parts { vec_id }".replace("parts", "embedding")), "SELECT vec_id FROM embeddings WHERE list_contains(embedding, 0)"),
    "fl8_subset": (text("SELECT nation WHERE ['a', 'b'] ⊂ ['b', 'a', 'c'] AND NOT (['a'] superset of ['a']) AND ['x'] subset or equal to ['x'] { n_nationkey }"), "SELECT n_nationkey FROM nation"),
    "fl9_boolean": (text("SELECT orders WHERE o_orderstatus = 'F' AND (o_totalprice > 400000 OR o_orderpriority = '1-URGENT') AND NOT (o_custkey < 100) { o_orderkey }"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 400000 OR o_orderpriority = '1-URGENT') AND NOT (o_custkey < 100)"),
    "fl10_arithmetic": (text("SELECT lineitem WHERE l_quantity * l_discount > 4.5 { l_orderkey, l_linenumber }"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * l_discount > 4.5"),
    "fl2_with_nulls": (text("SELECT sparse WHERE cust not= nil AND cust > 700 AND (priority = nil OR priority not= '5-LOW') { id, cust, priority }"), f"SELECT * FROM {SPARSE} WHERE cust > 700 AND (priority IS NULL OR priority <> '5-LOW')"),
    "fl3_only_nulls": (text("SELECT sparse WHERE cust = nil AND NOT (priority = nil) { id, priority }"), f"SELECT id, priority FROM {SPARSE} WHERE cust IS NULL AND priority IS NOT NULL"),
    "fl5_in_with_nulls": (text("SELECT sparse WHERE priority in ['1-URGENT', '2-HIGH'] { id }"), f"SELECT id FROM {SPARSE} WHERE coalesce(priority IN ('1-URGENT', '2-HIGH'), false)"),
    "fl2_sql_nulls": (text("SELECT sparse WHERE cust > 700 AND priority not= '5-LOW' { id }", strict_nulls=False), f"SELECT id FROM {SPARSE} WHERE cust > 700 AND priority <> '5-LOW'"),
    "fl6_in_list_field": (text("SELECT tagged WHERE 'red' in words OR 'bolt' in meta.words { p_partkey }"), "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red') OR list_contains(string_split(p_name, ' '), 'bolt')"),
    "fl7_literal_in_field": (text("SELECT tagged WHERE NOT ('small' in words) AND p_partkey in [1, 2, 3, 5, 8, 13] { p_partkey }"), "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%small%' AND p_partkey IN (1, 2, 3, 5, 8, 13)"),
    "ag1_group_with_nulls": (text("SELECT sparse GROUP BY priority { priority, n: count(id), some: count(cust) WHERE cust not= nil, top: max(cust) WHERE cust not= nil }"), f"SELECT priority, count(*) AS n, count(cust) AS some, max(cust) AS top FROM {SPARSE} GROUP BY priority"),
    "ag7_rollup_names": (text("SELECT orders GROUP BY ROLLUP(o_orderstatus) { o_orderstatus, status: min(o_orderstatus), n: count(o_orderkey) }"), "SELECT o_orderstatus, min(o_orderstatus) AS status, count(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus)"),
    "ag15_percentile_wide": (text("SELECT orders GROUP BY o_orderstatus { o_orderstatus, low: percentile(o_orderkey + 9007199254740992, 0.1), mid: percentile(o_orderkey + 9007199254740992, 0.5), name: percentile(o_orderpriority, 0.5) }"), "SELECT o_orderstatus, quantile_disc(o_orderkey + 9007199254740992, 0.1) AS low, quantile_disc(o_orderkey + 9007199254740992, 0.5) AS mid, quantile_disc(o_orderpriority, 0.5) AS name FROM orders GROUP BY o_orderstatus"),
    "ag15_percentile_flat": (text("SELECT lineitem { p: percentile(l_orderkey, 0.25), q: percentile(l_extendedprice, 0.75) }"), "SELECT quantile_disc(l_orderkey, 0.25) AS p, quantile_disc(l_extendedprice, 0.75) AS q FROM lineitem"),
    "ex3_power_of_columns": (text("SELECT nation { n_nationkey, p: string((n_regionkey + 2) ** (n_nationkey - 12)) }"), "SELECT n_nationkey, CASE WHEN n_nationkey < 12 THEN '1/' ELSE '' END || CAST(CAST(power(n_regionkey + 2, abs(n_nationkey - 12)) AS BIGINT) AS VARCHAR) AS p FROM nation"),
    "ex8_int_of_quotients": (text("SELECT part { p_partkey, a: int((p_partkey * 100000000 - 1) / 100000000), b: int((1 - p_partkey * 100000000) / 100000000), c: int(p_partkey / -7) }"), "SELECT p_partkey, greatest(p_partkey - 1, 0) AS a, -greatest(p_partkey - 1, 0) AS b, -(p_partkey // 7) AS c FROM part"),
    "ex9_exact_double": (text("SELECT part WHERE p_partkey < 40 { p_partkey, x: string(exact(inexact(p_size) / 8)) }"), "SELECT p_partkey, CAST(p_size // gcd(p_size, 8) AS VARCHAR) || CASE WHEN p_size % 8 = 0 THEN '' ELSE '/' || CAST(8 // gcd(p_size, 8) AS VARCHAR) END AS x FROM part WHERE p_partkey < 40"),
    "fe9_comments": (text("# a comment\n;with gone = SELECT nowhere { x, SELECT y { z } }\nselect nation where `n_name` = \"NATION_3\" or n_name = 'NATION_7' {\n  n_name\n  n_nationkey,\n}"), "SELECT n_name, n_nationkey FROM nation WHERE n_name IN ('NATION_3', 'NATION_7')"),
    "wn10_clamped_parts": (text("SELECT supplier { s_suppkey, n: count(s_suppkey) OVER PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING, t: max(s_suppkey) OVER PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING }"), "SELECT s_suppkey, greatest(1, count(*) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS n, coalesce(max(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), s_suppkey) AS t FROM supplier"),
    "wn5_percentile_frame": (text("SELECT supplier { s_suppkey, p: percentile(s_suppkey, 0.5) OVER PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW }"), "SELECT s_suppkey, quantile_disc(s_suppkey, 0.5) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS p FROM supplier"),
    "jn1_uncorrelated": (text("SELECT region { r_name, SELECT nation WHERE n_regionkey = 1 { n_name } }", exploded("nation")), "SELECT r_name, n_name FROM region, nation WHERE n_regionkey = 1"),
    "jn2_nested": (text("SELECT nation { n_name, SELECT supplier WHERE s_nationkey = nation.n_nationkey { s_suppkey, s_acctbal } }", exploded("supplier")), "SELECT n_name, s_suppkey, s_acctbal FROM nation JOIN supplier ON s_nationkey = n_nationkey"),
    "jn3_theta": (text("SELECT region { r_name, SELECT nation WHERE n_nationkey > region.r_regionkey AND n_regionkey not= region.r_regionkey { n_name } }", exploded("nation")), "SELECT r_name, n_name FROM region JOIN nation ON n_nationkey > r_regionkey AND n_regionkey <> r_regionkey"),
    "jn4_per_parent_top": (text("SELECT customer { c_custkey, SELECT orders WHERE o_custkey = customer.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2 { o_orderkey } }", exploded("orders")), "SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) ON o_custkey = c_custkey WHERE r <= 2"),
    "jn4_nested_aggregate": (text("SELECT customer { c_custkey, SELECT orders WHERE o_custkey = customer.c_custkey { n: count(o_orderkey), top: max(o_totalprice) } }", exploded("orders")), "SELECT c_custkey, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    "jn5_required": (text("SELECT nation { n_name, SELECT supplier WHERE s_nationkey = nation.n_nationkey AND s_acctbal > 9000 REQUIRED { s_suppkey } }", lambda df: df.select("n_name", F.size("supplier").cast("long").alias("n"))), "SELECT n_name, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY n_name"),
    "jn6_limit_after_required": (text("SELECT nation ORDER BY n_nationkey LIMIT 5 { n_nationkey, SELECT supplier WHERE s_nationkey = nation.n_nationkey AND s_acctbal > 8000 REQUIRED { s_suppkey } }", lambda df: df.select("n_nationkey")), "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 8000) ORDER BY n_nationkey LIMIT 5"),
    "jn7_two_levels": (text("SELECT region { r_name, SELECT nation WHERE n_regionkey = region.r_regionkey { n_name, SELECT supplier WHERE s_nationkey = nation.n_nationkey { s_suppkey } } }", lambda df: exploded("supplier")(exploded("nation")(df))), "SELECT r_name, n_name, s_suppkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey"),
    "jn10_nested_over_group": (text("SELECT customer GROUP BY c_nationkey { c_nationkey, n: count(c_custkey), SELECT supplier WHERE s_nationkey = customer.c_nationkey { s_suppkey } }", exploded("supplier")), "SELECT c_nationkey, n, s_suppkey FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) JOIN supplier ON s_nationkey = c_nationkey"),
    "ag1_group": (text("SELECT customer GROUP BY c_mktsegment, c_nationkey { c_mktsegment, c_nationkey, n: count(c_custkey) }"), "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL"),
    "ag1_high_cardinality": (text("SELECT lineitem GROUP BY l_orderkey { l_orderkey, n: count(l_linenumber), parts: sum(l_partkey), top: max(l_quantity) }"), "SELECT l_orderkey, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts, max(l_quantity) AS top FROM lineitem GROUP BY l_orderkey"),
    "ag9_flat_avg": (text("SELECT orders { mean: avg(o_custkey), n: count(o_orderkey) }"), "SELECT sum(o_custkey)::DOUBLE / count(*) AS mean, count(*) AS n FROM orders"),
    "fl2_point_lookup": (text("SELECT lineitem WHERE l_orderkey = 42 AND l_linenumber = 1 LIMIT 1 { l_orderkey, l_linenumber, l_quantity }"), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 42 AND l_linenumber = 1 LIMIT 1"),
    "ag21_exact_ratio": (text("SELECT orders GROUP BY o_orderstatus { o_orderstatus, share: sum(o_custkey) / count(o_orderkey) ** 2 }"), "SELECT o_orderstatus, sum(o_custkey)::DOUBLE / (count(*) * count(*)) AS share FROM orders GROUP BY o_orderstatus"),
    "ag2_whole": (text("SELECT lineitem WHERE l_quantity > 1000 { n: count(l_orderkey), top: max(l_quantity) }"), "SELECT count(*) AS n, max(l_quantity) AS top FROM lineitem WHERE l_quantity > 1000"),
    "ag3_representative": (text("SELECT nation GROUP BY n_regionkey { n_regionkey, n_name }"), "SELECT n_regionkey, arg_min(n_name, n_nationkey) AS n_name FROM nation GROUP BY n_regionkey"),
    "ag4_rollup": (text("SELECT orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority) { o_orderstatus, o_orderpriority, n: count(o_orderkey) }"), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)"),
    "ag4_rollup_empty": (text("SELECT orders WHERE o_totalprice < 0 GROUP BY ROLLUP(o_orderstatus) { o_orderstatus, n: count(o_orderkey) }"), "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice < 0 GROUP BY ROLLUP(o_orderstatus)"),
    "ag5_cube": (text("SELECT orders GROUP BY CUBE(o_orderstatus, o_orderpriority) { o_orderstatus, o_orderpriority, n: count(o_orderkey), top: max(o_totalprice) }"), "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)"),
    "ag8_pricing_summary": (text("SELECT lineitem WHERE l_shipdate <= 1998-09-02 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus { l_returnflag, l_linestatus, sum_qty: sum(l_quantity), sum_base: sum(l_extendedprice), sum_disc: sum(l_extendedprice * (1 - l_discount)), avg_qty: avg(l_quantity), n: count(l_orderkey) }", rounded("sum_qty", "sum_base", "sum_disc", "avg_qty")), "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus"),
    "ag9_exact_avg": (text("SELECT part GROUP BY p_brand { p_brand, mean: avg(p_size), total: sum(p_size) }"), "SELECT p_brand, sum(p_size)::DOUBLE / count(p_size) AS mean, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY p_brand"),
    "ag11_count_distinct": (text("SELECT lineitem GROUP BY l_returnflag { l_returnflag, parts: count(distinct l_partkey) }"), "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag"),
    "ag12_min_max": (text("SELECT orders GROUP BY o_orderpriority { o_orderpriority, first: min(o_orderdate), last: max(o_orderdate), low: min(o_orderstatus) }"), "SELECT o_orderpriority, min(o_orderdate) AS first, max(o_orderdate) AS last, min(o_orderstatus) AS low FROM orders GROUP BY o_orderpriority"),
    "ag13_spread": (text("SELECT part GROUP BY p_brand { p_brand, vp: var_pop(p_size), vs: var_samp(p_size), sp: stddev_pop(p_size), ss: stddev_samp(p_size) }", rounded("vp", "vs", "sp", "ss")), "SELECT p_brand, round(var_pop(p_size), 4) AS vp, round(var_samp(p_size), 4) AS vs, round(stddev_pop(p_size), 4) AS sp, round(stddev_samp(p_size), 4) AS ss FROM part GROUP BY p_brand"),
    "ag15_percentile": (text("SELECT lineitem GROUP BY l_returnflag { l_returnflag, p7: percentile(l_extendedprice, 0.07), p50: percentile(l_extendedprice, 0.5), p99: percentile(l_partkey, 0.99), day: percentile(l_shipdate, 0.5) }"), "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.07) AS p7, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_partkey, 0.99) AS p99, quantile_disc(l_shipdate, 0.5) AS day FROM lineitem GROUP BY l_returnflag"),
    "ag16_rate": (text("SELECT events GROUP BY event_type { event_type, r: rate(1h) }", rounded("r", digits=6), time_field=("ts",)), "SELECT event_type, round(count(*) * 3600.0 / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS r FROM events GROUP BY event_type"),
    "ag17_having": (text("SELECT orders GROUP BY o_custkey HAVING count(o_orderkey) > 15 AND max(o_totalprice) > 300000 { o_custkey, n: count(o_orderkey) }"), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND max(o_totalprice) > 300000"),
    "ag18_having_alias": (text("SELECT orders GROUP BY o_custkey HAVING urgent > 4 AND n < 20 { o_custkey, n: count(o_orderkey), urgent: count(o_orderkey) WHERE o_orderpriority = '1-URGENT' }"), "SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY o_custkey HAVING urgent > 4 AND n < 20"),
    "ag21_over_aggregates": (text("SELECT lineitem GROUP BY l_shipdate HAVING n > 30 { l_shipdate, n: count(l_orderkey), ratio: max(l_partkey) / count(l_partkey), level: WHEN max(l_quantity) > 49 THEN 'high' ELSE 'low' }"), "SELECT l_shipdate, count(*) AS n, max(l_partkey)::DOUBLE / count(*) AS ratio, CASE WHEN max(l_quantity) > 49 THEN 'high' ELSE 'low' END AS level FROM lineitem GROUP BY l_shipdate HAVING count(*) > 30"),
    "wn1_row_number": (text("SELECT customer { c_custkey, r: row_number() OVER PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey }"), "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer"),
    "wn2_rank": (text("SELECT part { p_partkey, r: rank() OVER PARTITION BY p_brand ORDER BY p_size, flat: rank() OVER PARTITION BY p_brand }"), "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, CAST(1 AS BIGINT) AS flat FROM part"),
    "wn3_first_last": (text("SELECT customer { c_custkey, best: first_value(c_custkey) OVER PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey, next: last_value(c_custkey) OVER PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING }"), "SELECT c_custkey, first_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS best, last_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS next FROM customer"),
    "wn4_running": (text("SELECT orders { o_orderkey, n: count(o_orderkey) OVER PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW, keys: sum(o_orderkey) OVER PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING, top: max(o_totalprice) OVER PARTITION BY o_custkey }"), "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS keys, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders"),
    "wn5_percentile": (text("SELECT part { p_partkey, p: percentile(p_size, 0.9) OVER PARTITION BY p_brand }"), "SELECT p_partkey, quantile_disc(p_size, 0.9) OVER (PARTITION BY p_brand) AS p FROM part"),
    "wn6_count_distinct": (text("SELECT part { p_partkey, n: count(distinct p_size) OVER PARTITION BY p_brand }"), "SELECT p_partkey, n FROM part JOIN (SELECT p_brand, count(DISTINCT p_size) AS n FROM part GROUP BY p_brand) USING (p_brand)"),
    "wn7_rate": (text("SELECT events { event_id, r: rate(60s) OVER PARTITION BY event_type }", rounded("r", digits=6), time_field=("ts",)), "SELECT event_id, round(count(*) OVER w * 60.0 / ((epoch_us(max(ts) OVER w) - epoch_us(min(ts) OVER w)) / 1e6), 6) AS r FROM events WINDOW w AS (PARTITION BY event_type)"),
    "wn8_whole_partition": (text("SELECT nation { n_nationkey, s: sum(n_nationkey) OVER PARTITION BY n_regionkey ORDER BY n_nationkey }"), "SELECT n_nationkey, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey) AS BIGINT) AS s FROM nation"),
    "wn10_clamped": (text("SELECT nation { n_nationkey, s: sum(n_nationkey) OVER ORDER BY n_nationkey ROWS BETWEEN 2 FOLLOWING AND 3 FOLLOWING, f: first_value(n_nationkey) OVER ORDER BY n_nationkey ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING }"), "SELECT n_nationkey, CAST(CASE WHEN n_nationkey >= 22 THEN 24 ELSE 2 * n_nationkey + 5 END AS BIGINT) AS s, CAST(greatest(0, n_nationkey - 3) AS INTEGER) AS f FROM nation"),
    "wn11_inverted": (text("SELECT nation { n_nationkey, s: sum(n_nationkey) OVER ORDER BY n_nationkey ROWS BETWEEN 2 FOLLOWING AND 1 PRECEDING, n: count(n_nationkey) OVER ORDER BY n_nationkey ROWS BETWEEN 2 FOLLOWING AND 1 PRECEDING }"), "SELECT n_nationkey, CAST(NULL AS BIGINT) AS s, CAST(0 AS BIGINT) AS n FROM nation"),
    "wn12_group_window": (text("SELECT customer GROUP BY c_nationkey { c_nationkey, n: count(c_custkey), r: rank() OVER ORDER BY n DESC }"), "SELECT c_nationkey, n, rank() OVER (ORDER BY n DESC) AS r FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey)"),
    "so1_order_expression": (text("SELECT part ORDER BY p_retailprice * -1, p_partkey LIMIT 20 { p_name, p_partkey }"), "SELECT p_name, p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20"),
    "so2_top": (text("SELECT orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 { o_orderkey, o_totalprice }"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "so4_offset": (text("SELECT orders ORDER BY o_orderkey LIMIT 10 OFFSET 30 { o_orderkey }"), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30"),
    "so5_distinct": (text("SELECT customer DISTINCT { c_mktsegment, c_nationkey }"), "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer"),
    "so5_distinct_ordered": (text("SELECT customer DISTINCT ORDER BY c_acctbal DESC, c_custkey LIMIT 5 { c_nationkey }"), "SELECT c_nationkey FROM (SELECT c_nationkey, c_acctbal, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1 ORDER BY c_acctbal DESC, c_custkey LIMIT 5"),
    "st1_union": (text("SELECT customer WHERE c_acctbal > 9000 { k: c_nationkey } UNION SELECT supplier WHERE s_acctbal > 9000 { k: s_nationkey }"), "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000"),
    "st2_union_all": (text("SELECT customer WHERE c_acctbal > 9000 { k: c_nationkey } UNION ALL SELECT supplier WHERE s_acctbal > 9000 { k: s_nationkey }"), "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000"),
    "st3_intersect": (text("SELECT customer { k: c_nationkey } INTERSECT SELECT supplier WHERE s_acctbal > 5000 { k: s_nationkey }"), "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000"),
    "st4_except": (text("SELECT nation { k: n_nationkey } EXCEPT SELECT supplier WHERE s_acctbal > 5000 { k: s_nationkey }"), "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000"),
    "st5_chain": (text("SELECT nation { k: n_nationkey } EXCEPT SELECT nation WHERE n_regionkey = 1 { k: n_nationkey } EXCEPT SELECT nation WHERE n_regionkey = 2 { k: n_nationkey }"), "SELECT n_nationkey AS k FROM nation WHERE n_regionkey NOT IN (1, 2)"),
    "ct1_with_twice": (text("WITH both = SELECT nation { k: n_regionkey } UNION ALL SELECT region { k: r_regionkey } SELECT both GROUP BY k { k, n: count(k) }"), "SELECT k, count(*) AS n FROM (SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) GROUP BY k"),
    "ct3_recursive": (text("WITH RECURSIVE below = SELECT hierarchy WHERE id = 3 { id } UNION SELECT hierarchy WHERE parent not= nil AND parent in below.id { id } SELECT below { id }"), "WITH RECURSIVE h AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey > 0 THEN n_nationkey // 2 END AS parent FROM nation), below AS (SELECT id FROM h WHERE id = 3 UNION SELECT h.id FROM h JOIN below ON h.parent = below.id) SELECT id FROM below"),
    "ct4_recursive_source": (text("WITH RECURSIVE count = SELECT region WHERE r_regionkey = 0 { n: r_regionkey + 1 } UNION ALL SELECT count WHERE n < 12 { n: n + 1 } SELECT count { n }".replace("count", "counter")), "SELECT CAST(range AS BIGINT) AS n FROM range(1, 13)"),
    "ex2_exact_division": (text("SELECT part WHERE p_partkey / 3 = 7 OR p_size / 2 > 24.5 { p_partkey, third: p_partkey / 3, text: string(p_partkey / 6) }"), "SELECT p_partkey, p_partkey::DOUBLE / 3 AS third, CASE WHEN p_partkey % 6 = 0 THEN CAST(p_partkey // 6 AS VARCHAR) ELSE CAST(p_partkey // gcd(p_partkey, 6) AS VARCHAR) || '/' || CAST(6 // gcd(p_partkey, 6) AS VARCHAR) END AS text FROM part WHERE p_partkey = 21 OR p_size > 49"),
    "ex3_power": (text("SELECT nation { n_nationkey, square: n_nationkey ** 2, big: (n_nationkey + 1) ** 3 * 2 }"), "SELECT n_nationkey, CAST(n_nationkey AS BIGINT) * n_nationkey AS square, (CAST(n_nationkey AS BIGINT) + 1) * (n_nationkey + 1) * (n_nationkey + 1) * 2 AS big FROM nation"),
    "ex4_bitwise": (text("SELECT nation { n_nationkey, a: n_nationkey & 6, o: n_nationkey | 9, x: !n_nationkey, m: -n_nationkey }"), "SELECT n_nationkey, CAST(n_nationkey & 6 AS BIGINT) AS a, CAST(n_nationkey | 9 AS BIGINT) AS o, CAST(~n_nationkey AS BIGINT) AS x, -n_nationkey AS m FROM nation"),
    "ex6_when": (text("SELECT customer { c_custkey, tier: WHEN c_acctbal > 8000 THEN 'gold' WHEN c_acctbal > 2000 THEN 'silver' ELSE 'none' }"), "SELECT c_custkey, CASE WHEN c_acctbal > 8000 THEN 'gold' WHEN c_acctbal > 2000 THEN 'silver' ELSE 'none' END AS tier FROM customer"),
    "ex7_casts": (text("SELECT part WHERE p_size > 48 { p_partkey, s: string(p_size), i: int(p_retailprice), f: inexact(p_size) / 4, n: int(string(p_size)) }"), "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(trunc(p_retailprice) AS BIGINT) AS i, p_size / 4.0::DOUBLE AS f, CAST(p_size AS BIGINT) AS n FROM part WHERE p_size > 48"),
    "ex11_json": (text("SELECT events WHERE json(props).k > 90 { event_id, k: json(props).k }"), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 90"),
    "ex13_registered_function": (text("SELECT nation WHERE n_regionkey = 2 { big: text.upper(n_name) }"), "SELECT upper(n_name) AS big FROM nation WHERE n_regionkey = 2"),
    "ex15_params": (text("SELECT customer WHERE c_acctbal > $low AND c_mktsegment = $seg { c_custkey }", params={"low": 5000, "seg": "BUILDING"}), "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'"),
    "ex16_literals": (text("SELECT region WHERE r_regionkey = 0b10 { kb: 2KB, kib: 1KiB, ms: inexact(500ms * 4), hex: 0xff, half: 1/2 + 1/3, day: 2024-02-29 }"), "SELECT 2000::BIGINT AS kb, 1024::BIGINT AS kib, 2.0::DOUBLE AS ms, 255::BIGINT AS hex, 5::DOUBLE / 6 AS half, DATE '2024-02-29' AS day FROM region WHERE r_regionkey = 2"),
    "fe3_builder": (built(lambda: from_("orders").where(col("o_totalprice") > 100000, col("o_orderstatus") == "O").group_by("o_orderpriority").having(fn.count(col("o_orderkey")) > 10).select("o_orderpriority", n=fn.count(col("o_orderkey")), late=item(fn.max(col("o_orderdate")), col("o_totalprice") < 200000))), "SELECT o_orderpriority, count(*) AS n, max(o_orderdate) FILTER (WHERE o_totalprice < 200000) AS late FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O' GROUP BY o_orderpriority HAVING count(*) > 10"),
    "fe9_lexical": (text("# a comment\n;with gone = SELECT nowhere { x, SELECT y { z } }\nselect nation where `n_name` = \"KENYA\" or n_name = 'PERU' {\n  n_name\n  n_nationkey,\n}"), "SELECT n_name, n_nationkey FROM nation WHERE n_name IN ('KENYA', 'PERU')"),
    "tc7_declared_types": (text("TYPE hierarchy { id: Int, parent: ?Int, name: String } SELECT hierarchy WHERE parent not= nil AND parent < 4 { id }"), "SELECT n_nationkey AS id FROM nation WHERE n_nationkey > 0 AND n_nationkey // 2 < 4"),
}

QUERIES = {name: run for name, (run, _) in PAIRS.items()}
ORACLES = {name: sql for name, (_, sql) in PAIRS.items() if sql}
