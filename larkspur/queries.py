"""The dialect's queries over the driver's tables, and their DuckDB counterparts.

Most are SQL texts of the dialect that go through the parser and :func:`larkspur.plans.lowering.lower`; ``names``
gives output columns the names that the dialect (which has no AS) can't. The others are the
DataFrame form of an engine operation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import changes
from larkspur.operators.constraints import duplicates, failing, orphans, referenced
from larkspur.plans.lowering import lower
from larkspur.plans.parser import parse_condition, parse_one

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, sql: str, names: list[str] | None = None, null_safe: bool = False) -> DataFrame:
    df = lower(parse_one(sql), lambda name: table(spark, sf_dir, name), null_safe)
    return df.toDF(*names) if names else df


#: Key to dialect text, output names (None: as they come), and DuckDB text (None: the dialect's).
SQL: dict[str, tuple[str, list[str] | None, str | None]] = {
    "scan_all": ("SELECT * FROM region", None, None),
    "project_cols": ("SELECT n_name, n_nationkey FROM nation", None, None),
    "join_self": (
        "SELECT * FROM nation JOIN nation ON nation.n_nationkey = nation.n_regionkey",
        ["l_key", "l_name", "l_region", "r_key", "r_name", "r_region"],
        "SELECT l.n_nationkey AS l_key, l.n_name AS l_name, l.n_regionkey AS l_region, r.n_nationkey AS r_key, r.n_name AS r_name, r.n_regionkey AS r_region FROM nation l JOIN nation r ON l.n_nationkey = r.n_regionkey",
    ),
    "join_self_count": ("SELECT COUNT(*) FROM orders JOIN orders ON orders.o_custkey = orders.o_custkey", ["cnt"], "SELECT count(*) AS cnt FROM orders l JOIN orders r ON l.o_custkey = r.o_custkey"),
    "limit_large": ("SELECT o_orderkey FROM orders WHERE o_custkey < 20 ORDER BY o_orderkey LIMIT 5000000000 OFFSET 3", None, None),
    "filter_eq": ("SELECT * FROM orders WHERE o_custkey = 42", None, None),
    "filter_neq": ("SELECT * FROM nation WHERE n_regionkey != 2", None, None),
    "filter_lt": ("SELECT o_orderkey FROM orders WHERE o_totalprice < 5000", None, None),
    "filter_lteq": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 2", None, None),
    "filter_gt": ("SELECT o_orderkey FROM orders WHERE o_totalprice > 400000", None, None),
    "filter_gteq": ("SELECT p_partkey FROM part WHERE p_size >= 45", None, None),
    "filter_literal_left": ("SELECT p_partkey FROM part WHERE 45 <= p_size", None, None),
    "filter_and": ("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' AND o_custkey < 100", None, None),
    "filter_string_order": ("SELECT o_orderkey FROM orders WHERE o_orderpriority < '2'", None, None),
    "filter_date": (
        "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01 00:00:00' AND o_orderdate < TIMESTAMP '2000-02-01 00:00:00'",
        None,
        "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '2000-01-01' AND o_orderdate < DATE '2000-02-01'",
    ),
    "filter_col_col": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = l_suppkey", None, None),
    "filter_null_cmp": ("SELECT n_name FROM nation WHERE n_nationkey = NULL", None, None),
    "filter_cross_kind": ("SELECT n_name FROM nation WHERE n_nationkey < 'abc' AND n_name != 7", None, "SELECT n_name FROM nation"),
    "in_subquery": ("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", None, None),
    "in_subquery_agg": ("SELECT o_orderkey FROM orders WHERE o_totalprice IN (SELECT MAX(o_totalprice) FROM orders GROUP BY o_custkey)", None, None),
    "in_subquery_nested": (
        "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))",
        None,
        None,
    ),
    "in_subquery_and": ("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders)", None, None),
    "join_inner": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey", ["o_orderkey", "c_name"], None),
    "join_where": (
        "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON orders.o_orderkey = lineitem.l_orderkey WHERE l_quantity > 45 AND o_orderstatus = 'O'",
        ["o_orderkey", "l_linenumber", "l_quantity"],
        None,
    ),
    "join_star": (
        "SELECT * FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey",
        ["n_nationkey", "n_name", "n_regionkey", "r_regionkey", "r_name"],
        None,
    ),
    "join_group": (
        "SELECT n_name, COUNT(*) FROM customer JOIN nation ON customer.c_nationkey = nation.n_nationkey GROUP BY n_name",
        ["n_name", "cnt"],
        "SELECT n_name, count(*) AS cnt FROM customer JOIN nation ON customer.c_nationkey = nation.n_nationkey GROUP BY n_name",
    ),
    "join_distinct_order": (
        "SELECT DISTINCT n_name, r_name FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey WHERE r_name != 'ASIA' ORDER BY n_name DESC LIMIT 7 OFFSET 2",
        ["n_name", "r_name"],
        None,
    ),
    "agg_sum_int_as_double": (
        "SELECT SUM(p_size), AVG(p_size) FROM part",
        ["s", "a"],
        "SELECT sum(CAST(p_size AS DOUBLE)) AS s, avg(CAST(p_size AS DOUBLE)) AS a FROM part",
    ),
    "agg_empty": (
        "SELECT COUNT(*), SUM(p_size), MIN(p_size), MAX(p_size) FROM part WHERE p_size < 0",
        ["c", "s", "mn", "mx"],
        "SELECT count(*) AS c, sum(CAST(p_size AS DOUBLE)) AS s, min(p_size) AS mn, max(p_size) AS mx FROM part WHERE p_size < 0",
    ),
    "agg_group": (
        "SELECT l_returnflag, l_linestatus, COUNT(*), SUM(l_quantity), MIN(l_shipdate), MAX(l_shipdate) FROM lineitem GROUP BY l_returnflag, l_linestatus",
        ["l_returnflag", "l_linestatus", "cnt", "sum_qty", "mn", "mx"],
        "SELECT l_returnflag, l_linestatus, count(*) AS cnt, sum(l_quantity) AS sum_qty, min(l_shipdate) AS mn, max(l_shipdate) AS mx FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
    "group_no_agg": ("SELECT o_orderstatus FROM orders GROUP BY o_orderstatus", None, None),
    "agg_min_max_string": ("SELECT MIN(c_name), MAX(c_name) FROM customer", ["mn", "mx"], "SELECT min(c_name) AS mn, max(c_name) AS mx FROM customer"),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None, None),
    "distinct_after_group": (
        "SELECT DISTINCT COUNT(*) FROM orders GROUP BY o_custkey",
        ["cnt"],
        "SELECT DISTINCT count(*) AS cnt FROM orders GROUP BY o_custkey",
    ),
    "order_limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 10", None, None),
    "order_limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 10 OFFSET 5", None, None),
    "order_offset_only": ("SELECT c_custkey FROM customer ORDER BY c_custkey ASC OFFSET 1490", None, None),
    "limit_zero": ("SELECT * FROM region ORDER BY r_regionkey LIMIT 0", None, None),
    "group_order": (
        "SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey ORDER BY o_custkey DESC LIMIT 20",
        ["o_custkey", "cnt"],
        "SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey ORDER BY o_custkey DESC LIMIT 20",
    ),
}

FLAGSHIP = "SELECT l_returnflag, l_linestatus, COUNT(*), SUM(l_quantity) FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag"


def _over(df: DataFrame, sql: str) -> DataFrame:
    """A dialect text over a derived table."""
    return lower(parse_one(sql), lambda _: df)


def filter_bool(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return _over(good, "SELECT doc_id FROM t WHERE good = TRUE")


def filter_decimal(spark: SparkSession, d: str) -> DataFrame:
    priced = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return _over(priced, "SELECT o_orderkey FROM t WHERE price > DECIMAL '400000.00'")


def _holed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") >= 5, F.col("n_nationkey")).alias("k"))


def join_null_safe(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    left = nation.filter("n_nationkey < 6").select("n_nationkey", F.when(F.col("n_nationkey") >= 2, F.col("n_nationkey")).alias("k"))
    right = nation.filter("n_nationkey < 6").select("n_name", F.when(F.col("n_nationkey") >= 2, F.col("n_nationkey")).alias("j"))
    return lower(parse_one("SELECT n_nationkey, n_name FROM x JOIN y ON x.k = y.j"), {"x": left, "y": right}.__getitem__, null_safe=True).toDF("n_nationkey", "n_name")


def agg_global(spark: SparkSession, d: str) -> DataFrame:
    df = run(spark, d, "SELECT COUNT(*), SUM(o_totalprice), AVG(o_totalprice), MIN(o_totalprice), MAX(o_totalprice) FROM orders", ["cnt", "sum_price", "avg_price", "min_price", "max_price"])
    return df.withColumns({"sum_price": F.round("sum_price", 2), "avg_price": F.round("avg_price", 4)})


def agg_count_col_nulls(spark: SparkSession, d: str) -> DataFrame:
    return _over(_holed(spark, d), "SELECT COUNT(*), COUNT(k) FROM t").toDF("c_all", "c_k")


def distinct_agg(spark: SparkSession, d: str) -> DataFrame:
    counts = run(spark, d, "SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey", ["o_custkey", "cnt"])
    return _over(counts, "SELECT DISTINCT cnt FROM t")


def order_nulls_first_limit(spark: SparkSession, d: str) -> DataFrame:
    return _over(_holed(spark, d), "SELECT k FROM t ORDER BY k ASC LIMIT 5")


def order_nulls_last_desc(spark: SparkSession, d: str) -> DataFrame:
    return _over(_holed(spark, d), "SELECT k FROM t ORDER BY k DESC LIMIT 22")


def distinct_nulls(spark: SparkSession, d: str) -> DataFrame:
    return _over(_holed(spark, d), "SELECT DISTINCT k FROM t")


def in_subquery_nulls(spark: SparkSession, d: str) -> DataFrame:
    holed = _holed(spark, d)
    return lower(parse_one("SELECT n_nationkey FROM t WHERE k IN (SELECT k FROM t)"), lambda _: holed)


def update_copy(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    hit = changes.hits(nation, "nation", parse_condition("n_regionkey = 1"))
    return changes.after_update(nation, hit, {"n_name": F.lit("X")})


def delete_copy(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    return changes.after_delete(nation, changes.hits(nation, "nation", parse_condition("n_regionkey = 1")))


def add_column(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").withColumn("extra", F.lit(None).cast("bigint"))


def drop_column(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").drop("n_name")


def rename_column(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").withColumnRenamed("r_name", "title")


def unique_check(spark: SparkSession, d: str) -> DataFrame:
    return duplicates(table(spark, d, "orders").select("o_custkey"), ["o_custkey"])


def unique_check_composite(spark: SparkSession, d: str) -> DataFrame:
    return duplicates(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), ["l_orderkey", "l_suppkey"])


def fk_check(spark: SparkSession, d: str) -> DataFrame:
    return orphans(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders"), "o_orderkey").select("l_orderkey")


def fk_check_found(spark: SparkSession, d: str) -> DataFrame:
    few = table(spark, d, "nation").filter("n_regionkey <> 3")
    return orphans(table(spark, d, "customer"), "c_nationkey", few, "n_nationkey").select("c_custkey")


def check_violation(spark: SparkSession, d: str) -> DataFrame:
    return failing(table(spark, d, "customer"), "customer", "c_acctbal > 0").select("c_custkey")


def fk_restrict(spark: SparkSession, d: str) -> DataFrame:
    return referenced(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders"), "o_custkey").select("c_custkey")


_HOLED = "(SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN NULL ELSE n_nationkey END AS k FROM nation) t"
DATAFRAME: dict[str, tuple[Query, str]] = {
    "filter_bool": (filter_bool, "SELECT doc_id FROM (SELECT doc_id, quality = 1 AS good FROM labels) t WHERE good = true"),
    "filter_decimal": (filter_decimal, "SELECT o_orderkey FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) > CAST('400000.00' AS DECIMAL(18,2))"),
    "join_null_safe": (
        join_null_safe,
        "SELECT n_nationkey, n_name FROM (SELECT n_nationkey, CASE WHEN n_nationkey >= 2 THEN n_nationkey END AS k FROM nation WHERE n_nationkey < 6) x "
        "JOIN (SELECT n_name, CASE WHEN n_nationkey >= 2 THEN n_nationkey END AS j FROM nation WHERE n_nationkey < 6) y ON x.k IS NOT DISTINCT FROM y.j",
    ),
    "agg_global": (
        agg_global,
        "SELECT count(*) AS cnt, round(sum(o_totalprice), 2) AS sum_price, round(avg(o_totalprice), 4) AS avg_price, min(o_totalprice) AS min_price, max(o_totalprice) AS max_price FROM orders",
    ),
    "agg_count_col_nulls": (agg_count_col_nulls, f"SELECT count(*) AS c_all, count(k) AS c_k FROM {_HOLED}"),
    "distinct_agg": (distinct_agg, "SELECT DISTINCT cnt FROM (SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey) t"),
    "distinct_nulls": (distinct_nulls, f"SELECT DISTINCT k FROM {_HOLED}"),
    "order_nulls_first_limit": (order_nulls_first_limit, f"SELECT k FROM {_HOLED} ORDER BY k ASC NULLS FIRST LIMIT 5"),
    "order_nulls_last_desc": (order_nulls_last_desc, f"SELECT k FROM {_HOLED} ORDER BY k DESC NULLS LAST LIMIT 22"),
    "in_subquery_nulls": (in_subquery_nulls, "SELECT n_nationkey FROM nation WHERE n_nationkey >= 5"),
    "update_copy": (update_copy, "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'X' ELSE n_name END AS n_name, n_regionkey FROM nation"),
    "delete_copy": (delete_copy, "SELECT * FROM nation WHERE NOT coalesce(n_regionkey = 1, false)"),
    "add_column": (add_column, "SELECT *, CAST(NULL AS BIGINT) AS extra FROM region"),
    "drop_column": (drop_column, "SELECT n_nationkey, n_regionkey FROM nation"),
    "rename_column": (rename_column, "SELECT r_regionkey, r_name AS title FROM region"),
    "unique_check": (unique_check, "SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey HAVING count(*) > 1"),
    "unique_check_composite": (unique_check_composite, "SELECT l_orderkey, l_suppkey, count(*) AS cnt FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1"),
    "fk_check": (fk_check, "SELECT l_orderkey FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey"),
    "fk_check_found": (fk_check_found, "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 3)"),
    "fk_restrict": (fk_restrict, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "check_violation": (check_violation, "SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal > 0, false)"),
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, FLAGSHIP, ["l_returnflag", "l_linestatus", "cnt", "sum_qty"])


def _dialect(sql: str, names: list[str] | None) -> Query:
    return lambda spark, d: run(spark, d, sql, names)


QUERIES: dict[str, Query] = {k: _dialect(sql, names) for k, (sql, names, _) in SQL.items()} | {k: f for k, (f, _) in DATAFRAME.items()} | {"flagship": flagship}
ORACLE: dict[str, str] = {k: duck or sql for k, (sql, _, duck) in SQL.items()} | {k: sql for k, (_, sql) in DATAFRAME.items()}
ORACLE["flagship"] = "SELECT l_returnflag, l_linestatus, count(*) AS cnt, sum(l_quantity) AS sum_qty FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus"
