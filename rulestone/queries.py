"""Queries that apply each operator to whole tables, with SQL that must give the same rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators.evaluate import checks, clause_statuses, evaluate, event_trees, exit_code, merge_reports, reports, results, roll_up, tallies
from .operators.reports import (
    by_resource,
    console_lines,
    failed_with_names,
    junit_suites,
    junit_totals,
    resource_details,
    resource_lines,
    sarif_artifacts,
    sarif_results,
    summary,
)
from .operators.rulegen import clauses, distinct_values, generated
from .operators.testing import read_specs, run_tests
from .sources.files import pair_tests, read_payload, read_rules, scan_documents, scan_texts, with_parameters
from .sources.loader import load_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return keep


def rows(name: str, source: str, keys: str, rules: str, statuses: dict[str, str]) -> None:
    """Rules over a table's rows; statuses: SQL of each rule's status."""
    columns = ", ".join(f"{sql} AS {rule}" for rule, sql in statuses.items())

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate(table(spark, sf_dir, source), rules, keys.split(", "))

    add(name, f"SELECT {keys}, {columns} FROM {source}")(query)


def either(condition: str, when: str | None = None) -> str:
    """SQL of a status: PASS or FAIL by a condition, SKIP where `when` doesn't hold."""
    skip = f"WHEN NOT coalesce({when}, false) THEN 'SKIP' " if when else ""
    return f"CASE {skip}WHEN {condition} THEN 'PASS' ELSE 'FAIL' END"


# -- comparators over rows

LINE, ORDER, PART = "l_orderkey, l_linenumber", "o_orderkey", "p_partkey"

rows("b1_eq", "orders", ORDER, "rule r { o_orderstatus == 'F' }", {"r": either("o_orderstatus = 'F'")})
rows("b1_literals", "orders", ORDER, "let f = 'F'\nlet n = [1, 2]\nrule r { %f == 'F'\n o_orderstatus == 'F' }\nrule n { %f != 'F' }\nrule l { %n == [1, 2] }\nrule k { %n == [2, 1] or o_orderstatus == 'O' }\nrule t { %f == 1 }", {"r": either("o_orderstatus = 'F'"), "n": "'FAIL'", "l": "'PASS'", "k": either("o_orderstatus = 'O'"), "t": "'FAIL'"})
rows("b5_neq", "orders", ORDER, "rule r { o_orderstatus != 'F' }", {"r": either("o_orderstatus <> 'F'")})
rows("b6_lt", "lineitem", LINE, "rule r { l_discount < 0.05 }", {"r": either("l_discount < 0.05")})
rows("b7_le", "lineitem", LINE, "rule r { l_discount <= 0.05 }", {"r": either("l_discount <= 0.05")})
rows("b8_gt", "lineitem", LINE, "rule r { l_linenumber > 3 }", {"r": either("l_linenumber > 3")})
rows("b9_ge", "lineitem", LINE, "rule r { l_linenumber >= 3 }", {"r": either("l_linenumber >= 3")})
rows("b11_in_list", "orders", ORDER, "rule r { o_orderpriority in ['1-URGENT', '2-HIGH'] }", {"r": either("o_orderpriority IN ('1-URGENT', '2-HIGH')")})
rows("b15_not_in", "orders", ORDER, "rule r { o_orderpriority not in ['1-URGENT', '2-HIGH'] }", {"r": either("o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")})
rows("b12_substring_in", "orders", ORDER, "rule r { o_orderstatus in 'FO' }\nrule n { o_orderstatus !in 'FO' }", {"r": either("contains('FO', o_orderstatus)"), "n": either("NOT contains('FO', o_orderstatus)")})
rows("b16_regex", "part", PART, "rule r { p_type == /BRASS$/ }\nrule n { p_type != /^(SMALL|LARGE)/ }\nrule l { p_type in [/TIN/, /^ECONOMY/] }", {"r": either("regexp_matches(p_type, 'BRASS$')"), "n": either("NOT regexp_matches(p_type, '^(SMALL|LARGE)')"), "l": either("regexp_matches(p_type, 'TIN') OR regexp_matches(p_type, '^ECONOMY')")})
rows("b17_range", "part", PART, "rule r { p_size in r[1,10) }\nrule e { p_size == r(10,20] }\nrule f { p_retailprice == r[900.0,1500.0] }", {"r": either("p_size >= 1 AND p_size < 10"), "e": either("p_size > 10 AND p_size <= 20"), "f": either("p_retailprice BETWEEN 900 AND 1500")})
rows("f3_scalar_filter", "orders", ORDER, "rule r { o_orderstatus[*][ this == 'F' ] !empty }\nrule s { o_orderstatus[ this == 'F' ] exists }", {"r": either("o_orderstatus = 'F'"), "s": "'FAIL'"})
rows("q1_type_mismatch", "lineitem", LINE, "rule r { l_quantity <= 50 }\nrule n { l_quantity != 1 }\nrule s { l_returnflag == 1 }", {"r": "'FAIL'", "n": "'FAIL'", "s": "'FAIL'"})
rows("b18_literal_map_list", "orders", ORDER, "let allowed = ['F', 'O']\nrule r { o_orderstatus in %allowed }\nrule one { o_orderstatus == ['F'] }\nrule l { o_orderstatus == ['F', 'O'] }", {"r": either("o_orderstatus IN ('F', 'O')"), "one": either("o_orderstatus = 'F'"), "l": "'FAIL'"})
rows("b2_literal_eq_query", "orders", ORDER, "let wanted = 'F'\nrule r { %wanted == o_orderstatus }\nrule n { %wanted != o_orderstatus }", {"r": either("o_orderstatus = 'F'"), "n": either("o_orderstatus <> 'F'")})
rows("b13_literal_in_query", "orders", ORDER, "let wanted = ['F']\nrule r { %wanted in o_orderstatus }", {"r": either("o_orderstatus = 'F'")})
rows("b4_query_eq_query", "lineitem", LINE, "rule r { l_returnflag == l_linestatus }\nrule n { l_returnflag != l_linestatus }\nrule o { l_discount < l_tax }", {"r": either("l_returnflag = l_linestatus"), "n": either("l_returnflag <> l_linestatus"), "o": either("l_discount < l_tax")})

# -- kinds, existence, emptiness

rows("u1_exists", "orders", ORDER, "rule r { o_orderstatus exists }\nrule m { missing exists }\nrule n { missing !exists }\nrule i { not missing exists }", {"r": "'PASS'", "m": "'FAIL'", "n": "'PASS'", "i": "'PASS'"})
rows("u2_empty", "documents", "doc_id", "rule r { text empty }\nrule n { text !empty }\nrule e { n_chars empty }\nrule o { n_chars empty or text !empty }", {"r": either("text = ''"), "n": either("text <> ''"), "e": "'ERROR'", "o": "'ERROR'"})
rows("u4_is_string", "lineitem", LINE, "rule r { l_returnflag is_string }\nrule n { l_quantity is_string }\nrule d { l_shipdate is_string }", {"r": "'PASS'", "n": "'FAIL'", "d": "'PASS'"})
rows("u7_is_int", "lineitem", LINE, "rule r { l_linenumber is_int }\nrule n { l_quantity !is_int }", {"r": "'PASS'", "n": "'PASS'"})
rows("u8_is_float", "lineitem", LINE, "rule r { l_quantity is_float }\nrule n { l_linenumber is_float }", {"r": "'PASS'", "n": "'FAIL'"})
rows("u5_u6_u9_u10_kinds", "embeddings", "vec_id", "rule l { embedding is_list }\nrule s { embedding is_struct }\nrule b { label is_bool }\nrule z { label is_null }\nrule e { embedding !empty }\nrule a { embedding[*] is_float }", {"l": "'PASS'", "s": "'FAIL'", "b": "'FAIL'", "z": either("label IS NULL"), "e": "'PASS'", "a": "'PASS'"})
rows("p2_key_spelling", "orders", ORDER, "rule r { oOrderstatus == 'F' }\nrule k { 'o-orderstatus' exists }\nrule t { OOrderstatus exists }", {"r": either("o_orderstatus = 'F'"), "k": "'PASS'", "t": "'PASS'"})
rows("p7_this", "orders", ORDER, "rule r { this is_struct }\nrule k { this.o_orderstatus == 'F' }", {"r": "'PASS'", "k": either("o_orderstatus = 'F'")})
rows("f4_key_filter", "orders", ORDER, "rule r { this[ keys == /^o_order(status|priority)$/ ] is_string }\nrule n { this[ keys in ['o_custkey'] ] > 10 }\nrule e { this[ keys == /^nothing/ ] exists }\nrule g { this[ keys == /^nothing/ ] empty }", {"r": "'PASS'", "n": either("o_custkey > 10"), "e": "'SKIP'", "g": "'PASS'"})

# -- composition

rows("c1_or", "orders", ORDER, "rule r { o_orderstatus == 'F' or o_totalprice > 100000.0 }\nrule a { o_orderstatus == 'F'\n o_totalprice > 100000.0 }", {"r": either("o_orderstatus = 'F' OR o_totalprice > 100000"), "a": either("o_orderstatus = 'F' AND o_totalprice > 100000")})
MANY = [f"o_custkey == {k}" for k in range(0, 400, 10)]
rows("c1_or_many", "orders", ORDER, f"rule r {{ {' or '.join(MANY)} }}\nrule b {{ this {{ {' or '.join(MANY[:13])} or o_orderstatus == 'F' }} }}", {"r": either("o_custkey < 400 AND o_custkey % 10 = 0"), "b": either("(o_custkey < 130 AND o_custkey % 10 = 0) OR o_orderstatus = 'F'")})
rows("f6_when", "lineitem", LINE, "rule discount_ok when l_returnflag == 'R' { l_discount <= 0.05 }\nrule inner { when l_linestatus == 'O' { l_tax < 0.05 } }", {"discount_ok": either("l_discount <= 0.05", "l_returnflag = 'R'"), "inner": either("l_tax < 0.05", "l_linestatus = 'O'")})
rows(
    "c6_rule_ref",
    "lineitem",
    LINE,
    "rule a when l_returnflag == 'R' { l_discount <= 0.05 }\nrule b {\n a\n}\nrule c {\n not a\n}\nrule d when a { l_tax < 0.05 }",
    {
        "a": either("l_discount <= 0.05", "l_returnflag = 'R'"),
        "b": either("l_returnflag = 'R' AND l_discount <= 0.05"),
        "c": either("NOT (l_returnflag = 'R' AND l_discount <= 0.05)"),
        "d": either("l_tax < 0.05", "l_returnflag = 'R' AND l_discount <= 0.05"),
    },
)
rows("c7_param_rule", "lineitem", LINE, "rule below(x, limit) { %x <= %limit }\nrule r { below(l_discount, 0.05) }\nrule s { below(l_tax, l_discount) }", {"r": either("l_discount <= 0.05"), "s": either("l_tax <= l_discount")})
rows("c9_default_rule", "orders", ORDER, "o_orderstatus in ['F', 'O']\nrule other { o_custkey >= 0 }", {'"default"': either("o_orderstatus IN ('F', 'O')"), "other": either("o_custkey >= 0")})
rows("c11_first_of_name", "orders", ORDER, "rule x when o_orderstatus == 'F' { o_totalprice > 50000.0 }\nrule x when o_orderstatus == 'O' { o_totalprice > 100000.0 }\nrule y {\n x\n}", {'"x#1"': either("o_totalprice > 50000", "o_orderstatus = 'F'"), '"x#2"': either("o_totalprice > 100000", "o_orderstatus = 'O'"), "y": either("(o_orderstatus = 'F' AND o_totalprice > 50000) OR (o_orderstatus = 'O' AND o_totalprice > 100000)")})
rows("q2_leading_not", "orders", ORDER, "rule b { not o_orderstatus == 'F' }\nrule u { not o_orderstatus is_string }", {"b": either("o_orderstatus = 'F'"), "u": "'FAIL'"})


# -- nested documents


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    item = F.struct("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    items = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return table(spark, sf_dir, "orders").join(items, "o_orderkey").select("o_orderkey", "o_orderstatus", "o_totalprice", "items")


def nested_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_orders(spark, sf_dir).select("o_orderkey", F.to_variant_object(F.struct("o_orderstatus", "o_totalprice", "items")).alias("doc"))


def nested(name: str, rules: str, statuses: dict[str, str]) -> None:
    """Rules over orders with their items, as rows and as VARIANT; statuses: SQL over each order's items."""
    columns = ", ".join(f"{sql} AS {rule}" for rule, sql in statuses.items())
    sql = f"SELECT o_orderkey, {columns} FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_totalprice"
    add(name, sql)(lambda spark, sf_dir: evaluate(nested_orders(spark, sf_dir), rules, ["o_orderkey"]))
    add(f"{name}_variant", sql)(lambda spark, sf_dir: evaluate(nested_variants(spark, sf_dir), rules, ["o_orderkey"], "doc"))


nested(
    "f1_filter",
    "let heavy = items[ l_quantity > 40.0 ]\nrule r when %heavy !empty { %heavy.l_discount <= 0.05 }\nrule f { items[ l_returnflag == 'R' ].l_discount < 0.09 }",
    {
        "r": "CASE WHEN count(*) FILTER (l_quantity > 40) = 0 THEN 'SKIP' WHEN bool_and(l_discount <= 0.05) FILTER (l_quantity > 40) THEN 'PASS' ELSE 'FAIL' END",
        "f": "CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'SKIP' WHEN bool_and(l_discount < 0.09) FILTER (l_returnflag = 'R') THEN 'PASS' ELSE 'FAIL' END",
    },
)
nested("f7_some", "rule r { some items[*].l_returnflag == 'R' }\nrule a { items[*].l_returnflag == 'R' }", {"r": either("bool_or(l_returnflag = 'R')"), "a": either("bool_and(l_returnflag = 'R')")})
nested(
    "c3_block",
    "rule r { items[*] { l_quantity > 2.0\n when l_returnflag == 'R' { l_discount < 0.09 } } }\nrule s { some items[*] { l_tax > 0.07\n l_discount > 0.07 } }\nrule e { items[ l_quantity > 49.0 ] !empty { l_tax < 0.08 } }",
    {
        "r": either("bool_and(l_quantity > 2 AND (l_returnflag <> 'R' OR l_discount < 0.09))"),
        "s": either("bool_or(l_tax > 0.07 AND l_discount > 0.07)"),
        "e": "CASE WHEN count(*) FILTER (l_quantity > 49) = 0 THEN 'FAIL' WHEN bool_and(l_tax < 0.08) FILTER (l_quantity > 49) THEN 'PASS' ELSE 'FAIL' END",
    },
)
nested("p3_index", "rule r { items[0].l_linenumber == 1 }\nrule n { items[-1].l_quantity > 20.0 }\nrule m { items[1] exists }", {"r": either("min(l_linenumber) = 1"), "n": either("count(*) > 1 AND (list(l_quantity ORDER BY l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus))[2] > 20"), "m": either("count(*) > 1")})
nested("p4_all_values", "rule r { items.*.l_discount <= 0.08 }\nrule v { items[*].* exists }", {"r": either("bool_and(l_discount <= 0.08)"), "v": "'PASS'"})
nested("a1_x1_count", "let n = count(items[*])\nlet r = count(items[ l_returnflag == 'R' ])\nrule three { %n >= 3 }\nrule none { %r == 0 }", {"three": either("count(*) >= 3"), "none": either("count(*) FILTER (l_returnflag = 'R') = 0")})
nested("j5_theta", "let a = items[ l_returnflag == 'R' ].l_tax\nlet b = items[ l_returnflag != 'R' ].l_discount\nrule r { %a < %b }", {"r": "CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 OR count(*) FILTER (l_returnflag <> 'R') = 0 THEN 'SKIP' WHEN max(l_tax) FILTER (l_returnflag = 'R') < min(l_discount) FILTER (l_returnflag <> 'R') THEN 'PASS' ELSE 'FAIL' END"})
SETS = "CASE WHEN count(*) FILTER (l_quantity > 25) = 0 OR count(*) FILTER (l_quantity <= 25) = 0 THEN 'SKIP' WHEN {} THEN 'PASS' ELSE 'FAIL' END"
FLAGS = "coalesce(list_sort(list(DISTINCT l_returnflag) FILTER (l_quantity {} 25)), [])"
LEFT, RIGHT = FLAGS.format(">"), FLAGS.format("<=")
LETS = "let a = items[ l_quantity > 25.0 ].l_returnflag\nlet b = items[ l_quantity <= 25.0 ].l_returnflag\n"
nested("j2_semi", LETS + "rule r { %a in %b }", {"r": SETS.format(f"list_has_all({RIGHT}, {LEFT})")})
nested("j3_anti", LETS + "rule r { %a not in %b }", {"r": SETS.format(f"NOT list_has_any({RIGHT}, {LEFT})")})
MORE = "count(*) FILTER (l_quantity > 25) > count(*) FILTER (l_quantity <= 25)"
nested("b4_set_eq", LETS + "rule r { %a == %b }", {"r": SETS.format(f"CASE WHEN {MORE} THEN list_has_all({RIGHT}, {LEFT}) ELSE list_has_all({LEFT}, {RIGHT}) END")})
nested("j6_correlated", "let top = items[0].l_linestatus\nrule r { items[ l_linestatus == %top ].l_quantity > 3.0 }", {"r": "CASE WHEN bool_and(l_quantity > 3) FILTER (l_linestatus = first_status) THEN 'PASS' ELSE 'FAIL' END"})
SQL["j6_correlated"] = SQL["j6_correlated_variant"] = """
SELECT o_orderkey, CASE WHEN bool_and(l_quantity > 3) FILTER (l_linestatus = top) THEN 'PASS' ELSE 'FAIL' END AS r
FROM (SELECT l_orderkey AS o_orderkey, l_quantity, l_linestatus, first_value(l_linestatus) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS top FROM lineitem)
JOIN orders USING (o_orderkey) GROUP BY o_orderkey"""


def by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each order: its largest discount by return flag, as a map."""
    tops = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max("l_discount").alias("top"))
    flags = F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_returnflag", F.struct("top")))))
    docs = tops.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(flags.alias("flags"))
    return docs.withColumn("names", F.create_map(F.lit("A"), F.lit("back"), F.lit("N"), F.lit("kept"), F.lit("R"), F.lit("back")))


CAPTURES = "rule some_back { some flags[ flag | top > 0.05 ] exists\n some names.%flag == 'back' }\nrule all_of { flags[ every ].top >= 0.0\n some %every == 'N' }"
TOPS = "(SELECT l_orderkey AS o_orderkey, l_returnflag AS flag, max(l_discount) AS top FROM lineitem GROUP BY ALL)"


@add(
    "p6_capture",
    f"""SELECT o_orderkey, CASE WHEN count(*) FILTER (top > 0.05) = 0 THEN 'SKIP' WHEN bool_or(flag <> 'N') FILTER (top > 0.05) THEN 'PASS' ELSE 'FAIL' END AS some_back,
    CASE WHEN bool_or(flag = 'N') THEN 'PASS' ELSE 'FAIL' END AS all_of FROM {TOPS} GROUP BY o_orderkey""",
)
def p6_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a filter lets through, and all keys, used behind the query that names them."""
    return evaluate(by_flag(spark, sf_dir), CAPTURES, ["o_orderkey"])


@add(
    "b18_maps",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS r, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'FAIL' ELSE 'PASS' END AS n, 'FAIL' AS k, CASE WHEN o_orderstatus = 'F' THEN 'PASS' ELSE 'FAIL' END AS l FROM orders",
)
def b18_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps against literal maps, and lists of maps."""
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_orderstatus", (F.col("o_custkey") % 2).alias("odd")).alias("m"), F.array(F.struct("o_orderstatus")).alias("l"))
    rules = "rule r { m == {o_orderstatus: 'F', odd: 0} }\nrule n { m != {odd: 0, o_orderstatus: 'F'} }\nrule k { m == {o_orderstatus: 'F'} }\nrule l { l == [{o_orderstatus: 'F'}] }"
    return evaluate(docs, rules, ["o_orderkey"])


@add("j1_lookup", "SELECT n_nationkey, CASE WHEN r_name = 'ASIA' THEN 'PASS' ELSE 'FAIL' END AS asia, 'PASS' AS known FROM nation JOIN region ON n_regionkey = r_regionkey")
def j1_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one part of a document look up values of another: here regions by name."""
    regions = table(spark, sf_dir, "region")
    by_key = regions.agg(F.map_from_entries(F.collect_list(F.struct(F.col("r_regionkey").cast("string"), F.struct("r_name")))).alias("regions"))
    docs = table(spark, sf_dir, "nation").withColumn("wanted", F.array(F.col("n_regionkey").cast("string"))).crossJoin(F.broadcast(by_key))  # one row
    rules = "let keys = wanted[*]\nlet found = regions.%keys\nrule asia { %found.r_name == 'ASIA' }\nrule known { regions.%keys exists }"
    return evaluate(docs, rules, ["n_nationkey"])


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each order: its items as resources, Type by return flag."""
    lines = table(spark, sf_dir, "lineitem")
    properties = F.struct(F.col("l_quantity").alias("Quantity"), F.col("l_discount").alias("Discount"), F.col("l_linestatus").alias("Status"))
    resource = F.struct(F.concat(F.lit("Item::Line::"), "l_returnflag").alias("Type"), properties.alias("Properties"))
    docs = lines.groupBy(F.col("l_orderkey").alias("name")).agg(F.array_sort(F.collect_list(resource)).alias("all"))
    named = F.map_from_entries(F.transform("all", lambda r, i: F.struct(F.concat(F.lit("line"), i + 1).alias("key"), r.alias("value"))))
    return docs.select(F.col("name").cast("string").alias("name"), F.to_variant_object(F.struct(named.alias("Resources"))).alias("document"))


NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_quantity, l_discount, l_linestatus) AS nr FROM lineitem)"
TYPES = "Item::Line::R { Properties.Discount <= 0.08 <<too much>> }\nrule lines { Item::Line::A when Resources exists { Properties { Quantity > 1.0\n Discount < 0.1 } } }"


@add(
    "f5_c10_type_block",
    """SELECT CAST(l_orderkey AS VARCHAR) AS name,
    CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'SKIP' WHEN bool_and(l_discount <= 0.08) FILTER (l_returnflag = 'R') THEN 'PASS' ELSE 'FAIL' END AS "default",
    CASE WHEN count(*) FILTER (l_returnflag = 'A') = 0 THEN 'SKIP' WHEN bool_and(l_quantity > 1 AND l_discount < 0.1) FILTER (l_returnflag = 'A') THEN 'PASS' ELSE 'FAIL' END AS lines
    FROM lineitem GROUP BY l_orderkey""",
)
def f5_type_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(templates(spark, sf_dir), TYPES, ["name"], "document")


@add(
    "k15_checks",
    f"""SELECT CAST(l_orderkey AS VARCHAR) AS name, 'default' AS rule, '/Resources/line' || nr || '/Properties/Discount' AS path,
    'too much' AS custom_message FROM {NUMBERED} WHERE l_returnflag = 'R' AND l_discount > 0.08""",
)
def k15_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks(templates(spark, sf_dir), TYPES, ["name"], "document")
    return found.filter(F.col("rule") == "default").select("name", "rule", "path", "custom_message")


@add(
    "a9_k3_by_resource",
    f"""SELECT CAST(l_orderkey AS VARCHAR) AS name, 'line' || nr AS resource, count(*) AS n_checks FROM {NUMBERED}
    WHERE l_returnflag = 'R' AND l_discount > 0.08 GROUP BY ALL""",
)
def a9_by_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = failed_with_names(templates(spark, sf_dir), TYPES.split("\nrule")[0], "name", "document")
    return by_resource(failed).select("name", "resource", "n_checks")


@add(
    "k9_a12_sarif",
    f"""SELECT 'DEFAULT' AS "ruleId", 'error' AS level, CAST(l_orderkey AS VARCHAR) AS uri, nr * 10 AS "startLine", 3 AS "startColumn",
    'Check was not compliant as property value [Path=/Resources/line' || nr || '/Properties/Discount Value=' || CAST(l_discount AS VARCHAR) || '] not less than equal to value [0.08]. too much' AS text
    FROM {NUMBERED} WHERE l_returnflag = 'R' AND l_discount > 0.08
    UNION ALL SELECT 'ARTIFACT', NULL, CAST(l_orderkey AS VARCHAR), NULL, NULL, NULL FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08 GROUP BY l_orderkey""",
)
def k9_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results at the places of their values, with their texts, and each document with results once."""
    docs = templates(spark, sf_dir)
    found = sarif_results(failed_with_names(docs, TYPES.split("\nrule")[0], "name", "document"), places(docs))
    artifacts = sarif_artifacts(found).select(F.lit("ARTIFACT").alias("ruleId"), "uri")
    return found.select("ruleId", "level", "uri", "startLine", "startColumn", "text").unionByName(artifacts, allowMissingColumns=True)


def places(docs: DataFrame) -> DataFrame:
    """name, path, line, column: the discount of the nth line of an order stands in line 10 n, column 3."""
    keys = F.map_keys(F.try_variant_get("document", "$.Resources", "map<string,variant>"))
    each = docs.select("name", F.explode(keys).alias("key"))
    line = F.regexp_replace("key", "^line", "").cast("int") * 10
    return each.select("name", F.concat(F.lit("/Resources/"), "key", F.lit("/Properties/Discount")).alias("path"), line.alias("line"), F.lit(3).alias("column"))


@add(
    "k15_messages",
    f"""SELECT CAST(l_orderkey AS VARCHAR) AS name, '/Resources/line' || nr || '/Properties/Discount' AS path, 'Properties.Discount <= 0.08' AS clause, 1 AS line,
    CAST(l_discount AS VARCHAR) AS value, '0.08' AS compared, 'too much' AS custom_message,
    'Check was not compliant as property value [Path=/Resources/line' || nr || '/Properties/Discount Value=' || CAST(l_discount AS VARCHAR) || '] not less than equal to value [0.08].' AS message
    FROM {NUMBERED} WHERE l_returnflag = 'R' AND l_discount > 0.08""",
)
def k15_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks(templates(spark, sf_dir), TYPES.split("\nrule")[0], ["name"], "document")
    return found.select("name", "path", "clause", "line", "value", "compared", "custom_message", "message")


@add(
    "k3_k18_resource_report",
    f"""WITH bad AS (SELECT *, 'line' || nr AS resource FROM {NUMBERED} WHERE l_returnflag = 'R' AND l_discount > 0.08), line AS (
    SELECT l_orderkey, resource, 1 AS k, '  Resource = ' || resource || ' {{' AS line FROM bad UNION ALL SELECT l_orderkey, resource, 2, '    Type = Item::Line::R' FROM bad
    UNION ALL SELECT l_orderkey, resource, 3, '    default: Properties.Discount <= 0.08' FROM bad UNION ALL SELECT l_orderkey, resource, 4, '      PropertyPath    = Properties/Discount' FROM bad
    UNION ALL SELECT l_orderkey, resource, 5, '      Value           = ' || CAST(l_discount AS VARCHAR) FROM bad UNION ALL SELECT l_orderkey, resource, 6, '      ComparedWith    = 0.08' FROM bad
    UNION ALL SELECT l_orderkey, resource, 7, '      Message         = too much' FROM bad UNION ALL SELECT l_orderkey, resource, 8, '  }}' FROM bad
    UNION ALL SELECT l_orderkey, '', 0, 'Number of non-compliant resources ' || count(*) FROM bad GROUP BY l_orderkey)
    SELECT CAST(l_orderkey AS VARCHAR) AS name, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY resource, k) - 1 AS INTEGER) AS seq, line FROM line""",
)
def k3_resource_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = templates(spark, sf_dir)
    return resource_lines(resource_details(failed_with_names(docs, TYPES.split("\nrule")[0], "name", "document"), docs))


@add(
    "k4_plan_report",
    """SELECT CAST(o_orderkey AS VARCHAR) AS name, 'plan' AS layout, 'order.o' || o_orderkey AS resource, 'order' AS type, 'r' AS rule, 'price' AS property, CAST(o_totalprice AS VARCHAR) AS value
    FROM orders WHERE o_totalprice >= 150000""",
)
def k4_plan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of one change for each order."""
    change = F.struct(
        F.concat(F.lit("order.o"), "o_orderkey").alias("address"), F.lit("order").alias("type"), F.struct(F.struct(F.col("o_totalprice").alias("price")).alias("after")).alias("change")
    )
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), F.to_variant_object(F.struct(F.array(change).alias("resource_changes"))).alias("document"))
    failed = failed_with_names(docs, "rule r { resource_changes[*].change.after.price < 150000.0 }", "name", "document")
    return resource_details(failed, docs).select("name", "layout", "resource", "type", "rule", "property", "value")


# -- functions


def functions(name: str, source: str, keys: str, rules: str, statuses: dict[str, str]) -> None:
    rows(name, source, keys, rules, statuses)


functions("x2_join", "part", PART, "let j = join(p_name, '-')\nrule r { %j == /a/ }", {"r": either("contains(p_name, 'a')")})
functions("x3_json_parse", "events", "event_id", "let p = json_parse(props)\nrule r { %p.k > 50 }\nrule i { %p.k is_int }", {"r": either("CAST(json_extract(props, '$.k') AS BIGINT) > 50"), "i": "'PASS'"})
functions("x4_regex_replace", "part", PART, "let d = regex_replace(p_brand, '^Brand#([0-9])([0-9])$', '${2}x${1}')\nrule r { %d == '1x1' }\nrule e { %d exists }", {"r": either("regexp_replace(p_brand, '^Brand#([0-9])([0-9])$', '\\2x\\1') = '1x1'"), "e": "'PASS'"})
functions("x5_substring", "part", PART, "let s = substring(p_type, 0, 3)\nrule r { %s == 'SMA' }\nlet far = substring(p_type, 500, 501)\nrule f { %far exists }", {"r": either("substr(p_type, 1, 3) = 'SMA'"), "f": "'SKIP'"})
functions("x6_x7_case", "part", PART, "let l = to_lower(p_type)\nlet u = to_upper(p_name)\nrule r { %l == /brass/ }\nrule s { %u == /^[^a-z]*$/ }", {"r": either("contains(lower(p_type), 'brass')"), "s": "'PASS'"})
functions("x8_url_decode", "pages", "page_id", "let u = url_decode(url)\nrule r { %u == /^https:/ }", {"r": either("starts_with(url, 'https:')")})
functions("x9_parse_int", "part", PART, "let n = parse_int(substring(p_brand, 6, 7))\nrule r { %n >= 3 }\nlet f = parse_int(p_retailprice)\nrule f { %f > 1000 }\nlet b = parse_int(p_brand)\nrule bad { %b > 1 }", {"r": either("CAST(substr(p_brand, 7, 1) AS INTEGER) >= 3"), "f": either("trunc(p_retailprice) > 1000"), "bad": "'ERROR'"})
functions("x10_parse_float", "part", PART, "let n = parse_float(p_size)\nrule r { %n > 10.5 }", {"r": either("p_size > 10.5")})
functions("x11_parse_boolean", "orders", ORDER, "let b = parse_boolean('True')\nrule r { %b == true }\nlet c = parse_boolean(o_orderstatus)\nrule bad { %c == true }", {"r": "'PASS'", "bad": "'ERROR'"})
functions("x12_parse_string", "part", PART, "let s = parse_string(p_size)\nrule r { %s == /^1/ }", {"r": either("starts_with(CAST(p_size AS VARCHAR), '1')")})
functions("x13_parse_char", "orders", ORDER, "let c = parse_char(o_orderstatus)\nrule r { %c == r(E,G) }\nlet d = parse_char('x')\nrule x { %d exists }", {"r": either("o_orderstatus = 'F'"), "x": "'PASS'"})
functions("x14_parse_epoch", "events", "event_id", "let t = parse_epoch(ts)\nrule r { %t > 1704153600 }", {"r": either("floor(epoch(ts)) > 1704153600")})
functions("x15_now", "region", "r_regionkey", "let t = now()\nrule r { %t > 1700000000 }", {"r": "'PASS'"})

rows("x2_x4_x5_queries", "part", PART, "let j = join(this[ keys in ['p_name', 'p_brand'] ], p_type)\nlet s = substring(p_type, p_one, p_size)\nlet r = regex_replace(p_type, p_brand, p_name)\nrule j { %j exists }\nrule r { %r exists }", {"j": "'PASS'", "r": "'PASS'"})
functions("x11_parse_boolean_query", "orders", ORDER, "let w = json_parse('{\"a\": \"TRUE\", \"b\": \"false\"}')\nlet b = parse_boolean(%w.*)\nrule some_true { some %b == true }\nrule every { %b == true or o_orderstatus == 'F' }", {"some_true": "'PASS'", "every": either("o_orderstatus = 'F'")})

# -- policies over whole tables

rows(
    "pages_url_policy",
    "pages",
    "page_id",
    "rule https { url == /^https:\\/\\// <<pages are served over TLS>> }\nrule clean { url != /[?#]/ }\nrule page when url == /^https:/ { html == /<title>/\n html !empty }",
    {"https": either("starts_with(url, 'https://')"), "clean": either("NOT regexp_matches(url, '[?#]')"), "page": either("contains(html, '<title>') AND html <> ''", "starts_with(url, 'https:')")},
)
rows(
    "doc_policy",
    "documents",
    "doc_id",
    "rule length { n_chars in r[200,20000] }\nrule lang { lang in ['en', 'de', 'fr', 'es'] }\nrule secrets { text != /(AKIA[0-9A-Z]{12,}|BEGIN [A-Z ]*PRIVATE KEY)/ }\nrule all {\n length\n lang\n secrets\n}",
    {
        "length": either("n_chars BETWEEN 200 AND 20000"),
        "lang": either("lang IN ('en', 'de', 'fr', 'es')"),
        "secrets": either("NOT regexp_matches(text, '(AKIA[0-9A-Z]{12,}|BEGIN [A-Z ]*PRIVATE KEY)')"),
        '"all"': either("n_chars BETWEEN 200 AND 20000 AND lang IN ('en', 'de', 'fr', 'es') AND NOT regexp_matches(text, '(AKIA[0-9A-Z]{12,}|BEGIN [A-Z ]*PRIVATE KEY)')"),
    },
)


@add(
    "conversation_policy",
    """SELECT conv_id, CASE WHEN arg_min(role, turn) = 'user' THEN 'PASS' ELSE 'FAIL' END AS first,
    CASE WHEN bool_and(text <> '') THEN 'PASS' ELSE 'FAIL' END AS said, CASE WHEN count(*) >= 2 THEN 'PASS' ELSE 'FAIL' END AS answered
    FROM conversations GROUP BY conv_id""",
)
def conversation_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return evaluate(turns, "let n = count(turns[*])\nrule first { turns[0].role == 'user' }\nrule said { turns[*].text !empty }\nrule answered { %n >= 2 }", ["conv_id"])


# -- roll-ups and reports

GRADES = "rule price { o_totalprice < 150000.0 }\nrule open when o_orderstatus == 'O' { o_orderpriority != '1-URGENT' }"
PRICE, OPEN = either("o_totalprice < 150000"), either("o_orderpriority <> '1-URGENT'", "o_orderstatus = 'O'")
LONG = f"(SELECT o_orderkey, o_custkey, o_orderstatus, 'price' AS rule, {PRICE} AS status FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, 'open', {OPEN} FROM orders)"


@add("a4_rollup", f"SELECT o_custkey, rule, CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'PASS' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'PASS' ELSE 'SKIP' END AS status FROM {LONG} GROUP BY o_custkey, rule")
def a4_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll_up(table(spark, sf_dir, "orders"), GRADES, ["o_custkey"])


@add("a5_tallies", f"SELECT o_orderstatus, rule, status, count(*) AS n FROM {LONG} GROUP BY o_orderstatus, rule, status")
def a5_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies(table(spark, sf_dir, "orders"), GRADES, ["o_orderstatus"])


@add("k2_results", f"SELECT o_orderkey, rule, status FROM {LONG}")
def k2_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(table(spark, sf_dir, "orders"), GRADES, ["o_orderkey"])


@add(
    "k10_clause_statuses",
    """SELECT o_orderkey, 'price' AS rule, 0 AS seq, 'o_totalprice < 150000.0' AS clause, CASE WHEN o_totalprice < 150000 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders
    UNION ALL SELECT o_orderkey, 'open', 0, 'when o_orderstatus == ''O''', CASE WHEN o_orderstatus = 'O' THEN 'PASS' ELSE 'FAIL' END FROM orders
    UNION ALL SELECT o_orderkey, 'open', 1, 'o_orderpriority != ''1-URGENT''',
    CASE WHEN o_orderstatus <> 'O' THEN 'SKIP' WHEN o_orderpriority <> '1-URGENT' THEN 'PASS' ELSE 'FAIL' END FROM orders""",
)
def k10_clause_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clause_statuses(table(spark, sf_dir, "orders"), GRADES, ["o_orderkey"])


@add(
    "k11_event_trees",
    """SELECT o_orderkey, 'rules' AS file, '{"context":"rules","status":"' || top || '","children":[{"context":"rule price","status":"' || p || '","children":[{"context":"o_totalprice < 150000.0","status":"' || p ||
    '","children":[]}]},{"context":"rule open","status":"' || o || '","children":[{"context":"o_orderstatus == ''O''","status":"' || w || '","children":[]}' ||
    CASE WHEN w = 'PASS' THEN ',{"context":"o_orderpriority != ''1-URGENT''","status":"' || o || '","children":[]}' ELSE '' END || ']}]}' AS events
    FROM (SELECT *, CASE WHEN p = 'FAIL' OR o = 'FAIL' THEN 'FAIL' ELSE 'PASS' END AS top FROM (SELECT o_orderkey, CASE WHEN o_totalprice < 150000 THEN 'PASS' ELSE 'FAIL' END AS p,
    CASE WHEN o_orderstatus = 'O' THEN 'PASS' ELSE 'FAIL' END AS w, CASE WHEN o_orderstatus <> 'O' THEN 'SKIP' WHEN o_orderpriority <> '1-URGENT' THEN 'PASS' ELSE 'FAIL' END AS o FROM orders))""",
)
def k11_event_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_trees(table(spark, sf_dir, "orders"), GRADES, ["o_orderkey"])


TREE = """'{"context":"items[*] { ... }","status":"' || CASE WHEN bool_and(l_quantity > 2) THEN 'PASS' ELSE 'FAIL' END || '","children":[' || string_agg('{"context":"block","status":"' || s || '","children":[{"context":"l_quantity > 2.0","status":"' || s || '","children":[]}]}', ',' ORDER BY l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) || ']}'"""


@add(
    "k10_nested_events",
    f"""SELECT o_orderkey, '{{"context":"rules","status":"' || CASE WHEN bool_and(l_quantity > 2) THEN 'PASS' ELSE 'FAIL' END || '","children":[{{"context":"rule r","status":"' ||
    CASE WHEN bool_and(l_quantity > 2) THEN 'PASS' ELSE 'FAIL' END || '","children":[' || {TREE} || ']}}]}}' AS events
    FROM (SELECT *, CASE WHEN l_quantity > 2 THEN 'PASS' ELSE 'FAIL' END AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY o_orderkey""",
)
def k10_nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_trees(nested_orders(spark, sf_dir), "rule r { items[*] { l_quantity > 2.0 } }", ["o_orderkey"]).drop("file")


PRICES = f"(SELECT o_orderkey, {PRICE} AS p, {OPEN} AS o FROM orders)"


@add(
    "k2_k5_console",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS name, string_agg(line, chr(10) ORDER BY k) AS said FROM (
    SELECT o_orderkey, 0 AS k, CAST(o_orderkey AS VARCHAR) || ' Status = ' || CASE WHEN p = 'FAIL' OR o = 'FAIL' THEN 'FAIL' ELSE 'PASS' END AS line FROM {PRICES}
    UNION ALL SELECT o_orderkey, 1, '  FAIL price' FROM {PRICES} WHERE p = 'FAIL'
    UNION ALL SELECT o_orderkey, 2, '    o_totalprice < 150000.0 at line 1: Check was not compliant as property value [Path=/o_totalprice Value=' || CAST(o_totalprice AS VARCHAR) || '] not less than value [150000.0].' FROM orders WHERE o_totalprice >= 150000
    UNION ALL SELECT o_orderkey, 3, '  FAIL open' FROM {PRICES} WHERE o = 'FAIL'
    UNION ALL SELECT o_orderkey, 4, '    o_orderpriority != ''1-URGENT'' at line 2: Check was not compliant as property value [Path=/o_orderpriority Value="1-URGENT"] equal to value ["1-URGENT"].' FROM {PRICES} WHERE o = 'FAIL'
    UNION ALL SELECT o_orderkey, 5, '  PASS open' FROM {PRICES} WHERE o = 'PASS' UNION ALL SELECT o_orderkey, 6, '  PASS price' FROM {PRICES} WHERE p = 'PASS'
    UNION ALL SELECT o_orderkey, 7, '  SKIP open' FROM {PRICES} WHERE o = 'SKIP') GROUP BY o_orderkey""",
)
def k2_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = console_lines(reports(table(spark, sf_dir, "orders"), GRADES, "o_orderkey"))
    whole = lines.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("all"))
    return whole.select("name", F.array_join(F.col("all.line"), "\n").alias("said"))


@add(
    "k8_a7_junit",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS name, 2 AS tests, CAST(p = 'FAIL' AS INTEGER) + CAST(o = 'FAIL' AS INTEGER) AS failures, 0 AS errors FROM {PRICES}
    UNION ALL SELECT 'all', count(*) * 2, count(*) FILTER (p = 'FAIL') + count(*) FILTER (o = 'FAIL'), 0 FROM {PRICES}""",
)
def k8_junit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suites of two rule files and the totals of all."""
    orders = table(spark, sf_dir, "orders")
    suites = junit_suites({f"r{i}.guard": reports(orders, f"rule {r}", "o_orderkey") for i, r in enumerate(GRADES.split("rule ")[1:])})
    return suites.drop("xml").unionByName(junit_totals(suites).select(F.lit("all").alias("name"), "*"))


@add("k1_exit_codes", f"SELECT 19 AS failing, 0 AS passing, 5 AS wrong FROM {PRICES} HAVING bool_or(p = 'FAIL')")
def k1_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    codes = [exit_code(orders, r) for r in (GRADES, "rule r { o_orderkey >= 0 }", "rule r { o_orderkey empty }")]
    return spark.createDataFrame([tuple(codes)], "failing int, passing int, wrong int")


@add("k6_summary", f"SELECT o_orderkey, rule, status FROM {LONG} WHERE status IN ('PASS', 'FAIL')")
def k6_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "orders"), GRADES, "o_orderkey", show=("pass", "fail"))


REPORT = f"""SELECT CAST(o_orderkey AS VARCHAR) AS name,
CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'PASS') THEN 'PASS' ELSE 'SKIP' END AS status,
coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (status = 'FAIL'), '') AS failed,
coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (status = 'SKIP'), '') AS skipped,
coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (status = 'PASS'), '') AS passed FROM {LONG} GROUP BY o_orderkey"""


def shown(report: DataFrame) -> DataFrame:
    failed = F.array_join(F.array_sort(F.col("not_compliant.name")), ",")
    return report.select("name", "status", failed.alias("failed"), F.array_join("not_applicable", ",").alias("skipped"), F.array_join("compliant", ",").alias("passed"))


@add("k7_k16_report", REPORT)
def k16_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(reports(table(spark, sf_dir, "orders"), GRADES, "o_orderkey"))


@add("a6_merge_reports", REPORT)
def a6_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    parts = [reports(orders, r, "o_orderkey") for r in ("rule " + GRADES.split("rule ")[1], "rule " + GRADES.split("rule ")[2])]
    return shown(merge_reports(parts[0].union(parts[1])))


# -- rule generation, tests, sources


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    each = F.array(F.struct(F.lit("Brand").alias("property"), F.concat(F.lit('"'), "p_brand", F.lit('"')).alias("value")), F.struct(F.lit("Size").alias("property"), F.col("p_size").cast("string").alias("value")))
    return part.select(F.split("p_type", " ")[0].alias("type"), F.explode(each).alias("e")).select("type", "e.property", "e.value")


@add(
    "a8_rulegen",
    """WITH pair AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS type, 'Brand' AS property, '"' || p_brand || '"' AS value FROM part
    UNION SELECT DISTINCT split_part(p_type, ' ', 1), 'Size', CAST(p_size AS VARCHAR) FROM part)
    SELECT type, property, '%' || lower(type) || '_resources.Properties.' || property ||
    CASE WHEN count(*) > 1 THEN ' IN [' || string_agg(value, ', ' ORDER BY value) || ']' ELSE ' == ' || min(value) END AS clause FROM pair GROUP BY type, property""",
)
def a8_rulegen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(distinct_values(part_pairs(spark, sf_dir)))


@add(
    "k13_generated_rules",
    """WITH v AS (SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem), c AS (SELECT f, CASE WHEN count(*) > 1
    THEN ' IN [' || string_agg('"' || s || '"', ', ' ORDER BY s) || ']' ELSE ' == "' || min(s) || '"' END AS tail FROM v GROUP BY f)
    SELECT 'Item::Line::' || f AS type, 'let item_line_' || lower(f) || '_resources = Resources.*[ Type == ''Item::Line::' || f || ''' ]' || chr(10) ||
    'rule item_line_' || lower(f) || ' when %item_line_' || lower(f) || '_resources !empty {' || chr(10) ||
    '  %item_line_' || lower(f) || '_resources.Properties.Status' || tail || chr(10) || '}' || chr(10) AS rules FROM c""",
)
def k13_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    resource = F.struct(F.concat(F.lit("Item::Line::"), "l_returnflag").alias("Type"), F.struct(F.col("l_linestatus").alias("Status")).alias("Properties"))
    docs = lines.select(F.to_variant_object(F.struct(F.create_map(F.lit("one"), resource).alias("Resources"))).alias("document"))
    return generated(docs)


@add(
    "m2_j9_run_tests",
    f"""SELECT CAST(o_orderkey AS INTEGER) AS case_id, rule, CASE WHEN rule = 'price' THEN 'PASS' END AS expected, status AS evaluated,
    CASE WHEN rule <> 'price' THEN 'NONE' WHEN status = 'PASS' THEN 'PASS' ELSE 'FAIL' END AS outcome FROM {LONG}""",
)
def m2_run_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a test case that expects the rule price to PASS."""
    orders = table(spark, sf_dir, "orders")
    document = F.to_variant_object(F.struct("o_totalprice", "o_orderstatus", "o_orderpriority"))
    specs = orders.select(
        F.col("o_orderkey").cast("int").alias("case_id"), F.lit("order").alias("name"), document.alias("document"), F.create_map(F.lit("price"), F.lit("PASS")).alias("expectations")
    )
    return run_tests(specs, GRADES).select("case_id", "rule", "expected", F.get("evaluated", F.lit(0)).alias("evaluated"), "outcome")


def yaml_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit("'"), "p_name", F.lit("'"))
    lines = [F.lit("Name: "), quoted, F.lit("\nSize: "), F.col("p_size"), F.lit("\nPrice: "), F.format_string("%.2f", "p_retailprice"), F.lit("\nTags: [yes, ~, !Ref x]\nEmpty:\n")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.concat(*lines).alias("content"))


@add(
    "s6_s8_load_yaml",
    """SELECT CAST(p_partkey AS VARCHAR) AS name, 'PASS' AS kinds, CASE WHEN p_size > 25 THEN 'PASS' ELSE 'FAIL' END AS size, 'PASS' AS tags FROM part""",
)
def s6_load_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_documents(yaml_texts(spark, sf_dir))
    rules = "rule kinds { Name is_string\n Size is_int\n Price is_float\n Empty == '' }\nrule size { Size > 25 }\nrule tags { Tags[0] == true\n Tags[1] is_null\n Tags[2].Ref == 'x' }"
    return evaluate(docs, rules, ["name"], "document")


NATIONS = "(SELECT *, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation)"


@add("s4_payload", f"SELECT 'DATA_STDIN[' || k || ']' AS name, 'asia' AS rule, CASE WHEN n_regionkey = 2 THEN 'PASS' ELSE 'FAIL' END AS status FROM {NATIONS} UNION ALL SELECT 'DATA_STDIN[' || k || ']', 'named', 'PASS' FROM {NATIONS}")
def s4_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload of two rule texts and a document for each nation."""
    data = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))), lambda x: F.to_json(x))
    texts = F.array(F.lit("rule asia { n_regionkey == 2 }"), F.lit("rule named { n_name !empty }"))
    payload = table(spark, sf_dir, "nation").agg(data.alias("data")).select(F.to_json(F.struct(texts.alias("rules"), "data")).alias("value"))
    rules, docs = read_payload(spark, payload)
    return results(docs, rules, ["name"], "document")


@add("s5_t4_j8_parameters", "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'PASS' ELSE 'FAIL' END AS r, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'PASS' ELSE 'FAIL' END AS s FROM orders")
def s5_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parameter documents merged into each document."""
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.to_variant_object(F.struct("o_totalprice", "o_orderstatus")).alias("document"))
    parameters = spark.createDataFrame([('{"limit": 1.0E5}',), ('{"statuses": ["F", "O"]}',)], "t string").select(F.parse_json("t").alias("document"))
    rules = "let limit = limit\nlet statuses = statuses[*]\nrule r { o_totalprice < %limit }\nrule s { o_orderstatus in %statuses }"
    return evaluate(with_parameters(docs, parameters), rules, ["o_orderkey"], "document")


@add("t4_lists", "SELECT o_orderkey, 'PASS' AS n, CASE WHEN o_orderstatus = 'F' THEN 'PASS' ELSE 'FAIL' END AS r FROM orders")
def t4_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter document that is a list, before the elements of documents that are lists."""
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.to_variant_object(F.array("o_orderstatus", "o_orderpriority")).alias("document"))
    merged = with_parameters(docs, spark.range(1).select(F.parse_json(F.lit('["F"]')).alias("document")))
    return evaluate(merged, "let n = count(this[*])\nrule n { %n == 3 }\nrule r { this[0] == this[1] }", ["o_orderkey"], "document")


def nation_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file of JSON for each nation, and one of another ending, in the warehouse, as executors read it."""
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/nations-{uuid.uuid4().hex}"
    nation = table(spark, sf_dir, "nation")
    nation.write.option("maxRecordsPerFile", 1).json(f"{folder}/deep/er")
    nation.limit(1).select("n_name").write.text(f"{folder}/other")
    return folder


@add("s1_s3_files", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'PASS' ELSE 'FAIL' END AS asia FROM nation")
def s1_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan_documents(spark, nation_files(spark, sf_dir))
    key = F.try_variant_get("document", "$.n_nationkey", "int").alias("n_nationkey")
    return evaluate(docs.select(key, "document"), "rule asia { n_regionkey == 2 }", ["n_nationkey"], "document")


@add("o1_o2_o3_orders", "SELECT count(*) AS files, 0 AS by_name, 0 AS by_time, count(*) AS any_order FROM nation")
def o1_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, how many stand out of order by name and by time, and how many come in any order."""
    folder = nation_files(spark, sf_dir)

    def wrong(order: str, keys: list[str]) -> DataFrame:
        texts = scan_texts(spark, folder, order=order).withColumn("at", F.monotonically_increasing_id())
        before = F.lag(F.struct(*keys)).over(Window.orderBy("at"))  # as many rows as files
        return texts.select(F.coalesce(before > F.struct(*keys), F.lit(False)).alias("wrong")).agg(F.count("*").alias("files"), F.count_if("wrong").alias("n"))

    by_name = wrong("alphabetical", ["name"]).select("files", F.col("n").alias("by_name"))
    by_time = wrong("modified", ["modified", "name"]).select(F.col("n").alias("by_time"))
    return by_name.crossJoin(by_time).crossJoin(scan_texts(spark, folder, order="none").agg(F.count("*").alias("any_order")))  # one row each


@add("s2_rule_files", "SELECT o_orderkey, CASE WHEN o_totalprice < 150000 THEN 'PASS' ELSE 'FAIL' END AS price, CASE WHEN o_orderstatus = 'F' THEN 'PASS' ELSE 'FAIL' END AS done, 'PASS' AS key FROM orders")
def s2_rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule files are read by the driver: a folder's by their endings, a file whatever its ending."""
    with tempfile.TemporaryDirectory() as folder:
        for name, text in (("a.guard", "rule price { o_totalprice < 150000.0 }"), ("deep/b.ruleset", "rule done { o_orderstatus == 'F' }"), ("c.txt", "rule key { o_orderkey exists }")):
            os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
            with open(os.path.join(folder, name), "w", encoding="utf-8") as file:
                file.write(text)
        return evaluate(table(spark, sf_dir, "orders"), read_rules([folder, os.path.join(folder, "c.txt")]), ["o_orderkey"])


@add("s7_plain_yaml", "SELECT CAST(p_partkey AS VARCHAR) AS name, 'PASS' AS words, CASE WHEN p_size > 25 THEN 'PASS' ELSE 'FAIL' END AS size FROM part")
def s7_plain_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other way of typing: yes is a string, and a plain empty scalar is null."""
    docs = load_documents(yaml_texts(spark, sf_dir), located=False)
    return evaluate(docs, "rule words { Tags[0] == 'yes'\n Tags[1] is_null\n Empty is_null }\nrule size { Size > 25 }", ["name"], "document")


@add("s9_validate_text", "SELECT r_regionkey, CASE WHEN r_name = 'ASIA' THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN r_name <> 'ASIA' THEN 'asia' ELSE '' END AS failed FROM region")
def s9_validate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call for each of the five regions."""
    from .api import validate_text

    found = []
    for r in table(spark, sf_dir, "region").limit(100).collect():
        report = validate_text(spark, f"name: {r.r_name}", "rule asia { name == 'ASIA' }")[0]
        found.append((r.r_regionkey, report["status"], ",".join(x["name"] for x in report["not_compliant"])))
    return spark.createDataFrame(found, "r_regionkey int, status string, failed string")


@add(
    "s10_k14_a10_a13_specs",
    """SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS case_id, n_name AS name, CASE WHEN n_regionkey = 2 THEN 'PASS/PASS' ELSE 'PASS/FAIL' END AS twice,
    CASE WHEN n_regionkey = 2 THEN 'FAIL' ELSE 'PASS' END AS skipped, 'NONE' AS extra FROM nation""",
)
def s10_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each nation: a rule of a name that two rules have, of which one as expected is enough, one that must be
    skipped, and one without an expectation."""
    nation = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # a specification is one text
    text = "".join(f"- name: {n.n_name}\n  input: {{key: {n.n_nationkey}, region: {n.n_regionkey}}}\n  expectations: {{rules: {{twice: PASS, skipped: SKIP}}}}\n" for n in nation)
    rules = "rule twice { key exists }\nrule twice { region == 2 }\nrule skipped when region == 2 { key exists }\nrule extra { key exists }"
    found = run_tests(read_specs(spark, text), rules)
    of = lambda rule, c: F.max(F.when(F.col("rule") == rule, c))
    return found.groupBy("case_id", "name").agg(
        of("twice", F.array_join("evaluated", "/")).alias("twice"), of("skipped", F.col("outcome")).alias("skipped"), of("extra", F.col("outcome")).alias("extra")
    )


@add("s11_j10_o5_pairs", "SELECT 'd/' || min(n_name) || '.guard' AS rule, 'd/tests/' || test AS test FROM nation JOIN (SELECT n_name || '_1.yaml' AS test FROM nation UNION ALL SELECT n_name || '.json' FROM nation) ON starts_with(test, n_name) GROUP BY test")
def s11_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r.n_name for r in table(spark, sf_dir, "nation").select("n_name").collect()]  # file names are the driver's
    tests = [f"d/tests/{n}{e}" for n in names for e in ("_1.yaml", ".json", ".txt")] + [f"other/tests/{n}.yaml" for n in names]
    return spark.createDataFrame([(r, t) for r, own in pair_tests([f"d/{n}.guard" for n in names], tests).items() for t in own], "rule string, test string")


@add("k12_parse_tree", "SELECT o_orderpriority AS rule, 1 AS clauses, 'RuleFile' AS kind FROM orders GROUP BY ALL")
def k12_parse_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each priority, as a tree."""
    from .api import parse_tree

    names = [r[0] for r in table(spark, sf_dir, "orders").select("o_orderpriority").distinct().limit(1000).collect()]
    tree = parse_tree("\n".join(f"rule p{i} {{ o_orderpriority == '{n}' }}" for i, n in enumerate(names)))
    found = [(names[int(r["name"][1:])], len(r["block"]["clauses"]), tree["kind"]) for r in tree["rules"]]
    return spark.createDataFrame(found, "rule string, clauses int, kind string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule, status, n over orders with their items."""
    rules = """
let heavy = items[ l_quantity > 40.0 ]
rule heavy_is_cheap when %heavy !empty { %heavy.l_discount <= 0.08 <<heavy lines get little discount>> }
rule some_returned { some items[*].l_returnflag == 'R' }
rule lines { items[*] { l_quantity > 0.0
                        when l_returnflag == 'R' { l_discount < 0.1 } } }
"""
    return tallies(nested_orders(spark, sf_dir), rules)


add(
    "flagship",
    """WITH d AS (SELECT o_orderkey,
    CASE WHEN count(*) FILTER (l_quantity > 40) = 0 THEN 'SKIP' WHEN bool_and(l_discount <= 0.08) FILTER (l_quantity > 40) THEN 'PASS' ELSE 'FAIL' END AS heavy_is_cheap,
    CASE WHEN bool_or(l_returnflag = 'R') THEN 'PASS' ELSE 'FAIL' END AS some_returned,
    CASE WHEN bool_and(l_quantity > 0 AND (l_returnflag <> 'R' OR l_discount < 0.1)) THEN 'PASS' ELSE 'FAIL' END AS lines
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
    SELECT 'heavy_is_cheap' AS rule, heavy_is_cheap AS status, count(*) AS n FROM d GROUP BY ALL UNION ALL
    SELECT 'some_returned', some_returned, count(*) FROM d GROUP BY ALL UNION ALL SELECT 'lines', lines, count(*) FROM d GROUP BY ALL""",
)(flagship)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
