"""Program-fact relations derived from the star-schema tables; one SQL text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "b_pkg": "SELECT s_suppkey AS pkg_id, 'pkg' || CAST(s_suppkey AS STRING) AS name, CAST(s_nationkey % 4 AS STRING) || '.' || CAST(s_suppkey % 10 AS STRING) || '.' || CAST(s_suppkey % 7 AS STRING) AS version, s_suppkey % 10 = 0 AS is_entry FROM {supplier}",
    "b_fn": "SELECT p_partkey AS fn_id, p_partkey % (SELECT count(*) FROM {supplier}) AS pkg_id, p_partkey - p_partkey % 50 AS file_id, 10 * (p_partkey % 50 - p_partkey % 10) + 1 + p_partkey % 10 AS sl, 10 * (p_partkey % 50 - p_partkey % 10) + 100 - p_partkey % 10 AS el FROM {part}",
    "b_call": "SELECT o_orderkey AS call_id, o_custkey - o_custkey % 50 AS file_id, 1 + o_orderkey % 500 AS line, o_orderkey % 5 = 0 AS is_native, o_orderkey % 7 = 0 AS is_external FROM {orders}",
    "b_c2f": "SELECT DISTINCT l_orderkey AS call_id, l_partkey AS fn_id FROM {lineitem}",
    "b_edge": "SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "b_tok": "SELECT DISTINCT l_partkey AS var_id, l_suppkey AS tok_id FROM {lineitem}",
    "b_vuln": "SELECT p_partkey AS fn_id, p_brand AS vuln_id FROM {part}",
    "b_site": "SELECT event_id AS node_id, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'call' WHEN 'purchase' THEN 'component' WHEN 'signup' THEN 'import' ELSE 'write' END AS kind, user_id AS base_ap, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS prop, (user_id * 31 + CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)) % 150 AS bp FROM {events}",
    # A tree of packages: a supplier is a package of one of five kinds of manifest, a part a module of it, and a line of an
    # order a request from its part's module for another: by the package's name alone, by name and path without and with
    # an extension, or by a relative path.
    "b_module": "SELECT p_partkey AS module_id, p_partkey % (SELECT count(*) FROM {supplier}) AS pkg_id, '/app/node_modules/p' || (p_partkey % (SELECT count(*) FROM {supplier})) || '/lib/m' || p_partkey || '.js' AS path FROM {part}",
    "b_manifest": "SELECT '/app/node_modules/p' || s_suppkey || '/package.json' AS path, chr(123) || '\"name\": \"p' || s_suppkey || '\", ' || CASE s_suppkey % 5 "
    "WHEN 0 THEN '\"main\": \"lib/m' || s_suppkey || '.js\"' "
    "WHEN 1 THEN '\"exports\": ' || chr(123) || '\".\": ' || chr(123) || '\"import\": \"./lib/m' || s_suppkey || '.js\", \"require\": \"./lib/m' || s_suppkey || '.js\"' || chr(125) || ', \"./lib/*\": \"./lib/*.js\"' || chr(125) "
    "WHEN 2 THEN '\"exports\": ' || chr(123) || '\".\": [\"bad\", \"./lib/m' || s_suppkey || '.js\"], \"./lib/*.js\": \"./lib/*.js\", \"./lib/m1*\": null' || chr(125) "
    "WHEN 3 THEN '\"exports\": \"./lib/m' || s_suppkey || '.js\"' ELSE '\"exports\": ' || chr(123) || '\"require\": \"./lib/m' || s_suppkey || '.js\"' || chr(125) END || chr(125) AS content FROM {supplier}",
    "b_request": "SELECT DISTINCT '/app/node_modules/p' || (l_partkey % ns) || '/lib/m' || l_partkey || '.js' AS path, l_partkey AS from_id, l_orderkey % np AS to_id, (l_orderkey % np) % ns AS to_pkg, l_linenumber % 4 AS style, "
    "CASE l_linenumber % 4 WHEN 0 THEN 'p' || ((l_orderkey % np) % ns) WHEN 1 THEN 'p' || ((l_orderkey % np) % ns) || '/lib/m' || (l_orderkey % np) WHEN 2 THEN 'p' || ((l_orderkey % np) % ns) || '/lib/m' || (l_orderkey % np) || '.js' "
    "ELSE '../../p' || ((l_orderkey % np) % ns) || '/lib/m' || (l_orderkey % np) END AS spec, CASE WHEN l_suppkey % 2 = 0 THEN 'module' ELSE 'commonjs' END AS mode "
    "FROM {lineitem}, (SELECT count(*) AS ns FROM {supplier}) AS c_s, (SELECT count(*) AS np FROM {part}) AS c_p",
    # A sparse program of modules that uses every order: a customer's orders are a heap by number, each requires the two
    # below it; some require the head of another customer's heap, a few of them by a specifier that only solving finds.
    "b_heap": "SELECT o_orderkey AS module_id, o_custkey AS cust, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM {orders}",
    "b_jump": "SELECT o_orderkey AS src, (o_custkey + 7) % (SELECT count(*) FROM {customer}) AS cust, o_orderkey % 62 = 0 AS is_dynamic FROM {orders} WHERE o_orderkey % 31 = 0",
    # Sparse call graphs, one a customer, that use every order and line: an order calls the next of its customer's and the one
    # at twice its place, some call one further back; a call weighs the root of the number of the order's distinct parts.
    "b_stack_edge": "SELECT n.o_custkey AS vuln_id, n.o_orderkey AS src, b.o_orderkey AS dst, sqrt(w.parts) AS weight FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM {orders}) AS n "
    "JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS parts FROM {lineitem} GROUP BY l_orderkey) AS w ON w.l_orderkey = n.o_orderkey "
    "JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM {orders}) AS b ON b.o_custkey = n.o_custkey AND (b.r = n.r + 1 OR b.r = 2 * n.r OR (b.r = n.r - 3 AND n.o_orderkey % 4 = 0)) WHERE b.o_orderkey <> n.o_orderkey",
    "b_stack_end": "SELECT o_custkey AS vuln_id, min(o_orderkey) AS first, max(o_orderkey) AS last FROM {orders} GROUP BY o_custkey",
    # A sparse program for the points-to kernel that uses every order and customer: see the query points_to.
    "b_order": "SELECT o_orderkey AS o, o_custkey AS c FROM {orders}",
    "b_container": "SELECT c_custkey AS c FROM {customer}",
}


#: Bytes of input that make one shuffle partition, where that is more partitions than the session has, the size up to
#: which adaptive execution puts small partitions together again, and what a task reads of a file: what a task sorts or
#: hashes does not grow with the input.
PER_PARTITION, TOGETHER, SPLIT = 4 << 20, "8m", "16m"


def _tables(*names: str) -> list[str]:
    return sorted({t for n in names for t in re.findall(r"\{(\w+)\}", VIEWS[n])})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _tables(name)})


def partitions(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Sets how finely files and shuffles are cut, by the size of the tables of these views. Result frames are planned when they are
    read, so the settings stay; each query sets them anew."""
    size = spark.read.format("binaryFile").load([f"{sf_dir}/{t}.parquet" for t in _tables(*names)]).agg(F.sum("length")).first()[0] or 0  # no content is read
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PER_PARTITION))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", n)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TOGETHER)
    spark.conf.set("spark.sql.files.maxPartitionBytes", SPLIT)


def ctes(*names: str) -> str:
    """The same views as the head of a DuckDB query: 'name AS (..), ..'."""
    plain = {n: re.sub(r"\{(\w+)\}", r"\1", VIEWS[n]) for n in names}
    return ", ".join(f"{n} AS ({q})" for n, q in plain.items())
