"""The driver's tables under this library's schemas: pure projections, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(name: str):
    """A function (spark, sf_dir) -> DataFrame that projects one table by the expressions of SQL[name]."""
    source, columns, where = BINDINGS[name]

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return (df.where(where) if where else df).select(*[F.expr(e).alias(c) for c, e in columns.items()])

    return read


def cte(*names: str) -> str:
    """WITH name AS (the same projection), for DuckDB."""
    parts = []
    for n in names:
        source, columns, where = BINDINGS[n]
        listed = ", ".join(f"{_duck(e)} AS {c}" for c, e in columns.items())
        parts.append(f"{n} AS (SELECT {listed} FROM {source}{f' WHERE {where}' if where else ''})")
    return "WITH " + ", ".join(parts)


def _duck(e: str) -> str:
    return e.replace("string)", "varchar)").replace("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')").replace(" div ", " // ")


SEVERITY = "CASE WHEN l_quantity > 45 THEN 'critical' WHEN l_quantity > 35 THEN 'high' WHEN l_quantity > 20 THEN 'medium' WHEN l_quantity > 5 THEN 'low' ELSE 'info' END"
DIMENSION = "CASE l_linenumber WHEN 1 THEN 'security' WHEN 2 THEN 'unit' WHEN 3 THEN 'accessibility' WHEN 4 THEN 'load' WHEN 5 THEN 'chaos' WHEN 6 THEN 'contracts' ELSE 'mutation' END"

#: name: (table, {column: expression that both Spark and DuckDB read}, filter)
BINDINGS: dict[str, tuple[str, dict[str, str], str | None]] = {
    "findings": ("lineitem", {
        "repo": "concat('repo-', CAST(l_suppkey AS string))", "run_id": "CAST(l_orderkey AS bigint)", "dimension": DIMENSION, "rule": "concat('r', CAST(l_partkey % 9 AS string))",
        "category": "concat(l_returnflag, l_linestatus)", "severity": SEVERITY, "title": "concat('finding ', CAST(l_partkey % 50 AS string))",
        "path": "concat('src/', CAST(l_partkey % 40 AS string), '.js')", "line": "CAST(l_orderkey % 60 AS int)", "col": "CAST(l_linenumber AS int)",
        "status": "CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'fixed' END", "seq": "CAST(l_orderkey * 10 + l_linenumber AS bigint)",
    }, None),
    "runs": ("orders", {
        "id": "CAST(o_orderkey AS bigint)", "user_id": "CAST(o_custkey AS bigint)", "project_id": "CAST(o_orderkey % 97 AS bigint)",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END",
        "score": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(floor(o_totalprice) AS bigint) % 101 END",
        "started_at": "CAST(o_orderdate AS timestamp)", "completed_at": "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_orderdate AS timestamp) + INTERVAL '1' SECOND * CAST(o_orderkey % 300 AS int) END",
        "total_findings": "CAST(o_orderkey % 40 AS bigint)",
    }, None),
    "users": ("customer", {
        "id": "CAST(c_custkey AS bigint)", "login": "c_name",
        "plan": "CASE c_mktsegment WHEN 'BUILDING' THEN 'pro' WHEN 'AUTOMOBILE' THEN CASE WHEN c_custkey % 2 = 0 THEN 'Forge' ELSE 'team' END WHEN 'MACHINERY' THEN 'enterprise' WHEN 'HOUSEHOLD' THEN 'hobby' END",
    }, None),
    "requests": ("events", {
        "id": "CAST(event_id AS bigint)", "ts": "CAST(ts AS timestamp)", "caller": "CAST(user_id AS bigint)", "status": "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END",
        "latency": "CAST(value AS double)", "concurrency": "CAST(get_json_object(props, '$.k') AS int)", "kind": "event_type",
    }, None),
    "locks": ("lineitem", {
        "repo": "concat('repo-', CAST(l_suppkey AS string))", "ecosystem": "CASE WHEN l_suppkey % 4 = 0 THEN 'PyPI' ELSE 'npm' END", "name": "concat('pkg-', CAST(l_partkey % 500 AS string))", "version": "concat(CAST(CAST(l_quantity AS int) % 5 AS string), '.', CAST(l_linenumber AS string))",
        "resolved": "CASE WHEN l_linestatus = 'O' THEN 'https://registry.npmjs.org/p' WHEN l_linenumber = 7 THEN 'git+ssh://host/p.git' ELSE 'https://registry.npmjs.org/q' END",
        "integrity": "CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'sha512-x' END", "is_direct": "l_linenumber = 1",
    }, None),
    "advisories": ("part", {
        "name": "concat('pkg-', CAST(p_partkey % 900 AS string))", "ecosystem": "CASE WHEN p_partkey % 3 = 0 THEN 'PyPI' ELSE 'npm' END", "version": "concat(CAST(p_size % 5 AS string), '.', CAST(p_size % 7 + 1 AS string))",
        "severity": "CASE WHEN p_size > 40 THEN 'critical' WHEN p_size > 30 THEN 'high' WHEN p_size > 10 THEN 'medium' ELSE 'low' END",
    }, None),
    "iterations": ("orders", {"user_id": "CAST(o_custkey AS bigint)", "created_at": "CAST(o_orderdate AS timestamp)"}, "o_orderkey % 3 = 0"),
    "exports": ("lineitem", {"repo": "concat('repo-', CAST(l_suppkey % 50 AS string))", "path": "concat('m', CAST(l_orderkey % 11 AS string), '.js')", "name": "concat('f', CAST(l_partkey AS string))"}, "l_linestatus = 'O'"),
    "idents": ("lineitem", {"repo": "concat('repo-', CAST(l_suppkey % 50 AS string))", "path": "concat('m', CAST(l_orderkey % 13 AS string), '.js')", "name": "concat('f', CAST(l_partkey AS string))"}, "l_linestatus = 'F' OR l_linenumber = 1"),
    "routes": ("orders", {
        "repo": "concat('repo-', CAST(o_custkey % 100 AS string))", "method": "CASE WHEN o_orderpriority LIKE '1%' THEN 'POST' WHEN o_orderpriority LIKE '2%' THEN 'DELETE' ELSE 'get' END",
        "route": "concat('/V1/items', CAST(o_orderkey % 23 AS string), CASE WHEN o_orderstatus = 'F' THEN '/{id}' ELSE '/:id/' END)", "origin": "CASE WHEN o_orderstatus = 'F' THEN 'spec' ELSE 'code' END",
    }, None),
    "docs": ("documents", {"repo": "source", "path": "concat('doc/', CAST(doc_id AS string), '.', lang)", "content": "text", "size": "CAST(n_chars AS bigint)"}, None),
    "ledger": ("orders", {
        "entry_date": "CAST(o_orderdate AS timestamp)", "state": "CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'open' ELSE 'rejected' END", "title": "concat('idea ', CAST(o_custkey % 211 AS string))", "pos": "CAST(o_orderkey AS bigint)",
    }, None),
    "billing": ("events", {
        "id": "CAST(event_id AS bigint)", "ts": "CAST(ts AS timestamp)", "customer": "CAST(user_id AS bigint)",
        "kind": "CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'updated' WHEN 'error' THEN 'deleted' ELSE 'other' END",
        "plan": "CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'team' WHEN event_type = 'purchase' AND event_id % 3 = 1 THEN 'enterprise' ELSE NULL END",
    }, None),
}
