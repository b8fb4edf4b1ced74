"""Every registered query of the library on the driver's tables, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions import scores as S
from auditlake.operators import findings as fi
from auditlake.operators import joins as jo
from auditlake.operators import loadlog as lo
from auditlake.operators import service as se
from auditlake.operators import text as tx
from auditlake.plans import code_queries, report_queries  # noqa: F401 - register their queries
from auditlake.plans.bindings import bound, cte, table
from auditlake.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from auditlake.streaming import jobs

FINDINGS, RUNS, USERS, REQUESTS, LOCKS, ADVISORIES, ITERATIONS = map(bound, ("findings", "runs", "users", "requests", "locks", "advisories", "iterations"))
EXPORTS, IDENTS, ROUTES, DOCS, LEDGER, BILLING = map(bound, ("exports", "idents", "routes", "docs", "ledger", "billing"))
AS_OF = "1997-06-15 00:00:00"
DIMENSIONS = ["security", "unit", "accessibility", "load", "chaos", "contracts", "mutation"]


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END"
_WEIGHT = "CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 50 WHEN 'medium' THEN 20 WHEN 'low' THEN 8 WHEN 'info' THEN 0 ELSE 10 END"
_ORDER = f"{_RANK}, path, line, col, title, seq"


def _curve(p: str, k: str = "5") -> str:
    return f"greatest(5, CAST(floor(100.0 / (1.0 + CAST({p} AS DOUBLE) / 100.0 / {k}.0) + 0.5) AS INTEGER))"


_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in S.SEVERITIES)

# ---------------------------------------------------------------- findings and scores


@query(rf"""{cte('docs')}, l AS (SELECT repo, path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line, unnest(string_split(content, chr(10))) AS text FROM docs),
h AS (SELECT repo, path, line, CASE WHEN regexp_extract(text, '{fi.TOKEN_SHAPES}', 1) <> '' THEN 'token-shape'
  WHEN regexp_extract(text, '{fi.SECRET_ASSIGNMENT.replace("'", "''")}', 2) <> '' AND NOT regexp_matches(regexp_extract(text, '{fi.SECRET_ASSIGNMENT.replace("'", "''")}', 2), '{fi.PLACEHOLDER}') THEN 'secret-assignment' END AS rule FROM l),
c AS (SELECT repo, count(*) AS n, sum(CASE rule WHEN 'token-shape' THEN 100 ELSE 50 END) AS p FROM h WHERE rule IS NOT NULL GROUP BY repo)
SELECT d.repo, coalesce(n, 0) AS n, {_curve('coalesce(p, 0)')} AS score FROM (SELECT DISTINCT repo FROM docs) d LEFT JOIN c ON d.repo = c.repo""")
def secret_scores(spark, sf):
    """Which sources leak credentials, and how do they score?"""
    docs = DOCS(spark, sf)
    found = fi.dedupe_findings(fi.secret_findings(fi.explode_lines(docs)))
    counts = found.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.sum(S.penalty_hundredths(F.col("severity"))).alias("p"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return docs.select("repo").distinct().join(counts, "repo", "left").select("repo", zero("n").alias("n"), S.curve(zero("p")).alias("score"))


@query(f"{cte('findings')} SELECT repo, dimension, count(*) AS total, {_COUNTS} FROM findings GROUP BY repo, dimension")
def severity_by_dimension(spark, sf):
    return fi.severity_counts(FINDINGS(spark, sf), "repo", "dimension")


@query(f"{cte('findings')} SELECT repo, dimension, count(*) AS n, {_curve(f'sum({_WEIGHT})')} AS score FROM findings GROUP BY repo, dimension")
def dimension_scores(spark, sf):
    return fi.severity_scores(FINDINGS(spark, sf), "repo", "dimension")


@query(f"""{cte('findings')}, s AS (SELECT repo, dimension, count(*) AS n, {_curve(f'sum({_WEIGHT})')} AS score FROM findings GROUP BY repo, dimension)
SELECT repo, CAST(floor(avg(score) + 0.5) AS INTEGER) AS overall, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY repo""")
def overall_scores(spark, sf):
    s = fi.severity_scores(FINDINGS(spark, sf), "repo", "dimension")
    return s.groupBy("repo").agg(S.round_half_up(F.avg("score")).alias("overall"), F.sum("n").alias("n"))


_TERMS = {"security": 30, "unit": 20, "load": 20, "accessibility": 15, "chaos": 15}


@query(f"""{cte('findings')}, s AS (SELECT repo, dimension, {_curve(f'sum({_WEIGHT})')} AS score FROM findings GROUP BY repo, dimension)
SELECT repo, CAST(floor(({' + '.join(f"{w} * coalesce(nullif(max(score) FILTER (dimension = '{d}'), 0), 50)" for d, w in _TERMS.items())}) / 100.0 + 0.5) AS INTEGER) AS overall FROM s GROUP BY repo""")
def overall_weighted(spark, sf):
    """Weighted mean of five dimensions; a missing or zero score counts as 50."""
    s = fi.severity_scores(FINDINGS(spark, sf), "repo", "dimension").groupBy("repo").pivot("dimension", list(_TERMS)).agg(F.max("score"))
    total = sum((w * F.coalesce(F.nullif(F.col(d), F.lit(0)), F.lit(50)) for d, w in _TERMS.items()), F.lit(0))
    return s.select("repo", S.round_half_up(total / F.lit(100.0)).alias("overall"))


_SCORED = {
    "repo": "concat('p', CAST(p_partkey AS string))", "vision": "CASE WHEN p_size % 7 > 0 THEN p_size * 3 % 101 END", "stack": "p_size % 4 * 30", "unit": "CASE WHEN p_size % 5 > 0 THEN p_size * 7 % 101 END", "accessibility": "p_size * 11 % 101", "accessibility_applies": "p_size % 6 > 0",
    "contract": "CASE WHEN p_size % 3 > 0 THEN p_size * 13 % 101 END", "chaos": "p_size * 17 % 101", "predictive": "p_size * 19 % 101", "agentic": "CASE WHEN p_size % 8 > 0 THEN p_size * 23 % 101 ELSE 0 END", "dora": "p_size * 29 % 101", "scope": "p_size * 31 % 140",
    "critical": "p_size % 4", "high": "p_size % 9", "findings": "p_size % 10", "max_users": "CASE WHEN p_size % 11 > 0 THEN p_size * 2 END",
}


def _or(c: str, default: int, keep_zero: bool = False) -> str:
    return f"coalesce({c}, {default})" if keep_zero else f"coalesce(nullif({c}, 0), {default})"


_CRIT, _BOTH = "greatest(0, 100 - 20 * critical)", "greatest(0, 100 - 20 * critical - 5 * high)"
_OVERALL = {
    "cli": f"(15 * {_or('vision', 50)} + 10 * {_or('stack', 60)} + 20 * {_CRIT} + 10 * {_or('unit', 50)} + 10 * {_or('accessibility', 70)} + 10 * {_or('contract', 50)} + 10 * {_or('chaos', 50)} + 15 * {_or('predictive', 50)}) / 100.0",
    "save": f"(25 * {_or('vision', 50)} + 15 * {_or('stack', 60)} + 10 * {_or('unit', 50)} + 10 * {_or('accessibility', 70)} + 40 * greatest(0, 100 - 5 * findings)) / 100.0",
    "local": f"(20 * {_or('agentic', 50, True)} + 15 * {_or('stack', 60, True)} + 15 * {_or('unit', 50, True)} + 30 * {_CRIT} + 10 * {_or('accessibility', 70, True)} + 10 * {_or('dora', 50, True)}) / 100.0",
    "dashboard": f"(30 * {_or('vision', 50)} + 20 * {_or('stack', 60)} + 30 * CASE WHEN findings > 0 THEN {_CRIT} ELSE 50 END + 20 * {_or('unit', 50)}) / 100.0",
    "report": f"(10 * {_or('accessibility', 70)} + 15 * {_BOTH} + 10 * CASE WHEN max_users < 50 THEN 70 ELSE 100 END + 10 * {_or('unit', 50)} + 25 * {_or('vision', 50)} + 15 * {_or('scope', 30)} + 15 * {_or('stack', 60)}) / 100.0",
    "digest": f"({_BOTH} + coalesce(unit, 0) + least(100, stack) + least(100, scope) + CASE WHEN accessibility_applies THEN accessibility ELSE 0 END) / CASE WHEN accessibility_applies THEN 5.0 ELSE 4.0 END",
}


@query(f"WITH s AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _SCORED.items())} FROM part) SELECT repo, {', '.join(f'CAST(floor({e} + 0.5) AS INTEGER) AS {p}' for p, e in _OVERALL.items())} FROM s")
def overall_profiles(spark, sf):
    wide = table(spark, sf, "part").select(*[F.expr(e).alias(c) for c, e in _SCORED.items()])
    return wide.select("repo", *[S.overall(p).alias(p) for p in S.PROFILES])


_CATEGORIES = [*sorted({c for names in fi.OWASP.values() for c in names}), "Other"]
_CATEGORY = f"CASE l_partkey % {len(_CATEGORIES)} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CATEGORIES)) + " END"
_CODES = ", ".join(f"('{k}', '{c}')" for k, names in fi.OWASP.items() for c in names or ["-"])


@query(f"""{cte('findings')}, f AS (SELECT concat('repo-', l_suppkey % 40) AS repo, {_CATEGORY} AS category, CASE WHEN l_quantity > 49 THEN 'critical' WHEN l_quantity > 44 THEN 'high' WHEN l_quantity > 20 THEN 'medium' ELSE 'low' END AS severity FROM lineitem WHERE l_linenumber > 5), m(code, category) AS (VALUES {_CODES}),
r AS (SELECT repo, m.code, severity FROM f JOIN m USING (category)), k AS (SELECT DISTINCT repo, code FROM (SELECT DISTINCT repo FROM f), m),
c AS (SELECT k.repo, k.code, count(severity) AS n, {', '.join(f"count(*) FILTER (severity = '{x}') AS {x}" for x in ('critical', 'high', 'medium', 'low'))} FROM k LEFT JOIN r ON r.repo = k.repo AND r.code = k.code GROUP BY k.repo, k.code)
SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN high >= 3 THEN 'high' END AS severity, 80 AS coverage FROM c""")
def owasp_report(spark, sf):
    severity = F.expr("CASE WHEN l_quantity > 49 THEN 'critical' WHEN l_quantity > 44 THEN 'high' WHEN l_quantity > 20 THEN 'medium' ELSE 'low' END").alias("severity")
    found = table(spark, sf, "lineitem").where("l_linenumber > 5")
    return fi.owasp_report(found.select(F.expr("concat('repo-', CAST(l_suppkey % 40 AS string))").alias("repo"), F.expr(_CATEGORY).alias("category"), severity))


@query(f"{cte('findings')} SELECT run_id, severity, title, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {_ORDER}) AS rank FROM findings WHERE severity IN ('critical', 'high')) WHERE rank <= 3")
def top_issues(spark, sf):
    return fi.top_issues(FINDINGS(spark, sf), 3).select("run_id", "severity", "title", "path", "rank")


@query(f"""{cte('findings')}, r AS (SELECT *, row_number() OVER (PARTITION BY repo, dimension ORDER BY {_ORDER}) AS rank FROM findings)
SELECT repo, dimension, CAST(list_position([{', '.join(f"'{d}'" for d in DIMENSIONS)}], dimension) AS INTEGER) AS position, count(*) AS n, string_agg(title, '|' ORDER BY rank) FILTER (rank <= 10) AS titles FROM r GROUP BY repo, dimension""")
def dimension_groups(spark, sf):
    return fi.dimension_groups(FINDINGS(spark, sf), DIMENSIONS)


# Scores and applicability by supplier; dimensions without a row have neither.
_KNOWN = f"""SELECT concat('repo-', s_suppkey) AS repo, dimension, CAST(CASE WHEN (s_suppkey + k) % 4 > 0 THEN s_suppkey * k * 7 % 1009 / 10.0 END AS DOUBLE) AS score,
CASE dimension WHEN 'accessibility' THEN s_suppkey % 3 > 0 WHEN 'load' THEN s_suppkey % 5 > 0 ELSE true END AS applicable, 'no such files' AS reason
FROM (SELECT s_suppkey, unnest(range(1, {len(DIMENSIONS)})) AS k, unnest([{', '.join(f"'{d}'" for d in DIMENSIONS[:-1])}]) AS dimension FROM supplier)"""
_GROUPS = f"""{cte('findings')}, f AS (SELECT * FROM findings WHERE line % 6 < 3), r AS (SELECT *, row_number() OVER (PARTITION BY repo, dimension ORDER BY {_ORDER}) AS rank FROM f), known AS ({_KNOWN}),
g AS (SELECT repo, dimension, count(*) AS n, string_agg(title, '|' ORDER BY rank) FILTER (rank <= 4) AS titles FROM r GROUP BY ALL),
grid AS (SELECT concat('repo-', s_suppkey) AS repo, unnest(range(1, {len(DIMENSIONS) + 1})) AS position, unnest([{', '.join(f"'{d}'" for d in DIMENSIONS)}]) AS dimension FROM supplier),
report AS (SELECT repo, position, dimension, CAST(floor(score + 0.5) AS INTEGER) AS score, coalesce(applicable, true) AS applicable, CASE WHEN NOT applicable THEN reason END AS reason, coalesce(n, 0) AS n, coalesce(titles, '') AS titles
FROM grid LEFT JOIN known USING (repo, dimension) LEFT JOIN g USING (repo, dimension))"""


def _report(spark, sf):
    suppliers = table(spark, sf, "supplier")
    repos = suppliers.select(F.expr("concat('repo-', CAST(s_suppkey AS string))").alias("repo"), "s_suppkey")
    known = repos.select("*", F.posexplode(F.array(*map(F.lit, DIMENSIONS[:-1]))).alias("k0", "dimension")).withColumn("k", F.col("k0") + 1)
    score = F.expr("CASE WHEN (s_suppkey + k) % 4 > 0 THEN CAST(s_suppkey * k * 7 % 1009 AS double) / 10 END")
    applies = F.expr("CASE dimension WHEN 'accessibility' THEN s_suppkey % 3 > 0 WHEN 'load' THEN s_suppkey % 5 > 0 ELSE true END")
    scores = known.select("repo", "dimension", score.alias("score"), applies.alias("applicable"), F.lit("no such files").alias("reason"))
    return fi.dimension_report(repos, FINDINGS(spark, sf).where("line % 6 < 3"), scores, DIMENSIONS, 4)


@query(f"{_GROUPS} SELECT * FROM report")
def dimension_report(spark, sf):
    return _report(spark, sf)


@query(f"{_GROUPS} SELECT repo, CAST(coalesce(floor(avg(score) FILTER (applicable) + 0.5), 0) AS INTEGER) AS overall, CAST(sum(n) AS BIGINT) AS findings FROM report GROUP BY repo")
def overall_of_groups(spark, sf):
    return fi.overall_of_groups(_report(spark, sf))


def _phase(i: int, p: tuple) -> str:
    phase, severity, dimension, limit = p
    where = f"severity = '{severity}'" if severity else f"dimension = '{dimension}' AND severity IN ('low', 'info')"
    return f"SELECT repo, '{phase}' AS phase, dimension, severity, title, seq, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_ORDER}) AS rank FROM findings WHERE {where}) t{i}" + (f" WHERE rank <= {limit}" if limit else "")


@query(f"{cte('findings')} {' UNION ALL '.join(_phase(i, p) for i, p in enumerate(fi.PHASES))}")
def remediation_plan(spark, sf):
    return fi.remediation_plan(FINDINGS(spark, sf))


_WORTH = "CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query(f"""{cte('findings')}, h AS (SELECT repo, {', '.join(f"CAST(100 - least(100, sum(CASE WHEN dimension IN {d} THEN {_WORTH} ELSE 0 END)) AS INTEGER) AS {a}" for a, d in (('security', "('security')"), ('reliability', "('chaos', 'unit', 'mutation')"), ('performance', "('load')"), ('accessibility', "('accessibility')")))} FROM findings GROUP BY repo)
SELECT *, CAST(floor((security + reliability + performance + accessibility) / 4.0 + 0.5) AS INTEGER) AS overall FROM h""")
def health_metrics(spark, sf):
    return fi.health_metrics(FINDINGS(spark, sf))


_TITLES = ["No rate limiting on routes", "Estimated mutation score is low", "Low test file coverage", "Images without alt attribute", "SQL injection in query", "Missing rate of change", "12 Unchained Promise Calls", "Query built from input"]


@query(f"""{cte('findings')}, t AS (SELECT CASE WHEN line % 4 > 0 THEN dimension END AS dimension, seq // 10 % 8 AS k FROM findings)
SELECT CASE WHEN dimension IN ('load', 'accessibility', 'chaos', 'mutation') THEN 'dimension' WHEN dimension IS NULL AND k IN (0, 1, 2, 3, 6) THEN 'title' END AS reason, count(*) AS n FROM t GROUP BY 1""")
def testable_split(spark, sf):
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.floor(F.col("seq") / 10) % 8 + 1).cast("int"))
    given = FINDINGS(spark, sf).withColumn("title", title).withColumn("dimension", F.when(F.col("line") % 4 > 0, F.col("dimension")))
    return fi.testable_split(given).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"{cte('findings')} SELECT severity, dimension, count(*) AS n FROM findings GROUP BY GROUPING SETS ((severity), (dimension), ())")
def compare_rollup(spark, sf):
    return fi.compare_rollup(FINDINGS(spark, sf))


_MAP = [("AF", "A01"), ("AF", "A03"), ("NO", "A05"), ("RF", "A02"), ("NF", "A08")]


@query(f"""{cte('findings')}, m(category, code) AS (VALUES {', '.join(str(x) for x in _MAP)}), k AS (SELECT 'A' || lpad(CAST(i AS VARCHAR), 2, '0') AS code FROM range(1, 11) r(i)),
c AS (SELECT code, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM findings JOIN m USING (category) GROUP BY code)
SELECT k.code, coalesce(n, 0) AS n, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(critical, 0) > 0 OR coalesce(high, 0) >= 3 AS flagged FROM k LEFT JOIN c USING (code)""")
def owasp_rollup(spark, sf):
    codes = spark.range(1, 11).select(F.concat(F.lit("A"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("code"))
    return fi.owasp_rollup(FINDINGS(spark, sf), spark.createDataFrame(_MAP, "category string, code string"), codes)


@query(f"""{cte('findings')}, t AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_ORDER}) AS k FROM findings WHERE severity IN ('critical', 'high')),
g AS (SELECT repo, count(*) AS n, {_curve(f'sum({_WEIGHT})')} AS score FROM findings GROUP BY repo)
SELECT g.repo, n, score, t.title AS top_title, t.path AS top_path FROM g LEFT JOIN t ON g.repo = t.repo AND k = 1""")
def digest_cards(spark, sf):
    return fi.digest_cards(FINDINGS(spark, sf))


@query(f"""{cte('findings')}, r AS (SELECT *, row_number() OVER (PARTITION BY repo, dimension = 'security' ORDER BY {_ORDER}) AS k FROM findings)
SELECT repo, dimension, severity, substring(title, 1, 400) AS title, regexp_replace(path, '^[^/]*/', '') AS path, seq FROM r WHERE dimension <> 'security' OR k <= 25""")
def distill_findings(spark, sf):
    return fi.distill_findings(FINDINGS(spark, sf))


@query(f"""{cte('findings')} SELECT repo, category, count(*) AS n FROM (SELECT DISTINCT repo, category, path, line, col, title FROM findings) GROUP BY repo, category""")
def dedupe_findings(spark, sf):
    return fi.dedupe_findings(FINDINGS(spark, sf)).groupBy("repo", "category").agg(F.count(F.lit(1)).alias("n"))


_SUPPRESSED = "SELECT DISTINCT concat('repo-', CAST(l_suppkey AS varchar)) AS repo, concat('src/', CAST(l_partkey % 40 AS varchar), '.js') AS path, CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_orderkey % 60 AS INTEGER) END AS line, CASE WHEN l_returnflag = 'A' THEN '*' ELSE 'NO' END AS category FROM lineitem WHERE l_partkey % 31 = 7"


@query(f"""{cte('findings')}, s AS ({_SUPPRESSED}) SELECT seq, category FROM findings f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.repo = f.repo AND s.path = f.path AND (s.line IS NULL OR s.line = f.line) AND (s.category = '*' OR s.category = f.category))""")
def filter_suppressed(spark, sf):
    remarks = table(spark, sf, "lineitem").where("l_partkey % 31 = 7").select(
        F.expr("concat('repo-', CAST(l_suppkey AS string))").alias("repo"), F.expr("concat('src/', CAST(l_partkey % 40 AS string), '.js')").alias("path"),
        F.expr("CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_orderkey % 60 AS int) END").alias("line"), F.expr("CASE WHEN l_returnflag = 'A' THEN '*' ELSE 'NO' END").alias("category"),
    )
    return fi.filter_suppressed(FINDINGS(spark, sf), remarks).select("seq", "category")


_RISK = f"""{cte('findings', 'exports')}, a AS (SELECT repo, path, sum(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 12 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 0 END) AS security FROM findings WHERE rule <> 'r2' GROUP BY ALL),
b AS (SELECT repo, path, count(*) * 10 AS queries FROM findings WHERE rule = 'r4' GROUP BY ALL), c AS (SELECT repo, path, count(*) * 0.5 AS dead FROM exports GROUP BY ALL),
d AS (SELECT repo, path, greatest(max(seq) % 1000 - 400, 0) * 0.05 AS length FROM findings GROUP BY ALL), e AS (SELECT repo, path, greatest(max(seq % 31) - 15, 0) AS complexity FROM findings WHERE rule = 'r2' GROUP BY ALL),
t AS (SELECT repo, path, CASE WHEN sum(seq % 3) > 3 THEN sum(seq % 3) ELSE 0 END AS todos FROM findings WHERE rule = 'r3' GROUP BY ALL), k AS (SELECT repo, path FROM findings UNION SELECT repo, path FROM exports),
j AS (SELECT repo, path, {', '.join(f'CAST(coalesce({x}, 0) AS DOUBLE) AS {x}' for x in ('security', 'queries', 'complexity', 'length', 'todos', 'dead'))}
 FROM k {' '.join(f'LEFT JOIN {x} USING (repo, path)' for x in 'abcdet')}),
risk AS (SELECT repo, path, floor((security + queries + complexity + length + todos + dead) * 10 + 0.5) / 10 AS risk,
 concat_ws(',', {', '.join(f"CASE WHEN {x} > 0 THEN '{x}' END" for x in ('security', 'queries', 'complexity', 'length', 'todos', 'dead'))}) AS reasons FROM j)"""


def _risk(spark, sf):
    f = FINDINGS(spark, sf)
    sizes = f.groupBy("repo", "path").agg((F.max("seq") % 1000).alias("n_lines"))
    functions = f.where("rule = 'r2'").select("repo", "path", (F.col("seq") % 31).cast("int").alias("cc"))
    todos = f.where("rule = 'r3'").select("repo", "path", (F.col("seq") % 3).alias("n"))
    return fi.file_risk(f.where("rule <> 'r2'"), f.where("rule = 'r4'"), EXPORTS(spark, sf), sizes, functions, todos)


@query(f"{_RISK} SELECT repo, path, risk, reasons FROM risk WHERE risk > 0")
def file_risk(spark, sf):
    return _risk(spark, sf)


@query(f"""{_RISK}, r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY risk DESC, path) AS rank, CAST(floor(sum(risk) OVER (PARTITION BY repo) / 5) AS BIGINT) AS predicted, max(risk) OVER (PARTITION BY repo) AS top FROM risk WHERE risk > 0)
SELECT repo, path, risk, rank, CASE WHEN risk >= 30 THEN 'high' WHEN risk >= 12 THEN 'medium' ELSE 'low' END AS severity, predicted, CASE WHEN top >= 30 THEN 'high' WHEN top >= 12 THEN 'medium' ELSE 'low' END AS level FROM r WHERE rank <= 5""")
def risk_hotspots(spark, sf):
    return fi.risk_hotspots(_risk(spark, sf))


# ---------------------------------------------------------------- joins between facts

_CANON = "regexp_replace(regexp_replace(lower(route), ':([a-z_][a-z0-9_]*)', '{\\1}', 'g'), '(.)/+$', '\\1')"
_DIFF = f"""{cte('routes')}, e AS (SELECT repo, upper(method) AS method, {_CANON} AS canonical, bool_or(origin = 'code') AS code, bool_or(origin = 'spec') AS spec FROM routes GROUP BY 1, 2, 3),
d AS (SELECT repo, method, canonical, CASE WHEN code AND spec THEN 'documented' WHEN code THEN 'undocumented' ELSE 'orphan' END AS state FROM e)"""


@query(f"{_DIFF} SELECT * FROM d")
def contract_diff(spark, sf):
    return jo.contract_diff(ROUTES(spark, sf))


@query(f"""{_DIFF}, c AS (SELECT repo, count(*) FILTER (state = 'documented') AS documented, count(*) FILTER (state = 'undocumented') AS undocumented, count(*) FILTER (state = 'orphan') AS orphan, count(*) FILTER (NOT regexp_matches(canonical, '/v[0-9]+(/|$)')) AS unversioned FROM d GROUP BY repo)
SELECT *, {_curve('(undocumented + orphan + CASE WHEN unversioned > 10 THEN 1 ELSE 0 END) * 100', '8')} AS score FROM c""")
def contract_report(spark, sf):
    return jo.contract_report(ROUTES(spark, sf))


@query(f"""{cte('exports', 'idents')}, u AS (SELECT repo, name, count(DISTINCT path) AS files, min(path) AS one FROM idents GROUP BY repo, name)
SELECT DISTINCT e.repo, e.path, e.name FROM exports e LEFT JOIN u ON e.repo = u.repo AND e.name = u.name WHERE u.files IS NULL OR (u.files = 1 AND u.one = e.path)""")
def unused_exports(spark, sf):
    return jo.unused_exports(EXPORTS(spark, sf), IDENTS(spark, sf))


@query("""WITH d AS (SELECT DISTINCT concat('repo-', CAST(l_suppkey AS varchar)) AS repo, concat('@org/p', CAST(l_partkey % 300 AS varchar)) AS name FROM lineitem WHERE l_linestatus = 'O'),
i AS (SELECT DISTINCT concat('repo-', CAST(l_suppkey AS varchar)) AS repo, concat('@org/p', CAST(l_partkey % 300 AS varchar)) AS name FROM lineitem WHERE l_linestatus = 'F')
SELECT d.repo, d.name FROM d ANTI JOIN i USING (repo, name)""")
def unused_deps(spark, sf):
    li = table(spark, sf, "lineitem")
    repo, name = F.expr("concat('repo-', CAST(l_suppkey AS string))").alias("repo"), F.expr("concat('@org/p', CAST(l_partkey % 300 AS string))")
    return jo.unused_deps(li.where("l_linestatus = 'O'").select(repo, name.alias("name")), li.where("l_linestatus = 'F'").select(repo, F.concat(name, F.lit("/lib/index")).alias("specifier")))


_MATCHES = f"""{cte('locks', 'advisories')}, once AS (SELECT DISTINCT repo, ecosystem, name, version, is_direct FROM locks), n AS (SELECT ecosystem, name, min({_RANK}) AS worst FROM advisories GROUP BY ALL), x AS (SELECT ecosystem, name, version, min({_RANK}) AS worst FROM advisories GROUP BY ALL),
h AS (SELECT repo, ecosystem, name, CASE WHEN is_direct THEN 1 ELSE 2 END AS stage, worst FROM once JOIN n USING (ecosystem, name) UNION ALL SELECT repo, ecosystem, name, 3, worst FROM once JOIN x USING (ecosystem, name, version)),
m AS (SELECT repo, ecosystem, name, min(struct_pack(stage := stage, worst := worst)) AS m FROM h GROUP BY repo, ecosystem, name)"""


@query(f"{_MATCHES} SELECT repo, ecosystem, name, m.stage AS stage, m.worst AS severity_rank FROM m")
def advisory_matches(spark, sf):
    return jo.advisory_matches(LOCKS(spark, sf), ADVISORIES(spark, sf))


_FLAGS = "SELECT repo, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(f) AS BIGINT) AS \"foreign\", CAST(sum(u) AS BIGINT) AS unsigned, count(*) FILTER (v > 1) AS many_versions FROM (SELECT repo, name, count(*) AS n, count(DISTINCT version) AS v, count(*) FILTER (NOT starts_with(resolved, 'https://registry.')) AS f, count(*) FILTER (integrity IS NULL) AS u FROM locks GROUP BY repo, name) GROUP BY repo"


@query(f"{cte('locks')} {_FLAGS}")
def lock_flags(spark, sf):
    return jo.lock_flags(LOCKS(spark, sf))


@query(f"""{_MATCHES}, f AS ({_FLAGS}), v AS (SELECT repo, count(*) AS vulnerable FROM m GROUP BY repo)
SELECT f.*, coalesce(vulnerable, 0) AS vulnerable, {_curve('(coalesce(vulnerable, 0) * 2 + f."foreign" + least(many_versions, 10)) * 100', '8')} AS score FROM f LEFT JOIN v USING (repo)""")
def supply_chain_report(spark, sf):
    return jo.supply_chain_report(LOCKS(spark, sf), ADVISORIES(spark, sf))


@query(f"{cte('locks')} SELECT repo, name, string_agg(DISTINCT version, ',' ORDER BY version) AS versions FROM locks GROUP BY repo, name HAVING count(DISTINCT version) > 1")
def duplicate_versions(spark, sf):
    return jo.duplicate_versions(LOCKS(spark, sf))


_LICENSE_LINES = "unnest(regexp_extract_all(text, '[^\\n]*[Ll]icen[sc]e[^\\n]*'))"
_FAMILY = "CASE WHEN license = '' OR license IS NULL THEN 'unknown' " + " ".join(f"WHEN regexp_matches(license, '{p}') THEN '{n}'" for n, p in jo.LICENSES) + " ELSE 'unknown' END"


@query(f"""WITH p AS (SELECT source AS repo, {_LICENSE_LINES} AS license FROM documents), c AS (SELECT repo, {', '.join(f"count(*) FILTER (family = '{f}') AS {f}" for f in [x for x, _ in jo.LICENSES] + ['unknown'])} FROM (SELECT repo, {_FAMILY} AS family FROM p) GROUP BY repo)
SELECT *, {_curve('(strong * 2 + proprietary * 2 + weak) * 100', '8')} AS score FROM c""")
def license_report(spark, sf):
    named = F.filter(F.split("text", "\n"), lambda x: x.rlike("[Ll]icen[sc]e"))
    return jo.license_report(table(spark, sf, "documents").select(F.col("source").alias("repo"), F.explode(named).alias("license")))


_MODULES = "concat('src/', CASE WHEN l_partkey % 2 = 0 THEN 'lib/' ELSE '' END, 'm', CAST(l_partkey % 90 AS string), CASE l_linenumber % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' WHEN 2 THEN '.mjs' ELSE '/index.js' END)"
_SPECIFIERS = "concat(CASE l_partkey % 4 WHEN 0 THEN './lib/m' WHEN 1 THEN './m' WHEN 2 THEN '../src/./lib/m' ELSE 'm' END, CAST(l_partkey % 120 AS string), CASE l_linenumber % 5 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' ELSE '' END)"
_BASES = "concat(CASE l_partkey % 4 WHEN 1 THEN 'src/m' ELSE 'src/lib/m' END, CAST(l_partkey % 120 AS varchar))"
_WRITTEN = "CASE l_linenumber % 5 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' ELSE '' END"
_REPO20 = "concat('repo-', CAST(l_suppkey % 20 AS string))"


@query(f"""WITH f AS (SELECT DISTINCT {_REPO20.replace('string', 'varchar')} AS repo, {_MODULES.replace('string', 'varchar')} AS path FROM lineitem WHERE l_linestatus = 'O'),
i AS (SELECT DISTINCT {_REPO20.replace('string', 'varchar')} AS repo, concat('src/u', CAST(l_orderkey % 7 AS varchar), '.js') AS path, {_SPECIFIERS.replace('string', 'varchar')} AS specifier, {_BASES} AS base, {_WRITTEN} AS ext FROM lineitem WHERE l_linestatus = 'F' AND l_partkey % 4 < 3),
e(rank, ext) AS (SELECT unnest(range(1, 9)), unnest({jo.EXTENSIONS})),
t AS (SELECT repo, path, specifier, 0 AS rank, concat(base, ext) AS target FROM i UNION ALL SELECT repo, path, specifier, rank, concat(base, i.ext, e.ext) FROM i, e
      UNION ALL SELECT repo, path, specifier, 10 + rank, concat(base, i.ext, '/index', e.ext) FROM i, e UNION ALL SELECT repo, path, specifier, 20 + rank, concat(base, e.ext) FROM i, e WHERE i.ext <> '')
SELECT t.repo, t.path, specifier, arg_min(target, rank) AS target FROM t JOIN f ON f.repo = t.repo AND f.path = target GROUP BY ALL""")
def resolve_imports(spark, sf):
    li, repo = table(spark, sf, "lineitem"), F.expr(_REPO20).alias("repo")
    files = li.where("l_linestatus = 'O'").select(repo, F.expr(_MODULES).alias("path"))
    imports = li.where("l_linestatus = 'F'").select(repo, F.expr("concat('src/u', CAST(l_orderkey % 7 AS string), '.js')").alias("path"), F.expr(_SPECIFIERS).alias("specifier")).distinct()
    return jo.resolve_imports(imports, files)


_RULES = [("eval", ["eval", "Function"], None, None, "critical", False), ("sql", [], "^db\\..*", "\\+", "high", None), ("exec", ["exec"], "^child_", "^req", "high", True)]
_CALLS = "CASE l_linenumber WHEN 1 THEN 'eval' WHEN 2 THEN 'db.query' WHEN 3 THEN 'exec' WHEN 4 THEN 'child_process.spawn' ELSE 'log' END"


@query(f"""WITH c AS (SELECT concat('repo-', CAST(l_suppkey AS varchar)) AS repo, concat('src/', CAST(l_partkey AS varchar)) AS path, CAST(l_orderkey AS BIGINT) AS line, {_CALLS} AS callee, CASE l_returnflag WHEN 'A' THEN 'req.body' WHEN 'N' THEN 'a + b' ELSE 'x' END AS args FROM lineitem)
SELECT repo, path, line, 'eval' AS rule, 'critical' AS severity FROM c WHERE callee IN ('eval', 'Function') UNION ALL SELECT repo, path, line, 'sql', 'high' FROM c WHERE regexp_matches(callee, '^db\\.') AND contains(args, '+')
UNION ALL SELECT repo, path, line, 'exec', 'high' FROM c WHERE (callee = 'exec' OR starts_with(callee, 'child_')) AND starts_with(args, 'req') AND line % 2 = 0""")
def rule_findings(spark, sf):
    calls = table(spark, sf, "lineitem").select(F.expr("concat('repo-', CAST(l_suppkey AS string))").alias("repo"), F.expr("concat('src/', CAST(l_partkey AS string))").alias("path"), F.expr("CAST(l_orderkey AS bigint)").alias("line"), F.expr(_CALLS).alias("callee"), F.expr("CASE l_returnflag WHEN 'A' THEN 'req.body' WHEN 'N' THEN 'a + b' ELSE 'x' END").alias("args_text"), F.expr("l_orderkey % 2 = 0").alias("taint"))
    return jo.rule_findings(calls, spark.createDataFrame(_RULES, "rule string, callees array<string>, callee_regex string, arg_regex string, severity string, needs_taint boolean"))


# ---------------------------------------------------------------- service tables


@query(f"{cte('runs')} SELECT user_id, id, project_id, status, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY completed_at DESC NULLS LAST, id DESC) AS rank FROM runs) WHERE rank <= 20")
def run_history(spark, sf):
    return se.run_history(RUNS(spark, sf)).select("user_id", "id", "project_id", "status", "rank")


@query(f"""{cte('runs')}, r AS (SELECT runs.*, p_name AS project_name FROM runs JOIN part ON p_partkey = project_id WHERE contains(lower(p_name), 'wi') AND status = 'completed')
SELECT user_id, id, project_name, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY completed_at DESC NULLS LAST, id DESC) AS rank FROM r) WHERE rank <= 3""")
def run_search(spark, sf):
    projects = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name"))
    return se.run_history(RUNS(spark, sf), 3, "completed", projects, "Wi").select("user_id", "id", "project_name", "rank")


@query(f"""{cte('runs')} SELECT user_id, count(*) AS n_runs, count(*) FILTER (completed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND completed_at <= TIMESTAMP '{AS_OF}') AS n_recent, CAST(floor(coalesce(avg(score), 0) + 0.5) AS INTEGER) AS mean_score, CAST(sum(total_findings) AS BIGINT) AS n_findings FROM runs GROUP BY user_id""")
def usage_stats(spark, sf):
    return se.usage_stats(RUNS(spark, sf), as_of())


_PLANS = ", ".join(f"('{p}', {', '.join('NULL' if x is None else str(x) for x in v)})" for p, v in se.PLANS.items())
_QUOTA = f"""{cte('users', 'runs', 'iterations')}, u AS (SELECT id, CASE lower(plan) WHEN 'pro' THEN 'pro' WHEN 'team' THEN 'team' WHEN 'premium' THEN 'team' WHEN 'forge' THEN 'team' WHEN 'enterprise' THEN 'enterprise' ELSE 'free' END AS plan FROM users),
p(plan, max_tests, max_repos, max_iterations) AS (VALUES ('free', 5, 1, 0), ('pro', 100, 10, 20), ('team', 500, 50, 200), ('enterprise', NULL, NULL, NULL)),
r AS (SELECT user_id AS id, count(*) AS tests, count(DISTINCT project_id) AS repos FROM runs WHERE started_at BETWEEN date_trunc('month', TIMESTAMP '{AS_OF}') AND TIMESTAMP '{AS_OF}' GROUP BY 1),
i AS (SELECT user_id AS id, count(*) AS iterations FROM iterations WHERE created_at BETWEEN date_trunc('month', TIMESTAMP '{AS_OF}') AND TIMESTAMP '{AS_OF}' GROUP BY 1),
q AS (SELECT u.id, u.plan, coalesce(tests, 0) AS tests, coalesce(repos, 0) AS repos, coalesce(iterations, 0) AS iterations, CASE WHEN max_tests IS NOT NULL THEN greatest(max_tests - coalesce(tests, 0), 0) END AS tests_left,
 CASE WHEN max_repos IS NOT NULL THEN greatest(max_repos - coalesce(repos, 0), 0) END AS repos_left, CASE WHEN max_iterations IS NOT NULL THEN greatest(max_iterations - coalesce(iterations, 0), 0) END AS iterations_left FROM u JOIN p USING (plan) LEFT JOIN r USING (id) LEFT JOIN i USING (id))"""


@query(f"{_QUOTA} SELECT * FROM q")
def quota(spark, sf):
    return se.quota(USERS(spark, sf), RUNS(spark, sf), ITERATIONS(spark, sf), as_of())


@query(f"{_QUOTA} SELECT id, plan, gate FROM (SELECT id, plan, unnest([CASE WHEN tests_left = 0 THEN 'tests' END, CASE WHEN iterations_left = 0 THEN 'iterations' END, CASE WHEN iterations_left IS NOT NULL AND iterations >= 50 AND iterations_left = 0 THEN 'personal-key' END]) AS gate FROM q) WHERE gate IS NOT NULL")
def quota_denials(spark, sf):
    return se.quota_denials(se.quota(USERS(spark, sf), RUNS(spark, sf), ITERATIONS(spark, sf), as_of()))


@query(f"""{cte('runs')}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY completed_at DESC NULLS FIRST, id DESC) AS k FROM runs)
SELECT project_id, id, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' WHEN score IS NOT NULL THEN 'D' END AS letter, CASE WHEN score >= 80 THEN 'green' WHEN score >= 50 THEN 'yellow' WHEN score IS NOT NULL THEN 'red' ELSE 'grey' END AS color FROM r WHERE k = 1""")
def latest_score(spark, sf):
    return se.latest_score(RUNS(spark, sf))


@query(f"""{cte('findings')}, s AS (SELECT repo, dimension, count(*) FILTER (status = 'open' AND severity IN ('critical', 'high')) AS bad FROM findings GROUP BY ALL)
SELECT repo, count(*) AS stages, count(*) FILTER (bad = 0) AS passed, CAST(floor(100.0 * count(*) FILTER (bad = 0) / count(*) + 0.5) AS INTEGER) AS percent FROM s GROUP BY repo""")
def stage_summary(spark, sf):
    return se.stage_summary(FINDINGS(spark, sf))


_RESULTS = """SELECT CAST(l_orderkey AS BIGINT) AS run_id, CASE l_linenumber WHEN 1 THEN 'security' WHEN 2 THEN 'unit' WHEN 3 THEN 'load' ELSE 'other' END AS dimension,
CASE l_partkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'warning' WHEN 2 THEN 'pending' WHEN 3 THEN NULL WHEN 4 THEN 'running' ELSE 'passed' END AS status, CASE WHEN l_suppkey % 6 > 0 THEN CAST(l_quantity * 100 AS INTEGER) END AS duration_ms FROM lineitem"""
_STATES = ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in se.STAGE_STATES)


def _results(spark, sf):
    states = "CASE l_partkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'warning' WHEN 2 THEN 'pending' WHEN 3 THEN NULL WHEN 4 THEN 'running' ELSE 'passed' END"
    dimension = "CASE l_linenumber WHEN 1 THEN 'security' WHEN 2 THEN 'unit' WHEN 3 THEN 'load' ELSE 'other' END"
    ms = "CASE WHEN l_suppkey % 6 > 0 THEN CAST(l_quantity * 100 AS int) END"
    return table(spark, sf, "lineitem").select(F.expr("CAST(l_orderkey AS bigint)").alias("run_id"), F.expr(dimension).alias("dimension"), F.expr(states).alias("status"), F.expr(ms).alias("duration_ms"))


@query(f"SELECT run_id, count(*) AS total, {_STATES}, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS duration_ms, 100.0 * count(*) FILTER (status = 'passed') / count(*) AS percent FROM ({_RESULTS}) GROUP BY run_id")
def stage_status_by_run(spark, sf):
    return se.stage_status(_results(spark, sf), "run_id")


@query(f"SELECT dimension, count(*) AS total, {_STATES}, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS duration_ms, 100.0 * count(*) FILTER (status = 'passed') / count(*) AS percent FROM ({_RESULTS}) GROUP BY dimension")
def stage_status_by_dimension(spark, sf):
    return se.stage_status(_results(spark, sf), "dimension")


@query(f"{cte('runs')} SELECT id, CASE WHEN status <> 'running' THEN CASE WHEN id % 300 < 60 THEN concat(id % 300, 's') ELSE concat(id % 300 // 60, 'm ', id % 60, 's') END END AS duration FROM runs")
def run_duration(spark, sf):
    return se.run_duration(RUNS(spark, sf))


@query(f"""{cte('runs')}, c AS (SELECT user_id, CAST(started_at AS DATE) AS day, count(*) AS n, sum(total_findings) AS found FROM runs GROUP BY ALL), m AS (SELECT user_id, min(day) AS a, max(day) AS b FROM c GROUP BY user_id),
d AS (SELECT user_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM m)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n, CAST(coalesce(found, 0) AS BIGINT) AS found FROM d LEFT JOIN c USING (user_id, day)""")
def usage_by_day(spark, sf):
    return se.usage_by_day(RUNS(spark, sf))


@query("""WITH b AS (SELECT c_custkey AS id, c_name AS name, 0 AS version FROM customer UNION ALL SELECT CAST(c_custkey + 50 AS BIGINT), concat('new-', c_name), 1 FROM customer WHERE c_custkey % 3 = 0)
SELECT id, arg_max(name, version) AS name, max(version) AS version FROM b GROUP BY id""")
def upsert(spark, sf):
    c = table(spark, sf, "customer")
    now = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0).alias("version"))
    new = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 50).alias("id"), F.concat(F.lit("new-"), "c_name").alias("name"), F.lit(1).alias("version"))
    return se.upsert(now, new, "id", "version")


@query("""WITH c AS (SELECT DISTINCT user_id AS k, 0 AS first_id FROM events WHERE user_id % 2 = 0), n AS (SELECT user_id AS k, CAST(min(event_id) AS INTEGER) AS first_id FROM events WHERE user_id NOT IN (SELECT k FROM c) GROUP BY 1) SELECT * FROM c UNION ALL SELECT * FROM n""")
def insert_new(spark, sf):
    e = table(spark, sf, "events")
    have = e.where("user_id % 2 = 0").select(F.col("user_id").alias("k"), F.lit(0).alias("first_id")).distinct()
    return se.insert_new(have, e.select(F.col("user_id").alias("k"), F.col("event_id").cast("int").alias("first_id")), "k", "first_id")


@query(f"""{cte('billing')} SELECT customer, arg_max(CASE WHEN kind = 'deleted' THEN 'free' ELSE coalesce(plan, 'pro') END, struct_pack(ts := ts, id := id)) AS plan, count(*) AS n_events FROM billing WHERE kind <> 'other' GROUP BY customer""")
def plan_from_billing(spark, sf):
    return se.plan_from_billing(BILLING(spark, sf))


# Events that bring a user, a customer, both or neither; customers change hands. Users start with a plan, some with a customer.
_BILLS = {
    "id": "CAST(event_id AS bigint)", "ts": "CAST(ts AS timestamp)", "kind": "CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'updated' WHEN 'error' THEN 'deleted' ELSE 'other' END",
    "user_id": "CASE WHEN event_id % 3 > 0 AND event_type <> 'error' THEN CAST(user_id AS bigint) END", "customer": "CASE WHEN event_id % 5 > 0 THEN (user_id * 7 + event_id % 4) % 97 END", "plan": "CASE WHEN event_id % 4 = 0 THEN 'team' WHEN event_id % 4 = 1 THEN 'enterprise' END",
}
_BUYERS = {"id": "CAST(c_custkey AS bigint)", "plan": "CASE WHEN c_custkey % 2 = 0 THEN 'free' END", "customer": "CASE WHEN c_custkey % 3 = 0 THEN (CAST(c_custkey AS bigint) * 5) % 97 END"}


@query(f"""WITH e AS (SELECT {', '.join(f'{x} AS {c}' for c, x in _BILLS.items())} FROM events), u AS (SELECT {', '.join(f'{x} AS {c}' for c, x in _BUYERS.items())} FROM customer),
o AS (SELECT * REPLACE (CASE WHEN kind = 'deleted' THEN 'free' ELSE coalesce(plan, 'pro') END AS plan), row_number() OVER (ORDER BY ts, id) AS k FROM e WHERE kind <> 'other'),
link AS (SELECT id AS user_id, customer, CAST(0 AS BIGINT) AS k FROM u WHERE customer IS NOT NULL UNION ALL SELECT user_id, customer, k FROM o WHERE user_id IS NOT NULL AND customer IS NOT NULL),
asked AS (SELECT DISTINCT l.user_id, o.k, o.plan, o.customer FROM o JOIN link l ON l.customer = o.customer WHERE o.user_id IS NULL),
done AS (SELECT user_id, k, plan FROM o WHERE user_id IS NOT NULL UNION ALL SELECT a.user_id, a.k, a.plan FROM asked a ASOF JOIN link l ON l.user_id = a.user_id AND l.k <= a.k WHERE l.customer = a.customer),
now AS (SELECT user_id, arg_max(plan, k) AS plan, count(*) AS n FROM done GROUP BY user_id), last AS (SELECT user_id, arg_max(customer, k) AS customer FROM link GROUP BY user_id)
SELECT u.id AS user_id, coalesce(now.plan, u.plan, 'free') AS plan, last.customer, coalesce(n, 0) AS n_events FROM u LEFT JOIN now ON now.user_id = u.id LEFT JOIN last ON last.user_id = u.id""")
def plan_of_users(spark, sf):
    made = lambda name, columns: table(spark, sf, name).select(*[F.expr(x).alias(c) for c, x in columns.items()])
    return se.plan_of_users(made("events", _BILLS), made("customer", _BUYERS))


@query(f"{cte('requests')} SELECT concat('user-', CAST(caller AS varchar)) AS owner, count(*) AS n, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_used FROM requests WHERE caller % 5 <> 0 GROUP BY caller")
def key_usage(spark, sf):
    r = REQUESTS(spark, sf).withColumn("presented", F.concat(F.lit("key-"), F.col("caller").cast("string")))
    keys = r.select("caller", "presented").distinct().select(F.sha2("presented", 256).alias("key_hash"), F.concat(F.lit("user-"), F.col("caller").cast("string")).alias("owner"), (F.col("caller") % 5 == 0).alias("revoked"))
    return se.key_usage(r, keys)


@query(f"""{cte('requests')}, l AS (SELECT caller AS who, arg_max(kind, struct_pack(ts := ts, id := id)) AS kind, min(ts) AS since FROM requests WHERE kind IN ('signup', 'error') GROUP BY caller)
SELECT who, CAST(floor(epoch(since)) AS BIGINT) AS since FROM l WHERE kind = 'signup'""")
def active_subscribers(spark, sf):
    return se.active_subscribers(REQUESTS(spark, sf).withColumnRenamed("caller", "who"), "signup", "error")


@query(f"{cte('ledger')} SELECT title, state, n FROM (SELECT title, arg_max(state, struct_pack(entry_date := entry_date, pos := pos)) AS state, count(*) AS n FROM ledger GROUP BY title) WHERE state = 'open'")
def open_proposals(spark, sf):
    return se.open_proposals(LEDGER(spark, sf))


@query(f"""{cte('ledger')}, s AS (SELECT title, arg_max(state, struct_pack(entry_date := entry_date, pos := pos)) AS state FROM ledger GROUP BY title),
c AS (SELECT concat('idea ', CAST(p_partkey % 400 AS varchar)) AS title, max(p_size) AS weight FROM part GROUP BY 1)
SELECT title, weight FROM c WHERE title NOT IN (SELECT title FROM s WHERE state IN ('open', 'rejected')) ORDER BY weight DESC, title LIMIT 3""")
def new_proposals(spark, sf):
    c = table(spark, sf, "part").groupBy(F.expr("concat('idea ', CAST(p_partkey % 400 AS string))").alias("title")).agg(F.max("p_size").alias("weight"))
    return se.new_proposals(c, LEDGER(spark, sf))


@query("SELECT o_orderstatus AS stage, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS position, CAST(o_orderkey AS BIGINT) AS id FROM orders")
def tasks_by_stage(spark, sf):
    o = table(spark, sf, "orders")
    return se.tasks_by_stage(o.select(F.col("o_orderstatus").alias("stage"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").cast("bigint").alias("id")))


@query(f"{cte('runs')} SELECT id, started_at AS created_at, score FROM runs ORDER BY started_at DESC, id DESC LIMIT 20")
def top_reports(spark, sf):
    return se.top_reports(RUNS(spark, sf).select("id", F.col("started_at").alias("created_at"), "score"))


@query("SELECT CAST(l_orderkey AS BIGINT) AS run_id, max(CAST(l_shipdate AS TIMESTAMP)) AS created_at, count(*) AS tests, count(*) FILTER (l_returnflag = 'N') AS passed FROM lineitem GROUP BY 1 ORDER BY created_at DESC, run_id DESC LIMIT 20")
def top_generations(spark, sf):
    return se.top_generations(table(spark, sf, "lineitem").select(F.expr("CAST(l_orderkey AS bigint)").alias("run_id"), F.col("l_shipdate").cast("timestamp").alias("created_at"), F.expr("l_returnflag = 'N'").alias("passed")))


@query(f"{cte('findings', 'runs')} SELECT f.run_id, r.user_id, r.project_id, r.status AS run_status, f.severity, {_RANK} AS severity_rank, f.seq FROM findings f LEFT JOIN runs r ON r.id = f.run_id")
def report_detail(spark, sf):
    return se.report_detail(FINDINGS(spark, sf), RUNS(spark, sf))


# Reports of orders: several of one run, some without a known run; asked for by report, by run, and by others than the owner.
_REPORTS = {"id": "concat('rep-', CAST(o_orderkey AS string))", "run_id": "CASE WHEN o_orderkey % 9 > 0 THEN concat('run-', CAST(o_orderkey - o_orderkey % 5 AS string)) END", "title": "concat('report ', o_orderpriority)", "created_at": "CAST(o_orderdate AS timestamp)"}
_OWNED = {"id": "concat('run-', CAST(o_orderkey AS string))", "user_id": "CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS bigint) END", "project_id": "CAST(o_orderkey % 97 AS bigint)", "branch": "CASE WHEN o_orderkey % 2 = 0 THEN 'main' ELSE 'dev' END", "score": "CAST(o_orderkey % 101 AS int)"}
_ASKED = {"key": "CASE o_orderkey % 4 WHEN 0 THEN concat('run-', CAST(o_orderkey - o_orderkey % 5 AS string)) WHEN 1 THEN 'rep-0' ELSE concat('rep-', CAST(o_orderkey AS string)) END", "user_id": "CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE o_custkey END AS bigint)"}
_PROJECTS = {"id": "CAST(p_partkey AS bigint)", "name": "p_name", "repo_url": "concat('https://host/', CAST(p_size AS string))"}
_sql = lambda columns, source, where="true": f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source} WHERE {where}".replace("string)", "varchar)")


@query(f"""WITH reports AS ({_sql(_REPORTS, 'orders')}), runs AS ({_sql(_OWNED, 'orders', 'o_orderkey % 5 = 0')}), projects AS ({_sql(_PROJECTS, 'part', 'p_partkey % 97 < 80 AND p_partkey < 97')}), asked AS (SELECT DISTINCT * FROM ({_sql(_ASKED, 'orders')})),
b AS (SELECT a.key, a.user_id, r.*, row_number() OVER (PARTITION BY a.key, a.user_id ORDER BY CASE WHEN r.id = a.key THEN 0 ELSE 1 END, r.created_at DESC NULLS LAST, r.id) AS rank FROM asked a JOIN (SELECT id AS k, * FROM reports UNION ALL SELECT run_id, * FROM reports WHERE run_id IS NOT NULL) r ON r.k = a.key)
SELECT b.key, b.user_id, b.id, b.run_id, b.title, runs.branch, runs.score, projects.name AS project_name, projects.repo_url FROM b LEFT JOIN runs ON runs.id = b.run_id LEFT JOIN projects ON projects.id = runs.project_id WHERE rank = 1 AND (runs.user_id IS NULL OR runs.user_id = b.user_id)""")
def report_lookup(spark, sf):
    made = lambda columns, source: source.select(*[F.expr(e).alias(c) for c, e in columns.items()])
    orders, parts = table(spark, sf, "orders"), table(spark, sf, "part").where("p_partkey % 97 < 80 and p_partkey < 97")
    return se.report_lookup(made(_ASKED, orders), made(_REPORTS, orders), made(_OWNED, orders.where("o_orderkey % 5 = 0")), made(_PROJECTS, parts))


# ---------------------------------------------------------------- request logs and streams

_LEVELS = "SELECT concurrency, count(*) AS attempts, quantile_cont(latency, 0.5) AS p50, quantile_cont(latency, 0.9) AS p90, quantile_cont(latency, 0.99) AS p99, least(1.0, count(*) FILTER (status >= 300) / count(*)) AS error_rate FROM requests GROUP BY concurrency"


@query(f"{cte('requests')} {_LEVELS}")
def load_levels(spark, sf):
    return lo.load_levels(REQUESTS(spark, sf))


@query(f"{cte('requests')}, l AS ({_LEVELS}), f AS (SELECT min(concurrency) FILTER (error_rate > 0.2) AS breaks_at, max(concurrency) AS highest FROM l) SELECT breaks_at, coalesce(breaks_at, highest) AS headline FROM f")
def breaking_point(spark, sf):
    return lo.breaking_point(lo.load_levels(REQUESTS(spark, sf)), 0.2)


@query(f"{cte('requests')}, l AS ({_LEVELS}) SELECT max(concurrency) FILTER (error_rate <= 0.2) AS healthy, min(concurrency) FILTER (error_rate > 0.2) AS degraded FROM l")
def max_healthy(spark, sf):
    return lo.max_healthy(lo.load_levels(REQUESTS(spark, sf)), 0.2)


_HOURS = "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(*) FILTER (status >= 500) / count(*) AS rate FROM requests GROUP BY 1"


_FAULTS = f"{cte('requests')}, h AS ({_HOURS}), f AS (SELECT CAST(epoch(hour) AS BIGINT) AS phase_id, hour - INTERVAL 5000 SECOND AS baseline, hour AS start, hour + INTERVAL 2900 SECOND AS stop FROM h WHERE rate > 0.25)"


@query(f"""{_FAULTS} SELECT phase_id, count(*) FILTER (ts < start AND status >= 500) / nullif(count(*) FILTER (ts < start), 0) AS before, count(*) FILTER (ts >= start AND status >= 500) / nullif(count(*) FILTER (ts >= start), 0) AS during
FROM f LEFT JOIN requests ON ts >= baseline AND ts < stop GROUP BY phase_id""")
def phase_error_rates(spark, sf):
    r = REQUESTS(spark, sf)
    hours = r.groupBy(F.date_trunc("hour", "ts").alias("start")).agg((F.count_if(F.col("status") >= 500) / F.count(F.lit(1))).alias("rate")).where("rate > 0.25")
    phases = hours.select(F.unix_timestamp("start").alias("phase_id"), F.expr("start - interval 5000 seconds").alias("baseline"), "start", F.expr("start + interval 2900 seconds").alias("end"))
    return lo.phase_error_rates(r, phases)


@query(f"{cte('requests')}, h AS ({_HOURS}), f AS (SELECT hour AS cleared FROM h WHERE rate > 0.35) SELECT CAST(epoch(cleared) AS BIGINT) AS fault_id, CAST((SELECT min(epoch(hour)) FROM h WHERE hour >= cleared AND hour < cleared + INTERVAL 6 HOUR AND rate <= 0.1 + 0.05) - epoch(cleared) AS BIGINT) AS seconds FROM f")
def recovery_time(spark, sf):
    hours = REQUESTS(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("ts")).agg((F.count_if(F.col("status") >= 500) / F.count(F.lit(1))).alias("rate"))
    faults = hours.where("rate > 0.35").select(F.unix_timestamp("ts").alias("fault_id"), F.col("ts").alias("cleared"), (F.col("ts") + F.expr("interval 6 hours")).alias("until"))
    return lo.recovery_time(hours, faults, 0.1, 0.05)


@query(f"{cte('requests')}, w AS (SELECT id, caller, count(*) OVER (PARTITION BY caller ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS n FROM requests) SELECT id, caller, n AS in_window, n <= 5 AS allowed, greatest(5 - n, 0) AS remaining FROM w")
def rate_limit_sliding(spark, sf):
    return lo.rate_limit_sliding(REQUESTS(spark, sf), 5, 21600)


@query(f"""{cte('requests')}, o AS (SELECT id, caller, epoch_us(ts) AS t, row_number() OVER (PARTITION BY caller ORDER BY epoch_us(ts), id) AS k FROM requests),
w AS (WITH RECURSIVE step AS (SELECT id, caller, k, t + 21600000000 AS ends, 1 AS n FROM o WHERE k = 1
 UNION ALL SELECT o.id, o.caller, o.k, CASE WHEN o.t > step.ends THEN o.t + 21600000000 ELSE step.ends END, CASE WHEN o.t > step.ends THEN 1 ELSE step.n + 1 END FROM step JOIN o ON o.caller = step.caller AND o.k = step.k + 1) SELECT * FROM step)
SELECT id, caller, CAST(n AS BIGINT) AS count, n <= 2 AS allowed FROM w""")
def rate_limit_fixed(spark, sf):
    return lo.rate_limit_fixed(REQUESTS(spark, sf), 2, 21600)


@query(f"{cte('requests')}, h AS ({_HOURS}) SELECT CAST(epoch(hour) AS BIGINT) AS start, n, rate FROM h")
def error_rate_windows(spark, sf):
    return lo.error_rate_windows(REQUESTS(spark, sf))


@query(f"{cte('requests')} SELECT caller, arg_max(kind, id) AS status, count(*) FILTER (kind = 'purchase') AS completed FROM requests GROUP BY caller")
def latest_state(spark, sf):
    return lo.latest_state(REQUESTS(spark, sf).select("caller", "id", F.col("kind").alias("status")), "caller", "id", "purchase")


@query("SELECT DISTINCT event_id % 1000 AS id FROM events")
def dedupe_events(spark, sf):
    return jobs.dedupe_events(table(spark, sf, "events").select((F.col("event_id") % 1000).alias("id")))


@query("""SELECT concat('https://host/u', CAST(user_id AS varchar), '.git') AS repo_url, concat('b', CAST(event_id % 7 AS varchar)) AS branch, substring(md5(CAST(event_id AS varchar)), 1, 7) AS "commit" FROM events WHERE event_type = 'click'""")
def parse_push_events(spark, sf):
    body = F.to_json(F.struct(F.concat(F.lit("refs/heads/b"), (F.col("event_id") % 7).cast("string")).alias("ref"), F.md5(F.col("event_id").cast("string")).alias("after"), F.struct(F.concat(F.lit("https://host/u"), F.col("user_id").cast("string"), F.lit(".git")).alias("clone_url")).alias("repository")))
    return jobs.parse_push_events(table(spark, sf, "events").select(F.when(F.col("event_type") == "click", "push").otherwise("ping").alias("event"), body.alias("body")))


# ---------------------------------------------------------------- corpus scans


@query(f"{cte('docs')} SELECT repo, count(*) AS files, CAST(sum(length(content) - length(replace(content, chr(10), '')) + 1) AS BIGINT) AS lines, CAST(sum(length(content)) AS BIGINT) AS chars FROM docs GROUP BY repo")
def scan_summary(spark, sf):
    return tx.scan_summary(DOCS(spark, sf))


@query(rf"""{cte('docs')}, n AS (SELECT *, length(content) - length(replace(content, chr(10), '')) AS k FROM docs)
SELECT repo, path, regexp_extract(path, '\.([A-Za-z0-9]+)$', 1) AS ext, regexp_matches(path, '{tx.TEST_PATH}') AS is_test, (k <= 1 AND length(content) > 5000) OR length(content) > 500 * (k + 1) AS is_minified, k + 1 AS n_lines FROM n""")
def path_flags(spark, sf):
    return tx.path_flags(DOCS(spark, sf))


# Paths and what they are: example, vendored, generated, parseable, user interface.
_PATHS = [
    ("src/a.ts", 0, 0, 0, 1, 0), ("Examples/a.js", 1, 0, 0, 1, 0), ("x/demo/b.vue", 1, 0, 0, 0, 1), ("vendor/c.go", 0, 1, 1, 0, 0), ("third-party/d.jsx", 0, 1, 1, 1, 1), ("lib/e.min.js", 0, 1, 1, 1, 0), ("app/__generated__/f.TSX", 0, 0, 1, 0, 1), ("api/g.gen.ts", 0, 0, 1, 1, 0),
    ("p/h_pb2.py", 0, 0, 1, 0, 0), ("types/i.d.ts", 0, 0, 1, 1, 0), ("samplesx/j.html", 0, 0, 0, 0, 1), ("buildings/k.mjs", 0, 0, 0, 1, 0), ("samples/dist/l.bundle.js", 1, 1, 1, 1, 0), ("notes.md", 0, 0, 0, 0, 0),
]


@query(f"""WITH k(i, path, e, v, g, p, u) AS (VALUES {', '.join(f'({i}, {", ".join(repr(x) for x in row)})' for i, row in enumerate(_PATHS))})
SELECT p_brand AS repo, concat('r', p_partkey, '/', path) AS path, e = 1 AS is_example, v = 1 AS is_vendored, g = 1 AS is_generated, k.p = 1 AS is_parseable, u = 1 AS is_ui FROM part JOIN k ON i = p_size % {len(_PATHS)}""")
def path_kinds(spark, sf):
    path = f"CASE p_size % {len(_PATHS)} " + " ".join(f"WHEN {i} THEN '{row[0]}'" for i, row in enumerate(_PATHS)) + " END"
    return tx.path_kinds(table(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.expr(f"concat('r', CAST(p_partkey AS string), '/', {path})").alias("path")))


_EXT = "CASE lang WHEN 'en' THEN 'py' WHEN 'de' THEN 'rb' WHEN 'fr' THEN 'go' ELSE CASE WHEN doc_id % 3 = 0 THEN 'java' WHEN doc_id % 3 = 1 THEN 'cpp' ELSE 'md' END END"


@query(f"""WITH l AS (SELECT source AS repo, {_EXT} AS ext, count(*) AS n FROM documents GROUP BY ALL), m(ext, language) AS (VALUES ('rb', 'Ruby'), ('java', 'Java'), ('cpp', 'C++')), g AS (SELECT repo, sum(n) FILTER (ext IN ('py', 'go')) AS own, sum(n) FILTER (language IS NOT NULL) AS other, string_agg(language, ',' ORDER BY n DESC, language) AS u FROM l LEFT JOIN m USING (ext) GROUP BY repo)
SELECT repo, CAST(coalesce(own, 0) AS BIGINT) AS native, CASE WHEN own IS NULL AND other IS NULL THEN 100 ELSE CAST(floor(100.0 * coalesce(own, 0) / (coalesce(own, 0) + coalesce(other, 0)) + 0.5) AS INTEGER) END AS percent, coalesce(u, '') AS unsupported FROM g""")
def language_coverage(spark, sf):
    d = table(spark, sf, "documents")
    return tx.language_coverage(d.select(F.col("source").alias("repo"), F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.lit("."), F.expr(_EXT)).alias("path")))


_MARKS = [("license", "FIXME"), ("token", "HACK"), (" und ", " XXX "), (" the ", " WORKAROUND "), (" la ", " TODO ")]


@query(f"WITH d AS (SELECT source AS repo, concat('doc/', CAST(doc_id AS varchar), '.', lang) AS path, {' + '.join(f'(length(text) - length(replace(text, {chr(39)}{a}{chr(39)}, {chr(39)}{chr(39)}))) // {len(a)}' for a, _ in _MARKS)} + len(regexp_extract_all(text, 'TODO|FIXME|HACK|XXX|WORKAROUND')) AS n FROM documents) SELECT repo, path, n FROM d WHERE n > 0")
def todo_counts(spark, sf):
    content = F.col("content")
    for a, b in _MARKS:
        content = F.replace(content, F.lit(a), F.lit(b))
    return tx.todo_counts(DOCS(spark, sf).withColumn("content", content))


@query(f"{cte('docs')} SELECT repo, bool_or(regexp_matches(content, '[0-9]{{13,}}')) AS numbers, bool_or(regexp_matches(content, '@[a-z0-9]+[.]')) AS mail, bool_or(regexp_matches(content, '(?i)licen[sc]e')) AS licensed FROM docs GROUP BY repo")
def content_flags(spark, sf):
    return tx.content_flags(DOCS(spark, sf), {"numbers": "[0-9]{13,}", "mail": "@[a-z0-9]+[.]", "licensed": "(?i)licen[sc]e"})


@query(f"{cte('docs')} SELECT path, size FROM docs WHERE NOT regexp_matches(path, '{tx.SKIPPED}')")
def filter_sources(spark, sf):
    return tx.filter_sources(DOCS(spark, sf)).select("path", "size")


@query(f"""{cte('docs')}, o AS (SELECT repo, path, size, row_number() OVER (PARTITION BY repo ORDER BY path) AS k FROM docs WHERE size <= 8000),
w AS (WITH RECURSIVE step AS (SELECT repo, path, size, k, size <= 40000 AS kept, CASE WHEN size <= 40000 THEN size ELSE 0 END AS total, CASE WHEN size <= 40000 THEN 1 ELSE 0 END AS files FROM o WHERE k = 1
 UNION ALL SELECT o.repo, o.path, o.size, o.k, step.files < 20 AND step.total + o.size <= 40000, CASE WHEN step.files < 20 AND step.total + o.size <= 40000 THEN step.total + o.size ELSE step.total END, CASE WHEN step.files < 20 AND step.total + o.size <= 40000 THEN step.files + 1 ELSE step.files END
 FROM step JOIN o ON o.repo IS NOT DISTINCT FROM step.repo AND o.k = step.k + 1) SELECT * FROM step)
SELECT repo, path, size FROM w WHERE kept""")
def scan_budget(spark, sf):
    return tx.scan_budget(DOCS(spark, sf), 8000, 40_000, 20)


_UI = """WITH u AS (SELECT p_brand AS repo, concat('ui/', CAST(p_partkey AS varchar), '.html') AS path, unnest([1, 2, 3, 4]) AS line, unnest([CASE WHEN p_size % 3 = 0 THEN '<img src=a>' ELSE '<img src=a alt=b>' END, concat('<h', CAST(p_size % 2 + 1 AS varchar), '>t'), concat('<h', CAST(p_size % 4 + 1 AS varchar), '>u'), CASE WHEN p_size % 5 = 0 THEN '<a href=x> </a>' ELSE '<input type=text>' END]) AS text FROM part)"""


def _ui(spark, sf):
    lines = F.expr("array(CASE WHEN p_size % 3 = 0 THEN '<img src=a>' ELSE '<img src=a alt=b>' END, concat('<h', CAST(p_size % 2 + 1 AS string), '>t'), concat('<h', CAST(p_size % 4 + 1 AS string), '>u'), CASE WHEN p_size % 5 = 0 THEN '<a href=x> </a>' ELSE '<input type=text>' END)")
    files = table(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.expr("concat('ui/', CAST(p_partkey AS string), '.html')").alias("path"), F.array_join(lines, "\n").alias("content"))
    return fi.explode_lines(files)


@query(rf"""{_UI}, h AS (SELECT *, CAST(regexp_extract(text, '<h([1-6])[ >]', 1) AS INTEGER) AS level FROM u WHERE regexp_matches(text, '<h([1-6])[ >]')), b AS (SELECT *, lag(level) OVER (PARTITION BY repo, path ORDER BY line) AS before FROM h)
SELECT repo, path, line, before, level FROM b WHERE level > before + 1""")
def heading_skips(spark, sf):
    return tx.heading_skips(_ui(spark, sf))


@query(rf"""{_UI} SELECT repo, path, line, 'img-alt' AS rule FROM u WHERE contains(text, '<img') AND NOT contains(text, 'alt=') UNION ALL SELECT repo, path, line, 'input-label' FROM u WHERE contains(text, '<input') UNION ALL SELECT repo, path, line, 'empty-link' FROM u WHERE regexp_matches(text, '<a\b[^>]*>\s*</a>')""")
def accessibility_findings(spark, sf):
    return tx.accessibility_findings(_ui(spark, sf))


@query("""SELECT p_brand AS repo, concat('src/', CAST(p_partkey AS varchar), '.js') AS path, unnest(list_distinct(['f' || CAST(p_size AS varchar), 'g' || CAST(p_size % 7 AS varchar)])) AS name FROM part""")
def function_names(spark, sf):
    content = F.expr("concat('function f', CAST(p_size AS string), '(a) { return a }\nasync function g', CAST(p_size % 7 AS string), '() {}')")
    return tx.function_names(table(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.expr("concat('src/', CAST(p_partkey AS string), '.js')").alias("path"), content.alias("content")))
