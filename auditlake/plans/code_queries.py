"""Queries over code and manifests that Spark derives from `part`; the SQL says what each part's numbers must lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators import config as co
from auditlake.operators import detectors as de
from auditlake.operators import facts as fa
from auditlake.operators import joins as jo
from auditlake.operators import findings as fi
from auditlake.operators import reports as re_
from auditlake.operators import taint as ta
from auditlake.operators import text as tx
from auditlake.plans.bindings import table
from auditlake.plans.registry import query
from auditlake.sources.store import stored
from auditlake.sources import manifests as ma

_CODE = [
    "'import { f0 } from \"./lib.js\";'",
    "concat('export function fn', CAST(p_partkey AS string), '(x) { if (x && x.y) { return 1 }', repeat(' if (x) { y() }', p_size % 5), ' return 0 }')",
    "concat('app.', CASE WHEN p_size % 2 = 0 THEN 'post' ELSE 'get' END, '(\"/r', CAST(p_size % 5 AS string), '\", async (req, res) => { const id = req.query.id; db.query(', "
    "CASE p_size % 3 WHEN 0 THEN '\"select \" + id' WHEN 1 THEN concat('`select $', '{id}`') ELSE '\"select ?\", [id]' END, '); ', CASE WHEN p_size % 6 = 0 THEN 'fs.readFileSync(p); ' ELSE '' END, '});')",
    "CASE p_size % 4 WHEN 0 THEN 'for (const r of rows) { db.find(r) }' WHEN 1 THEN 'rows.map(r => db.query(r));' WHEN 2 THEN 'Promise.all(rows.map(r => db.query(r)));' ELSE 'rows.forEach(r => log(r));' END",
    "CASE WHEN p_size % 2 = 0 THEN 'if (a == b) { parseInt(z) }' ELSE 'if (a === b) { parseInt(z, 10) }' END",
    "CASE WHEN p_size % 7 = 0 THEN 'switch (k) { case 1: break; }' ELSE 'switch (k) { case 1: break; default: break; }' END",
    "concat(CASE p_size % 9 WHEN 0 THEN 'it.skip' WHEN 1 THEN 'it.only' ELSE 'it' END, '(\"works fn', CAST(p_partkey - p_partkey % 3 AS string), '\", () => { ', CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN 'g()' WHEN p_size % 8 = 7 THEN repeat('expect(2).toMatchSnapshot(); ', 1 + p_size % 3)"
    " ELSE concat(CASE WHEN p_size % 2 = 0 THEN 'expect(1).toBe(1); ' ELSE 'expect(1).toBeTruthy(); ' END, repeat('expect(2).toMatchSnapshot(); ', p_size % 3), repeat('expect(3).toBeDefined(); ', p_size % 4), CASE WHEN p_size % 6 = 0 THEN 'expect(4).toEqual(4); ' ELSE '' END) END, ' });')",
    "CASE p_size % 4 WHEN 0 THEN '// redis' WHEN 1 THEN '// Cloudflare' WHEN 2 THEN '// pool_size' ELSE '' END",
    "CASE WHEN p_size % 6 = 1 THEN 'fs.readFileSync(p);' ELSE '' END",
    "concat(CASE WHEN p_size % 3 = 0 THEN 'JSON.parse(s); ' ELSE 'try { JSON.parse(s) } catch (e) {} ' END, repeat('Number(z); ', p_size % 5), repeat('new Date(s); ', p_size % 6), CASE WHEN p_size % 7 = 3 THEN 'app.use(mw); ' ELSE '' END)",
    "concat(CASE WHEN p_size % 3 = 1 THEN concat('router.put(\"/x\", ', CASE WHEN p_size % 2 = 0 THEN 'requireAuth, ' ELSE '' END, 'h); ') ELSE '' END, CASE p_size % 13 WHEN 0 THEN 'cors(); ' WHEN 1 THEN 'cors({ origin: \"*\", credentials: true }); ' WHEN 2 THEN 'cors({ origin: true }); ' WHEN 3 THEN 'res.json({ password: p }); ' ELSE '' END)",
    "concat(CASE WHEN p_size % 4 = 1 THEN 'fc.property(g); ' ELSE '' END, repeat('invariant(x); ', p_size % 4), repeat('typeof y; ', p_size % 6))",
    "CASE p_size % 6 WHEN 0 THEN 'eval(w);' WHEN 1 THEN 'setInterval(\"x\", 1);' WHEN 2 THEN 'res.redirect(w);' WHEN 3 THEN 'res.send(\"<b>\" + w);' WHEN 4 THEN 'fs.readFile(\"a\" + w);' ELSE 'exec(w);' END",
]
_PYTHON = [
    "concat('def a(x=', CASE WHEN p_size % 2 = 0 THEN '[]' ELSE 'None' END, '):')", "'    q = request.args[\"q\"]'",
    "concat('    cur.execute(', CASE WHEN p_size % 3 = 0 THEN 'f\"select {q}\"' ELSE '\"select ?\", [q]' END, ')')", "concat('    requests.get(q', CASE WHEN p_size % 5 = 0 THEN '' ELSE ', timeout=3' END, ')')",
]
_OWN = "concat('p', CAST(p_partkey AS string))"
_AT = "p_brand AS repo, concat('src/', CAST(p_partkey AS varchar), '.js') AS path"


def _parts(spark, sf) -> DataFrame:
    """The table's few files spread over the cores before contents grow from its rows."""
    return table(spark, sf, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def _code(spark, sf, lines: list[str], ext: str, repo: str = "p_brand") -> DataFrame:
    parts = _parts(spark, sf)
    return parts.select(F.expr(repo).alias("repo"), F.expr(f"concat('src/', CAST(p_partkey AS string), '.{ext}')").alias("path"), F.array_join(F.array(*map(F.expr, lines)), "\n").alias("content"))


def _facts(spark, sf, repo: str = "p_brand") -> DataFrame:
    return fa.code_facts(_code(spark, sf, _CODE, "js", repo))


def _functions_and_tests(spark, sf) -> DataFrame:
    """The facts of both kinds, written once, as they are asked for separately."""
    return stored(_facts(spark, sf).where("kind IN ('function', 'test')"))


def _project(spark, sf, **files: str) -> DataFrame:
    """One repo for each part, with the given files; content is an expression."""
    made = F.array(*[F.struct(F.lit(p.replace("__", "/").replace("_DOT_", ".").replace("_DASH_", "-")).alias("path"), F.expr(e).alias("content")) for p, e in files.items()])
    return _parts(spark, sf).select(F.expr(_OWN).alias("repo"), F.explode(made).alias("f")).select("repo", "f.*")


def _manifests(spark, sf) -> DataFrame:
    return _project(
        spark, sf,
        package_DOT_json="""concat('{"dependencies":{"express":"^', CAST(p_size % 6 AS string), '.1.0","lodash":"', CAST(p_size % 5 AS string), '.0.0"},"devDependencies":{"', CASE WHEN p_size % 2 = 0 THEN 'jest' ELSE 'helmet' END, '":"1.0"}}')""",
        requirements_DOT_txt="concat('Django==4.', CAST(p_size % 3 AS string), '.1\n# c\nflask_login>=0.', CAST(p_size % 4 AS string), '\n')",
    )


_DEPS = """WITH deps AS (
  SELECT p_partkey, p_size, unnest(['express', 'lodash', CASE WHEN p_size % 2 = 0 THEN 'jest' ELSE 'helmet' END, 'django', 'flask-login']) AS name,
         unnest([concat('^', p_size % 6, '.1.0'), concat(p_size % 5, '.0.0'), '1.0', concat('==4.', p_size % 3, '.1'), concat('>=0.', p_size % 4)]) AS spec, unnest(['runtime', 'runtime', 'dev', 'runtime', 'runtime']) AS scope FROM part)"""


@query(f"{_DEPS} SELECT concat('p', p_partkey) AS repo, name, spec, scope FROM deps")
def declared_deps(spark, sf):
    return ma.extract_deps(_manifests(spark, sf)).select("repo", "name", "spec", "scope")


@query("SELECT concat('p', p_partkey) AS repo, unnest(CASE WHEN p_size % 2 = 0 THEN ['Express', 'Django', 'Testing'] ELSE ['Express', 'Django'] END) AS stack FROM part")
def tech_stack(spark, sf):
    return ma.tech_stack(ma.extract_deps(_manifests(spark, sf)))


@query(f"{_DEPS} SELECT concat('p', p_partkey) AS repo, name, spec, 'medium' AS severity FROM deps WHERE name = 'lodash' OR (name = 'express' AND p_size % 6 <= 4)")
def dependency_findings(spark, sf):
    return de.dependency_findings(ma.extract_deps(_manifests(spark, sf)))


def _web(spark, sf) -> DataFrame:
    """Dependencies of one project for each part: a web framework or not, limits, headers, an ORM, an old package, tests."""
    names = ["CASE p_size % 3 WHEN 0 THEN 'express' WHEN 1 THEN 'fastify' ELSE 'left-pad' END", "CASE WHEN p_size % 2 = 0 THEN 'express-rate-limit' ELSE 'pino' END", "CASE WHEN p_size % 5 < 2 THEN 'helmet' ELSE 'yargs' END", "CASE p_size % 4 WHEN 0 THEN 'prisma' WHEN 1 THEN 'drizzle-orm' ELSE 'chalk' END", "CASE p_size % 7 WHEN 0 THEN 'minimist' WHEN 1 THEN 'semver' WHEN 2 THEN 'node-fetch' ELSE 'vitest' END"]
    listed = ", ',', ".join(f"""'"', {n}, '":"0.5.0"'""" for n in names)
    return ma.extract_deps(_project(spark, sf, package_DOT_json=f"""concat('{{"dependencies":{{', {listed}, '}}}}')"""))


@query("SELECT concat('p', p_partkey) AS repo, p_size % 2 > 0 AS no_rate_limit, p_size % 5 >= 2 AS no_headers FROM part WHERE p_size % 3 < 2 AND NOT (p_size % 2 = 0 AND p_size % 5 < 2)")
def missing_controls(spark, sf):
    return de.missing_controls(_web(spark, sf))


@query("""WITH s AS (SELECT *, CAST(p_size % 3 < 2 AS INTEGER) + CAST(p_size % 4 < 2 AS INTEGER) + CAST(p_size % 7 > 2 AS INTEGER) AS strengths, CASE p_size % 7 WHEN 0 THEN 8 WHEN 1 THEN 15 WHEN 2 THEN 3 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 8 ELSE 0 END AS cost FROM part)
SELECT concat('p', p_partkey) AS repo, strengths, greatest(0, least(100, 70 + 5 * strengths - cost)) AS score FROM s""")
def stack_report(spark, sf):
    deps = _web(spark, sf)
    return de.stack_report(deps, {"web": ["express", "fastify"], "orm": ["prisma", "drizzle-orm"], "tests": ["vitest", "jest"]}, de.dependency_findings(deps))


@query("""SELECT concat('p', p_partkey) AS repo, unnest(['a', '@s/b', 'h.io/m']) AS name, unnest([concat('1.', p_size), concat('2.', p_size % 3), concat('v0.', p_size, '.0')]) AS version, unnest([true, false, NULL]) AS is_direct FROM part""")
def lock_entries(spark, sf):
    files = _project(
        spark, sf,
        package_DASH_lock_DOT_json="""concat('{"packages":{"":{"dependencies":{"a":"1"}},"node_modules/a":{"version":"1.', CAST(p_size AS string), '"},"node_modules/a/node_modules/@s/b":{"version":"2.', CAST(p_size % 3 AS string), '"}}}')""",
        go_DOT_sum="concat('h.io/m v0.', CAST(p_size AS string), '.0 h1:x=\nh.io/m v0.', CAST(p_size AS string), '.0/go.mod h1:y=\n')",
    )
    return ma.lock_entries(files).select("repo", "name", "version", "is_direct")


@query("SELECT concat('p', p_partkey) AS repo, 'a' AS name, CASE p_size % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPL-3.0' END AS license FROM part")
def installed_licenses(spark, sf):
    text = """concat('{"name":"a"', CASE p_size % 3 WHEN 0 THEN ',"license":"MIT"' WHEN 1 THEN ',"license":{"type":"GPL-3.0"}' ELSE '' END, '}')"""
    return ma.installed_licenses(_project(spark, sf, node_modules__a__package_DOT_json=text)).select("repo", "name", "license")


@query("""SELECT concat('p', p_partkey) AS repo, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 100.0 * (p_size % 11 + 2) / 20 END AS pct,
CASE WHEN p_size % 2 = 0 THEN 'istanbul' ELSE 'lcov' END AS format FROM part""")
def measured_coverage(spark, sf):
    files = _project(
        spark, sf,
        cov__lcov_DOT_info="concat('SF:a\nLF:10\nLH:', CAST(p_size % 11 AS string), '\nSF:b\nLF:10\nLH:2\n')",
        coverage__coverage_DASH_summary_DOT_json="CASE WHEN p_size % 2 = 0 THEN concat('{\"total\":{\"lines\":{\"pct\":', CAST(p_size AS string), '}}}') ELSE '{}' END",
    )
    return ma.read_coverage(files).select("repo", "pct", "format")


@query("SELECT concat('p', p_partkey) AS repo, concat(CASE WHEN p_size % 2 = 0 THEN 'libs/' ELSE 'mods/' END, 'm') AS member FROM part")
def workspace_members(spark, sf):
    files = _project(
        spark, sf, package_DOT_json="'{\"workspaces\":[\"mods/*\"]}'", libs__m__package_DOT_json="CASE WHEN p_size % 2 = 0 THEN '{}' END", mods__m__package_DOT_json="CASE WHEN p_size % 2 = 1 THEN '{}' END"
    )
    return ma.workspace_members(files.where("content is not null"))


@query(f"""SELECT {_AT}, 3 + p_size % 5 AS max_cc, 5 + p_size % 5 + CAST(p_size % 4 > 0 AS INTEGER) AS total_cc, 3 + CAST(p_size % 4 > 0 AS INTEGER) AS n,
concat('fn', p_partkey, ':', 3 + p_size % 5, ',(anonymous):1,(anonymous):1') AS hottest FROM part""")
def code_complexity(spark, sf):
    return de.complexity_by_file(fa.js_functions(_facts(spark, sf)))


@query(f"""SELECT {_AT}, 3 AS line, 'sql-injection' AS rule, 'critical' AS severity, 'high' AS confidence FROM part WHERE p_size % 3 < 2
UNION ALL SELECT {_AT}, 13, CASE p_size % 6 WHEN 0 THEN 'eval' WHEN 1 THEN 'string-timer' WHEN 2 THEN 'open-redirect' WHEN 3 THEN 'reflected-xss' WHEN 4 THEN 'path-traversal' ELSE 'shell' END,
CASE p_size % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 5 THEN 'critical' ELSE 'low' END, 'low' FROM part""")
def injection_findings(spark, sf):
    return de.injection_findings(fa.js_calls(_facts(spark, sf))).select("repo", "path", "line", "rule", "severity", "confidence")


# Helpers f0, f1, ...: each hands one of its two parameters to the one before it, in one of four ways to import it; every
# fifth hands it to a sink instead. Routes call them with data of a request, with a text built from parts or with a constant.
_OWN_PARAM, _NEXT_ARG, _SAFE = "p_size % 2", "(p_size DIV 2) % 2", "p_size % 7 = 0"
_PARAM = f"CASE WHEN {_OWN_PARAM} = 0 THEN 'a' ELSE 'b' END"
_SINK = "CASE p_size % 5 WHEN 0 THEN 'db.query(' WHEN 1 THEN 'eval(' WHEN 2 THEN 'res.redirect(302, ' WHEN 3 THEN 'fs.readFile(' ELSE 'res.send(' END"
_BEFORE = "CAST(p_partkey - 1 AS string)"
_HELPER = [
    f"CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CASE p_size % 4 WHEN 0 THEN concat('import {{ f', {_BEFORE}, ' as g }} from \"./m', {_BEFORE}, '.js\";') WHEN 1 THEN concat('import * as lib from \"./m', {_BEFORE}, '\";')"
    f" WHEN 2 THEN concat('const {{ f', {_BEFORE}, ': g }} = require(\"./m', {_BEFORE}, '\");') ELSE concat('import g from \"./m', {_BEFORE}, '.js\";') END END",
    "concat('export default function f', CAST(p_partkey AS string), '(a, b) {')",
    f"concat('  const v = ', CASE WHEN {_SAFE} THEN concat('escape(', {_PARAM}, ')') ELSE concat({_PARAM}, ' + \"x\"') END, ';')",
    f"CASE WHEN p_partkey % 5 = 0 THEN concat('  return ', {_SINK}, 'v)') ELSE concat('  return ', CASE WHEN p_size % 4 = 1 THEN concat('lib.f', {_BEFORE}) ELSE 'g' END, CASE WHEN {_NEXT_ARG} = 0 THEN '(v, 1)' ELSE '(1, v)' END) END",
    "'}'",
    "concat('export { f', CAST(p_partkey AS string), ' }')",
    "concat('app.get(\"/\", (req, res) => { f', CAST(p_partkey AS string), CASE p_size % 3 WHEN 0 THEN '(req.query.a, 1)' WHEN 1 THEN '(1, req.body.b)' ELSE concat('(`t $', '{x}`, \"c\")') END, ' })')",
]


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k, p_size AS z, p_size % 2 AS own, (p_size // 2) % 2 AS next, p_size % 7 = 0 AS safe FROM part),
sink(k, own, category, cleaned) AS (
    SELECT k, own, CASE z % 5 WHEN 0 THEN 'SQL Injection' WHEN 1 THEN 'Dangerous Functions' WHEN 2 THEN 'Open Redirect' WHEN 3 THEN 'Path Traversal' ELSE 'XSS' END, safe FROM p WHERE k % 5 = 0
    UNION ALL SELECT p.k, p.own, category, cleaned OR p.safe FROM sink s JOIN p ON p.k = s.k + 1 AND p.k % 5 > 0 AND p.next = s.own)
SELECT concat('r', k // 20) AS repo, concat('src/m', k, '.js') AS path, concat('f', k) AS callee, category,
       CASE WHEN cleaned THEN 'medium' WHEN z % 3 = 2 THEN 'low' ELSE 'high' END AS confidence,
       CASE category WHEN 'SQL Injection' THEN 'critical' WHEN 'Dangerous Functions' THEN 'critical' WHEN 'Open Redirect' THEN 'medium' ELSE 'high' END AS severity
FROM sink s JOIN p USING (k) WHERE s.own = CASE WHEN z % 3 = 1 THEN 1 ELSE 0 END""")
def cross_file_taint(spark, sf):
    at = [F.expr("concat('r', CAST(p_partkey DIV 20 AS string))").alias("repo"), F.expr("concat('src/m', CAST(p_partkey AS string), '.js')").alias("path")]
    files = _parts(spark, sf).select(*at, F.array_join(F.array(*map(F.expr, _HELPER)), "\n").alias("content"))
    return ta.cross_file_taint(stored(fa.code_facts(files)), files).select("repo", "path", "callee", "category", "confidence", "severity")


@query(f"""SELECT {_AT}, 3 AS line, 'route-without-auth' AS rule, 'medium' AS severity FROM part WHERE p_size % 2 = 0
UNION ALL SELECT {_AT}, 11, 'route-without-auth', 'medium' FROM part WHERE p_size % 3 = 1 AND p_size % 2 = 1
UNION ALL SELECT {_AT}, 11, CASE p_size % 13 WHEN 0 THEN 'cors-default' WHEN 3 THEN 'sensitive-response' ELSE 'cors-wildcard' END, CASE p_size % 13 WHEN 1 THEN 'high' WHEN 3 THEN 'high' ELSE 'medium' END FROM part WHERE p_size % 13 < 4""")
def route_findings(spark, sf):
    return de.route_findings(fa.js_calls(_facts(spark, sf))).select("repo", "path", "line", "rule", "severity")


@query(f"SELECT * FROM (SELECT {_AT}, 4 AS line, row_number() OVER (PARTITION BY p_brand ORDER BY concat('src/', CAST(p_partkey AS varchar), '.js')) AS rank, count(*) OVER (PARTITION BY p_brand) AS total FROM part WHERE p_size % 4 < 2) WHERE rank <= 8")
def n_plus_one(spark, sf):
    return de.n_plus_one_findings(fa.js_calls(_facts(spark, sf))).select("repo", "path", "line", "rank", "total")


@query("""SELECT p_brand AS repo, count(*) FILTER (p_size % 2 = 0) AS parse_int_radix, count(*) FILTER (p_size % 3 = 0) AS json_parse_unguarded, CAST(sum(p_size % 5) AS BIGINT) AS number_unchecked, CAST(sum(p_size % 6) AS BIGINT) AS new_date,
count(*) FILTER (p_size % 2 = 0) AS loose_equality, count(*) FILTER (p_size % 7 = 0) AS switch_no_default FROM part GROUP BY p_brand""")
def edge_case_counts(spark, sf):
    return de.edge_case_counts(_facts(spark, sf))


@query("SELECT p_brand AS repo, count(*) AS cases, count(*) FILTER (p_size % 9 = 0) AS skipped, count(*) FILTER (p_size % 9 = 1) AS focused, count(*) FILTER (p_size % 5 = 0) AS empty, count(*) FILTER (p_size % 5 = 1 AND p_size % 9 > 0) AS assertionless FROM part GROUP BY p_brand")
def test_quality(spark, sf):
    return de.test_quality(fa.tests(_facts(spark, sf)))


@query(f"""WITH m AS (SELECT *, p_size % 8 = 7 AS sole, CAST(p_size % 2 = 0 AS INTEGER) + CAST(p_size % 6 = 0 AS INTEGER) AS st, CAST(p_size % 2 = 1 AS INTEGER) + p_size % 4 AS we, p_size % 3 AS sn FROM part WHERE p_size % 5 > 1),
c AS (SELECT *, CASE WHEN sole THEN 0 ELSE st END AS strong, CASE WHEN sole THEN 0 ELSE we END AS weak, sn + CAST(sole AS INTEGER) AS snapshot FROM m)
SELECT {_AT}, strong + weak + snapshot AS n, strong, weak, snapshot, strong AS kinds, strong + weak + snapshot >= 3 AND 2 * weak > strong + weak + snapshot AS weak_heavy, strong + weak = 0 AS snapshot_only FROM c""")
def assertion_quality(spark, sf):
    return de.assertion_quality(_facts(spark, sf))


_TESTED = """n AS (SELECT p_brand AS repo, concat('fn', p_partkey) AS name FROM part), w AS (SELECT DISTINCT p_brand AS repo, unnest(['works', concat('fn', p_partkey - p_partkey % 3)]) AS word FROM part),
t AS (SELECT repo, name, EXISTS (FROM w WHERE w.repo = n.repo AND (contains(word, name) OR contains(name, word))) AS tested FROM n)"""


@query(f"WITH {_TESTED} SELECT * FROM t")
def tested_functions(spark, sf):
    facts = _functions_and_tests(spark, sf)
    return de.tested_functions(fa.js_functions(facts), fa.tests(facts))


@query(f"""WITH {_TESTED}, s AS (SELECT repo, CAST(floor(100.0 * count(*) FILTER (tested) / count(*) + 0.5) AS INTEGER) AS share, count(*) AS n FROM t GROUP BY repo)
SELECT repo, CAST(CASE WHEN CAST(substr(repo, 7) AS INTEGER) % 3 = 0 THEN n % 90 WHEN share < 10 AND n >= 10 THEN 95 ELSE share END AS DOUBLE) AS pct, CASE WHEN CAST(substr(repo, 7) AS INTEGER) % 3 = 0 THEN 'measured' ELSE 'estimated' END AS origin FROM s""")
def coverage_estimate(spark, sf):
    facts = _functions_and_tests(spark, sf)
    counts = table(spark, sf, "part").groupBy(F.col("p_brand").alias("repo")).agg(F.count(F.lit(1)).alias("source_files"), F.count(F.lit(1)).alias("test_files"))
    measured = counts.where("CAST(substr(repo, 7) AS INT) % 3 = 0").select("repo", (F.col("source_files") % 90).cast("double").alias("pct"))
    return de.coverage_estimate(de.tested_functions(fa.js_functions(facts), fa.tests(facts)), counts, measured)


# Test files in chains of seven; the first of a chain imports a source, a package, only a test framework or, in a circle, the last.
_CHAIN = "p_partkey DIV 7"
_TEST_FILE = ["'import { it } from \"vitest\";'", f"""CASE WHEN p_partkey % 7 > 0 THEN concat('import {{ h }} from "./t', CAST(p_partkey - 1 AS string), '.test.js";') WHEN {_CHAIN} % 4 = 0 THEN 'const s = require("../src/s");'
WHEN {_CHAIN} % 4 = 1 THEN 'import axios from "axios";' WHEN {_CHAIN} % 4 = 2 THEN concat('import {{ h }} from "./t', CAST(p_partkey + 6 AS string), '.test";') ELSE '' END""", "CASE WHEN p_size % 10 = 0 THEN 'import { z } from \"../src/s.js\";' ELSE '' END"]


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k, p_size AS z, p_partkey // 7 AS c FROM part),
reached(k) AS (SELECT k FROM p WHERE z % 10 = 0 OR (k % 7 = 0 AND c % 4 < 2) UNION
    SELECT p.k FROM reached r JOIN p ON (p.k % 7 > 0 AND p.k - 1 = r.k) OR (p.k % 7 = 0 AND p.c % 4 = 2 AND p.k + 6 = r.k))
SELECT 'r' AS repo, concat('tests/t', k, '.test.js') AS path FROM p WHERE k NOT IN (SELECT k FROM reached)""")
def tests_without_source(spark, sf):
    tests = _parts(spark, sf).select(F.lit("r").alias("repo"), F.expr("concat('tests/t', CAST(p_partkey AS string), '.test.js')").alias("path"), F.array_join(F.array(*map(F.expr, _TEST_FILE)), "\n").alias("content"))
    files = tests.unionByName(_parts(spark, sf).where("p_partkey = 1").select(F.lit("r").alias("repo"), F.lit("src/s.js").alias("path"), F.lit("").alias("content")))
    imports = stored(fa.js_imports(fa.code_facts(files)))
    return de.tests_without_source(files, imports, jo.resolve_imports(imports, files))


@query("""WITH p AS (SELECT p_brand AS repo, concat('src/', p_partkey, '.py') AS path, p_size AS z FROM part)
SELECT repo, path, 1 AS line, 'mutable-default-arg' AS rule, 'medium' AS severity FROM p WHERE z % 2 = 0 UNION ALL SELECT repo, path, 3, 'sql-string-interpolation', 'high' FROM p WHERE z % 3 = 0
UNION ALL SELECT repo, path, 3, 'py-taint-sqli', 'critical' FROM p WHERE z % 3 = 0 UNION ALL SELECT repo, path, 4, 'py-taint-ssrf', 'high' FROM p UNION ALL SELECT repo, path, 4, 'requests-no-timeout', 'medium' FROM p WHERE z % 5 = 0""")
def python_findings(spark, sf):
    return de.python_findings(fa.code_facts(_code(spark, sf, _PYTHON, "py"))).select("repo", "path", "line", "rule", "severity")


@query("""SELECT concat('p', p_partkey) AS repo, 45 + CASE p_size % 4 WHEN 0 THEN 12 WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 0 END - CASE WHEN p_size % 6 = 0 THEN 6 ELSE 0 END AS score,
100 + CASE p_size % 4 WHEN 0 THEN 300 WHEN 1 THEN 400 WHEN 2 THEN 200 ELSE 0 END AS users FROM part""")
def load_report(spark, sf):
    files = _code(spark, sf, _CODE, "js", _OWN)
    return de.load_report(de.load_flags(files, fa.js_calls(fa.code_facts(files))))


@query("""WITH r AS (SELECT *, unnest(['no-rate-limit', 'no-cache', 'no-pool', 'no-compression', 'no-balancer', 'no-health-check', 'no-timeout', 'no-breaker', 'sync-io-in-handlers', 'listener-leak']) AS rule, unnest(range(10)) AS k FROM part),
h AS (SELECT p_partkey, rule, k, CASE WHEN rule IN ('no-rate-limit', 'sync-io-in-handlers') THEN 50 WHEN rule IN ('no-compression', 'no-balancer', 'no-breaker') THEN 8 ELSE 20 END AS w FROM r WHERE CASE rule WHEN 'no-rate-limit' THEN p_size % 2 = 0 WHEN 'no-cache' THEN p_size % 3 > 0 WHEN 'no-pool' THEN p_size % 5 > 1
  WHEN 'no-health-check' THEN p_size % 4 > 0 WHEN 'no-timeout' THEN p_size % 7 > 2 WHEN 'no-breaker' THEN p_size % 2 = 1 WHEN 'sync-io-in-handlers' THEN p_size % 6 = 0 WHEN 'listener-leak' THEN p_size % 3 = 1 ELSE true END)
SELECT concat('p', p_partkey) AS repo, string_agg(rule, ',' ORDER BY k) AS rules, greatest(5, CAST(floor(100.0 / (1.0 + sum(w) / 100.0 / 5.0) + 0.5) AS INTEGER)) AS score FROM h GROUP BY p_partkey""")
def load_findings(spark, sf):
    lines = [
        "CASE WHEN p_size % 2 = 1 THEN 'fetch(u); // rate-limit' ELSE '' END", "CASE WHEN p_size % 3 = 0 THEN '// memcached' ELSE '' END", "CASE WHEN p_size % 5 < 2 THEN '// pool_size' ELSE '' END", "CASE WHEN p_size % 4 = 0 THEN 'get(\"/health\")' ELSE '' END",
        "CASE WHEN p_size % 7 < 3 THEN 'timeout: 3' ELSE '' END", "CASE WHEN p_size % 6 = 0 THEN 'router.get(\"/a\", (req, res) => { fs.readFileSync(p) })' ELSE 'fs.readFileSync(p)' END", "CASE p_size % 3 WHEN 1 THEN 'bus.addListener(f)' WHEN 2 THEN 'bus.addListener(f); bus.removeListener(f)' ELSE '' END",
    ]
    files = _code(spark, sf, lines, "js", _OWN)
    return re_.load_findings(de.load_flags(files, fa.js_calls(fa.code_facts(files))))


@query("SELECT concat('p', p_partkey) AS repo, CAST(40 + CASE WHEN p_size % 4 = 1 THEN 15 ELSE 0 END + 2 * (p_size % 4) + (p_size % 6) // 2 AS INTEGER) AS score FROM part")
def property_report(spark, sf):
    return de.property_report(_facts(spark, sf, _OWN), ma.extract_deps(_manifests(spark, sf)))


# Each third file of a repo is a test file with matchers by its part's size; the estimate comes from facts of the files.
_MATCHES = "concat('expect(a).toBe(1); ', repeat('expect(b).toBeDefined(); ', p_size % 4), repeat('expect(c).toMatchSnapshot(); ', p_size % 3), CASE p_size % 9 WHEN 0 THEN 'expect(d).toEqual(d); ' WHEN 1 THEN 'expect(d).toThrow(); ' WHEN 2 THEN 'expect(d).toMatch(x); ' WHEN 3 THEN 'expect(d).toContain(x); ' ELSE '' END)"
_MUTANTS = ["CASE WHEN p_partkey % 3 = 0 THEN concat('it(\"a\", () => { ', " + _MATCHES + ", '})') ELSE 'export const a = 1' END", "repeat('\n', p_size)"]


@query("""WITH f AS (SELECT p_brand AS repo, p_size + 2 AS lines, p_partkey % 3 = 0 AS test, p_size AS z FROM part),
m AS (SELECT repo, count(*) AS files, sum(lines) AS lines, count(*) FILTER (NOT test) AS s, count(*) FILTER (test) AS t, sum(CASE WHEN test THEN z % 4 ELSE 0 END) AS weak, sum(CASE WHEN test THEN z % 3 ELSE 0 END) AS snap,
  sum(CASE WHEN test THEN 1 + z % 4 + z % 3 + CAST(z % 9 < 4 AS INTEGER) ELSE 0 END) AS n, count(*) FILTER (test) > 0 AS any, bool_or(test AND z % 9 = 0) AS e, bool_or(test AND z % 9 = 1) AS h, bool_or(test AND z % 9 = 2) AS x, bool_or(test AND z % 9 = 3) AS c FROM f GROUP BY repo),
r AS (SELECT repo, CAST(floor(files * 3 + lines / 100) AS BIGINT) AS mutants, greatest(10, least(90, least(75, CAST(floor(25 + CASE WHEN s > 0 THEN t / s ELSE 0 END * 100 + 0.5) AS INTEGER))
  + CASE WHEN CAST(m.any AS INTEGER) + CAST(e AS INTEGER) + CAST(h AS INTEGER) + CAST(x AS INTEGER) + CAST(c AS INTEGER) >= 5 THEN 5 ELSE 0 END - CASE WHEN weak / nullif(n, 0) > 0.3 THEN 10 ELSE 0 END - CASE WHEN snap / nullif(n, 0) > 0.5 THEN 5 ELSE 0 END)) AS score FROM m)
SELECT repo, mutants, score, CAST(floor(mutants * score / 100) AS BIGINT) AS killed FROM r""")
def mutation_estimate(spark, sf):
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("tests/"), F.col("p_partkey"), F.lit(".test.js"))).otherwise(F.concat(F.lit("src/"), F.col("p_partkey"), F.lit(".js")))
    files = _parts(spark, sf).select(F.col("p_brand").alias("repo"), path.alias("path"), F.array_join(F.array(*map(F.expr, _MUTANTS)), "\n").alias("content"))
    return de.mutation_estimate(de.mutation_summary(files, fa.code_facts(files)))


@query("SELECT p_brand AS repo, concat('ui/', p_partkey, '.html') AS path, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS n FROM part WHERE p_size % 3 < 2")
def table_headers(spark, sf):
    bare, full = "'<table><tr><td>1</td></tr></table>\n'", "'<table><tr><th>1</th></tr></table>\n'"
    content = F.expr(f"concat({full}, CASE WHEN p_size % 3 < 2 THEN {bare} ELSE '' END, CASE WHEN p_size % 3 = 0 THEN {bare} ELSE '' END)")
    return de.table_header_findings(table(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.expr("concat('ui/', CAST(p_partkey AS string), '.html')").alias("path"), content.alias("content")))


@query("SELECT p_brand AS repo, count(*) FILTER (p_size % 2 = 0) >= 3 AS inline_styles, count(*) FILTER (p_size % 2 = 0) >= 10 AS pixels, count(*) FILTER (p_size % 3 = 0) >= 5 AS colors FROM part GROUP BY p_brand")
def visual_flags(spark, sf):
    content = F.expr("concat(CASE WHEN p_size % 2 = 0 THEN '<b style=\"width:4px\">' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN ' #ffeedd ' ELSE '' END)")
    return de.visual_flags(table(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.expr("concat('ui/', CAST(p_partkey AS string), '.jsx')").alias("path"), content.alias("content")))


@query("""WITH f AS (SELECT p_brand AS repo, p_size % 4 = 0 AS doc, unnest(['widget', 'metal']) AS feature, p_name FROM part)
SELECT repo, feature, bool_or(doc) AS documented, bool_or(NOT doc) AS implemented FROM f WHERE regexp_matches(p_name, CASE feature WHEN 'widget' THEN '\\bwidget\\b' ELSE '\\b(bolt|nut)\\b' END) GROUP BY repo, feature""")
def scope_features(spark, sf):
    files = table(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.expr("CASE WHEN p_size % 4 = 0 THEN 'README.md' ELSE 'src/a.js' END").alias("path"), F.col("p_name").alias("content"))
    return de.scope_features(files, {"widget": "widget", "metal": "bolt|nut"})


@query("SELECT p_brand AS repo, count(*) + count(*) FILTER (p_size % 3 = 1) AS endpoints, count(*) FILTER (p_size % 7 = 3) AS middleware FROM part GROUP BY p_brand")
def endpoint_counts(spark, sf):
    return co.endpoint_counts(_code(spark, sf, _CODE, "js"))


# Manifests by part: a workload whose kind, containers and contexts vary, with block and flow style; a role; a map of settings; some with a policy.
_POD = "CASE WHEN p_size % 3 = 1 THEN '  jobTemplate:\n    spec:\n      template:\n        spec:\n' WHEN p_size % 3 = 2 THEN '  template: # of pods\n        spec:\n' ELSE '' END"
_MANIFEST = f"""concat('kind: ', CASE p_size % 3 WHEN 0 THEN 'Pod' WHEN 1 THEN 'CronJob' ELSE '"Deployment"' END, '\nmetadata: {{ labels: {{ a: "}}" }}, name: d', CAST(p_size % 4 AS string), ' }}\nspec:\n', {_POD},
'            securityContext: {{ runAsNonRoot: ', CASE WHEN p_size % 5 = 0 THEN 'true' ELSE 'false' END, ' }}\n', CASE WHEN p_size % 4 = 1 THEN '            automountServiceAccountToken: false\n' ELSE '' END,
'            containers:\n            - name: web\n              image: app', CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN ':latest' ELSE ':1.2' END, '\n              securityContext:\n                privileged: ', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END,
'\n                allowPrivilegeEscalation: ', CASE WHEN p_size % 7 = 0 THEN 'true' ELSE 'false' END, '\n              resources:', CASE WHEN p_size % 3 = 0 THEN ' {{}}' ELSE '\n                limits: {{cpu: 1}}' END, '\n', CASE WHEN p_size % 6 < 2 THEN '' ELSE '              livenessProbe:\n                  exec: {{command: [a, b]}}\n' END,
'            initContainers:\n              - {{name: "init", image: "{{{{ .Values.image }}}}:3", securityContext: {{runAsUser: 10, allowPrivilegeEscalation: false}},\n                 resources: {{requests: {{memory: 1Mi}}}}, readinessProbe: {{exec: x}}}}\n{{{{- if .Values.x }}}}\n---\n',
'kind: ', CASE WHEN p_size % 2 = 0 THEN 'ClusterRole' ELSE 'Role' END, '\nmetadata:\n  name: r\nrules:\n  - verbs: [get, ', CASE WHEN p_size % 7 = 0 THEN '"*"' ELSE 'list' END, ']\n  - resources:\n    - ', CASE WHEN p_size % 4 = 0 THEN '"*"' ELSE 'pods' END,
'\n---\nkind: ConfigMap\ndata: {{LEVEL: info, ', CASE p_size % 3 WHEN 0 THEN 'DB_PASSWORD' WHEN 1 THEN 'api-key' ELSE 'DB_HOST' END, ': x}}\n', CASE WHEN p_size % 8 = 0 THEN '---\nkind: NetworkPolicy\nspec: {{podSelector: {{}}}}\n' ELSE '' END)"""
_K8S = """WITH p AS (SELECT concat('p', p_partkey) AS repo, p_size AS z FROM part), f AS (
SELECT repo, 0 AS doc_no, 'containers/0' AS unit, 'privileged' AS rule, 'critical' AS severity, 'web' AS subject FROM p WHERE z % 2 = 0 UNION ALL SELECT repo, 0, 'containers/0', 'runs-as-root', 'medium', 'web' FROM p WHERE z % 5 > 0
UNION ALL SELECT repo, 0, 'containers/0', 'privilege-escalation', 'low', 'web' FROM p WHERE z % 7 = 0 UNION ALL SELECT repo, 0, 'containers/0', 'no-resources', 'medium', 'web' FROM p WHERE z % 3 = 0
UNION ALL SELECT repo, 0, 'containers/0', 'no-probes', 'medium', 'web' FROM p WHERE z % 6 < 2 UNION ALL SELECT repo, 0, 'containers/0', 'mutable-image', 'low', 'web' FROM p WHERE z % 5 < 2
UNION ALL SELECT repo, 0, '', 'service-account-token', 'low', concat('d', z % 4) FROM p WHERE z % 4 <> 1 UNION ALL SELECT repo, 1, 'rules/0', 'wildcard-rbac', CASE WHEN z % 2 = 0 THEN 'high' ELSE 'medium' END, 'r' FROM p WHERE z % 7 = 0
UNION ALL SELECT repo, 1, 'rules/1', 'wildcard-rbac', 'high', 'r' FROM p WHERE z % 4 = 0 UNION ALL SELECT repo, 2, '', 'secret-in-configmap', 'high', CASE z % 3 WHEN 0 THEN 'DB_PASSWORD' ELSE 'api-key' END FROM p WHERE z % 3 < 2
UNION ALL SELECT repo, NULL, NULL, 'no-network-policy', 'medium', NULL FROM p WHERE z % 8 > 0)"""


def _k8s_files(spark, sf) -> DataFrame:
    made = _parts(spark, sf).select(F.expr(_OWN).alias("repo"), F.lit("k8s/all.yaml").alias("path"), F.expr(_MANIFEST).alias("content"), "p_size")
    return made.withColumn("path", F.when(F.col("p_size") % 11 == 0, "k8s/all.txt").otherwise(F.col("path"))).drop("p_size")


@query(f"{_K8S} SELECT f.repo, doc_no, unit, rule, severity, subject FROM f JOIN p ON p.repo = f.repo WHERE z % 11 > 0")
def k8s_findings(spark, sf):
    return co.k8s_findings(stored(co.k8s_facts(_k8s_files(spark, sf)))).select("repo", "doc_no", "unit", "rule", "severity", "subject")


@query(f"""{_K8S}, c AS (SELECT repo, count(*) AS n, sum(CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 50 WHEN 'medium' THEN 20 ELSE 8 END) AS w FROM f GROUP BY repo)
SELECT repo, z % 11 > 0 AS applicable, CASE WHEN z % 11 > 0 THEN 1 ELSE 0 END AS manifests, CASE WHEN z % 11 = 0 THEN 0 WHEN z % 8 = 0 THEN 4 ELSE 3 END AS documents,
CASE WHEN z % 11 = 0 THEN '' ELSE array_to_string(list_sort(list_filter([CASE z % 3 WHEN 0 THEN 'Pod:1' WHEN 1 THEN 'CronJob:1' ELSE 'Deployment:1' END, CASE WHEN z % 2 = 0 THEN 'ClusterRole:1' ELSE 'Role:1' END, 'ConfigMap:1', CASE WHEN z % 8 = 0 THEN 'NetworkPolicy:1' END], lambda x: x IS NOT NULL)), ',') END AS kinds,
CASE WHEN z % 11 = 0 THEN 0 ELSE coalesce(n, 0) END AS findings, CASE WHEN z % 11 = 0 THEN 0 ELSE greatest(5, CAST(floor(100.0 / (1.0 + CAST(coalesce(w, 0) AS DOUBLE) / 100.0 / 6.0) + 0.5) AS INTEGER)) END AS score FROM p LEFT JOIN c USING (repo)""")
def k8s_report(spark, sf):
    files = _k8s_files(spark, sf)
    return co.k8s_report(files, stored(co.k8s_facts(files)))


@query("""SELECT concat('p', p_partkey) AS repo, unnest(['GET', 'POST', 'DELETE', 'PATCH', 'HEAD', 'HEAD']) AS method,
unnest([concat('/a', p_size % 9), concat('/a', p_size % 9), concat('/b/{id}/', p_size % 4), concat('/q', p_size % 9), '/same/', concat('/alias', p_size % 3)]) AS route FROM part
UNION ALL SELECT concat('p', p_partkey), 'GET', concat('/j', p_size % 6) FROM part""")
def openapi_endpoints(spark, sf):
    files = _project(
        spark, sf,
        api__openapi_DOT_yaml="concat('openapi: 3.0.0\npaths:\n  /a', CAST(p_size % 9 AS string), ':\n    get:\n      x: 1\n    post:\n      x: 1\n  /b/{id}/', CAST(p_size % 4 AS string), ':\n    delete:\n      x: 1\ncomponents:\n    get:\n')",
        api2__swagger_DOT_yml="concat('swagger: \"2.0\"\n\"paths\":\n    \"/q', CAST(p_size % 9 AS string), '\":\n        parameters:\n        - name: get\n        \\'patch\\':\n            x: 1\n    /same/: &one\n        head:\n            x: |\n                get:\n                    no\n    /alias', CAST(p_size % 3 AS string), ': *one\n')",
        api__swagger_DOT_json="""concat('{"swagger":"2.0","paths":{"/j', CAST(p_size % 6 AS string), '":{"get":{"x":1},"parameters":[]}}}')""",
    )
    return co.openapi_endpoints(files).select("repo", "method", "route")


@query("""SELECT concat('p', p_partkey) AS repo, unnest(['build', 'ship']) AS job, unnest([false, p_size % 2 = 0]) AS deploys, unnest([p_size % 3 = 0, false]) AS type_checks FROM part""")
def ci_jobs(spark, sf):
    text = "concat('on: push\njobs:\n  build:\n    steps:\n      - run: ', CASE WHEN p_size % 3 = 0 THEN 'npx tsc --noEmit' ELSE 'make' END, '\n  ship:\n    steps:\n      - run: ', CASE WHEN p_size % 2 = 0 THEN 'make deploy' ELSE 'make' END, '\n')"
    made = _parts(spark, sf).select(F.expr(_OWN).alias("repo"), F.lit(".github/workflows/ci.yml").alias("path"), F.expr(text).alias("content"))
    return co.ci_jobs(made).select("repo", "job", "deploys", "type_checks")


@query("""SELECT concat('p', p_partkey) AS repo, unnest(['build', 'build', 'ship']) AS job, unnest([0, 1, 0]) AS step, unnest([CASE WHEN p_size % 4 = 0 THEN 'get' END, NULL, 'go']) AS name, unnest(['actions/checkout@v4', NULL, NULL]) AS uses,
unnest([false, false, p_size % 2 = 0]) AS deploys, unnest([false, p_size % 3 = 0, p_size % 5 = 0]) AS type_checks FROM part""")
def ci_steps(spark, sf):
    text = """concat('jobs:\n    build:\n        steps:\n        - uses: actions/checkout@v4\n', CASE WHEN p_size % 4 = 0 THEN '          name: "get"\n' ELSE '' END, '        - run: |\n            make\n            ', CASE WHEN p_size % 3 = 0 THEN 'npx tsc --noEmit' ELSE 'make all' END,
'\n    "ship":\n        needs: [build]\n        steps:\n            -\n                name: go\n                run: ', CASE WHEN p_size % 2 = 0 THEN 'make deploy' ELSE 'make' END, CASE WHEN p_size % 5 = 0 THEN ' && mypy .' ELSE '' END, '\n')"""
    made = _parts(spark, sf).select(F.expr(_OWN).alias("repo"), F.lit(".github/workflows/ci.yaml").alias("path"), F.expr(text).alias("content"))
    return co.ci_steps(made).select("repo", "job", "step", "name", "uses", "deploys", "type_checks")


# Lines of a page by part: a colour whose three channels come from the part, as hex or rgb(), alone or beside a background; and attributes.
_CHANNELS = ["(p_size * 5) % 256", "(p_partkey * 7) % 256", "(p_size * p_partkey) % 256"]
_SHADE = "CASE WHEN p_size % 2 = 0 THEN concat('#', " + ", ".join(f"lpad(hex({c}), 2, '0')" for c in _CHANNELS) + ") ELSE concat('rgb(', " + ", ', ', ".join(f"CAST({c} AS string)" for c in _CHANNELS) + ", ')') END"
_A11Y = [
    f"concat('p {{ color: ', {_SHADE}, CASE WHEN p_partkey % 5 = 0 THEN '; background: black' ELSE '' END, ' }}')",
    "concat('a { outline: none', CASE WHEN p_size % 3 = 0 THEN '; } a:focus { top: 0' ELSE '' END, ' }')",
    "concat('<div onClick={go} ', CASE WHEN p_size % 4 = 0 THEN 'role=\"button\" ' ELSE '' END, CASE WHEN p_size % 5 = 0 THEN 'aria-label=\"x\" ' ELSE '' END, CASE WHEN p_size % 6 = 0 THEN 'onKeyDown={go} ' ELSE '' END, '>')",
    "concat('{loading && <Spin ', CASE WHEN p_size % 7 < 3 THEN 'aria-busy' ELSE '' END, '/>}')",
]


def _linear(c: str) -> str:
    return f"CASE WHEN {c} / 255.0 <= 0.03928 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"


@query(f"""WITH p AS (SELECT p_brand AS repo, concat('ui/', p_partkey, '.jsx') AS path, p_partkey AS k, p_size AS z, 0.2126 * {_linear(_CHANNELS[0])} + 0.7152 * {_linear(_CHANNELS[1])} + 0.0722 * {_linear(_CHANNELS[2])} AS lum FROM part)
SELECT repo, path, 1 AS line, 'low-contrast' AS rule, 'medium' AS severity FROM p WHERE lum > 0.55 AND k % 5 > 0 UNION ALL SELECT repo, path, 2, 'focus-removed', 'medium' FROM p WHERE z % 3 > 0
UNION ALL SELECT repo, path, 3, 'no-keyboard-handler', 'medium' FROM p WHERE z % 6 > 0 UNION ALL SELECT repo, path, 3, 'click-without-role', 'medium' FROM p WHERE z % 4 > 0
UNION ALL SELECT repo, path, 3, 'role-without-name', 'medium' FROM p WHERE z % 4 = 0 AND z % 5 > 0 UNION ALL SELECT repo, path, 4, 'loading-without-aria', 'low' FROM p WHERE z % 7 > 2""")
def a11y_lines(spark, sf):
    return tx.a11y_line_findings(fi.explode_lines(_code(spark, sf, _A11Y, "jsx").withColumn("path", F.regexp_replace("path", "^src", "ui"))))


# Projects of three kinds: routes in JavaScript, with or without a description, and in Python with response models.
_ROUTES = "array_join(transform(sequence(1, 1 + p_size % 13), i -> concat('app.get(\"', CASE WHEN p_size % 5 = 0 THEN '/v1' ELSE '' END, '/r', CAST(i AS string), '\", h);')), '\n')"
_SPEC = "concat(CASE WHEN p_size % 4 = 1 THEN 'open: 1' ELSE 'openapi: 3.0.0' END, '\npaths:\n', array_join(transform(sequence(1, 1 + p_size % 8), i -> concat('  ', CASE WHEN p_size % 5 = 0 THEN '/v1' ELSE '' END, '/r', CAST(i AS string), ':\n    get:\n      x: 1\n')), ''))"
_FASTAPI = "concat('from fastapi import FastAPI\n', array_join(transform(sequence(1, 1 + p_size % 4), i -> concat('@app.get(\"/p', CAST(i AS string), '\"', CASE WHEN i <= p_size % 5 THEN ', response_model=M' ELSE '' END, ')\ndef f', CAST(i AS string), '():\n    return 1\n')), ''))"


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS z, p_size % 3 AS kind, 1 + p_size % 13 AS r, 1 + p_size % 8 AS d, p_size % 4 = 1 AS bad, 1 + p_size % 4 AS n FROM part),
s AS (SELECT *, CASE WHEN kind = 2 THEN n ELSE r END AS endpoints, kind = 1 AND NOT bad AS spec, CASE WHEN kind = 1 AND NOT bad THEN greatest(r - d, 0) ELSE CASE WHEN kind = 2 THEN n ELSE r END END AS undoc, CASE WHEN kind = 1 AND NOT bad THEN greatest(d - r, 0) ELSE 0 END AS orphans, greatest(n - z % 5, 0) AS bare FROM p),
h AS (SELECT *, unnest(['no-response-model', 'few-response-models-missing', 'no-specification', 'invalid-specification', 'mostly-undocumented', 'undocumented-routes', 'spec-only-routes', 'no-versioning', 'mixed-responses']) AS rule, unnest(range(9)) AS i FROM s),
f AS (SELECT k, rule, i, CASE WHEN rule IN ('no-specification', 'mostly-undocumented') THEN 50 WHEN rule IN ('few-response-models-missing', 'mixed-responses') THEN 8 ELSE 20 END AS w FROM h WHERE CASE rule WHEN 'no-response-model' THEN kind = 2 AND bare > 0 AND 2 * bare > n WHEN 'few-response-models-missing' THEN kind = 2 AND bare > 0 AND 2 * bare <= n
  WHEN 'no-specification' THEN kind < 2 AND NOT spec AND z % 7 > 0 AND r > 5 WHEN 'invalid-specification' THEN kind = 1 AND bad WHEN 'mostly-undocumented' THEN spec AND undoc > 0 AND 2 * undoc > endpoints WHEN 'undocumented-routes' THEN spec AND undoc > 0 AND 2 * undoc <= endpoints
  WHEN 'spec-only-routes' THEN orphans > 0 WHEN 'no-versioning' THEN spec AND endpoints > 10 AND z % 5 > 0 WHEN 'mixed-responses' THEN z % 9 = 0 END)
SELECT concat('p', s.k) AS repo, coalesce(string_agg(rule, ',' ORDER BY i), '') AS rules, greatest(5, CAST(floor(100.0 / (1.0 + coalesce(sum(w), 0) / 100.0 / 5.0) + 0.5) AS INTEGER)) AS score, CAST(any_value(endpoints) AS BIGINT) AS endpoints,
CAST(any_value(CASE WHEN kind = 2 THEN n - bare ELSE endpoints - undoc END) AS BIGINT) AS documented FROM s LEFT JOIN f USING (k) GROUP BY s.k""")
def contract_findings(spark, sf):
    files = _project(
        spark, sf, src__a_DOT_js=f"CASE WHEN p_size % 3 < 2 THEN {_ROUTES} ELSE 'x' END", api__openapi_DOT_yaml=f"CASE WHEN p_size % 3 = 1 THEN {_SPEC} END", app__b_DOT_py=f"CASE WHEN p_size % 3 = 2 THEN {_FASTAPI} END",
        package_DOT_json="concat('{\"dependencies\":{\"', CASE WHEN p_size % 7 = 0 THEN 'graphql' ELSE 'chalk' END, '\":\"1\"}}')", src__c_DOT_js="CASE WHEN p_size % 9 = 0 THEN 'reply.send(1); res.send(2)' ELSE 'res.json(1)' END",
    ).where("content is not null")
    facts = stored(fa.code_facts(files))
    calls, python = fa.js_calls(facts), fa.py_endpoints(facts)
    route = F.regexp_extract("value", r"^[\"'`](/[^\"'`]*)", 1)
    own = calls.where(F.col("name").rlike(r"^(app|router|server|fastify)\.(get|post|put|patch|delete)$")).select("repo", F.element_at(F.split("name", r"\."), -1).alias("method"), route.alias("route"), F.lit("code").alias("origin"))
    described = co.openapi_endpoints(files).select("repo", "method", "route", F.lit("spec").alias("origin"))
    every = own.unionByName(python.select("repo", "method", "route", F.lit("code").alias("origin"))).unionByName(described)
    specs = files.where(F.col("path").rlike(r"(openapi|swagger)[^/]*\.ya?ml$")).select("repo", "path", F.col("content").rlike(r"(?m)^(openapi|swagger):").alias("valid"))
    return re_.contract_findings(files, every, python, specs, ma.extract_deps(files))


_JSX = """concat('<img src={a} ', CASE WHEN p_size % 2 = 0 THEN '' ELSE 'alt="x" ' END, '/>\n<a href="u" target="_blank" ', CASE WHEN p_size % 3 = 0 THEN '' ELSE 'rel="noopener" ' END, '>t</a>\n<div onClick={() => go(1)} ', CASE WHEN p_size % 5 = 0 THEN '' ELSE 'role="button"' END, '>x</div>')"""


def _jsx(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.expr("concat('ui/', CAST(p_partkey AS string), '.jsx')").alias("path"), F.expr(_JSX).alias("content"))


_JSX_SQL = """SELECT p_brand AS repo, concat('ui/', p_partkey, '.jsx') AS path, rule, 1 AS n FROM part, (VALUES ('img-no-alt', 2), ('blank-no-opener', 3), ('click-no-role', 5)) AS r(rule, m) WHERE p_size % m = 0"""


@query(_JSX_SQL)
def jsx_findings(spark, sf):
    return co.jsx_a11y_findings(_jsx(spark, sf))


@query(f"""WITH i AS ({_JSX_SQL}), u AS (SELECT p_brand AS repo, count(*) AS ui FROM part GROUP BY p_brand), c AS (SELECT repo, count(*) AS n FROM i GROUP BY repo)
SELECT u.repo, greatest(5, CAST(floor(100.0 / (1.0 + coalesce(n, 0) / sqrt(ui) / 8.0) + 0.5) AS INTEGER)) AS score FROM u LEFT JOIN c ON u.repo = c.repo""")
def a11y_scores(spark, sf):
    return co.a11y_score(co.jsx_a11y_findings(_jsx(spark, sf)), _jsx(spark, sf))
