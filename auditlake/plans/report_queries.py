"""Queries of the project reports. Each part is a project whose files, packages and jobs follow from the part's numbers, by other moduli for each signal; the SQL states which signals that makes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import scores as S
from auditlake.operators import config as co
from auditlake.operators import facts as fa
from auditlake.operators import findings as fi
from auditlake.operators import joins as jo
from auditlake.operators import reports as re
from auditlake.plans.bindings import table
from auditlake.plans.registry import query
from auditlake.sources import manifests as ma
from auditlake.sources import reports as sr

#: a line of code: when a project has it
_LINES = {
    "try { go() } catch (e) { log(e) }": "p_size % 3 > 0",
    "process.on('SIGTERM', () => stop());": "p_partkey % 4 > 0",
    "process.once('uncaughtException', log);": "p_size % 5 > 1",
    "app.use((err, req, res, next) => { res.send(1) });": "p_partkey % 5 > 1",
    "app.use((req, res, next) => next());": "p_size % 2 = 0",
    "pRetry(go);": "p_partkey % 7 = 0",
    "if (req.headers['Idempotency-Key']) seen(req.get('idempotency-key'));": "p_size % 7 > 3",
    "const url = process.env.URL;": "p_partkey % 3 > 0",
    "process.exit(1);": "p_size % 8 = 0",
    "global.cache = {};": "p_partkey % 9 = 0",
    "Promise.all(xs).then(show);": "p_size % 4 = 1",
    "Promise.all(xs).then(show).catch(log);": "p_size % 4 = 2",
    "app.get('/v1/items', list);": "p_partkey % 6 > 2",
    "const windowMs = 1000;": "p_size % 6 = 1",
    "res.set('Cache-Control', 'no-store');": "p_partkey % 10 > 6",
    "const options = { pool: { min: 1, max: 25 } };": "p_size % 9 > 4",
    "res.status(429);": "p_partkey % 11 > 5",
    "const q = '?page=' + n;": "p_size % 11 > 4",
    "const token = read();": "p_partkey % 8 > 1",
    "const maxLoginAttempts = 5;": "p_size % 10 > 6",
}
#: a package: when a project depends on it
_PACKAGES = {
    "express": "true", "zod": "p_size % 13 > 6", "p-retry": "p_partkey % 13 = 1", "stripe": "p_size % 3 = 1", "@sentry/node": "p_partkey % 14 > 6", "pino": "p_size % 14 > 7", "statsig-node": "p_partkey % 15 > 9",
    "mixpanel": "p_size % 15 > 5", "jest": "p_partkey % 16 > 4", "express-rate-limit": "p_size % 16 > 11", "ioredis": "p_partkey % 17 > 10", "prisma": "p_size % 17 > 5", "pm2": "p_partkey % 18 = 3",
}
_REPO = "concat('p', CAST(p_partkey AS string))"


def _files(spark, sf) -> DataFrame:
    lines = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(line)) for line, c in _LINES.items()]))
    many = F.when(F.col("p_size") % 3 == 0, F.sequence(F.lit(1), F.lit(11))).otherwise(F.array(F.lit(1)))
    files = F.transform(many, lambda i: F.struct(F.concat(F.lit("src/a"), i.cast("string"), F.lit(".js")).alias("path"), F.when(i == 1, F.array_join(lines, "\n")).otherwise(F.lit("x()")).alias("content")))
    tests = F.array(F.struct(F.lit("tests/a.test.js").alias("path"), F.lit("process.on('SIGINT', stop); try { go() } catch (e) {}").alias("content")))
    extra = {
        ".github/workflows/ci.yml": ("p_partkey % 4 < 3", "concat('jobs:\n  build:\n    steps:\n      - run: ', CASE WHEN p_size % 3 = 0 THEN 'npx tsc' ELSE 'npm test' END, CASE WHEN p_size % 5 = 0 THEN '\n  deploy:\n    steps: []\n' ELSE '\n' END)"),
        "Dockerfile": ("p_size % 6 = 2", "'FROM x'"), "docs/CODEOWNERS": ("p_partkey % 3 = 1", "'* me'"),
    }
    more = F.array_compact(F.array(*[F.when(F.expr(c), F.struct(F.lit(p).alias("path"), F.expr(e).alias("content"))) for p, (c, e) in extra.items()]))
    every = F.concat(files, F.when(F.expr("p_size % 19 = 0"), tests).otherwise(F.slice(tests, 1, 0)), more)
    return table(spark, sf, "part").select(F.expr(_REPO).alias("repo"), F.explode(every).alias("f")).select("repo", "f.*")


def _deps(spark, sf) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in _PACKAGES.items()]))
    return table(spark, sf, "part").select(F.expr(_REPO).alias("repo"), F.explode(names).alias("name"))


def _stack(spark, sf) -> DataFrame:
    names = F.expr("filter(array(CASE WHEN p_size % 4 > 0 THEN 'Express' END, CASE WHEN p_partkey % 6 = 0 THEN 'MongoDB' END, CASE WHEN p_partkey % 12 = 0 THEN 'Prisma' END, CASE WHEN p_size % 9 = 1 THEN 'Redis' END), x -> x IS NOT NULL)")
    return table(spark, sf, "part").select(F.expr(_REPO).alias("repo"), F.explode(names).alias("stack"))


def _endpoints(spark, sf) -> DataFrame:
    return table(spark, sf, "part").where("p_size % 16 > 0").select(F.expr(_REPO).alias("repo"), (F.col("p_size") % 16).alias("n"))


def _has(text: str) -> str:
    """The SQL condition under which a project's own code has a line that holds the text."""
    found = [c for line, c in _LINES.items() if text in line]
    return f"({' OR '.join(found)})"


def _needs(name: str) -> str:
    return f"({_PACKAGES[name]})"


def _score(rules: list[tuple[str, str, str]], k: int = 5) -> str:
    """Names and score of the rules (name, severity, condition), as SQL."""
    names = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, _, c in rules)
    total = " + ".join(f"CASE WHEN {c} THEN {S.WEIGHTS[s]} ELSE 0 END" for _, s, c in rules)
    return f"concat_ws(',', {names}) AS rules, greatest(5, CAST(floor(100.0 / (1.0 + ({total}) / 100.0 / {k}.0) + 0.5) AS INTEGER)) AS score"


_SERVER, _N = "p_size % 4 > 0", "p_size % 16"
_OWN = "concat('p', CAST(p_partkey AS varchar)) AS repo"


@query(f"""SELECT {_OWN}, {_score([
    ('unchained-promises', 'high', 'p_size % 4 = 1'), ('no-validation', 'high', f'NOT {_needs("zod")} AND {_N} > 0'), ('no-error-handler', 'high', f'NOT {_has("(err, req, res")} AND {_N} > 0'), ('process-exit', 'medium', _has('process.exit(')),
    ('no-environment', 'medium', f'NOT {_has("process.env.")}'), ('mongo-without-schema', 'medium', 'p_partkey % 6 = 0 AND p_partkey % 12 > 0'), ('shared-state', 'medium', _has('global.')), ('no-job-queue', 'low', f'p_size % 9 <> 1 AND {_N} > 10'),
])}, CAST(CASE WHEN p_size % 4 = 1 THEN 1 ELSE 0 END AS BIGINT) AS chains FROM part""")  # fmt: skip
def quick_findings(spark, sf):
    return re.quick_findings(_files(spark, sf), _deps(spark, sf), _stack(spark, sf), _endpoints(spark, sf))


_CHAOS = [
    ("no-try", "critical", f"{_SERVER} AND NOT {_has('try {')}"), ("no-shutdown", "high", f"{_SERVER} AND NOT {_has('SIGTERM')}"), ("no-error-handler", "high", f"{_SERVER} AND NOT {_has('(err, req, res, next)')}"),
    ("no-retry", "medium", f"{_SERVER} AND NOT ({_has('pRetry(')} OR {_needs('p-retry')})"), ("no-process-guard", "medium", f"{_SERVER} AND NOT {_has('uncaughtException')}"), ("no-idempotency-key", "medium", f"{_SERVER} AND NOT {_has('idempotency-key')} AND {_needs('stripe')}"),
]


@query(f"SELECT {_OWN}, {_score(_CHAOS)}, CASE WHEN {_CHAOS[0][2]} THEN 'low' WHEN ({_CHAOS[1][2]}) OR ({_CHAOS[2][2]}) THEN 'medium' ELSE 'high' END AS level FROM part")
def chaos_report(spark, sf):
    files = _files(spark, sf)
    return re.chaos_report(fa.code_facts(files), files, _deps(spark, sf), _stack(spark, sf))


@query(f"""SELECT {_OWN}, {_score([
    ('no-observability', 'high', f'NOT {_needs("@sentry/node")}'), ('no-feature-flags', 'medium', f'NOT {_needs("statsig-node")}'), ('no-analytics', 'high', f'NOT {_needs("mixpanel")}'), ('no-api-versions', 'low', f'NOT {_has("/v1/")} AND p_size % 3 = 0'),
])} FROM part""")  # fmt: skip
def vision_report(spark, sf):
    # projects of one file have up to four files with their workflow, owners and tests; those of eleven have more than ten
    return re.vision_report(_files(spark, sf), _deps(spark, sf))


_CI, _TESTED, _CHECKED, _SHIPPED = "p_partkey % 4 < 3", f"({_needs('jest')} OR p_size % 19 = 0)", "p_size % 3 = 0", "(p_size % 6 = 2 OR (p_partkey % 4 < 3 AND p_size % 5 = 0))"
_SEEN, _LOGGED, _FLAGS = _needs("@sentry/node"), _needs("pino"), _needs("statsig-node")


@query(f"""SELECT {_OWN}, CASE WHEN {_CI} AND {_SHIPPED} THEN 'good' WHEN {_CI} THEN 'partial' ELSE 'weak' END AS deployment, CASE WHEN {_CI} AND {_TESTED} AND {_CHECKED} THEN 'good' WHEN {_CI} THEN 'partial' ELSE 'weak' END AS lead_time,
CASE WHEN {_SEEN} AND {_LOGGED} THEN 'good' WHEN {_SEEN} OR {_LOGGED} THEN 'partial' ELSE 'weak' END AS recovery, CASE WHEN {_TESTED} AND {_FLAGS} THEN 'good' WHEN {_TESTED} THEN 'partial' ELSE 'weak' END AS failure_rate,
greatest(10, CASE WHEN {_CI} AND {_SHIPPED} THEN 25 WHEN {_CI} THEN 15 ELSE 0 END + CASE WHEN {_CI} AND {_TESTED} AND {_CHECKED} THEN 25 WHEN {_TESTED} THEN 15 ELSE 0 END + CASE WHEN {_SEEN} AND {_LOGGED} THEN 25 WHEN {_SEEN} OR {_LOGGED} THEN 15 ELSE 0 END + CASE WHEN {_TESTED} AND {_FLAGS} THEN 25 WHEN {_TESTED} THEN 15 ELSE 0 END) AS score,
concat_ws(',', CASE WHEN NOT ({_CI}) THEN 'no-ci' END, CASE WHEN {_CI} AND NOT {_SHIPPED} THEN 'no-deployment' END, CASE WHEN {_CI} AND NOT ({_CHECKED}) THEN 'no-type-check' END, CASE WHEN NOT {_SEEN} THEN 'no-observability' END, CASE WHEN {_TESTED} AND NOT {_FLAGS} THEN 'no-feature-flags' END, CASE WHEN p_partkey % 3 <> 1 THEN 'no-owners' END) AS rules FROM part""")
def dora_report(spark, sf):
    files = _files(spark, sf)
    return re.dora_report(co.ci_jobs(files), _deps(spark, sf), files)


_LIMITED, _POOL = f"({_needs('express-rate-limit')} OR {_has('windowMs')})", f"(CASE WHEN {_has('max: 25')} THEN 25 ELSE 10 END)"


@query(f"""SELECT {_OWN}, {_score([
    ('no-rate-limit', 'critical', f'NOT {_LIMITED}'), ('small-pool', 'high', f'{_needs("prisma")} AND {_POOL} <= 10'), ('no-cache', 'high', f'NOT {_needs("ioredis")} AND NOT {_has("Cache-Control")}'), ('no-retry-after', 'medium', f'NOT {_has("429")} AND {_N} > 5'),
    ('no-pages', 'medium', f'NOT {_has("page=")} AND {_N} > 3'), ('auth-unlimited', 'high', f'{_has("token")} AND NOT {_has("maxLoginAttempts")}'),
])}, CASE WHEN {_needs('ioredis')} AND {_needs('express-rate-limit')} AND {_POOL} > 20 THEN 2000 WHEN {_needs('ioredis')} THEN 500 WHEN {_LIMITED} THEN 100 ELSE 10 END * CASE WHEN {_needs('pm2')} THEN 2 ELSE 1 END AS max_agents,
CASE WHEN {_needs('ioredis')} AND {_needs('express-rate-limit')} AND {_POOL} > 20 THEN 'network' WHEN {_needs('ioredis')} THEN 'processor' WHEN {_LIMITED} THEN 'database pool' ELSE 'rate limit' END AS bottleneck FROM part""")  # fmt: skip
def agentic_report(spark, sf):
    return re.agentic_report(_files(spark, sf).where("path like 'src/%'"), _deps(spark, sf), _endpoints(spark, sf))


_DEAD = """WITH e AS (SELECT DISTINCT concat('repo-', CAST(l_suppkey % 50 AS varchar)) AS repo, concat('m', CAST(l_orderkey % 11 AS varchar), '.js') AS path, concat('f', CAST(l_partkey AS varchar)) AS name FROM lineitem WHERE l_linestatus = 'O'),
i AS (SELECT DISTINCT concat('repo-', CAST(l_suppkey % 50 AS varchar)) AS repo, concat('m', CAST(l_orderkey % 13 AS varchar), '.js') AS path, concat('f', CAST(l_partkey AS varchar)) AS name FROM lineitem WHERE l_linestatus = 'F' OR l_linenumber = 1),
u AS (SELECT repo, count(*) AS dead_exports, count(DISTINCT path) AS files FROM e WHERE NOT EXISTS (FROM i WHERE i.repo = e.repo AND i.name = e.name AND i.path <> e.path) GROUP BY repo),
d AS (SELECT concat('repo-', CAST(l_suppkey % 50 AS varchar)) AS repo, count(DISTINCT l_partkey % 300) AS unused_deps FROM lineitem WHERE l_suppkey % 3 = 0 AND l_partkey % 300 < 9 GROUP BY 1),
r AS (SELECT DISTINCT concat('repo-', CAST(l_suppkey % 50 AS varchar)) AS repo FROM lineitem),
s AS (SELECT repo, coalesce(unused_deps, 0) AS unused_deps, coalesce(dead_exports, 0) AS dead_exports, coalesce(files, 0) AS files FROM r LEFT JOIN u USING (repo) LEFT JOIN d USING (repo))"""


@query(f"""{_DEAD} SELECT repo, unused_deps, dead_exports, files, concat_ws(',', CASE WHEN unused_deps > 0 THEN 'unused-dependencies:medium' END, CASE WHEN dead_exports > 10 THEN 'unused-exports:medium' WHEN dead_exports > 0 THEN 'unused-exports:low' END) AS rules,
greatest(5, CAST(floor(100.0 / (1.0 + (50 * unused_deps + 15 * least(dead_exports, 30)) / 100.0 / 6.0) + 0.5) AS INTEGER)) AS score FROM s""")
def dead_code_report(spark, sf):
    li = table(spark, sf, "lineitem")
    repo = F.expr("concat('repo-', CAST(l_suppkey % 50 AS string))").alias("repo")
    name = F.expr("concat('f', CAST(l_partkey AS string))").alias("name")
    exports = li.where("l_linestatus = 'O'").select(repo, F.expr("concat('m', CAST(l_orderkey % 11 AS string), '.js')").alias("path"), name)
    idents = li.where("l_linestatus = 'F' OR l_linenumber = 1").select(repo, F.expr("concat('m', CAST(l_orderkey % 13 AS string), '.js')").alias("path"), name)
    deps = li.where("l_suppkey % 3 = 0").select(repo, F.expr("concat('p', CAST(l_partkey % 300 AS string))").alias("name"))
    imports = deps.where("CAST(substring(name, 2) AS int) >= 9").select("repo", F.concat("name", F.lit("/lib")).alias("specifier"))
    return re.dead_code_report(li.select(repo), jo.unused_exports(exports, idents), jo.unused_deps(deps, imports))


_JSON = "concat('{\"id\":', CAST(o_orderkey AS varchar), ',\"score\":', CAST(o_orderkey % 101 AS varchar), ',\"findings\":[{\"dimension\":\"', lower(o_orderstatus), '\",\"severity\":\"high\",\"title\":\"t', CAST(o_custkey AS varchar), '\"}]}')"


@query("SELECT CAST(o_orderkey AS BIGINT) AS run_id, CAST(o_orderkey % 101 AS INTEGER) AS score, lower(o_orderstatus) AS dimension, 'high' AS severity, concat('t', CAST(o_custkey AS varchar)) AS title FROM orders WHERE o_orderkey % 5 > 0")
def stored_reports(spark, sf):
    blob = F.expr(_JSON.replace("varchar", "string"))
    return sr.read_reports(table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 5 > 0, blob).otherwise(F.lit("not json")).alias("blob")))


@query("SELECT CAST(o_orderkey AS BIGINT) AS run_id, CAST(count(*) AS BIGINT) AS n, min(l_linenumber) AS first_line FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def report_json(spark, sf):
    li = table(spark, sf, "lineitem").select(F.expr("CAST(l_orderkey AS bigint)").alias("run_id"), F.col("l_linenumber").alias("seq"), F.lit("unit").alias("dimension"), F.lit("low").alias("severity"), F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("title"))
    runs = table(spark, sf, "orders").select(F.expr("CAST(o_orderkey AS bigint)").alias("id"), F.lit(7).alias("score"))
    back = sr.read_reports(sr.to_report_json(runs, li))
    return back.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.expr("CAST(substring(title, 2) AS int)")).alias("first_line"))


@query("""SELECT CAST(o_orderdate AS DATE) AS entry_date, CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'open' ELSE 'rejected' END AS state, concat('idea ', CAST(o_custkey % 211 AS varchar)) AS title, lower(o_orderpriority[1]) AS risk, concat('run ', CAST(o_orderkey AS varchar)) AS evidence FROM orders WHERE o_orderkey % 4 > 0""")
def read_ledger(spark, sf):
    line = F.expr("""CASE WHEN o_orderkey % 4 > 0 THEN concat('- ', date_format(o_orderdate, 'yyyy-MM-dd'), ' | ', CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'open' ELSE 'rejected' END, ' | idea ', CAST(o_custkey % 211 AS string), ' | ', lower(substring(o_orderpriority, 1, 1)), ' | run ', CAST(o_orderkey AS string))
      ELSE concat('## note ', CAST(o_orderkey AS string)) END""")
    return sr.read_ledger(table(spark, sf, "orders").select(line.alias("value")))


@query("SELECT dimension, count(*) AS n FROM (SELECT CASE l_linenumber WHEN 1 THEN 'security' WHEN 2 THEN 'unit' ELSE 'load' END AS dimension FROM lineitem) GROUP BY 1")
def written_findings(spark, sf):
    from auditlake.plans.bindings import bound
    from auditlake.sources.store import scratch

    found = bound("findings")(spark, sf).withColumn("dimension", F.expr("CASE col WHEN 1 THEN 'security' WHEN 2 THEN 'unit' ELSE 'load' END"))
    path = scratch(spark)
    sr.write_findings(found, path)
    return fi.severity_counts(spark.read.parquet(path), "dimension").select("dimension", F.col("total").alias("n"))


@query("SELECT concat('b', p_size % 9) AS repo, count(*) AS lines, CAST(sum(length(p_name)) AS BIGINT) AS chars, max(p_name) AS last FROM part GROUP BY 1")
def read_repos(spark, sf):
    """Texts written as trees of files, one folder a repository, and read again from the folders."""
    from auditlake.sources.store import scratch

    path = scratch(spark)
    table(spark, sf, "part").select(F.expr("concat('b', CAST(p_size % 9 AS string))").alias("name"), F.col("p_name").alias("value")).repartition(5).write.partitionBy("name").text(path)
    files = ma.read_repos(spark, path, ["txt"])
    lines = files.select(F.regexp_replace("repo", "^name=", "").alias("repo"), F.explode(F.split(F.regexp_replace("content", "\n$", ""), "\n")).alias("line"))
    return lines.groupBy("repo").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"), F.max("line").alias("last"))


_UNION = {"security": ("l_linenumber = 1", "'high'", "l_orderkey % 60"), "accessibility": ("l_linenumber = 2", "'low'", None), "load": ("l_linenumber > 5", None, "l_partkey % 7")}


@query("WITH u AS (" + " UNION ALL ".join(f"SELECT l_suppkey % 30 AS repo, '{d}' AS dimension, {sev or 'NULL'} AS severity, {line or 'NULL'} AS line FROM lineitem WHERE {where}" for d, (where, sev, line) in _UNION.items()) + ") SELECT repo, dimension, severity, count(*) AS n, count(line) AS placed, CAST(max(line) AS BIGINT) AS last FROM u GROUP BY ALL")
def union_findings(spark, sf):
    """Findings of three dimensions, each without some of the others' columns, in one table."""
    parts = []
    for dimension, (where, severity, line) in _UNION.items():
        columns = {"severity": severity, "line": line and f"CAST({line} AS bigint)"}
        parts.append(table(spark, sf, "lineitem").where(where).select(F.expr("l_suppkey % 30").alias("repo"), F.lit(dimension).alias("dimension"), *[F.expr(e).alias(c) for c, e in columns.items() if e]))
    return fi.union_findings(*parts).groupBy("repo", "dimension", "severity").agg(F.count(F.lit(1)).alias("n"), F.count("line").alias("placed"), F.max("line").alias("last"))


@query("SELECT o_custkey % 50 AS repo, o_orderstatus AS status, count(*) AS n, CAST(sum(o_orderkey % 101) AS BIGINT) AS total FROM orders GROUP BY ALL")
def stored_scores(spark, sf):
    """Scores of runs stored in two writes and read again."""
    from auditlake.sources.store import scratch

    scores = table(spark, sf, "orders").select(F.expr("o_custkey % 50").alias("repo"), F.col("o_orderstatus").alias("status"), F.expr("o_orderkey % 101").alias("score"))
    path = scratch(spark)
    sr.write_scores(scores.where("score < 50"), path)
    sr.write_scores(scores.where("score >= 50"), path)
    return spark.read.parquet(path).groupBy("repo", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))
