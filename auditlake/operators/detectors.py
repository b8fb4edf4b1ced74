"""Findings and reports that stand on the facts of code and on manifests: filters, conditional aggregates, equi joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import scores as S
from auditlake.operators.text import TEST_PATH
from auditlake.sources.store import sorted_side, stored

# Which callees query a database, which packages are known to be vulnerable and below which major version.
QUERY_METHODS = {"query", "exec", "execute", "raw", "findone", "findmany", "findunique", "findfirst", "aggregate", "queryraw", "executeraw"}
STORE_METHODS = {"find", "get", "all", "run", "count"}  # of a database only if an object before them says so
STORES = {
    "db", "database", "conn", "connection", "client", "pool", "knex", "prisma", "sequelize", "collection", "coll", "model", "models", "repository", "repo", "mongoose", "mongo", "sql", "cursor", "tx",
    "trx", "trans", "transaction", "queryrunner", "datasource", "orm", "dao", "pg", "pgp", "sqlite", "d1", "drizzle", "stmt", "statement", "prepared",
}
VULNERABLE = {"lodash": ("medium", 4), "minimist": ("medium", 1), "axios": ("medium", 0), "jsonwebtoken": ("high", 9), "express": ("medium", 4), "node-fetch": ("low", 2), "semver": ("high", 7), "word-wrap": ("medium", 1)}
PYTHON_SEVERITY = {
    "sql-string-interpolation": "high", "mutable-default-arg": "medium", "int-coercion-unchecked": "medium", "requests-no-timeout": "medium", "bare-except": "low", "eq-none": "low", "assert-for-validation": "low",
    "py-taint-sqli": "critical", "py-taint-rce": "critical", "py-taint-path": "high", "py-taint-ssrf": "high",
}
STRONG_MATCHERS = [
    "toBe", "toEqual", "toStrictEqual", "toThrow", "toThrowError", "toBeInstanceOf", "toHaveLength", "toContain", "toContainEqual", "toHaveProperty", "toHaveBeenCalledWith", "toHaveReturnedWith", "toMatch",
    "toMatchObject", "toBeCloseTo", "toBeGreaterThan", "toBeGreaterThanOrEqual", "toBeLessThan", "toBeLessThanOrEqual", "toBeBetween", "rejects", "resolves", "is", "deepEqual", "truthy", "falsy", "throws", "notThrows",
]
WEAK_MATCHERS = ["toBeTruthy", "toBeFalsy", "toBeDefined", "toBeUndefined", "toBeNull", "toBeNaN", "toHaveBeenCalled"]
SNAPSHOT_MATCHERS = ["toMatchSnapshot", "toMatchInlineSnapshot", "toMatchFileSnapshot", "toMatchTrimmedSnapshot"]
TEST_OR_EXAMPLE = r"(^|/)(tests?|__tests__|spec|e2e|examples?|demos?)/|(^|/)test_[^/]*\.py$|[._-](test|spec)\.[a-z]+$"
_FINDING = ["repo", "path", "line", "col", "rule", "category", "severity", "title"]


def is_db_query(callee: Column) -> Column:
    """A callee whose last segment queries, or is a plain method of something that is named like a database; case doesn't matter."""
    parts = F.split(F.lower(callee), r"\??\.")
    last, before = F.element_at(parts, -1), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    of_store = F.arrays_overlap(before, F.array(*map(F.lit, sorted(STORES))))
    return last.isin(*QUERY_METHODS) | (last.isin(*STORE_METHODS) & of_store)


def _first_rule(df: DataFrame, rules: list[tuple[Column, str, str, Column | str, str]], *more: Column) -> DataFrame:
    """One finding for each rule that a row meets: (condition, rule, category, severity, title)."""
    as_col = lambda s: s if isinstance(s, Column) else F.lit(s)
    hits = F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(cat).alias("category"), as_col(sev).alias("severity"), F.lit(title).alias("title"))) for c, r, cat, sev, title in rules])
    found = df.select("repo", "path", "line", "col", *more, F.explode(F.array_compact(hits)).alias("h"))
    return found.select("*", "h.*").drop("h").select(*_FINDING, *[c for c in found.columns if c not in ("repo", "path", "line", "col", "h")])


def injection_findings(calls: DataFrame) -> DataFrame:
    """Calls whose first argument is built from parts or comes from a request; a name that made it safe clears it.

    confidence: high for data of a request as they are, medium if they went through a call, low without proof of any.
    """
    n, kind = F.col("name"), F.col("arg_kind")
    dirty = F.col("taint") & ~F.col("sanitized")
    built, moving = kind.isin("template", "concat"), ~kind.isin("literal", "none")
    by = lambda high: F.when(dirty, high).otherwise("low")
    return _first_rule(calls, [
        (is_db_query(n) & ~n.rlike(r"\.(get|all|find)$") & (built | (dirty & moving)) & ~F.col("sanitized"), "sql-injection", "SQL Injection", "critical", "query text built from parts"),
        (n.isin("eval", "Function") & moving, "eval", "Dangerous Functions", "critical", "text run as code"),
        (n.isin("exec", "execSync", "child_process.exec", "child_process.execSync", "cp.exec", "cp.execSync") & moving, "shell", "Dangerous Functions", "critical", "shell command from parts"),
        (n.isin("setTimeout", "setInterval") & kind.isin("literal", "template", "concat") & F.col("value").rlike(r"^[\"'`]"), "string-timer", "Dangerous Functions", "high", "timer given text"),
        (n.rlike(r"^fs\.|(^|\.)(readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream|unlink|sendFile)$") & moving & (dirty | built), "path-traversal", "Path Traversal", by("high"), "path from input"),
        (n.rlike(r"(^|\.)redirect$") & moving, "open-redirect", "Open Redirect", by("medium"), "redirect target from input"),
        (n.rlike(r"^res\.(send|write|end)$") & moving & (dirty | built), "reflected-xss", "XSS", by("high"), "input sent back as markup"),
    ], _confidence())


def markup_findings(facts: DataFrame) -> DataFrame:
    """Assignments to innerHTML and outerHTML of what moves and nothing makes safe; high severity if it comes from a request."""
    moving = ~F.col("arg_kind").isin("literal", "none", "ident") | F.col("taint")
    set_ = facts.where("kind = 'misc' and name = 'markup'")
    return _first_rule(set_, [(moving & ~F.col("sanitized"), "inner-html", "XSS", F.when(F.col("taint"), "high").otherwise("low"), "markup set from input")], _confidence())


def _confidence() -> Column:
    return F.when(F.col("level") == "direct", "high").when(F.col("level").isNotNull(), "medium").otherwise("low").alias("confidence")


def route_findings(calls: DataFrame) -> DataFrame:
    """Routes that change data without a guard among their arguments, open cross-origin settings, secrets in responses."""
    n, has = F.col("name"), lambda m: F.array_contains("marks", m)
    route = n.rlike(r"^(app|router|server|fastify)\.(post|put|patch|delete)$") & F.col("value").rlike(r"^[\"'`]/")
    guarded, wild, creds = has("guarded"), has("wild-origin"), has("credentials")
    return _first_rule(calls, [
        (route & ~guarded, "route-without-auth", "Authentication Bypass", "medium", "route without inline auth"),
        ((n == "cors") & (F.col("n_args") == 0), "cors-default", "CORS Misconfiguration", "medium", "cross-origin default"),
        ((n == "cors") & wild, "cors-wildcard", "CORS Misconfiguration", F.when(creds, "high").otherwise("medium"), "cross-origin for everyone"),
        (n.rlike(r"^(res|reply)\.(json|send)$") & has("secret"), "sensitive-response", "Sensitive Data Exposure", "high", "secret field in a response"),
    ])


def n_plus_one_findings(calls: DataFrame) -> DataFrame:
    """(repo, path, line, col, name, rank, total): queries inside loops but not inside Promise.all; all counted, 8 shown for a repo."""
    hits = calls.where(is_db_query(F.col("name")) & F.col("in_loop") & ~F.col("in_all")).select("repo", "path", "line", "col", "name").dropDuplicates(["repo", "path", "line", "col"])
    totals = hits.groupBy("repo").agg(F.count(F.lit(1)).alias("total"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy("path", "line", "col"))).where("rank <= 8")
    return ranked.join(totals, "repo")


def edge_case_counts(facts: DataFrame) -> DataFrame:
    """Counts of each edge rule for each repo with any."""
    n, call = F.col("name"), F.col("kind") == "call"
    rule = (
        F.when(call & n.isin("parseInt", "Number.parseInt") & (F.col("n_args") == 1), "parse-int-radix")
        .when(call & (n == "JSON.parse") & ~F.col("in_try"), "json-parse-unguarded")
        .when(call & (n == "Number") & ~F.array_contains("marks", "nan") & (F.col("arg_kind") != "literal"), "number-unchecked")
        .when((F.col("kind") == "misc") & n.isin("new-date", "loose-equality", "switch-no-default"), n)
    )
    names = ["parse-int-radix", "json-parse-unguarded", "number-unchecked", "new-date", "loose-equality", "switch-no-default"]
    found = facts.where(F.col("kind").isin("call", "misc")).select("repo", rule.alias("rule")).where("rule is not null")
    return found.groupBy("repo").agg(*[F.count_if(F.col("rule") == r).alias(r.replace("-", "_")) for r in names])


def python_findings(facts: DataFrame) -> DataFrame:
    """Edge and taint rules with fixed severities; taint only outside tests and examples; one finding a rule and line."""
    severity = F.create_map(*[F.lit(x) for kv in PYTHON_SEVERITY.items() for x in kv])[F.col("name")]
    rows = facts.where("kind = 'rule'").where(~(F.col("name").startswith("py-taint") & F.col("path").rlike(TEST_OR_EXAMPLE)))
    return rows.dropDuplicates(["repo", "path", "line", "name"]).select("repo", "path", "line", "col", F.col("name").alias("rule"), severity.alias("severity"))


def dependency_findings(deps: DataFrame) -> DataFrame:
    """Known-vulnerable npm names; the first manifest of a name counts, and a declared major above the bound clears it."""
    table = lambda i: F.create_map(*[F.lit(x) for k, v in VULNERABLE.items() for x in (k, v[i])])[F.col("name")]
    first = Window.partitionBy("repo", "name").orderBy("manifest", "scope")
    one = deps.where(F.col("name").isin(*VULNERABLE)).withColumn("n", F.row_number().over(first)).where("n = 1")
    major = F.regexp_extract("spec", r"^[\^~>=<v\s]*(\d+)", 1)
    return one.where((major == "") | (major.try_cast("int") <= table(1))).select("repo", "name", "spec", table(0).alias("severity"))


def missing_controls(deps: DataFrame) -> DataFrame:
    """(repo, no_rate_limit, no_headers) of repos with a web framework."""
    has = lambda p: F.coalesce(F.bool_or(F.col("name").rlike(p)), F.lit(False))
    by = deps.groupBy("repo").agg(has(r"^(express|fastify|koa|fastapi|flask|django|gin|echo|fiber|chi)$").alias("web"), has("rate-?limit|slowapi|limits$").alias("limit"), has("helmet|secure|talisman").alias("headers"))
    return by.where("web and not (limit and headers)").select("repo", (~F.col("limit")).alias("no_rate_limit"), (~F.col("headers")).alias("no_headers"))


def table_header_findings(files: DataFrame) -> DataFrame:
    """(repo, path, n): tables without a header cell before the first close after them, or the text's end.

    In a text between two closes, these are the tables that open after the last header cell.
    """
    after = lambda part: F.element_at(F.split(part, r"(?i)<th\b|role=.?columnheader", -1), -1)
    bare = F.transform(F.split("content", "(?i)</table>", -1), lambda part: F.regexp_count(after(part), F.lit(r"(?i)<table\b")).cast("long"))
    n = F.aggregate(bare, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return files.where(F.contains(F.lower("content"), F.lit("<table"))).select("repo", "path", n.alias("n")).where("n > 0")


def visual_flags(files: DataFrame) -> DataFrame:
    """(repo, inline_styles, pixels, colors): inline styles in 3 files or more without style modules, 10 pixel sizes, 5 colour literals."""
    count = lambda p: F.regexp_count("content", F.lit(p)).cast("long")
    per = files.select("repo", F.col("content").rlike(r"style=\{\{|style=[\"']").cast("long").alias("s"), F.col("path").rlike(r"\.module\.(css|scss)$").alias("m"), count(r"\b\d+px\b").alias("p"), count(r"#[0-9a-fA-F]{3,8}\b|\brgba?\(").alias("c"))
    by = per.groupBy("repo").agg(F.sum("s").alias("s"), F.bool_or("m").alias("m"), F.sum("p").alias("p"), F.sum("c").alias("c"))
    return by.select("repo", ((F.col("s") >= 3) & ~F.col("m")).alias("inline_styles"), (F.col("p") >= 10).alias("pixels"), (F.col("c") >= 5).alias("colors"))


def complexity_by_file(functions: DataFrame) -> DataFrame:
    """(repo, path, max_cc, total_cc, n, hottest): the three functions of most branches as name:cc, ties by line. Only three a file are ever kept."""
    top = Window.partitionBy("repo", "path").orderBy(F.desc("cc"), "line", "name")
    ranked = functions.withColumn("r", F.row_number().over(top))
    named = F.concat_ws(":", F.when(F.col("name") == "", "(anonymous)").otherwise(F.col("name")), "cc")
    by = ranked.groupBy("repo", "path").agg(F.max("cc").alias("max_cc"), F.sum("cc").alias("total_cc"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", named.alias("s"))))).alias("h"))
    return by.select("repo", "path", "max_cc", "total_cc", "n", F.concat_ws(",", F.transform("h", lambda x: x["s"])).alias("hottest"))


def assertion_quality(facts: DataFrame) -> DataFrame:
    """Per test file: strong, weak, snapshot and other matchers, distinct strong ones, weak-heavy (3 or more, over half) and snapshot-only."""
    m = F.col("value")
    is_in = lambda names: m.isin(*names)
    by = facts.where("kind = 'misc' and name = 'matcher'").groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_in(STRONG_MATCHERS)).alias("strong"), F.count_if(is_in(WEAK_MATCHERS)).alias("weak"), F.count_if(is_in(SNAPSHOT_MATCHERS)).alias("snapshot"),
        F.count_distinct(F.when(is_in(STRONG_MATCHERS), m)).alias("kinds"),
    )
    return by.select("*", ((F.col("n") >= 3) & (2 * F.col("weak") > F.col("n"))).alias("weak_heavy"), (F.col("n") == F.col("snapshot")).alias("snapshot_only"))


def mutation_summary(files: DataFrame, facts: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """What mutation_estimate() needs of each repo, from its files and the matchers among their facts; tools: (repo) of repos with a mutation tool."""
    test, lines = F.col("path").rlike(TEST_PATH), F.length("content") - F.length(F.replace("content", F.lit("\n"))) + 1
    by = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum(lines).alias("lines"), F.count_if(~test).alias("source_files"), F.count_if(test).alias("test_files"))
    m, n = F.col("value"), F.count(F.lit(1))
    said = facts.where("kind = 'misc' and name = 'matcher'").groupBy("repo").agg(
        (F.count_if(m.isin(*WEAK_MATCHERS)) / n).alias("weak_ratio"), (F.count_if(m.isin(*SNAPSHOT_MATCHERS)) / n).alias("snapshot_ratio"), F.count_distinct(F.when(m.isin(*STRONG_MATCHERS), m)).alias("kinds")
    )
    both = by.join(said, "repo", "left").fillna(0, ["weak_ratio", "snapshot_ratio", "kinds"])
    if tools is None:
        return both.withColumn("has_tool", F.lit(False))
    return both.join(tools.select("repo").distinct().withColumn("tool", F.lit(True)), "repo", "left").withColumn("has_tool", F.coalesce("tool", F.lit(False))).drop("tool")


def mutation_estimate(summary: DataFrame) -> DataFrame:
    """summary (repo, files, lines, source_files, test_files, weak_ratio, snapshot_ratio, kinds, has_tool) to (repo, mutants, score, killed)."""
    mutants = F.floor(F.col("files") * 3 + F.col("lines") / 100)
    ratio = F.when(F.col("source_files") > 0, F.col("test_files") / F.col("source_files")).otherwise(0.0)
    base = F.least(F.lit(75), S.round_half_up(25 + ratio * 100))
    moved = base + F.when(F.col("kinds") >= 5, 5).otherwise(0) - F.when(F.col("weak_ratio") > 0.3, 10).otherwise(0) - F.when(F.col("snapshot_ratio") > 0.5, 5).otherwise(0) + F.when(F.col("has_tool"), 10).otherwise(0)
    score = F.greatest(F.lit(10), F.least(F.lit(90), moved))
    return summary.select("repo", mutants.alias("mutants"), score.alias("score")).withColumn("killed", F.floor(F.col("mutants") * F.col("score") / 100))


def test_quality(tests: DataFrame) -> DataFrame:
    """Per repo: cases, skipped, focused, empty and (of the others that run) assertion-less."""
    form = F.col("form")
    skipped = form.rlike(r"\.skip$|^x(it|test)$")
    return tests.groupBy("repo").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(skipped).alias("skipped"), F.count_if(form.rlike(r"\.only$|^fit$")).alias("focused"),
        F.count_if(F.col("is_empty")).alias("empty"), F.count_if(~F.col("has_assertion") & ~F.col("is_empty") & ~skipped).alias("assertionless"),
    )


def test_words(titles: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(repo, w): lower-case words of test titles, from a letter on, three letters or digits at least; and, if imports of test files are given, the names that they import."""
    said = titles.select("repo", F.explode(F.split(F.lower("title"), r"\s+")).alias("w")).where(F.col("w").rlike("^[a-z][a-z0-9]{2,}$"))
    if imports is not None:
        names = imports.where(F.col("path").rlike(TEST_PATH)).select("repo", F.explode(F.regexp_extract_all("imported", F.lit(r"([A-Za-z_$][\w$]*)"), F.lit(1))).alias("w"))
        said = said.union(names.select("repo", F.lower("w").alias("w")).where("length(w) > 2 and w not in ('from', 'type')"))
    return said.distinct()


def contained_in(parts: DataFrame, wholes: DataFrame, by: str = "repo", gram: int = 3) -> DataFrame:
    """(by, part, whole): the texts of parts that stand in texts of wholes with the same key; both are (by, text), distinct.

    An index of grams: a part stands only where each of its grams does, so it is looked up by the one that the fewest
    wholes of its key have, and what that finds is compared whole. Parts shorter than a gram are looked up as they are.
    """
    grams = lambda size: F.transform(F.sequence(F.lit(1), F.length("text") - size + 1), lambda i: F.substr("text", i, F.lit(size)))
    sizes = [F.when(F.length("text") >= k, grams(k)).otherwise(F.array().cast("array<string>")) for k in range(1, gram + 1)]
    index = wholes.where("text <> ''").select(by, F.col("text").alias("whole"), F.explode(F.array_distinct(F.concat(*sizes))).alias("g"))
    common = index.groupBy(by, "g").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length("text") >= gram, F.array_distinct(grams(gram))).otherwise(F.array("text"))
    asked = parts.where("text <> ''").select(by, F.col("text").alias("part"), F.explode(own).alias("g"))
    rarest = asked.join(sorted_side(common), [by, "g"], "left").groupBy(by, "part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).where("r.n > 0")
    return rarest.select(by, "part", F.col("r.g").alias("g")).join(sorted_side(index), [by, "g"]).where(F.contains("whole", F.col("part"))).select(by, "part", "whole")


def tested_functions(functions: DataFrame, titles: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(repo, name, tested): the name, whatever its case, is a test word, holds one or stands in one; see test_words().

    Names and words are looked up in both directions; they are written once, so that no file is parsed again for that.
    """
    words = stored(test_words(titles, imports).select("repo", F.col("w").alias("text")))
    names = stored(functions.where("name <> ''").select("repo", "name").distinct().withColumn("text", F.lower("name")))
    own = names.select("repo", "text").distinct()
    hit = contained_in(own, words).select("repo", F.col("part").alias("text")).union(contained_in(words, own).select("repo", F.col("whole").alias("text"))).distinct()
    return names.join(sorted_side(hit.withColumn("hit", F.lit(True))), ["repo", "text"], "left").select("repo", "name", F.coalesce("hit", F.lit(False)).alias("tested"))


# Packages that only run tests.
TEST_FRAMEWORKS = r"^(vitest|jest|mocha|chai|sinon|ava|tape|node:test|node:assert|assert|@jest/.*|@testing-library/.*|@playwright/test|cypress)$"


def tests_without_source(files: DataFrame, imports: DataFrame, paths: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(repo, path): test files from which no chain of imports through test files and helpers leads to a source or a package of use.

    imports: facts.js_imports; paths: joins.resolve_imports. The files that do reach one grow backwards from the sources,
    a join a round with what the last round found, so that cycles end and a chain of k helpers takes k rounds.
    """
    tests = files.select("repo", "path").distinct().where(F.col("path").rlike(TEST_PATH))
    edges = stored(imports.select("repo", "path", "specifier").join(paths.select("repo", "path", "specifier", "target"), ["repo", "path", "specifier"]).select("repo", "path", "target").distinct())
    packages = imports.where(~F.col("specifier").rlike(r"^[./]") & ~F.col("specifier").rlike(TEST_FRAMEWORKS)).select("repo", "path")
    sources = edges.where(~F.col("target").rlike(TEST_PATH)).select("repo", "path")
    new = reached = stored(packages.union(sources).distinct().join(tests, ["repo", "path"], "left_semi"))
    for _ in range(max_rounds):
        found = edges.join(new.select("repo", F.col("path").alias("target")), ["repo", "target"], "left_semi").select("repo", "path").distinct()
        new = stored(found.join(tests, ["repo", "path"], "left_semi").join(reached, ["repo", "path"], "left_anti"))
        if new.isEmpty():
            return tests.join(reached, ["repo", "path"], "left_anti")
        reached = stored(reached.union(new))
    raise RuntimeError(f"chains of helpers did not end in {max_rounds} rounds")


def coverage_estimate(tested: DataFrame, counts: DataFrame, measured: DataFrame) -> DataFrame:
    """(repo, pct, origin): measured coverage, else the share of tested functions, else (where that plainly failed) tests to sources.

    counts: (repo, source_files, test_files); measured: (repo, pct).
    """
    share = tested.groupBy("repo").agg(S.round_half_up(F.lit(100.0) * F.count_if("tested") / F.count(F.lit(1))).alias("share"))
    both = counts.join(sorted_side(share), "repo", "left").join(sorted_side(measured.select("repo", F.col("pct").alias("real"))), "repo", "left")
    ratio = F.when(F.col("source_files") > 0, F.least(F.lit(95), S.round_half_up(F.lit(100.0) * F.col("test_files") / F.col("source_files")))).otherwise(0)
    found = F.coalesce("share", F.lit(0))
    failed = (found < 10) & (F.col("test_files") >= 10) & (10 * F.col("test_files") >= F.greatest(F.lit(1), F.col("source_files")))
    return both.select("repo", F.coalesce("real", F.when(failed, ratio).otherwise(found).cast("double")).alias("pct"), F.when(F.col("real").isNotNull(), "measured").otherwise("estimated").alias("origin"))


def load_report(flags: DataFrame) -> DataFrame:
    """flags (repo, one boolean for each capability, sync_io long) to (repo, score, users)."""
    # Points and users that each capability stands for.
    points = {"rate_limit": 12, "cache": 12, "pool": 10, "health": 8, "timeout": 8, "breaker": 5, "compression": 5, "balancer": 5, "cdn": 5}
    users = {"pool": 200, "cache": 300, "rate_limit": 100, "balancer": 500, "compression": 100, "cdn": 400}
    add = lambda table, base: reduce(lambda a, kv: a + F.when(F.col(kv[0]), kv[1]).otherwise(0), table.items(), F.lit(base))
    score = add(points, 45) - 6 * F.least("sync_io", F.lit(4))
    return flags.select("repo", F.greatest(F.lit(15), F.least(F.lit(95), score)).cast("int").alias("score"), add(users, 100).alias("users"))


def load_flags(files: DataFrame, calls: DataFrame) -> DataFrame:
    """The capabilities of load_report() and load_findings() from texts, and blocking file calls in request handlers, outside tests, from calls."""
    # Words of packages and settings that show a capability.
    patterns = {
        "rate_limit": r"rate-?limit|SlowAPIMiddleware|@limiter\.limit|Limiter\(", "cache": r"ioredis|redis|memcached|node-cache|cachetools", "pool": r"prisma|drizzle-orm|sequelize|pg-pool|create_engine|pool_size|QueuePool",
        "health": r"/healthz?\b", "timeout": r"timeout\s*[:=]|setTimeout\(", "breaker": r"opossum|circuit-?[bB]reaker", "compression": r"compression|GZipMiddleware|BrotliMiddleware", "balancer": r"[cC]luster|worker|WORKERS|pm2", "cdn": r"CloudFront|Cloudflare|CDN|static",
    }
    # Words of outgoing calls and of listeners.
    patterns |= {"calls_out": r"\bfetch\(|\baxios\b|\bgot\(|\bsuperagent\(", "listens": r"on\(|addListener", "unlistens": r"removeListener|off\("}
    seen = files.groupBy("repo").agg(*[F.bool_or(F.col("content").rlike(p)).alias(k) for k, p in patterns.items()])
    blocking = calls.where("in_handler").where(F.col("name").rlike(r"(^|\.)(readFileSync|writeFileSync|execSync|existsSync|readdirSync)$") & ~F.col("path").rlike(TEST_OR_EXAMPLE))
    return seen.join(blocking.groupBy("repo").agg(F.count(F.lit(1)).alias("sync_io")), "repo", "left").fillna(0, ["sync_io"])


def property_report(facts: DataFrame, deps: DataFrame) -> DataFrame:
    """(repo, score): 40, 15 for a framework, 15 for property calls, up to 20 for invariants and 10 for guards."""
    named = lambda k, p: F.count_if((F.col("kind") == k) & F.col("name").rlike(p))
    by = facts.where("kind in ('call', 'misc')").groupBy("repo").agg(
        named("call", r"^(fc|jsc)\.(property|assert|check)$").alias("p"), named("call", r"(?i)(^|\.)(invariant|assert)$").alias("i"), F.count_if((F.col("kind") == "misc") & (F.col("name") == "guard")).alias("g")
    )
    tools = deps.where(F.col("name").isin("fast-check", "jsverify", "hypothesis")).select("repo", F.lit(True).alias("tool")).distinct()
    score = 40 + F.when(F.col("tool"), 15).otherwise(0) + F.when(F.col("p") > 0, 15).otherwise(0) + F.least(F.lit(20), 2 * F.col("i")) + F.least(F.lit(10), F.floor(F.col("g") / 2))
    return by.join(tools, "repo", "left").select("repo", score.cast("int").alias("score"))


def stack_report(deps: DataFrame, strengths: dict[str, list[str]], severities: DataFrame) -> DataFrame:
    """(repo, strengths, score): 70 and 5 for each set of names a repo has one of, less 15, 8 or 3 a finding; within 0 and 100."""
    has = [F.bool_or(F.col("name").isin(*names)).cast("int") for names in strengths.values()]
    good = deps.groupBy("repo").agg(reduce(lambda a, b: a + b, has).alias("strengths"))
    cost = F.sum(F.when(F.col("severity").isin("critical", "high"), 15).when(F.col("severity") == "medium", 8).otherwise(3))
    both = good.join(severities.groupBy("repo").agg(cost.alias("cost")), "repo", "left").fillna(0, ["cost"])
    return both.select("repo", "strengths", F.greatest(F.lit(0), F.least(F.lit(100), 70 + 5 * F.col("strengths") - F.col("cost"))).cast("int").alias("score"))


def scope_features(files: DataFrame, features: dict[str, str]) -> DataFrame:
    """(repo, feature, documented, implemented): keywords at word bounds in README files, and in all others."""
    readme = F.col("path").rlike(r"(?i)(^|/)readme[^/]*$")
    marks = F.array_compact(F.array(*[F.when(F.col("content").rlike(rf"(?i)\b({p})\b"), F.lit(f)) for f, p in features.items()]))
    hits = files.select("repo", readme.alias("doc"), F.explode(marks).alias("feature"))
    return hits.groupBy("repo", "feature").agg(F.bool_or("doc").alias("documented"), F.bool_or(~F.col("doc")).alias("implemented"))
