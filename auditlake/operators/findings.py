"""Detectors on lines of text, and what becomes of findings: suppression, deduplication, union, roll-ups, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import scores as S

# Names and shapes of credentials, and words that mark a placeholder.
SECRET_ASSIGNMENT = r"(?i)(api_?key|secret|password|passwd|pwd|token|auth_?token|private_?key|aws_?secret|client_?secret)[\"']?\s*[:=]\s*[\"']([^\"'\s]{8,})[\"']"
TOKEN_SHAPES = r"((?:AKIA|ASIA)[0-9A-Z]{16}|gh[po]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9]{20,})"
PLACEHOLDER = r"(?i)(example|placeholder|changeme|your[_-]?|xxxx|dummy|sample|<[^>]+>|\$\{)"
VISIBLE = 10
# Dimensions whose findings are advice, and how titles of such findings read, for findings without a dimension.
ADVISORY_DIMENSIONS = ["load", "accessibility", "chaos", "mutation", "predictive"]
ADVISORY_TITLES = [
    "no observability", "estimated mutation|mutation score|mutation testing", r"(low|moderate|unit) test\b.*(coverage|ratio)|test-to-source", "unchained promise calls", "load analysis",
    "no (rate limiting|caching|response compression|circuit breaker|input validation|database connection pooling)", "missing (health check|rate limiting)",
    r"accessible name|visible label association|without alt attribute|low contrast|onclick|skipped heading|table without headers|role\+tabindex",
]
PHASES = [("P0", "critical", None, None), ("P1", "high", None, 10), ("P2", "medium", None, 8), ("P3", None, "unit", 5), ("P3", None, "mutation", 3), ("P3", None, "load", 5), ("P3", None, "accessibility", 5), ("P3", None, "chaos", 3)]


def explode_lines(files: DataFrame) -> DataFrame:
    """files to (repo, path, line, text), lines counted from 1; a text that ends in a newline has an empty last line."""
    return files.select("repo", "path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "text")).select("repo", "path", (F.col("pos") + 1).alias("line"), "text")


def secret_findings(lines: DataFrame) -> DataFrame:
    """One finding for each line that assigns a literal to a secret-like name, or holds a known token shape."""
    named = F.regexp_extract("text", SECRET_ASSIGNMENT, 2)
    shaped = F.regexp_extract("text", TOKEN_SHAPES, 1)
    hit = lines.select("repo", "path", "line", named.alias("named"), shaped.alias("shaped"))
    rule = F.when(F.col("shaped") != "", "token-shape").when((F.col("named") != "") & ~F.col("named").rlike(PLACEHOLDER), "secret-assignment")
    return hit.withColumn("rule", rule).where("rule is not null").select(
        "repo", "path", "line", "rule", F.lit("secrets").alias("category"), F.when(F.col("rule") == "token-shape", "critical").otherwise("high").alias("severity"), F.lit("hard-coded credential").alias("title"), F.lit(0).alias("col")
    )


def suppressions(lines: DataFrame) -> DataFrame:
    """(repo, path, line, category) of `audit-disable` remarks; line null: the whole file; category '*': every one."""
    found = lines.select("repo", "path", "line", F.regexp_extract("text", r"audit-disable(-next-line)?(?:[ ]+([a-z*-]+))?", 0).alias("m"), F.regexp_extract("text", r"audit-disable-next-line", 0).alias("n"), F.regexp_extract("text", r"audit-disable(?:-next-line)?[ ]+([a-z*-]+)", 1).alias("c")).where("m <> ''")
    return found.select("repo", "path", F.when(F.col("n") != "", F.col("line") + 1).alias("line"), F.when(F.col("c") == "", "*").otherwise(F.col("c")).alias("category"))


def filter_suppressed(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """findings without those that a remark covers; line null: the whole file, category '*': every one. One anti join on the file."""
    r = rules.select(F.col("repo").alias("r_repo"), F.col("path").alias("r_path"), F.col("line").alias("r_line"), F.col("category").alias("r_category")).distinct()
    same = (F.col("repo") == F.col("r_repo")) & (F.col("path") == F.col("r_path"))
    covers = same & (F.col("r_line").isNull() | (F.col("r_line") == F.col("line"))) & ((F.col("r_category") == "*") | (F.col("r_category") == F.col("category")))
    return findings.join(r, covers, "left_anti")


def dedupe_findings(findings: DataFrame) -> DataFrame:
    return findings.dropDuplicates(["repo", "category", "path", "line", "col", "title"])


def union_findings(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in S.SEVERITIES]
    return findings.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts)


def severity_scores(findings: DataFrame, *by: str, k: float = 5) -> DataFrame:
    """One score a key: the weights are added as integers, so the order of findings doesn't matter."""
    return findings.groupBy(*by).agg(F.sum(S.penalty_hundredths(F.col("severity"))).alias("p"), F.count(F.lit(1)).alias("n")).select(*by, "n", S.curve(F.col("p"), k).alias("score"))


def _order(*first: Column) -> list[Column]:
    return [*first, F.col("path"), F.col("line"), F.col("col"), F.col("title"), F.col("seq")]


def top_issues(findings: DataFrame, n: int = 20, run: str = "run_id") -> DataFrame:
    """The first n critical and high findings of each run, by severity, then place."""
    w = Window.partitionBy(run).orderBy(*_order(S.severity_rank(F.col("severity"))))
    return findings.where(F.col("severity").isin("critical", "high")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def dimension_groups(findings: DataFrame, order: list[str], cap: int = VISIBLE) -> DataFrame:
    """(repo, dimension, position, n, titles): the first `cap` titles of each dimension, in the fixed order of dimensions."""
    w = Window.partitionBy("repo", "dimension").orderBy(*_order(S.severity_rank(F.col("severity"))))
    shown = findings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
    lists = shown.groupBy("repo", "dimension").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("t"))
    counts = findings.groupBy("repo", "dimension").agg(F.count(F.lit(1)).alias("n"))
    position = F.array_position(F.array(*[F.lit(d) for d in order]), F.col("dimension")).cast("int")
    return counts.join(lists, ["repo", "dimension"]).select("repo", "dimension", position.alias("position"), "n", F.concat_ws("|", F.transform("t", lambda x: x["title"])).alias("titles"))


def dimension_report(repos: DataFrame, findings: DataFrame, scores: DataFrame, order: list[str], cap: int = VISIBLE) -> DataFrame:
    """(repo, position, dimension, score, applicable, reason, n, titles): every dimension of the order for each repo, found or not.

    scores: (repo, dimension, score, applicable, reason), a row where something is known; without one the score is null
    and the dimension applies. Scores are rounded half up; reason is that of dimensions that don't apply, else null.
    """
    grid = repos.select("repo").distinct().select("repo", F.posexplode(F.array(*map(F.lit, order))).alias("at", "dimension"))
    groups = dimension_groups(findings, order, cap).select("repo", "dimension", "n", "titles")
    both = grid.join(scores.select("repo", "dimension", "score", "applicable", "reason"), ["repo", "dimension"], "left").join(groups, ["repo", "dimension"], "left")
    applies = F.coalesce("applicable", F.lit(True))
    return both.select(
        "repo", (F.col("at") + 1).alias("position"), "dimension", S.round_half_up(F.col("score")).alias("score"), applies.alias("applicable"), F.when(~applies, F.col("reason")).alias("reason"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("titles", F.lit("")).alias("titles"),
    )


def overall_of_groups(report: DataFrame) -> DataFrame:
    """(repo, overall, findings) of a dimension_report(): the rounded mean of the scores that are known and apply (0 without any), and all findings."""
    counts = F.when(F.col("applicable"), F.col("score"))
    return report.groupBy("repo").agg(F.coalesce(S.round_half_up(F.avg(counts)), F.lit(0)).alias("overall"), F.sum("n").alias("findings"))


def remediation_plan(findings: DataFrame, run: str = "repo") -> DataFrame:
    """(repo, phase, dimension, severity, title, rank): what to mend first, each group with its limit."""
    group, phase, limit = F.lit(None), F.lit(None), F.lit(None)
    for i, (name, severity, dimension, most) in reversed(list(enumerate(PHASES))):
        belongs = F.col("severity") == severity if severity else (F.col("dimension") == dimension) & F.col("severity").isin("low", "info")
        group, phase, limit = (F.when(belongs, v).otherwise(c) for v, c in ((i, group), (name, phase), (most, limit)))
    taken = findings.withColumn("group", group).where("group is not null").withColumn("phase", phase).withColumn("most", limit.cast("int"))
    rank = F.row_number().over(Window.partitionBy(run, "group").orderBy(*_order(S.severity_rank(F.col("severity")))))
    # the largest limit as a number lets Spark drop the rest of a group before it is shuffled
    few = taken.where("most is not null").withColumn("rank", rank).where(F.col("rank") <= max(most for *_, most in PHASES if most)).where("rank <= most")
    every = taken.where("most is null").withColumn("rank", rank)
    return few.unionByName(every).select(run, "phase", "dimension", "severity", "title", "seq", "rank")


def health_metrics(findings: DataFrame, run: str = "repo") -> DataFrame:
    """100 less capped deductions of 10, 5, 2 and 1 for security, reliability, performance and accessibility, and their mean."""
    worth = F.when(F.col("severity") == "critical", 10).when(F.col("severity") == "high", 5).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 1).otherwise(0)
    areas = {"security": ["security"], "reliability": ["chaos", "unit", "mutation"], "performance": ["load"], "accessibility": ["accessibility"]}
    sums = [F.sum(F.when(F.col("dimension").isin(*d), worth).otherwise(0)).alias(a) for a, d in areas.items()]
    made = findings.groupBy(run).agg(*sums).select(run, *[(F.lit(100) - F.least(F.col(a), F.lit(100))).cast("int").alias(a) for a in areas])
    return made.withColumn("overall", S.round_half_up(sum((F.col(a) for a in areas), F.lit(0)) / F.lit(4.0)))


def testable_split(findings: DataFrame) -> DataFrame:
    """findings with `kept` and `reason`: those of advisory dimensions can't be tested, nor, where a finding has no dimension, those with an advisory title."""
    dimension = F.lower(F.trim(F.coalesce("dimension", F.lit(""))))
    by_title = F.coalesce(F.col("title"), F.lit("")).rlike("(?i)" + "|".join(f"({t})" for t in ADVISORY_TITLES))
    reason = F.when(dimension.isin(*ADVISORY_DIMENSIONS), "dimension").when((dimension == "") & by_title, "title")
    return findings.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def compare_rollup(findings: DataFrame) -> DataFrame:
    """Counts by severity, by dimension, and of all, by grouping sets."""
    return findings.groupingSets([["severity"], ["dimension"], []], "severity", "dimension").agg(F.count(F.lit(1)).alias("n"))


def owasp_rollup(findings: DataFrame, mapping: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row for each code of the catalog, zero rows kept: counts by severity and whether it needs attention."""
    hit = findings.join(mapping, "category")
    counts = hit.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = catalog.join(counts, "code", "left").select("code", zero("n"), zero("critical"), zero("high"))
    return out.withColumn("flagged", (F.col("critical") > 0) | (F.col("high") >= 3))


# The ten codes of the 2021 list with the categories of findings that belong to each; codes without any have no rules yet.
OWASP = {
    "A01": ["Authentication Bypass", "Path Traversal"], "A02": ["Hardcoded Secrets"], "A03": ["SQL Injection", "XSS", "Dangerous Functions", "Open Redirect"], "A04": ["Rate Limiting"], "A05": ["CORS Misconfiguration", "Security Headers"],
    "A06": ["Vulnerable Dependencies"], "A07": ["Authentication Bypass"], "A08": [], "A09": ["Sensitive Data Exposure"], "A10": [],
}


def owasp_report(findings: DataFrame) -> DataFrame:
    """(repo, code, n, critical, high, medium, low, severity, coverage): all ten codes for each repo with findings.

    severity: critical with one critical finding, high with three high ones, else null. coverage: the percent of codes
    that any rule belongs to. A category counts for each of its codes; the codes come from a literal map, without a join.
    """
    categories = sorted({c for names in OWASP.values() for c in names})
    codes = F.create_map(*[x for c in categories for x in (F.lit(c), F.array(*[F.lit(k) for k, names in OWASP.items() if c in names]))])
    by = findings.groupBy("repo", "category", "severity").agg(F.count(F.lit(1)).alias("n"))
    every = F.array(*map(F.lit, OWASP))
    rows = by.select("repo", "severity", "n", F.explode_outer(codes[F.col("category")]).alias("code")).unionByName(by.select("repo").distinct().select("repo", F.explode(every).alias("code")), allowMissingColumns=True).where("code is not null")
    total = lambda s=None: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n")) if s else F.col("n")), F.lit(0)).cast("long")
    out = rows.groupBy("repo", "code").agg(total().alias("n"), *[total(s).alias(s) for s in ("critical", "high", "medium", "low")])
    coverage = S.round_half_up(F.lit(100.0 * sum(map(bool, OWASP.values())) / len(OWASP)))
    return out.select("*", F.when(F.col("critical") > 0, "critical").when(F.col("high") >= 3, "high").alias("severity"), coverage.alias("coverage"))


def digest_cards(findings: DataFrame) -> DataFrame:
    """Per repo: counts, score and the single worst critical or high finding."""
    key = F.struct(S.severity_rank(F.col("severity")).alias("r"), "path", "line", "col", "title", "seq")
    best = F.min(F.when(F.col("severity").isin("critical", "high"), key))
    p = F.sum(S.penalty_hundredths(F.col("severity")))
    return findings.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), S.curve(p).alias("score"), best.alias("b")).select("repo", "n", "score", F.col("b.title").alias("top_title"), F.col("b.path").alias("top_path"))


def distill_findings(findings: DataFrame, cap: int = 25, length: int = 400) -> DataFrame:
    """Input for proposals: at most `cap` security findings a repo, all others; titles cut, the path's first part dropped."""
    w = Window.partitionBy("repo", F.col("dimension") == "security").orderBy(*_order(S.severity_rank(F.col("severity"))))
    kept = findings.withColumn("rank", F.row_number().over(w)).where((F.col("dimension") != "security") | (F.col("rank") <= cap))
    return kept.select("repo", "dimension", "severity", F.substring("title", 1, length).alias("title"), F.regexp_replace("path", r"^[^/]*/", "").alias("path"), "seq")


def file_risk(findings: DataFrame, n_plus_one: DataFrame, dead: DataFrame, sizes: DataFrame, functions: DataFrame, todos: DataFrame) -> DataFrame:
    """(repo, path, risk, reasons): six weighted signals of a file; every input is counted by file before the joins.

    functions: facts.js_functions (repo, path, cc), the most complex one counts from 16 on; todos: text.todo_counts
    (repo, path, n), from 4 on. A file with a size only is not listed unless it is long.
    """
    key = ["repo", "path"]
    worth = F.when(F.col("severity") == "critical", 25).when(F.col("severity") == "high", 12).when(F.col("severity") == "medium", 5).when(F.col("severity") == "low", 2).otherwise(0)
    a = findings.groupBy(*key).agg(F.sum(worth).alias("security"))
    b = n_plus_one.groupBy(*key).agg((F.count(F.lit(1)) * 10).alias("queries"))
    c = dead.groupBy(*key).agg((F.count(F.lit(1)) * 0.5).alias("dead"))
    d = sizes.groupBy(*key).agg((F.greatest(F.max("n_lines") - 400, F.lit(0)) * 0.05).alias("length"))
    e = functions.groupBy(*key).agg(F.greatest(F.max("cc") - 15, F.lit(0)).alias("complexity"))
    f = todos.groupBy(*key).agg(F.sum("n").alias("n")).select(*key, F.when(F.col("n") > 3, F.col("n")).otherwise(0).alias("todos"))
    both = a
    for other in (b, c, d, e, f):
        both = both.join(other, key, "full")
    parts = ["security", "queries", "complexity", "length", "todos", "dead"]
    filled = both.select(*key, *[F.coalesce(F.col(p).cast("double"), F.lit(0.0)).alias(p) for p in parts])
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    reasons = F.concat_ws(",", *[F.when(F.col(p) > 0, p) for p in parts])
    return filled.select(*key, (F.floor(total * 10 + 0.5) / 10).alias("risk"), reasons.alias("reasons")).where("risk > 0")


def risk_hotspots(risk: DataFrame, n: int = 5) -> DataFrame:
    """The n riskiest files of each repo with a severity, and the repo's predicted failures and its level, that of its riskiest file.

    predicted is a fifth of the repo's risks, rounded down. They are added as doubles from the riskiest on, which the SQL's
    window does too: another order can end just above or below a multiple of 5.
    """
    w = Window.partitionBy("repo").orderBy(F.col("risk").desc(), "path")
    so_far = F.sum("risk").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    added = risk.withColumn("rank", F.row_number().over(w)).withColumn("so_far", so_far)
    whole = F.max(F.struct("rank", "so_far")).over(Window.partitionBy("repo"))["so_far"]
    top = added.withColumn("predicted", F.floor(whole / 5)).where(F.col("rank") <= n)
    level = F.when(F.col("risk") >= 30, "high").when(F.col("risk") >= 12, "medium").otherwise("low")
    worst = F.max(level.isin("high").cast("int") * 2 + level.isin("medium").cast("int")).over(Window.partitionBy("repo"))
    repo_level = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.least(worst, F.lit(2)) + 1)
    return top.select("repo", "path", "risk", "rank", level.alias("severity"), "predicted", repo_level.alias("level"))
