"""Repository files as a table, and the rows that manifests, lock files and coverage artifacts hold, in built-in functions.

Every reader takes files (repo, path, content) and keeps to the files whose names it knows; a file that doesn't parse
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Member directories by convention, tags of dependency names.
MEMBER_DIRS = "libs|packages|apps|services"
STACK = {
    "express": "Express", "fastify": "Fastify", "next": "Next.js", "react": "React", "typescript": "TypeScript", "ts-node": "TypeScript", "mongoose": "MongoDB", "mongodb": "MongoDB",
    "prisma": "Prisma", "drizzle-orm": "Drizzle", "jest": "Testing", "vitest": "Testing", "stripe": "Stripe", "jsonwebtoken": "JWT", "jwt": "JWT", "passport": "Passport.js",
    "bcrypt": "Bcrypt", "bcryptjs": "Bcrypt", "redis": "Redis", "ioredis": "Redis", "redis-py": "Redis", "docker": "Docker", "docker-compose": "Docker", "zod": "Zod", "tailwindcss": "TailwindCSS",
    "socket.io": "Socket.IO", "bull": "Queue/Bull", "bullmq": "Queue/Bull", "playwright": "Playwright", "@playwright/test": "Playwright", "cypress": "Cypress",
    "fastapi": "FastAPI", "flask": "Flask", "django": "Django", "starlette": "Starlette", "sqlalchemy": "SQLAlchemy", "pydantic": "Pydantic", "alembic": "Alembic", "celery": "Celery",
    "pytest": "pytest", "httpx": "HTTP client (httpx/requests)", "requests": "HTTP client (httpx/requests)", "uvicorn": "Uvicorn/Gunicorn", "gunicorn": "Uvicorn/Gunicorn",
    "apscheduler": "APScheduler", "gin": "Gin", "echo": "Echo", "chi": "Chi", "fiber": "Fiber", "mux": "Gorilla Mux", "gorm": "GORM/sqlx", "sqlx": "GORM/sqlx", "cobra": "Cobra",
    "viper": "Viper", "grpc-go": "gRPC", "grpc": "gRPC", "zap": "Structured Go logging", "zerolog": "Structured Go logging", "logrus": "Structured Go logging",
    "testify": "Go testing (testify/ginkgo)", "ginkgo": "Go testing (testify/ginkgo)", "pgx": "PostgreSQL", "pq": "PostgreSQL",
}
_SCOPES = {"dependencies": "runtime", "devDependencies": "dev", "peerDependencies": "peer"}
_PACKAGE = "map<string,struct<version:string,resolved:string,integrity:string,dependencies:map<string,string>,devDependencies:map<string,string>>>"


def read_repos(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """files (repo, path, content, size) under root: the first folder below root is the repo. Bytes that aren't UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:
        raw = raw.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}" if len(extensions) > 1 else f"*.{extensions[0]}")
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    inner = F.element_at(F.split("path", F.concat(F.lit(r"\Q"), F.lit("/" + base + "/"), F.lit(r"\E")), 2), 2)
    df = raw.load(root).select(inner.alias("inner"), F.col("content").cast("string").alias("content"), F.col("length").alias("size"))
    return df.select(F.substring_index("inner", "/", 1).alias("repo"), F.regexp_replace("inner", "^[^/]*/", "").alias("path"), "content", "size")


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def _folder() -> Column:
    return F.regexp_replace("path", "/?[^/]*$", "")


def python_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def _known_place() -> Column:
    """The root of a repo, or a direct member of a conventional folder."""
    return _folder().rlike(rf"^$|^({MEMBER_DIRS})/[^/]+$")


def _line_matches(files: DataFrame, pattern: str) -> DataFrame:
    """One row for each line that matches, its groups in m: lines, not texts, so that a pattern never runs over a whole file."""
    lines = files.select("repo", "path", F.explode(F.split("content", r"\r?\n")).alias("s"))
    return lines.where(F.col("s").rlike(pattern))


def package_deps(files: DataFrame) -> DataFrame:
    parsed = files.where(_name() == "package.json").select("repo", "path", F.from_json("content", ", ".join(f"`{k}` map<string,string>" for k in _SCOPES)).alias("j"))
    sides = F.array(*[F.struct(F.lit(s).alias("scope"), F.col(f"j.{k}").alias("m")) for k, s in _SCOPES.items()])
    each = parsed.select("repo", "path", F.explode(sides).alias("d")).select("repo", "path", "d.scope", F.explode("d.m").alias("name", "spec"))
    return each.select("repo", F.col("path").alias("manifest"), F.lit("npm").alias("ecosystem"), "name", "spec", "scope")


def requirement_deps(files: DataFrame) -> DataFrame:
    p = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*([=<>!~][^;#]*)?"
    rows = _line_matches(files.where(_name().rlike(r"^requirements[^/]*\.txt$")), r"^\s*[A-Za-z0-9]")
    dev = F.when(F.col("path").rlike("dev|test"), "dev").otherwise("runtime")
    return rows.select("repo", F.col("path").alias("manifest"), F.lit("pypi").alias("ecosystem"), python_name(F.regexp_extract("s", p, 1)).alias("name"), F.trim(F.regexp_extract("s", p, 2)).alias("spec"), dev.alias("scope"))


def pyproject_deps(files: DataFrame) -> DataFrame:
    """PEP 621 arrays, extras and groups (quoted requirements inside [...] after a key), and Poetry tables (name = spec)."""
    f = files.where(_name() == "pyproject.toml")
    sections = f.select("repo", "path", F.explode(F.split("content", r"(?m)^(?=\[)")).alias("s"))
    head = sections.select("repo", "path", "s", F.regexp_extract("s", r"^\[+([^\]]+)\]", 1).alias("h"))
    listed = F.regexp_extract_all("s", F.lit(r"""["']([A-Za-z0-9][A-Za-z0-9._-]*(?:\[[^\]"']*\])?[^"']*)["']"""), F.lit(1))
    only = F.when(F.col("h") == "project", F.array(F.regexp_extract("s", r"(?s)(?m)^dependencies\s*=\s*(\[.*?^?\s*\])\s*$", 1))).otherwise(F.array("s"))
    pep = head.where("h in ('project', 'project.optional-dependencies', 'dependency-groups')").select("repo", "path", "h", F.explode(only).alias("s"))
    a = pep.select("repo", "path", "h", F.explode(listed).alias("r")).select(
        "repo", "path", F.regexp_extract("r", r"^([A-Za-z0-9._-]+)", 1).alias("name"), F.trim(F.regexp_extract("r", r"^[A-Za-z0-9._-]+(?:\[[^\]]*\])?([^;]*)", 1)).alias("spec"),
        F.when(F.col("h") == "dependency-groups", "dev").otherwise("runtime").alias("scope"),
    )
    poetry = head.where(F.col("h").rlike(r"^tool\.poetry\.(dependencies|dev-dependencies|group\..*\.dependencies)$")).select("repo", "path", "h", F.explode(F.split("s", "\n")).alias("l"))
    b = poetry.select("repo", "path", F.regexp_extract("l", r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*=", 1).alias("name"), F.regexp_extract("l", r"""=\s*(?:\{[^}]*version\s*=\s*)?["']([^"']*)""", 1).alias("spec"), F.when(F.col("h") == "tool.poetry.dependencies", "runtime").otherwise("dev").alias("scope"))
    both = a.unionByName(b).where("name not in ('', 'python')")
    return both.select("repo", F.col("path").alias("manifest"), F.lit("pypi").alias("ecosystem"), python_name(F.col("name")).alias("name"), "spec", "scope")


def go_deps(files: DataFrame) -> DataFrame:
    """Direct requirements of go.mod under the last segment of their module path, major version suffixes left out."""
    p = r"^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+(v\S+)\s*(//.*)?$"
    rows = _line_matches(files.where(_name() == "go.mod"), p).where(~F.col("s").contains("// indirect") & ~F.col("s").contains("=>"))
    module = F.regexp_replace(F.regexp_extract("s", p, 1), r"/v[0-9]+$", "")
    return rows.select("repo", F.col("path").alias("manifest"), F.lit("go").alias("ecosystem"), F.element_at(F.split(module, "/"), -1).alias("name"), F.regexp_extract("s", p, 2).alias("spec"), F.lit("runtime").alias("scope"))


def extract_deps(files: DataFrame) -> DataFrame:
    """deps (repo, manifest, ecosystem, name, spec, scope), distinct, from manifests at known places."""
    f = files.where(_known_place())
    return package_deps(f).unionByName(requirement_deps(f)).unionByName(pyproject_deps(f)).unionByName(go_deps(f)).distinct()


def workspace_members(files: DataFrame) -> DataFrame:
    """(repo, member): folders with a manifest that a workspace pattern of the root or a convention names. The patterns of a repo meet only its own manifests."""
    root = files.where("path = 'package.json'").select("repo", F.from_json("content", "workspaces array<string>").alias("a"), F.from_json("content", "workspaces struct<packages:array<string>>").alias("b"))
    globs = root.select("repo", F.explode(F.coalesce("a.workspaces", "b.workspaces.packages")).alias("g"))
    uv = files.where("path = 'pyproject.toml'").select("repo", F.regexp_extract("content", r"(?s)\[tool\.uv\.workspace\].*?members\s*=\s*\[([^\]]*)\]", 1).alias("m"))
    globs = globs.unionByName(uv.select("repo", F.explode(F.regexp_extract_all("m", F.lit("[\"']([^\"']+)[\"']"), F.lit(1))).alias("g")))
    regex = F.concat(F.lit("^"), F.replace(F.replace(F.replace(F.regexp_replace(F.col("g"), "/$", ""), F.lit("."), F.lit("[.]")), F.lit("**"), F.lit(".+")), F.lit("*"), F.lit("[^/]+")), F.lit("$"))
    folders = files.where(_name().isin("package.json", "pyproject.toml", "go.mod")).select("repo", _folder().alias("member")).where("member <> ''").distinct()
    named = folders.join(globs.select("repo", regex.alias("re")).distinct(), "repo").where("member rlike re").select("repo", "member")
    return named.union(folders.where(F.col("member").rlike(rf"^({MEMBER_DIRS})/[^/]+$"))).distinct()


def tech_stack(deps: DataFrame) -> DataFrame:
    """(repo, stack): distinct tags of a repo's dependency names; the rule table is a literal map."""
    tags = F.create_map(*[F.lit(x) for kv in STACK.items() for x in kv])
    tag = F.when(F.col("name").startswith("opentelemetry"), "OpenTelemetry").otherwise(tags[F.col("name")])
    return deps.select("repo", tag.alias("stack")).where("stack is not null").distinct()


def package_lock_entries(files: DataFrame) -> DataFrame:
    parsed = files.where(_name() == "package-lock.json").select("repo", "path", F.from_json("content", f"packages {_PACKAGE}").alias("j"))
    root = F.element_at("j.packages", "")
    direct = F.concat(F.coalesce(F.map_keys(root["dependencies"]), F.array().cast("array<string>")), F.coalesce(F.map_keys(root["devDependencies"]), F.array().cast("array<string>")))
    each = parsed.select("repo", "path", direct.alias("direct"), F.explode("j.packages").alias("k", "p")).where("k like '%node_modules/%'")
    name = F.substring_index("k", "node_modules/", -1)
    is_direct = F.array_contains("direct", name) & (F.size(F.split("k", "node_modules/")) == 2)
    return each.select("repo", F.lit("npm").alias("ecosystem"), name.alias("name"), "p.version", "p.resolved", "p.integrity", is_direct.alias("is_direct"))


def pinned_entries(files: DataFrame) -> DataFrame:
    """Requirements with ==, Poetry's [[package]] blocks, both parts of Pipfile.lock, and go.sum with its '/go.mod' twins folded."""
    lines = lambda name: _line_matches(files.where(_name().rlike(name)), r"\S")
    req = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*==\s*([^\s;#,]+)"
    a = lines(r"^requirements[^/]*\.txt$").select("repo", F.lit("pypi").alias("ecosystem"), python_name(F.regexp_extract("s", req, 1)).alias("name"), F.regexp_extract("s", req, 2).alias("version"))
    blocks = files.where(_name() == "poetry.lock").select("repo", F.explode(F.split("content", r"\[\[package\]\]")).alias("s"))
    field = lambda k: F.regexp_extract("s", rf'(?m)^{k}\s*=\s*"([^"]+)"', 1)
    b = blocks.select("repo", F.lit("pypi").alias("ecosystem"), python_name(field("name")).alias("name"), field("version").alias("version"))
    pip = files.where(_name() == "Pipfile.lock").select("repo", F.from_json("content", "`default` map<string,struct<version:string>>, develop map<string,struct<version:string>>").alias("j"))
    c = pip.select("repo", F.explode(F.array("j.default", "j.develop")).alias("m")).select("repo", F.explode("m").alias("k", "v"))
    c = c.select("repo", F.lit("pypi").alias("ecosystem"), python_name(F.col("k")).alias("name"), F.regexp_replace("v.version", "^==", "").alias("version"))
    gs = r"^(\S+)\s+(v[^\s/]+)(?:/go\.mod)?\s+\S+"
    d = lines(r"^go\.sum$").select("repo", F.lit("go").alias("ecosystem"), F.regexp_extract("s", gs, 1).alias("name"), F.regexp_extract("s", gs, 2).alias("version"))
    return a.union(b).union(c).union(d).where("name <> '' and version <> ''").distinct()


def lock_entries(files: DataFrame) -> DataFrame:
    """lock_entries (repo, ecosystem, name, version, resolved, integrity, is_direct) of every kind of lock file."""
    return package_lock_entries(files).unionByName(pinned_entries(files), allowMissingColumns=True)


def installed_licenses(files: DataFrame) -> DataFrame:
    """(repo, name, version, license) of installed packages: a string, {type}, or the first of licenses[]."""
    f = files.where(F.col("path").rlike(r"(^|/)node_modules/((@[^/]+/)?[^/@]+)/package\.json$"))
    j = lambda p: F.get_json_object("content", p)
    whole = F.when(~j("$.license").startswith("{"), j("$.license"))
    text = F.coalesce(j("$.license.type"), whole, j("$.licenses[0].type"), j("$.licenses[0]"))
    return f.select("repo", F.coalesce(j("$.name"), F.regexp_extract("path", r"node_modules/((?:@[^/]+/)?[^/@]+)/package\.json$", 1)).alias("name"), j("$.version").alias("version"), text.alias("license"))


def read_coverage(files: DataFrame) -> DataFrame:
    """coverage (repo, pct, file_count, format, source): Istanbul's summary before Cobertura before lcov; then the first path."""
    f = files.select("repo", "path", "content")
    ist = f.where(_name() == "coverage-summary.json").select(
        "repo", "path", F.get_json_object("content", "$.total.lines.pct").cast("double").alias("pct"), (F.size(F.map_keys(F.from_json("content", "map<string,string>"))) - 1).cast("long").alias("file_count"), F.lit(1).alias("rank"), F.lit("istanbul").alias("format")
    )
    rates = F.regexp_extract_all("content", F.lit(r'<class\b[^>]*?line-rate="([0-9.]+)"'), F.lit(1)).cast("array<double>")
    root = F.regexp_extract("content", r'<coverage\b[^>]*?line-rate="([0-9.]+)"', 1)
    mean = F.aggregate(rates, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(rates) > 0, F.size(rates))
    cob = f.where(_name().rlike(r"^(cobertura[^/]*|coverage)\.xml$")).select(
        "repo", "path", (100 * F.coalesce(F.when(root != "", root).cast("double"), mean)).alias("pct"), F.size(rates).cast("long").alias("file_count"), F.lit(2).alias("rank"), F.lit("cobertura").alias("format")
    )
    lcov = _line_matches(f.where(_name().rlike(r"^lcov\.info$|\.lcov$")), "^(LF|LH):[0-9]+").select("repo", "path", F.substring("s", 1, 2).alias("k"), F.regexp_extract("s", ":([0-9]+)", 1).cast("long").alias("v"))
    total = lambda k: F.sum(F.when(F.col("k") == k, F.col("v")))
    by = lcov.groupBy("repo", "path").agg(total("LH").alias("hit"), total("LF").alias("found"), F.count_if(F.col("k") == "LF").alias("file_count"))
    lc = by.where("found > 0").select("repo", "path", (F.lit(100.0) * F.coalesce(F.col("hit"), F.lit(0)) / F.col("found")).alias("pct"), "file_count", F.lit(3).alias("rank"), F.lit("lcov").alias("format"))
    every = ist.unionByName(cob).unionByName(lc).where("pct is not null and not isnan(pct)")
    first = Window.partitionBy("repo").orderBy("rank", "path")
    return every.withColumn("n", F.row_number().over(first)).where("n = 1").select("repo", F.greatest(F.lit(0.0), F.least(F.lit(100.0), "pct")).alias("pct"), "file_count", "format", F.col("path").alias("source"))
