"""Project reports: boolean signals of a repo, then rules on them. Signals are conditional aggregates; a rule is a condition and a severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import scores as S
from auditlake.operators import joins as jo
from auditlake.operators.detectors import TEST_OR_EXAMPLE
from auditlake.sources.store import sorted_side

# Packages, names and file names by what their presence shows.
VALIDATION = ["zod", "joi", "yup", "validator"]
RETRY_PACKAGES = ["p-retry", "async-retry", "axios-retry", "retry", "exponential-backoff", "retry-axios", "cockatiel"]
RETRY_CALLS = ["pRetry", "asyncRetry", "axiosRetry", "retry", "exponentialBackoff", "backOff"]
ERROR_TRACKING = ["@sentry/node", "@sentry/browser", "@sentry/nextjs", "@sentry/react", "rollbar", "@bugsnag/js", "bugsnag", "@bugsnag/react"]
TRACING = ["@datadog/browser-rum", "dd-trace", "datadog-metrics", "newrelic", "@newrelic/native-metrics", "@opentelemetry/api", "@opentelemetry/sdk-node", "@opentelemetry/sdk-trace-node", "honeycomb-beeline", "@honeycombio/opentelemetry-node"]
OTHER_OBSERVABILITY = [
    "opentracing", "jaeger-client", "zipkin-javascript-opentracing", "@logtail/node", "@logtail/winston", "logflare", "prom-client", "statsd-client", "sentry-sdk", "ddtrace", "opentelemetry-api", "opentelemetry-sdk",
    "opentelemetry-instrumentation-fastapi", "opentelemetry-instrumentation", "prometheus-client", "prometheus-fastapi-instrumentator", "elastic-apm", "scout-apm",
]
LOGGING = ["pino", "pino-http", "pino-pretty", "winston", "bunyan", "roarr", "structlog", "loguru", "python-json-logger", "json-logging"]
FEATURE_FLAGS = [
    "@growthbook/growthbook", "@growthbook/growthbook-react", "launchdarkly-js-client-sdk", "launchdarkly-node-server-sdk", "@launchdarkly/node-server-sdk", "@statsig/js-client", "statsig-js", "statsig-node", "unleash-client",
    "@unleash/proxy-client-react", "flagsmith", "flagsmith-nodejs", "@flagsmith/react-sdk", "flipt-client", "configcat-js", "configcat-node", "@splitsoftware/splitio",
]
#: packages that count as feature flags for delivery, but as analytics for the product
DELIVERY_FLAGS = ["posthog-js", "posthog-node", "split-software"]
ANALYTICS = [
    "posthog-js", "posthog-node", "@posthog/react", "mixpanel", "mixpanel-browser", "amplitude-js", "@amplitude/analytics-browser", "@segment/analytics-next", "analytics-node", "heap-analytics", "@heap-analytics/web", "react-ga",
    "react-ga4", "ga-4-react", "@analytics/google-analytics", "fathom-client", "plausible-tracker", "umami-tracker",
]
SERVERS = ["Express", "Fastify", "Koa", "NestJS", "Hono"]
TEST_TOOLS = ["jest", "vitest", "mocha", "ava", "@japa/runner"]
CI_FILE = r"^\.github/workflows/.+\.ya?ml$|^\.gitlab-ci\.ya?ml$|^azure-pipelines\.ya?ml$|^\.circleci/config\.ya?ml$|^bitbucket-pipelines\.yml$"
DEPLOY_FILE = (
    r"(^|/)(Dockerfile|docker-compose\.ya?ml|vercel\.json|vercel\.ts|render\.ya?ml|fly\.toml|app\.ya?ml|Procfile|netlify\.toml|cloudbuild\.ya?ml|serverless\.ya?ml)$|\.tf$|/(kubernetes|k8s|helm|terraform)/"
)
OWNERS_FILE = r"^(\.github/|docs/)?CODEOWNERS$"
SEVERITIES = S.SEVERITIES


def dependency_signals(deps: DataFrame, **names: list[str] | str) -> DataFrame:
    """(repo, one boolean a signal): whether a dependency (repo, name) is in the list, or matches the pattern."""
    has = lambda x: F.col("name").rlike(x) if isinstance(x, str) else F.col("name").isin(*x)
    return deps.groupBy("repo").agg(*[F.bool_or(has(x)).alias(k) for k, x in names.items()])


def text_signals(files: DataFrame, **patterns: str) -> DataFrame:
    """(repo, one boolean a signal): whether a file's content matches the pattern."""
    return files.groupBy("repo").agg(*[F.bool_or(F.coalesce(F.col("content").rlike(p), F.lit(False))).alias(k) for k, p in patterns.items()])


def together(repos: DataFrame, *signals: DataFrame) -> DataFrame:
    """The signals of each repo of repos, false or 0 where a repo has none. Each side has one row a repo."""
    out = repos.select("repo").distinct()
    for s in signals:
        out = out.join(sorted_side(s), "repo", "left")
        for name, kind in s.dtypes:
            if name != "repo":
                out = out.withColumn(name, F.coalesce(F.col(name), F.lit(False) if kind == "boolean" else F.lit(0).cast(kind)))
    return out


def judged(signals: DataFrame, rules: list[tuple[str, str, Column]], *keep: Column, k: float = 5) -> DataFrame:
    """(repo, rules, score, keep...): names of the rules that hold, in their order, comma-joined, and the severity score."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, _, c in rules]))
    penalty = sum((F.when(c, S.penalty_hundredths(F.lit(s))).otherwise(0) for _, s, c in rules), F.lit(0))
    return signals.select("repo", F.concat_ws(",", names).alias("rules"), S.curve(penalty, k).alias("score"), *keep)


def _count(rules: list[tuple[str, str, Column]], severity: str) -> Column:
    return sum((F.when(c, 1).otherwise(0) for _, s, c in rules if s == severity), F.lit(0))


def quick_findings(files: DataFrame, deps: DataFrame, stack: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(repo, rules, score, chains): predicates of the quick suite; chains: lines that chain a promise without a catch.

    stack: (repo, stack), endpoints: (repo, n). A repo without files is not listed; one without dependencies, stack or
    endpoints has none.
    """
    line = F.explode(F.split("content", "\n"))
    chained = F.col("l").contains("Promise") & F.col("l").contains(".then(") & ~F.col("l").contains(".catch(") & ~F.col("l").contains("try")
    chains = files.select("repo", line.alias("l")).groupBy("repo").agg(F.count_if(chained).alias("chains"))
    text = text_signals(files, handler=r"errorHandler|error handler|\(err, req, res", exits=r"process\.exit\(", environment=r"process\.env\.", shared=r"global\.|module\.exports\.shared|singleton")
    tools = stack.groupBy("repo").agg(F.bool_or(F.col("stack") == "MongoDB").alias("mongo"), F.bool_or(F.col("stack").isin("Prisma", "Drizzle")).alias("schema"), F.bool_or(F.col("stack").isin("Redis", "Queue/Bull")).alias("queue"))
    s = together(files, chains, text, tools, dependency_signals(deps, validation="|".join(VALIDATION)), endpoints.groupBy("repo").agg(F.sum("n").alias("endpoints")))
    served = F.col("endpoints") > 0
    return judged(s, [
        ("unchained-promises", "high", F.col("chains") > 0), ("no-validation", "high", ~F.col("validation") & served), ("no-error-handler", "high", ~F.col("handler") & served), ("process-exit", "medium", F.col("exits")),
        ("no-environment", "medium", ~F.col("environment")), ("mongo-without-schema", "medium", F.col("mongo") & ~F.col("schema")), ("shared-state", "medium", F.col("shared")), ("no-job-queue", "low", ~F.col("queue") & (F.col("endpoints") > 10)),
    ], "chains")


def load_findings(flags: DataFrame) -> DataFrame:
    """(repo, rules, score) of detectors.load_flags(): what a service lacks to take load; the score is the severities', not load_report()'s."""
    has = F.col
    return judged(flags, [
        ("no-rate-limit", "high", ~has("rate_limit")), ("no-cache", "medium", ~has("cache")), ("no-pool", "medium", ~has("pool")), ("no-compression", "low", ~has("compression")), ("no-balancer", "low", ~has("balancer")),
        ("no-health-check", "medium", ~has("health")), ("no-timeout", "medium", ~has("timeout")), ("no-breaker", "low", has("calls_out") & ~has("breaker")), ("sync-io-in-handlers", "high", has("sync_io") > 0),
        ("listener-leak", "medium", has("listens") & ~has("unlistens")),
    ])


def contract_findings(files: DataFrame, endpoints: DataFrame, py_routes: DataFrame, specs: DataFrame, deps: DataFrame) -> DataFrame:
    """(repo, rules, score, endpoints, documented): what is wrong between a repo's routes and its descriptions of them.

    endpoints: (repo, method, route, origin), origin code or spec; py_routes: facts.py_endpoints; specs: (repo, path,
    valid), files that look like descriptions. Projects with a web framework that makes its description from response
    models need no file; other kinds of schemas count by dependency. A repo without any of these scores 100.
    """
    e = jo.contract_diff(endpoints)
    versioned = F.col("canonical").rlike(r"/v\d+\b")
    diff = e.groupBy("repo").agg(
        F.count_if(F.col("state") != "orphan").alias("endpoints"), F.count_if(F.col("state") == "undocumented").alias("undocumented"), F.count_if(F.col("state") == "orphan").alias("orphans"), F.bool_or(versioned).alias("versioned")
    )
    models = py_routes.groupBy("repo").agg(F.count(F.lit(1)).alias("py_routes"), F.count_if("has_model").alias("modelled"), F.count_if(F.col("method").isin("GET", "POST", "PUT", "PATCH") & ~F.col("has_model")).alias("unmodelled"))
    spec = specs.groupBy("repo").agg(F.bool_or("valid").alias("has_spec"), F.count_if(~F.col("valid")).alias("invalid"))
    text = files.where(~F.col("path").contains("node_modules")).groupBy("repo").agg(
        F.bool_or(F.col("path").endswith(".py") & F.col("content").rlike(r"\bfrom\s+fastapi\b|\bimport\s+fastapi\b|FastAPI\s*\(")).alias("own_spec"),
        F.count_if(F.contains("content", F.lit("reply.send(")) & F.contains("content", F.lit("res.send(")) & ~F.contains("content", F.lit("res.json("))).alias("mixed"),
    )
    s = together(files, diff, models, spec, text, dependency_signals(deps, schema=r"graphql|apollo|grpc|protobuf"))
    has, n = F.col, F.col("endpoints")
    documented = F.when(~has("has_spec") & has("own_spec"), has("modelled")).otherwise(n - has("undocumented"))
    models_missing = has("own_spec") & (has("unmodelled") > 0)
    undocumented = has("has_spec") & (has("undocumented") > 0)
    return judged(s, [
        ("no-response-model", "medium", models_missing & (2 * has("unmodelled") > has("py_routes"))), ("few-response-models-missing", "low", models_missing & (2 * has("unmodelled") <= has("py_routes"))),
        ("no-specification", "high", ~has("has_spec") & ~has("schema") & ~has("own_spec") & (n > 5)), ("invalid-specification", "medium", has("invalid") > 0),
        ("mostly-undocumented", "high", undocumented & (2 * has("undocumented") > n)), ("undocumented-routes", "medium", undocumented & (2 * has("undocumented") <= n)),
        ("spec-only-routes", "medium", (has("orphans") > 0) & (n > 0)), ("no-versioning", "medium", has("has_spec") & (n > 10) & ~has("versioned")), ("mixed-responses", "low", has("mixed") > 0),
    ], n.cast("long").alias("endpoints"), documented.cast("long").alias("documented"))


def dead_code_report(repos: DataFrame, dead_exports: DataFrame, dead_deps: DataFrame) -> DataFrame:
    """(repo, unused_deps, dead_exports, files, rules, score) from joins.unused_exports and joins.unused_deps; repos without either score 100."""
    e = dead_exports.groupBy("repo").agg(F.count(F.lit(1)).alias("dead_exports"), F.count_distinct("path").alias("files"))
    d = dead_deps.groupBy("repo").agg(F.count(F.lit(1)).alias("unused_deps"))
    s = together(repos, e, d)
    rule = F.concat_ws(",", F.when(F.col("unused_deps") > 0, "unused-dependencies:medium"), F.when(F.col("dead_exports") > 10, "unused-exports:medium").when(F.col("dead_exports") > 0, "unused-exports:low"))
    hundredths = 50 * F.col("unused_deps") + 15 * F.least(F.col("dead_exports"), F.lit(30))
    return s.select("repo", "unused_deps", "dead_exports", "files", rule.alias("rules"), S.curve(hundredths, 6).alias("score"))


def chaos_signals(facts: DataFrame) -> DataFrame:
    """(repo, shutdown, guards, handler, retry, idempotency, tries) from code_facts() outside tests."""
    own = facts.where(~F.col("path").rlike(TEST_OR_EXAMPLE))
    call, name, first = F.col("kind") == "call", F.col("name"), F.regexp_extract("value", r"^\s*[\"'`]([^\"'`]*)[\"'`]", 1)
    listens = call & name.isin("process.on", "process.once")
    four = F.array_contains("marks", "four")
    return own.groupBy("repo").agg(
        F.bool_or(listens & first.isin("SIGTERM", "SIGINT", "SIGQUIT")).alias("shutdown"), F.bool_or(listens & first.isin("unhandledRejection", "uncaughtException", "beforeExit")).alias("guards"),
        F.bool_or(call & (name.rlike(r"(?i)^(app|server|router|api|express)\.use$") & four | name.rlike(r"(^|\.)setErrorHandler$"))).alias("handler"),
        F.bool_or(call & (name.isin(*RETRY_CALLS) | (name == "require") & first.isin(*RETRY_PACKAGES)) | (F.col("kind") == "import") & name.isin(*RETRY_PACKAGES)).alias("retry"),
        F.bool_or(call & F.array_contains("marks", "idempotency")).alias("idempotency"),
    )


def chaos_report(facts: DataFrame, files: DataFrame, deps: DataFrame, stack: DataFrame) -> DataFrame:
    """(repo, rules, score, level): what a server application lacks to survive faults; other repos have no rules."""
    own = files.where(~F.col("path").rlike(TEST_OR_EXAMPLE))
    server = stack.groupBy("repo").agg(F.bool_or(F.col("stack").isin(*SERVERS)).alias("server"))
    tools = dependency_signals(deps, retry_package=RETRY_PACKAGES, payment=r"^stripe$|^@stripe/stripe-js$|payment")
    s = together(files, chaos_signals(facts), text_signals(own, tries=r"\btry\s*\{"), server, tools)
    lacks = lambda c: F.col("server") & ~c
    rules = [
        ("no-try", "critical", lacks(F.col("tries"))), ("no-shutdown", "high", lacks(F.col("shutdown"))), ("no-error-handler", "high", lacks(F.col("handler"))), ("no-retry", "medium", lacks(F.col("retry") | F.col("retry_package"))),
        ("no-process-guard", "medium", lacks(F.col("guards"))), ("no-idempotency-key", "medium", lacks(F.col("idempotency")) & F.col("payment")),
    ]
    level = F.when(_count(rules, "critical") > 0, "low").when(_count(rules, "high") > 0, "medium").otherwise("high").alias("level")
    return judged(s, rules, level)


def vision_report(files: DataFrame, deps: DataFrame) -> DataFrame:
    """(repo, rules, score): whether use, errors and releases of the product can be seen and steered."""
    counts = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"))
    s = together(files, dependency_signals(deps, observed=ERROR_TRACKING + TRACING, flags=FEATURE_FLAGS, analytics=ANALYTICS), text_signals(files, versioned=r"[\"'`]/v[0-9]+/"), counts)
    return judged(s, [("no-observability", "high", ~F.col("observed")), ("no-feature-flags", "medium", ~F.col("flags")), ("no-analytics", "high", ~F.col("analytics")), ("no-api-versions", "low", ~F.col("versioned") & (F.col("files") > 10))])


def dora_report(jobs: DataFrame, deps: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, deployment, lead_time, recovery, failure_rate, score, rules): delivery capabilities, each good, partial or weak.

    jobs: config.ci_jobs (repo, deploys, type_checks).
    """
    path = F.col("path")
    places = files.groupBy("repo").agg(F.bool_or(path.rlike(CI_FILE)).alias("ci"), F.bool_or(path.rlike(DEPLOY_FILE)).alias("platform"), F.bool_or(path.rlike(OWNERS_FILE)).alias("owners"), F.bool_or(path.rlike(TEST_OR_EXAMPLE) & ~path.rlike(r"(^|/)(examples?|demos?)/")).alias("test_files"))
    work = jobs.groupBy("repo").agg(F.bool_or("deploys").alias("deploys"), F.bool_or("type_checks").alias("checked"))
    s = together(files, places, work, dependency_signals(deps, observed=ERROR_TRACKING + TRACING + OTHER_OBSERVABILITY, logged=LOGGING, flags=FEATURE_FLAGS + DELIVERY_FLAGS, tools=TEST_TOOLS))
    ci, tested, seen, logged, flags = F.col("ci"), F.col("tools") | F.col("test_files"), F.col("observed"), F.col("logged"), F.col("flags")
    shipped, checked = F.col("platform") | F.col("deploys"), F.col("checked")
    axes = {"deployment": (ci & shipped, ci), "lead_time": (ci & tested & checked, ci), "recovery": (seen & logged, seen | logged), "failure_rate": (tested & flags, tested)}
    levels = [F.when(good, "good").when(some, "partial").otherwise("weak").alias(a) for a, (good, some) in axes.items()]
    scored = {**axes, "lead_time": (ci & tested & checked, tested)}
    points = sum((F.when(good, 25).when(some, 15).otherwise(0) for good, some in scored.values()), F.lit(0))
    lacks = {"no-ci": ~ci, "no-deployment": ci & ~shipped, "no-type-check": ci & ~checked, "no-observability": ~seen, "no-feature-flags": tested & ~flags, "no-owners": ~F.col("owners")}
    names = F.concat_ws(",", *[F.when(c, F.lit(r)) for r, c in lacks.items()])
    return s.select("repo", *levels, F.greatest(F.lit(10), F.least(F.lit(100), points)).alias("score"), names.alias("rules"))


def agentic_report(files: DataFrame, deps: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(repo, rules, score, max_agents, bottleneck): how far an interface carries clients that ask, repeat and retry without pause."""
    tools = dependency_signals(deps, limiter=r"(?i)rate-limit|bottleneck|p-limit|throttle|^(slowapi|fastapi-limiter|asgi-ratelimit|limits)$", orm="prisma|drizzle|sequelize|typeorm|mongoose", cache_package="redis|cache|memcached", cluster="cluster|pm2")
    text = text_signals(
        files, limits=r"rateLimit|rate_limit|maxRequests|windowMs|RATE_LIMIT|SlowAPIMiddleware|@limiter\.limit|Limiter\(", cache_headers="Cache-Control|ETag|max-age|etag", retries="retry|Retry-After|backoff|429",
        pages="page=|offset=|cursor|limit=", auth="auth|jwt|token", auth_limits=r"maxLoginAttempts|loginRateLimit|@limiter\.limit\(|SlowAPIMiddleware",
    )
    size = F.coalesce(*[F.regexp_extract("content", p, 1).try_cast("int") for p in (r"(?i)pool[:\s]*\{[^}]*max[:\s]*([0-9]+)", r"(?i)maxPoolSize[:\s]*([0-9]+)", r"(?i)connectionLimit[:\s]*([0-9]+)")])
    pools = files.withColumn("pool", size).groupBy("repo").agg(F.min_by("pool", F.when(F.col("pool").isNotNull(), F.col("path"))).alias("pool"))
    s = together(files, tools, text, pools, endpoints.groupBy("repo").agg(F.sum("n").alias("endpoints")))
    pool = F.when(F.col("pool") > 0, F.col("pool")).otherwise(10)
    limited, cache = F.col("limiter") | F.col("limits"), F.col("cache_package")
    agents = F.when(cache & F.col("limiter") & (pool > 20), 2000).when(cache, 500).when(limited, 100).otherwise(10) * F.when(F.col("cluster"), 2).otherwise(1)
    bottleneck = F.when(cache & F.col("limiter") & (pool > 20), "network").when(cache, "processor").when(limited, "database pool").otherwise("rate limit")
    return judged(s, [
        ("no-rate-limit", "critical", ~limited), ("small-pool", "high", F.col("orm") & (pool <= 10)), ("no-cache", "high", ~cache & ~F.col("cache_headers")), ("no-retry-after", "medium", ~F.col("retries") & (F.col("endpoints") > 5)),
        ("no-pages", "medium", ~F.col("pages") & (F.col("endpoints") > 3)), ("auth-unlimited", "high", F.col("auth") & ~F.col("auth_limits")),
    ], agents.alias("max_agents"), bottleneck.alias("bottleneck"))
