"""Run history, quota, plans, upserts, digests and proposals: relational work on the service tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import scores as S
from auditlake.sources.store import sorted_side, stored

# Tests, repositories and iterations that a plan includes a month; None is without limit. Old names of plans.
PLANS = {"free": (5, 1, 0), "pro": (100, 10, 20), "team": (500, 50, 200), "enterprise": (None, None, None)}
ALIASES = {"premium": "team", "forge": "team"}
PERSONAL_KEY_CAP = 50
STAGE_STATES = ["passed", "failed", "warning", "pending"]  # fixed values


def run_history(runs: DataFrame, n: int = 20, status: str | None = None, projects: DataFrame | None = None, search: str | None = None) -> DataFrame:
    """The latest n runs of every user; runs that haven't ended come last.

    projects (id, name) adds project_name, null for runs without a known project; search keeps the runs of projects
    whose name holds it, in any case, before the n are taken.
    """
    kept = runs.where(F.col("status") == status) if status else runs
    if projects is not None:
        kept = kept.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id", "left")
        kept = kept.where(F.contains(F.lower("project_name"), F.lit(search.lower()))) if search else kept
    w = Window.partitionBy("user_id").orderBy(F.col("completed_at").desc_nulls_last(), F.col("id").desc())
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def usage_stats(runs: DataFrame, as_of: Column) -> DataFrame:
    """Per user: all runs, runs ended in the last 30 days, rounded mean score (0 when there is none), findings."""
    recent = F.col("completed_at").isNotNull() & (F.col("completed_at") >= as_of - F.expr("interval 30 days")) & (F.col("completed_at") <= as_of)
    return runs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(recent).alias("n_recent"),
        S.round_half_up(F.coalesce(F.avg("score"), F.lit(0.0))).alias("mean_score"), F.sum("total_findings").alias("n_findings"),
    )


def plan_limits(spark) -> DataFrame:
    return spark.createDataFrame([(p, *v) for p, v in PLANS.items()], "plan string, max_tests int, max_repos int, max_iterations int")


def quota(users: DataFrame, runs: DataFrame, iterations: DataFrame, as_of: Column) -> DataFrame:
    """Used and remaining tests, repositories and iterations since the month began (UTC); null: without limit.

    Old plan names count as the plan they became, unknown and missing ones as free. Each side is aggregated before it
    is joined. iterations: (user_id, created_at).
    """
    month = F.date_trunc("month", as_of)
    used = runs.where((F.col("started_at") >= month) & (F.col("started_at") <= as_of)).groupBy("user_id").agg(F.count(F.lit(1)).alias("tests"), F.count_distinct("project_id").alias("repos"))
    tried = iterations.where((F.col("created_at") >= month) & (F.col("created_at") <= as_of)).groupBy("user_id").agg(F.count(F.lit(1)).alias("iterations"))
    plans = F.broadcast(plan_limits(users.sparkSession))  # four rows
    named = F.lower("plan")
    for old, new in ALIASES.items():
        named = F.when(named == old, new).otherwise(named)
    both = users.withColumn("plan", F.when(named.isin(*PLANS), named).otherwise("free")).join(plans, "plan")
    both = both.join(used, both["id"] == used["user_id"], "left").drop("user_id").join(tried, F.col("id") == tried["user_id"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    left = lambda most, c: F.when(F.col(most).isNotNull(), F.greatest(F.col(most) - count(c), F.lit(0))).cast("long").alias(f"{c}_left")
    names = {"tests": "max_tests", "repos": "max_repos", "iterations": "max_iterations"}
    return both.select("id", "plan", *[count(c).alias(c) for c in names], *[left(most, c) for c, most in names.items()])


def quota_denials(quotas: DataFrame) -> DataFrame:
    """(id, plan, gate) of every gate that is shut: tests, iterations, and iterations with a key of one's own, of which any plan has PERSONAL_KEY_CAP at least."""
    most = F.col("iterations") + F.col("iterations_left")
    spent = F.col("iterations_left").isNotNull() & (F.col("iterations") >= F.greatest(F.lit(PERSONAL_KEY_CAP), most))
    gates = F.array(F.when(F.col("tests_left") == 0, "tests"), F.when(F.col("iterations_left") == 0, "iterations"), F.when(spent, "personal-key"))
    return quotas.select("id", "plan", F.explode(F.array_compact(gates)).alias("gate"))


def latest_score(runs: DataFrame) -> DataFrame:
    """Newest score of each project with its letter; runs that haven't ended count as newest, as nulls come first."""
    w = Window.partitionBy("project_id").orderBy(F.col("completed_at").desc_nulls_first(), F.col("id").desc())
    letter = F.when(F.col("score") >= 80, "A").when(F.col("score") >= 60, "B").when(F.col("score") >= 40, "C").when(F.col("score").isNotNull(), "D")
    color = F.when(F.col("score") >= 80, "green").when(F.col("score") >= 50, "yellow").when(F.col("score").isNotNull(), "red").otherwise("grey")
    return runs.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("project_id", "id", "score", letter.alias("letter"), color.alias("color"))


def stage_summary(findings: DataFrame) -> DataFrame:
    """Per repo and dimension as a stage: passed without open findings of weight, percent passed per repo."""
    stages = findings.groupBy("repo", "dimension").agg(F.count_if((F.col("status") == "open") & F.col("severity").isin("critical", "high")).alias("bad"))
    return stages.groupBy("repo").agg(F.count(F.lit(1)).alias("stages"), F.count_if(F.col("bad") == 0).alias("passed"), S.round_half_up(F.lit(100.0) * F.count_if(F.col("bad") == 0) / F.count(F.lit(1))).alias("percent"))


def stage_status(results: DataFrame, *by: str) -> DataFrame:
    """Stages by status for each key (a run, a dimension): results hold a stage's status and duration_ms.

    percent is the share of passed stages; a stage without one of these counts in the total alone, one without a duration
    adds nothing to it.
    """
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STAGE_STATES]
    g = results.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts, F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("long").alias("duration_ms"))
    return g.withColumn("percent", F.lit(100.0) * F.col("passed") / F.col("total"))


def run_duration(runs: DataFrame) -> DataFrame:
    seconds = F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")
    text = F.when(seconds >= 60, F.concat((seconds / 60).cast("int").cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s"))).otherwise(F.concat(seconds.cast("string"), F.lit("s")))
    return runs.select("id", F.when(F.col("completed_at").isNotNull(), text).alias("duration"))


def usage_by_day(runs: DataFrame) -> DataFrame:
    """Runs and findings of every user for each UTC day from the user's first run to the last; days without a run count 0.

    Each day with a run gives itself and the days up to the next one, so that only days with a run are shuffled. Runs
    without a user count for nobody, their days are listed with 0.
    """
    counts = runs.groupBy("user_id", F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("total_findings").alias("found"))
    following = F.lead("day").over(Window.partitionBy("user_id").orderBy("day"))
    gaps = counts.where("day is not null").withColumn("until", F.coalesce(F.date_sub(following, 1), "day"))
    days = gaps.select("user_id", F.explode(F.sequence("day", "until")).alias("on"), "day", "n", "found")
    own = (F.col("on") == F.col("day")) & F.col("user_id").isNotNull()
    of_day = lambda c: F.when(own, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    return days.select("user_id", F.date_format("on", "yyyy-MM-dd").alias("day"), of_day("n"), of_day("found"))


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins: the newest row of each key out of both tables."""
    both = current.unionByName(changes)
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), order).alias("r")).select(key, "r.*")


def insert_new(current: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """current and those first incoming rows whose key it doesn't have."""
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*[c for c in incoming.columns if c != key]), order).alias("r")).select(key, "r.*")
    return current.unionByName(first.join(current.select(key), key, "left_anti"))


def plan_from_billing(events: DataFrame) -> DataFrame:
    """Plan of each customer after its events in order: created and updated set one (pro by default), deleted frees."""
    once = events.dropDuplicates(["id"]).where(F.col("kind") != "other")
    plan = F.when(F.col("kind") == "deleted", "free").otherwise(F.coalesce("plan", F.lit("pro")))
    return once.groupBy("customer").agg(F.max_by(plan, F.struct("ts", "id")).alias("plan"), F.count(F.lit(1)).alias("n_events"))


def _before(points: DataFrame, events: DataFrame) -> DataFrame:
    """points (customer, open, when, ...) with n, how many events (customer, when, plan) of the customer come before, and latest, the last of them (when, plan).

    An open point comes after all events. Points and events are dealt into ranges of customer and time; each range counts
    by itself and adds what its customer's ranges before it hold, so that a customer of many events is no single task's.
    """
    own = [c for c in points.columns if c not in ("customer", "open", "when")]
    event = events.select("customer", F.lit(False).alias("open"), "when", F.lit(1).cast("long").alias("is_event"), "plan")
    every = event.unionByName(points.withColumn("is_event", F.lit(0).cast("long")), allowMissingColumns=True)
    ranges = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(every.repartitionByRange(ranges, "customer", "open", "when", "is_event", "user_id").withColumn("range", F.spark_partition_id()))
    seen = F.when(F.col("is_event") == 1, F.struct("when", "plan"))
    sums = dealt.groupBy("customer", "range").agg(F.sum("is_event").alias("n"), F.max(seen).alias("last"))
    earlier = Window.partitionBy("customer").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("customer", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_then"), F.last("last", ignorenulls=True).over(earlier).alias("last_then"))
    so_far = Window.partitionBy("customer", "range").orderBy("open", "when", "is_event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumn("n_here", F.sum("is_event").over(so_far)).withColumn("last_here", F.last(seen, ignorenulls=True).over(so_far)).where("is_event = 0")
    both = local.join(sorted_side(sums), ["customer", "range"])
    return both.select("customer", "open", "when", *own, (F.col("n_here") + F.col("n_then")).alias("n"), F.coalesce("last_here", "last_then").alias("latest"))


def plan_of_users(events: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, plan, customer, n_events) after replaying billing events (id, ts, kind, user_id, customer, plan) in order.

    created and updated with a user set that user's plan (pro by default) and customer (the old one if null); without a
    user they set the plan of whoever had that customer then, and deleted frees those. Who had a customer when: the
    spans between a user's links, from the users table's own customer on. A span holds its customer's events between its
    ends: as many as stand before its end less those before its start, and the last before its end is the one that counts
    (see _before()), so that no event meets each span. Repeated ids count once; other kinds don't. users: (id, plan,
    customer), the plan and customer they start with; events of unknown users are ignored.
    """
    once = events.where(F.col("kind").isin("created", "updated", "deleted")).groupBy("id").agg(F.min(F.struct("ts", "kind", "user_id", "customer", "plan")).alias("e")).select("id", "e.*")
    order, plan = F.struct("ts", "id"), F.when(F.col("kind") == "deleted", "free").otherwise(F.coalesce("plan", F.lit("pro")))
    once = stored(once.withColumn("at", order).withColumn("plan", plan).drop("ts", "id"))
    direct = once.where("user_id is not null and kind <> 'deleted'")
    never = F.lit(None).cast(once.schema["at"].dataType)
    links = users.where("customer is not null").select(F.col("id").alias("user_id"), "customer", never.alias("at")).unionByName(direct.where("customer is not null").select("user_id", "customer", "at"))
    spans = stored(links.withColumn("until", F.lead("at").over(Window.partitionBy("user_id").orderBy(F.asc_nulls_first("at")))))
    others = once.where("customer is not null and (user_id is null or kind = 'deleted')").select("customer", F.col("at").alias("when"), F.col("plan"))
    starts = spans.where("at is not null").select("customer", F.lit(False).alias("open"), F.col("at").alias("when"), "user_id", F.lit(-1).alias("sign"), never.alias("since"))
    ends = spans.select("customer", F.col("until").isNull().alias("open"), F.col("until").alias("when"), "user_id", F.lit(1).alias("sign"), F.col("at").alias("since"))
    met = _before(starts.unionByName(ends), others)
    counts = (F.col("sign") == 1) & (F.col("since").isNull() | (F.col("latest.when") >= F.col("since")))
    held = met.select("user_id", F.when(counts, F.col("latest.when")).alias("at"), F.col("latest.plan").alias("plan"), (F.col("sign") * F.col("n")).alias("n"))
    each = direct.select("user_id", "at", "plan", F.lit(1).cast("long").alias("n")).unionByName(held)
    applied = each.groupBy("user_id").agg(F.max_by("plan", "at").alias("now"), F.sum("n").alias("n_events"))
    last = spans.where("until is null").select("user_id", F.col("customer").alias("linked"))
    known = users.select(F.col("id").alias("user_id"), F.coalesce("plan", F.lit("free")).alias("had"))
    out = known.join(sorted_side(applied), "user_id", "left").join(sorted_side(last), "user_id", "left")
    return out.select("user_id", F.coalesce("now", "had").alias("plan"), F.col("linked").alias("customer"), F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"))


def key_usage(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests (presented, ts) by known, unrevoked key (key_hash, owner, revoked): the presented key is hashed and joined; unknown and revoked keys drop out."""
    used = requests.where("presented is not null").groupBy(F.sha2("presented", 256).alias("key_hash")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_used"))
    return used.join(keys.where("not revoked"), "key_hash").select("owner", "n", F.unix_timestamp("last_used").alias("last_used"))


def active_subscribers(events: DataFrame, opt_in: str = "subscribe", opt_out: str = "unsubscribe", limit: int = 50000) -> DataFrame:
    """(who, since) of those whose last word (who, kind, ts, id) isn't opt_out, oldest first."""
    last = events.where(F.col("kind").isin(opt_in, opt_out)).groupBy("who").agg(F.max_by("kind", F.struct("ts", "id")).alias("kind"), F.min("ts").alias("since"))
    return last.where(F.col("kind") == opt_in).select("who", F.unix_timestamp("since").alias("since")).orderBy("since", "who").limit(limit)


def open_proposals(ledger: DataFrame) -> DataFrame:
    """Titles whose latest entry is open."""
    return ledger.groupBy("title").agg(F.max_by("state", F.struct("entry_date", "pos")).alias("state"), F.count(F.lit(1)).alias("n")).where("state = 'open'")


def new_proposals(candidates: DataFrame, ledger: DataFrame, n: int = 3) -> DataFrame:
    """At most n candidates that are neither open nor rejected in the ledger, by weight."""
    state = ledger.groupBy("title").agg(F.max_by("state", F.struct("entry_date", "pos")).alias("state"))
    return candidates.join(state.where(F.col("state").isin("open", "rejected")), "title", "left_anti").orderBy(F.col("weight").desc(), "title").limit(n)


def tasks_by_stage(tasks: DataFrame) -> DataFrame:
    """(stage, position, id): each stage's tasks in order of priority (as text), then age, then id.

    The position is that of the task's group of equal stage, priority and day, from counts, and its rank in the group,
    so that no task reads a stage.
    """
    group = ["stage", "priority", "day"]
    t = tasks.withColumn("day", F.to_date("created"))
    counts = t.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("stage").orderBy("priority", "day").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("created", "id"))
    starts = starts.select(*[F.col(c).alias(f"of_{c}") for c in group], "start")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in group]
    return t.withColumn("rank", rank).join(starts, same).select("stage", (F.col("start") + F.col("rank")).alias("position"), "id")


def top_reports(reports: DataFrame, n: int = 20) -> DataFrame:
    """The n newest stored reports (id, created_at, score, ...), newest first."""
    return reports.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def top_generations(generations: DataFrame, n: int = 20) -> DataFrame:
    """The n newest generation runs with how many of their tests passed; generations: one row a test (run_id, created_at, passed)."""
    runs = generations.groupBy("run_id").agg(F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("tests"), F.count_if("passed").alias("passed"))
    return runs.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(n)


def report_detail(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings of each run with the run's columns, in order of severity, then sequence."""
    ranked = findings.withColumn("severity_rank", S.severity_rank(F.col("severity")))
    return ranked.join(runs.select(F.col("id").alias("run_id"), "user_id", "project_id", F.col("status").alias("run_status")), "run_id", "left").select("run_id", "user_id", "project_id", "run_status", "severity", "severity_rank", "seq")


def report_lookup(wanted: DataFrame, reports: DataFrame, runs: DataFrame, projects: DataFrame) -> DataFrame:
    """(key, user_id, id, run_id, title, branch, score, project_name, repo_url) for each (key, user_id) that asks and may see.

    The key is a report's id or its run's; of several reports the one of that id comes first, then the newest, then the
    smallest id. A report whose run belongs to another user isn't shown; one of a run without a user, or of no known
    run, is. Keys without a report give no row. Each side is joined by its own key, so that no condition is an OR.
    """
    asked = wanted.select("key", "user_id").distinct()
    report = F.struct("id", "run_id", "title")
    one = reports.where("id is not null").groupBy(F.col("id").alias("key")).agg(F.min(report).alias("own"))
    newest = F.struct(F.col("created_at").isNull(), -F.unix_micros(F.col("created_at").cast("timestamp")), "id")
    of_key = reports.where("run_id is not null").groupBy(F.col("run_id").alias("key")).agg(F.min_by(report, newest).alias("newest"))
    best = asked.join(one, "key", "left").join(of_key, "key", "left").withColumn("r", F.coalesce("own", "newest")).where("r is not null").select("key", "user_id", "r.*")
    of_run = runs.select(F.col("id").alias("run_id"), F.col("user_id").alias("owner"), "project_id", "branch", "score")
    of_project = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), "repo_url")
    seen = best.join(of_run, "run_id", "left").where("owner is null or owner = user_id").join(of_project, "project_id", "left")
    return seen.select("key", "user_id", "id", "run_id", "title", "branch", "score", "project_name", "repo_url")
