"""Load-test and request logs: levels, breaking points, recovery, rate limits, error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.sources.store import stored


RANGES = 4096


def load_levels(requests: DataFrame, by: str = "concurrency") -> DataFrame:
    """Attempts, exact percentiles of latency (interpolated) and error rate of each level.

    A distributed selection: a level's latencies are counted in RANGES equal ranges first, running sums over these few
    counts tell which ranges hold the wanted ranks, and only the values of those are ranked, each range for itself. No
    task holds a level. A level without latencies has null percentiles.
    """
    totals = requests.groupBy(by).agg(
        F.count(F.lit(1)).alias("attempts"), F.least(F.lit(1.0), F.count_if(F.col("status") >= 300) / F.count(F.lit(1))).alias("error_rate"), F.count("latency").alias("timed"),
        F.min("latency").alias("least"), F.max("latency").alias("most"),
    )
    share = (F.col("latency") - F.col("least")) / F.nullif(F.col("most") - F.col("least"), F.lit(0.0))
    ranged = requests.where("latency is not null").select(by, "latency").join(totals.select(by, "least", "most"), by)
    values = ranged.withColumn("range", F.coalesce(F.floor(share * RANGES), F.lit(0))).groupBy(by, "range", "latency").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = values.groupBy(by, "range").agg(F.sum("n").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    at = lambda p: (F.col("timed") - 1) * F.lit(p)
    wanted = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    ranks = F.array(*[F.struct(F.lit(f"{name}_{side}").alias("pick"), f(at(p)).cast("long").alias("rank")) for name, p in wanted.items() for side, f in (("low", F.floor), ("high", F.ceil))])
    asked = totals.where("timed > 0").select(by, F.explode(ranks).alias("r")).select(by, "r.*")
    held = asked.join(sums, by).where("rank >= before and rank < before + held")  # a row for each rank
    near = values.join(held.select(by, "range", "before").distinct(), [by, "range"])
    upto = Window.partitionBy(by, "range").orderBy("latency").rowsBetween(Window.unboundedPreceding, 0)
    placed = near.withColumn("last", F.col("before") + F.sum("n").over(upto))
    found = placed.join(held.select(by, "range", "pick", "rank"), [by, "range"]).where("rank < last and rank >= last - n")
    picks = found.groupBy(by).agg(*[F.max(F.when(F.col("pick") == f"{name}_{side}", F.col("latency"))).alias(f"{name}_{side}") for name in wanted for side in ("low", "high")])
    made = []
    for name, p in wanted.items():
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        made.append((low + (high - low) * (at(p) - F.floor(at(p)))).alias(name))
    return totals.join(picks, by, "left").select(by, "attempts", *made, "error_rate")


def breaking_point(levels: DataFrame, threshold: float = 0.05) -> DataFrame:
    """The first level above the threshold, and the last level that counts: that one, or the last of all."""
    first = levels.agg(F.min(F.when(F.col("error_rate") > threshold, F.col("concurrency"))).alias("breaks_at"), F.max("concurrency").alias("highest"))
    return first.select("breaks_at", F.coalesce("breaks_at", "highest").alias("headline"))


def max_healthy(levels: DataFrame, threshold: float = 0.05) -> DataFrame:
    return levels.agg(F.max(F.when(F.col("error_rate") <= threshold, F.col("concurrency"))).alias("healthy"), F.min(F.when(F.col("error_rate") > threshold, F.col("concurrency"))).alias("degraded"))


def phase_error_rates(requests: DataFrame, phases: DataFrame, bucket: int = 600) -> DataFrame:
    """(phase_id, before, during): error rates of the requests before each fault, from baseline to start, and during it, from start to end.

    phases: (phase_id, baseline, start, end). A range join by buckets of `bucket` seconds, whose counts are made first
    where a bucket lies wholly in one part; requests of the buckets at the edges are compared by time. A phase without
    requests in a part has a null rate there.
    """
    parts = F.array(F.struct(F.lit("before").alias("part"), F.col("baseline").alias("a"), F.col("start").alias("b")), F.struct(F.lit("during").alias("part"), F.col("start").alias("a"), F.col("end").alias("b")))
    spans = phases.select("phase_id", F.explode(parts).alias("p")).select("phase_id", "p.*")
    index = lambda c: F.floor(F.unix_micros(c) / (bucket * 1_000_000))
    slots = spans.where("a < b").withColumn("slot", F.explode(F.sequence(index("a"), index("b"))))
    edge = (F.col("slot") == index("a")) | (F.col("slot") == index("b"))
    logged = requests.select("ts", (F.col("status") >= 500).alias("bad"), index("ts").alias("slot"))
    counts = logged.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"))
    whole = slots.where(~edge).join(counts, "slot").select("phase_id", "part", "n", "bad")
    near = slots.where(edge).join(logged, "slot").where("ts >= a and ts < b").select("phase_id", "part", F.lit(1).cast("long").alias("n"), F.col("bad").cast("long").alias("bad"))
    rates = whole.union(near).groupBy("phase_id").agg(*[(F.sum(F.when(F.col("part") == p, F.col("bad"))) / F.sum(F.when(F.col("part") == p, F.col("n")))).alias(p) for p in ("before", "during")])
    return phases.select("phase_id").join(rates, "phase_id", "left")


def recovery_time(checks: DataFrame, faults: DataFrame, baseline: float, margin: float = 0.15, bucket: int = 3600) -> DataFrame:
    """Seconds from each fault's clearing to the first check within baseline + margin; null when there is none.

    faults (fault_id, cleared, until): the checks looked at are those from cleared to until. A range join by buckets of
    `bucket` seconds, so that neither side is broadcast or compared with all of the other.
    """
    index = lambda c: F.floor(F.unix_micros(c) / (bucket * 1_000_000))
    good = checks.where(F.col("rate") <= baseline + margin).select("ts", index("ts").alias("slot"))
    slots = faults.where("cleared < until").withColumn("slot", F.explode(F.sequence(index("cleared"), index("until"))))
    met = slots.join(good, "slot").where("ts >= cleared and ts < until")
    first = met.groupBy("fault_id").agg(F.min("ts").alias("back"))
    return faults.join(first, "fault_id", "left").select("fault_id", (F.unix_timestamp("back") - F.unix_timestamp("cleared")).alias("seconds"))


def rate_limit_sliding(requests: DataFrame, most: int = 60, seconds: int = 60) -> DataFrame:
    """Whether each request is allowed: the requests of its caller in the trailing window, itself included, are at most `most`."""
    micros = F.unix_micros("ts")
    w = Window.partitionBy("caller").orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    n = F.count(F.lit(1)).over(w)
    return requests.select("id", "caller", n.alias("in_window"), (n <= most).alias("allowed"), F.greatest(F.lit(most) - n, F.lit(0)).alias("remaining"))


def window_openers(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """(caller, t): the times (microseconds) at which a caller's windows open: its first request, and each first one after a window.

    By pointer doubling: every time points to the first one after the window that it would open, found in the next
    bucket of a window's length or, if that holds none, in the one after it; the first time then reaches twice as many
    openers a round. A round is two joins; a caller's times are split over tasks by bucket and by time.
    """
    size = seconds * 1_000_000
    times = stored(requests.groupBy("caller", F.unix_micros("ts").alias("t")).agg(F.count(F.lit(1)).alias("n")).select("caller", "t", F.floor(F.col("t") / size).alias("slot")))
    in_turn = Window.partitionBy("caller").orderBy("slot")  # over a caller's buckets, not its requests
    slots = times.groupBy("caller", "slot").agg(F.min("t").alias("first"))
    ahead = slots.select("caller", "slot", F.lead("slot").over(in_turn).alias("next_slot"), F.lead("first").over(in_turn).alias("next_first"), F.lead("first", 2).over(in_turn).alias("then_first"))
    ends = times.select("caller", (F.col("slot") + 1).alias("slot"), (F.col("t") + size).alias("at"), F.lit(0).alias("kind"), F.col("t").alias("of"))
    marks = times.select("caller", "slot", F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("of"))
    back = Window.partitionBy("caller", "slot").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    later = ends.unionByName(marks).withColumn("next", F.last(F.when(F.col("kind") == 1, F.col("at")), True).over(back)).where("kind = 0")
    after = F.coalesce("next", F.when(F.col("next_slot") == F.col("slot"), F.col("then_first")).otherwise(F.col("next_first")))
    jump = later.select("caller", "slot", "next", "of").join(ahead.withColumn("slot", F.col("slot") + 1), ["caller", "slot"]).select("caller", F.col("of").alias("t"), after.alias("to"))
    jump = stored(jump.where("to is not null"))
    reached = stored(times.groupBy("caller").agg(F.min("t").alias("t")))
    while True:
        new = stored(reached.join(jump, ["caller", "t"]).select("caller", F.col("to").alias("t")))
        if new.isEmpty():
            return reached
        reached = stored(reached.union(new))
        jump = stored(jump.join(jump.select("caller", F.col("t").alias("to"), F.col("to").alias("further")), ["caller", "to"]).select("caller", "t", F.col("further").alias("to")))


def rate_limit_fixed(requests: DataFrame, most: int = 60, seconds: int = 60) -> DataFrame:
    """Windows open at a caller's first request after the last window has closed. (id, caller, count, allowed).

    A window is as long as a bucket of time, so each bucket holds one opener at most: a request belongs to the one of
    its own bucket, if that isn't later, or of the bucket before. Requests without a time or caller are left out.
    """
    size = seconds * 1_000_000
    timed = requests.where("caller is not null and ts is not null").select("id", "caller", "ts", F.unix_micros("ts").alias("t")).withColumn("slot", F.floor(F.col("t") / size))
    openers = window_openers(timed, seconds).withColumn("slot", F.floor(F.col("t") / size))
    own = openers.select("caller", "slot", F.col("t").alias("own"))
    before = openers.select("caller", (F.col("slot") + 1).alias("slot"), F.col("t").alias("before"))
    of = timed.join(own, ["caller", "slot"], "left").join(before, ["caller", "slot"], "left").withColumn("opener", F.when(F.col("own") <= F.col("t"), F.col("own")).otherwise(F.col("before")))
    n = F.row_number().over(Window.partitionBy("caller", "opener").orderBy("t", "id")).cast("long")
    return of.select("id", "caller", n.alias("count")).withColumn("allowed", F.col("count") <= most)


def error_rate_windows(requests: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows of request counts and error rates; on a stream, late rows are bounded by the watermark."""
    source = requests.withWatermark("ts", late) if requests.isStreaming else requests
    g = source.groupBy(F.window("ts", size)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 500).alias("bad"))
    return g.select(F.unix_timestamp("window.start").alias("start"), "n", (F.col("bad") / F.col("n")).alias("rate"))


def latest_state(progress: DataFrame, key: str, order: str, done: str = "completed") -> DataFrame:
    """Newest status of each key and how many entries have reached `done`; the same on a stream in update mode."""
    return progress.groupBy(key).agg(F.max_by("status", order).alias("status"), F.count_if(F.col("status") == done).alias("completed"))
