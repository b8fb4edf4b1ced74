"""Streaming forms: the same operators on readStream sources, with watermarks and foreachBatch sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators import findings


def dedupe_events(events: DataFrame, key: str = "id", within: str = "1 day", time: str = "ts") -> DataFrame:
    """Each event id once; on a stream, within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def parse_push_events(raw: DataFrame) -> DataFrame:
    """Push webhooks (event, body JSON) to (repo_url, branch, commit); other events are dropped."""
    shape = "ref string, after string, repository struct<clone_url:string, html_url:string>"
    b = raw.where(F.col("event") == "push").select(F.from_json("body", shape).alias("b"))
    return b.select(F.coalesce("b.repository.clone_url", "b.repository.html_url").alias("repo_url"), F.regexp_replace("b.ref", "^refs/(heads|tags)/", "").alias("branch"), F.substring("b.after", 1, 7).alias("commit"))


def sliding_counts(requests: DataFrame, window: str = "60 seconds", step: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Requests of each caller in sliding windows, for a stream."""
    return requests.withWatermark("ts", late).groupBy("caller", F.window("ts", window, step)).agg(F.count(F.lit(1)).alias("n"))


def findings_stream(files: DataFrame) -> DataFrame:
    """The stateless detectors on a stream of files."""
    return findings.secret_findings(findings.explode_lines(files))


def anchored_windows(requests: DataFrame, most: int = 60, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """rate_limit_fixed for a stream: the state of a caller is (window end, count).

    Windows and their expiry both go by event time: the state goes once the watermark has passed the window's end, so an
    idle or slow stream keeps open windows and a backlog drops closed ones. Rows older than the watermark are dropped;
    one that comes in a later batch and lies before the open window counts 0 and is allowed, as its own window is gone.
    A task holds the numbers and times of one caller's requests of one micro-batch, which the source's limits bound.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ends, n = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        counts = []
        for t in rows["t"]:
            if t > ends:
                ends, n = t + seconds * 1_000_000, 0
            elif t < ends - seconds * 1_000_000:
                counts.append(0)
                continue
            n += 1
            counts.append(n)
        state.update((int(ends), int(n)))
        state.setTimeoutTimestamp(max(int(ends) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": rows["id"].to_numpy(), "caller": key[0], "count": counts, "allowed": [c <= most for c in counts]})

    narrow = requests.withWatermark("ts", late).select("id", "caller", "ts", F.unix_micros("ts").alias("t"))
    return narrow.groupBy("caller").applyInPandasWithState(run, "id long, caller long, count long, allowed boolean", "ends long, n long", "append", "EventTimeTimeout")


def sliding_limits(requests: DataFrame, most: int = 60, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """rate_limit_sliding for a stream, row for row: (id, caller, in_window, allowed, remaining).

    A caller's requests wait in its state until the watermark has passed them, so that those which come late, but not
    later than `late`, are counted where they belong; then they are judged in order against the times of the trailing
    window, and times that fell out of it go. The state holds a caller's requests of the last window and lateness. Rows
    later than that are dropped by the watermark; what waits when a stream is stopped comes out once it goes on.
    """
    size = seconds * 1_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times, waiting, ids = state.get if state.exists else ([], [], [])
        came = [] if state.hasTimedOut else [(int(t), int(i)) for rows in batches for t, i in zip(rows["t"], rows["id"])]
        queue = sorted([*zip(map(int, waiting), map(int, ids)), *came])
        passed = state.getCurrentWatermarkMs() * 1000
        due = [q for q in queue if q[0] < passed]
        queue, seen, counts = queue[len(due) :], list(map(int, times)), []
        # requests at one time count each other, as the batch form's range does
        every = sorted([*seen, *(t for t, _ in due)])
        low = high = 0
        for t, _ in due:
            while high < len(every) and every[high] <= t:
                high += 1
            while every[low] <= t - size:
                low += 1
            counts.append(high - low)
        keep = [t for t in every if t > passed - size]
        if queue or keep:
            state.update((keep, [t for t, _ in queue], [i for _, i in queue]))
            ends = queue[0][0] if queue else keep[-1] + size
            state.setTimeoutTimestamp(max(ends // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if due:
            yield pd.DataFrame({"id": [i for _, i in due], "caller": key[0], "in_window": counts, "allowed": [n <= most for n in counts], "remaining": [max(most - n, 0) for n in counts]})

    narrow = requests.withWatermark("ts", late).select("id", "caller", "ts", F.unix_micros("ts").alias("t"))
    kinds = "id long, caller long, in_window long, allowed boolean, remaining long"
    return narrow.groupBy("caller").applyInPandasWithState(run, kinds, "times array<long>, waiting array<long>, ids array<long>", "append", "EventTimeTimeout")
