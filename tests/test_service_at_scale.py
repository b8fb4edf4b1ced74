"""Service operators whose work must not grow with the product of two tables, nor pass a table of days through a shuffle."""

import re

from auditlake.operators import service as se

EVENTS = "id long, ts long, kind string, user_id long, customer string, plan string"


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_events_of_one_customer_do_not_meet_each_span(spark):
    n = 400  # users who all start with one customer; the even ones move on at times that lie between its events
    users = [(i, None, "c") for i in range(n)]
    events = [(k, 10 * k, "deleted" if k % 7 == 0 else "updated", None, "c", "team" if k % 2 else None) for k in range(300)]
    events += [(1000 + i, 10 * i + 5, "updated", i, "d", "enterprise") for i in range(0, n, 2)]
    of_c = ["free" if k % 7 == 0 else "team" if k % 2 else "pro" for k in range(300)]
    want = {(i, "enterprise", "d", 1 + min(i + 1, 300)) if i % 2 == 0 else (i, of_c[-1], "c", 300) for i in range(n)}
    found = se.plan_of_users(spark.createDataFrame(events, EVENTS), spark.createDataFrame(users, "id long, plan string, customer string"))
    assert not re.search(r"Join \[customer#\d+L?\]", plan(found))
    assert {tuple(r) for r in found.collect()} == want


def test_points_before_between_and_after_events(spark):
    events = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y"), ("b", 1, "z")], "customer string, when long, plan string")
    points = [("a", False, 5, 1), ("a", False, 6, 2), ("a", False, 7, 3), ("a", True, None, 4), ("b", False, 0, 5), ("b", True, None, 6), ("c", True, None, 7)]
    got = se._before(spark.createDataFrame(points, "customer string, open boolean, when long, user_id long"), events).collect()
    assert {(r.user_id, r.n, r.latest and r.latest.plan) for r in got} == {(1, 0, None), (2, 1, "x"), (3, 1, "x"), (4, 2, "y"), (5, 0, None), (6, 1, "z"), (7, 0, None)}


def test_days_without_a_run_are_not_shuffled(spark):
    rows = [(1, "2024-02-27 23:00:00", 2), (1, "2024-03-01 01:00:00", None), (1, "2024-03-01 02:00:00", 3), (2, "2024-01-01 00:00:00", None), (2, None, 9), (None, "2024-05-01 00:00:00", 4), (None, "2024-05-02 00:00:00", 4), (3, None, 1)]
    runs = spark.createDataFrame(rows, "user_id long, at string, total_findings long").selectExpr("user_id", "cast(at as timestamp) as started_at", "total_findings")
    found = se.usage_by_day(runs)
    assert "Join" not in plan(found)
    assert sorted(tuple(r) for r in found.where("user_id is not null").collect()) == [(1, "2024-02-27", 1, 2), (1, "2024-02-28", 0, 0), (1, "2024-02-29", 0, 0), (1, "2024-03-01", 2, 3), (2, "2024-01-01", 1, 0)]
    assert sorted(tuple(r)[1:] for r in found.where("user_id is null").collect()) == [("2024-05-01", 0, 0), ("2024-05-02", 0, 0)]
