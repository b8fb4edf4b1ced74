"""Risks are added in one order, whatever the order and the partitions in which they come."""

import math

from auditlake.operators import findings as fi


def test_predicted_failures_do_not_depend_on_the_order(spark):
    want, rows = {}, []
    for repo in range(60):
        risks = [round(0.1 * ((k * 37 + repo * 11) % 400 + 1), 1) for k in range(40)]
        risks.append(round(5 - math.fsum(risks) % 5, 1) or 5.0)  # the sum of the decimals is a multiple of 5
        total = 0.0
        for x in sorted(risks, reverse=True):
            total += x
        want[f"r{repo}"] = math.floor(total / 5)
        rows += [(f"r{repo}", f"f{k}", x) for k, x in enumerate(sorted(risks))]
    assert any(want[f"r{i}"] != math.floor(sum(x for r, _, x in rows if r == f"r{i}") / 5) for i in range(60))  # added the other way round
    for parts in (1, 7):
        got = fi.risk_hotspots(spark.createDataFrame(rows, "repo string, path string, risk double").repartition(parts).sortWithinPartitions("risk")).collect()
        assert {r.repo: r.predicted for r in got} == want and len(got) == 60 * 5
