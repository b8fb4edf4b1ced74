"""Long and unclosed tables, and more than a thousand rules."""

from auditlake.operators import detectors as de
from auditlake.operators import joins as jo


def test_long_unclosed_and_nested_tables(spark):
    cell = "<tr><td>1</td></tr>" * 4000
    texts = {
        "long": f"<table>{cell}</TABLE>", "long-head": f"<table>{cell}<th>x</th></table>", "open": f"<TABLE>{cell}", "nested": "<table><table><td></table></table>",
        "inner-head": "<table><td><table><th>x</table></table>", "head-first": "<th><table></table>", "none": "<tablet>",
    }
    files = spark.createDataFrame([("r", p, c) for p, c in texts.items()], "repo string, path string, content string")
    assert {r.path: r.n for r in de.table_header_findings(files).collect()} == {"long": 1, "open": 1, "nested": 2, "head-first": 1}


def test_all_rules_are_used(spark):
    rules = [(f"r{i}", [f"f{i}", f"f{i}", None], None, None, "low") for i in range(1500)] + [("p", None, "^f14[0-9]{2}$", "x", "high"), ("both", ["f1"], "^f1$", None, "high")]
    calls = spark.createDataFrame([("r", "a", i, f"f{i}", "x" if i % 2 else "y") for i in range(1500)], "repo string, path string, line int, callee string, args_text string")
    table = spark.createDataFrame(rules, "rule string, callees array<string>, callee_regex string, arg_regex string, severity string")
    got = sorted((r.line, r.rule) for r in jo.rule_findings(calls, table).collect())
    assert got == sorted([(i, f"r{i}") for i in range(1500)] + [(i, "p") for i in range(1401, 1500, 2)] + [(1, "both")])
