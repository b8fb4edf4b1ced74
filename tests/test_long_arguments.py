"""Calls whose telling argument stands late."""

from auditlake.operators import detectors as de
from auditlake.operators import facts as fa


def test_late_arguments(spark):
    long = ", ".join(f"field{i}: {i}" for i in range(200))
    code = f"""cors({{ {long}, origin: '*', credentials: true }});
res.json({{ {long}, password: p }});
app.post('/a', {', '.join(f'step{i}' for i in range(100))}, requireAuth, h);
Number({' + '.join(f'a{i}' for i in range(150))} + (isNaN(b) ? 0 : b));
"""
    files = spark.createDataFrame([("r", "a.js", code)], "repo string, path string, content string")
    f = fa.code_facts(files).cache()
    got = sorted((r.line, r.rule, r.severity) for r in de.route_findings(fa.js_calls(f)).collect())
    assert got == [(1, "cors-wildcard", "high"), (2, "sensitive-response", "high")]
    assert de.edge_case_counts(f).where("number_unchecked > 0").count() == 0
