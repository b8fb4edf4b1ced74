"""Facts and detectors on literal code."""

import pytest

from auditlake.operators import detectors as de
from auditlake.operators import facts as fa

JS = """import a, {b as c} from "./x";
const q = require('pg');
export function top(p) { if (p && p.x) { return 1 } for (const i of p) { db.query("a" + i) } return p?.y }
app.post('/u', async (req, res) => { const id = req.query.id; const n = parseInt(id, 10); try { JSON.parse(id) } catch (e) {} await db.query(`select ${id}`); db.query("s ?", [id]); eval(id);
await Promise.all(xs.map(x => db.find(x))); res.redirect(id); });
it('works', () => { expect(1).not.toBe(2) });
test.only("e", () => {});
if (a == b) { } if (a == null) {}
switch (x) { case 1: break; }
parseInt("5"); new Date("x"); // eval(req.query.x)
"""


@pytest.fixture(scope="module")
def facts(spark):
    def make(*rows):
        return fa.code_facts(spark.createDataFrame([("r", p, c) for p, c in rows], "repo string, path string, content string"))

    return make


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_js(facts):
    f = facts(("a.js", JS), ("empty.js", ""), ("null.js", None), ("broken.ts", "((({{{ ]]] 'x"), ("b.txt", JS)).cache()
    assert rows(fa.js_imports(f), "specifier", "form") == [("./x", "esm"), ("pg", "cjs")]
    assert rows(fa.js_exports(f), "name") == [("top",)]
    assert ("top", 5) in rows(fa.js_functions(f), "name", "cc")
    found = rows(de.injection_findings(fa.js_calls(f)), "line", "rule", "severity")
    assert found == [(3, "sql-injection", "critical"), (4, "eval", "critical"), (4, "sql-injection", "critical"), (5, "open-redirect", "medium")]
    assert rows(de.route_findings(fa.js_calls(f)), "line", "rule") == [(4, "route-without-auth")]
    assert rows(de.n_plus_one_findings(fa.js_calls(f)), "line", "total") == [(3, 1)]
    e = de.edge_case_counts(f).first()
    assert (e["parse_int_radix"], e["json_parse_unguarded"], e["loose_equality"], e["switch_no_default"], e["new_date"]) == (1, 0, 1, 1, 1)
    t = de.test_quality(fa.tests(f)).first()
    assert (t["cases"], t["focused"], t["empty"], t["assertionless"]) == (2, 1, 1, 0)
    assert rows(de.assertion_quality(f), "strong", "weak") == [(1, 0)]


def test_python(facts):
    code = "def a(x=[]):\n  pass\ndef b(y={}): pass\n@app.route('/a', methods=['POST'])\ndef c():\n    q = request.args['q']\n    cur.execute(f'select {q}')\n    n = int(q)\n    open(n)\n    try:\n        requests.get('u')\n    except:\n        assert q == None\n"
    f = facts(("a.py", code), ("tests/test_a.py", code), ("bad.py", "def ("))
    got = rows(de.python_findings(f).where("path = 'a.py'"), "line", "rule")
    assert got == [(1, "mutable-default-arg"), (3, "mutable-default-arg"), (7, "py-taint-sqli"), (7, "sql-string-interpolation"), (11, "requests-no-timeout"), (12, "bare-except"), (13, "assert-for-validation"), (13, "eq-none")]
    assert "py-taint-sqli" not in [r for _, r in rows(de.python_findings(f).where("path <> 'a.py'"), "line", "rule")]
    assert rows(f.where("kind = 'endpoint' and path = 'a.py'"), "name", "value") == [("/a", "POST")]
