"""Operators that work without a task for a key: against plain loops on crowded and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.operators import config as co
from auditlake.operators import detectors as de
from auditlake.operators import loadlog as lo
from auditlake.operators import service as se
from auditlake.operators import text as tx
from auditlake.streaming import jobs

REQUESTS = "id long, caller long, us long"


def requests(spark, rows):
    return spark.createDataFrame(rows, REQUESTS).select("id", "caller", F.timestamp_micros("us").alias("ts"))


def test_anchored_windows_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(i, 1, rng.randrange(0, 40_000_000)) for i in range(1500)]  # crowded: one caller
    rows += [(2000 + i, 2, 60_000_000 * i) for i in range(40)]  # each exactly at the end of the window before
    rows += [(3000 + i, 3, rng.randrange(0, 3_000_000_000)) for i in range(60)] + [(4000, 4, 5), (4001, 4, 5), (4002, 4, 5)]
    want = {}
    for caller in {c for _, c, _ in rows}:
        ends = n = 0
        first = True
        for t, i in sorted((t, i) for i, c, t in rows if c == caller):
            if first or t > ends:
                ends, n, first = t + 2_000_000, 0, False
            n += 1
            want[i] = (n, n <= 3)
    got = lo.rate_limit_fixed(requests(spark, rows + [(9000, None, 1)]), 3, 2).collect()
    assert len(got) == len(want) and {r.id: (r["count"], r.allowed) for r in got} == want
    assert lo.rate_limit_fixed(requests(spark, []), 3, 2).count() == 0


def test_percentiles_of_odd_levels(spark):
    rng = np.random.default_rng(2)
    levels = {1: rng.exponential(50, 3000).round(3), 2: np.array([7.0] * 50), 3: np.array([1.0, 1e9] * 20 + [2.0]), 4: np.array([5.0])}
    rows = [(k, 200, float(v)) for k, vs in levels.items() for v in vs] + [(5, 500, None), (4, 200, None)]
    got = {r.concurrency: r for r in lo.load_levels(spark.createDataFrame(rows, "concurrency int, status int, latency double").repartition(3)).collect()}
    for k, vs in levels.items():
        assert np.allclose([got[k].p50, got[k].p90, got[k].p99], np.quantile(vs, [0.5, 0.9, 0.99]), rtol=1e-12)
    assert got[5].p50 is None and got[5].error_rate == 1.0 and got[4].attempts == 2


def test_containment_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abc", k=rng.randrange(0, 7)))
    a, b = ({(r, word()) for r in ("r", "s") for _ in range(150)} for _ in range(2))
    got = {tuple(r) for r in de.contained_in(spark.createDataFrame(sorted(a), "repo string, text string"), spark.createDataFrame(sorted(b), "repo string, text string")).collect()}
    assert got == {(r, x, y) for r, x in a for s, y in b if r == s and x and x in y}


def test_words_of_titles_and_imports(spark):
    functions = spark.createDataFrame([("r", n) for n in ("getUser", "save", "load", "zap", "")], "repo string, name string")
    titles = spark.createDataFrame([("r", "getUserById works"), ("r", "a b!"), ("s", "zap")], "repo string, title string")
    imports = spark.createDataFrame([("r", "tests/a.test.js", "{ loadAll }"), ("r", "src/a.js", "{ zap }")], "repo string, path string, imported string")
    got = {(r.name): r.tested for r in de.tested_functions(functions, titles, imports).collect()}
    assert got == {"getUser": True, "save": False, "load": True, "zap": False}


YAML = """# a comment
"paths": &all
    '/a b':
        get: {x: 1}   # said
    /c:
    - name: one
      deep:
          - x: "1"
          -
            - inner
            - y: 2
    run: |
        line: one

          line two
    after: 'it''s'
---
jobs: *none
more:
  base: &b
    image: x
  own:
    <<: *b
    k: v
"""


def test_paths_of_lines(spark):
    df = spark.createDataFrame([("r", "a.yml", YAML), ("r", "b.yml", ""), ("r", "c.yml", None), ("r", "d.yml", "\t- : :\n- - - a: b\n]x:\n&\n*\n: |\n  t")], "repo string, path string, content string")
    rows = co.yaml_paths(df).collect()
    got = {(r.doc, r.line, ".".join(r["keys"])): r.value for r in rows if r.path == "a.yml"}
    assert got == {
        (0, 2, "paths"): "", (0, 3, "paths./a b"): "", (0, 4, "paths./a b.get"): "{x: 1}", (0, 4, "paths./a b.get.x"): "1", (0, 5, "paths./c"): "", (0, 6, "paths./c.0.name"): "one", (0, 7, "paths./c.0.deep"): "", (0, 8, "paths./c.0.deep.0.x"): "1",
        (0, 9, "paths./c.0.deep.1"): "", (0, 10, "paths./c.0.deep.1.0"): "inner", (0, 11, "paths./c.0.deep.1.1.y"): "2", (0, 12, "paths.run"): "", (0, 13, "paths.run"): "line: one", (0, 15, "paths.run"): "line two", (0, 16, "paths.after"): "it''s",
        (1, 18, "jobs"): "*none", (1, 19, "more"): "", (1, 20, "more.base"): "", (1, 21, "more.base.image"): "x", (1, 22, "more.own"): "", (1, 23, "more.own.<<"): "*b", (1, 23, "more.own.image"): "x", (1, 24, "more.own.k"): "v",
    }


def test_indent_does_not_matter(spark):
    flat = "openapi: 3.0.0\npaths:\n  /a:\n    get:\n      x: 1\n    parameters:\n      - name: post\n  /b:\n    'post':\n      x: 1\n"
    wide = flat.replace("  ", "    ")
    flow = "jobs:\n  a:\n    steps:\n      - run: npm publish\n      - name: t\n        run: tsc\n  b:\n    uses: x\n"
    df = spark.createDataFrame([("r", "2/openapi.yaml", flat), ("r", "4/openapi.yaml", wide), ("r", "2/.github/workflows/a.yml", flow), ("r", "4/.github/workflows/a.yml", flow.replace("  ", "   "))], "repo string, path string, content string")
    ends = {(r.path[0], r.method, r.route) for r in co.openapi_endpoints(df).collect()}
    assert ends == {(i, m, p) for i in "24" for m, p in (("GET", "/a"), ("POST", "/b"))}
    jobs_ = {(r.path[0], r.job, r.deploys, r.type_checks) for r in co.ci_jobs(df).collect()}
    assert jobs_ == {(i, j, j == "a", j == "a") for i in "24" for j in "ab"}
    assert {(r.path[0], r.job, r.step, r.name, r.deploys) for r in co.ci_steps(df).collect()} == {(i, "a", k, n, d) for i in "24" for k, n, d in ((0, None, True), (1, "t", False))}


def test_plans_of_customers_that_change_hands(spark):
    events = [(1, 1, "created", 10, "c", "team"), (2, 2, "updated", None, "c", "enterprise"), (3, 3, "updated", 11, "c", None), (4, 4, "updated", 10, "d", "team"), (5, 5, "deleted", None, "c", None), (5, 5, "deleted", None, "c", None), (6, 6, "updated", None, "x", "team"), (7, 7, "other", 12, "c", "team"), (8, 8, "deleted", 10, None, None)]
    users = [(10, None, None), (11, "pro", None), (12, "free", "x"), (13, "pro", None)]
    got = {tuple(r) for r in se.plan_of_users(spark.createDataFrame(events, "id long, ts long, kind string, user_id long, customer string, plan string"), spark.createDataFrame(users, "id long, plan string, customer string")).collect()}
    assert got == {(10, "team", "d", 3), (11, "free", "c", 2), (12, "team", "x", 1), (13, "pro", None, 0)}


@pytest.mark.parametrize("line,color", [("color: #fff", "fff"), ("x color:'#A0b1C2'", "A0b1C2"), ("color: rgb(1, 300,16)", "01FF10"), ("color: LightGray;", "d3d3d3"), ("backgroundColor: '#fff'", None), ("color: red", None), ("outline: none", None)])
def test_text_colors(spark, line, color):
    assert spark.range(1).select(tx.text_color(F.lit(line)).alias("c")).first().c == color


def test_luminance(spark):
    got = spark.createDataFrame([(x,) for x in ("fff", "000000", "777", "zz", None)], "h string").select(tx.luminance(F.col("h")).alias("l")).collect()
    assert [r.l and round(r.l, 4) for r in got] == [1.0, 0.0, 0.1845, None, None]


def test_sliding_limits_of_a_stream_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 1, 2]), 1_000_000_000 + rng.randrange(0, 300) * 1_000_000) for i in range(400)]
    arrival = sorted(rows, key=lambda r: r[2] + rng.randrange(0, 40) * 1_000_000)  # up to 40 seconds late
    last = [(9000 + c, c, 2_000_000_000) for c in (1, 2)]
    for k, at in enumerate(range(0, 400, 80)):
        requests(spark, arrival[at : at + 80] + (last if at == 320 else [])).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        (tmp_path / "src").mkdir(exist_ok=True)
        for f in (tmp_path / "in" / str(k)).glob("*.parquet"):
            f.rename(tmp_path / "src" / f"{k}.parquet")
    source = spark.readStream.schema("id long, caller long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src")
    q = jobs.sliding_limits(source, 5, 60, "1 minute").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.id < 9000}
    want = {tuple(r) for r in lo.rate_limit_sliding(requests(spark, rows), 5, 60).collect()}
    assert got == want
