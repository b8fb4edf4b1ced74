"""YAML is read once, and its aliases are resolved where it is read: no join, nothing that the driver could collect."""

import pytest

from auditlake.operators import config as co
from auditlake.plans import code_queries as cq
from auditlake.plans import report_queries as rq

SF = "/root/testdata/sf0.001"
FILE = "repo string, path string, content string"


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_workflow_jobs_join_nothing(spark):
    made = plan(cq.ci_jobs(spark, SF))
    assert "Join" not in made and "Broadcast" not in made and made.count("MapInArrow") == 1


def test_aliases_of_repeated_and_nameless_files(spark):
    text = "on: x\njobs:\n  a: &one\n    steps:\n      - run: make deploy\n  b: *one\n  c:\n    <<: *one\n    name: c\n---\njobs:\n  d: *one\n"
    rows = [("r", ".github/workflows/a.yml", text), ("r", ".github/workflows/a.yml", text), (None, ".github/workflows/a.yml", text)]
    files = spark.createDataFrame(rows, FILE)
    lines = [(r.doc, r.line, "/".join(r["keys"]), r.value) for r in co.yaml_paths(files).where("repo is null").collect()]
    brought = [("steps", ""), ("steps/0/run", "make deploy")]
    assert sorted(x for x in lines if x[1] in (6, 8)) == sorted(
        [(0, 6, "jobs/b", "*one"), (0, 8, "jobs/c/<<", "*one"), *[(0, 6, f"jobs/b/{k}", v) for k, v in brought], *[(0, 8, f"jobs/c/{k}", v) for k, v in brought]]
    )
    assert not [x for x in lines if x[2].startswith("jobs/d/")]  # an anchor is known in its own document only
    assert co.yaml_paths(files).where("repo = 'r'").count() == 2 * len(lines)  # a repeated file counts as often as it stands there
    assert {(r.repo, r.job): r.deploys for r in co.ci_jobs(files).collect()} == {(repo, job): job != "d" for repo in ("r", None) for job in "abcd"}


def test_steps_that_are_no_list(spark):
    text = "jobs:\n  a:\n    steps:\n      one: x\n      2a: deploy\n  b:\n    steps:\n    - run: make\n    - name: n\n"
    got = {(r.job, r.step): r.name for r in co.ci_steps(spark.createDataFrame([("r", ".github/workflows/a.yml", text)], FILE)).collect()}
    assert got == {("b", 0): None, ("b", 1): "n"}
    made = plan(cq.ci_steps(spark, SF))
    assert "Join" not in made and made.count("MapInArrow") == 1


def test_descriptions_are_read_once_and_spread(spark):
    found = cq.openapi_endpoints(spark, SF)
    made = plan(found)
    assert "Join" not in made and made.count("MapInArrow") == 1
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()  # the table's few files come in few partitions


def test_kubernetes_rules_join_nothing(spark):
    facts = co.k8s_facts(cq._k8s_files(spark, SF))
    assert "Join" not in plan(facts) and plan(facts).count("MapInArrow") == 1


def test_sides_of_the_kubernetes_report_are_not_broadcast(spark):
    files = cq._k8s_files(spark, SF)
    assert "Broadcast" not in plan(co.k8s_report(files, co.k8s_facts(files)))


@pytest.mark.parametrize("query", [rq.dora_report, cq.contract_findings])
def test_sides_of_project_reports_are_not_broadcast(spark, query):
    assert "Broadcast" not in plan(query(spark, SF))


@pytest.mark.parametrize("query", [cq.tested_functions, cq.coverage_estimate])
def test_grams_of_names_are_not_broadcast(spark, query):
    made = plan(query(spark, SF))
    assert "Broadcast" not in made and "MapInArrow" not in made  # files are parsed before, once
