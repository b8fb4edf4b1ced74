"""Kubernetes manifests and flow style, on literal files."""

import pytest

from auditlake.operators import config as co

BAD = """
apiVersion: apps/v1
kind: Deployment
metadata: { name: api }
spec:
  template:
    spec:
      containers:
        - name: api
          image: api:latest
          securityContext: { privileged: true }
"""
HARD = """
kind: Deployment
metadata: { name: worker }
spec:
    template:
        spec:
            automountServiceAccountToken: false
            containers:
                - name: worker
                  image: "reg:5000/worker@sha256:abc"
                  securityContext: { runAsNonRoot: true, allowPrivilegeEscalation: false }
                  resources: { limits: { cpu: 1 } }
                  readinessProbe: { httpGet: { path: /, port: 80 } }
"""
ROLES = "kind: ClusterRole\nmetadata: { name: all }\nrules:\n  - { apiGroups: ['*'], resources: ['*'], verbs: [get] }\n  - resources: [pods]\n    verbs:\n      - '*'\n---\nkind: ConfigMap\nmetadata: { name: c }\ndata: { LOG_LEVEL: info, DB_PASSWORD: hunter2 }\n"
HELM = 'apiVersion: apps/v1\nkind: Deployment\nmetadata: { name: {{ .Release.Name }} }\nspec:\n  replicas: {{ .Values.replicas }}\n  template:\n    spec:\n      containers:\n        - name: app\n          image: "{{ .Values.image }}:latest"\n'


@pytest.fixture(scope="module")
def found(spark):
    files = [("bad", "k8s/api.yaml", BAD), ("hard", "k8s/worker.yaml", HARD), ("hard", "k8s/np.yml", "kind: NetworkPolicy\nspec: { podSelector: {} }\n"), ("roles", "rbac.yaml", ROLES), ("helm", "t/deploy.yaml", HELM), ("helm", "Chart.yaml", "name: app\n"), ("none", "README.md", "# kind: hi"), ("empty", "a.yaml", ""), ("empty", "b.yaml", None)]
    df = spark.createDataFrame(files, "repo string, path string, content string")
    facts = co.k8s_facts(df)
    return co.k8s_findings(facts).collect(), {r.repo: r for r in co.k8s_report(df, facts).collect()}


def test_rules(found):
    rules = lambda repo: sorted((r.rule, r.subject) for r in found[0] if r.repo == repo)
    named = ["mutable-image", "no-probes", "no-resources", "privilege-escalation", "privileged", "runs-as-root"]
    assert rules("bad") == sorted([("no-network-policy", None), ("service-account-token", "api"), *[(r, "api") for r in named]], key=lambda x: (x[0], x[1] or ""))
    assert rules("hard") == []
    assert rules("roles") == [("secret-in-configmap", "DB_PASSWORD"), ("wildcard-rbac", "all"), ("wildcard-rbac", "all")]
    assert ("mutable-image", "app") in rules("helm") and not any(r.repo in ("none", "empty") for r in found[0])


def test_report(found):
    r = found[1]
    assert r["bad"].score < 80 and r["bad"].kinds == "Deployment:1" and r["hard"].score == 100 and r["hard"].kinds == "Deployment:1,NetworkPolicy:1"
    assert (r["none"].applicable, r["none"].score, r["empty"].applicable, r["helm"].manifests, r["roles"].documents) == (False, 0, False, 1, 2)


def test_flow_entries():
    entries = lambda text: {".".join(k): v for k, v in co._flow_entries(text)}
    assert entries("{a: 1, b: [x, {c: 'd, e'}], f: }") == {"a": "1", "b": "[", "b.0": "x", "b.1": "{", "b.1.c": "d, e", "f": ""}
    assert entries('{"a":1,"b":{"c":"x:y"},"e":[]}') == {"a": "1", "b": "{", "b.c": "x:y", "e": "["}
    assert entries("[http://x/y, a b, it's]") == {"0": "http://x/y", "1": "a b", "2": "it's"} and entries("{}") == {} and entries("[[[") == {"0": "[", "0.0": "["}
    lines = list(co._key_lines("a: [1,\n  2, # two\n 3]\nb: {c: 'x\n y'}\nd: e\n"))
    assert {".".join(k): v for _, _, k, v, _, _ in lines}["a.2"] == "3" and lines[-1][2:4] == (["d"], "e")


def test_flow_takes_linear_time():
    deep = "a: " + "[" * 20_000 + "]" * 20_000 + "\nb: {" + ",\n".join(f"k{i}: {i}" for i in range(50_000)) + "}\n"
    n = sum(1 for _ in co._key_lines(deep))
    assert n == 2 + 19_999 + 50_000
