"""Manifests, lock files and coverage artifacts on literal files."""

import json

import pytest

from auditlake.sources import manifests as m


@pytest.fixture(scope="module")
def files(spark):
    return lambda *rows: spark.createDataFrame([("r", p, c) for p, c in rows], "repo string, path string, content string")


def names(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_deps(files):
    package = json.dumps({"dependencies": {"express": "^4.1.0"}, "devDependencies": {"jest": "29"}, "workspaces": ["mods/*"]})
    project = '[project]\nname = "x"\ndependencies = [\n  "httpx[http2]>=0.2",\n  "Typing_Ext",\n]\n[project.optional-dependencies]\ndb = ["asyncpg==1"]\n[tool.poetry.dependencies]\npython = "^3"\ncelery = {version = "5"}\n'
    f = files(
        ("package.json", package), ("deep/er/package.json", package), ("broken/package.json", "{"), ("requirements.txt", "Django==4.2.1\nnumpy>=1.0,<2\n# no\nflask_login==0.6.2\n"), ("pyproject.toml", project),
        ("go.mod", "module x\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.0\n\tgolang.org/x/net v0.1.0 // indirect\n\tgithub.com/a/chi/v5 v5.0.1\n)\n"), ("apps/web/package.json", '{"peerDependencies":{"react":"18"}}'),
    )
    assert names(m.extract_deps(f), "name", "scope") == sorted([
        ("express", "runtime"), ("jest", "dev"), ("react", "peer"), ("django", "runtime"), ("numpy", "runtime"), ("flask-login", "runtime"), ("httpx", "runtime"), ("typing-ext", "runtime"), ("asyncpg", "runtime"), ("celery", "runtime"), ("gin", "runtime"), ("chi", "runtime"),
    ])
    assert ("Testing",) in names(m.tech_stack(m.extract_deps(f)), "stack")
    more = files(("package.json", package), ("mods/a/package.json", "{}"), ("mods/a/b/package.json", "{}"), ("libs/z/go.mod", "module z"))
    assert names(m.workspace_members(more), "member") == [("libs/z",), ("mods/a",)]


def test_locks(files):
    lock = {"packages": {"": {"dependencies": {"a": "1"}}, "node_modules/a": {"version": "1.2", "integrity": "x"}, "node_modules/a/node_modules/@s/b": {"version": "2.0", "resolved": "git+ssh://h"}}}
    f = files(
        ("package-lock.json", json.dumps(lock)), ("requirements.txt", "Django==4.2.1\nnumpy>=1\n#x\nflask_login==0.6.2"), ("poetry.lock", '[[package]]\nname = "Foo_Bar"\nversion = "1.0"\n\n[[package]]\nname = "b"\nversion = "2"\n'),
        ("Pipfile.lock", '{"default":{"Req":{"version":"==2.1"}},"develop":{}}'), ("go.sum", "h.io/a v1.0.0 h1:x=\nh.io/a v1.0.0/go.mod h1:y=\nh.io/b v2.0.0 h1:z=\n"),
    )
    got = m.lock_entries(f).select("name", "version", "is_direct").collect()
    assert sorted(map(tuple, got)) == sorted([
        ("a", "1.2", True), ("@s/b", "2.0", False), ("django", "4.2.1", None), ("flask-login", "0.6.2", None), ("foo-bar", "1.0", None), ("b", "2", None), ("req", "2.1", None), ("h.io/a", "v1.0.0", None), ("h.io/b", "v2.0.0", None),
    ])


def test_licenses(files):
    f = files(("node_modules/a/package.json", '{"name":"a","license":"MIT"}'), ("node_modules/@s/b/package.json", '{"license":{"type":"GPL-3.0"}}'), ("node_modules/c/package.json", '{"licenses":[{"type":"BSD"}]}'), ("node_modules/d/package.json", "{}"), ("package.json", '{"license":"X"}'))
    got = {r["name"]: r["license"] for r in m.installed_licenses(f).collect()}
    assert got == {"a": "MIT", "@s/b": "GPL-3.0", "c": "BSD", "d": None}


@pytest.mark.parametrize(
    "path,text,pct,n",
    [("cov/lcov.info", "SF:a\nLF:10\nLH:8\nSF:b\nLF:10\nLH:2\n", 50.0, 2), ("cobertura.xml", '<coverage line-rate="0.83">', 83.0, 0), ("cobertura.xml", '<coverage><class line-rate="0.5"/><class line-rate="1.0"/>', 75.0, 2), ("coverage/coverage-summary.json", '{"total":{"lines":{"pct":76}},"a.js":{}}', 76.0, 1)],
)
def test_coverage(files, path, text, pct, n):
    row = m.read_coverage(files((path, text))).first()
    assert (round(row["pct"], 6), row["file_count"]) == (pct, n)


def test_read_repos(spark, tmp_path):
    (tmp_path / "one" / "src").mkdir(parents=True)
    (tmp_path / "one" / "src" / "a.js").write_text("x")
    (tmp_path / "one" / "b.txt").write_text("y")
    assert names(m.read_repos(spark, str(tmp_path), ["js"]), "repo", "path", "content", "size") == [("one", "src/a.js", "x", 1)]
