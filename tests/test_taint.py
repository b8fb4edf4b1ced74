"""Taint across functions and files on literal code: chains, import styles, recursion, sanitizers; the scan's cost."""

import time

import pytest

from auditlake.operators import facts as fa
from auditlake.operators import taint
from auditlake.operators.scan import js_rows


@pytest.fixture(scope="module")
def found(spark):
    def run(**files):
        df = spark.createDataFrame([("r", p.replace("__", "/").replace("_JS", ".js"), c) for p, c in files.items()], "repo string, path string, content string")
        got = taint.cross_file_taint(fa.code_facts(df).cache(), df).collect()
        return sorted((r.path, r.line, r.callee, r.category, r.confidence) for r in got)

    return run


ONE_FILE = """const express = require('express');
function ask(q) {
  return db.query(q)
}
const find = function (id) {
  const text = 'select ' + id
  return db.query(text)
}
const go = (res, to) => res.redirect(to);
function load(name) { return fs.readFile('./up/' + name, 'utf-8'); }
function lost(res, said) {
  res.send('<h1>' + said + '</h1>');
}
function fine(x) { db.query('select ?', [x]); }
app.get('/a', (req, res) => {
  ask('select ' + req.params.id);
  res.json(find(req.params.id));
});
app.get('/b', (req, res) => { go(res, req.query.next); load(req.query.name).then((b) => res.send(b)); lost(res, req.query.what); fine(req.query.x); ask('all'); })
"""


def test_helpers_of_one_file(found):
    assert found(a_JS=ONE_FILE) == [
        ("a.js", 16, "ask", "SQL Injection", "high"), ("a.js", 17, "find", "SQL Injection", "high"), ("a.js", 19, "go", "Open Redirect", "high"),
        ("a.js", 19, "load", "Path Traversal", "high"), ("a.js", 19, "lost", "XSS", "high"),
    ]


def test_ways_to_import(found):
    lib = "function run(q) {\n  return db.query(q);\n}\nfunction build(id) { const sql = 'a' + id; return db.query(sql); }\nmodule.exports = { run, other: build };\n"
    esm = "export function go(res, to) {\n return res.redirect(to)\n}\nexport const echo = (res, msg) => {\n  res.send('<b>' + msg + '</b>');\n};\nfunction hid(x) { eval(x) }\nexport { hid as shown };\nexport default go\n"
    cjs_user = "const { run, other: o } = require('./lib/db');\nconst ns = require('./lib/db');\nconst one = require('./lib/db').run;\napp.get('/', (req, res) => {\n  run(req.body.a);\n  o(req.query.id);\n  ns.run('x' + req.params.id);\n  one(req.query.z);\n  ns.absent(req.query.z);\n});\n"
    esm_user = "import express from 'express';\nimport def, { go as jump, echo } from './lib/web.js';\nimport * as all from './lib/web';\nimport { shown } from '../src/lib/web';\napp.get('/', (req, res) => {\n  jump(res, req.query.next);\n  echo(res, req.query.msg);\n  all.echo(res, req.query.msg);\n  def(res, req.query.n);\n  shown(req.body.code);\n  hid(req.body.code);\n});\n"
    assert found(src__lib__db_JS=lib, src__lib__web_JS=esm, src__a_JS=cjs_user, src__b_JS=esm_user) == [
        ("src/a.js", 5, "run", "SQL Injection", "high"), ("src/a.js", 6, "o", "SQL Injection", "high"), ("src/a.js", 7, "ns.run", "SQL Injection", "high"), ("src/a.js", 8, "one", "SQL Injection", "high"),
        ("src/b.js", 6, "jump", "Open Redirect", "high"), ("src/b.js", 7, "echo", "XSS", "high"), ("src/b.js", 8, "all.echo", "XSS", "high"), ("src/b.js", 9, "def", "Open Redirect", "high"), ("src/b.js", 10, "shown", "Dangerous Functions", "high"),
    ]


def test_chains_recursion_and_levels(found):
    files = {f"m{i}_JS": f"import {{ f{i - 1} }} from './m{i - 1}';\nexport function f{i}(a, b) {{ return f{i - 1}({'b' if i % 2 else '0, a'}) }}\n" for i in range(1, 9)}
    files["m0_JS"] = "export function f0(a, b) { if (a) { f0(b, a) } db.query(a) }\nexport function ping(n, x) { pong(x, n) }\nexport function pong(y, n) { ping(n, y); eval(n) }\n"
    files["use_JS"] = (
        "import { f8 } from './m8';\nimport { f0, ping } from './m0';\nfunction safe(v) { f0(encodeURIComponent(v)) }\napp.get('/', (req, res) => {\n  f8(req.query.a, 1);\n  f8(1, req.query.a);\n  ping(req.query.n, 1);\n  ping(1, req.query.n);\n"
        "  safe(req.query.a);\n  f0(escape(req.query.a));\n  f0(wrap(req.query.a));\n  f0(`a ${thing}`);\n  f0(1, req.query.b);\n  f0('constant');\n});\n"
    )
    # f8(a, b) -> f7(0, a) -> f6(a = b of f7) -> f5(0, a) -> ... -> f0(a = b of f1)
    sql, code = "SQL Injection", "Dangerous Functions"
    assert found(**files) == [
        ("use.js", 5, "f8", sql, "high"), ("use.js", 7, "ping", code, "high"), ("use.js", 9, "safe", sql, "medium"),
        ("use.js", 10, "f0", sql, "medium"), ("use.js", 11, "f0", sql, "medium"), ("use.js", 12, "f0", sql, "low"), ("use.js", 13, "f0", sql, "high"),
    ]


def test_scopes(found):
    code = """class Store {
  find(id) { return this.db.query('a' + id) }
}
function outer(p) { return rows.map(r => db.query(r + p)) }
function shadow(p) { return rows.map(p => db.query(p)) }
const typed: Handler = (req: Request, res) => { const a: string = req.query.a; outer(a)
  shadow(a) }
"""
    assert found(a_JS=code) == [("a.js", 6, "outer", "SQL Injection", "high")]


def test_cost_of_nesting_and_minified_text():
    rows = {n: len(js_rows("f(" * n + "x" + ")" * n)) for n in (500, 4000)}
    assert rows[4000] - rows[500] == 3500
    small = "".join(f"function a{i}(b,c){{var d=b+c;if(d&&b.x){{e.push(d)}}return db.query('s'+d)}};" for i in range(14_000))
    began = time.time()
    assert sum(r["kind"] == "function" for r in js_rows(small)) == 14_000
    assert len(small) > 1_000_000 and time.time() - began < 10
