"""Facts of code: one pass over each file's tokens in Arrow batches gives a tagged frame; all else is built on its columns.

A row is (repo, path, line, kind, name, value, context...). Kinds of JavaScript and TypeScript (see scan.py): call, flow,
import, export, ident, function, test, misc. Kinds of Python: rule (edge cases and taint), endpoint, test. Code that a
compiler would reject still gives the rows that can be told.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.scan import js_rows, module_rows

SCHEMA = (
    "repo string, path string, line int, col int, kind string, name string, value string, n_args int, arg_kind string, taint boolean, sanitized boolean, "
    "in_loop boolean, in_all boolean, in_try boolean, in_handler boolean, func string, cc int, pos int, end int, marks array<string>, arg int, param int, level string"
)
JS_PATH = r"\.(js|jsx|mjs|cjs|ts|tsx)$"

def _called(node: ast.AST) -> str:
    try:
        return ast.unparse(node)
    except (ValueError, RecursionError):
        return ""


PY_SOURCE = re.compile(r"\brequest\.(args|form|json|values|data|cookies|headers|GET|POST|query_params)\b|\binput\(|\bsys\.argv\b")
_HTTP = {"get", "post", "put", "delete", "patch", "head", "request"}


def py_rows(text: str) -> Iterator[dict]:
    """Rows of one Python text: a text that doesn't parse gives none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return

    def rule(node, name, value=""):
        return {"kind": "rule", "line": node.lineno, "col": node.col_offset, "name": name, "value": value}

    guarded = {id(x) for n in ast.walk(tree) if isinstance(n, ast.Try) for b in n.body for x in ast.walk(b)}
    for n in ast.walk(tree):
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            if any(isinstance(d, ast.List | ast.Dict | ast.Set) or isinstance(d, ast.Call) and _called(d.func) in ("list", "dict", "set") for d in [*n.args.defaults, *filter(None, n.args.kw_defaults)]):
                yield rule(n, "mutable-default-arg", n.name)
            for d in n.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                    verbs = [d.func.attr.upper()] if d.func.attr in _HTTP else []
                    if d.func.attr == "route":
                        verbs = next(([str(getattr(e, "value", "")).upper() for e in k.value.elts] for k in d.keywords if k.arg == "methods" and isinstance(k.value, ast.List | ast.Tuple)), ["GET"])
                    shaped = any(k.arg == "response_model" for k in d.keywords)
                    for v in verbs:
                        yield {"kind": "endpoint", "line": n.lineno, "name": d.args[0].value, "value": v, "sanitized": shaped}
            if n.name.startswith("test"):
                said = list(ast.walk(n))
                asserts = any(isinstance(x, ast.Assert) or isinstance(x, ast.Call) and re.search(r"(^|\.)(assert\w*|raises)$", _called(x.func)) for x in said)
                empty = all(isinstance(s, ast.Pass) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) for s in n.body)
                skip = any("skip" in _called(d) for d in n.decorator_list)
                yield {"kind": "test", "line": n.lineno, "name": n.name, "value": "test.skip" if skip else "test", "taint": asserts, "sanitized": empty}
            yield from _py_taint(n, rule)
        elif isinstance(n, ast.ExceptHandler) and n.type is None:
            yield rule(n, "bare-except")
        elif isinstance(n, ast.Compare) and any(isinstance(o, ast.Eq | ast.NotEq) and isinstance(c, ast.Constant) and c.value is None for o, c in zip(n.ops, n.comparators)):
            yield rule(n, "eq-none")
        elif isinstance(n, ast.Assert):
            yield rule(n, "assert-for-validation")
        elif isinstance(n, ast.Call):
            f = _called(n.func)
            if re.fullmatch(r"(requests|httpx)\.(get|post|put|delete|patch|head|request)", f) and not any(k.arg in ("timeout", None) for k in n.keywords):
                yield rule(n, "requests-no-timeout", f)
            if f == "int" and n.args and not isinstance(n.args[0], ast.Constant) and id(n) not in guarded and PY_SOURCE.search(_called(n.args[0])):
                yield rule(n, "int-coercion-unchecked")
            if f.rsplit(".", 1)[-1] in ("execute", "executemany", "raw") and n.args and _built_text(n.args[0]):
                yield rule(n, "sql-string-interpolation", f)


def _built_text(a: ast.AST) -> bool:
    return (
        isinstance(a, ast.JoinedStr) and any(isinstance(v, ast.FormattedValue) for v in a.values)
        or isinstance(a, ast.BinOp) and isinstance(a.op, ast.Add | ast.Mod) and any(isinstance(x, ast.Constant | ast.JoinedStr) for x in (a.left, a.right))
        or isinstance(a, ast.Call) and isinstance(a.func, ast.Attribute) and a.func.attr == "format"
    )


def _py_taint(fn: ast.AST, rule) -> Iterator[dict]:
    """Sinks of one function whose first argument comes from a request through plain assignments."""
    dirty: set[str] = set()
    reaches = lambda a: bool(PY_SOURCE.search(_called(a))) or any(isinstance(x, ast.Name) and x.id in dirty for x in ast.walk(a))
    for n in sorted((x for x in ast.walk(fn) if isinstance(x, ast.Assign | ast.Call)), key=lambda x: (x.lineno, isinstance(x, ast.Call))):
        if isinstance(n, ast.Assign):
            safe = isinstance(n.value, ast.Call) and _called(n.value.func) in ("int", "float", "bool", "secure_filename", "shlex.quote", "escape", "html.escape")
            for t in n.targets:
                if isinstance(t, ast.Name):
                    dirty.add(t.id) if reaches(n.value) and not safe else dirty.discard(t.id)
        elif n.args and reaches(n.args[0]):
            f = _called(n.func)
            last = f.rsplit(".", 1)[-1]
            if last in ("execute", "executemany", "raw") and (_built_text(n.args[0]) or isinstance(n.args[0], ast.Name)):
                yield rule(n, "py-taint-sqli", f)
            elif f in ("eval", "exec", "os.system", "os.popen") or f.startswith("subprocess."):
                yield rule(n, "py-taint-rce", f)
            elif f == "open" or last == "send_file":
                yield rule(n, "py-taint-path", f)
            elif re.fullmatch(r"(requests|httpx)\.\w+", f) and last in _HTTP or last == "urlopen":
                yield rule(n, "py-taint-ssrf", f)


def code_facts(files: DataFrame) -> DataFrame:
    """The tagged frame of all JavaScript, TypeScript and Python files; other files and null contents give no rows.

    A file is read by one task, and a task reads its files one after the other. Rows stay where their file is: spread
    files that lie in few partitions before their contents are read.
    """
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")]

    def frame(rows):
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kind) for c, kind in fields], names=[c for c, _ in fields])

    def run(batches):
        for batch in batches:
            out = []
            for repo, path, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = py_rows(content) if path.endswith(".py") else [*module_rows(content), *js_rows(content)]
                out.extend({"repo": repo, "path": path} | r for r in found)
                if len(out) > 20_000:
                    yield frame(out)
                    out = []
            yield frame(out)

    code = files.where((F.col("path").rlike(JS_PATH) | F.col("path").endswith(".py")) & F.col("content").isNotNull())
    return code.select("repo", "path", "content").mapInArrow(run, SCHEMA)


def js_calls(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'call'").drop("kind", "cc", "arg", "param")


def with_arguments(calls: DataFrame, files: DataFrame) -> DataFrame:
    """calls with args_text, the whole text of their arguments, cut from the contents of files."""
    texts = files.select("repo", "path", "content")
    return calls.join(texts, ["repo", "path"]).withColumn("args_text", F.expr("substring(content, pos + 1, end - pos)")).drop("content")


def js_flows(facts: DataFrame) -> DataFrame:
    """(repo, path, line, col, callee, n_args, arg, func, param, level): what reaches an argument of a call, data of a request (func null) or a parameter of an enclosing function, and how: direct, derived or safe."""
    return facts.where("kind = 'flow'").select("repo", "path", "line", "col", F.col("name").alias("callee"), "n_args", "arg", "func", "param", "level")


def js_imports(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'import'").select("repo", "path", "line", F.col("name").alias("specifier"), F.col("value").alias("imported"), F.col("arg_kind").alias("form"), F.col("func").alias("property"))


def js_exports(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'export'").select("repo", "path", "line", "name", F.col("value").alias("local"))


def js_idents(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'ident'").select("repo", "path", "name")


def js_functions(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'function'").select("repo", "path", "line", "name", "cc")


def tests(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'test'").select("repo", "path", "line", F.col("name").alias("title"), F.col("value").alias("form"), F.col("taint").alias("has_assertion"), F.col("sanitized").alias("is_empty"))


def py_endpoints(facts: DataFrame) -> DataFrame:
    """(repo, path, line, method, route, has_model): routes of decorated Python functions, and whether they declare a response model."""
    return facts.where("kind = 'endpoint'").select("repo", "path", "line", F.col("value").alias("method"), F.col("name").alias("route"), F.col("sanitized").alias("has_model"))
