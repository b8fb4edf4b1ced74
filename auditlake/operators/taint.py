"""Taint across functions and files: a fixpoint over tables of flows.

Facts of the scan say which parameter of which function reaches which argument of which call. Calls are resolved to
functions of the same file or of imported ones; then "parameter i of this function reaches a sink of category c" grows
from the sinks along the calls, a join a round with only what the last round found, until a round finds nothing. A
finding is a call that hands data of a request, or a text built from parts, to such a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators import facts as fa
from auditlake.operators import joins as jo
from auditlake.sources.store import stored

# Last segments of callees whose first argument (redirects: the last one) is a sink, by category; severities.
SINKS = {
    "SQL Injection": ["query", "exec", "execute", "raw", "findraw"],
    "Path Traversal": ["readFile", "readFileSync", "createReadStream", "sendFile", "writeFile", "writeFileSync", "unlink", "unlinkSync", "open", "openSync"],
    "Open Redirect": ["redirect"],
    "XSS": ["send", "write", "render"],
}
WHOLE_NAMES = {"Dangerous Functions": ["eval", "Function", "child_process.exec", "child_process.execSync"], "Path Traversal": ["path.join", "path.resolve"]}
SEVERITY = {"SQL Injection": "critical", "Dangerous Functions": "critical", "XSS": "high", "Path Traversal": "high", "Open Redirect": "medium"}
FUNC = ["repo", "path", "func", "param"]


def sink_categories(callee: Column) -> Column:
    """The categories of sinks that a callee is, as an array; SQL verbs whatever their case."""
    last = F.element_at(F.split(callee, r"\."), -1)
    hits = [F.when((F.lower(last) if c == "SQL Injection" else last).isin(names), c) for c, names in SINKS.items()]
    return F.array_distinct(F.array_compact(F.array(*hits, *[F.when(callee.isin(names), c) for c, names in WHOLE_NAMES.items()])))


def import_bindings(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(repo, path, local, target, exported): the names that imports of files bind; exported is '*' for a whole module.

    imports: facts.js_imports; paths: joins.resolve_imports, the file of each specifier.
    """
    name, text = r"[A-Za-z_$][\w$]*", F.col("imported")
    braces = F.regexp_extract(text, r"\{([^}]*)\}", 1)
    pairs = F.regexp_extract_all(braces, F.lit(rf"({name}(?:\s+as\s+{name}|\s*:\s*{name})?)"), F.lit(1))
    inner = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, rf"({name})$", 1).alias("local"), F.regexp_extract(p, rf"^({name})", 1).alias("exported")))
    outer = F.regexp_replace(text, r"\{[^}]*\}", "")
    whole = F.regexp_extract(outer, rf"\*\s*as\s+({name})", 1)
    plain = F.regexp_extract(outer, rf"^\s*({name})", 1)
    esm = F.col("form") == "esm"
    one = lambda local, exported: F.when(local != "", F.struct(local.alias("local"), exported.alias("exported")))
    outside = F.array_compact(F.array(one(F.when(esm, whole).otherwise(F.lit("")), F.lit("*")), one(plain, F.when(esm, "default").otherwise(F.coalesce("property", F.lit("*"))))))
    bound = imports.select("repo", "path", "specifier", F.explode(F.concat(inner, outside)).alias("b")).select("repo", "path", "specifier", "b.*")
    return bound.join(paths.select("repo", "path", "specifier", "target"), ["repo", "path", "specifier"]).select("repo", "path", "local", "target", "exported").distinct()


def call_targets(callees: DataFrame, functions: DataFrame, bindings: DataFrame, exports: DataFrame) -> DataFrame:
    """(repo, path, callee, to_path, to_func) of distinct (repo, path, callee): a function of the file, else an imported one.

    'ns.f' is looked up where ns binds a whole module. Callees that are neither are left out.
    """
    known = functions.where("name <> ''").select("repo", F.col("path").alias("to_path"), F.col("name").alias("to_func")).distinct()
    dot = F.instr("callee", ".")
    asked = callees.select("repo", "path", "callee", F.when(dot > 0, F.substring_index("callee", ".", 1)).otherwise(F.col("callee")).alias("local"), F.when(dot > 0, F.expr("substring(callee, instr(callee, '.') + 1)")).alias("member"))
    own = asked.where("member is null").join(known.withColumnRenamed("to_path", "path").withColumnRenamed("to_func", "callee"), ["repo", "path", "callee"], "left_semi").select("repo", "path", "callee", F.col("path").alias("to_path"), F.col("callee").alias("to_func"))
    bound = asked.join(own.select("repo", "path", "callee"), ["repo", "path", "callee"], "left_anti").join(bindings, ["repo", "path", "local"])
    wanted = bound.where("(exported = '*') = (member is not null)").withColumn("exported", F.coalesce("member", "exported"))
    given = exports.select("repo", F.col("path").alias("target"), F.col("name").alias("exported"), F.col("local").alias("to_func")).distinct()
    found = wanted.join(given, ["repo", "target", "exported"]).withColumnRenamed("target", "to_path").join(known, ["repo", "to_path", "to_func"], "left_semi")
    return own.unionByName(found.select("repo", "path", "callee", "to_path", "to_func")).groupBy("repo", "path", "callee").agg(F.min(F.struct("to_path", "to_func")).alias("to")).select("repo", "path", "callee", "to.*")


def param_sinks(flows: DataFrame, targets: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(repo, path, func, param, category, cleaned): the parameters that reach a sink; cleaned if only through a call that makes safe.

    Semi-naive: a round joins the calls with what the last one found or improved. The rounds are as many as the longest
    chain of helpers, twice that at most as a parameter improves once. Recursion adds nothing new and so ends.
    """
    passed = flows.where("func is not null").withColumn("cleaned", F.col("level") == "safe")
    at_sink = passed.withColumn("category", F.explode(sink_categories(F.col("callee")))).where(F.col("arg") == F.when(F.col("category") == "Open Redirect", F.col("n_args") - 1).otherwise(0))
    edges = stored(
        passed.join(targets, ["repo", "path", "callee"]).groupBy(*FUNC, "to_path", "to_func", "arg").agg(F.bool_and("cleaned").alias("by_cleaned"))
    )
    new = reached = stored(at_sink.groupBy(*FUNC, "category").agg(F.bool_and("cleaned").alias("cleaned")))
    for _ in range(max_rounds):
        far = new.select("repo", F.col("path").alias("to_path"), F.col("func").alias("to_func"), F.col("param").alias("arg"), "category", "cleaned")
        found = edges.join(far, ["repo", "to_path", "to_func", "arg"]).groupBy(*FUNC, "category").agg(F.bool_and(F.col("cleaned") | F.col("by_cleaned")).alias("cleaned"))
        had = reached.withColumnRenamed("cleaned", "had")
        new = stored(found.join(had, [*FUNC, "category"], "left").where("had is null or (had and not cleaned)").drop("had"))
        if new.isEmpty():
            return reached
        reached = stored(reached.unionByName(new).groupBy(*FUNC, "category").agg(F.bool_and("cleaned").alias("cleaned")))
    raise RuntimeError(f"chains of helpers did not end in {max_rounds} rounds")


def cross_file_taint(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, line, col, callee, category, severity, confidence, title): calls that pass a helper what its sink must not get.

    facts: facts.code_facts of files; they are read several times, so store them first. One finding for a call and
    category. confidence: high for data of a request as they are; medium if they went through another call or anything
    on the way makes them safe; low for a text built from parts. Files without facts give none.
    """
    flows, imports, functions = fa.js_flows(facts), fa.js_imports(facts), fa.js_functions(facts)
    bindings = import_bindings(imports, jo.resolve_imports(imports, files))
    targets = stored(call_targets(flows.select("repo", "path", "callee").distinct(), functions, bindings, fa.js_exports(facts)))
    sinks = param_sinks(flows, targets).select("repo", F.col("path").alias("to_path"), F.col("func").alias("to_func"), F.col("param").alias("arg"), "category", "cleaned")
    handed = flows.where("func is null").join(targets, ["repo", "path", "callee"]).join(sinks, ["repo", "to_path", "to_func", "arg"])
    sure = F.when(F.col("cleaned") | F.col("level").isin("derived", "safe"), 2).when(F.col("level") == "direct", 3).otherwise(1)
    found = handed.groupBy("repo", "path", "line", "col", "callee", "category").agg(F.max(sure).alias("sure"))
    named = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return found.select(
        "repo", "path", "line", "col", "callee", "category", named(SEVERITY)[F.col("category")].alias("severity"), F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), F.col("sure")).alias("confidence"),
        F.concat("category", F.lit(" via `"), "callee", F.lit("()` helper")).alias("title"),
    )
