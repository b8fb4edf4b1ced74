"""Joins between facts: contracts, dead code, advisories, lock files, licenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import scores as S

# License families in the order in which they are tried; names stand at the begin of a word.
LICENSES = [
    ("proprietary", r"(?i)unlicensed|see[ -]license[ -]in|proprietary|all rights reserved"),
    ("strong", r"(?i)(^|[ (/])(a?gpl|osl)([-,v )]|$)|(^|[ (/])sspl|(^|affero |gnu )general public licen[sc]e"),
    ("weak", r"(?i)(^|[ (/])(lgpl|mpl|epl)([-,v .)]|$)|lesser general|mozilla public|eclipse public"),
    ("permissive", r"(?i)(^|[ (/])(mit|isc|apache|0?bsd|cc0|cc by|cc-by|unlicense|wtfpl|beerware|zlib|python-2)([-., )/]|$)"),
]


def canonical_route(route: Column) -> Column:
    """Lower case, ':id' and '{id}' alike, no slash at the end."""
    named = F.regexp_replace(F.lower(route), r":([a-z_][a-z0-9_]*)", "{$1}")
    return F.regexp_replace(named, r"(.)/+$", "$1")


def contract_diff(endpoints: DataFrame) -> DataFrame:
    """(repo, method, canonical, state): documented, undocumented (code only) or orphan (spec only)."""
    e = endpoints.select("repo", F.upper("method").alias("method"), canonical_route(F.col("route")).alias("canonical"), "origin")
    seen = e.groupBy("repo", "method", "canonical").agg(F.bool_or(F.col("origin") == "code").alias("code"), F.bool_or(F.col("origin") == "spec").alias("spec"))
    return seen.select("repo", "method", "canonical", F.when(F.col("code") & F.col("spec"), "documented").when(F.col("code"), "undocumented").otherwise("orphan").alias("state"))


def contract_report(endpoints: DataFrame) -> DataFrame:
    d = contract_diff(endpoints)
    counts = d.groupBy("repo").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("documented", "undocumented", "orphan")], F.count_if(~F.col("canonical").rlike(r"/v[0-9]+(/|$)")).alias("unversioned"))
    return counts.withColumn("score", S.count_score(F.col("undocumented") + F.col("orphan") + F.when(F.col("unversioned") > 10, 1).otherwise(0)))


def unused_exports(exports: DataFrame, idents: DataFrame) -> DataFrame:
    """Exported names that no other file of the repo mentions. Identifiers are counted by (repo, name) before the join."""
    names = exports.where(F.col("name") != "default").dropDuplicates(["repo", "path", "name"])
    used = idents.join(names.select("repo", "name").distinct(), ["repo", "name"], "left_semi")
    seen = used.groupBy("repo", "name").agg(F.count_distinct("path").alias("files"), F.min("path").alias("one"))
    both = names.join(seen, ["repo", "name"], "left")
    return both.where(F.col("files").isNull() | ((F.col("files") == 1) & (F.col("one") == F.col("path")))).select("repo", "path", "name")


def unused_deps(deps: DataFrame, imports: DataFrame) -> DataFrame:
    """Dependencies whose package no import names; '@scope/name/sub' belongs to '@scope/name', 'name/sub' to 'name'."""
    root = F.when(F.col("specifier").startswith("@"), F.substring_index("specifier", "/", 2)).otherwise(F.substring_index("specifier", "/", 1))
    used = imports.select("repo", root.alias("name")).distinct()
    return deps.select("repo", "name").distinct().join(used, ["repo", "name"], "left_anti")


def advisory_matches(locks: DataFrame, advisories: DataFrame) -> DataFrame:
    """(repo, ecosystem, name, stage, severity_rank): direct name hits, then transitive, then exact versions; a name once, earliest stage.

    Both tables have an ecosystem; a name of one says nothing about the same name in another. Entries are reduced to
    one row for each name and version of a repo, and shuffled by name once.
    """
    key = ["ecosystem", "name"]
    once = locks.groupBy("repo", *key, "version").agg(F.bool_or("is_direct").alias("direct"), F.bool_or(~F.col("is_direct")).alias("indirect"))
    rank = F.min(S.severity_rank(F.col("severity"))).alias("worst")
    worst = advisories.groupBy(*key, "version").agg(rank).groupBy(*key).agg(F.min("worst").alias("worst"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("version", F.lit("")).alias("v"), "worst"))).alias("exact"))
    hits = once.join(worst, key)
    stages = F.array_compact(F.array(
        F.when(F.col("direct"), F.struct(F.lit(1).alias("stage"), F.col("worst").alias("rank"))), F.when(F.col("indirect"), F.struct(F.lit(2).alias("stage"), F.col("worst").alias("rank"))),
        F.when(F.try_element_at("exact", F.col("version")).isNotNull(), F.struct(F.lit(3).alias("stage"), F.try_element_at("exact", F.col("version")).alias("rank"))),
    ))
    return hits.groupBy("repo", *key).agg(F.min(F.array_min(stages)).alias("m")).select("repo", *key, F.col("m.stage").alias("stage"), F.col("m.rank").alias("severity_rank"))


def lock_flags(locks: DataFrame) -> DataFrame:
    """Per repo: entries from elsewhere than a registry, without integrity, and names at two versions or more."""
    odd = ~F.col("resolved").startswith("https://registry.")
    by_name = locks.groupBy("repo", "name").agg(F.count_distinct("version").alias("versions"), F.count_if(odd).alias("foreign"), F.count_if(F.col("integrity").isNull()).alias("unsigned"), F.count(F.lit(1)).alias("n"))
    return by_name.groupBy("repo").agg(F.sum("n").alias("entries"), F.sum("foreign").alias("foreign"), F.sum("unsigned").alias("unsigned"), F.count_if(F.col("versions") > 1).alias("many_versions"))


def supply_chain_report(locks: DataFrame, advisories: DataFrame) -> DataFrame:
    flags, hits = lock_flags(locks), advisory_matches(locks, advisories).groupBy("repo").agg(F.count(F.lit(1)).alias("vulnerable"))
    both = flags.join(hits, "repo", "left").withColumn("vulnerable", F.coalesce("vulnerable", F.lit(0)).cast("long"))
    weight = F.col("vulnerable") * 2 + F.col("foreign") + F.least(F.col("many_versions"), F.lit(10))
    return both.withColumn("score", S.count_score(weight))


def duplicate_versions(locks: DataFrame) -> DataFrame:
    v = locks.groupBy("repo", "name").agg(F.sort_array(F.collect_set("version")).alias("v")).where(F.size("v") > 1)
    return v.select("repo", "name", F.concat_ws(",", "v").alias("versions"))


def license_category(text: Column) -> Column:
    out = F.lit("unknown")
    for name, pattern in reversed(LICENSES):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return F.when(text.isNull() | (text == ""), "unknown").otherwise(out)


def license_report(packages: DataFrame) -> DataFrame:
    """Counts by family for each repo, and the score; packages: (repo, license)."""
    families = [f for f, _ in LICENSES] + ["unknown"]
    c = packages.withColumn("family", license_category(F.col("license"))).groupBy("repo").agg(*[F.count_if(F.col("family") == f).alias(f) for f in families])
    return c.withColumn("score", S.count_score(F.col("strong") * 2 + F.col("proprietary") * 2 + F.col("weak")))


# Extensions in the order in which they are tried.
EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"]


def joined_path(path: Column, specifier: Column) -> Column:
    """The path that a relative specifier names, seen from the folder of `path`: '.' and '' parts go, '..' takes the part before it along."""
    parts = F.split(F.concat(F.regexp_replace(path, r"[^/]*$", ""), specifier), "/")
    kept = F.filter(parts, lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    step = lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p))
    return F.array_join(F.aggregate(kept, none, step), "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Specifiers that begin with '.' to files: as written, with an extension, as a folder with an index file, with another extension; the first that exists wins."""
    base = joined_path(F.col("path"), F.col("specifier"))
    bare = F.regexp_replace(base, r"\.([jt]sx?|[mc][jt]s)$", "")
    tries = [base, *[F.concat(base, F.lit(e)) for e in EXTENSIONS], *[F.concat(base, F.lit(f"/index{e}")) for e in EXTENSIONS], *[F.when(bare != base, F.concat(bare, F.lit(e))) for e in EXTENSIONS]]
    named = imports.where(F.col("specifier").startswith(".")).select("repo", "path", "specifier", F.posexplode(F.array(*tries)).alias("rank", "target")).where("target is not null")
    found = named.join(files.select("repo", F.col("path").alias("target")).distinct(), ["repo", "target"])
    return found.groupBy("repo", "path", "specifier").agg(F.min_by("target", "rank").alias("target"))


def rule_findings(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """User rules as data: the callee is listed, or matches the rule's pattern; arguments match the rule's, if it has one,
    and come from a request, if it says so (needs_taint, a column that rules may lack; calls then has taint).

    Listed callees are an equi join. Patterns are tried on the distinct callees only, whatever the number of calls, and
    the callees that match joined to the calls; all rules are used.
    """
    argument = F.col("arg_regex").isNull() | F.expr("args_text rlike arg_regex")
    if "needs_taint" in rules.columns:
        argument = argument & (~F.coalesce("needs_taint", F.lit(False)) | F.col("taint"))
    listed = F.coalesce(F.array_contains(F.col("callees"), F.col("callee")), F.lit(False))
    by_name = calls.join(rules.withColumn("callee", F.explode(F.array_distinct("callees"))), "callee").where(argument)
    matching = calls.select("callee").distinct().join(rules.where("callee_regex is not null"), F.expr("callee rlike callee_regex") & ~listed)
    by_pattern = calls.join(matching, "callee").where(argument)
    out = ["repo", "path", "line", "rule", "severity"]
    return by_name.select(*out).unionByName(by_pattern.select(*out))
