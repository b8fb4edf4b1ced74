"""Corpus scans: path flags, summaries, counts and signals of files, as expressions on (repo, path, content)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import scores as S

# Paths that aren't a repository's own source, and languages by extension.
SKIPPED = r"(^|/)(node_modules|\.git|dist|build|coverage|\.next|\.venv|venv|__pycache__|vendor|target|\.cache)/|(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock)$"
TEST_PATH = r"(^|/)(tests?|__tests__|spec|e2e)/|[._-](test|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$"
NATIVE = ["ts", "js", "tsx", "jsx", "mjs", "cjs", "mts", "cts", "py", "go"]
OTHER_LANGUAGES = {
    "rb": "Ruby", "rs": "Rust", "java": "Java", "kt": "Kotlin", "scala": "Scala", "swift": "Swift", "php": "PHP", "cs": "C#", "cpp": "C++", "cc": "C++", "cxx": "C++", "c": "C", "h": "C/C++ header",
    "hpp": "C++ header", "ex": "Elixir", "exs": "Elixir", "erl": "Erlang", "clj": "Clojure", "ml": "OCaml", "dart": "Dart",
}


def filter_sources(files: DataFrame) -> DataFrame:
    return files.where(~F.col("path").rlike(SKIPPED))


def path_flags(files: DataFrame) -> DataFrame:
    """(repo, path, ext, is_test, is_minified, n_lines): minified: at most one newline in over 5,000 characters, or lines of over 500 on average."""
    newlines = F.length("content") - F.length(F.replace("content", F.lit("\n")))
    minified = ((newlines <= 1) & (F.length("content") > 5000)) | (F.length("content") > 500 * (newlines + 1))
    return files.select("repo", "path", F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("ext"), F.col("path").rlike(TEST_PATH).alias("is_test"), minified.alias("is_minified"), (newlines + 1).alias("n_lines"))


# How paths tell examples, other people's code, generated files, files that are parsed and pages.
EXAMPLES = r"(?i)(^|/)(examples?|samples?|demos?)/"
VENDORED = r"(?i)(^|/)(node_modules|\.next|dist|build|out|coverage|__pycache__|\.venv|venv|vendor|vendored|third[-_]?party|monaco-editor|codemirror)/|\.min\.[mc]?jsx?$"
GENERATED = r"(?i)(^|/)(generated|__generated__|\.nuxt)/|\.(gen|generated)\.[mc]?[jt]sx?$|\.gen\.(go|py|rs|kt|swift)$|(_pb2(_grpc)?\.py|\.pb\.go)$|\.(min|bundle)\.[mc]?js$|\.d\.ts$"
PARSEABLE, PAGES = r"\.[mc]?[jt]sx?$", r"(?i)\.(html|tsx|jsx|vue|svelte)$"


def path_kinds(files: DataFrame) -> DataFrame:
    """(repo, path, is_example, is_vendored, is_generated, is_parseable, is_ui) by path alone; vendored and build folders hold generated files too. A null path is none of these."""
    path = F.coalesce("path", F.lit(""))
    vendored = path.rlike(VENDORED)
    return files.select(
        "repo", "path", path.rlike(EXAMPLES).alias("is_example"), vendored.alias("is_vendored"), (path.rlike(GENERATED) | vendored).alias("is_generated"), path.rlike(PARSEABLE).alias("is_parseable"), path.rlike(PAGES).alias("is_ui")
    )


def scan_summary(files: DataFrame) -> DataFrame:
    """Files, lines and characters of each repo; a text's lines are its newlines and one."""
    newlines = F.length("content") - F.length(F.replace("content", F.lit("\n")))
    return files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum(newlines + 1).alias("lines"), F.sum(F.length("content")).alias("chars"))


def language_coverage(files: DataFrame) -> DataFrame:
    """(repo, native, percent, unsupported): share of a repo's source files in languages that are analysed (100 without source files), and the other languages, most files first."""
    names = F.create_map(*[F.lit(x) for kv in OTHER_LANGUAGES.items() for x in kv])
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    by = files.groupBy("repo", ext.isin(*NATIVE).alias("own"), F.try_element_at(names, ext).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    other = F.col("language").isNotNull()
    g = by.groupBy("repo").agg(F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("native"), F.sum(F.when(F.col("own") | other, F.col("n")).otherwise(0)).alias("all"), F.array_sort(F.collect_list(F.when(other, F.struct((-F.col("n")).alias("k"), "language")))).alias("u"))
    percent = F.when(F.col("all") == 0, 100).otherwise(S.round_half_up(F.lit(100.0) * F.col("native") / F.col("all")))
    return g.select("repo", "native", percent.cast("int").alias("percent"), F.concat_ws(",", F.transform("u", lambda x: x["language"])).alias("unsupported"))


def todo_counts(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", F.regexp_count("content", F.lit(r"TODO|FIXME|HACK|XXX|WORKAROUND")).cast("long").alias("n")).where("n > 0")


def content_flags(files: DataFrame, flags: dict[str, str]) -> DataFrame:
    """For each flag whether any file of the repo matches its pattern."""
    return files.groupBy("repo").agg(*[F.bool_or(F.col("content").rlike(p)).alias(f) for f, p in flags.items()])


def scan_budget(files: DataFrame, max_file: int, max_total: int, max_files: int) -> DataFrame:
    """(repo, path) kept: files over max_file go; of the others, in path order, each that still fits the repo's budget stays.

    Sizes alone are shuffled; a task reads a repo's files in order and keeps two numbers.
    """

    def run(batches):
        repo, total, n = None, 0, 0
        for rows in batches:
            keep = []
            for r, size in zip(rows["repo"], rows["size"]):
                if r != repo:
                    repo, total, n = r, 0, 0
                fits = n < max_files and total + size <= max_total
                if fits:
                    total, n = total + size, n + 1
                keep.append(fits)
            yield rows[keep][["repo", "path", "size"]]

    small = files.where(F.col("size") <= max_file).select("repo", "path", "size").repartition("repo").sortWithinPartitions("repo", "path")
    return small.mapInPandas(run, "repo string, path string, size long")


def function_names(files: DataFrame) -> DataFrame:
    """Distinct names of functions by the language's patterns."""
    js = F.regexp_extract_all("content", F.lit(r"function\s+([A-Za-z_$][\w$]*)"), F.lit(1))
    py = F.regexp_extract_all("content", F.lit(r"(?m)^\s*def\s+([A-Za-z_]\w*)"), F.lit(1))
    go = F.regexp_extract_all("content", F.lit(r"(?m)^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"), F.lit(1))
    names = F.when(F.col("path").endswith(".py"), py).when(F.col("path").endswith(".go"), go).otherwise(js)
    return files.select("repo", "path", F.explode(F.array_distinct(names)).alias("name"))


def heading_skips(lines: DataFrame) -> DataFrame:
    """Headings more than one level below the heading before, in (repo, path, line, text): of a line the first heading tag, then the first text component with a heading's variant."""
    level = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit("")).cast("int")
    found = F.array_compact(F.array(level(r"<h([1-6])[ >]"), level(r"<(?:Typography|Text)[^>]*variant\s*=\s*['\"]h([1-6])['\"]")))
    h = lines.select("repo", "path", "line", F.posexplode(found).alias("at", "level"))
    w = Window.partitionBy("repo", "path").orderBy("line", "at")
    return h.withColumn("before", F.lag("level").over(w)).where(F.col("level") > F.col("before") + 1).select("repo", "path", "line", "before", "level")


def accessibility_findings(lines: DataFrame) -> DataFrame:
    """All line rules in one projection: an array of rules, exploded."""
    t = F.col("text")
    rules = {
        "img-alt": t.rlike(r"<img\b") & ~t.rlike(r"\balt="), "input-label": t.rlike(r"<input\b") & ~t.rlike(r"aria-label|\bid="), "click-div": t.rlike(r"<(div|span)[^>]*onclick"),
        "tabindex": t.rlike(r"tabindex=.?[1-9]"), "empty-link": t.rlike(r"<a\b[^>]*>\s*</a>"), "generic-link": t.rlike(r">(click here|read more|here)</a>"), "no-lang": t.rlike(r"<html>"),
    }
    hits = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    return lines.select("repo", "path", "line", F.explode(hits).alias("rule"))


# Light colour names, keys beside which a colour is no lone text colour, the luminance above which text is light.
LIGHT_NAMES = {"lightgray": "d3d3d3", "lightgrey": "d3d3d3", "white": "ffffff", "silver": "c0c0c0", "gainsboro": "dcdcdc", "whitesmoke": "f5f5f5", "yellow": "ffff00"}
SIBLINGS = r"(?i)\b(?:text|name|value|label|title|bg|background|backgroundColor|fill|stroke)\s*:"
LIGHT = 0.55


def luminance(hex_digits: Column) -> Column:
    """Relative luminance, from 0 to 1, of a colour of three or six hex digits; null for anything else."""
    h = F.when(hex_digits.rlike("^[0-9a-fA-F]{3}$"), F.regexp_replace(hex_digits, "(.)", "$1$1")).when(hex_digits.rlike("^[0-9a-fA-F]{6}$"), hex_digits)

    def linear(at: int) -> Column:
        c = F.conv(F.substring(h, at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(1) + 0.7152 * linear(3) + 0.0722 * linear(5)


def text_color(line: Column) -> Column:
    """The hex digits of the first `color:` of a line: hex as it is, rgb() and light names translated; null without one."""
    said = lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit(""))
    channel = lambda i: F.regexp_extract(line, r"(?i)\bcolor\s*:\s*['\"]?rgb\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)", i).try_cast("int")
    part = lambda i: F.lpad(F.hex(F.when(channel(i) > 255, 255).otherwise(channel(i))), 2, "0")
    names = F.create_map(*[F.lit(x) for kv in LIGHT_NAMES.items() for x in kv])
    named = F.lower(said(r"(?i)\bcolor\s*:\s*['\"]?([a-z]+)\b(?!\()"))
    return F.coalesce(said(r"(?i)\bcolor\s*:\s*['\"]?#([a-f0-9]{6}|[a-f0-9]{3})\b"), F.concat(part(1), part(2), part(3)), F.try_element_at(names, named))


def a11y_line_findings(lines: DataFrame) -> DataFrame:
    """(repo, path, line, rule, severity): contrast, focus, keyboard, names, loading states and semantics, each line for itself.

    One projection makes all rules of a line, without a shuffle. A null text meets none.
    """
    t = F.col("text")
    has = lambda *words: reduce(lambda a, w: a & F.contains(t, F.lit(w)), words, F.lit(True))
    lacks = lambda *words: reduce(lambda a, w: a & ~F.contains(t, F.lit(w)), words, F.lit(True))
    element, clickable = has("<div") | has("<span"), has("onClick", "div")
    rules = [
        ("low-contrast", "medium", ~t.rlike(SIBLINGS) & (luminance(text_color(t)) > LIGHT)), ("low-contrast-class", "medium", t.rlike(r"text-gray-[34]00\b")),
        ("focus-removed", "medium", has("outline", "none") & lacks("focus")), ("positive-tabindex", "medium", t.rlike(r"tabindex\s*=\s*['\"][1-9]['\"]")),
        ("no-keyboard-handler", "medium", clickable & lacks("onKeyDown", "onKeyPress")), ("click-without-role", "medium", clickable & lacks("role=")),
        ("role-without-name", "medium", (has('role="button"') | has('role="link"')) & lacks("aria-label")),
        ("loading-without-aria", "low", (has("loading") | (has("setState") | has("useState")) & (has("spinner") | has("Skeleton"))) & has("&&") & lacks("aria-live", "aria-busy")),
        ("image-without-alt", "high", (has("<img") | has("<Image")) & lacks("alt=", "{...")), ("empty-alt", "low", has("<img", 'alt=""') & lacks('role="presentation"', "aria-hidden")),
        ("input-without-label", "high", (has("<input") | has("<textarea") | has("<select")) & lacks("aria-label", "placeholder", "hidden", 'type="button"', 'type="submit"', 'type="reset"')),
        ("use-nav", "low", has('role="navigation"') & element), ("use-main", "low", has('role="main"') & element),
    ]
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, c in rules]))
    return lines.select("repo", "path", "line", F.explode(hits).alias("h")).select("repo", "path", "line", "h.*")
