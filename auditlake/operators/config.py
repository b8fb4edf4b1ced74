"""Configuration and markup: Kubernetes documents, API descriptions, workflow files, tags, and counts of endpoints.

Kubernetes documents, API descriptions and workflow files are read by the path of keys that every line of YAML has,
whatever its indent; each entry of a flow mapping or list counts as a line, also where it spans several. Aliases take
the lines of their anchor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import scores as S
from auditlake.sources.store import sorted_side

# Verbs of an API description, endpoint patterns by extension.
VERBS = "get|put|post|delete|options|head|patch|trace"
ENDPOINTS = {
    "js": r"\b(?:app|router|server|fastify)\.(?:get|post|put|patch|delete)\s*\(\s*[\"'`]/", "ts": r"\b(?:app|router|server|fastify)\.(?:get|post|put|patch|delete)\s*\(\s*[\"'`]/",
    "py": r"@\w+\.(?:get|post|put|patch|delete|route)\s*\(", "go": r"\.(?:GET|POST|PUT|PATCH|DELETE|HandleFunc)\s*\(",
}
SECRET_NAMES = ["pass", "secret", "token", "apikey", "api_key", "api-key", "privatekey", "private_key", "private-key", "credential"]
WORKLOADS = ["Deployment", "StatefulSet", "DaemonSet", "Job", "CronJob", "Pod", "ReplicaSet"]


def endpoint_counts(files: DataFrame) -> DataFrame:
    """(repo, endpoints, middleware) by the pattern of each file's language."""
    ext = F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)
    n = F.lit(0)
    for e, p in ENDPOINTS.items():
        n = F.when(ext == e, F.regexp_count("content", F.lit(p))).otherwise(n)
    used = F.regexp_count("content", F.lit(r"\b(?:app|router)\.use\s*\(|\badd_middleware\s*\("))
    return files.groupBy("repo").agg(F.sum(n.cast("long")).alias("endpoints"), F.sum(used.cast("long")).alias("middleware"))


# Words that open template blocks which only control, and the keys of a security context.
CONTROL_WORDS = ["if", "else", "end", "range", "with", "define", "template", "block"]
CONTEXT = ["privileged", "runAsNonRoot", "runAsUser", "allowPrivilegeEscalation"]


def k8s_lines(files: DataFrame) -> DataFrame:
    """(repo, path, doc_no, kind, name, line, keys, value): the lines of YAML documents that have a kind at their root.

    Template control blocks go before the text is read, other templates become a word. name is null without one.
    """
    yaml = files.where(F.col("path").rlike(r"\.ya?ml$") & F.col("content").contains("kind"))
    control = r"\{\{-?\s*(" + "|".join(CONTROL_WORDS) + r")\b[^}]*\}\}"
    plain = F.regexp_replace(F.regexp_replace("content", control, ""), r"\{\{[^}]*\}\}", "template")
    lines = yaml_paths(yaml.select("repo", "path", plain.alias("content"))).withColumnRenamed("doc", "doc_no")
    of_doc = Window.partitionBy("repo", "path", "doc_no")  # no document is larger than its file
    said = lambda *keys: F.max(F.when(F.col("keys") == F.array(*map(F.lit, keys)), F.col("value"))).over(of_doc)
    known = lines.withColumn("kind", F.nullif(said("kind"), F.lit(""))).withColumn("name", F.nullif(said("metadata", "name"), F.lit(""))).where("kind is not null")
    return known.select("repo", "path", "doc_no", "kind", "name", "line", "keys", "value")


def k8s_docs(files: DataFrame) -> DataFrame:
    """(repo, path, doc_no, kind, name): YAML documents with a kind."""
    return k8s_lines(files).groupBy("repo", "path", "doc_no").agg(F.first("kind").alias("kind"), F.first("name").alias("name"))


def k8s_facts(files: DataFrame) -> DataFrame:
    """What the Kubernetes rules ask, one row for each container, each rule of a role, and the rest of each document.

    unit tells the three apart ('containers/0', 'initContainers/1', 'rules/2', ''). A workload is a document of a
    workload kind with a pod's spec, which CronJob, Pod and the others keep in different places. A container's security
    context goes before its pod's, key by key. Documents without a kind give no rows.
    """
    lines = k8s_lines(files)
    kind, value = F.col("kind"), F.col("value")
    path = lambda text: F.array(*map(F.lit, text.split()))
    spec = F.when(kind == "Pod", path("spec")).when(kind == "CronJob", path("spec jobTemplate spec template spec")).otherwise(path("spec template spec"))
    inside = kind.isin(*WORKLOADS) & (F.slice("keys", 1, F.size(spec)) == spec)
    lines = lines.withColumn("pod", F.when(inside, F.slice("keys", F.size(spec) + 1, 64)))
    pod, given = F.col("pod"), ~value.isin("", "null", "~")
    of_doc = Window.partitionBy("repo", "path", "doc_no")
    in_pod = lambda text: F.max(F.when(pod == path(text), value)).over(of_doc)
    lines = lines.withColumns({"workload": F.coalesce(F.max(pod.isNotNull() & ((F.size("pod") > 0) | given)).over(of_doc), F.lit(False)), "token": in_pod("automountServiceAccountToken"), **{f"pod_{k}": in_pod(f"securityContext {k}") for k in CONTEXT}})
    held = F.get("pod", F.lit(0)).isin("containers", "initContainers") & (F.size("pod") >= 2)
    role = kind.isin("Role", "ClusterRole") & (F.get("keys", F.lit(0)) == "rules") & (F.size("keys") >= 2)
    unit = F.when(held, F.concat_ws("/", F.slice("pod", 1, 2))).when(role, F.concat_ws("/", F.slice("keys", 1, 2))).otherwise("")
    own = F.when(held, F.slice("pod", 3, 64))
    said = lambda text: F.max(F.when(own == path(text), value))
    has = lambda *of: F.coalesce(F.bool_or(F.get(own, F.lit(0)).isin(*of) & ((F.size(own) > 1) | given)), F.lit(False))
    limits = F.coalesce(F.bool_or((F.get(own, F.lit(0)) == "resources") & F.get(own, F.lit(1)).isin("limits", "requests") & ((F.size(own) > 2) | given)), F.lit(False))
    secret = F.get("keys", F.lit(0)).isin("data", "stringData") & F.exists(F.array(*map(F.lit, SECRET_NAMES)), lambda n: F.contains(F.lower(F.get("keys", F.lit(1))), n))
    wild = role & F.get("keys", F.lit(2)).isin("verbs", "resources") & (F.size("keys") == 4) & (value == "*")
    return lines.withColumn("unit", unit).groupBy("repo", "path", "doc_no", "unit").agg(
        *[F.first(c).alias(c) for c in ("kind", "name", "workload", "token")],
        *[F.coalesce(said(f"securityContext {k}"), F.first(f"pod_{k}")).alias(k) for k in CONTEXT],
        said("name").alias("container"), said("image").alias("image"), limits.alias("limits"), has("livenessProbe", "readinessProbe").alias("probes"),
        F.coalesce(F.bool_or((F.size(own) > 0) | F.startswith("value", F.lit("{"))), F.lit(False)).alias("object"),
        F.min_by(F.when(secret, F.get("keys", F.lit(1))), F.when(secret, F.struct(F.get("keys", F.lit(0)).alias("of"), "line"))).alias("secret"), F.coalesce(F.bool_or(wild), F.lit(False)).alias("wild"),
    )


def k8s_findings(facts: DataFrame) -> DataFrame:
    """(repo, path, doc_no, unit, rule, severity, subject) by k8s_facts(); one network-policy row (path null) for a repo with workloads and no policy."""
    of_container = F.col("workload") & F.col("unit").rlike("^(containers|initContainers)/") & F.col("object")
    of_doc = F.col("unit") == ""
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    image = F.col("image")
    named = F.coalesce("container", F.lit("container"))
    rules = [
        (F.col("wild"), "wildcard-rbac", F.when(F.col("kind") == "ClusterRole", "high").otherwise("medium"), F.col("name")),
        (of_doc & (F.col("kind") == "ConfigMap") & F.col("secret").isNotNull(), "secret-in-configmap", F.lit("high"), F.col("secret")),
        (of_doc & F.col("workload") & ~is_("token", "false"), "service-account-token", F.lit("low"), F.coalesce("name", "kind")),
        (of_container & is_("privileged", "true"), "privileged", F.lit("critical"), named),
        (of_container & ~is_("runAsNonRoot", "true") & ~F.coalesce(F.col("runAsUser").rlike(r"^\d+$"), F.lit(False)), "runs-as-root", F.lit("medium"), named),
        (of_container & ~is_("allowPrivilegeEscalation", "false"), "privilege-escalation", F.lit("low"), named),
        (of_container & ~F.col("limits"), "no-resources", F.lit("medium"), named), (of_container & ~F.col("probes"), "no-probes", F.lit("medium"), named),
        (of_container & (image != "") & (image.endswith(":latest") | ~image.contains(":")), "mutable-image", F.lit("low"), named),
    ]
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), s.alias("severity"), n.alias("subject"))) for c, r, s, n in rules]))
    each = facts.select("repo", "path", "doc_no", "unit", F.explode(hits).alias("h")).select("repo", "path", "doc_no", "unit", "h.*")
    open_net = facts.groupBy("repo").agg(F.bool_or("workload").alias("w"), F.bool_or(F.col("kind") == "NetworkPolicy").alias("p")).where("w and not p")
    return each.unionByName(open_net.select("repo", F.lit("no-network-policy").alias("rule"), F.lit("medium").alias("severity")), allowMissingColumns=True)


def k8s_report(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo, applicable, manifests, documents, kinds, findings, score) for every repo of files; without a manifest not applicable and 0.

    kinds: 'Kind:count' in order of the kind, comma-joined.
    """
    docs = facts.groupBy("repo", "path", "doc_no").agg(F.first("kind").alias("kind"))
    by_kind = docs.groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = by_kind.groupBy("repo").agg(F.sum("n").alias("documents"), F.array_sort(F.collect_list(F.concat_ws(":", "kind", "n"))).alias("kinds"))
    manifests = docs.select("repo", "path").distinct().groupBy("repo").agg(F.count(F.lit(1)).alias("manifests"))
    scored = k8s_findings(facts).groupBy("repo").agg(F.count(F.lit(1)).alias("findings"), F.sum(S.penalty_hundredths(F.col("severity"))).alias("p"))
    both = files.select("repo").distinct()
    for side in (manifests, kinds, scored):
        both = both.join(sorted_side(side), "repo", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    applies = F.col("manifests").isNotNull()
    score = F.when(applies, S.curve(zero("p"), 6)).otherwise(0)
    return both.select("repo", applies.alias("applicable"), *[zero(c).alias(c) for c in ("manifests", "documents")], F.coalesce(F.concat_ws(",", "kinds"), F.lit("")).alias("kinds"), zero("findings").alias("findings"), score.alias("score"))


KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s#"'\[\]{},&*!|>%@`-][^#]*?|-[^\s#:][^#:]*))\s*:(?=\s|$)\s*""")


FLOW = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')|([\[\]{},])|(:)(?=[\s,\[\]{}]|$)|((?:[^\[\]{},:"']|:(?![\s,\[\]{}]|$)|(?<=[\w.-])["'])+)""")
FLOW_DEPTH = 64
BATCH_LINES = 10_000  # rows of an Arrow batch that a task hands over
NESTED = "\0"  # stands for a nested mapping or list whose entries are out


def _flow_open(line: str, depth: int, quote: str) -> tuple[str, int, str]:
    """The line without its comment, and the brackets and the quote left open after it, given those before it."""
    for m in re.finditer(r"""\\.|[\[\]{}"']|(?<!\S)#""", line):
        c = m[0]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = "" if re.match(r"[\w.-]", line[m.start() - 1 : m.start()]) else c
        elif c == "#":
            return line[: m.start()], depth, quote
        elif len(c) == 1:
            depth += 1 if c in "[{" else -1
            if depth == 0:
                break
    return line, depth, quote


def _flow_entries(text: str) -> Iterator[tuple[list[str], str]]:
    """(keys, value) of each entry of a flow mapping or list, those of nested ones too; a nested one's own value is its bracket."""
    frames: list[list] = []  # [is it a list, key or number, scalar not yet given out]
    above = lambda: [str(f[1]) for f in frames[:FLOW_DEPTH]]
    quoted_key = False
    for m in FLOW.finditer(text):
        quoted, mark, colon, plain = m.groups()
        if plain is not None and quoted_key and plain.startswith(":"):  # "key":value
            colon, plain = ":", plain[1:]
        quoted_key = quoted is not None
        if mark is not None and mark in "[{":
            if frames:
                frames[-1][1] = "" if frames[-1][1] is None else frames[-1][1]
                yield above(), mark
                frames[-1][2] = None
            frames.append([mark == "[", 0 if mark == "[" else None, None])
        elif not frames:
            return
        elif mark is not None:
            is_list, key, scalar = frames[-1]
            if is_list and scalar is not None:
                yield above(), scalar
            elif not is_list and (scalar is not None or key is not None):
                if key is None:
                    frames[-1][1], scalar = scalar, ""
                if scalar != NESTED:
                    yield above(), scalar or ""
            if mark == ",":
                frames[-1][1:] = [key + 1, None] if is_list else [None, None]
                continue
            frames.pop()
            if not frames:
                return
            frames[-1][2] = None if frames[-1][0] else NESTED
        if colon is not None and not frames[-1][0]:
            frames[-1][1:] = [frames[-1][2] or "", None]
        scalar = quoted[1:-1] if quoted is not None else plain.strip() if plain is not None else ""
        if scalar or quoted is not None:
            frames[-1][2] = scalar


def _key_lines(text: str) -> Iterator[tuple]:
    """(line, doc, keys, value, anchor, alias) of each line of YAML that says something; items of lists are numbered keys.

    A line's keys are those of the stack of lines that enclose it, each deeper than the one before. Lines of a block
    scalar (| or >) have its keys and their own text.
    """
    stack: list[list] = []  # [indent, key, number of the last item below]
    doc, scalar = 0, None
    flow: list[str] = []  # lines of a flow mapping or list that is still open
    depth, quote = 0, ""
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.rstrip()
        body = line.lstrip(" \t")
        indent = len(line) - len(body)
        if depth > 0 and not body.startswith("---"):
            body, depth, quote = _flow_open(body, depth, quote)
            flow.append(body)
            if depth <= 0:
                yield from ((start, doc, [*keys, *more], value, None, None) for more, value in _flow_entries(" ".join(flow)))
            continue
        depth = 0
        if scalar is not None and (not body or indent > scalar):
            if body:
                yield n, doc, [k for _, k, _ in stack], body, None, None
            continue
        scalar = None
        if body == "---" or body.startswith("--- "):
            doc, stack = doc + 1, []
            continue
        if not body or body[0] == "#":
            continue
        while body == "-" or body.startswith("- "):
            while stack and (stack[-1][0] > indent or stack[-1][0] == indent and stack[-1][1].isdigit() and stack[-1][2] is None):
                stack.pop()
            above = stack[-1] if stack else [-1, "", -1]
            above[2] = -1 if above[2] is None else above[2]
            above[2] += 1
            stack.append([indent, str(above[2]), None])
            rest = body[1:].lstrip(" ")
            indent, body = indent + len(body) - len(rest), rest
        m = KEY.match(body)
        if m:
            while stack and stack[-1][0] >= indent:
                stack.pop()
            stack.append([indent, next(g for g in m.groups() if g is not None), -1])
            body = body[m.end() :]
        anchor = re.match(r"&(\S+)\s*", body)
        body = body[anchor.end() :] if anchor else body
        if re.match(r"[|>][+-]?\d?\s*(#.*)?$", body):
            scalar, body = stack[-1][0] if stack else 0, ""
        alias = re.match(r"\*(\S+)$", body)
        quoted = re.match(r"""(["'])(.*)\1$""", body)
        value = quoted[2] if quoted else re.sub(r"\s+#.*$", "", body)
        keys = [k for _, k, _ in stack]
        yield n, doc, keys, value, anchor[1] if anchor else None, alias[1] if alias else None
        if body[:1] in ("{", "["):
            body, depth, quote = _flow_open(body, 0, "")
            start, flow = n, [body]
            if depth <= 0:
                yield from ((n, doc, [*keys, *more], value, None, None) for more, value in _flow_entries(body))


def yaml_paths(files: DataFrame, max_depth: int = 64) -> DataFrame:
    """(repo, path, doc, line, keys, value): the keys that lead to each line of the given YAML files; see _key_lines().

    An alias, also one that is merged ('<<: *name'), brings in the lines below its anchor under the keys where it
    stands; aliases inside those lines stay as they are. Files without contents give no rows; deeper lines than
    max_depth keys have only the first that many. A file is read once, by one task, which holds its lines.
    """
    kinds = [("repo", pa.string()), ("path", pa.string()), ("doc", pa.int32()), ("line", pa.int32()), ("keys", pa.list_(pa.string())), ("value", pa.string())]

    def run(batches):
        for batch in batches:
            rows = []
            for repo, path, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for row in _with_aliases([(n, doc, keys[:max_depth], *more) for n, doc, keys, *more in _key_lines(text)]):
                    rows.append((repo, path, *row))
                    if len(rows) >= BATCH_LINES:
                        yield _batch(rows, kinds)
                        rows = []
            if rows:
                yield _batch(rows, kinds)

    return files.where("content is not null").select("repo", "path", "content").mapInArrow(run, "repo string, path string, doc int, line int, keys array<string>, value string")


def _batch(rows: list[tuple], kinds: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])


def _with_aliases(lines: list[tuple]) -> Iterator[tuple]:
    """(doc, line, keys, value) of a file's _key_lines(), and of the lines that its aliases bring in."""
    roots: dict[tuple, list[list[str]]] = {}
    for _, doc, keys, _, anchor, _ in lines:
        if anchor is not None:
            roots.setdefault((doc, anchor), []).append(keys)
    for n, doc, keys, value, _, _ in lines:
        yield doc, n, keys, value
    below: dict[tuple, list[tuple]] = {}  # lines below an anchor that an alias names, found once
    for use, doc, keys, _, _, alias in lines:
        for root in roots.get((doc, alias), []) if alias is not None else []:
            at = (doc, *root)
            if at not in below:
                below[at] = [(k[len(root) :], v) for _, d, k, v, _, _ in lines if d == doc and len(k) > len(root) and k[: len(root)] == root]
            under = keys[:-1] if keys and keys[-1] == "<<" else keys
            for rest, value in below[at]:
                yield doc, use, under + rest, value


def openapi_endpoints(files: DataFrame) -> DataFrame:
    """(repo, path, method, route) of API descriptions with an openapi or swagger root: JSON by schema, YAML by the keys of its lines."""
    f = files.where(F.col("path").rlike(r"(?i)(openapi|swagger)[^/]*\.(json|ya?ml)$"))
    j = f.where(F.col("path").endswith(".json")).select("repo", "path", F.from_json("content", "openapi string, swagger string, paths map<string,map<string,string>>").alias("j")).where("j.openapi is not null or j.swagger is not null")
    a = j.select("repo", "path", F.explode("j.paths").alias("route", "m")).select("repo", "path", "route", F.explode(F.map_keys("m")).alias("method"))
    y = yaml_paths(f.where(~F.col("path").endswith(".json") & F.col("content").rlike(r"(?m)^[\"']?(openapi|swagger)[\"']?\s*:")))
    b = y.where((F.size("keys") >= 3) & (F.col("keys")[0] == "paths") & F.col("keys")[1].startswith("/")).select("repo", "path", F.col("keys")[1].alias("route"), F.col("keys")[2].alias("method"))
    return a.union(b).where(F.lower("method").rlike(f"^({VERBS})$")).select("repo", "path", F.upper("method").alias("method"), "route").distinct()


DEPLOYS, CHECKS_TYPES = r"(?i)deploy|publish|release", r"(?i)\btsc\b|type-?check|\bmypy\b|pyright"


def _workflow_lines(files: DataFrame) -> DataFrame:
    y = yaml_paths(files.where(F.col("path").rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$"))).where((F.size("keys") >= 2) & (F.col("keys")[0] == "jobs"))
    last = F.element_at("keys", -1)
    text = F.concat_ws(" ", F.when(~last.rlike(r"^\d+$"), last), "value")
    return y.select("repo", "path", F.col("keys")[1].alias("job"), "keys", "value", F.col("line").alias("line"), text.rlike(DEPLOYS).alias("deploys"), text.rlike(CHECKS_TYPES).alias("type_checks"))


def ci_jobs(files: DataFrame) -> DataFrame:
    """(repo, path, job, deploys, type_checks) of workflow files: whether any line of the job says so."""
    return _workflow_lines(files).groupBy("repo", "path", "job").agg(F.bool_or("deploys").alias("deploys"), F.bool_or("type_checks").alias("type_checks"))


def ci_steps(files: DataFrame) -> DataFrame:
    """(repo, path, job, step, name, uses, deploys, type_checks): the steps of each job, numbered from 0, with all lines of their scripts."""
    lines = _workflow_lines(files).where((F.size("keys") >= 4) & (F.col("keys")[2] == "steps") & F.col("keys")[3].rlike(r"^\d{1,9}$"))
    said = lambda key: F.max(F.when(F.element_at("keys", -1) == key, F.col("value")))
    return lines.groupBy("repo", "path", "job", F.col("keys")[3].cast("int").alias("step")).agg(said("name").alias("name"), said("uses").alias("uses"), F.bool_or("deploys").alias("deploys"), F.bool_or("type_checks").alias("type_checks"))


def jsx_a11y_findings(files: DataFrame) -> DataFrame:
    """(repo, path, rule, n): tag rules on JSX, each tag read with its attributes."""
    tags = F.regexp_extract_all("content", F.lit(r"<((?:img|button|a|input|div|span|li)\b(?:\{[^}]*\}|=>|[^>{])*>(?:\s*</(?:button|a)>)?)"), F.lit(1))
    t = F.col("t")
    named = t.rlike(r"aria-label|aria-labelledby|title=")
    rule = F.array_compact(F.array(
        F.when(t.rlike(r"^img\b") & ~t.rlike(r"\balt="), F.lit("img-no-alt")), F.when(t.rlike(r"^(button|a)\b.*\s*</(button|a)>$") & ~named, F.lit("no-name")),
        F.when(t.rlike(r"target=[\"']_blank") & ~t.rlike("noopener|noreferrer"), F.lit("blank-no-opener")), F.when(t.rlike(r"^input\b") & ~t.rlike("aria-label|\\bid=|type=[\"'](hidden|submit)"), F.lit("input-no-label")),
        F.when(t.rlike(r"^(div|span|li)\b") & t.rlike("onClick=") & ~t.rlike("role="), F.lit("click-no-role")), F.when(t.rlike(r"aria-\w+=([\"']{2}|\{\s*[\"']{2}\s*\})"), F.lit("empty-aria")),
    ))
    ui = files.where(F.col("path").rlike(r"\.(jsx|tsx)$")).select("repo", "path", F.explode(tags).alias("t"))
    return ui.select("repo", "path", F.explode(rule).alias("rule")).groupBy("repo", "path", "rule").agg(F.count(F.lit(1)).alias("n"))


def a11y_score(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, score): findings over the square root of UI files on the count curve, 10 more where aria is used; null without UI files."""
    ui = F.col("path").rlike(r"\.(jsx|tsx|html|vue|svelte)$")
    by = files.groupBy("repo").agg(F.count_if(ui).alias("ui"), F.bool_or(ui & F.col("content").contains("aria-")).alias("aria"))
    n = findings.groupBy("repo").agg(F.count(F.lit(1)).alias("issues"))
    both = by.join(n, "repo", "left").fillna(0, ["issues"])
    score = F.least(F.lit(100), S.count_score(F.col("issues") / F.sqrt(F.col("ui"))) + F.when(F.col("aria"), 10).otherwise(0))
    return both.select("repo", F.when(F.col("ui") > 0, score).alias("score"))
