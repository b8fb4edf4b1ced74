"""One linear pass over the tokens of a JavaScript or TypeScript text, with a stack of open brackets and no grammar.

Every open bracket keeps counts of what encloses it and, for its current argument, what flows into it, so that a token
and a closing bracket cost the same at any depth. Rows hold offsets; texts of arguments are cut by those who ask.

A flow is three bit sets: what reaches a value as it is, through a call, through a call that makes it safe. Bit 0 stands
for data of a request, the others for the parameters of the enclosing functions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

# Calls whose result is safe, by whole name or last segment; array methods whose callback repeats; where data of a request stand.
SANITIZERS = {
    "sanitize", "sanitizeHtml", "sanitize_html", "purify", "DOMPurify.sanitize", "escape", "escapeHtml", "escape_html", "he.encode", "xss", "path.normalize", "path.basename",
    "parseInt", "parseFloat", "Number", "Math.floor", "Math.ceil", "Math.round", "encodeURIComponent", "encodeURI", "includes", "has", "indexOf", "startsWith", "endsWith",
}
REPEATING = {"forEach", "map", "filter", "reduce", "some", "every", "find", "flatMap"}
REQUESTS = {"req", "request", "ctx", "event"}
OTHER_SOURCE = re.compile(r"\b(?:process\.argv|(?:window|document)\.location|searchParams)\b")

TOKEN = re.compile(
    r"\n|//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|[A-Za-z_$][\w$]*(?:(?:\?\.|\.)[A-Za-z_$][\w$]*)*"
    r"|\d[\w.]*|=>|===|!==|==|!=|&&|\|\||\?\?|\?\.|[^\s]", re.S,
)
NAME = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\?\.|\.)[A-Za-z_$][\w$]*)*\s*\(?")
MARK = re.compile(r"(?P<guarded>(?i:auth|guard|protect|verify|session|passport|require\w+|csrf))|(?P<secret>\b(?i:password|passwordHash|secret|apiKey|privateKey|ssn)\b)|(?P<nan>\bisNaN\b)|(?P<asserts>\b(?:expect|assert|should)\b)|(?P<idempotency>(?i:idempotency-key))")
BEFORE_PAREN = {"if", "for", "while", "switch", "catch", "return", "typeof", "function", "await", "new", "in", "of", "case", "with", "do", "else", "void", "delete", "throw", "yield", "async"}
NO_VALUE = BEFORE_PAREN | {"const", "let", "var", "class", "import", "export", "default", "from", "try", "finally", "this", "true", "false", "null", "undefined"}
OPENS = {"for": "loop", "while": "loop", "do": "loop", "try": "try", "switch": "switch", "catch": "catch", "class": "class"}
ROUTE = re.compile(r"(?:app|router|server|fastify)\.(?:get|post|put|patch|delete|all|use)$")
TESTS = {"it", "test", "it.only", "test.only", "it.skip", "test.skip", "xit", "xtest", "fit"}
CONTINUES = set("+-*/%=?:,.&|<>([{!~^") | {"=>", "==", "===", "!=", "!==", "&&", "||", "??", "?.", "return", "in", "of", "typeof", "await", "new", "const", "let", "var"}
CONTINUED = set("+-*/%=?:,.&|<>)]}([{") | {"=>", "==", "===", "!=", "!==", "&&", "||", "??", "?.", "in", "of", "instanceof"}
NOTHING = (0, 0, 0)
LEVELS = ("direct", "derived", "safe")
CLOSES = {")": "(", "]": "[", "}": "{"}


def _either(a, b):
    return b if a is NOTHING else a if b is NOTHING else (a[0] | b[0], a[1] | b[1], a[2] | b[2])


def _quoted(token: str) -> bool:
    return token[:1] in ("'", '"', "`")


def _is_safe(name: str) -> bool:
    return name in SANITIZERS or name.rsplit(".", 1)[-1] in SANITIZERS


def _after_call(name: str, flow):
    """The flow of a call's result from that of its arguments and its object."""
    if flow is NOTHING or name == "JSON.parse" or name.endswith(".get"):
        return flow
    every = flow[0] | flow[1] | flow[2]
    return (0, 0, every) if _is_safe(name) else (0, flow[0] | flow[1], flow[2])


class _Function:
    __slots__ = ("name", "cc", "line", "base", "params", "outer", "own")

    def __init__(self, name, line, params, outer):
        self.name, self.line, self.params, self.outer, self.cc, self.own = name, line, params, outer, 1, []
        self.base = outer.base + len(outer.params) if outer else 1


class _Argument:
    __slots__ = ("first", "named", "count", "concat", "cleaned", "flow")

    def __init__(self):
        self.first, self.named, self.count, self.concat, self.cleaned, self.flow = "", None, 0, False, False, NOTHING

    def kind(self) -> str:
        f = self.first
        if not f:
            return "none"
        if f[0] == "`":
            return "template" if "${" in f else "literal"
        if self.concat:
            return "concat"
        return "literal" if f[0] in "\"'" or f[0].isdigit() else "ident" if self.count == 1 and (f[0].isalpha() or f[0] in "_$") else "other"


class _Open:
    """An open bracket, or the body of an arrow function without one."""

    __slots__ = ("char", "kind", "name", "pos", "start", "fn", "loops", "alls", "tries", "routes", "args", "now", "marks", "guard", "sealed", "tokens", "inside", "bodies", "arrow", "four", "assign", "at", "key", "case")

    def __init__(self, char, kind, name, pos, start, fn, up=None):
        self.char, self.kind, self.name, self.pos, self.start, self.fn = char, kind, name, pos, start, fn
        self.loops, self.alls, self.tries, self.routes = (up.loops, up.alls, up.tries, up.routes) if up else (0, 0, 0, 0)
        self.args, self.now, self.marks, self.guard, self.sealed = [], _Argument(), set(), [False, False], False
        self.tokens = self.inside = self.bodies = 0
        self.arrow = self.four = self.case = False
        self.assign, self.at, self.key = "", 0, ""


class _Scan:
    def __init__(self, text: str):
        self.text, self.rows, self.seen, self.values = text, [], set(), {}
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.tokens = []
        fresh = False
        for m in TOKEN.finditer(text):
            t = m.group()
            if t == "\n" or t.startswith(("//", "/*")):
                fresh = fresh or "\n" in t
            else:
                self.tokens.append((t, m.start(), fresh))
                fresh = False
        self.words = ["", "", "", *(t for t, _, _ in self.tokens), "", "", ""]
        self.stack = [_Open("", "block", "", 0, 0, _Function("", 1, [], None))]
        self.closed = None  # the last parentheses that closed: their arguments name an arrow function's parameters

    def line(self, pos: int) -> int:
        return bisect_right(self.starts, pos)

    def row(self, kind: str, begin: int, **more) -> None:
        line = self.line(begin)
        self.rows.append({"kind": kind, "line": line, "col": begin - self.starts[line - 1]} | more)

    def token(self, k: int) -> str:
        """The k-th token; '' beside the text's, up to three away."""
        return self.words[k + 3]

    def flow_of(self, name: str):
        root, _, rest = name.replace("?.", ".").partition(".")
        if rest and root in REQUESTS or OTHER_SOURCE.search(name):
            return (1, 0, 0)
        known = self.values.get(root)
        return known[-1][1] if known else NOTHING

    def template_flow(self, t: str):
        """What the holes of a template literal bring in."""
        flow = NOTHING
        for hole in re.findall(r"\$\{([^}]*)\}", t):
            inner, calls = NOTHING, []
            for m in NAME.finditer(hole):
                name = m.group()
                calls += [name[:-1].strip()] * name.endswith("(")
                inner = _either(inner, NOTHING if name.endswith("(") else self.flow_of(name.strip()))
            for name in calls:
                inner = _after_call(name, inner)
            flow = _either(flow, inner)
        return flow

    def assign(self, fn: _Function, name: str, flow, shadow: bool = False) -> None:
        if flow is NOTHING and not shadow:
            return
        known = self.values.setdefault(name, [])
        if known and known[-1][0] is fn:
            known[-1] = (fn, _either(known[-1][1], flow))
        else:
            known.append((fn, flow))
            fn.own.append(name)

    def assigned(self, o: _Open) -> None:
        """What the statement's assignment, if it is one, means for its target."""
        if not o.assign:
            return
        self.assign(o.fn, o.assign, o.now.flow)
        if o.assign.rsplit(".", 1)[-1] in ("innerHTML", "outerHTML"):
            level = next((name for name, bits in zip(LEVELS, o.now.flow) if bits & 1), None)
            self.row("misc", o.at, name="markup", value=o.assign, arg_kind=o.now.kind(), taint=level is not None, level=level, sanitized=o.now.cleaned, func=o.fn.name)

    def settle(self, o: _Open) -> None:
        """Ends a statement of this bracket."""
        self.assigned(o)
        o.assign, o.now = "", _Argument()

    def open_function(self, char: str, pos: int, params: list[str], name: str | None) -> None:
        up = self.stack[-1]
        own = (up.assign or up.key) if name is None else name
        fn = _Function(own.rsplit(".", 1)[-1], self.line(pos), params, up.fn)
        for i, p in enumerate(params):
            self.assign(fn, p, (1 << (fn.base + i), 0, 0), shadow=True)
        if not up.args and up.now.count == 0 or up.kind == "call" and not up.args:
            up.four = len(params) == 4 and all(params)
        self.stack.append(_Open(char, "function" if char else "arrow", own, pos, pos, fn, up))

    def close_function(self, o: _Open) -> None:
        self.row("function", o.start, name=o.fn.name, cc=o.fn.cc, n_args=len(o.fn.params))
        self.rows[-1]["line"] = o.fn.line
        for name in o.fn.own:
            self.values[name].pop()

    def pop(self, end: int, after: str) -> None:
        """Closes the innermost bracket and passes on to the one around it what counts there too."""
        o = self.stack.pop()
        up = self.stack[-1]
        if o.now.count or o.args:
            o.args.append(o.now)
        self.assigned(o)
        flow = NOTHING
        for a in o.args:
            flow = _either(flow, a.flow)
        method = o.kind == "call" and after == "{"
        if o.kind == "call" and not method:
            base = self.flow_of(o.name.rpartition(".")[0].removesuffix("?")) if "." in o.name else NOTHING
            self.call(o, up, end)
            flow = _after_call(o.name, _either(flow, base))
        elif o.kind in ("function", "arrow"):
            self.close_function(o)
        elif o.kind == "switch" and not o.case:
            self.row("misc", o.start, name="switch-no-default", value="")
        if o.char == "(":
            self.closed = o
        if o.kind in ("function", "arrow", "params", "head") or method or o.char == "(" and after == "=>":
            flow = NOTHING
        up.now.flow = _either(up.now.flow, flow)
        up.now.count += 1
        up.now.concat = up.now.concat or any(a.concat for a in o.args)
        up.now.cleaned = up.now.cleaned or any(a.cleaned for a in o.args) or o.kind == "call" and _is_safe(o.name)
        up.marks |= o.marks
        if not up.sealed:
            up.guard[bool(up.args)] |= o.guard[0] or o.guard[1]
        up.sealed = up.sealed or o.sealed
        up.tokens += o.tokens + 1
        up.inside += o.inside + (o.tokens if o.char == "{" else 0)
        up.bodies += o.bodies + (o.char == "{")
        up.arrow = up.arrow or o.arrow

    def call(self, o: _Open, up: _Open, end: int) -> None:
        first = o.args[0] if o.args else _Argument()
        marks = set(o.marks) - {"guarded"} | ({"guarded"} if o.guard[1] and _quoted(first.first) else set()) | ({"four"} if o.four else set())
        level = next((name for name, bits in zip(LEVELS, first.flow) if bits & 1), None)
        where = {"name": o.name, "n_args": len(o.args), "pos": o.pos, "end": end}
        self.row(
            "call", o.start, **where, value=first.first if _quoted(first.first) else None, arg_kind=first.kind(), taint=level is not None, level=level, sanitized=first.cleaned,
            in_loop=up.loops > 0, in_all=up.alls > 0, in_try=up.tries > 0, in_handler=up.routes > 0, func=up.fn.name, marks=sorted(marks),
        )
        if o.name in TESTS:
            title = first.first[1:-1] if _quoted(first.first) else ""
            self.row("test", o.start, name=title, value=o.name, taint="asserts" in o.marks, sanitized=o.arrow and o.bodies > 0 and o.inside == 0)
        for i, a in enumerate(o.args):
            if not (a.flow[0] | a.flow[1] | a.flow[2]) & 1 and a.kind() in ("template", "concat"):
                self.row("flow", o.start, name=o.name, n_args=len(o.args), arg=i, level="built")
            for level, bits in zip(LEVELS, a.flow):
                if bits & 1:
                    self.row("flow", o.start, name=o.name, n_args=len(o.args), arg=i, level=level)
                fn = up.fn
                while bits > 1 and fn is not None:
                    own, bits = bits >> fn.base, bits & ((1 << fn.base) - 1)
                    if fn.name:
                        for p in range(len(fn.params)):
                            if own >> p & 1:
                                self.row("flow", o.start, name=o.name, n_args=len(o.args), arg=i, level=level, func=fn.name, param=p)
                    fn = fn.outer

    def read(self) -> list[dict]:
        pending = None
        for k, (t, start, fresh) in enumerate(self.tokens):
            before, after, o = self.words[k + 2], self.words[k + 4], self.stack[-1]
            if fresh and before not in CONTINUES and t not in CONTINUED:
                while o.kind == "arrow" and self.stack[-2].char in ("{", ""):
                    self.pop(start, t)
                    o = self.stack[-1]
                if o.char in ("{", "") and o.kind != "arrow":
                    self.settle(o)
            word = t[0].isalpha() or t[0] in "_$"
            if t in ")]},;":
                while o.kind == "arrow":
                    self.pop(start, t)
                    o = self.stack[-1]
            if t in ")]}" and len(self.stack) > 1:
                while len(self.stack) > 2 and self.stack[-1].char != CLOSES[t]:  # an unclosed bracket of another kind
                    self.pop(start, t)
                self.pop(start, after)
                continue
            if t == "," or t == ";":
                if t == "," and o.kind in ("call", "group", "params", "head"):
                    o.args.append(o.now)
                    o.now = _Argument()
                elif t == ";" or o.assign and o.char in ("{", ""):
                    self.settle(o)
                o.tokens += 1
                continue
            now = o.now
            if not now.first and t not in "([{.":
                now.first = t
            elif not now.first and t != ".":
                now.first = t
            if now.named is None and t != ".":
                now.named = t if word and t not in NO_VALUE else ""
            o.tokens += 1
            if word:
                self.word(k, t, start, before, after, o, now)
                if t == "function":
                    pending = ("function", after if after != "(" and after != "*" else self.token(k + 2) if after == "*" and self.token(k + 2) != "(" else None)
                elif t in OPENS:
                    pending = OPENS[t]
            elif _quoted(t):
                now.count += 1
                self.marked(o, t)
                if t[0] == "`":
                    now.flow = _either(now.flow, self.template_flow(t))
                if before == "+":
                    now.concat = True
                if before == ":" and t[1:2] == "*" and self.token(k - 2) == "origin":
                    o.marks.add("wild-origin")
            elif t in ("&&", "||", "??", "?", "?."):
                o.fn.cc += 1
                now.count += 1
            elif t in ("==", "!="):
                now.count += 1
                if not {"null", "undefined"} & {before, after}:
                    self.row("misc", start, name="loose-equality", value=f"{before[:30]} {t} {after[:30]}")
            elif t == "=>":
                o.arrow = o.sealed = True
                single = before and (before[0].isalpha() or before[0] in "_$") and before != "async"
                params = [before] if single else [a.named or "" for a in self.closed.args] if before == ")" and self.closed else []
                if after == "{":
                    pending = ("body", params)
                elif after:
                    self.open_function("", start + 2, params, None)
            elif t == "(":
                self.parenthesis(k, start, before, o)
            elif t == "{":
                o.sealed = True
                self.brace(k, start, before, o, pending)
                pending = None
            elif t == "[":
                self.stack.append(_Open("[", "list", "", start + 1, start, o.fn, o))
            else:
                now.count += 1
                if t == "+" and _quoted(before):
                    now.concat = True
                if t in "=>":
                    o.sealed = True
        while len(self.stack) > 1:
            self.pop(len(self.text), "")
        self.settle(self.stack[0])
        return self.rows + [{"kind": "ident", "line": 0, "name": w} for w in sorted(self.seen)]

    def marked(self, o: _Open, t: str) -> None:
        for m in MARK.finditer(t):
            if m.lastgroup != "guarded":
                o.marks.add(m.lastgroup)
            elif not o.sealed:
                o.guard[bool(o.args)] = True

    def word(self, k: int, t: str, start: int, before: str, after: str, o: _Open, now: _Argument) -> None:
        now.count += 1
        self.seen.update(t.replace("?.", ".").split("."))
        self.marked(o, t)
        if t in ("if", "for", "while", "catch", "case"):
            o.fn.cc += 1
        if "?." in t:
            o.fn.cc += t.count("?.")
        if t == "default" and o.kind == "switch":
            o.case = True
        if t == "true" and before == ":" and self.token(k - 2) in ("origin", "credentials"):
            o.marks.add("wild-origin" if self.token(k - 2) == "origin" else "credentials")
        if t == "Date" and before == "new" and after == "(" and self.token(k + 2) not in (")", ""):
            self.row("misc", start, name="new-date", value=self.token(k + 2)[:80])
        if t in ("typeof", "Array.isArray", "Number.isFinite", "Number.isInteger", "Number.isNaN", "isNaN"):
            self.row("misc", start, name="guard", value=t, func=o.fn.name)
        if after == "=" and o.char in ("{", "") and t not in NO_VALUE:
            typed = before == ":" and self.token(k - 3) in ("const", "let", "var")
            if typed or before in ("const", "let", "var", ";", "{", "}", ",", "") or self.tokens[k][2]:
                self.settle(o)
                o.assign, o.at = self.token(k - 2) if typed else t, start
                return
        if after == ":" and before in ("{", ",") and o.char == "{":
            o.key = t
            return
        if before not in (".", "?.") and after != "(" and t not in NO_VALUE:
            now.flow = _either(now.flow, self.flow_of(t))

    def parenthesis(self, k: int, start: int, before: str, o: _Open) -> None:
        name = before if before and (before[0].isalpha() or before[0] in "_$") else ""
        if name and self.token(k - 2) in ("function", "*") or before == "function" or before == "*" and self.token(k - 2) == "function":
            self.stack.append(_Open("(", "params", name, start + 1, start, o.fn, o))
        elif name and name not in BEFORE_PAREN:
            f = _Open("(", "call", name, start + 1, self.tokens[k - 1][1], o.fn, o)
            last = name.rsplit(".", 1)[-1]
            f.loops += "." in name and last in REPEATING
            f.alls += name == "Promise.all"
            f.routes += bool(ROUTE.match(name))
            if last.startswith("to") and self.token(k - 2) == ".":  # expect(x).toBe(, expect(x).not.toBe(
                self.row("misc", start, name="matcher", value=last)
            self.stack.append(f)
        else:
            self.stack.append(_Open("(", "head" if name else "group", name, start + 1, start, o.fn, o))

    def brace(self, k: int, start: int, before: str, o: _Open, pending) -> None:
        if isinstance(pending, tuple):
            kind, said = pending
            params = said if kind == "body" else [a.named or "" for a in self.closed.args] if self.closed else []
            self.open_function("{", start, params, None if kind == "body" else said)
        elif before == ")" and pending is None and self.closed and self.closed.kind == "call":
            self.open_function("{", start, [a.named or "" for a in self.closed.args], self.closed.name)
        else:
            f = _Open("{", pending or "block", "", start, start, o.fn, o)
            f.loops += f.kind == "loop"
            f.tries += f.kind == "try"
            self.stack.append(f)


def js_rows(text: str) -> list[dict]:
    """Rows of one text: call, flow, function, test, misc and ident."""
    return _Scan(text).read()


IMPORTS = [
    (re.compile(r"\bimport\s+(?:type\s+)?([^'\";]*?)\s*from\s*['\"]([^'\"]+)['\"]()"), "esm"), (re.compile(r"\bimport\s*()['\"]([^'\"]+)['\"]()"), "esm"),
    (re.compile(r"(?:\b(?:const|let|var)\s+([^=;]+?)\s*=\s*)?\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)(?:\.([A-Za-z_$][\w$]*))?"), "cjs"), (re.compile(r"\bimport\(\s*()['\"]([^'\"]+)['\"]\s*\)()"), "dynamic"),
]
DECLARED = re.compile(r"\bexport\s+(default\s+)?(?:async\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)|\b(?:module\.)?exports\.([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?(?:function\b\s*)?([A-Za-z_$][\w$]*)?")
LISTED = re.compile(r"\bexport\s*\{([^}]*)\}|\bmodule\.exports\s*=\s*\{([^}]*)\}|\bexport\s+default\s+()([A-Za-z_$][\w$]*)\s*(?:;|\n|$)")
PAIR = re.compile(r"([A-Za-z_$][\w$]*)(?:\s+as\s+|\s*:\s*)?([A-Za-z_$][\w$]*)?[^,]*(?:,|$)")


def module_rows(text: str) -> Iterator[dict]:
    """Imports (name: specifier, value: what is bound, func: the property taken of a required module) and exports (name, value: the local name)."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    for pattern, kind in IMPORTS:
        for m in pattern.finditer(text):
            yield {"kind": "import", "line": bisect_right(starts, m.start(2)), "name": m[2], "value": (m[1] or "").strip(), "arg_kind": kind, "func": m[3] or None}
    for m in DECLARED.finditer(text):
        name = m[2] or m[3]
        yield {"kind": "export", "line": bisect_right(starts, m.start()), "name": "default" if m[1] else name, "value": m[2] or m[4] or m[3]}
    for m in LISTED.finditer(text):
        line = bisect_right(starts, m.start())
        if m[4] and m[4] not in NO_VALUE:
            yield {"kind": "export", "line": line, "name": "default", "value": m[4]}
        for p in PAIR.finditer(m[1] or m[2] or ""):
            exported, local = (p[2] or p[1], p[1]) if m[1] else (p[1], p[2] or p[1])  # { local as exported }, { exported: local }
            yield {"kind": "export", "line": line, "name": exported, "value": local}
