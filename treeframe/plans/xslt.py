"""XSLT 1.0, a document at a time within Arrow batches: a stylesheet is compiled once a task, documents stream by."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeframe.plans.local import Context, Node, build, descendants, evaluate, ordered, run, tests, to_boolean, to_number, to_string
from treeframe.sources.xml import Limits, Reader
from treeframe.xpath.parser import parse

XSL = "http://www.w3.org/1999/XSL/Transform"


class StyleError(ValueError):
    pass


class Fragment(list):
    """A result tree: a node-set of one document node."""


def _branches(e) -> list:
    return [*_branches(e[1]), *_branches(e[2])] if e[0] == "union" else [e]


def _priority(e) -> float:
    if e[0] == "path" and e[1] == "self" and len(e[2]) == 1 and not e[2][0][2]:
        kind, a, b = e[2][0][1]
        if kind == "name":
            return 0.0 if b != "*" else -0.25 if a else -0.5
        return 0.0 if b else -0.5
    return 0.5


def matches(e, n: Node, c: Context) -> bool:
    """Whether a pattern's branch matches: read from its end, each step must hold of a node on the way up."""
    if e[0] != "path":
        return n in evaluate(e, c.at(n))
    if e[1] == "root" and not e[2]:
        return n.kind == "document"
    return _up(e, len(e[2]) - 1, n, c)


def _up(e, i: int, n: Node | None, c: Context) -> bool:
    if n is None:
        return False
    axis, test, predicates = e[2][i]
    if axis == "descendant-or-self" and test == ("kind", "node", None):
        x = n
        while x is not None:
            if i == 0 and (e[1] != "root" or x.kind == "document") or i > 0 and _up(e, i - 1, x, c):
                return True
            x = x.parent
        return False
    if n.kind == "document" or not tests(n, axis, test, c.namespaces) or (axis == "attribute") != (n.kind == "attribute"):
        return False
    if predicates:
        kin = [x for x in (n.parent.attrs if axis == "attribute" else n.parent.children) if tests(x, axis, test, c.namespaces)] if n.parent else [n]
        for p in predicates:
            kept = []
            for k, x in enumerate(kin, 1):
                v = evaluate(p, c.at(x, k, len(kin)))
                if (v == k) if isinstance(v, float) else to_boolean(v):
                    kept.append(x)
            kin = kept
        if n not in kin:
            return False
    if i == 0:
        if e[1] == "root":
            return n.parent is not None and n.parent.kind == "document"
        return True if e[1] == "self" else n.parent in evaluate(e[1], c)
    return _up(e, i - 1, n.parent, c)


class Stylesheet:
    def __init__(self, text: str, load: Callable[[str], str | None] = lambda uri: None):
        self.load, self.templates, self.named, self.keys = load, [], {}, {}
        self.globals: list[Node] = []
        self.output: dict[str, str] = {}
        self.attribute_sets: dict[str, list[Node]] = {}
        self.strip: list[tuple[str, bool]] = []
        self.formats: dict[str, dict[str, str]] = {}
        self.aliases: dict[str, str] = {}
        self.excluded = {XSL}
        self._read(text, 0, ())
        self.templates.sort(key=lambda t: (-t["precedence"], -t["priority"], -t["index"]))

    def _read(self, text: str, precedence: int, seen: tuple[str, ...]) -> int:
        root = next(n for n in build(Reader(Limits(max_depth=1000)).read(text)).children if n.kind == "element")
        if root.ns != XSL:  # a literal result element as stylesheet
            self.templates.append({"match": parse("/"), "mode": None, "priority": 0.5, "precedence": precedence, "index": 0, "node": root, "body": [root], "ns": root.nsmap})
            return precedence + 1
        self.excluded |= {root.nsmap.get(p, "") for p in (root.get("exclude-result-prefixes", "") + " " + root.get("extension-element-prefixes", "")).split()}
        for n in root.children:
            if n.kind == "element" and n.ns == XSL and n.local in ("import", "include"):
                uri = n.get("href", "")
                got = self.load(uri)
                if got is None or uri in seen:
                    raise StyleError(f"cannot load {uri}")
                precedence = self._read(got, precedence, (*seen, uri))
        for n in root.children:
            if n.kind != "element" or n.ns != XSL:
                continue
            match n.local:
                case "template":
                    t = {"mode": n.get("mode"), "precedence": precedence, "node": n, "body": n.children, "ns": n.nsmap}
                    if n.get("name"):
                        self.named[n.get("name")] = t
                    for e in _branches(parse(n.get("match"))) if n.get("match") else []:
                        p = float(n.get("priority")) if n.get("priority") else _priority(e)
                        self.templates.append(t | {"match": e, "priority": p, "index": len(self.templates)})
                case "variable" | "param":
                    self.globals.append(n)
                case "key":
                    self.keys.setdefault(n.get("name"), []).append((_branches(parse(n.get("match"))), n.get("use"), n.nsmap))
                case "output":
                    self.output |= {a.local: a.value for a in n.attrs}
                case "attribute-set":
                    self.attribute_sets.setdefault(n.get("name"), []).append(n)
                case "strip-space" | "preserve-space":
                    self.strip += [(x, n.local == "strip-space") for x in n.get("elements", "").split()]
                case "decimal-format":
                    self.formats[n.get("name", "")] = {a.local: a.value for a in n.attrs}
                case "namespace-alias":
                    p, q = n.get("stylesheet-prefix"), n.get("result-prefix")
                    self.aliases[n.nsmap.get("" if p == "#default" else p, "")] = n.nsmap.get("" if q == "#default" else q, "")
        return precedence + 1

    def transform(self, text: str, params: dict[str, object] | None = None) -> str:
        source = build(Reader(Limits(max_depth=1000, allow_doctype=True)).read(text))
        if self.strip:
            self._strip(source)
        return Run(self, source, params or {}).result()

    def _strip(self, root: Node) -> None:
        for n in [root, *descendants(root)]:
            if n.kind != "element":
                continue
            rule = next((s for x, s in self.strip if x in (n.name, n.local)), next((s for x, s in self.strip if x == "*"), False))
            if rule and not any(a.name == "xml:space" and a.value == "preserve" for a in n.attrs):
                n.children = [x for x in n.children if not (x.kind == "text" and not x.value.strip(" \t\n\r"))]
                for i, x in enumerate(n.children):
                    x.kin = i


class Run:
    def __init__(self, sheet: Stylesheet, source: Node, params: dict[str, object]):
        self.sheet, self.source, self.params = sheet, source, params
        self.uids, self.indexes, self.loaded = 0, {}, {}
        self.variables: dict[str, object] = {}
        self.depth = 0
        self.functions = {"key": self._key, "document": self._document, "format-number": self._format, "system-property": lambda c, a: {"xsl:version": "1.0", "xsl:vendor": "treeframe"}.get(to_string(a[0]), ""), "function-available": lambda c, a: to_string(a[0]) in self.functions or to_string(a[0]) in _known(), "element-available": lambda c, a: to_string(a[0]).removeprefix("xsl:") in _INSTRUCTIONS, "unparsed-entity-uri": lambda c, a: "", "exsl:node-set": lambda c, a: a[0]}

    def result(self) -> str:
        root = Context(self.source, {}, None, self.functions)
        for n in self.sheet.globals:
            name = n.get("name")
            if n.local == "param" and name in self.params:
                self.variables[name] = self.params[name]
            else:
                self.variables[name] = self.value(n, root, dict(self.variables))
        out = Node("document")
        self.apply([self.source], None, {}, out, dict(self.variables))
        method = self.sheet.output.get("method") or ("html" if next((n.name.lower() for n in out.children if n.kind == "element"), "") == "html" else "xml")
        return write(out, method, self.sheet.output)

    # running

    def context(self, node: Node, variables: dict, at: Node, position: int = 1, size: int = 1) -> Context:
        c = Context(node, variables, {k: v for k, v in at.nsmap.items() if k} or {}, self.functions, node)
        c.position, c.size = position, size
        return c

    def find(self, n: Node, mode: str | None, variables: dict, below: int | None = None) -> dict | None:
        for t in self.sheet.templates:
            if t["mode"] == mode and (below is None or t["precedence"] < below) and matches(t["match"], n, Context(n, variables, {k: v for k, v in t["ns"].items() if k}, self.functions)):
                return t
        return None

    def apply(self, nodes: list[Node], mode: str | None, given: dict, out: Node, variables: dict, below: int | None = None) -> None:
        for i, n in enumerate(nodes, 1):
            t = self.find(n, mode, self.variables, below)
            if t:
                self.call(t, n, given, out, i, len(nodes))
            elif n.kind in ("element", "document"):
                self.apply(n.children, mode, {}, out, variables)
            elif n.kind in ("text", "cdata", "attribute"):
                self.text(out, n.value)

    def call(self, t: dict, n: Node, given: dict, out: Node, position: int, size: int) -> None:
        self.depth += 1
        if self.depth > 250:
            raise StyleError("templates are nested too deeply")
        local = dict(self.variables)
        local["\0"] = given
        local["\1"] = t
        self.body(t["body"], self.context(n, local, t["node"], position, size), out)
        self.depth -= 1

    def body(self, items: list[Node], c: Context, out: Node) -> None:
        c = self._copy(c)
        for x in items:
            if x.kind in ("text", "cdata"):
                if x.value.strip(" \t\n\r") or x.kind == "cdata":
                    self.text(out, x.value)
            elif x.kind == "element":
                c.namespaces = {k: v for k, v in x.nsmap.items() if k}
                if x.ns == XSL:
                    self.instruction(x, c, out)
                else:
                    self.literal(x, c, out)

    @staticmethod
    def _copy(c: Context) -> Context:
        d = Context(c.node, dict(c.variables), c.namespaces, c.functions, c.current)
        d.position, d.size = c.position, c.size
        return d

    def text(self, out: Node, value: str, raw: bool = False) -> None:
        if value:
            kind = "raw" if raw else "text"
            if out.children and out.children[-1].kind == kind:
                out.children[-1].value += value
            else:
                self.add(out, Node(kind, value=value))

    def add(self, out: Node, n: Node) -> Node:
        n.parent, n.kin = out, len(out.children)
        out.children.append(n)
        return n

    def template(self, s: str, c: Context) -> str:
        """An attribute value template."""
        if "{" not in s and "}" not in s:
            return s
        parts, i = [], 0
        for m in re.finditer(r"\{\{|\}\}|\{((?:[^{}\"']|\"[^\"]*\"|'[^']*')*)\}", s):
            parts.append(s[i : m.start()])
            parts.append(m[0][0] if m[0] in ("{{", "}}") else to_string(run(m[1], c)))
            i = m.end()
        return "".join(parts) + s[i:]

    def set_attribute(self, out: Node, prefix: str, local: str, ns: str, value: str) -> None:
        out.attrs = [a for a in out.attrs if (a.local, a.ns) != (local, ns)] + [Node("attribute", prefix, local, ns, value, out)]

    def literal(self, x: Node, c: Context, out: Node) -> None:
        alias = lambda uri: self.sheet.aliases.get(uri, uri)
        e = self.add(out, Node("element", x.prefix, x.local, alias(x.ns)))
        e.nsmap = {p: alias(u) for p, u in x.nsmap.items() if u not in self.sheet.excluded and p != "xml"}
        sets = next((a.value for a in x.attrs if a.ns == XSL and a.local == "use-attribute-sets"), "")
        self.use_sets(sets, c, e)
        for a in x.attrs:
            if a.ns != XSL:
                self.set_attribute(e, a.prefix, a.local, a.ns, self.template(a.value, c))
        self.body(x.children, c, e)

    def use_sets(self, names: str, c: Context, e: Node) -> None:
        for name in names.split():
            for s in self.sheet.attribute_sets.get(name, []):
                self.use_sets(s.get("use-attribute-sets", ""), c, e)
                self.body(s.children, c, e)

    def value(self, x: Node, c: Context, variables: dict):
        c = self._copy(c)
        c.variables, c.namespaces = variables, {k: v for k, v in x.nsmap.items() if k}
        if x.get("select") is not None:
            return run(x.get("select"), c)
        if not x.children:
            return ""
        return self.fragment(x.children, c)

    def fragment(self, items: list[Node], c: Context) -> Fragment:
        doc = Node("document")
        self.body(items, c, doc)
        self.uids -= 1
        for i, n in enumerate([doc, *descendants(doc)]):
            n.order = (self.uids, i, 0, 0)
            for k, a in enumerate(n.attrs):
                a.order = (self.uids, i, 2, k)
        return Fragment([doc])

    def params_of(self, x: Node, c: Context) -> dict:
        return {p.get("name"): self.value(p, c, c.variables) for p in x.children if p.kind == "element" and p.local == "with-param"}

    def sorted(self, nodes: list[Node], x: Node, c: Context) -> list[Node]:
        for s in [k for k in x.children if k.kind == "element" and k.ns == XSL and k.local == "sort"][::-1]:
            number = self.template(s.get("data-type", "text"), c) == "number"
            upper = self.template(s.get("case-order", ""), c) == "upper-first"
            got = []
            for i, n in enumerate(nodes, 1):
                d = self._copy(c)
                d.node = d.current = n
                d.position, d.size = i, len(nodes)
                v = run(s.get("select", "."), d)
                if number:
                    f = to_number(v)
                    got.append((f == f, f if f == f else 0.0))
                else:
                    t = to_string(v)
                    got.append((t.casefold(), t if upper else t.swapcase()))
            order = sorted(range(len(nodes)), key=got.__getitem__, reverse=self.template(s.get("order", "ascending"), c) == "descending")
            if self.template(s.get("order", "ascending"), c) == "descending":  # equal keys stay in their order
                order = sorted(range(len(nodes)), key=lambda i: i)
                order.sort(key=got.__getitem__, reverse=True)
            nodes = [nodes[i] for i in order]
        return nodes

    def instruction(self, x: Node, c: Context, out: Node) -> None:
        name = x.local
        select = x.get("select")
        if name == "value-of":
            self.text(out, to_string(run(select, c)), x.get("disable-output-escaping") == "yes")
        elif name == "text":
            self.text(out, x.string(), x.get("disable-output-escaping") == "yes")
        elif name == "apply-templates":
            nodes = ordered(run(select, c)) if select else c.node.children
            self.apply(self.sorted(nodes, x, c), x.get("mode"), self.params_of(x, c), out, c.variables)
        elif name == "apply-imports":
            self.apply([c.node], c.variables["\1"]["mode"], {}, out, c.variables, c.variables["\1"]["precedence"])
        elif name == "call-template":
            if x.get("name") not in self.sheet.named:
                raise StyleError(f"no template {x.get('name')}")
            self.call(self.sheet.named[x.get("name")], c.node, self.params_of(x, c), out, c.position, c.size)
        elif name == "for-each":
            nodes = self.sorted(ordered(run(select, c)), x, c)
            for i, n in enumerate(nodes, 1):
                d = self._copy(c)
                d.node = d.current = n
                d.position, d.size = i, len(nodes)
                self.body([k for k in x.children if not (k.kind == "element" and k.ns == XSL and k.local == "sort")], d, out)
        elif name == "if":
            if to_boolean(run(x.get("test"), c)):
                self.body(x.children, c, out)
        elif name == "choose":
            for k in x.children:
                if k.kind == "element" and (k.local == "otherwise" or to_boolean(run(k.get("test"), c))):
                    self.body(k.children, c, out)
                    break
        elif name in ("variable", "param"):
            key, given = x.get("name"), c.variables.get("\0", {})
            c.variables[key] = given[key] if name == "param" and key in given else self.value(x, c, c.variables)
        elif name == "element":
            q = self.template(x.get("name"), c)
            prefix, _, local = q.rpartition(":")
            ns = self.template(x.get("namespace"), c) if x.get("namespace") is not None else x.nsmap.get(prefix, "")
            e = self.add(out, Node("element", prefix, local, ns))
            e.nsmap = {prefix: ns} if ns or prefix else {}
            self.use_sets(x.get("use-attribute-sets", ""), c, e)
            self.body(x.children, c, e)
        elif name == "attribute":
            if out.kind == "element" and not out.children:
                q = self.template(x.get("name"), c)
                prefix, _, local = q.rpartition(":")
                ns = self.template(x.get("namespace"), c) if x.get("namespace") is not None else x.nsmap.get(prefix, "") if prefix else ""
                if ns and not prefix:
                    prefix = "ns0"
                if prefix and prefix != "xml":
                    out.nsmap = out.nsmap | {prefix: ns}
                self.set_attribute(out, prefix, local, ns, self.fragment(x.children, c)[0].string())
        elif name in ("comment", "processing-instruction"):
            body = self.fragment(x.children, c)[0].string()
            if name == "comment":
                self.add(out, Node("comment", value=re.sub(r"-(?=-|$)", "- ", body)))
            else:
                self.add(out, Node("pi", local=self.template(x.get("name"), c), value=body.replace("?>", "? >")))
        elif name == "copy":
            n = c.node
            if n.kind == "element":
                e = self.add(out, Node("element", n.prefix, n.local, n.ns))
                e.nsmap = {p: u for p, u in n.nsmap.items() if p != "xml"}
                self.use_sets(x.get("use-attribute-sets", ""), c, e)
                self.body(x.children, c, e)
            elif n.kind == "document":
                self.body(x.children, c, out)
            else:
                self.copy_of(n, out)
        elif name == "copy-of":
            v = run(select, c)
            for n in ordered(v) if isinstance(v, list) else []:
                self.copy_of(n, out)
            if not isinstance(v, list):
                self.text(out, to_string(v))
        elif name == "number":
            self.text(out, self.number(x, c))
        elif name == "message":
            if x.get("terminate") == "yes":
                raise StyleError(self.fragment(x.children, c)[0].string())
        elif name not in ("sort", "fallback", "with-param"):
            fall = [k for k in x.children if k.kind == "element" and k.ns == XSL and k.local == "fallback"]
            if not fall:
                raise StyleError(f"unknown instruction {name}")
            for k in fall:
                self.body(k.children, c, out)

    def copy_of(self, n: Node, out: Node) -> None:
        if n.kind == "document":
            for k in n.children:
                self.copy_of(k, out)
        elif n.kind == "attribute":
            if out.kind == "element":
                self.set_attribute(out, n.prefix, n.local, n.ns, n.value)
        elif n.kind in ("text", "cdata"):
            self.text(out, n.value)
        elif n.kind == "element":
            e = self.add(out, Node("element", n.prefix, n.local, n.ns))
            e.nsmap = {p: u for p, u in n.nsmap.items() if p != "xml"}
            for a in n.attrs:
                self.set_attribute(e, a.prefix, a.local, a.ns, a.value)
            for k in n.children:
                self.copy_of(k, e)
        elif n.kind != "namespace":
            self.add(out, Node(n.kind, n.prefix, n.local, n.ns, n.value))

    # numbering

    def number(self, x: Node, c: Context) -> str:
        if x.get("value") is not None:
            numbers = [int(to_number(run(x.get("value"), c)) + 0.5)]
        else:
            n, d = c.node, Context(c.node, c.variables, c.namespaces, c.functions)
            count = _branches(parse(x.get("count"))) if x.get("count") else None
            since = _branches(parse(x.get("from"))) if x.get("from") else []
            hit = lambda k: any(matches(e, k, d) for e in count) if count else (k.kind, k.local, k.ns) == (n.kind, n.local, n.ns)
            stop = lambda k: any(matches(e, k, d) for e in since)
            up = [n]
            while up[-1].parent is not None and not (since and stop(up[-1])):
                up.append(up[-1].parent)
            among = lambda k: 1 + sum(1 for s in (k.parent.children[: k.kin] if k.parent else []) if hit(s))
            if x.get("level") == "any":
                total = 0
                for k in [n.top(), *descendants(n.top())]:
                    if k.order > n.order:
                        break
                    if since and stop(k):
                        total = 0
                    total += hit(k)
                numbers = [total] if total else []
            elif x.get("level") == "multiple":
                numbers = [among(k) for k in up if hit(k)][::-1]
            else:
                numbers = [among(k) for k in up if hit(k)][:1]
        return formatted(numbers, self.template(x.get("format", "1"), c), self.template(x.get("grouping-separator", ""), c), self.template(x.get("grouping-size", ""), c))

    # functions

    def _key(self, c: Context, a: list) -> list[Node]:
        name, root = to_string(a[0]), c.node.top()
        index = self.indexes.get((name, id(root)))
        if index is None:
            index = self.indexes[(name, id(root))] = {}
            for branches, use, ns in self.sheet.keys.get(name, []):
                for n in [root, *descendants(root), *(x for d in descendants(root) for x in d.attrs)]:
                    d = Context(n, self.variables, {k: v for k, v in ns.items() if k}, self.functions)
                    if any(matches(e, n, d) for e in branches):
                        v = run(use, d)
                        for s in {k.string() for k in v} if isinstance(v, list) else {to_string(v)}:
                            index.setdefault(s, []).append(n)
        wanted = {n.string() for n in a[1]} if isinstance(a[1], list) else {to_string(a[1])}
        return ordered(n for w in wanted for n in index.get(w, []))

    def _document(self, c: Context, a: list) -> list[Node]:
        out = []
        for uri in [n.string() for n in a[0]] if isinstance(a[0], list) else [to_string(a[0])]:
            if uri not in self.loaded:
                text = self.sheet.load(uri)
                self.loaded[uri] = build(Reader(Limits()).read(text), len(self.loaded) + 1) if text is not None else None
            if self.loaded[uri] is not None:
                out.append(self.loaded[uri])
        return out

    def _format(self, c: Context, a: list) -> str:
        return format_number(to_number(a[0]), to_string(a[1]), self.sheet.formats.get(to_string(a[2]) if len(a) > 2 else "", {}))


_INSTRUCTIONS = frozenset("apply-imports apply-templates attribute call-template choose comment copy copy-of element fallback for-each if message number processing-instruction text value-of variable".split())


def _known() -> dict:
    from treeframe.plans.local import FUNCTIONS

    return FUNCTIONS


def _roman(n: int) -> str:
    out = ""
    for v, s in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
        out += s * (n // v)
        n %= v
    return out


def _letters(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def formatted(numbers: list[int], form: str, separator: str = "", size: str = "") -> str:
    parts = re.findall(r"[^\W_]+|[\W_]+", form)
    head = parts.pop(0) if parts and not parts[0][0].isalnum() else ""
    tail = parts.pop() if parts and not parts[-1][0].isalnum() else ""
    kinds, gaps = parts[::2] or ["1"], parts[1::2]
    out = ""
    for i, n in enumerate(numbers):
        k = kinds[min(i, len(kinds) - 1)]
        if k in ("i", "I") and 0 < n < 4000:
            s = _roman(n)
        elif k in ("a", "A") and n > 0:
            s = _letters(n)
        else:
            s = str(n).rjust(len(k), "0") if k.isdigit() else str(n)
            if separator and size.isdigit() and int(size):
                s = re.sub(rf"(?<=\d)(?=(?:\d{{{size}}})+$)", lambda _: separator, s)
        s = s.upper() if k in ("I", "A") else s
        out += (gaps[min(i, len(gaps)) - 1] if gaps else ".") + s if i else s
    return head + out + tail


def format_number(x: float, picture: str, symbols: dict[str, str]) -> str:
    g = lambda k, d: symbols.get(k, d)
    if x != x:
        return g("NaN", "NaN")
    point, group, zero, digit = g("decimal-separator", "."), g("grouping-separator", ","), g("zero-digit", "0"), g("digit", "#")
    positive, _, negative = picture.partition(g("pattern-separator", ";"))
    minus = x < 0
    use = negative if minus and negative else positive
    active = {point, group, zero, digit}
    m = re.match(rf"^([^{re.escape(''.join(active))}]*)([{re.escape(''.join(active))}]*)(.*)$", use, re.S)
    before, body, after = m.groups()
    sign = g("minus-sign", "-") if minus and not negative else ""
    if x in (float("inf"), float("-inf")):
        return sign + before + g("infinity", "Infinity") + after
    whole, _, part = body.partition(point)
    scale = 100 if g("percent", "%") in before + after else 1000 if g("per-mille", "‰") in before + after else 1
    least, least_part, most_part = whole.count(zero), part.count(zero), len(part.replace(group, ""))
    from decimal import ROUND_HALF_EVEN, Decimal

    value = (abs(Decimal(repr(x))) * scale).quantize(Decimal(1).scaleb(-most_part), rounding=ROUND_HALF_EVEN)
    digits, _, decimals = f"{value:f}".partition(".")
    digits = digits.lstrip("0").rjust(least, "0")
    while len(decimals) > least_part and decimals.endswith("0"):
        decimals = decimals[:-1]
    if group in whole:
        n = len(whole) - whole.rfind(group) - 1
        if n:
            digits = re.sub(rf"(?<=\d)(?=(?:\d{{{n}}})+$)", lambda _: group, digits)
    if zero != "0":
        move = str.maketrans("0123456789", "".join(chr(ord(zero) + i) for i in range(10)))
        digits, decimals = digits.translate(move), decimals.translate(move)
    return sign + before + digits + (point + decimals if decimals else "") + after


# writing


def write(doc: Node, method: str, options: dict[str, str]) -> str:
    from treeframe.sources.html import RAW, VOID

    html, indent = method == "html", options.get("indent") == "yes"
    cdata = set(options.get("cdata-section-elements", "").split())

    def escape(s: str) -> str:
        return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def attribute(s: str) -> str:
        s = s.replace("&", "&amp;").replace('"', "&quot;")
        return s if html else s.replace("<", "&lt;").replace("\t", "&#9;").replace("\n", "&#10;").replace("\r", "&#13;")

    def one(n: Node, scope: dict[str, str], deep: int) -> str:
        if n.kind == "raw":
            return n.value
        if n.kind in ("text", "cdata"):
            if method == "text" or html and n.parent.local.lower() in RAW:
                return n.value
            return f"<![CDATA[{n.value.replace(']]>', ']]]]><![CDATA[>')}]]>" if n.parent.name in cdata else escape(n.value)
        if method == "text":
            return "".join(one(k, scope, deep) for k in n.children)
        if n.kind == "comment":
            return f"<!--{n.value}-->"
        if n.kind == "pi":
            return f"<?{n.local} {n.value}{'>' if html else '?>'}"
        want = {p: u for p, u in n.nsmap.items() if scope.get(p, "") != u}
        if scope.get(n.prefix, "") != n.ns and n.prefix != "xml":
            want[n.prefix] = n.ns
        for a in n.attrs:
            if a.prefix and a.prefix != "xml" and (scope | want).get(a.prefix) != a.ns:
                want[a.prefix] = a.ns
        if n.prefix not in want and not n.ns and not n.prefix and scope.get(""):
            want[""] = ""
        head = n.name + "".join(f' xmlns{":" + p if p else ""}="{attribute(u)}"' for p, u in sorted(want.items())) + "".join(f' {a.name}="{attribute(a.value)}"' for a in n.attrs)
        if html and n.local.lower() in VOID and not n.ns:
            return f"<{head}>"
        if not n.children:
            return f"<{head}></{n.name}>" if html else f"<{head}/>"
        below = scope | want
        mixed = any(k.kind in ("text", "cdata", "raw") for k in n.children)
        if indent and not mixed:
            pad = "\n" + "  " * (deep + 1)
            return f"<{head}>" + "".join(pad + one(k, below, deep + 1) for k in n.children) + "\n" + "  " * deep + f"</{n.name}>"
        return f"<{head}>" + "".join(one(k, below, deep + 1) for k in n.children) + f"</{n.name}>"

    body = "".join(one(k, {}, 0) for k in doc.children)
    if method != "xml":
        return body
    head = ""
    if options.get("omit-xml-declaration") != "yes":
        alone = f' standalone="{options["standalone"]}"' if "standalone" in options else ""
        head = f'<?xml version="{options.get("version", "1.0")}" encoding="{options.get("encoding", "UTF-8")}"{alone}?>'
    root = next((n.name for n in doc.children if n.kind == "element"), "")
    kind = f'<!DOCTYPE {root} {"PUBLIC " + chr(34) + options["doctype-public"] + chr(34) if "doctype-public" in options else "SYSTEM"} "{options["doctype-system"]}">' if "doctype-system" in options else ""
    return head + kind + body


def transform(df: DataFrame, stylesheet: str, *, id_col: str = "doc_id", text: str = "xml", params: dict[str, object] | None = None, resources: dict[str, str] | None = None) -> DataFrame:
    """doc_id, output, error for each document. resources: texts by URI for import, include and document()."""
    kind = df.schema[id_col].dataType.simpleString()
    Stylesheet(stylesheet, (resources or {}).get)  # faults of the stylesheet are raised here

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sheet = Stylesheet(stylesheet, (resources or {}).get)
        for b in batches:
            out: list[tuple[str | None, str | None]] = []
            for x in b.column(1).to_pylist():
                try:
                    out.append((None, None) if x is None else (sheet.transform(x, params), None))
                except (ValueError, RecursionError) as e:
                    out.append((None, str(e)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o for o, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], names=["doc_id", "output", "error"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text)).mapInArrow(work, f"doc_id {kind}, output string, error string")
