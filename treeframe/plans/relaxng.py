"""RELAX NG by derivatives of patterns, a document at a time: XML syntax, and a pattern algebra that simplifies as it goes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeframe.functions.datatypes import LEXICAL, BOUNDS
from treeframe.plans.local import Node, build
from treeframe.sources.xml import Limits, Reader, XMLFault

EMPTY, NOT_ALLOWED, TEXT = ("empty",), ("notAllowed",), ("text",)


class GrammarError(ValueError):
    pass


def choice(a, b):
    return b if a == NOT_ALLOWED or a == b else a if b == NOT_ALLOWED else ("choice", a, b)


def group(a, b):
    if NOT_ALLOWED in (a, b):
        return NOT_ALLOWED
    return b if a == EMPTY else a if b == EMPTY else ("group", a, b)


def interleave(a, b):
    if NOT_ALLOWED in (a, b):
        return NOT_ALLOWED
    return b if a == EMPTY else a if b == EMPTY else ("interleave", a, b)


def after(a, b):
    return NOT_ALLOWED if NOT_ALLOWED in (a, b) else ("after", a, b)


def one_or_more(a):
    return a if a in (NOT_ALLOWED, EMPTY) else ("oneOrMore", a)


class Grammar:
    """start, and definitions by name; a pattern refers to them by ("ref", name)."""

    def __init__(self, text: str, load=lambda uri: None):
        self.load, self.defs = load, {}
        root = next(n for n in build(Reader(Limits(allow_doctype=True)).read(text)).children if n.kind == "element")
        self.start = self.pattern(root, "", "", "")
        self.null = lru_cache(None)(self._nullable)

    def _kids(self, n: Node) -> list[Node]:
        return [k for k in n.children if k.kind == "element" and k.ns == n.ns and k.local not in ("documentation",)]

    def _all(self, n: Node, ns: str, lib: str, scope: str, join=group):
        out = None
        for k in self._kids(n):
            if k.local in ("name", "anyName", "nsName", "param", "except") and n.local in ("element", "attribute", "data"):
                continue
            p = self.pattern(k, ns, lib, scope)
            out = p if out is None else join(out, p)
        return EMPTY if out is None else out

    def pattern(self, n: Node, ns: str, lib: str, scope: str):
        ns, lib = n.get("ns", ns), n.get("datatypeLibrary", lib)
        match n.local:
            case "element" | "attribute":
                given = n.get("name")
                head = self._kids(n)[:1]
                cls = self._named(given, n, ns if n.local == "element" else n.get("ns", "")) if given else self.name_class(head[0], ns)
                rest = self._all_from(n, 0 if given else 1, ns, lib, scope)
                if n.local == "attribute":
                    return ("attribute", cls, TEXT if rest is None else rest)
                return ("element", cls, EMPTY if rest is None else rest)
            case "text":
                return TEXT
            case "empty":
                return EMPTY
            case "notAllowed":
                return NOT_ALLOWED
            case "group" | "div":
                return self._all(n, ns, lib, scope)
            case "interleave":
                return self._all(n, ns, lib, scope, interleave)
            case "choice":
                return self._all(n, ns, lib, scope, choice)
            case "optional":
                return choice(self._all(n, ns, lib, scope), EMPTY)
            case "zeroOrMore":
                return choice(one_or_more(self._all(n, ns, lib, scope)), EMPTY)
            case "oneOrMore":
                return one_or_more(self._all(n, ns, lib, scope))
            case "mixed":
                return interleave(self._all(n, ns, lib, scope), TEXT)
            case "list":
                return ("list", self._all(n, ns, lib, scope))
            case "data":
                params = tuple((p.get("name"), p.string()) for p in self._kids(n) if p.local == "param")
                less = next((self._all(k, ns, lib, scope, choice) for k in self._kids(n) if k.local == "except"), NOT_ALLOWED)
                return ("data", n.get("type"), params, less)
            case "value":
                return ("value", n.get("type", "token"), n.string())
            case "ref" | "parentRef":
                name = n.get("name").strip()
                return ("ref", (scope if n.local == "ref" else scope.rpartition("/")[0]) + "/" + name)
            case "externalRef":
                return Grammar._other(self, n, ns)
            case "grammar":
                return self.grammar(n, ns, lib, f"{scope}/{id(n)}" if scope else "g")
        raise GrammarError(f"unknown pattern {n.local}")

    def _other(self, n: Node, ns: str):
        got = self.load(n.get("href"))
        if got is None:
            raise GrammarError(f"cannot load {n.get('href')}")
        root = next(k for k in build(Reader(Limits()).read(got)).children if k.kind == "element")
        return self.pattern(root, ns, "", "x" + str(len(self.defs)))

    def _all_from(self, n: Node, skip: int, ns: str, lib: str, scope: str):
        parts = [self.pattern(k, ns, lib, scope) for k in self._kids(n)[skip:]]
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = group(out, p)
        return out

    def grammar(self, n: Node, ns: str, lib: str, scope: str):
        start: list = []
        how: dict[str, str] = {}

        def add(k: Node, replace: set[str]) -> None:
            if k.local == "div":
                for x in self._kids(k):
                    add(x, replace)
                return
            if k.local == "include":
                got = self.load(k.get("href"))
                if got is None:
                    raise GrammarError(f"cannot load {k.get('href')}")
                own = {x.get("name", "\0start") for x in self._kids(k)}
                root = next(x for x in build(Reader(Limits()).read(got)).children if x.kind == "element")
                for x in self._kids(root):
                    add(x, own)
                for x in self._kids(k):
                    add(x, set())
                return
            name = k.get("name", "\0start")
            if name in replace:
                return
            key = f"{scope}/{name}"
            p = self._all(k, k.get("ns", ns), k.get("datatypeLibrary", lib), scope)
            how[key] = k.get("combine") or how.get(key, "")
            if key in self.defs:
                self.defs[key] = (interleave if how[key] == "interleave" else choice)(self.defs[key], p)
            else:
                self.defs[key] = p

        for k in self._kids(n):
            add(k, set())
        if f"{scope}/\0start" not in self.defs:
            raise GrammarError("no start")
        return ("ref", f"{scope}/\0start")

    def _named(self, q: str, n: Node, ns: str):
        p, colon, local = q.strip().partition(":")
        return ("name", n.nsmap.get(p, ""), local) if colon else ("name", ns, p)

    def name_class(self, n: Node, ns: str):
        ns = n.get("ns", ns)
        kids = self._kids(n)
        match n.local:
            case "name":
                return self._named(n.string(), n, ns)
            case "anyName" | "nsName":
                less = tuple(self.name_class(k, ns) for x in kids if x.local == "except" for k in self._kids(x))
                return (n.local, ns, less)
            case "choice":
                return ("choice", tuple(self.name_class(k, ns) for k in kids))
        raise GrammarError(f"unknown name class {n.local}")

    @staticmethod
    def holds(cls, ns: str, local: str) -> bool:
        match cls[0]:
            case "name":
                return cls[1:] == (ns, local)
            case "choice":
                return any(Grammar.holds(c, ns, local) for c in cls[1])
        return (cls[0] == "anyName" or cls[1] == ns) and not any(Grammar.holds(c, ns, local) for c in cls[2])

    # derivatives

    def _nullable(self, p) -> bool:
        match p[0]:
            case "empty" | "text":
                return True
            case "choice":
                return self.null(p[1]) or self.null(p[2])
            case "group" | "interleave":
                return self.null(p[1]) and self.null(p[2])
            case "oneOrMore":
                return self.null(p[1])
            case "ref":
                return self.null(self.defs[p[1]])
        return False

    def map_after(self, p, f):
        match p[0]:
            case "after":
                return after(p[1], f(p[2]))
            case "choice":
                return choice(self.map_after(p[1], f), self.map_after(p[2], f))
        return NOT_ALLOWED

    def start_tag(self, p, ns: str, local: str):
        match p[0]:
            case "ref":
                return self.start_tag(self.defs[p[1]], ns, local)
            case "choice":
                return choice(self.start_tag(p[1], ns, local), self.start_tag(p[2], ns, local))
            case "element":
                return after(p[2], EMPTY) if self.holds(p[1], ns, local) else NOT_ALLOWED
            case "interleave":
                a = self.map_after(self.start_tag(p[1], ns, local), lambda x: interleave(x, p[2]))
                return choice(a, self.map_after(self.start_tag(p[2], ns, local), lambda x: interleave(p[1], x)))
            case "oneOrMore":
                return self.map_after(self.start_tag(p[1], ns, local), lambda x: group(x, choice(p, EMPTY)))
            case "group":
                a = self.map_after(self.start_tag(p[1], ns, local), lambda x: group(x, p[2]))
                return choice(a, self.start_tag(p[2], ns, local)) if self.null(p[1]) else a
            case "after":
                return self.map_after(self.start_tag(p[1], ns, local), lambda x: after(x, p[2]))
        return NOT_ALLOWED

    def attribute(self, p, a: Node):
        match p[0]:
            case "ref":
                return self.attribute(self.defs[p[1]], a)
            case "after":
                return after(self.attribute(p[1], a), p[2])
            case "choice":
                return choice(self.attribute(p[1], a), self.attribute(p[2], a))
            case "group" | "interleave":
                join = group if p[0] == "group" else interleave
                return choice(join(self.attribute(p[1], a), p[2]), join(p[1], self.attribute(p[2], a)))
            case "oneOrMore":
                return group(self.attribute(p[1], a), choice(p, EMPTY))
            case "attribute":
                return EMPTY if self.holds(p[1], a.ns, a.local) and self.value(p[2], a.value) else NOT_ALLOWED
        return NOT_ALLOWED

    def value(self, p, s: str) -> bool:
        return self.null(p) and not s.strip() or self.null(self.text(p, s))

    def close_tag(self, p):
        match p[0]:
            case "ref":
                return self.close_tag(self.defs[p[1]])
            case "after":
                return after(self.close_tag(p[1]), p[2])
            case "choice":
                return choice(self.close_tag(p[1]), self.close_tag(p[2]))
            case "group":
                return group(self.close_tag(p[1]), self.close_tag(p[2]))
            case "interleave":
                return interleave(self.close_tag(p[1]), self.close_tag(p[2]))
            case "oneOrMore":
                return one_or_more(self.close_tag(p[1]))
            case "attribute":
                return NOT_ALLOWED
        return p

    def text(self, p, s: str):
        match p[0]:
            case "ref":
                return self.text(self.defs[p[1]], s)
            case "choice":
                return choice(self.text(p[1], s), self.text(p[2], s))
            case "interleave":
                return choice(interleave(self.text(p[1], s), p[2]), interleave(p[1], self.text(p[2], s)))
            case "group":
                a = group(self.text(p[1], s), p[2])
                return choice(a, self.text(p[2], s)) if self.null(p[1]) else a
            case "after":
                return after(self.text(p[1], s), p[2])
            case "oneOrMore":
                return group(self.text(p[1], s), choice(p, EMPTY))
            case "text":
                return p
            case "value":
                norm = (lambda x: x) if p[1] == "string" else (lambda x: " ".join(x.split()))
                return EMPTY if norm(p[2]) == norm(s) else NOT_ALLOWED
            case "data":
                return EMPTY if datatype(p[1], p[2], s) and not (p[3] != NOT_ALLOWED and self.value(p[3], s)) else NOT_ALLOWED
            case "list":
                inner = p[1]
                for w in s.split():
                    inner = self.text(inner, w)
                return EMPTY if self.null(inner) else NOT_ALLOWED
        return NOT_ALLOWED

    def end_tag(self, p):
        match p[0]:
            case "choice":
                return choice(self.end_tag(p[1]), self.end_tag(p[2]))
            case "after":
                return p[2] if self.null(p[1]) else NOT_ALLOWED
        return NOT_ALLOWED

    def check(self, text: str) -> tuple[bool, str | None, tuple]:
        """Whether the document is valid; else why, and the order key of the node where that showed."""
        root = build(Reader(Limits(max_depth=1000, allow_doctype=True)).read(text))
        p = self.start
        for n in root.children:
            if n.kind == "element":
                p, fault = self._element(p, n)
                if fault:
                    return False, *fault
        return (True, None, ()) if self.null(p) else (False, "the document is incomplete", ())

    def _element(self, p, top: Node):
        """Without recursion: (node, next child) on a stack."""
        stack: list[list] = []

        def enter(p, n: Node):
            q = self.start_tag(p, n.ns, n.local)
            if q == NOT_ALLOWED:
                return q, f"element {n.name} is not allowed"
            for a in n.attrs:
                q = self.attribute(q, a)
                if q == NOT_ALLOWED:
                    return q, f"attribute {a.name} is not allowed"
            q = self.close_tag(q)
            if q == NOT_ALLOWED:
                return q, f"element {n.name} lacks an attribute"
            return q, None

        p, why = enter(p, top)
        if why:
            return p, (why, top.order)
        stack.append([top, self._content(top), 0])
        while stack:
            n, content, i = stack[-1]
            if i < len(content):
                stack[-1][2] += 1
                x = content[i]
                if isinstance(x, str):
                    q = self.text(p, x)
                    only = len(content) == 1
                    p = choice(p, q) if not x.strip() and (only or True) else q
                    if p == NOT_ALLOWED:
                        return p, (f"text in {n.name} is not allowed", n.order)
                    continue
                p, why = enter(p, x)
                if why:
                    return p, (why, x.order)
                stack.append([x, self._content(x), 0])
                continue
            stack.pop()
            q = self.end_tag(p)
            if q == NOT_ALLOWED and not content:
                q = self.end_tag(self.text(p, ""))
            p = q
            if p == NOT_ALLOWED:
                return p, (f"element {n.name} is incomplete", n.order)
        return p, None

    @staticmethod
    def _content(n: Node) -> list:
        out: list = []
        for k in n.children:
            if k.kind in ("text", "cdata"):
                if out and isinstance(out[-1], str):
                    out[-1] += k.value
                else:
                    out.append(k.value)
            elif k.kind == "element":
                out.append(k)
        return [x for x in out if not isinstance(x, str) or x.strip() or len(out) == 1]


def datatype(name: str, params: tuple, s: str) -> bool:
    if name in ("string", "token"):
        v = s if name == "string" else " ".join(s.split())
    else:
        v = " ".join(s.split())
        form = LEXICAL.get(name, LEXICAL["integer"] if name in BOUNDS else None)
        if form and not re.fullmatch(form, v):
            return False
        low, high = BOUNDS.get(name, (None, None))
        if low is not None and int(v) < low or high is not None and int(v) > high:
            return False
    for k, x in params:
        if k == "pattern" and not re.fullmatch(x, v):
            return False
        if k in ("length", "minLength", "maxLength"):
            n = int(x)
            if not {"length": len(v) == n, "minLength": len(v) >= n, "maxLength": len(v) <= n}[k]:
                return False
        if k in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive"):
            try:
                a, b = float(v), float(x)
            except ValueError:
                a, b = v, x
            if not {"minInclusive": a >= b, "maxInclusive": a <= b, "minExclusive": a > b, "maxExclusive": a < b}[k]:
                return False
    return True


def validate(df: DataFrame, schema: str, *, id_col: str = "doc_id", text: str = "xml", resources: dict[str, str] | None = None) -> DataFrame:
    """doc_id, valid, reason, pre. Documents that can't be read are invalid; null ones give nulls."""
    kind = df.schema[id_col].dataType.simpleString()
    Grammar(schema, (resources or {}).get)  # faults of the schema are raised here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(schema, (resources or {}).get)
        for b in batches:
            rows = []
            for x in b.column(1).to_pylist():
                if x is None:
                    rows.append((None, None, None))
                    continue
                try:
                    ok, why, at = grammar.check(x)
                    rows.append((ok, why, at[1] if at else None))
                except XMLFault as e:
                    rows.append((False, str(e), None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(cols, (pa.bool_(), pa.string(), pa.int32()), strict=True))], names=["doc_id", "valid", "reason", "pre"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {kind}, valid boolean, reason string, pre int")
