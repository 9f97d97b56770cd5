"""Reading XML 1.0 with namespaces: strictly, or with faults noted and mended."""

from __future__ import annotations

import re
from dataclasses import dataclass

from treeframe.sources.trees import XML_NS, Lines, Tree

_START = r":A-Z_a-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000EFFFF"
NAME = rf"[{_START}][-.0-9·̀-ͯ‿-⁀{_START}]*"
_ILLEGAL = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
_MARKUP = re.compile(rf"<!--(?P<comment>.*?)-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?(?P<target>{NAME})(?:\s+(?P<data>.*?))?\?>|</(?P<close>{NAME})\s*>", re.S)
#: A start tag of any kind, without backtracking; and attributes that need no decoding.
_OPEN = re.compile(rf"<({NAME.replace(']*', ']*+')})([^<>\"']*+(?:\"[^\"]*+\"[^<>\"']*+|'[^']*+'[^<>\"']*+)*+)>", re.S)
_PLAIN = re.compile(rf"\s+({NAME})=\"([^\"<&\t\n]*)\"")
_ATTR = re.compile(rf"(?P<gap>\s*)(?P<name>{NAME})\s*=\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)')", re.S)
_REF = re.compile(rf"&(?:#(\d+)|#x([0-9a-fA-F]+)|({NAME}));")
_DECL = re.compile(r"<\?xml\s+version\s*=\s*(?:\"(1\.\d+)\"|'(1\.\d+)')(?:\s+encoding\s*=\s*(?:\"([A-Za-z][\w.\-]*)\"|'([A-Za-z][\w.\-]*)'))?(?:\s+standalone\s*=\s*(?:\"(yes|no)\"|'(yes|no)'))?\s*\?>")
_ENTITY = re.compile(rf"<!ENTITY\s+({NAME})\s+(?:\"([^\"]*)\"|'([^']*)')\s*>")
PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}


@dataclass(frozen=True)
class Limits:
    max_depth: int = 256
    max_name: int = 50_000
    max_content: int = 10_000_000
    max_expansion: int = 1_000_000
    allow_doctype: bool = False


class XMLFault(ValueError):
    def __init__(self, code: str, message: str, at: tuple[int, int]):
        super().__init__(f"{code} at {at[0]}:{at[1]}: {message}")
        self.code, self.message, self.at = code, message, at


def declaration(text: str) -> dict[str, str | None] | None:
    """Version, encoding and standalone of the XML declaration, if there is one."""
    m = _DECL.match(text.removeprefix("﻿"))
    return {"version": m[1] or m[2], "encoding": m[3] or m[4], "standalone": m[5] or m[6]} if m else None


class Scope:
    """Namespace bindings, and the names that were resolved in them."""

    __slots__ = ("bindings", "elements", "attributes")

    def __init__(self, bindings: dict[str, str]):
        self.bindings = bindings
        self.elements: dict[str, tuple[str, str, str]] = {}
        self.attributes: dict[str, tuple[str, str, str]] = {}


class Reader:
    """Reads one document into a Tree. recover: note faults and go on, else raise the first."""

    def __init__(self, limits: Limits = Limits(), recover: bool = False):
        self.limits, self.recover, self.faults = limits, recover, []

    def fault(self, code: str, message: str, at: tuple[int, int]) -> None:
        if not self.recover:
            raise XMLFault(code, message, at)
        self.faults.append((code, message, *at))

    def decode(self, s: str, at: tuple[int, int], attribute: bool = False, busy: tuple[str, ...] = ()) -> str:
        if attribute:
            s = s.translate({9: " ", 10: " ", 13: " "})
        if "&" not in s:
            return s

        def one(m: re.Match) -> str:
            if m[3]:
                if m[3] in PREDEFINED:
                    return PREDEFINED[m[3]]
                if m[3] in busy:
                    self.fault("recursiveEntity", m[3], at)
                    return ""
                if m[3] in self.entities:
                    out = self.decode(self.entities[m[3]], at, attribute, (*busy, m[3]))
                    self.expanded += len(out)
                    if self.expanded > self.limits.max_expansion:
                        raise XMLFault("entityExpansionLimit", m[3], at)
                    return out
                self.fault("undefinedEntity", m[3], at)
                return m[0]
            code = int(m[1]) if m[1] else int(m[2], 16)
            c = chr(code) if code < 0x110000 else "\0"
            if _ILLEGAL.match(c):
                self.fault("invalidCharacterReference", m[0], at)
                return ""
            return c

        parts, last = [], 0
        for m in _REF.finditer(s):
            plain = s[last : m.start()]
            if "&" in plain:
                self.fault("malformedReference", plain, at)
            parts += [plain, one(m)]
            last = m.end()
        if "&" in s[last:]:
            self.fault("malformedReference", s[last:], at)
        return "".join([*parts, s[last:]])

    def read(self, text: str) -> list[list]:
        text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
        tree, lines = Tree(), Lines(text)
        self.entities: dict[str, str] = {}
        self.expanded = 0
        names: list[str] = []
        scopes: list[Scope] = [Scope({"xml": XML_NS})]
        root_seen = False
        at = m.end() if (m := _DECL.match(text)) else 0
        if not m and text.startswith("<?xml") and text[5:6].isspace():
            self.fault("malformedXMLDeclaration", text[:40], (1, 1))
            at = text.find("?>") + 2 if "?>" in text else 0
        if (bad := _ILLEGAL.search(text)) is not None:
            self.fault("invalidCharacter", repr(bad[0]), (text.count("\n", 0, bad.start()) + 1, bad.start() - text.rfind("\n", 0, bad.start())))
            text = _ILLEGAL.sub("�", text)
        n = len(text)
        while at < n:
            lt = text.find("<", at)
            stop = n if lt < 0 else lt
            if stop > at:
                raw, mark = text[at:stop], lines.mark(at)
                if len(raw) > self.limits.max_content:
                    raise XMLFault("contentLimit", str(len(raw)), mark)
                if names:
                    if "]]>" in raw:
                        self.fault("cdataEndInText", "]]>", mark)
                    tree.text(self.decode(raw, mark), mark)
                elif raw.strip(" \t\n"):
                    self.fault("contentOutsideRoot", raw.strip()[:40], mark)
                at = stop
                continue
            if names and text.startswith(closing := f"</{names[-1]}>", at):
                names.pop(), scopes.pop(), tree.end()
                at += len(closing)
                continue
            mark = lines.mark(at)
            m = _OPEN.match(text, at)
            if m:
                at = m.end()
                empty = m[2].endswith("/")
                self.element(tree, m[1], m[2][:-1] if empty else m[2], names, scopes, root_seen, mark)
                root_seen = True
                if empty:
                    names.pop(), scopes.pop(), tree.end()
                continue
            m = _MARKUP.match(text, at)
            if m is None:
                if text.startswith("<!DOCTYPE", at) and not names and not root_seen:
                    at = self.doctype(text, at, mark)
                    continue
                self.fault("malformedMarkup", text[at : at + 40], mark)
                if names:
                    tree.text("<", mark)
                at += 1
                continue
            at = m.end()
            if m["comment"] is not None:
                if "--" in m["comment"] or m["comment"].endswith("-"):
                    self.fault("doubleHyphenInComment", m["comment"][:40], mark)
                tree.leaf("comment", m["comment"], mark)
            elif m["cdata"] is not None:
                if names:
                    tree.leaf("cdata", m["cdata"], mark)
                else:
                    self.fault("contentOutsideRoot", "CDATA", mark)
            elif m["target"]:
                if m["target"].lower() == "xml":
                    self.fault("reservedTarget", m["target"], mark)
                tree.leaf("pi", m["data"] or "", mark, m["target"])
            else:
                if m["close"] in names:
                    while names[-1] != m["close"]:
                        self.fault("unclosedElement", names[-1], mark)
                        names.pop(), scopes.pop(), tree.end()
                    names.pop(), scopes.pop(), tree.end()
                else:
                    self.fault("unexpectedEndTag", m["close"], mark)
        end = lines.mark(n)
        for name in reversed(names):
            self.fault("unclosedElement", name, end)
        if not root_seen:
            self.fault("noRoot", "", end)
        return tree.finish()

    def element(self, tree: Tree, name: str, raw: str, names: list[str], scopes: list[Scope], root_seen: bool, mark: tuple[int, int]) -> None:
        if not names and root_seen:
            self.fault("multipleRoots", name, mark)
        if len(name) > self.limits.max_name:
            raise XMLFault("nameLimit", str(len(name)), mark)
        if len(names) >= self.limits.max_depth:
            raise XMLFault("depthLimit", str(len(names)), mark)
        self.start(tree, name, raw, scopes, mark)
        names.append(name)

    def start(self, tree: Tree, name: str, raw: str, scopes: list[Scope], mark: tuple[int, int]) -> None:
        scope = scopes[-1]
        found: list[tuple[str, str]] = []
        parts = _PLAIN.split(raw) if raw else [""]
        keys = parts[1::3]
        if "xmlns" not in raw and not "".join(parts[::3]).strip() and len(set(keys)) == len(keys):
            found = list(zip(keys, parts[2::3]))
        else:
            found = self.attributes(raw, mark)
            own = {k.partition(":")[2]: v for k, v in found if k == "xmlns" or k.startswith("xmlns:")}
            for p, uri in own.items():
                if p == "xmlns" or (p == "xml") != (uri == XML_NS) or p and not uri:
                    self.fault("namespaceConstraint", p, mark)
            if own:
                scope = Scope(scope.bindings | own)
                found = [(k, v) for k, v in found if not (k == "xmlns" or k.startswith("xmlns:"))]
        scopes.append(scope)
        known = scope.attributes
        attrs = [(*(known.get(k) or self.split(k, "", scope, known, mark)), v) for k, v in found]
        if ":" in raw:
            seen = [(ns, local) for _, local, ns, _ in attrs if ns]
            if len(set(seen)) < len(seen):
                self.fault("duplicateAttribute", "same expanded name", mark)
        prefix, local, ns = scope.elements.get(name) or self.split(name, scope.bindings.get("", ""), scope, scope.elements, mark)
        tree.start(prefix, local, ns, attrs, scope.bindings, mark)

    def attributes(self, raw: str, mark: tuple[int, int]) -> list[tuple[str, str]]:
        """Names and decoded values of any attributes, with their faults."""
        found: list[tuple[str, str]] = []
        at = 0
        for m in _ATTR.finditer(raw):
            if raw[at : m.start()].strip():
                self.fault("malformedAttribute", raw[at : m.start()].strip(), mark)
            elif not m["gap"]:
                self.fault("missingSpace", m["name"], mark)
            at = m.end()
            value = m["dq"] if m["dq"] is not None else m["sq"]
            if "<" in value:
                self.fault("lessThanInAttribute", m["name"], mark)
            if any(k == m["name"] for k, _ in found):
                self.fault("duplicateAttribute", m["name"], mark)
                continue
            found.append((m["name"], self.decode(value, mark, attribute=True)))
        if raw[at:].strip():
            self.fault("malformedAttribute", raw[at:].strip(), mark)
        return found

    def split(self, k: str, default: str, scope: Scope, known: dict[str, tuple[str, str, str]], mark: tuple[int, int]) -> tuple[str, str, str]:
        """Prefix, local name and namespace of a name; kept for the scope unless the prefix is unbound, which is a fault each time."""
        p, colon, local = k.partition(":")
        if not colon or not p or not local or ":" in local:
            out = "", k, default
        elif p not in scope.bindings:
            self.fault("unboundPrefix", p, mark)
            return p, local, ""
        else:
            out = p, local, scope.bindings[p]
        known[k] = out
        return out

    def doctype(self, text: str, at: int, mark: tuple[int, int]) -> int:
        """Skips the document type; its internal general entities are kept."""
        if not self.limits.allow_doctype:
            self.fault("doctypeForbidden", "", mark)
        depth, i, quote = 0, at, ""
        while i < len(text):
            c = text[i]
            if quote:
                quote = "" if c == quote else quote
            elif text.startswith("<!--", i):
                i = text.find("-->", i) + 2
                if i < 2:
                    break
            elif c in "\"'":
                quote = c
            elif c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
            elif c == ">" and not depth:
                if self.limits.allow_doctype:
                    for m in _ENTITY.finditer(text, at, i):
                        self.entities.setdefault(m[1], re.sub(r"&#(\d+);|&#x([0-9a-fA-F]+);", lambda r: chr(int(r[1]) if r[1] else int(r[2], 16)), m[2] if m[2] is not None else m[3]))
                return i + 1
            elif c == ">" and depth:
                pass
            i += 1
        self.fault("unterminatedDoctype", "", mark)
        return len(text)
