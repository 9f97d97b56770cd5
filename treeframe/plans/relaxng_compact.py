"""RELAX NG compact syntax to the XML syntax."""

from __future__ import annotations

import re

from treeframe.plans.relaxng import Grammar, GrammarError

_TOKEN = re.compile(r"\s*(?:#[^\n]*\s*)*(?:(\"\"\"(?:.|\n)*?\"\"\"|'''(?:.|\n)*?'''|\"[^\"\n]*\"|'[^'\n]*')|(\|=|&=|[-=~(){}\[\],&|?*+])|(\\?[\w][\w.\-]*(?::(?:\*|[\w.\-]+))?))")
_NS = "http://relaxng.org/ns/structure/1.0"
_XSD = "http://www.w3.org/2001/XMLSchema-datatypes"


def _escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


class _Compact:
    def __init__(self, text: str):
        self.toks, at, text = [], 0, re.sub(r"#[^\n]*\Z", "", text)
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise GrammarError(f"unexpected {text[at : at + 20]!r}")
            self.toks.append(("str" if m[1] else "sym" if m[2] else "id", m[1] or m[2] or m[3]))
            at = m.end()
        self.toks.append(("end", ""))
        self.i, self.ns, self.default = 0, {"xml": "http://www.w3.org/XML/1998/namespace"}, ""
        self.libs = {"xsd": _XSD}

    def peek(self, *values: str) -> bool:
        return self.toks[self.i][0] != "str" and self.toks[self.i][1] in values

    def take(self) -> str:
        self.i += 1
        return self.toks[self.i - 1][1]

    def need(self, value: str) -> None:
        if not self.peek(value):
            raise GrammarError(f"expected {value!r}, found {self.toks[self.i][1]!r}")
        self.i += 1

    def string(self) -> str:
        kind, s = self.toks[self.i]
        if kind != "str":
            raise GrammarError(f"expected a string, found {s!r}")
        self.i += 1
        s = s[3:-3] if s[:3] in ('"""', "'''") else s[1:-1]
        if self.peek("~"):
            self.i += 1
            s += self.string()
        return s

    def document(self) -> str:
        while self.peek("namespace", "default", "datatypes"):
            word = self.take()
            if word == "default":
                self.need("namespace")
            name = self.take() if not self.peek("=") else ""
            self.need("=")
            uri = "" if self.peek("inherit") and self.take() else self.string()
            if word == "datatypes":
                self.libs[name] = uri
            else:
                self.ns[name] = uri
                self.default = uri if word == "default" else self.default
        follows = self.toks[self.i + 1][1] if self.i + 1 < len(self.toks) else ""
        if self.peek("include", "div", "start") or self.toks[self.i][0] == "id" and follows in ("=", "|=", "&="):
            return f'<grammar xmlns="{_NS}">{self.components("")}</grammar>'
        out = self.pattern()
        if self.toks[self.i][0] != "end":
            raise GrammarError(f"unexpected {self.toks[self.i][1]!r}")
        return re.sub(r"^<(\w+)", rf'<\1 xmlns="{_NS}"', out, count=1)

    def components(self, end: str) -> str:
        out = ""
        while self.toks[self.i] != (("sym", end) if end else ("end", "")):
            word = self.take()
            if word == "div":
                self.need("{")
                out += f"<div>{self.components('}')}</div>"
                self.need("}")
            elif word == "include":
                uri, inner = self.string(), ""
                if self.peek("{"):
                    self.take()
                    inner = self.components("}")
                    self.need("}")
                out += f'<include href="{_escape(uri)}">{inner}</include>'
            else:
                how = {"=": "", "|=": ' combine="choice"', "&=": ' combine="interleave"'}[self.take()]
                body = self.pattern()
                out += f"<start{how}>{body}</start>" if word == "start" else f'<define name="{word.lstrip(chr(92))}"{how}>{body}</define>'
        return out

    def pattern(self) -> str:
        first = self.postfix()
        for symbol, tag in ((",", "group"), ("|", "choice"), ("&", "interleave")):
            if self.peek(symbol):
                parts = [first]
                while self.peek(symbol):
                    self.take()
                    parts.append(self.postfix())
                if self.peek(",", "|", "&"):
                    raise GrammarError("mixed connectors need parentheses")
                return f"<{tag}>{''.join(parts)}</{tag}>"
        return first

    def postfix(self) -> str:
        out = self.primary()
        while self.peek("?", "*", "+"):
            tag = {"?": "optional", "*": "zeroOrMore", "+": "oneOrMore"}[self.take()]
            out = f"<{tag}>{out}</{tag}>"
        return out

    def primary(self) -> str:
        kind, word = self.toks[self.i]
        if kind == "str":
            return f"<value>{_escape(self.string())}</value>"
        self.i += 1
        if word == "(":
            out = self.pattern()
            self.need(")")
            return out
        if word in ("element", "attribute"):
            name = self.name_class(word == "attribute")
            self.need("{")
            body = self.pattern()
            self.need("}")
            return f"<{word}>{name}{body}</{word}>"
        if word in ("list", "mixed"):
            self.need("{")
            body = self.pattern()
            self.need("}")
            return f"<{word}>{body}</{word}>"
        if word == "grammar":
            self.need("{")
            body = self.components("}")
            self.need("}")
            return f"<grammar>{body}</grammar>"
        if word in ("text", "empty", "notAllowed"):
            return f"<{word}/>"
        if word == "parent":
            return f'<parentRef name="{self.take()}"/>'
        if word == "external":
            return f'<externalRef href="{_escape(self.string())}"/>'
        if ":" in word or word in ("string", "token"):
            prefix, _, local = word.rpartition(":")
            lib = f' datatypeLibrary="{_escape(self.libs[prefix])}"' if prefix else ""
            if self.toks[self.i][0] == "str":
                return f'<value type="{local}"{lib}>{_escape(self.string())}</value>'
            params = ""
            if self.peek("{"):
                self.take()
                while not self.peek("}"):
                    name = self.take()
                    self.need("=")
                    params += f'<param name="{name}">{_escape(self.string())}</param>'
                self.take()
            if self.peek("-"):
                self.take()
                params += f"<except>{self.primary()}</except>"
            return f'<data type="{local}"{lib}>{params}</data>'
        if kind == "id":
            return f'<ref name="{word.lstrip(chr(92))}"/>'
        raise GrammarError(f"unexpected {word!r}")

    def name_class(self, attribute: bool) -> str:
        parts = [self.one_name(attribute)]
        while self.peek("|"):
            self.take()
            parts.append(self.one_name(attribute))
        return parts[0] if len(parts) == 1 else f"<choice>{''.join(parts)}</choice>"

    def one_name(self, attribute: bool) -> str:
        word = self.take()
        if word == "(":
            out = self.name_class(attribute)
            self.need(")")
            return out
        less = ""
        if word == "*" or word.endswith(":*"):
            if self.peek("-"):
                self.take()
                less = f"<except>{self.one_name(attribute)}</except>"
            if word == "*":
                return f"<anyName>{less}</anyName>"
            return f'<nsName ns="{_escape(self.ns[word[:-2]])}">{less}</nsName>'
        prefix, colon, local = word.lstrip("\\").rpartition(":")
        uri = self.ns[prefix] if colon else "" if attribute else self.default
        return f'<name ns="{_escape(uri)}">{local}</name>'


def to_xml(compact: str) -> str:
    return _Compact(compact).document()


def compile_compact(compact: str, load=lambda uri: None) -> Grammar:
    return Grammar(to_xml(compact), lambda uri: (t if (t := load(uri)) is None or t.lstrip().startswith("<") else to_xml(t)))
