"""Trees while a document is being read, and their rows."""

from __future__ import annotations

XML_NS = "http://www.w3.org/XML/1998/namespace"


class Tree:
    """Builds the rows of one document from events. Rows are lists, in the order of model.FIELDS."""

    PRE, LAST, PARENT, LEVEL, SIB, KIND, PREFIX, LOCAL, NS, VALUE, SVAL, ATTRS, NSMAP, NSOWN, ANC, PATH, LANG, LINE, COL = range(19)

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.open: list[list] = []
        self.children: list[int] = []
        self.texts: list[list[str]] = []
        self._add("document", None, None, None, None, (1, 1))
        self._push(self.rows[0])

    def _push(self, row: list) -> None:
        self.open.append(row)
        self.children.append(0)
        self.texts.append([])

    def _add(self, kind: str, prefix: str | None, local: str | None, ns: str | None, value: str | None, at: tuple[int, int]) -> list:
        n = len(self.rows)
        if self.open:
            up = self.open[-1]
            row = [n, n, up[0], up[3] + 1, self.children[-1], kind, prefix, local, ns, value, value, None, None, None, [*up[14], up[0]], up[15], up[16], *at]
            self.children[-1] += 1
        else:
            row = [n, n, None, 0, 0, kind, prefix, local, ns, value, value, None, None, None, [], "", None, *at]
        self.rows.append(row)
        return row

    def start(self, prefix: str, local: str, ns: str, attrs: list[tuple[str, str, str, str]], nsmap: dict[str, str] | None, at: tuple[int, int]) -> None:
        row = self._add("element", prefix, local, ns, None, at)
        row[self.ATTRS] = attrs
        above = self.open[-1][self.NSMAP] or {}
        row[self.NSMAP] = nsmap if nsmap is not None else above or None
        # bindings that differ from the parent's
        row[self.NSOWN] = {} if nsmap is above else {k: v for k, v in (nsmap or {}).items() if above.get(k, "") != v and k != "xml"}
        row[self.PATH] += f"/{prefix}:{local}" if prefix else f"/{local}"
        for p, name, _, value in attrs:
            if name == "lang" and p == "xml":
                row[self.LANG] = value
        self._push(row)

    def end(self) -> None:
        row = self.open.pop()
        self.children.pop()
        row[self.LAST] = len(self.rows) - 1
        row[self.SVAL] = held = "".join(self.texts.pop())
        if held and self.texts:
            self.texts[-1].append(held)

    def leaf(self, kind: str, value: str, at: tuple[int, int], name: str | None = None) -> None:
        self._add(kind, "" if name else None, name, "" if name else None, value, at)
        if kind in ("text", "cdata"):
            self.texts[-1].append(value)

    def text(self, value: str, at: tuple[int, int]) -> None:
        """Appends to a text node just before, if there is one."""
        up, prior = self.open[-1], self.rows[-1]
        if prior[self.KIND] == "text" and prior[self.PARENT] == up[0]:
            prior[self.VALUE] += value
            prior[self.SVAL] = prior[self.VALUE]
            self.texts[-1].append(value)
        elif value:
            self.leaf("text", value, at)

    def finish(self) -> list[list]:
        while self.open:
            self.end()
        return self.rows


class Lines:
    """Line and column, from 1, of offsets that only grow."""

    def __init__(self, text: str):
        self.text, self.at, self.line, self.start = text, 0, 1, 0

    def mark(self, offset: int) -> tuple[int, int]:
        if self.text.find("\n", self.at, offset) >= 0:
            self.line += self.text.count("\n", self.at, offset)
            self.start = self.text.rfind("\n", 0, offset) + 1
        self.at = offset
        return self.line, offset - self.start + 1
