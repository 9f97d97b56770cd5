"""Schematron: in each pattern the first rule whose context matches claims a node; failed assertions and successful reports are findings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeframe.sources.xml import Limits, Reader
from treeframe.sources.trees import Tree as T
from treeframe.xpath.parser import parse
from treeframe.xpath.plan import COLUMNS, Env, Loop, Planner

_NS = ("http://purl.oclc.org/dsdl/schematron", "http://www.ascc.net/xml/schematron")


class Schematron:
    def __init__(self, text: str):
        rows = Reader(Limits()).read(text)
        self.kids: dict[int, list[list]] = {}
        for r in rows[1:]:
            self.kids.setdefault(r[T.PARENT], []).append(r)
        root = next(r for r in rows if r[T.KIND] == "element")
        if root[T.LOCAL] != "schema" or root[T.NS] not in (*_NS, ""):
            raise ValueError("not a Schematron schema")
        self.namespaces = {self._get(r, "prefix"): self._get(r, "uri") for r in self._all(root, "ns")} or None
        self.default_phase = self._get(root, "defaultPhase")
        self.phases = {self._get(p, "id"): [self._get(a, "pattern") for a in self._all(p, "active")] for p in self._all(root, "phase")}
        self.lets = self._lets(root)
        self.diagnostics = {self._get(d, "id"): d for ds in self._all(root, "diagnostics") for d in self._all(ds, "diagnostic")}
        abstract = {self._get(p, "id"): p for p in self._all(root, "pattern") if self._get(p, "abstract") == "true"}
        self.patterns = []
        for p in self._all(root, "pattern"):
            if self._get(p, "abstract") == "true":
                continue
            params = {self._get(x, "name"): self._get(x, "value") for x in self._all(p, "param")}
            body = abstract.get(self._get(p, "is-a"), p)
            self.patterns.append((self._get(p, "id") or self._get(p, "name"), self._rules(body, params), self._lets(body)))

    def _all(self, row: list, name: str) -> list[list]:
        return [r for r in self.kids.get(row[T.PRE], []) if r[T.KIND] == "element" and r[T.LOCAL] == name]

    @staticmethod
    def _get(row: list, name: str) -> str:
        return next((v for _, k, _, v in row[T.ATTRS] if k == name), "")

    def _lets(self, row: list) -> dict[str, str]:
        return {self._get(x, "name"): self._get(x, "value") for x in self._all(row, "let")}

    def _rules(self, pattern: list, params: dict[str, str]) -> list[dict]:
        def put(s: str) -> str:
            for k in sorted(params, key=len, reverse=True):
                s = re.sub(rf"\${re.escape(k)}\b", lambda _, k=k: params[k], s)
            return s

        every = self._all(pattern, "rule")
        abstract = {self._get(r, "id"): r for r in every if self._get(r, "abstract") == "true"}

        def tests(rule: list) -> list[dict]:
            out = []
            for x in self.kids.get(rule[T.PRE], []):
                if x[T.KIND] == "element" and x[T.LOCAL] == "extends":
                    out += tests(abstract[self._get(x, "rule")])
                elif x[T.KIND] == "element" and x[T.LOCAL] in ("assert", "report"):
                    out.append({"kind": x[T.LOCAL], "test": put(self._get(x, "test")), "id": self._get(x, "id"), "row": x, "put": put})
            return out

        return [{"context": put(self._get(r, "context")), "lets": {k: put(v) for k, v in self._lets(r).items()}, "tests": tests(r)} for r in every if self._get(r, "abstract") != "true"]

    def _expand(self, e, lets: dict):
        """e with variables replaced by the expressions they stand for."""
        if isinstance(e, tuple):
            if e[:1] == ("var",) and e[1] in lets:
                return self._expand(parse(lets[e[1]]), {k: v for k, v in lets.items() if k != e[1]})
            return tuple(self._expand(x, lets) for x in e)
        return [self._expand(x, lets) for x in e] if isinstance(e, list) else e

    def validate(self, nodes: DataFrame, phase: str | None = None) -> DataFrame:
        """doc_id, pattern, rule (from 1), severity (error or warning), reason, pre."""
        phase = phase or self.default_phase or "#ALL"
        active = None if phase == "#ALL" else self.phases.get(phase, [])
        planner = Planner(Env(nodes, self.namespaces))
        out = []
        for name, rules, lets in self.patterns:
            if active is not None and name not in active:
                continue
            claims = []
            for i, rule in enumerate(rules, 1):
                e = parse(rule["context"])
                branches = self._branches(e)
                for b in branches:
                    if b[0] == "path" and b[1] == "self":
                        b = ("path", "root", [("descendant-or-self", ("kind", "node", None), []), *b[2]])
                    claims.append(planner.nodeset(b, None).select("doc_id", *COLUMNS, F.lit(i).alias("_rule")))
            if not claims:
                continue
            first = Window.partitionBy("doc_id", "pre", "band", "sub").orderBy("_rule")
            claimed = reduce(DataFrame.unionByName, claims).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
            for i, rule in enumerate(rules, 1):
                own = claimed.where(F.col("_rule") == i)
                known = self.lets | lets | rule["lets"]
                for t in rule["tests"]:
                    loop = Loop(planner, own)
                    holds = loop.boolean(loop.value(self._expand(parse(t["test"]), known)))
                    message = self._message(loop, t["row"], known, t["put"])
                    bad = loop.df.where(~holds if t["kind"] == "assert" else holds)
                    out.append(bad.select("doc_id", F.lit(name).alias("pattern"), F.lit(i).alias("rule"), F.lit("error" if t["kind"] == "assert" else "warning").alias("severity"), message.alias("reason"), "pre"))
        if not out:
            return nodes.sparkSession.createDataFrame([], "doc_id string, pattern string, rule int, severity string, reason string, pre int")
        return reduce(DataFrame.unionByName, out)

    def _branches(self, e) -> list:
        return [*self._branches(e[1]), *self._branches(e[2])] if e[0] == "union" else [e]

    def _message(self, loop: Loop, row: list, lets: dict, put):
        parts = []
        for x in self.kids.get(row[T.PRE], []):
            if x[T.KIND] in ("text", "cdata"):
                parts.append(F.lit(x[T.VALUE]))
            elif x[T.LOCAL] == "value-of":
                parts.append(loop.string(loop.value(self._expand(parse(put(self._get(x, "select"))), lets))))
            elif x[T.LOCAL] == "name":
                parts.append(loop.string(loop.value(parse(f"name({self._get(x, 'path') or '.'})"))))
            elif x[T.SVAL]:
                parts.append(F.lit(x[T.SVAL]))
        return F.btrim(F.regexp_replace(F.concat(*parts), r"[ \t\n\r]+", " "), F.lit(" ")) if parts else F.lit("")
