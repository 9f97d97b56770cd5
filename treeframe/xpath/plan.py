"""From XPath to DataFrame plans.

A node-set is a DataFrame of node rows with ``_k``, the key of the context node it was reached from. A step is an
equi-join on doc_id and a node number; a downward path without predicates is a filter on the stored path, with no join.
A scalar is a Column over the context rows. A node-set within a scalar is aggregated by its context and joined back,
unless it is an attribute or the context itself, which the row already has. Positions are windows over a step's context.
All joins carry doc_id, so that a node table bucketed or partitioned by it is not shuffled again.

Null doc_ids are not joined. An empty node table gives empty results; a document without a match gives no row (a node-set)
or the empty set's value (a scalar). Names without declared prefixes match the written name or the local name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeframe.functions import values as V
from treeframe.xpath.parser import XPathError, calls, fused, parse, positional, static_type

#: Columns of a node row in a plan.
COLUMNS = ("pre", "band", "sub", "last", "parent", "sib", "kind", "prefix", "local", "ns", "value", "sval", "attrs", "nsmap", "anc", "lang")
ORDER = ("pre", "band", "sub")
_KEY = ("doc_id", *ORDER)
_REVERSE = frozenset("parent ancestor ancestor-or-self preceding preceding-sibling".split())
_ITEM = ("pre", "band", "sub", "sval", "kind", "prefix", "local", "ns")


@dataclass(frozen=True)
class Value:
    """A scalar column or, with ast, a node-set yet to be made. type: num, str, bool or set."""

    type: str
    column: Column | None = None
    ast: tuple | None = None


@dataclass
class Env:
    nodes: DataFrame
    namespaces: dict[str, str] | None = None
    variables: dict[str, object] = field(default_factory=dict)
    keys: dict[str, tuple[str, str]] = field(default_factory=dict)

    def tree(self) -> DataFrame:
        """The node table with the columns of a plan."""
        have = set(self.nodes.columns)
        added = {"band": F.lit(0), "sub": F.lit(0)}
        return self.nodes.select("doc_id", *(added[c].alias(c) if c in added else F.col(c) if c in have else F.lit(None).alias(c) for c in COLUMNS), *(["path"] if "path" in have else []))


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns))


def _key(df: DataFrame | None = None) -> Column:
    return F.struct(*(F.col(c) for c in ORDER))


def name_test(test: tuple, axis: str, env: Env) -> Column:
    kind, a, b = test
    c = F.col
    if kind == "kind":
        if a == "node":
            return F.lit(True)
        if a == "text":
            return c("kind").isin("text", "cdata")
        if a == "comment":
            return c("kind") == "comment"
        return (c("kind") == "pi") & ((c("local") == b) if b else F.lit(True))
    principal = {"attribute": "attribute", "namespace": "namespace"}.get(axis, "element")
    right = c("kind") == principal
    prefix, local = a, b
    if local == "*":
        if prefix is None:
            return right
        if env.namespaces and prefix in env.namespaces:
            return right & (F.coalesce(c("ns"), F.lit("")) == env.namespaces[prefix])
        return right & (c("prefix") == prefix)
    if env.namespaces is None:
        rendered = F.when(c("prefix") == "", c("local")).otherwise(F.concat_ws(":", "prefix", "local"))
        if prefix is None:
            return right & (c("local") == local)
        return right & (rendered == f"{prefix}:{local}")
    if prefix is None:
        return right & (c("local") == local) & (F.coalesce(c("ns"), F.lit("")) == "")
    if prefix not in env.namespaces:
        raise XPathError(f"undeclared prefix {prefix}")
    return right & (c("local") == local) & (c("ns") == env.namespaces[prefix])


def path_regex(steps: list, env: Env) -> str | None:
    """A pattern on the stored path that holds just for the elements the steps reach from the root, if they are child and descendant steps by name."""
    out = "^"
    for axis, test, preds in steps:
        if axis not in ("child", "descendant") or preds or test[0] != "name":
            return None
        _, prefix, local = test
        if env.namespaces is not None and (prefix or local != "*"):
            return None
        name = re.escape(local) if local != "*" else "[^/]+"
        if local != "*" and prefix is None:
            name = f"(?:[^/:]+:)?{name}"
        elif prefix is not None:
            name = f"{re.escape(prefix)}:{'[^/:]+' if local == '*' else re.escape(local)}"
        out += ("" if axis == "child" else "(?:/[^/]+)*") + "/" + name
    return out + "$"


def _attributes(ctx: DataFrame, keep: list[str]) -> DataFrame:
    """Attribute nodes of the context's elements, with the context's columns keep."""
    at = ctx.where("kind = 'element'").select("doc_id", *keep, "pre", "last", "anc", "lang", F.posexplode("attrs").alias("sub", "_a"))
    out = {"band": F.lit(2), "parent": F.col("pre"), "sib": F.lit(None).cast("int"), "kind": F.lit("attribute"), "prefix": F.col("_a.prefix"), "local": F.col("_a.local"), "ns": F.col("_a.ns"), "value": F.col("_a.value"), "sval": F.col("_a.value"), "attrs": F.lit(None).cast(ctx.schema["attrs"].dataType), "nsmap": F.lit(None).cast(ctx.schema["nsmap"].dataType), "last": F.col("pre"), "anc": F.array_append("anc", F.col("pre"))}
    return at.select("doc_id", *keep, *(out[c].alias(c) if c in out else F.col(c) for c in COLUMNS))


def _bindings(ctx: DataFrame, keep: list[str]) -> DataFrame:
    """Namespace nodes; their order is that of their prefixes."""
    entries = F.array_sort(F.filter(F.map_entries(F.coalesce("nsmap", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), lambda e: e["value"] != ""))
    at = ctx.where("kind = 'element'").select("doc_id", *keep, "pre", "last", "anc", "lang", F.posexplode(entries).alias("sub", "_a"))
    out = {"band": F.lit(1), "parent": F.col("pre"), "sib": F.lit(None).cast("int"), "kind": F.lit("namespace"), "prefix": F.lit(""), "local": F.col("_a.key"), "ns": F.lit(""), "value": F.col("_a.value"), "sval": F.col("_a.value"), "attrs": F.lit(None).cast(ctx.schema["attrs"].dataType), "nsmap": F.lit(None).cast(ctx.schema["nsmap"].dataType), "last": F.col("pre"), "anc": F.array_append("anc", F.col("pre"))}
    return at.select("doc_id", *keep, *(out[c].alias(c) if c in out else F.col(c) for c in COLUMNS))


class Planner:
    def __init__(self, env: Env):
        self.env = env

    # node-sets

    def roots(self) -> DataFrame:
        return self.env.tree().where("kind = 'document'").drop("path")

    def step(self, ctx: DataFrame, axis: str, test: tuple, from_root: bool) -> DataFrame:
        """ctx has _k and node columns. The nodes reached, with _k and _p, the key of the node they were reached from."""
        ctx = ctx.withColumn("_p", _key())
        keep = ["_k", "_p"]
        match_ = name_test(test, axis, self.env)
        if axis == "self":
            return ctx.where(match_)
        if axis == "attribute":
            return _attributes(ctx, keep).where(match_)
        if axis == "namespace":
            return _bindings(ctx, keep).where(match_)
        tree = self.env.tree().drop("path")
        found = tree.where(match_)
        c = lambda name: F.col(f"c_{name}")
        here = ctx.select(F.col("doc_id").alias("c_doc"), *(F.col(x) for x in keep), *(F.col(x).alias(f"c_{x}") for x in ("pre", "band", "last", "parent", "sib", "anc")))
        same = F.col("doc_id") == c("doc")
        if axis in ("descendant", "descendant-or-self") and from_root:
            below = F.col("kind") != "document" if axis == "descendant" else F.lit(True)
            joined = found.where(below).join(here, same)
        elif axis == "child":
            joined = found.join(here.where("c_band = 0"), same & (F.col("parent") == c("pre")))
        elif axis in ("descendant", "descendant-or-self"):
            # attributes and bindings have nothing below, but are themselves in descendant-or-self
            up = F.array_append("anc", F.col("pre")) if axis.endswith("self") else F.col("anc")
            joined = found.withColumn("_up", F.explode(up)).join(here.where("c_band = 0"), same & (F.col("_up") == c("pre"))).drop("_up")
            if axis.endswith("self"):
                own = ctx.where("band > 0").where(match_)
                return joined.select("doc_id", *keep, *COLUMNS).unionByName(own.select("doc_id", *keep, *COLUMNS))
        elif axis == "parent":
            joined = found.join(here.where("c_parent IS NOT NULL"), same & (F.col("pre") == c("parent")))
        elif axis in ("ancestor", "ancestor-or-self"):
            up = F.array_append("c_anc", c("pre")) if axis.endswith("self") else c("anc")
            up = F.when(c("band") > 0, c("anc")).otherwise(up)
            joined = found.join(here.withColumn("_up", F.explode(up)), same & (F.col("pre") == F.col("_up"))).drop("_up")
            if axis.endswith("self"):
                own = ctx.where("band > 0").where(match_)
                return joined.select("doc_id", *keep, *COLUMNS).unionByName(own.select("doc_id", *keep, *COLUMNS))
        elif axis in ("following-sibling", "preceding-sibling"):
            side = F.col("sib") > c("sib") if axis[0] == "f" else F.col("sib") < c("sib")
            joined = found.join(here.where("c_band = 0"), same & (F.col("parent") == c("parent")) & side)
        elif axis == "following":
            joined = found.join(here, same & (F.col("pre") > F.when(c("band") > 0, c("pre")).otherwise(c("last"))))
        else:  # preceding
            joined = found.join(here, same & (F.col("pre") < c("pre")) & ~F.array_contains(c("anc"), F.col("pre")) & (F.col("kind") != "document"))
        return joined.select("doc_id", *keep, *COLUMNS)

    def filtered(self, found: DataFrame, predicates: list, reverse: bool, scope: tuple[str, ...]) -> DataFrame:
        """found after predicates; positions count within scope, from the near end for reverse axes."""
        for e in predicates:
            if positional(e):
                order = [F.col(x).desc() if reverse else F.col(x) for x in ORDER]
                by = Window.partitionBy("doc_id", *scope)
                place = {"_pos": F.row_number().over(by.orderBy(*order)).cast("double")}
                if calls(e, {"last"}):
                    place["_size"] = F.count("*").over(by).cast("double")
                found = found.withColumns(place)
            loop = Loop(self, found)
            v = loop.value(e)
            if v.type == "num":
                found = loop.df.where(v.column == F.col("_pos"))
            else:
                test = loop.boolean(v)
                found = loop.df.where(test)
            found = found.select("doc_id", *(x for x in ("_k", "_p") if x in found.columns), *COLUMNS)
        return found

    def path(self, start: DataFrame, steps: list, from_root: bool) -> DataFrame:
        steps = fused(steps)
        single = from_root  # whether each _k has one context node
        done = 0
        if from_root and "path" in self.env.nodes.columns:
            while done < len(steps) and path_regex(steps[: done + 1], self.env):
                done += 1
            if done:
                # a downward path from the root is a filter
                hit = self.env.tree().where((F.col("kind") == "element") & F.col("path").rlike(path_regex(steps[:done], self.env))).drop("path")
                if start is None:
                    start = hit.withColumn("_k", F.struct(F.lit(0).alias("pre"), F.lit(0).alias("band"), F.lit(0).alias("sub")))
                else:
                    start = hit.join(start.select(F.col("doc_id").alias("c_doc"), "_k").distinct(), F.col("doc_id") == F.col("c_doc")).drop("c_doc")
                single = False
        if start is None:
            start = self.roots().withColumn("_k", _key())
        current, at_root = start, from_root and not done
        for axis, test, predicates in steps[done:]:
            reverse = axis in _REVERSE
            current = self.step(current, axis, test, at_root)
            current = self.filtered(current, predicates, reverse, ("_k", "_p"))
            if not single and axis not in ("child", "attribute", "namespace", "self"):
                current = current.dropDuplicates(["doc_id", "_k", *ORDER])
            single, at_root = single and axis == "self", False
        return current.select("doc_id", "_k", *COLUMNS)

    def nodeset(self, e: tuple, loop: DataFrame | None) -> DataFrame:
        """loop: distinct context rows; None: the document nodes, not joined unless needed."""
        context = lambda: (self.roots() if loop is None else loop).withColumn("_k", _key())
        match e[0]:
            case "path":
                if e[1] == "root":
                    return self.path(None if loop is None else self._to_root(context()), e[2], True)
                if e[1] == "self":
                    return self.path(None if loop is None else context(), e[2], loop is None)
                return self.path(self.nodeset(e[1], loop), e[2], False)
            case "union":
                both = self.nodeset(e[1], loop).unionByName(self.nodeset(e[2], loop))
                return both.dropDuplicates(["doc_id", "_k", *ORDER])
            case "filter":
                return self.filtered(self.nodeset(e[1], loop), e[2], False, ("_k",)).select("doc_id", "_k", *COLUMNS)
            case "call":
                return self.set_call(e[1], e[2], loop, context)
        raise XPathError("a node-set is expected")

    def _to_root(self, context: DataFrame) -> DataFrame:
        roots = self.roots()
        return roots.join(context.select(F.col("doc_id").alias("c_doc"), "_k"), F.col("doc_id") == F.col("c_doc")).drop("c_doc")

    def set_call(self, name: str, args: list, loop: DataFrame | None, context) -> DataFrame:
        on = ["doc_id", "_k", *ORDER]
        if name == "current":
            return context()
        if name in ("id", "key"):
            ctx = context()
            wanted = args[-1]
            if static_type(wanted) == "set":
                ids = self.nodeset(wanted, loop).select(F.col("doc_id").alias("c_doc"), "_k", F.col("sval").alias("_v"))
            else:
                own = Loop(self, ctx)
                text = own.string(own.value(wanted))
                ids = own.df.select(F.col("doc_id").alias("c_doc"), "_k", text.alias("_v"))
            if name == "id":
                ids = ids.withColumn("_v", F.explode(F.split(F.btrim("_v", F.lit(" \t\n\r")), r"[ \t\n\r]+")))
                tree = self.env.tree().drop("path").where("kind = 'element'")
                tree = tree.withColumn("_id", F.explode(F.transform(F.filter("attrs", lambda a: (a["local"] == "id") & a["prefix"].isin("", "xml")), lambda a: a["value"])))
                return tree.join(ids.distinct(), (F.col("doc_id") == F.col("c_doc")) & (F.col("_id") == F.col("_v"))).select(*on[:2], *COLUMNS).dropDuplicates(on)
            if args[0][0] != "str" or args[0][1] not in self.env.keys:
                raise XPathError("unknown key")
            uses = key_table(self, *self.env.keys[args[0][1]])
            return uses.join(ids.distinct(), (F.col("doc_id") == F.col("c_doc")) & (F.col("_use") == F.col("_v"))).select(*on[:2], *COLUMNS).dropDuplicates(on)
        sets = [self.nodeset(a, loop) for a in args]
        first = sets[0]
        if name == "set:distinct":
            w = Window.partitionBy("doc_id", "_k", "sval").orderBy(*ORDER)
            return first.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        if name in ("set:difference", "set:intersection"):
            return first.join(sets[1].select(*on), on, "left_anti" if name == "set:difference" else "left_semi").select("doc_id", "_k", *COLUMNS)
        if name in ("set:leading", "set:trailing"):
            pivot = sets[1].groupBy(F.col("doc_id").alias("c_doc"), F.col("_k").alias("_k2")).agg(F.min(_key()).alias("_m"))
            both = first.join(pivot, (F.col("doc_id") == F.col("c_doc")) & (F.col("_k") == F.col("_k2")), "left")
            has = sets[1].select(F.col("doc_id").alias("d2"), F.col("_k").alias("k3"), F.struct(*(F.col(c) for c in ORDER)).alias("_key2"))
            inside = first.select("doc_id", "_k", _key().alias("_key1")).join(has, (F.col("doc_id") == F.col("d2")) & (F.col("_k") == F.col("k3")) & (F.col("_key1") == F.col("_key2"))).select(F.col("doc_id").alias("d4"), F.col("_k").alias("k4")).distinct()
            side = _key() < F.col("_m") if name == "set:leading" else _key() > F.col("_m")
            both = both.join(inside, (F.col("doc_id") == F.col("d4")) & (F.col("_k") == F.col("k4")), "left")
            # the pivot has to be in the first set; without a pivot all stay
            return both.where(F.col("_m").isNull() | (F.col("d4").isNotNull() & side)).select("doc_id", "_k", *COLUMNS)
        if name in ("math:highest", "math:lowest"):
            x = V.number_of_string(F.col("sval"))
            by = Window.partitionBy("doc_id", "_k")
            best = (F.max if name == "math:highest" else F.min)(x).over(by)
            out = first.withColumns({"_x": x, "_best": best, "_bad": F.max(F.isnan(x)).over(by)})
            return out.where(~F.col("_bad") & (F.col("_x") == F.col("_best"))).select("doc_id", "_k", *COLUMNS)
        raise XPathError(f"unknown function {name}")


def key_table(planner: Planner, match: str, use: str) -> DataFrame:
    """Nodes that match (a path from anywhere), with _use, a row for each value of use."""
    e = parse(match)
    if e[0] == "path" and e[1] == "self":
        e = ("path", "root", [("descendant-or-self", ("kind", "node", None), []), *e[2]])
    found = planner.nodeset(e, None).drop("_k")
    u = parse(use)
    if static_type(u) == "set":
        vals = planner.nodeset(u, found).select(F.col("doc_id").alias("c_doc"), F.col("_k").alias("_k2"), F.col("sval").alias("_use"))
        return found.join(vals, (F.col("doc_id") == F.col("c_doc")) & (_key() == F.col("_k2"))).select("doc_id", *COLUMNS, "_use")
    loop = Loop(planner, found)
    s = loop.string(loop.value(u))
    return loop.df.withColumn("_use", s).select("doc_id", *COLUMNS, "_use")


class Loop:
    """Context rows to which the values that an expression needs are joined, as columns."""

    def __init__(self, planner: Planner, df: DataFrame):
        self.planner, self.df, self.n = planner, df, 0
        self.context, self.made = df, {}  # the rows without what is joined to them; what was joined, by node-set and aggregates

    def attach(self, e: tuple, **aggregates: Column) -> dict[str, Column]:
        """Joins aggregates of a node-set, by context row; they are null where the set is empty. What is asked for again is there already."""
        key = (repr(e), *(f"{k} {c}" for k, c in aggregates.items()))
        if key not in self.made:
            self.made[key] = self._attach(e, aggregates)
        return self.made[key]

    def _attach(self, e: tuple, aggregates: dict[str, Column]) -> dict[str, Column]:
        self.n += 1
        # of the context alone, so that each plan holds it once, however many node-sets are attached
        rows = self.context.select("doc_id", *COLUMNS).dropDuplicates(list(_KEY))
        names = {k: f"_v{self.n}_{k}" for k in aggregates}
        made = self.planner.nodeset(e, rows).groupBy("doc_id", "_k").agg(*(c.alias(names[k]) for k, c in aggregates.items()))
        made = made.withColumnsRenamed({"doc_id": "_jd", "_k": "_jk"})
        self.df = self.df.join(made, (F.col("doc_id") == F.col("_jd")) & (_key() == F.col("_jk")), "left").drop("_jd", "_jk")
        return {k: F.col(v) for k, v in names.items()}

    def local(self, e: tuple) -> Column | None:
        """The node-set as an array of items if the context row has it: itself or its attributes."""
        if e[0] != "path" or e[1] != "self" or len(e[2]) != 1 or e[2][0][2]:
            return None
        axis, test, _ = e[2][0]
        if axis == "self" and test == ("kind", "node", None):
            return F.array(F.struct(*(F.col(c) for c in _ITEM)))
        if axis == "attribute" and test[0] == "name" and self.planner.env.namespaces is None:
            _, prefix, local = test
            own = F.coalesce("attrs", F.array().cast(self.df.schema["attrs"].dataType))
            if local != "*":
                own = F.filter(own, lambda a: (a["local"] == local) & ((a["prefix"] == prefix) if prefix else F.lit(True)))
            elif prefix:
                own = F.filter(own, lambda a: a["prefix"] == prefix)
            return F.transform(own, lambda a, i: F.struct(F.col("pre").alias("pre"), F.lit(2).alias("band"), i.alias("sub"), a["value"].alias("sval"), F.lit("attribute").alias("kind"), a["prefix"].alias("prefix"), a["local"].alias("local"), a["ns"].alias("ns")))
        return None

    def items(self, v: Value) -> Column:
        """The node-set in document order, as an array."""
        if (own := self.local(v.ast)) is not None:
            return own
        got = self.attach(v.ast, all=F.array_sort(F.collect_list(F.struct(*(F.col(c) for c in _ITEM)))))["all"]
        return F.coalesce(got, F.array().cast(f"array<struct<{','.join(f'{c}:{t}' for c, t in zip(_ITEM, ('int', 'int', 'int', *['string'] * 5), strict=True))}>>"))

    def first(self, v: Value, what: str = "sval") -> Column:
        if (own := self.local(v.ast)) is not None:
            return F.coalesce(F.get(own, F.lit(0))[what], F.lit(""))
        return F.coalesce(self.attach(v.ast, first=F.min_by(what, _key()))["first"], F.lit(""))

    def exists(self, v: Value) -> Column:
        if (own := self.local(v.ast)) is not None:
            return F.size(own) > 0
        return F.coalesce(self.attach(v.ast, any=F.count("*") > 0)["any"], F.lit(False))

    # conversions

    def string(self, v: Value) -> Column:
        match v.type:
            case "set":
                return self.first(v)
            case "num":
                return V.string_of_number(v.column)
            case "bool":
                return V.string_of_boolean(v.column)
        return v.column

    def number(self, v: Value) -> Column:
        match v.type:
            case "num":
                return v.column
            case "bool":
                return V.number_of_boolean(v.column)
        return V.number_of_string(self.string(v))

    def boolean(self, v: Value) -> Column:
        match v.type:
            case "set":
                return self.exists(v)
            case "num":
                return V.boolean_of_number(v.column)
            case "str":
                return V.boolean_of_string(v.column)
        return v.column

    # expressions

    def value(self, e: tuple) -> Value:
        match e[0]:
            case "num":
                return Value("num", F.lit(e[1]))
            case "str":
                return Value("str", F.lit(e[1]))
            case "var":
                if e[1] not in self.planner.env.variables:
                    raise XPathError(f"unbound variable {e[1]}")
                x = self.planner.env.variables[e[1]]
                return Value("bool", F.lit(x)) if isinstance(x, bool) else Value("num", F.lit(float(x))) if isinstance(x, (int, float)) else Value("str", F.lit(str(x)))
            case "neg":
                return Value("num", -self.number(self.value(e[1])))
            case "op":
                return self.operator(e[1], e[2], e[3])
            case "path" | "union":
                return Value("set", ast=e)
            case "filter":
                return Value("set", ast=e)
            case "call":
                return self.call(e[1], e[2])
        raise XPathError(f"unknown expression {e[0]}")

    def operator(self, op: str, a: tuple, b: tuple) -> Value:
        x, y = self.value(a), self.value(b)
        if op in ("and", "or"):
            p, q = self.boolean(x), self.boolean(y)
            return Value("bool", p & q if op == "and" else p | q)
        if op in ("+", "-", "*", "div", "mod"):
            p, q = self.number(x), self.number(y)
            return Value("num", {"+": lambda: p + q, "-": lambda: p - q, "*": lambda: p * q, "div": lambda: V.divide(p, q), "mod": lambda: V.modulo(p, q)}[op]())
        return Value("bool", self.comparison(op, x, y))

    def comparison(self, op: str, x: Value, y: Value) -> Column:
        swapped = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
        if x.type == "set" and y.type == "set":
            p, q = self.items(x), self.items(y)
            if op in ("=", "!="):
                text = lambda c: F.transform(c, lambda i: i["sval"])
                if op == "=":
                    return F.arrays_overlap(text(p), text(q))
                return (F.size(p) > 0) & (F.size(q) > 0) & (F.size(F.array_distinct(F.concat(text(p), text(q)))) > 1)
            return F.exists(p, lambda i: F.exists(q, lambda j: V.compare(op, V.number_of_string(i["sval"]), V.number_of_string(j["sval"]))))
        if y.type == "set":
            return self.comparison(swapped.get(op, op), y, x)
        if x.type == "set":
            if y.type == "bool":
                p, q = self.exists(x), y.column
                return V.compare(op, V.number_of_boolean(p), V.number_of_boolean(q))
            if op in ("=", "!=") and y.type == "str":
                test = lambda s: s == y.column if op == "=" else s != y.column
            else:
                n = self.number(y)
                test = lambda s: V.compare(op, V.number_of_string(s), n)
            if (own := self.local(x.ast)) is not None:
                return F.exists(own, lambda i: test(i["sval"]))
            return F.exists(self.items(x), lambda i: test(i["sval"]))
        if op in ("=", "!="):
            if "bool" in (x.type, y.type):
                p, q = self.boolean(x), self.boolean(y)
                return p == q if op == "=" else p != q
            if "num" not in (x.type, y.type):
                p, q = self.string(x), self.string(y)
                return p == q if op == "=" else p != q
        return V.compare(op, self.number(x), self.number(y))

    def call(self, name: str, args: list) -> Value:
        name = name.removeprefix("exsl:") if name == "exsl:object-type" else name
        here = ("path", "self", [("self", ("kind", "node", None), [])])
        arg = lambda i: self.value(args[i])
        text = lambda i=0: self.string(arg(i) if len(args) > i else self.value(here))
        num = lambda i=0: self.number(arg(i) if len(args) > i else self.value(here))

        def a_set(i: int = 0) -> Value:
            v = arg(i) if len(args) > i else self.value(here)
            if v.type != "set":
                raise XPathError(f"{name}() needs a node-set")
            return v

        match name:
            case "position":
                return Value("num", F.col("_pos") if "_pos" in self.df.columns else F.lit(1.0))
            case "last":
                return Value("num", F.col("_size") if "_size" in self.df.columns else F.lit(1.0))
            case "count":
                v = a_set()
                own = self.local(v.ast)
                return Value("num", F.size(own).cast("double") if own is not None else F.coalesce(self.attach(v.ast, n=F.count("*").cast("double"))["n"], F.lit(0.0)))
            case "sum":
                v = a_set()
                own = self.local(v.ast)
                if own is not None:
                    return Value("num", F.aggregate(own, F.lit(0.0), lambda a, i: a + V.number_of_string(i["sval"])))
                return Value("num", F.coalesce(self.attach(v.ast, sum=F.sum(V.number_of_string(F.col("sval"))))["sum"], F.lit(0.0)))
            case "math:min" | "math:max":
                v = a_set()
                x = V.number_of_string(F.col("sval"))
                got = self.attach(v.ast, best=(F.min if name == "math:min" else F.max)(x), bad=F.max(F.isnan(x)))
                return Value("num", F.when(F.coalesce(got["bad"], F.lit(True)), V.nan()).otherwise(got["best"]))
            case "set:has-same-node":
                a_set(0), a_set(1)
                return Value("bool", self.exists(Value("set", ast=("call", "set:intersection", args))))
            case "local-name":
                return Value("str", self.first(a_set(), "local"))
            case "namespace-uri":
                return Value("str", self.first(a_set(), "ns"))
            case "name":
                v = a_set()
                items = self.items(v)
                one = F.get(items, F.lit(0))
                return Value("str", F.coalesce(F.when(one["prefix"] != "", F.concat(one["prefix"], F.lit(":"), one["local"])).otherwise(one["local"]), F.lit("")))
            case "generate-id":
                one = F.get(self.items(a_set()), F.lit(0))
                return Value("str", F.coalesce(F.concat(F.lit("N"), F.col("doc_id").cast("string"), F.lit("_"), one["pre"], F.lit("_"), one["band"], F.lit("_"), one["sub"]), F.lit("")))
            case "string":
                return Value("str", text())
            case "number":
                return Value("num", num())
            case "boolean":
                return Value("bool", self.boolean(arg(0)))
            case "not":
                return Value("bool", ~self.boolean(arg(0)))
            case "true" | "false":
                return Value("bool", F.lit(name == "true"))
            case "lang":
                return Value("bool", V.lang_matches(F.col("lang"), text()))
            case "concat":
                return Value("str", reduce(lambda a, b: F.concat(a, b), [text(i) for i in range(len(args))]) if args else F.lit(""))
            case "starts-with":
                return Value("bool", F.startswith(text(0), text(1)))
            case "contains":
                return Value("bool", F.contains(text(0), text(1)))
            case "substring-before":
                return Value("str", V.substring_before(text(0), text(1)))
            case "substring-after":
                return Value("str", V.substring_after(text(0), text(1)))
            case "substring":
                return Value("str", V.substring(text(0), num(1), num(2) if len(args) > 2 else None))
            case "string-length":
                return Value("num", F.length(text()).cast("double"))
            case "normalize-space":
                return Value("str", V.normalize_space(text()))
            case "translate":
                if args[1][0] == "str" and args[2][0] == "str":
                    pairs: dict[str, str] = {}
                    for i, c in enumerate(args[1][1]):
                        pairs.setdefault(c, args[2][1][i] if i < len(args[2][1]) else "")
                    kept = [k for k, v in pairs.items() if v] + [k for k, v in pairs.items() if not v]
                    return Value("str", F.translate(text(0), "".join(kept), "".join(pairs[k] for k in kept)))
                raise XPathError("translate() needs literal character lists")
            case "floor" | "ceiling" | "round":
                return Value("num", {"floor": V.floor, "ceiling": V.ceiling, "round": V.round_half_up}[name](num()))
            case "math:abs":
                return Value("num", F.abs(num()))
            case "math:sqrt":
                return Value("num", F.sqrt(num()))
            case "object-type" | "exsl:object-type":
                kind = arg(0).type
                return Value("str", F.lit({"set": "node-set", "num": "number", "str": "string", "bool": "boolean"}[kind]))
            case "function-available" | "element-available":
                known = static_type(("call", args[0][1], [])) != "str" or args[0][1] in ("string", "concat", "name", "local-name", "namespace-uri", "substring", "substring-before", "substring-after", "normalize-space", "translate", "generate-id")
                return Value("bool", F.lit(known and name[0] == "f"))
            case "system-property":
                return Value("str", F.when(text() == "xsl:version", "1.0").otherwise(""))
        if static_type(("call", name, args)) == "set":
            return Value("set", ast=("call", name, args))
        raise XPathError(f"unknown function {name}")


def compile_xpath(expression: str) -> tuple:
    """The expression's tree; raises XPathError."""
    return parse(expression)


def _env(nodes: DataFrame, namespaces: dict[str, str] | None, variables: dict[str, object] | None, keys: dict[str, tuple[str, str]] | None) -> Env:
    return Env(nodes, namespaces, variables or {}, keys or {})


def select(nodes: DataFrame, expression: str, *, namespaces: dict[str, str] | None = None, variables: dict[str, object] | None = None, keys: dict[str, tuple[str, str]] | None = None, full: bool = False) -> DataFrame:
    """The node-set of an expression over each document: doc_id, pre, band, sub (the order key), kind, name, value (the string-value)."""
    e = compile_xpath(expression)
    planner = Planner(_env(nodes, namespaces, variables, keys))
    if static_type(e) != "set":
        raise XPathError("the expression is no node-set")
    found = planner.nodeset(e, None)
    if full:
        return found.drop("_k")
    name = F.when(F.coalesce("prefix", F.lit("")) != "", F.concat_ws(":", "prefix", "local")).otherwise(F.col("local"))
    return found.select("doc_id", *ORDER, "kind", name.alias("name"), F.col("sval").alias("value"))


def evaluate(nodes: DataFrame, expression: str, *, namespaces: dict[str, str] | None = None, variables: dict[str, object] | None = None, keys: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, value: the expression's value for each document. Node-sets give their string-value."""
    planner = Planner(_env(nodes, namespaces, variables, keys))
    loop = Loop(planner, planner.roots())
    v = loop.value(compile_xpath(expression))
    column = loop.first(v) if v.type == "set" else v.column
    return loop.df.select("doc_id", column.alias("value"))
