"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

A token budget is divided over a tree of domains, languages and sources. Among siblings each node gets the budget in
proportion to its weight, up to what its subtree can supply (its tokens times ``max_epochs``); what a short node leaves
goes to its siblings, by weight, and only what all siblings lack goes back to the level above, because a parent's own
limit is the sum of its children's. Dividing top down with those limits is that rule in closed form: with siblings sorted
by limit over weight, the full ones are a prefix, which running sums find.

A leaf of S tokens and quota q is taken q div S times whole; the rest is a prefix of the next epoch, whose order is the
MD5 of seed, epoch and id. The prefix ends at the last document whose running sum is within the rest. The cut is found
DIGITS hexadecimal digits of it at a time: sums over the 256 buckets that a leaf's open bucket has, LEVELS times, then a
running sum in the one bucket that is left, a 16-millionth of the leaf. So no task sorts a leaf, however large.

Nulls: null domain, language or source are values of their own; a null id sorts as the word null; a null text has no
tokens. Rows without tokens are taken with the prefix they stand in. Repeated rows of an id stand at one place and are
taken or left together. A leaf with weight 0 gets nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeframe.llm.common import SPACE_RUN, materialize, table, trimmed

#: Production parameters: integer weights; names that are not listed have the weight under "".
WEIGHTS = {
    "domain": {"d0": 40, "d1": 30, "d2": 20, "d3": 10, "": 1},
    "lang": {"en": 50, "de": 20, "fr": 20, "es": 10, "": 5},
    "source": {"src0": 2, "": 1},
}
SEED, MAX_EPOCHS, BUDGET_PERCENT = 17, 2, 80
DIGITS, LEVELS = 2, 3


def domain_of(source: Column) -> Column:
    """Four domains by the first hexadecimal digit of the source name's MD5."""
    digit = F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1)
    return F.when(digit < "4", "d0").when(digit < "8", "d1").when(digit < "c", "d2").otherwise("d3")


def n_words(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE_RUN))).cast("long")


def _weight(level: str, weights: dict[str, int]) -> Column:
    out = F.lit(None).cast("long")
    for k, v in weights.items():
        if k:
            out = F.when(F.col(level) == k, F.lit(v).cast("long")).otherwise(out)
    return F.coalesce(out, F.lit(weights.get("", 1)).cast("long"))


def water_fill(nodes: DataFrame, parents: list[str], child: str) -> DataFrame:
    """nodes: parents, child, _w (weight over 0), _c (limit), _b (the parent's budget). Adds _x, the child's share."""
    parent = [*parents, F.lit(1)]
    order = Window.partitionBy(*parent).orderBy(F.col("_c").cast("double") / F.col("_w"), F.col(child).asc_nulls_first())
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(*parent)
    left = F.col("_b") - F.coalesce(F.sum("_c").over(before), F.lit(0))
    nodes = nodes.withColumns({"_rn": F.row_number().over(order), "_left": left, "_rest": F.sum("_w").over(after)})
    full = F.col("_c").cast("double") * F.col("_rest") <= F.col("_left").cast("double") * F.col("_w")
    nodes = nodes.withColumn("_first", F.min(F.when(~full, F.col("_rn"))).over(every))
    at = lambda c: F.max(F.when(F.col("_rn") == F.col("_first"), F.col(c))).over(every)
    nodes = nodes.withColumns({"_num": at("_left"), "_den": at("_rest")})
    share = F.floor(F.col("_w").cast("double") * F.col("_num").cast("double") / F.col("_den").cast("double")).cast("long")
    x = F.when(F.col("_first").isNull() | (F.col("_rn") < F.col("_first")), F.col("_c")).otherwise(F.greatest(share, F.lit(0).cast("long")))
    return nodes.withColumn("_x", x).drop("_rn", "_left", "_rest", "_first", "_num", "_den")


def quotas(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """leaves: levels, _tokens. Adds _q, the leaf's tokens to take. All tables here have a row for a node, none for a document."""
    named = leaves
    for i, level in enumerate(levels):
        # limits count only what lies under positive weights
        named = named.withColumn(f"_w{i}", _weight(level, weights[level]))
    named = named.where(" AND ".join(f"_w{i} > 0" for i in range(len(levels)))).withColumn("_cap", F.col("_tokens") * max_epochs)
    out = named.withColumn("_b", budget)
    for i, level in enumerate(levels):
        nodes = out.groupBy(*levels[: i + 1]).agg(F.max(f"_w{i}").alias("_w"), F.sum("_cap").alias("_c"), F.max("_b").alias("_b"))
        nodes = water_fill(nodes, levels[:i], level).select(*(F.col(c).alias(f"_k{j}") for j, c in enumerate(levels[: i + 1])), F.col("_x"))
        same = F.lit(True)
        for j, c in enumerate(levels[: i + 1]):
            same = same & out[c].eqNullSafe(nodes[f"_k{j}"])
        out = out.join(nodes, same).withColumn("_b", F.col("_x")).drop("_x", *(f"_k{j}" for j in range(i + 1)))
    return out.select(*levels, "_tokens", F.col("_b").alias("_q"))


def _place(seed: int, epoch: Column, id_: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(id_.cast("string"), F.lit("null"))).cast("binary"))


def plan(rows: DataFrame, *, seed: int, weights: dict, max_epochs: int, budget_percent: int) -> DataFrame:
    """rows: _id, domain, lang, source, _n. A row for each leaf: _d, _l, _s, _epochs (times whole), _cut (the first digits of the place of the cut; null: none), _last (place in it, or null)."""
    levels, leaf = ["domain", "lang", "source"], ["_d", "_l", "_s"]
    leaves = materialize(rows.groupBy(*levels).agg(F.sum("_n").alias("_tokens")), "mix-leaves")
    total = leaves.agg(F.sum("_tokens")).first()[0] or 0
    q = quotas(leaves, levels, weights, F.lit(total * budget_percent // 100).cast("long"), max_epochs)
    whole = F.when(F.col("_tokens") > 0, F.floor(F.col("_q") / F.col("_tokens"))).otherwise(max_epochs).cast("long")
    q = q.select(F.col("domain").alias("_d"), F.col("lang").alias("_l"), F.col("source").alias("_s"), whole.alias("_epochs"), (F.col("_q") - F.col("_tokens") * whole).alias("_r"))
    open_ = materialize(q.withColumns({"_cut": F.lit(""), "_base": F.lit(0).cast("long")}), "mix-quotas")
    for level in range(LEVELS):
        # _base: tokens before the open bucket, whose places begin with _cut
        placed = _placed(rows, open_, seed)
        buckets = placed.groupBy(*leaf, "_r", "_base", F.substring("_h", 1, DIGITS * (level + 1)).alias("_k")).agg(F.sum("_n").alias("_n"))
        run = F.col("_base") + F.sum("_n").over(Window.partitionBy(*leaf).orderBy("_k"))
        cut = buckets.withColumn("_sum", run).where("_sum > _r").groupBy(*leaf).agg(F.min(F.struct("_k", (F.col("_sum") - F.col("_n")).alias("_before"))).alias("_m"))
        cut = cut.select(*(F.col(c).alias(f"{c}2") for c in leaf), F.col("_m._k").alias("_next"), F.col("_m._before").alias("_before"))
        open_ = _same(open_, materialize(cut, "mix-cuts"), leaf, "2", "left")
        open_ = materialize(open_.select(*leaf, "_epochs", "_r", F.col("_next").alias("_cut"), F.col("_before").alias("_base")), "mix-open")
    inside = _placed(rows, open_, seed)
    inside = inside.withColumn("_sum", F.col("_base") + F.sum("_n").over(Window.partitionBy(*leaf).orderBy("_h")))
    last = inside.where("_sum <= _r").groupBy(*leaf).agg(F.max("_h").alias("_last"))
    last = last.select(*(F.col(c).alias(f"{c}2") for c in leaf), "_last")
    return materialize(_same(open_, last, leaf, "2", "left").select(*leaf, "_epochs", "_cut", "_last"), "mix-plan")


def _placed(rows: DataFrame, open_: DataFrame, seed: int) -> DataFrame:
    """The rows of each leaf's open bucket, with their place _h."""
    return _with(rows, open_.where("_cut IS NOT NULL")).withColumn("_h", _place(seed, F.col("_epochs"), F.col("_id"))).where(F.startswith("_h", "_cut"))


def _same(a: DataFrame, b: DataFrame, keys: list[str], suffix: str, how: str) -> DataFrame:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[f"{k}{suffix}"])
    return a.join(b, on, how)


def _with(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    on = rows["domain"].eqNullSafe(leaves["_d"]) & rows["lang"].eqNullSafe(leaves["_l"]) & rows["source"].eqNullSafe(leaves["_s"])
    return rows.join(leaves, on)


def mixed(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domain: Column | None = None, carry: list[str] | None = None, seed: int = SEED, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS, budget_percent: int = BUDGET_PERCENT) -> DataFrame:
    """_id, domain, lang, source, _n (tokens; null with carry), _copies (over 0), and with carry the carried columns as struct _row."""
    key = [F.col(id_col).alias("_id"), (domain_of(F.col(source)) if domain is None else domain).alias("domain"), F.col(lang).alias("lang"), F.col(source).alias("source")]
    rows = materialize(df.select(*key, n_words(F.col(text)).alias("_n")), "mix-rows")
    leaves = plan(rows, seed=seed, weights=weights, max_epochs=max_epochs, budget_percent=budget_percent)
    if carry:  # the choice depends on id and leaf only, so that it is made again beside the texts, which don't move
        rows = df.select(*key, F.lit(None).cast("long").alias("_n"), F.struct(*(F.col(c) for c in carry)).alias("_row"))
    h = _place(seed, F.col("_epochs"), F.col("_id"))
    k = F.substring(h, 1, DIGITS * LEVELS)
    partly = F.col("_cut").isNull() | (k < F.col("_cut")) | ((k == F.col("_cut")) & F.coalesce(h <= F.col("_last"), F.lit(False)))
    copies = F.least(F.col("_epochs") + F.when(partly, 1).otherwise(0), F.lit(max_epochs)).cast("long")
    return _with(rows, leaves).withColumn("_copies", copies).where("_copies > 0")


def mix(df: DataFrame, *, id_col: str = "doc_id", **params) -> DataFrame:
    """A row for each row of df that is taken: id, domain, lang, source, n_tokens, copies."""
    return mixed(df, id_col=id_col, **params).select(F.col("_id").alias(id_col), "domain", "lang", "source", F.col("_n").alias("n_tokens"), F.col("_copies").alias("copies"))


def mix_rows(df: DataFrame, **params) -> DataFrame:
    """The rows taken, with df's columns, each as often as it is taken."""
    out = mixed(df, carry=df.columns, **params)
    out = out.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select(*(F.col("_row")[c].alias(c) for c in df.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _case(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items() if k) + f" ELSE {WEIGHTS[level].get('', 1)} END"


def _fill_sql(name: str, source: str, levels: list[str]) -> str:
    """Budget _b of each parent in source over its children: name(levels, x)."""
    ps, child = levels[:-1], levels[-1]
    part = f"PARTITION BY {', '.join(ps)}" if ps else "PARTITION BY 1"
    cols = ", ".join(levels)
    return f"""{name}_n AS (SELECT {cols}, max({_case(child)}) AS w, sum(cap)::BIGINT AS c, max(b) AS b FROM {source} GROUP BY {cols}),
{name}_o AS (SELECT *, row_number() OVER o AS rn, b - coalesce(sum(c) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM {name}_n WINDOW o AS ({part} ORDER BY c::DOUBLE / w, {child} NULLS FIRST)),
{name}_f AS (SELECT *, min(rn) FILTER (NOT c::DOUBLE * r::DOUBLE <= l::DOUBLE * w::DOUBLE) OVER ({part}) AS fi FROM {name}_o),
{name}_g AS (SELECT *, max(l) FILTER (rn = fi) OVER ({part}) AS num, max(r) FILTER (rn = fi) OVER ({part}) AS den FROM {name}_f),
{name} AS (SELECT {cols}, CASE WHEN fi IS NULL OR rn < fi THEN c ELSE greatest(floor(w::DOUBLE * num::DOUBLE / den::DOUBLE)::BIGINT, 0) END AS x FROM {name}_g)"""


def _on(a: str, b: str, levels: list[str]) -> str:
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in levels)


SQL = rf"""WITH d0 AS (SELECT doc_id, lang, source, substr(md5(coalesce(source, '')), 1, 1) AS hx, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
d AS (SELECT doc_id, CASE WHEN hx < '4' THEN 'd0' WHEN hx < '8' THEN 'd1' WHEN hx < 'c' THEN 'd2' ELSE 'd3' END AS domain, lang, source, n FROM d0),
leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS t, (sum(n) * {MAX_EPOCHS})::BIGINT AS cap, (SELECT floor(sum(n) * {BUDGET_PERCENT} / 100)::BIGINT FROM d) AS b FROM d GROUP BY ALL),
{_fill_sql("a", "leaf", ["domain"])},
leaf2 AS (SELECT leaf.* REPLACE (a.x AS b) FROM leaf JOIN a ON {_on("leaf", "a", ["domain"])}),
{_fill_sql("bb", "leaf2", ["domain", "lang"])},
leaf3 AS (SELECT leaf2.* REPLACE (bb.x AS b) FROM leaf2 JOIN bb ON {_on("leaf2", "bb", ["domain", "lang"])}),
{_fill_sql("cc", "leaf3", ["domain", "lang", "source"])},
q AS (SELECT leaf3.*, CASE WHEN t > 0 THEN cc.x // t ELSE {MAX_EPOCHS} END AS epochs, CASE WHEN t > 0 THEN cc.x % t ELSE 0 END AS rest FROM leaf3 JOIN cc ON {_on("leaf3", "cc", ["domain", "lang", "source"])}),
h AS (SELECT d.*, epochs, rest, md5('{SEED}:' || epochs::VARCHAR || ':' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM d JOIN q ON {_on("d", "q", ["domain", "lang", "source"])}),
s AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h) AS run FROM h)
SELECT doc_id, domain, lang, source, n AS n_tokens, least(epochs + CASE WHEN run <= rest THEN 1 ELSE 0 END, {MAX_EPOCHS})::BIGINT AS copies FROM s WHERE least(epochs + CASE WHEN run <= rest THEN 1 ELSE 0 END, {MAX_EPOCHS}) > 0"""
