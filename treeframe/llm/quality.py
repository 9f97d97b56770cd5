"""Quality rules with thresholds that adapt to language and source.

Every document gets integer metrics from built-in functions. For each (language, source) and metric a mergeable
quantile sketch is kept: counts in logarithmic bins of relative width GAMMA - 1. Sketches merge by adding counts, so they
are ordinary partial aggregations, exact in their counts and the same in whatever order tasks end. A group below
``min_docs`` documents takes the sketch of its language, merged over sources, and a language below it the sketch of all.
The threshold of a metric is ``q50 + spread * (q75 - q50)``, never under the metric's floor, and a document above any
threshold is rejected. The thresholds, a row for each group, are joined to the documents.

Nulls: a null text has no words (and so fails the base rule); null languages and sources are groups of their own; ids are
only carried. Repeated rows count each. Columns of other names are carried if asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeframe.llm.common import SPACE_RUN, SPACES, materialize, table, trimmed, without

SYMBOLS = "#*$%&|<>"
GAMMA = 1.05
#: metric: floor of its threshold (per thousand words, lines or words; hundredths of a character for word_length)
FLOORS = {"symbols": 100, "shouts": 200, "dup_lines": 500, "repeats": 200, "word_length": 1200}
SPREAD = 6
MIN_DOCS = 200


def measured(df: DataFrame, text: str) -> DataFrame:
    """df with a struct column _tf_q: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouts."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_tf_t", trimmed(F.col(text)))
    df = df.withColumn("_tf_w", F.when(F.col("_tf_t") != "", F.split("_tf_t", SPACE_RUN)).otherwise(F.array().cast("array<string>")))
    w, n = F.col("_tf_w"), F.size("_tf_w")
    windows = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5))))
    df = df.withColumn("_tf_h", F.when(n >= 6, windows))
    repeated = F.size(F.array_distinct("_tf_h")) < F.size("_tf_h")
    df = df.withColumn("_tf_s", F.when(repeated, F.array_sort(F.transform("_tf_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("_tf_s")
    twice = F.filter(s, lambda e, i: (e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"]))
    df = df.withColumn("_tf_i", F.array_sort(F.transform(twice, lambda e: e["i"])))
    covered = F.aggregate(
        "_tf_i",
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    df = df.withColumn("_tf_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    long = lambda c: c.cast("long")
    q = F.struct(
        long(n).alias("n_words"),
        long(F.length(without(F.col("_tf_t"), SPACES))).alias("word_chars"),
        long(F.length(t) - F.length(without(t, SYMBOLS))).alias("n_symbols"),
        long(F.size("_tf_l") - F.size(F.array_distinct("_tf_l"))).alias("n_dup_lines"),
        long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
        long(F.size("_tf_l")).alias("n_lines"),
        long(F.length(t) - F.length(without(t, "!?"))).alias("n_shouts"),
    )
    return df.withColumn("_tf_q", q).drop("_tf_t", "_tf_w", "_tf_h", "_tf_s", "_tf_i", "_tf_l")


def _rate(a: Column, b: Column, k: int) -> Column:
    return F.when(b > 0, F.floor(a * k / b)).otherwise(F.lit(0)).cast("long")


def rates(q: Column) -> dict[str, Column]:
    return {
        "symbols": _rate(q["n_symbols"], q["n_words"], 1000),
        "shouts": _rate(q["n_shouts"], q["n_words"], 1000),
        "dup_lines": _rate(q["n_dup_lines"], q["n_lines"], 1000),
        "repeats": _rate(q["n_repeat_words"], q["n_words"], 1000),
        "word_length": _rate(q["word_chars"], q["n_words"], 100),
    }


def sketch(metrics: DataFrame) -> DataFrame:
    """lang, source, metric, bin, n: bin 0 holds zeros, bin b the values of [GAMMA ** (b - 1), GAMMA ** b)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in rates(F.col("_tf_q")).items())))
    bins = F.when(F.col("p.v") > 0, F.floor(F.ln(F.col("p.v").cast("double")) / F.ln(F.lit(GAMMA))) + 1).otherwise(0).cast("int")
    return metrics.select("lang", "source", pairs.alias("p")).select("lang", "source", "p.metric", bins.alias("bin")).groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))


def thresholds(sketched: DataFrame, min_docs: int = MIN_DOCS, spread: float = SPREAD, floors: dict[str, int] = FLOORS, pull: float | None = None) -> DataFrame:
    """lang, source, max_<metric>. With pull, no group's threshold exceeds pull times its language's, nor that one pull times that of all."""
    floor = F.coalesce(*(F.when(F.col("metric") == k, F.lit(float(v))) for k, v in floors.items()))
    edge = F.when(F.col("bin") > 0, F.pow(F.lit(GAMMA), (F.col("bin") - 1).cast("double"))).otherwise(F.lit(0.0))

    def limits(level: list[str], name: str) -> DataFrame:
        keys = [*level, "metric"]
        merged = sketched.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
        merged = merged.withColumn("_c", F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))).withColumn("_n", F.sum("n").over(Window.partitionBy(*keys)))
        at = lambda q: F.min(F.when(F.col("_c") >= q * F.col("_n"), edge))
        out = merged.groupBy(*keys).agg(at(0.5).alias("_a"), at(0.75).alias("_b"), F.max("_n").alias(f"n_{name}"))
        return out.select(*keys, f"n_{name}", F.greatest(floor, F.col("_a") + F.lit(float(spread)) * (F.col("_b") - F.col("_a"))).alias(f"t_{name}"))

    own, lang, all_ = limits(["lang", "source"], "own"), limits(["lang"], "lang"), limits([], "all")
    lang = lang.withColumnsRenamed({"lang": "_lang", "metric": "_metric"})
    all_ = all_.withColumnRenamed("metric", "_metric_all")
    both = own.join(lang, own["lang"].eqNullSafe(lang["_lang"]) & (own["metric"] == lang["_metric"])).join(all_, own["metric"] == all_["_metric_all"])
    held = lambda c, above: F.col(c) if pull is None else F.least(F.col(c), pull * above)
    of_lang = F.when(F.col("n_lang") >= min_docs, held("t_lang", F.col("t_all"))).otherwise(F.col("t_all"))
    limit = F.when(F.col("n_own") >= min_docs, held("t_own", of_lang)).otherwise(of_lang)
    return both.groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == k, limit)).alias(f"max_{k}") for k in floors))


def judged(df: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str], **limits_as) -> DataFrame:
    """The carried columns of df as struct _tf_row, the metrics as _tf_q, and booleans _tf_base and _tf_kept.

    The metrics are made once and written to the shared folder; the sketches and the verdicts both read them there.
    limits_as (min_docs, spread, floors, pull) go to thresholds.
    """
    # each text's arrays stay in its row: memory is bounded by the longest text
    rows = df.select(F.struct(*(F.col(c) for c in carry)).alias("_tf_row"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("_tf_text"))
    metrics = materialize(measured(rows, "_tf_text").drop("_tf_text"), "quality-metrics")
    limits = materialize(thresholds(sketch(metrics), **limits_as).withColumnsRenamed({"lang": "_l", "source": "_s"}), "quality-limits")
    joined = metrics.join(limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    q = F.col("_tf_q")
    base = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])
    over = F.lit(False)
    for k, v in rates(q).items():
        over = over | F.coalesce(v > F.col(f"max_{k}"), F.lit(False))
    return joined.select("_tf_row", "_tf_q", base.alias("_tf_base"), (~base & ~over).alias("_tf_kept"), *(F.col(f"max_{k}") for k in FLOORS))


def quality_rules(df: DataFrame, *, id_col: str = "doc_id", **names) -> DataFrame:
    """A row for each row of df: its id, the metrics, base_failed, kept."""
    out = judged(df, carry=[id_col], **names)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select(F.col(f"_tf_row.{id_col}").alias(id_col), *(F.col(f"_tf_q.{k}").alias(k) for k in fields), F.col("_tf_base").alias("base_failed"), F.col("_tf_kept").alias("kept"))


def keep_good(df: DataFrame, **names) -> DataFrame:
    """The rows of df that the rules keep, with df's columns."""
    out = judged(df, carry=df.columns, **names)
    return out.where("_tf_kept").select(*(F.col("_tf_row")[c].alias(c) for c in df.columns))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _limit_sql(keys: str, name: str) -> str:
    k = f"{keys}, metric" if keys else "metric"
    floor = " ".join(f"WHEN '{m}' THEN {v}.0::DOUBLE" for m, v in FLOORS.items())
    return f"""(SELECT {k}, max(nn) AS n_{name}, greatest(any_value(CASE metric {floor} END), min(e) FILTER (c >= 0.5 * nn) + {SPREAD} * (min(e) FILTER (c >= 0.75 * nn) - min(e) FILTER (c >= 0.5 * nn))) AS t_{name}
 FROM (SELECT {k}, CASE WHEN bin > 0 THEN pow({GAMMA}::DOUBLE, bin - 1) ELSE 0.0::DOUBLE END AS e, sum(n) OVER (PARTITION BY {k} ORDER BY bin) AS c, sum(n) OVER (PARTITION BY {k}) AS nn
  FROM (SELECT {k}, bin, sum(n)::BIGINT AS n FROM sk GROUP BY {k}, bin)) GROUP BY {k})"""


SQL = rf"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, row_number() OVER () AS rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
d AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, s) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM d, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
m AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, (length(text) - length(regexp_replace(text, '[!?]', '', 'g')))::BIGINT AS n_shouts
  FROM w LEFT JOIN r USING (rid)),
v AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbols, CASE WHEN n_words > 0 THEN n_shouts * 1000 // n_words ELSE 0 END AS shouts,
  CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeats,
  CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS word_length FROM m),
u AS (SELECT lang, source, unnest(['symbols', 'shouts', 'dup_lines', 'repeats', 'word_length']) AS metric, unnest([symbols, shouts, dup_lines, repeats, word_length]) AS v FROM v),
sk AS (SELECT lang, source, metric, CASE WHEN v > 0 THEN floor(ln(v::DOUBLE) / ln({GAMMA}::DOUBLE)) + 1 ELSE 0 END::INT AS bin, count(*) AS n FROM u GROUP BY ALL),
lim AS (SELECT o.lang, o.source, o.metric, CASE WHEN n_own >= {MIN_DOCS} THEN t_own WHEN n_lang >= {MIN_DOCS} THEN t_lang ELSE t_all END AS t
  FROM {_limit_sql("lang, source", "own")} o JOIN {_limit_sql("lang", "lang")} l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN {_limit_sql("", "all")} a ON o.metric = a.metric),
p AS (SELECT lang, source, {", ".join(f"max(t) FILTER (metric = '{k}') AS max_{k}" for k in FLOORS)} FROM lim GROUP BY lang, source),
b AS (SELECT v.*, {", ".join(f"max_{k}" for k in FLOORS)}, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM v LEFT JOIN p ON v.lang IS NOT DISTINCT FROM p.lang AND v.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(f"coalesce({k} > max_{k}, false)" for k in FLOORS)}) AS kept FROM b"""
