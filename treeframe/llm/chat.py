"""Chat formatting after cumulative-snapshot collapse.

A logged conversation that is the beginning of a longer one is dropped; of equal ones the least conv_id stays. Each turn
(role and text at its turn number) has a position-dependent hash, and the hash of the turns up to t is their exclusive
or: a rolling hash that, being associative, is summed within blocks of turns and over blocks, so that one conversation
with a third of all rows is not one task. Prefix hashes are two independent 64-bit values. A conversation whose whole
hash is a proper prefix hash of another is removed by an anti-join; what stays is rendered turn by turn.

Defined cases: a conversation is the set of its (turn, role, text) rows, so repeated rows count once; several different
rows of one turn number are one step. Null roles and texts are values of their own, distinct from empty ones, and render
as empty; a null turn sorts first; rows with a null conv_id are one conversation. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeframe.llm.common import materialize, table

BLOCK = 1024


def _hashes(turn: Column, role: Column, text: Column) -> list[Column]:
    """Two 64-bit hashes of a row; nulls are marked, as hashing skips them."""
    marks = F.concat(*(F.when(c.isNull(), F.lit("n")).otherwise("v") for c in (turn, role, text)))
    return [F.xxhash64(marks, turn, role, text), F.xxhash64(text, F.lit("second"), role, turn, marks)]


def prefixes(turns: DataFrame) -> DataFrame:
    """turns: _c, _t, _a, _b. Per (conversation, turn): _c, _t, _pa, _pb (hash of the turns up to this one)."""
    steps = turns.groupBy("_c", "_t").agg(F.bit_xor("_a").alias("_a"), F.bit_xor("_b").alias("_b")).withColumn("_k", F.coalesce(F.floor(F.col("_t") / BLOCK), F.lit(-(1 << 62))).cast("long"))
    blocks = steps.groupBy("_c", "_k").agg(F.bit_xor("_a").alias("_ka"), F.bit_xor("_b").alias("_kb"))
    before = Window.partitionBy("_c").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("_c").alias("_c2"), F.col("_k").alias("_k2"), *(F.coalesce(F.bit_xor(f"_k{x}").over(before), F.lit(0)).alias(f"_o{x}") for x in "ab"))
    within = Window.partitionBy("_c", "_k").orderBy(F.col("_t").asc_nulls_first())
    steps = steps.select("_c", "_k", "_t", *(F.bit_xor(f"_{x}").over(within).alias(f"_w{x}") for x in "ab"))
    both = steps.join(blocks, F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_k") == F.col("_k2")))
    return both.select("_c", "_t", *(F.col(f"_w{x}").bitwiseXOR(F.col(f"_o{x}")).alias(f"_p{x}") for x in "ab"))


def maximal(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """_c of each conversation that stays."""
    hashes = _hashes(*(F.col(c) for c in (turn, role, text)))
    rows = df.select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), hashes[0].alias("_a"), hashes[1].alias("_b")).distinct()
    p = materialize(prefixes(rows), "chat-prefixes")
    ends = p.groupBy("_c").agg(F.max(F.struct(F.col("_t").isNotNull(), F.col("_t"))).alias("_m")).select(F.col("_c").alias("_ce"), F.col("_m._t").alias("_e"))
    marked = p.join(ends, F.col("_c").eqNullSafe(F.col("_ce")))
    whole = marked.where(F.col("_t").eqNullSafe(F.col("_e"))).groupBy("_pa", "_pb").agg(F.min("_c").alias("_c"))
    proper = marked.where(~F.col("_t").eqNullSafe(F.col("_e"))).select(F.col("_pa").alias("_qa"), F.col("_pb").alias("_qb")).distinct()
    return whole.join(proper, (F.col("_pa") == F.col("_qa")) & (F.col("_pb") == F.col("_qb")), "left_anti").select("_c")


def rendered(role: Column, text: Column) -> Column:
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("<|"), e(role), F.lit("|>\n"), e(text), F.lit("<|end|>\n"))


def format_chats(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each distinct row of the conversations that stay: conv, turn, role, rendered; in order of turn these are the chat."""
    kept = materialize(maximal(df, conv=conv, turn=turn, role=role, text=text), "chat-kept")
    rows = df.select(*(F.col(c) for c in (conv, turn, role, text))).distinct()
    rows = rows.join(kept, rows[conv].eqNullSafe(kept["_c"]), "left_semi")
    return rows.select(conv, turn, role, rendered(F.col(role), F.col(text)).alias("rendered"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = r"""WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
r AS (SELECT *, chr(2) || coalesce(turn::VARCHAR, chr(1)) || chr(3) || coalesce(role, chr(1)) || chr(3) || coalesce(text, chr(1)) AS s FROM t),
st AS (SELECT conv_id, turn, string_agg(s, chr(4) ORDER BY s) AS s FROM r GROUP BY conv_id, turn),
p AS (SELECT conv_id, turn, md5(string_agg(s, chr(5)) OVER w) AS h, turn IS NOT DISTINCT FROM last_value(turn) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS whole FROM st WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST ROWS UNBOUNDED PRECEDING)),
k AS (SELECT min(conv_id) AS conv_id FROM p WHERE whole AND h NOT IN (SELECT h FROM p WHERE NOT whole) GROUP BY h)
SELECT t.conv_id, turn, role, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered FROM t WHERE EXISTS (SELECT 1 FROM k WHERE k.conv_id IS NOT DISTINCT FROM t.conv_id)"""
