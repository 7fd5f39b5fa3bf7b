"""Chat formatting by collapse of cumulative snapshots, with DataFrame functions alone.

Applications log a conversation again after each turn, so most logged conversations are beginnings of longer ones. A
rolling hash over a conversation's first k turns names each beginning; conversations whose own hash names a beginning of
a longer one are removed by an anti-join, equal ones but for the smallest conv_id, and the rest are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint

#: Turns of one conversation are numbered and hashed in chunks of so many turn numbers.
CHUNK = 1024
#: Conversations that stay, broadcast at most; more are joined by a shuffle.
SMALL_ROWS = 500_000


def _hashes() -> list[Column]:
    """turn, h1, h2: what turns of a conversation are told apart and ordered by, nulls first; hashes tell a null role or
    text from any other."""
    marked = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return [F.col("turn").cast("long").alias("turn"), F.xxhash64(*marked).alias("h1"), F.xxhash64(F.lit(11), *marked).alias("h2")]


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, chunk, h1, h2: each turn once, dealt out by conversation and chunk; null turns are a chunk before
    all others."""
    own = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), *_hashes()).distinct()
    chunk = F.when(F.col("turn").isNull(), F.lit(-(1 << 62))).otherwise(F.floor(F.col("turn") / CHUNK)).cast("long")
    return checkpoint(own.withColumn("chunk", chunk).repartition("conv_id", "chunk"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, n (1, 2, ...), p1, p2 (hash of the first n turns), last (whether that is all of them). Turns are ordered
    by turn, nulls first, ties by hash. The hash is the exclusive or of hashes of (number, turn), so chunks of a long
    conversation are hashed side by side and put together."""
    turns = _turns(conversations)
    in_chunk = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2")
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    counts = turns.groupBy("conv_id", "chunk").agg(F.count("*").alias("k"))
    counts = counts.select("conv_id", "chunk", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("from"), F.sum("k").over(whole).alias("total"))
    numbered = (
        turns.withColumn("r", F.row_number().over(in_chunk))
        .join(counts, ["conv_id", "chunk"])
        .withColumn("n", F.col("from") + F.col("r"))
        .withColumn("x1", F.xxhash64("n", "h1"))
        .withColumn("x2", F.xxhash64("h2", "n"))
    )
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = numbered.groupBy("conv_id", "chunk").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    based = [F.coalesce(F.bit_xor(s).over(before), F.lit(0)).alias(b) for s, b in (("s1", "b1"), ("s2", "b2"))]
    return numbered.join(sums.select("conv_id", "chunk", *based), ["conv_id", "chunk"]).select(
        "conv_id",
        "n",
        F.col("b1").bitwiseXOR(F.bit_xor("x1").over(so_far)).alias("p1"),
        F.col("b2").bitwiseXOR(F.bit_xor("x2").over(so_far)).alias("p2"),
        (F.col("n") == F.col("total")).alias("last"),
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that begin no longer one and equal none of smaller id."""
    every = checkpoint(prefixes(conversations))
    begun = every.filter(~F.col("last")).select("n", "p1", "p2").distinct()
    whole = every.filter("last").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    return whole.join(begun, ["n", "p1", "p2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, chat: each maximal conversation as one text, `<|role|>`, line end, text, `<|end|>`, line end for
    each turn, in the order in which prefixes are taken.

    Rows without conv_id belong to no conversation and are left out; repeated rows of a turn count once; rows that share
    a turn number but differ are turns of their own, ordered by hash; a null turn comes first; null roles and texts are
    rendered as empty but differ from empty ones; a very long text counts by its hashes until it is rendered; other
    columns are not looked at; an empty table gives an empty one.

    A conversation's turns are dealt out by (conv_id, chunk) until it is rendered; turns that share one number meet in one
    task, as hashes alone. A conversation that is logged very often, and a common first turn, are pre-aggregated before
    any shuffle by content. What is rendered are the distinct turns of the conversations that stay.
    """
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(*_hashes(), said.alias("said")).alias("said"))
    chosen = checkpoint(maximal(conversations))
    chosen = F.broadcast(chosen) if chosen.count() <= SMALL_ROWS else chosen
    return (
        rows.join(chosen, "conv_id")
        .groupBy("conv_id", "n_turns")
        .agg(F.array_sort(F.collect_set("said")).alias("turns"))
        .select("conv_id", "n_turns", F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("chat"))
    )


#: DuckDB SQL for render() over conversations. Assumes (conv_id, turn) is unique.
SQL = """
WITH turn AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS said
  FROM conversations WHERE conv_id IS NOT NULL
), begun AS (
  SELECT conv_id, n, total, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS chat FROM turn
), whole AS (
  SELECT min(conv_id) AS conv_id, n, chat FROM begun WHERE n = total GROUP BY n, chat
)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, chat FROM whole
ANTI JOIN (SELECT DISTINCT n, chat FROM begun WHERE n < total) USING (n, chat)
"""
