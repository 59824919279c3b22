"""Chat formatting: collapse of cumulative snapshots, then rendering (DataFrame functions only).

A logged conversation whose turns are the first turns of a longer one is a
snapshot of it; of equal conversations the smallest conv_id stays.  Each turn
gets a 128-bit hash of its place, role and text; a running xor gives the hash
of every prefix, without collecting a conversation.  Complete conversations are
then anti-joined with the distinct proper prefixes of all others, and only the
maximal ones are rendered.

Prefixes and complete hashes are reduced to one row each before they meet, so
a first turn or a conversation that a third of the log shares is one row.

Defined results: turns are ordered by (turn, role, text), null first; a null
role or text differs from an empty one and is rendered as empty; rows without
conv_id are no conversation; repeated rows are turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _marked(c: Column) -> Column:
    """A value that hashes apart from null and from its neighbours."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit("-"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text and the hashes h1, h2 of the prefix that ends here."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("place"))
    what = [F.col("place"), _marked(F.col("role")), _marked(F.col("text"))]
    running = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select(
        "conv_id",
        "place",
        "role",
        "text",
        F.bit_xor(F.xxhash64(F.lit(1), *what)).over(running).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(2), *what[::-1])).over(running).alias("h2"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no prefix of another."""
    every = prefixes(turns).select("conv_id", "place", "h1", "h2")
    last = Window.partitionBy("conv_id")
    every = every.withColumn("n_turns", F.max("place").over(last))
    # of equal conversations one stays
    complete = every.filter("place = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = every.filter("place < n_turns").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    return complete.join(proper, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"))


def render(turns: DataFrame, kept: DataFrame, opening: str = "<|", closing: str = "|>", end: str = "<|end|>") -> DataFrame:
    """conv_id, n_turns, text: one block for each turn, in order."""
    lines = F.concat(F.lit(opening), F.coalesce("role", F.lit("")), F.lit(closing + "\n"), F.coalesce("text", F.lit("")), F.lit(end))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    stay = turns.select("conv_id", "turn", "role", "text").join(kept, "conv_id", "left_semi")
    placed = stay.select("conv_id", F.row_number().over(order).alias("place"), lines.alias("line"))
    blocks = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("turns"))
    return blocks.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("turns.line"), "\n").alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    """The maximal conversations, rendered."""
    return render(turns, maximal(turns))


ORACLE = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n,
  list(coalesce('=' || role, '-') || chr(1) || coalesce('=' || text, '-') ORDER BY place) AS turns,
  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>', chr(10) ORDER BY place) AS body FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT turns[1:k] AS head FROM (SELECT turns, unnest(range(1, n)) AS k FROM c) q)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, body AS text FROM c
WHERE turns NOT IN (SELECT head FROM p) AND conv_id = (SELECT min(d.conv_id) FROM c d WHERE d.turns = c.turns)
"""
