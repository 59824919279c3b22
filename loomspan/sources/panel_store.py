"""The panel of a snapshot by mode, kept as a bucketed table: dealt out by ticker and sorted by session on disk.

A window over time then reads its partitions as they lie, without a shuffle or a sort, in every application that opens
the table; a cached frame gives that to one application only, and makes it anew where an executor is lost.  There is
one file for each bucket, so a bucket's order is that of its file.  Column statistics go with the table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.operators import ingest as I
from loomspan.sources import snapshot as X
from loomspan.sources.brand_panel import HISTORY
from loomspan.sources.shared_files import Files

FIELDS = ("open", "high", "low", "close", "volume", "adv")
BUCKETS = 16


@dataclass(frozen=True)
class Tables:
    """What a snapshot holds for a mode: the panel and, long by date, what is joined to it."""

    panel: DataFrame
    market: DataFrame
    yields: DataFrame
    indices: DataFrame
    stock_returns: DataFrame
    stock_members: DataFrame


def dense_panel(bars: DataFrame, tickers: DataFrame) -> DataFrame:
    """session_idx, date, ticker, asset_group, the fields of bars and tradable, for every session of the bars and every listed ticker.

    A ticker trades where it has a close, is not flagged and has had HISTORY closes; of repeated bars the one with the
    greatest values counts.
    """
    listed = tickers.select("ticker", F.col("block_name").alias("asset_group"))  # a row for each ticker
    one = bars.groupBy("date", "ticker").agg(F.max(F.struct(*FIELDS, "non_tradeable")).alias("_b")).select("date", "ticker", "_b.*")
    sessions = bars.select("date").distinct().withColumn("session_idx", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")) - 1).cast("int"))  # a row for each session
    every = sessions.crossJoin(F.broadcast(listed)).join(one, ["date", "ticker"], "left")
    seen = F.count("close").over(Window.partitionBy("ticker").orderBy("session_idx").rowsBetween(Window.unboundedPreceding, 0))
    live = F.col("close").isNotNull() & ~F.coalesce("non_tradeable", F.lit(False)) & (seen >= HISTORY)
    return every.withColumn("tradable", live).select("session_idx", "date", "ticker", "asset_group", *FIELDS, "tradable")


def load(spark: SparkSession, folder: str, mode: str, fence: str, unlock: dict | None = None, runs: str | None = None) -> Tables:
    """The tables of a snapshot: mode dev is checked against the fence everywhere, full needs an unlock of a run in ``runs``."""
    read = lambda name: X.read(spark, folder, name, mode, fence, unlock, runs)
    bars, yields, members = read("bars"), read("treasury"), read("stock_members")
    if mode == "dev":
        I.check_fence(yields, fence, "available_at_date")  # a yield is known when it is published
        late = members.filter(F.col("effective_year").isNull() | (F.col("effective_year") >= int(fence[:4])))
        if not late.isEmpty():
            raise I.FenceError(f"members of a year from {fence[:4]} on, or of none")
    tickers = spark.read.csv(f"{folder}/tickers.csv", header=True)
    sessions = bars.select("date").distinct()
    on_sessions = lambda name: read(name).join(sessions, "date", "left_semi")
    published = yields.select(F.col("tenor"), "date", F.col("available_at_date").alias("available_at"), "value")
    return Tables(dense_panel(bars, tickers), on_sessions("market"), I.as_of(sessions, published, "tenor"), on_sessions("index_closes"), on_sessions("stock_returns"), members)


def store(panel: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Write a panel as a bucketed, sorted table at a path, with statistics, and open it; an earlier one of the name is replaced."""
    if not re.fullmatch(r"[A-Za-z_]\w*", table):
        raise ValueError(f"{table!r} is no name of a table")
    spark = panel.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    Files(spark).delete(path)
    # dealt out by the buckets' own hash, so that each task writes one file
    panel.repartition(buckets, "ticker").write.bucketBy(buckets, "ticker").sortBy("ticker", "session_idx").option("path", path).saveAsTable(table)
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
    return stored(spark, table)


def stored(spark: SparkSession, table: str) -> DataFrame:
    """A stored panel; its files' order is used, which Spark does only where it is told to."""
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return spark.table(table)
