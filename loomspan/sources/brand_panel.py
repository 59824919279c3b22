"""A panel from order tables: a session for each ship date, eight tickers that share the brands, prices from line items.

Eight tickers have bars on nearly all sessions, also in the small tables, so that gated windows hold values.  A price is
100 + sqrt(price of the line item) / 10, which moves by a few per cent from session to session, as prices do.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.keeping import kept

HISTORY = 252

#: Roles that formulas ask for, and the tickers that play them.
ROLES = {"SPY": "T1", "TLT": "T2", "HYG": "T3", "GLD": "T4", "UUP": "T5", "VXX": "T6", "LQD": "T7", "IEF": "T0", "SHY": "T2"}
TICKERS = 8
_PANELS: dict[tuple, DataFrame] = {}


def densify(bars: DataFrame) -> DataFrame:
    """Every session x every ticker: windows then count sessions, whether a ticker traded or not.

    The two sides are the distinct dates and tickers, which are few beside the facts.
    """
    dates = bars.select("date").distinct().withColumn("session_idx", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")) - 1).cast("int"))
    tickers = bars.select("ticker").distinct()
    return dates.crossJoin(F.broadcast(tickers)).join(bars, ["date", "ticker"], "left")


def _lines(spark: SparkSession, items: DataFrame, sf_dir: str, asset: str | None) -> DataFrame:
    """date, ticker, price, l_quantity and keys of line items.

    Parts grow with the line items: each task has a hash table of its share of them, none is in the driver.
    """
    number = F.expr(f"concat('T', CAST(CAST(substring(p_brand, 7) AS INT) % {TICKERS} AS STRING))")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), (F.col(asset) if asset else number).alias("ticker"))
    price = (100 + F.sqrt(F.col("l_extendedprice") / F.col("l_quantity")) / 10).alias("price")
    return items.join(parts.hint("shuffle_hash"), "l_partkey").select(F.to_date("l_shipdate").alias("date"), "ticker", price, "l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def bar_sums(spark: SparkSession, sf_dir: str, asset: str | None = None) -> DataFrame:
    """date, ticker, high, low, volume, and the first and the last order key (null comes first); all of fixed width, so tasks sum up by hash."""
    lines = _lines(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet"), sf_dir, asset)
    first = F.when(F.count("l_orderkey") == F.count(F.lit(1)), F.min("l_orderkey"))
    return lines.groupBy("date", "ticker").agg(F.max("price").alias("high"), F.min("price").alias("low"), F.sum("l_quantity").alias("volume"), first.alias("first"), F.max("l_orderkey").alias("last"))


_kept_sums = kept(bar_sums)


@kept
def _bars(spark: SparkSession, sf_dir: str, asset: str | None) -> DataFrame:
    """Prices by the order of line items: among a minimum of structs all line items would be sorted, so only those of first and last orders get there."""
    sums = _kept_sums(spark, sf_dir, asset)
    ends = sums.select(F.explode(F.array("first", "last")).alias("end")).distinct()  # two for each session and ticker at most
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(F.broadcast(ends), F.col("l_orderkey").eqNullSafe(F.col("end")), "left_semi")
    lines = _lines(spark, items, sf_dir, asset).withColumn("at", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    prices = lines.groupBy("date", "ticker").agg(F.min_by("price", "at").alias("open"), F.max_by("price", "at").alias("close"))
    mine = sums.withColumnsRenamed({"date": "_date", "ticker": "_ticker"})
    met = mine.join(prices, F.col("_date").eqNullSafe(F.col("date")) & F.col("_ticker").eqNullSafe(F.col("ticker")))
    return met.select("date", "ticker", "open", "high", "low", "close", "volume")


def brand_bars(spark: SparkSession, sf_dir: str, asset: str | None = None) -> DataFrame:
    """date, ticker, open, high, low, close, volume of the days on which a ticker's brands (or a value of a column of part) were shipped.

    Made once for an application and kept: a row for each session and ticker, whatever the line items are.
    """
    return _bars(spark, sf_dir, asset)


def brand_panel(spark: SparkSession, sf_dir: str, asset: str | None = None) -> DataFrame:
    """session_idx, date, ticker, asset_group, open, high, low, close, volume, adv, tradable.

    Built once for an application and kept, dealt out by ticker and in order of sessions: windows over time then need
    no shuffle and no sort.  A lost executor's part is made again from the tables.
    """
    key = (spark.sparkContext.applicationId, sf_dir, asset)
    if key not in _PANELS:
        _PANELS[key] = _brand_panel(spark, sf_dir, asset).persist(StorageLevel.MEMORY_AND_DISK)
    return _PANELS[key]


def _brand_panel(spark: SparkSession, sf_dir: str, asset: str | None) -> DataFrame:
    dense = densify(brand_bars(spark, sf_dir, asset))
    by_ticker = Window.partitionBy("ticker").orderBy("session_idx")
    month = by_ticker.rowsBetween(-29, 0)
    value = F.col("close") * F.col("volume")
    adv = F.when(F.count(value).over(month) >= 24, F.expr("percentile(close * volume, 0.5)").over(month))
    seen = F.count("close").over(by_ticker.rowsBetween(Window.unboundedPreceding, 0))
    return dense.select(
        "session_idx", "date", "ticker", F.expr("CAST(CAST(right(ticker, 1) AS INT) % 3 AS STRING)").alias("asset_group") if asset is None else F.substring("ticker", -1, 1).alias("asset_group"), "open", "high", "low", "close", "volume",
        adv.alias("adv"), (F.col("close").isNotNull() & (seen >= HISTORY)).alias("tradable"),
    )


BRAND_SQL = f"""li AS (SELECT CAST(l_shipdate AS DATE) AS d, 'T' || CAST(CAST(substring(p_brand, 7) AS INTEGER) % {TICKERS} AS VARCHAR) AS tk, p_brand, 100 + sqrt(l_extendedprice / l_quantity) / 10 AS px, l_quantity AS q,
  row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE), CAST(substring(p_brand, 7) AS INTEGER) % {TICKERS} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS first,
  row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE), CAST(substring(p_brand, 7) AS INTEGER) % {TICKERS} ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS final
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (SELECT d, tk, max(CASE WHEN first = 1 THEN px END) AS open, max(px) AS high, min(px) AS low, max(CASE WHEN final = 1 THEN px END) AS close, sum(q) AS volume FROM li GROUP BY d, tk),
days AS (SELECT d, CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS session_idx FROM (SELECT DISTINCT d FROM li) q),
names AS (SELECT DISTINCT tk FROM li),
dense AS (SELECT session_idx, days.d AS date, names.tk AS ticker, CAST(CAST(right(names.tk, 1) AS INTEGER) % 3 AS VARCHAR) AS asset_group, open, high, low, close, volume
  FROM days CROSS JOIN names LEFT JOIN bars ON bars.d = days.d AND bars.tk = names.tk),
panel AS (SELECT *,
  CASE WHEN count(close * volume) OVER m >= 24 THEN quantile_cont(close * volume, 0.5) OVER m END AS adv,
  (close IS NOT NULL AND count(close) OVER (PARTITION BY ticker ORDER BY session_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= {HISTORY}) AS tradable
  FROM dense WINDOW m AS (PARTITION BY ticker ORDER BY session_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""
