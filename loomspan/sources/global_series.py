"""Session-level series from orders: five priorities x three statistics stand for market, index and yield series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
#: Number of the priority (none: all of them, which gives a value on nearly every session) and statistic of each series.
MARKET = {"m_vix": (None, "avg"), "m_vxn": (1, "avg"), "m_copper": (2, "avg"), "m_gold": (3, "avg"), "m_oil": (4, "avg")}
CBOE = {"c_vix": (0, "max"), "c_vix3m": (1, "max"), "c_vix9d": (2, "max"), "c_vvix": (3, "max"), "c_skew": (4, "max"), "c_cor1m": (0, "min"), "c_cor3m": (1, "min")}
TREASURY = {"t_10_year": (2, "min"), "t_3_month": (3, "min"), "t_2_year": (4, "min")}
CBOE_FILL, LAG = 5, 1


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date with a column for each series."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("date"), "o_orderpriority", "o_totalprice")
    pick = lambda k, f: getattr(F, f)(F.when(F.lit(True) if k is None else F.col("o_orderpriority") == _PRIORITIES[k], F.col("o_totalprice")))
    return orders.groupBy("date").agg(*[pick(k, f).alias(n) for n, (k, f) in (MARKET | CBOE | TREASURY).items()])


def with_globals(panel: DataFrame, series: DataFrame) -> DataFrame:
    """The panel with the series as known at each session.

    Market and index series count one session later; index gaps of up to five sessions are closed first; yields count
    from the day after their date, the last one known.
    """
    sessions = panel.select("session_idx", "date").distinct()
    order = Window.partitionBy(F.lit(1)).orderBy("session_idx")  # a row for each session
    known = sessions.join(series.select("date", *MARKET, *CBOE), "date", "left")
    filled = known.select("session_idx", "date", *MARKET, *[F.last(c, ignorenulls=True).over(order.rowsBetween(-CBOE_FILL, 0)).alias(c) for c in CBOE])
    lagged = filled.select("session_idx", "date", *[F.lag(c, LAG).over(order).alias(c) for c in [*MARKET, *CBOE]])
    published = series.select(F.date_add("date", 1).alias("date"), F.lit(0).alias("_side"), *TREASURY)
    asked = sessions.select("date", F.lit(1).alias("_side"), *[F.lit(None).cast("double").alias(c) for c in TREASURY])
    so_far = Window.partitionBy(F.lit(1)).orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    yields = published.unionByName(asked).select("date", "_side", *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in TREASURY]).filter("_side = 1").drop("_side")
    return panel.join(lagged.drop("date"), "session_idx").join(yields, "date")


def _sql() -> str:
    cols = ", ".join(f"{f}(CASE WHEN {'true' if k is None else f"o_orderpriority = '{_PRIORITIES[k]}'"} THEN o_totalprice END) AS {n}" for n, (k, f) in (MARKET | CBOE | TREASURY).items())
    lagged = ", ".join(f"lag({c}, {LAG}) OVER (ORDER BY session_idx) AS {c}" for c in [*MARKET, *CBOE])
    filled = ", ".join([*MARKET, *[f"last_value({c} IGNORE NULLS) OVER (ORDER BY session_idx ROWS BETWEEN {CBOE_FILL} PRECEDING AND CURRENT ROW) AS {c}" for c in CBOE]])
    latest = ", ".join(f"(SELECT arg_max({c}, g.date) FROM series g WHERE g.date < days.d AND {c} IS NOT NULL) AS {c}" for c in TREASURY)
    return f""",
series AS (SELECT CAST(o_orderdate AS DATE) AS date, {cols} FROM orders GROUP BY 1),
filled AS (SELECT session_idx, days.d AS date, {filled} FROM days LEFT JOIN series ON series.date = days.d),
lagged AS (SELECT session_idx, {lagged} FROM filled),
yields AS (SELECT session_idx, {latest} FROM days)"""


GLOBALS_SQL = _sql()
