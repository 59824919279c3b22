"""Operators that SQL can call: table functions over partitions in order, and an aggregate over a bounded frame.

    SELECT * FROM ts_ema(TABLE(t) PARTITION BY (key) ORDER BY (session_idx), 12)
    SELECT * FROM expanding_pct(TABLE(t) PARTITION BY (key) ORDER BY (session_idx), 252)
    SELECT rank_past(value, 40) OVER (PARTITION BY key ORDER BY session_idx ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) FROM t

Table functions read (key, session_idx, value) by place and return a row for each.  Spark deals partitions out and sorts
them; a function sees one key's rows one after another and holds a few numbers (ts_ema) or the key's earlier values
(expanding_pct).  Null and NaN are missing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

_RETURNS = "key string, session_idx int, result double"


class Ema:
    """Recursive average with weight 2 / (span + 1), from span present values on; a missing value only ages what is known."""

    def __init__(self) -> None:
        self.mean, self.weight, self.present = None, 1.0, 0

    def eval(self, row: Row, span: int) -> Iterator[tuple]:
        alpha, value = 2 / (span + 1), row[2]
        here = value is not None and value == value
        if self.mean is None:
            self.mean = value if here else None
        else:
            self.weight *= 1 - alpha
            if here:
                self.mean = (self.weight * self.mean + alpha * value) / (self.weight + alpha)
                self.weight = 1.0
        self.present += here
        yield row[0], row[1], self.mean if self.present >= span else None


class ExpandingPct:
    """Mid-rank of each value among all earlier ones, from ``least`` of them on."""

    def __init__(self) -> None:
        self.earlier: list[float] = []

    def eval(self, row: Row, least: int) -> Iterator[tuple]:
        value, n, out = row[2], len(self.earlier), None
        if value is not None and value == value:
            if n >= max(least, 1):
                out = (bisect_left(self.earlier, value) + bisect_right(self.earlier, value)) / 2 / n
            insort(self.earlier, value)
        yield row[0], row[1], out


def rank_past(value: pd.Series, least: pd.Series) -> float:
    """Mid-rank of the frame's last value among the present ones before it, if there are ``least``."""
    v = value.to_numpy(dtype=float)
    now, earlier = v[-1], v[:-1][v[:-1] == v[:-1]]
    if now != now or len(earlier) < max(int(least.iloc[-1]), 1):
        return None
    return float(((earlier < now).sum() + (earlier == now).sum() / 2) / len(earlier))


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    spark.udtf.register("ts_ema", F.udtf(Ema, returnType=_RETURNS))
    spark.udtf.register("expanding_pct", F.udtf(ExpandingPct, returnType=_RETURNS))
    spark.udf.register("rank_past", F.pandas_udf(rank_past, "double"))
