"""Ingest operators: field assembly, as-of by publication date, members by year, resolution, fences, split and write."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class FenceError(ValueError):
    """A development table reaches over the fence date, or has rows without a date."""


def assemble_fields(fields: dict[str, DataFrame], keys: tuple[str, ...], required: str) -> DataFrame:
    """Long frames (keys, value), one for each field, as one frame with a column for each; rows need the required field.

    The frames are tagged, united and pivoted by one aggregate: one shuffle instead of one for each join.
    """
    tagged = [df.select(*keys, F.lit(name).alias("_field"), F.col("value").cast("double").alias("value")) for name, df in fields.items()]
    wide = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(*[F.max(F.when(F.col("_field") == n, F.col("value"))).alias(n) for n in fields], F.count_if(F.col("_field") == required).alias("_n"))
    return wide.filter("_n > 0").drop("_n")


def last_present(df: DataFrame, keys: tuple[str, ...], order: Column) -> DataFrame:
    """The last value that is present, by key."""
    return df.filter(F.col("value").isNotNull()).groupBy(*keys).agg(F.max_by("value", order).alias("value"))


def as_of(sessions: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """For each session and key the last present value published up to the session.

    facts: key, date, available_at, value.  Of one publication date the value of the latest date counts.  Facts and
    sessions are united and carried forward in one window, so no range join is needed.
    """
    published = last_present(facts, (key, "available_at"), F.struct("available_at", "date"))
    asked = sessions.select("date").distinct().crossJoin(F.broadcast(facts.select(key).distinct()))
    rows = published.select(key, F.col("available_at").alias("date"), F.lit(0).alias("_side"), "value").unionByName(asked.select(key, "date", F.lit(1).alias("_side"), F.lit(None).cast("double").alias("value")))
    carried = F.last("value", ignorenulls=True).over(Window.partitionBy(key).orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("value", carried).filter("_side = 1").select("date", key, "value")


def top_by_year(df: DataFrame, year: str, order: list[Column], n: int) -> DataFrame:
    """The n first rows of each year, with size_rank from 1."""
    return df.withColumn("size_rank", F.row_number().over(Window.partitionBy(year).orderBy(*order))).filter(F.col("size_rank") <= n)


def members_of_year(facts: DataFrame, members: DataFrame, key: str, date: str) -> DataFrame:
    """Facts of keys that are members in the year of the fact."""
    return facts.withColumn("effective_year", F.year(date)).join(members, [key, "effective_year"])


def resolve(universe: DataFrame, instruments: DataFrame, kind: str, overrides: DataFrame | None = None) -> DataFrame:
    """Each ticker with its instrument (the one valid longest) and overrides; raises when a ticker has none."""
    picked = instruments.filter(F.col("asset") == kind).groupBy("ticker").agg(F.max_by("instrument_uid", F.struct("valid_to", "instrument_uid")).alias("instrument_uid"))
    out = universe.join(picked, "ticker", "left")
    missing = [r["ticker"] for r in out.filter("instrument_uid is null").select("ticker").limit(20).collect()]
    if missing:
        raise ValueError(f"no instrument for {', '.join(missing)}")
    return out.join(overrides, "ticker", "left") if overrides is not None else out


def from_first_usable(bars: DataFrame, first: DataFrame) -> DataFrame:
    """Bars without those before a ticker's first usable date (none given: all)."""
    return bars.join(first.select("ticker", "first_usable_date"), "ticker", "left").filter("first_usable_date is null or date >= first_usable_date").drop("first_usable_date")


def check_fence(df: DataFrame, fence: str, date: str = "date") -> DataFrame:
    """The frame itself, after a check that no row is on or after the fence or without a date."""
    row = df.agg(F.max(date).alias("last"), F.count_if(F.col(date).isNull()).alias("undated")).first()
    if row["undated"] or row["last"] is not None and str(row["last"])[:10] >= fence:
        raise FenceError(f"last date {row['last']}, {row['undated']} rows without a date; the fence is {fence}")
    return df


def upsert_runs(ledger: DataFrame, rows: DataFrame, key: str = "run_id") -> DataFrame:
    """The ledger with all rows of the given runs replaced."""
    return ledger.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.select(ledger.columns))


def evaluation_window(sessions: DataFrame, start: str, end: str | None) -> DataFrame:
    """first, stop: the position of the first session from start on, and one past the last up to end."""
    through = F.lit(True) if end is None else F.col("date") <= F.lit(end).cast("date")
    return sessions.agg(F.count_if(F.col("date") < F.lit(start).cast("date")).cast("int").alias("first"), F.count_if(through).cast("int").alias("stop"))


def retrain_schedule(sessions: DataFrame, first: int, months: int) -> DataFrame:
    """session_idx, date of the first session of every months-th month, counted from the first month of the data; those from session ``first`` on."""
    starts = sessions.groupBy(F.trunc("date", "month").alias("_m")).agg(F.min("session_idx").alias("session_idx"), F.min("date").alias("date"))
    placed = starts.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("session_idx")) - 1)  # a row for each month
    return placed.filter((F.col("_n") % months == 0) & (F.col("session_idx") >= first)).select("session_idx", "date")


def fits(schedule: DataFrame, horizons: tuple[int, ...], window: int | None, first_row: int, back, history: int = 252) -> DataFrame:
    """retrain, h, train_start, train_end (inclusive): the last training session is back(h) before the retrain.

    ``back`` is the reach of a label and the sessions that are purged beside it.  A rolling window has its whole length
    from first_row on or is no fit; an expanding one (None) needs ``history`` sessions.
    """
    each = F.inline(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(back(h)).alias("_back")) for h in horizons]))
    rows = schedule.select(F.col("session_idx").alias("retrain"), each).select("retrain", "h", (F.col("retrain") - F.col("_back")).alias("train_end"))
    start = F.lit(first_row) if window is None else F.col("train_end") - (window - 1)
    enough = F.col("train_end") - first_row + 1 >= history if window is None else F.col("train_start") >= first_row
    return rows.withColumn("train_start", start).filter(enough).select("retrain", "h", "train_start", "train_end")


def calendar_features(sessions: DataFrame) -> DataFrame:
    """date with day_of_week, month_sin, month_cos, business_days_to_month_end and turn_of_month."""
    in_month = F.row_number().over(Window.partitionBy(F.trunc("date", "month")).orderBy("date"))
    last = F.last_day("date")
    back = F.greatest(F.weekday(last) - 4, F.lit(0))
    month_end = F.date_sub(last, back)
    # a session after its month's last business day counts to that of the next month
    late = F.col("date") > month_end
    following = F.last_day(F.add_months("date", 1))
    following = F.date_sub(following, F.greatest(F.weekday(following) - 4, F.lit(0)))
    end = F.when(late, following).otherwise(month_end)
    days = F.when(end > F.col("date"), F.sequence(F.date_add("date", 1), end)).otherwise(F.array().cast("array<date>"))
    to_end = F.size(F.filter(days, lambda d: F.weekday(d) < 5)).cast("double")
    angle = F.month("date") * (2 * 3.141592653589793 / 12)
    return sessions.select(
        "date", F.weekday("date").cast("double").alias("day_of_week"), F.sin(angle).alias("month_sin"), F.cos(angle).alias("month_cos"),
        to_end.alias("business_days_to_month_end"), F.when((to_end <= 2) | (in_month <= 3), 1.0).otherwise(0.0).alias("turn_of_month"),
    )


def mid_ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earlier values that are smaller, plus half of the equal ones; number of earlier values) for each value, by merging sorted halves."""
    n = len(values)
    place = np.unique(values, return_inverse=True)[1]
    below, equal = np.zeros(n), np.zeros(n)
    width = 1
    while width < n:  # each block of values against the block before it
        block = np.arange(n) // width
        left = block % 2 == 0
        key = (block // 2) * (n + 1) + place  # pairs of blocks one after another, in order of the values
        earlier = np.sort(key[left])
        asked = np.flatnonzero(~left)
        first = np.searchsorted(earlier, (block[asked] // 2) * (n + 1))
        lo, hi = np.searchsorted(earlier, key[asked], side="left"), np.searchsorted(earlier, key[asked], side="right")
        below[asked] += lo - first
        equal[asked] += hi - lo
        width *= 2
    return below + equal / 2, np.arange(n)


def expanding_pct(series: DataFrame, least: int = 252) -> DataFrame:
    """key, session_idx, pct: mid-rank of each value among all earlier ones of its key.

    Keys spread over the cluster; a key is one value for each session, ranked by merging, O(n log^2 n).
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("session_idx")
        v = rows["value"].to_numpy(dtype=float)
        out, known = np.full(len(v), np.nan), np.flatnonzero(~np.isnan(v))
        rank, before = mid_ranks(v[known])
        enough = before >= max(least, 1)
        out[known[enough]] = rank[enough] / before[enough]
        return pd.DataFrame({"key": rows["key"], "session_idx": rows["session_idx"], "pct": out})

    out = series.groupBy("key").applyInPandas(one, "key string, session_idx int, pct double")
    return out.withColumn("pct", F.nanvl("pct", F.lit(None).cast("double")))


def ema_columns(panel: DataFrame, spans: tuple[int, ...], signal: tuple[int, int, int] = (12, 26, 9), value: str = "close") -> DataFrame:
    """The panel with ema_<span> of a value and ema_signal, the average of the difference of two of them.

    Recursive averages have no window form; each ticker is one ordered fold over (session, value), sent through Arrow and joined back.
    """
    names = [f"ema_{s}" for s in spans]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("session_idx").copy()
        ema = {s: rows[value].ewm(span=s, adjust=False, min_periods=s).mean() for s in spans}
        for s in spans:
            rows[f"ema_{s}"] = ema[s]
        fast, slow, n = signal
        rows["ema_signal"] = (ema[fast] - ema[slow]).ewm(span=n, adjust=False, min_periods=n).mean()
        return rows.drop(columns=value)

    added = [*names, "ema_signal"]
    sent = panel.select("ticker", "session_idx", F.col(value).cast("double").alias(value))
    out = sent.groupBy("ticker").applyInPandas(one, "ticker string, session_idx int" + "".join(f", {n} double" for n in added))
    return panel.join(out.select("ticker", "session_idx", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in added]), ["ticker", "session_idx"])
