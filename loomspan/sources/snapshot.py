"""Scans of the market files, their assembly into the tables of a snapshot, and reading those by mode.

A snapshot is a folder with ``dev`` and ``holdout``, a Parquet folder for each table in both, tickers.csv and
MANIFEST.json.  Folders may be on any file system that Spark reads; the two small files are written by Spark too.
"""

from __future__ import annotations

import datetime as dt
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.settings import SettingsError
from loomspan.operators import ingest as I

# fixed values of the files
TENORS = ("1_month", "3_month", "1_year", "2_year", "5_year", "10_year", "30_year")
INDEX_SERIES = ("SKEW", "VVIX", "COR1M", "COR3M", "VIX9D", "VIX3M", "VIX")
BAR_FIELDS = {"close": "c", "open": "o", "high": "h", "low": "l", "volume": "v", "adv": "adv"}
REFRESH_WINDOW = ("17:15", "18:15")
UNLOCK_FIELDS = ("owner", "date", "run_id", "config_ids", "statement")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def refuse_refresh(now: dt.time, window: tuple[str, str] = REFRESH_WINDOW) -> None:
    """Raise while the source files are being rewritten; both ends count."""
    first, last = map(dt.time.fromisoformat, window)
    if first <= now <= last:
        raise RuntimeError(f"the source files are rewritten from {window[0]} to {window[1]}; no snapshot now ({now:%H:%M})")


def as_view(df: DataFrame, name: str) -> DataFrame:
    """The frame, also as a view that SQL of the session can name."""
    df.createOrReplaceTempView(name)
    return df


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, columns taken by name; columns that the file lacks are missing."""
    raw = spark.read.csv(path, header=True)
    wanted = spark.createDataFrame([], schema).schema
    return raw.select(*[(F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in wanted])


def bars(spark: SparkSession, root: str, tickers: DataFrame) -> DataFrame:
    """date, ticker, open, high, low, close, volume, adv, non_tradeable of the universe, from a file for each field.

    A bar needs a close; a field that is not there is missing, an absent flag is false; nothing before a ticker's
    first usable date.
    """
    uids = tickers.select("ticker", "instrument_uid")  # a row for each ticker
    fields = {n: spark.read.parquet(f"{root}/etf/{f}.parquet").join(F.broadcast(uids), "instrument_uid").select("date", "ticker", "value") for n, f in BAR_FIELDS.items()}
    flags = spark.read.parquet(f"{root}/etf/non_tradeable.parquet").join(F.broadcast(uids), "instrument_uid")
    fields["non_tradeable"] = flags.select("date", "ticker", F.col("value").cast("boolean").cast("double").alias("value"))
    wide = I.assemble_fields(fields, ("date", "ticker"), "close").withColumn("non_tradeable", F.coalesce(F.col("non_tradeable") > 0, F.lit(False)))
    return I.from_first_usable(wide, tickers).select("date", "ticker", "open", "high", "low", "close", "volume", "adv", "non_tradeable")


def market(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/market/c.parquet").select("date", "instrument", "value")


def yields(spark: SparkSession, root: str, tenors: tuple[str, ...] = TENORS) -> DataFrame:
    """date, available_at_date, value, tenor: a file for each tenor."""
    parts = [spark.read.parquet(f"{root}/treasury/yield_{t}.parquet").select("date", "available_at_date", "value", F.lit(t).alias("tenor")) for t in tenors]
    return reduce(DataFrame.unionByName, parts)


def index_closes(spark: SparkSession, folder: str, series: tuple[str, ...] = INDEX_SERIES) -> DataFrame:
    """date, series, value from a CSV for each series: column CLOSE, else the series' own; files that are not there are
    left out, numbers that cannot be read dropped."""
    parts = []
    for name in series:
        path = f"{folder}/{name}.csv"
        if exists(spark, path):
            raw = spark.read.csv(path, header=True)
            value = F.col("CLOSE" if "CLOSE" in raw.columns else name)
            parts.append(raw.select(F.to_date("DATE", "M/d/yyyy").alias("date"), F.lit(name).alias("series"), F.trim(value).try_cast("double").alias("value")))
    empty = spark.createDataFrame([], "date date, series string, value double")
    return reduce(DataFrame.unionByName, parts, empty).filter("value IS NOT NULL AND NOT isnan(value)")


def stocks(spark: SparkSession, universe: str, root: str, size: int, rank_field: str = "mktcap_63d_median") -> tuple[DataFrame, DataFrame]:
    """(effective_year, instrument_uid, size_rank) of the largest stocks of each year, and (date, instrument_uid, ret) of
    members in their years; both empty where there is no universe file."""
    if not exists(spark, universe):
        return spark.createDataFrame([], "effective_year int, instrument_uid string, size_rank int"), spark.createDataFrame([], "date date, instrument_uid string, ret double")
    listed = spark.read.parquet(universe).filter(F.col("value") & F.col(rank_field).isNotNull())
    members = I.top_by_year(listed, "effective_year", [F.desc(rank_field), F.asc("instrument_uid")], size).select("effective_year", "instrument_uid", "size_rank")
    facts = spark.read.parquet(f"{root}/equity/ret.parquet").select("date", "instrument_uid", F.col("value").alias("ret"))
    return members, I.members_of_year(facts, members, "instrument_uid", "date").select("date", "instrument_uid", "ret")


def write_table(df: DataFrame, folder: str, name: str, before_fence: Column) -> dict[str, dict]:
    """Write a table's rows before the fence and the others (unknown counts as the latter); returns both manifest entries."""
    out, spark = {}, df.sparkSession
    dev = F.coalesce(before_fence, F.lit(False))
    for part, rows in (("dev", df.filter(dev)), ("holdout", df.filter(~dev))):
        path = f"{folder}/{part}/{name}.parquet"
        rows.write.mode("overwrite").parquet(path)
        back = spark.read.parquet(path)
        dated = "date" in back.columns
        found = back.agg(
            F.count(F.lit(1)).alias("rows"), *([F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last")] if dated else []),
            F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")).alias("hash"),
        ).first()
        out[f"{part}/{name}.parquet"] = {"rows": found["rows"], "first": found["first"] if dated else None, "last": found["last"] if dated else None, "hash": str(found["hash"] or 0)}
    return out


def build(spark: SparkSession, root: str, folder: str, tickers: DataFrame, fence: str, index_folder: str, universe: str, size: int = 500, now: dt.datetime | None = None) -> dict:
    """Write all tables of a snapshot; returns the manifest.

    A yield from before the fence that was published on or after it belongs to the holdout, as do members of the
    fence's year.
    """
    now = now or dt.datetime.now()
    refuse_refresh(now.time())
    before = F.col("date") < F.lit(fence).cast("date")
    members, rets = stocks(spark, universe, root, size)
    tables = {
        "bars": (bars(spark, root, tickers), before), "market": (market(spark, root), before),
        "treasury": (yields(spark, root), before & (F.col("available_at_date") < F.lit(fence).cast("date"))),
        "index_closes": (index_closes(spark, index_folder), before),
        "stock_members": (members, F.col("effective_year") < int(fence[:4])), "stock_returns": (rets, before),
    }
    manifest = {"built_at": now.isoformat(timespec="seconds"), "fence_date": fence, "source": root, "stock_state_size": size, "files": {}}
    tickers.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/tickers.csv")  # a row for each ticker
    for name, (df, dev) in tables.items():
        manifest["files"] |= write_table(df, folder, name, dev)
    spark.createDataFrame([(json.dumps(manifest, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/MANIFEST.json")
    return manifest


def read_unlock(unlock: dict | None, run_exists) -> dict:
    """The unlock of the holdout, after a check that every field is given and its run has trials."""
    if not unlock:
        raise I.FenceError("the holdout is sealed: there is no unlock")
    lacking = [f for f in UNLOCK_FIELDS if not unlock.get(f)]
    if lacking:
        raise I.FenceError(f"the unlock lacks {', '.join(lacking)}")
    dt.date.fromisoformat(str(unlock["date"]))
    if not run_exists(str(unlock["run_id"])):
        raise I.FenceError(f"the unlock names run {unlock['run_id']}, which has no trials")
    return dict(unlock)


def read(spark: SparkSession, folder: str, name: str, mode: str, fence: str, unlock: dict | None = None, runs: str | None = None) -> DataFrame:
    """A table of the snapshot: mode dev is checked against the fence; mode full adds the holdout, for an unlock that names a run of the folder ``runs`` with trials."""
    if mode not in ("dev", "full"):
        raise SettingsError(f"a mode is dev or full, not {mode}")
    if mode == "full":  # before any row is read
        read_unlock(unlock, lambda run: runs is not None and exists(spark, f"{runs}/{run}/trials"))
    dev = spark.read.parquet(f"{folder}/dev/{name}.parquet")
    if mode == "dev":
        return I.check_fence(dev, fence) if "date" in dev.columns else dev
    return dev.unionByName(spark.read.parquet(f"{folder}/holdout/{name}.parquet"))
