"""Frames that several queries share: written once for an application, read back without their lineage.

A plan of hundreds of expressions costs the driver seconds each time it is analysed or compared with cached plans;
a written table costs a scan.  It also outlives a lost executor, which a cached frame does not.
"""

from __future__ import annotations

import atexit
import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, DataFrame] = {}
_FOLDERS: dict[str, tuple[SparkSession, str]] = {}


def folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir; a temporary one only where all runs on this machine."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="loomspan-")
        _FOLDERS[app] = (spark, f"{root}/kept-{app}")
        atexit.register(_delete, app)
    return _FOLDERS[app][1]


def _delete(app: str) -> None:
    spark, path = _FOLDERS[app]
    if spark.sparkContext._jsc is None:  # the application has ended
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The frame of (spark, folder of tables, more choices), made and written once for an application."""

    @wraps(make)
    def get(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, make.__module__, make.__name__, *more)
        if key not in _KEPT:
            path = f"{folder(spark)}/{make.__name__}-{len(_KEPT)}"
            made = make(spark, sf_dir, *more)
            made.write.mode("overwrite").parquet(path)
            _KEPT[key] = spark.read.schema(made.schema).parquet(path)
        return _KEPT[key]

    return get
