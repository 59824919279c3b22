"""Runs and caches: a run is frozen with the settings and code it began with, derived tables are found by their content key."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import io
import json
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loomspan.functions.settings import SettingsError, migrated, settings_hash
from loomspan.sources.shared_files import Files


def code_hash(*roots: Path, digits: int = 12) -> str:
    """Hash of all Python files below some folders (or of single files), by relative name and content."""
    h = hashlib.sha256()
    for root in roots:
        for path in sorted(root.rglob("*.py")) if root.is_dir() else [root]:
            h.update((path.relative_to(root) if root.is_dir() else Path(path.name)).as_posix().encode() + b"\0" + path.read_bytes() + b"\0")
    return h.hexdigest()[:digits]


def _packed(root: Path) -> str:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.writestr(path.relative_to(root).as_posix(), path.read_bytes())
    return base64.b64encode(out.getvalue()).decode()


@dataclass(frozen=True)
class Run:
    """A run: run.json has everything it began with (settings, their hash, what changed the base, packed code), starts/ a file for each start."""

    spark: SparkSession
    folder: str
    run_id: str

    @classmethod
    def begin(cls, spark: SparkSession, runs: str, settings: dict, code: Path, run_id: str | None = None, changes: dict | None = None, now: dt.datetime | None = None) -> Run:
        """Begin a run, or go on with one of the same id and settings; other settings under a used id are refused."""
        now = now or dt.datetime.now()
        run_id = run_id or f"{now:%Y%m%d_%H%M}_{settings.get('run_name', 'run')}"
        run = cls(spark, f"{runs}/{run_id}", run_id)
        files, key = Files(spark), settings_hash(settings)
        first = {"run_id": run_id, "began": now.isoformat(timespec="seconds"), "settings_hash": key, "settings": settings, "changes": changes or {}, "code": _packed(code)}
        if not files.create(f"{run.folder}/run.json", json.dumps(first, default=str)):
            frozen = run.record()["settings_hash"]
            if frozen != key:
                raise SettingsError(f"run {run_id} began with other settings ({frozen}, not {key}); take a new run id")
        start = {"at": now.isoformat(timespec="seconds"), "code_hash": code_hash(code)}
        files.create(f"{run.folder}/starts/{len(run.starts()):06d}.json", json.dumps(start))
        return run

    def record(self) -> dict:
        return json.loads(Files(self.spark).text(f"{self.folder}/run.json"))

    def starts(self) -> list[dict]:
        files = Files(self.spark)
        return [json.loads(files.text(f"{self.folder}/starts/{n}")) for n in files.names(f"{self.folder}/starts")]

    def settings(self, base: dict) -> dict:
        """The settings it began with, as today's base lays them out."""
        return migrated(self.record()["settings"], base)

    def code(self) -> dict[str, str]:
        """The files of the code it began with."""
        with zipfile.ZipFile(io.BytesIO(base64.b64decode(self.record()["code"]))) as z:
            return {n: z.read(n).decode() for n in z.namelist()}


def fingerprint(spark: SparkSession, *places: str) -> str:
    """Of tables: the manifest where a place has one (rows and content hashes), else names, sizes and times of its files."""
    files, h = Files(spark), hashlib.sha256()
    for place in places:
        manifest = f"{place}/MANIFEST.json"
        if files.exists(manifest):
            names = [n for n in files.names(manifest) if n.startswith("part-")]
            said = "".join(files.text(f"{manifest}/{n}") for n in names) if names else files.text(manifest)
            h.update(json.dumps({k: v for k, v in json.loads(said).items() if k != "built_at"}, sort_keys=True).encode())
        else:
            h.update(json.dumps(files.listing(place)).encode())
    return h.hexdigest()[:16]


def cache_key(settings: dict, code: str, data: str) -> str:
    """Key of a derived table: the settings it reads, the code that makes it, the data it is made from."""
    return hashlib.sha256(json.dumps([settings, code, data], sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached(spark: SparkSession, folder: str, name: str, key: str, make: Callable[[], DataFrame], rebuild: bool = False, partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """(table, whether it was there) of a key; a table counts once it is written whole.  Other keys of the name stay."""
    path, files = f"{folder}/{name}_{key}", Files(spark)
    hit = files.exists(f"{path}/_SUCCESS") and not rebuild
    if not hit:
        writer = make().write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path), hit


def drop_stale(spark: SparkSession, folder: str, name: str, keys: set[str]) -> list[str]:
    """Delete tables of a name under other keys than these; returns their folders' names."""
    files = Files(spark)
    stale = [n for n in files.names(folder) if n.startswith(f"{name}_") and n[len(name) + 1 :] not in keys]
    for n in stale:
        files.delete(f"{folder}/{n}")
    return stale
