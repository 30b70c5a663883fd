"""Versioned dataset folders: candidate, gate, atomic publish, manifest, lock, backups.

``<root>/versions/<run id>/`` holds one Parquet folder per table; ``<root>/CURRENT`` names the published version and
is replaced in one step, so readers see the old or the new version and nothing between. Paths are on a file system that
all share; every step works on metadata only, data are written by executors.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import shutil
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


class StoreError(RuntimeError):
    """A publish, lock or restore that may not go on."""


def run_id() -> str:
    """A name that sorts by time."""
    now = time.time()
    return time.strftime("%Y%m%dT%H%M%S", time.gmtime(now)) + f"{int(now % 1 * 1e6):06d}-{os.getpid():x}"


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order: count, sum and xor of row hashes."""
    r = df.select(F.xxhash64(*[F.col(c).cast("string") if "map" in t else F.col(c) for c, t in df.dtypes]).alias("h"))
    n, total, x = r.agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return hashlib.sha256(f"{n}|{total}|{x}|{df.schema.simpleString()}".encode()).hexdigest()[:32]


class Store:
    """One dataset."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        os.makedirs(f"{root}/versions", exist_ok=True)

    @contextmanager
    def lock(self):
        """Only one writer at a time; a second one fails at once."""
        with open(f"{self.root}/.lock", "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError as e:
                raise StoreError("another run holds the lock") from e
            yield

    def current(self) -> str | None:
        try:
            with open(f"{self.root}/CURRENT") as f:
                return f.read().strip() or None
        except FileNotFoundError:
            return None

    def table(self, name: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/versions/{version or self.current()}/{name}")

    def manifest(self, version: str | None = None) -> dict:
        with open(f"{self.root}/versions/{version or self.current()}/manifest.json") as f:
            return json.load(f)

    def publish(self, tables: dict[str, DataFrame], gate: Callable[[dict[str, DataFrame]], list[str]] | None = None, must_have_rows: tuple[str, ...] = ()) -> str:
        """Write a candidate, check it, and make it current; on any failure the published version stays as it was.

        Unchanged tables (equal fingerprints) make a no-op that returns the current version.
        """
        with self.lock():
            version = run_id()
            base = f"{self.root}/versions/{version}"
            try:
                return self._candidate(tables, version, base, gate, must_have_rows)
            except BaseException:
                shutil.rmtree(base, ignore_errors=True)  # a candidate that failed is not left behind
                raise

    def _candidate(self, tables, version, base, gate, must_have_rows) -> str:
        """Write and check the candidate; the version that is current afterwards."""
        for name, df in tables.items():
            df.write.parquet(f"{base}/{name}")
        written = {name: self.table(name, version) for name in tables}
        prints = {name: fingerprint(df) for name, df in written.items()}
        if self.current() and self.manifest()["tables"] == prints:
            shutil.rmtree(base)
            return self.current()
        errors = [f"{n} is empty" for n in must_have_rows if written[n].isEmpty()] + (gate(written) if gate else [])
        if errors:
            raise StoreError("; ".join(errors))
        self._write(f"{base}/manifest.json", json.dumps({"schema_version": SCHEMA_VERSION, "run_id": version, "tables": prints}))
        self._write(f"{self.root}/CURRENT", version)
        return version

    def consistent(self) -> bool:
        """Whether the published files are those of their manifest."""
        m = self.manifest()
        return m["run_id"] == self.current() and all(fingerprint(self.table(n)) == h for n, h in m["tables"].items())

    def backup(self, target: str, keep: int = 5) -> str:
        """Copy the published version aside; the oldest copies beyond ``keep`` go."""
        version = self.current()
        if not version:
            raise StoreError("nothing is published")
        shutil.copytree(f"{self.root}/versions/{version}", f"{target}/{version}", dirs_exist_ok=True)
        for old in sorted(os.listdir(target))[:-keep]:
            shutil.rmtree(f"{target}/{old}")
        return f"{target}/{version}"

    def restore(self, backup: str) -> str:
        """Make a backup current again, after its manifest has been held against its files."""
        with self.lock():
            with open(f"{backup}/manifest.json") as f:
                m = json.load(f)
            if m["schema_version"] > SCHEMA_VERSION:
                raise StoreError("the backup is of a later schema")
            if any(fingerprint(self.spark.read.parquet(f"{backup}/{n}")) != h for n, h in m["tables"].items()):
                raise StoreError("the backup is damaged")
            shutil.copytree(backup, f"{self.root}/versions/{m['run_id']}", dirs_exist_ok=True)
            self._write(f"{self.root}/CURRENT", m["run_id"])
            return m["run_id"]

    @staticmethod
    def _write(path: str, text: str) -> None:
        with open(path + ".tmp", "w") as f:
            f.write(text)
        os.replace(path + ".tmp", path)
