"""Writing the library: files of entries, and keyed tables with versions."""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import keyed
from tidemill.session import cut


def safe_path(root: str, relative: str) -> str:
    """The path of a relative name below a root; names that leave the root are refused."""
    whole = posixpath.normpath(posixpath.join(root, relative))
    if not relative or posixpath.isabs(relative) or not whole.startswith(posixpath.normpath(root) + "/"):
        raise ValueError(f"outside of the library: {relative!r}")
    return whole


def write_entries(entries: DataFrame, root: str, path: str = "relativePath", body: str = "body") -> DataFrame:
    """Write one file per row below a shared ``root``; one result row each, a failure never stops another.

    Files appear under their name only when complete, so a repeated task leaves the same files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, text in zip(b["p"], b["t"], strict=True):
                try:
                    target = safe_path(root, name or "")
                    os.makedirs(posixpath.dirname(target), exist_ok=True)
                    part = f"{target}.{os.getpid()}.tmp"
                    with open(part, "w", encoding="utf-8") as f:
                        f.write(text or "")
                        f.flush()
                        os.fsync(f.fileno())
                    os.replace(part, target)
                    out.append((name, True, None))
                except (OSError, ValueError) as e:
                    out.append((name, False, str(e)))
            yield pd.DataFrame(out, columns=["path", "ok", "error"])

    return entries.select(F.col(path).alias("p"), F.col(body).alias("t")).mapInPandas(run, "path string, ok boolean, error string")


class VersionedTable:
    """A keyed Parquet table in a shared folder, changed by upserts that are applied once and whole.

    Rows lie in buckets of their key's hash. An upsert reads and rewrites only the buckets it touches, into a folder of
    its own; then a numbered commit, put in place by one rename, names the folder of every bucket. The highest commit
    counts, so a crash at any moment leaves the table as it was, and what was written without a commit is removed by
    :meth:`vacuum`. Upserts carry a batch number; a number that was applied is skipped, which makes them safe to repeat.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], keep: tuple[str, ...] = (), buckets: int = 16) -> None:
        self.spark, self.root, self.schema, self.keys, self.keep, self.buckets = spark, root.rstrip("/"), schema, keys, keep, buckets
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self._path(folder))] if self._fs.exists(self._path(folder)) else []

    def _current(self) -> dict:
        numbers = [int(n[:-5]) for n in self._names("commits") if n.endswith(".json")]
        if not numbers:
            return {"version": 0, "batch": -1, "folders": {}}
        return json.loads(self.spark.read.text(f"{self.root}/commits/{max(numbers):09d}.json", wholetext=True).head()[0])

    def _commit(self, version: int, state: dict) -> None:
        target, part = self._path(f"commits/{version:09d}.json"), self._path(f"commits/{version:09d}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(part, target):
            raise RuntimeError(f"version {version} exists: another writer was faster")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*(f"{self.root}/{f}" for f in folders))

    def read(self) -> DataFrame:
        return self._read(sorted(self._current()["folders"].values()))

    def upsert(self, new: DataFrame, batch: int) -> bool:
        """Apply a batch once; rows of ``new`` must have one row per key."""
        now = self._current()
        if batch <= now["batch"]:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = cut(new)
        touched = sorted(r[0] for r in new.select(bucket.alias("b")).distinct().collect())  # at most ``buckets`` numbers
        version, folders = now["version"] + 1, dict(now["folders"])
        if touched:
            old = self._read([folders[str(b)] for b in touched if str(b) in folders])
            at = f"data/{version:09d}-{uuid.uuid4().hex[:8]}"
            rows = keyed.upsert(old, new, self.keys, self.keep).withColumn("_bucket", bucket)
            rows.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{at}")
            folders |= {str(b): f"{at}/_bucket={b}" for b in touched}
        self._commit(version, {"version": version, "batch": batch, "folders": folders})
        return True

    def vacuum(self) -> list[str]:
        """Remove folders and commits that the newest commit doesn't need; no reader may be at work on an older one."""
        now = self._current()
        used = set(now["folders"].values())
        gone = []
        for name in self._names("data"):
            for part in self._names(f"data/{name}"):
                if part.startswith("_bucket=") and f"data/{name}/{part}" not in used:
                    gone.append(f"data/{name}/{part}")
        gone += [f"commits/{n}" for n in self._names("commits") if n != f"{now['version']:09d}.json"]
        for name in gone:
            self._fs.delete(self._path(name), True)
        return gone
