"""A stored table of values by key: appended runs, of which the newest entry counts, and compaction.

A run is a folder of Parquet files, in folders by bucket of the key, that appears under its name at once.
Several writers append without knowing of each other. Compaction writes one run for several, which names
them; from its appearance on readers leave those out, so they see the old runs or the new one, and a
reader that began before still finds its files, which only ``vacuum`` deletes, some time later.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import Files

ENTRY = "key string, value string, fetched_at timestamp"
BUCKETS = 16


class KeyValueStore:
    """``ENTRY`` rows at ``path``; all users of a path give the same number of buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.files = Files(spark, path)
        self.files.make(f"{self.path}/runs")
        self.files.make(f"{self.path}/begun")

    def _bucket(self, key: str = "key"):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def append(self, entries: DataFrame, supersedes: list[str] | None = None) -> str:
        """Add entries as a run; the run's name. Rows without a key are left out, and an entry that a newer one of the run replaces."""
        name = f"run-{uuid.uuid4().hex}"
        begun = f"{self.path}/begun/{name}"
        newest = self._newest(entries.select("key", "value", F.col("fetched_at").cast("timestamp").alias("fetched_at")).filter("key is not null"))
        newest.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{begun}/data")
        self.files.write(f"{begun}/replaces.json", json.dumps(sorted(supersedes or [])))
        self.files.rename(begun, f"{self.path}/runs/{name}")
        return name

    @staticmethod
    def _newest(entries: DataFrame) -> DataFrame:
        """The newest entry of each key; of equal times the largest value, null values last."""
        best = F.max(F.struct("fetched_at", F.col("value").isNotNull().alias("some"), "value"))
        return entries.groupBy("key").agg(best.alias("e")).select("key", "e.value", "e.fetched_at")

    def _replaced(self, names) -> dict[str, list[str]]:
        paths = [f"{self.path}/runs/{n}/replaces.json" for n in names]
        rows = self.spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value").collect() if paths else []
        return {r["p"].rstrip("/").split("/")[-2]: json.loads(r["value"]) for r in rows}

    def runs(self) -> list[str]:
        """Names of the runs that count."""
        names = sorted(self.files.names(f"{self.path}/runs"))
        gone = {old for olds in self._replaced(names).values() for old in olds}
        return [n for n in names if n not in gone]

    def _entries(self, runs: list[str]) -> DataFrame:
        schema = f"{ENTRY}, bucket int"
        if not runs:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/runs/{n}/data") for n in runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read(self, since=None) -> DataFrame:
        """The newest entry of each key; with ``since``, of those fetched at that time or later."""
        return self._aged(self._newest(self._entries(self.runs()).drop("bucket")), since)

    @staticmethod
    def _aged(entries: DataFrame, since) -> DataFrame:
        return entries if since is None else entries.filter(F.col("fetched_at") >= F.lit(since).cast("timestamp"))

    def lookup(self, keys: DataFrame, key: str = "key", since=None) -> DataFrame:
        """``keys`` with value and fetched_at, null where nothing (young enough) is stored; only the keys' buckets are read."""
        asked = keys.select(F.col(key).alias("_k")).filter("_k is not null").distinct().withColumn("_b", self._bucket("_k"))
        met = self._entries(self.runs()).join(asked, (F.col("bucket") == F.col("_b")) & (F.col("key") == F.col("_k")), "left_semi").drop("bucket")
        found = self._aged(self._newest(met), since).select(F.col("key").alias("_k"), "value", "fetched_at")
        return keys.join(found, keys[key] == F.col("_k"), "left").drop("_k")

    def missing(self, keys: DataFrame, key: str = "key", since=None) -> DataFrame:
        """The distinct keys of which nothing (young enough) is stored."""
        found = self.lookup(keys.select(F.col(key).alias("key")).filter("key is not null").distinct(), since=since)
        return found.filter("fetched_at is null").select("key")

    def compact(self, since=None) -> str | None:
        """One run for all that count now, without entries older than ``since``; its name, or None where one run is all there is."""
        runs = self.runs()
        if len(runs) < 2 and since is None or not runs:
            return None
        replaced = self._replaced(runs)
        known = sorted({*runs, *(old for n in runs for old in replaced.get(n, []))})
        return self.append(self._aged(self._newest(self._entries(runs).drop("bucket")), since), known)

    def vacuum(self, older_than_ms: int) -> list[str]:
        """Delete runs that were replaced, and writes that never ended, if they were last changed before that time; their names."""
        stored = self.files.names(f"{self.path}/runs")
        live, out = set(self.runs()), []
        for folder, names in (("runs", {n: t for n, t in stored.items() if n not in live}), ("begun", self.files.names(f"{self.path}/begun"))):
            for name, changed in names.items():
                if changed < older_than_ms:
                    self.files.drop(f"{self.path}/{folder}/{name}")
                    out.append(name)
        return sorted(out)
