"""Stored findings: snapshots that readers see whole or not at all.

A store is a folder. A write puts the findings of the runs it touches into a batch of its own (`data/batch=B/run_id=R`), writes a
list of which batch holds each run (`lists/L`, a table), and then publishes the list by one small file
(`versions/N`), whose creation by rename is what commits it. Readers follow the newest version to its list and read the
batches it names, so a batch that was never published, or is half written, is not seen. Runs that a write does not touch are not
rewritten. Two writers who start from one version cannot both publish the next: the second one lists its batch again on top
of the first one's, unless both touched the same run, which raises.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIST = "run_id long, batch string"


class ConflictError(RuntimeError):
    """Another writer has published a run that this one was about to change."""


class FindingStore:
    """Findings with columns of `schema`, run_id (long) among them, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    # which version holds

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest published version, 0 before the first."""
        path, fs = self._files()
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _list_of(self, version: int) -> DataFrame:
        """run_id and batch of the runs that a version holds."""
        if not version:
            return self.spark.createDataFrame([], _LIST)
        name = self.spark.read.text(f"{self.folder}/versions/{version:012d}").first()[0]
        return self.spark.read.schema(_LIST).parquet(f"{self.folder}/lists/{name}")

    def _publish(self, version: int, name: str) -> bool:
        """Creates the version's file, as a whole and only if there is none yet; False if another writer was first."""
        jvm = self.spark._jvm
        folder, fs = self._files()
        fs.mkdirs(folder)
        waiting, final = (jvm.org.apache.hadoop.fs.Path(folder, n) for n in (f".{uuid.uuid4().hex}", f"{version:012d}"))
        out = fs.create(waiting, False)
        out.write(bytearray(name.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(waiting, final, options)  # without the right to overwrite
        except Exception:
            fs.delete(waiting, False)
            if fs.exists(final):
                return False
            raise
        return True

    # what readers and writers do

    def read(self, version: int | None = None) -> DataFrame:
        """The findings of a version, the newest one by default."""
        version = self.version() if version is None else version
        held = self._list_of(version)
        if not version:
            return self.spark.createDataFrame([], self.schema)
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        try:
            rows = self.spark.read.schema(f"{self.schema}, batch string").option("basePath", f"{self.folder}/data").parquet(f"{self.folder}/data")
        except PySparkException:  # every run of this version is empty
            return self.spark.createDataFrame([], self.schema)
        return rows.join(held, ["run_id", "batch"], "left_semi").select(*columns)

    def write(self, findings: DataFrame, gone: DataFrame | None = None, base: int | None = None, tries: int = 5) -> int:
        """Replaces the findings of the runs in `findings`, and clears those of `gone` (run_id); the version published.

        `base` is the version that the findings were made from: a run that others have published since then raises.
        """
        base = self.version() if base is None else base
        batch = uuid.uuid4().hex
        findings.withColumn("batch", F.lit(batch)).write.partitionBy("batch", "run_id").mode("append").parquet(f"{self.folder}/data")
        stored = self.spark.read.schema(f"{self.schema}, batch string").option("basePath", f"{self.folder}/data").parquet(f"{self.folder}/data").filter(F.col("batch") == batch)
        mine = stored.select("run_id", "batch").distinct()
        touched = mine.select("run_id") if gone is None else mine.select("run_id").union(gone.select(F.col("run_id").cast("long"))).distinct()
        return self._commit(mine, touched, base, tries)

    def _commit(self, mine: DataFrame, touched: DataFrame, base: int, tries: int) -> int:
        before = self._list_of(base)
        for _ in range(tries):
            newest = self.version()
            held = self._list_of(newest)
            if newest != base:
                same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("run_id", "batch")]
                new = held.alias("a").join(before.alias("b"), same, "left_anti").select("run_id")
                lost = before.alias("a").join(held.alias("b"), same, "left_anti").select("run_id")
                if not new.union(lost).join(touched, "run_id", "left_semi").isEmpty():
                    raise ConflictError(f"a run was changed between versions {base} and {newest}")
            name = uuid.uuid4().hex
            held.join(touched, "run_id", "left_anti").union(mine.select("run_id", "batch")).write.parquet(f"{self.folder}/lists/{name}")
            if self._publish(newest + 1, name):
                return newest + 1
        raise ConflictError(f"no version could be published in {tries} tries")

    def clear(self, runs: DataFrame) -> int:
        """Clears the findings of runs (run_id); the version published."""
        return self._commit(self.spark.createDataFrame([], _LIST), runs.select(F.col("run_id").cast("long").alias("run_id")).distinct(), self.version(), 5)

    def update(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """Publishes what `change` makes of the stored findings; it raises if a run was changed meanwhile."""
        base = self.version()
        now = self.read(base)
        after = change(now)
        emptied = now.select("run_id").distinct().join(after.select("run_id").distinct(), "run_id", "left_anti")
        return self.write(after, emptied, base)
