"""Compaction of append logs (K2-K4).

A log is one folder per batch, ``<path>/batch=<id>`` (``writers.write_batch``). Left
alone it grows by a folder a batch, and its views rank every row ever written.
``AppendLog.compact`` folds finished batches into a *generation*: rows by UTC date,
sorted by key, in ``<path>-compacted/gen=<batch>/date=<day>``. Folding is what the
view does anyway (the newest row of a key, or the newest ``keep`` rows of a series),
and both may be done in steps, so the view over generations and the batches after
them is the view over all batches.

Only the dates that the new batches touch are written again (all of them with
``keep``, where the log is as small as what it retains); a manifest says which
generation holds each date. It is written last, by Spark's committer, and counts
once its ``_SUCCESS`` is there: a run that dies before leaves the old manifest in
force, and its half generation is overwritten or vacuumed later.

The newest ``spare`` batches are left alone, since a stream may run its last batch
again. A folded batch that runs again all the same is ignored: the view takes batch
folders after the manifest's last batch only. ``vacuum`` deletes what the last two
manifests don't need, so a reader that planned with the one before can finish.

Only folder names, one row a date, are held on the driver. One compaction of a log
runs at a time.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import keep_last
from .writers import retain_last, with_date

_MANIFEST = "folder string, gen long"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the folders under ``path`` that begin with ``prefix``, without it."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(x.getPath().getName()[len(prefix):] for x in fs.listStatus(p) if x.isDirectory() and x.getPath().getName().startswith(prefix))


@dataclass(frozen=True)
class AppendLog:
    """``key_cols``: the newest row of each key by ``order_cols`` stays (without
    them all rows do). ``keep``: the newest so many rows of each of ``series_cols``
    by ``order_cols`` stay. ``where``: rows that count at all. ``schema``: needed
    where all batches may be without a file."""
    path: str
    key_cols: Sequence[str] = ()
    order_cols: Sequence[str] = ("batch",)
    ts_col: str = "timestamp"
    keep: int | None = None
    series_cols: Sequence[str] = ("series_id",)
    where: str | None = None
    schema: T.StructType | None = None

    @property
    def _root(self) -> str:
        return f"{self.path}-compacted"

    # ------------------------------------------------------------ what is there
    def batches(self, spark: SparkSession) -> list[int]:
        return sorted(int(b) for b in _names(spark, self.path, "batch="))

    def manifests(self, spark: SparkSession) -> list[int]:
        """The last batch that each committed manifest covers, ascending."""
        out = []
        for n in sorted(int(x) for x in _names(spark, f"{self._root}/manifest", "through=")):
            fs, p = _fs(spark, f"{self._root}/manifest/through={n}/_SUCCESS")
            if fs.exists(p):
                out.append(n)
        return out

    def _folders(self, spark: SparkSession, through: int) -> dict[str, int]:
        """Date folder -> generation of a manifest: one row a date."""
        rows = spark.read.schema(_MANIFEST).json(f"{self._root}/manifest/through={through}").collect()
        return {r["folder"]: r["gen"] for r in rows}

    def _read_batches(self, spark: SparkSession, ids: Sequence[int] | None = None) -> DataFrame:
        r = spark.read.option("basePath", self.path)
        r = r.schema(self.schema) if self.schema else r
        d = r.parquet(*([self.path] if ids is None else [f"{self.path}/batch={b}" for b in ids]))
        return d.withColumn("batch", F.col("batch").cast("long"))

    def _read_folders(self, spark: SparkSession, folders: dict[str, int]) -> DataFrame | None:
        paths = [f"{self._root}/gen={g}/{name}" for name, g in sorted(folders.items())]
        return spark.read.option("basePath", self._root).parquet(*paths).drop("gen") if paths else None

    # ------------------------------------------------------------ reading
    def rows(self, spark: SparkSession) -> DataFrame:
        """The log's rows with their ``batch``: folded ones and those of later batches."""
        done = self.manifests(spark)
        if not done:
            return self._read_batches(spark)
        folded = self._read_folders(spark, self._folders(spark, done[-1]))
        later = [b for b in self.batches(spark) if b > done[-1]]
        if not later:
            return folded if folded is not None else with_date(self._read_batches(spark), self.ts_col).limit(0)
        tail = self._read_batches(spark, later)
        tail = tail if "date" in tail.columns else with_date(tail, self.ts_col)
        return folded.unionByName(tail) if folded is not None else tail

    def fold(self, rows: DataFrame) -> DataFrame:
        rows = rows.filter(self.where) if self.where else rows
        if self.key_cols:
            rows = keep_last(rows, self.key_cols, self.order_cols)
        if self.keep:
            rows = retain_last(rows, self.keep, series_cols=self.series_cols, order_cols=self.order_cols)
        return rows

    def view(self, spark: SparkSession) -> DataFrame:
        return self.fold(self.rows(spark))

    # ------------------------------------------------------------ folding
    def compact(self, spark: SparkSession, spare: int = 1) -> int | None:
        """Fold the batches but the newest ``spare``; the last batch folded, or None if there is none new."""
        done = self.manifests(spark)
        old = self._folders(spark, done[-1]) if done else {}
        ids = self.batches(spark)
        ids = [b for b in ids[:len(ids) - spare] if not done or b > done[-1]]
        if not ids:
            return None
        new = self._read_batches(spark, ids)
        new = new if "date" in new.columns else with_date(new, self.ts_col)
        if self.keep:
            again = old
        else:
            days = {r[0] for r in new.select(F.coalesce(F.col("date").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))).distinct().collect()}
            again = {name: g for name, g in old.items() if name.removeprefix("date=") in days}
        before = self._read_folders(spark, again)
        rows = self.fold(before.unionByName(new) if before is not None else new)
        gen, by = ids[-1], list(self.key_cols) or [*self.series_cols, self.ts_col]
        out = f"{self._root}/gen={gen}"
        (rows.hint("rebalance", F.col("date")).sortWithinPartitions("date", *by)
         .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("date").parquet(out))
        now = {name: g for name, g in old.items() if name not in again}
        now |= {f"date={d}": gen for d in _names(spark, out, "date=")}
        spark.createDataFrame(sorted(now.items()), _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self._root}/manifest/through={gen}")
        return gen

    def vacuum(self, spark: SparkSession, manifests: int = 2) -> int:
        """Delete the batches that the oldest of the last ``manifests`` manifests
        covers, and the date folders that none of them names; the count of folders."""
        kept = self.manifests(spark)[-manifests:]
        if len(kept) < manifests:
            return 0
        used = {f"gen={g}/{name}" for m in kept for name, g in self._folders(spark, m).items()}
        dead = [f"{self.path}/batch={b}" for b in self.batches(spark) if b <= kept[0]]
        dead += [f"{self._root}/manifest/through={n}" for n in _names(spark, f"{self._root}/manifest", "through=") if int(n) < kept[0]]
        for g in (int(x) for x in _names(spark, self._root, "gen=")):
            if g <= kept[-1]:  # a later one belongs to a run that has not committed yet
                dead += [f"{self._root}/gen={g}/date={d}" for d in _names(spark, f"{self._root}/gen={g}", "date=") if f"gen={g}/date={d}" not in used]
        for path in dead:
            fs, p = _fs(spark, path)
            fs.delete(p, True)
        return len(dead)
