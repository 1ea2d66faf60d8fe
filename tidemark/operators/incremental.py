"""Processing only new or changed records: a manifest of processed inputs, an anti-join, an idempotent write, a commit.

An *input* is whatever arrives as one piece and may grow or change in place: a file of a landing folder
(``FolderRuns``), or the rows of a table that one recorder delivered within one ``BUCKET`` of time (``TableRuns``).
The manifest (``Manifest``) holds of every input that was processed its key, size and checksum at that time. An input
whose key, size and checksum are in the manifest is done; every other input is pending: new ones, ones that have grown
and ones that changed in place.

A run stages the list of pending inputs, writes their results to a folder named by the batch, overwriting what a
failed attempt left there, writes the batch's part of the manifest beside it and commits it by an atomic rename. The batch's name
follows from the pending inputs and from how many batches went before. A run that is stopped before the rename has no effect and
is done again under the same name; one that is stopped after it has taken full effect. Nothing is skipped or
repeated either way. Results of an input that is processed again supersede its earlier ones.

Nulls: a row without an arrival time is never covered by a mark, so it is always pending. Rows without a recorder
likewise. Null values equal null and NaN equals NaN in comparisons. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Width of the pieces of arrival time that make the inputs of a table, in microseconds.
BUCKET = 3_600_000_000
#: Inputs that a batch of files takes at most: their paths are held on the driver. A run makes as many batches as it needs.
MAX_INPUTS = 10_000
#: Where a run can be stopped, for tests of its recovery.
STEPS = ("staged", "written", "ready", "committed")


class Stopped(RuntimeError):
    """A run was stopped on purpose after one of its ``STEPS``."""


def checksum_parts(columns: list[str]) -> tuple[Column, Column]:
    """The halves of a row's hash. Their sums over rows don't depend on the order, are sensitive to repeated rows, and combine before an exchange."""
    h = F.xxhash64(*columns)
    return h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(h, 32)


class Manifest:
    """The processed inputs, one folder ``batch_id=...`` of Parquet a batch under ``path``: key columns, size, checksum, batch_id, seq.

    Any file system that Hadoop knows will do; the commit needs its rename of a folder to be atomic.
    """

    def __init__(self, spark: SparkSession, path: str, key: dict[str, str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.fields = {**key, "size": "bigint", "checksum": "bigint", "modified": "bigint", "seq": "bigint"}

    def fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _typed(self, rows: DataFrame, fields: dict[str, str]) -> DataFrame:
        return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()))

    def entries(self) -> DataFrame:
        """All committed entries, superseded ones too."""
        fs, at = self.fs(self.path)
        schema = ", ".join(f"{c} {t}" for c, t in {**self.fields, "batch_id": "string"}.items())
        if not fs.exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)

    def latest(self) -> DataFrame:
        """The newest entry of each input."""
        rest = [c for c in [*self.fields, "batch_id"] if c not in self.key]
        newest = F.max_by(F.struct(*rest), "seq").alias("__now")
        return self.entries().groupBy(*self.key).agg(newest).select(*self.key, *(F.col(f"__now.{c}").alias(c) for c in rest))

    def next_seq(self) -> int:
        return (self.entries().agg(F.max("seq")).first()[0] or 0) + 1

    def pending(self, listing: DataFrame) -> DataFrame:
        """The anti-join: inputs of the listing whose key, size and checksum aren't together in the newest entries. Null keys match nothing."""
        return listing.join(self.latest().select(*self.key, "size", "checksum"), [*self.key, "size", "checksum"], "left_anti")

    def stage(self, rows: DataFrame, name: str) -> DataFrame:
        """Writes rows beside the manifest, where no reader of it looks, and reads them back: what is listed is fixed here, and its size known."""
        at = f"{self.path}/_{name}"
        rows.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def batch_name(self, pending: DataFrame, seq: int) -> str | None:
        """A name that depends on the pending inputs and the number of batches before; None if nothing is pending."""
        low, high = checksum_parts([*self.key, "size", "checksum"])
        n, a, b = pending.agg(F.count(F.lit(1)), F.sum(low), F.sum(high)).first()
        return "b" + hashlib.sha256(json.dumps([seq, n, a, b]).encode()).hexdigest()[:24] if n else None

    def commit(self, inputs: DataFrame, batch: str, seq: int, stop: str | None = None) -> None:
        """Makes the inputs done, all at once."""
        ready = f"{self.path}/_ready-{batch}"
        self._typed(inputs.withColumn("seq", F.lit(seq)), self.fields).write.mode("overwrite").parquet(ready)
        if stop == "ready":
            raise Stopped(stop)
        fs, src = self.fs(ready)
        _, dst = self.fs(f"{self.path}/batch_id={batch}")
        if fs.exists(dst):  # committed by an attempt that was taken for dead
            fs.delete(src, True)
        elif not fs.rename(src, dst):
            raise RuntimeError(f"the commit of {batch} failed")
        if stop == "committed":
            raise Stopped(stop)


# --- runs over a landing folder -----------------------------------------------------------------------------------


class FolderRuns:
    """Runs over a landing folder of Parquet files. ``out`` gets a folder ``batch_id=...`` a batch, ``manifest`` likewise.

    The function that processes a batch gets the rows with a column ``input``, the path of their file, and has to
    keep it: by it the results of a file that is processed again supersede its earlier ones. (A column of the files
    with that name is hidden by it.) Files that have gone keep their results; files without rows are processed and have none.
    """

    def __init__(self, spark: SparkSession, landing: str, out: str, manifest: str, glob: str = "*.parquet", trust_times: bool = True):
        self.spark, self.landing, self.out, self.glob, self.trust_times = spark, landing, out.rstrip("/"), glob, trust_times
        self.manifest = Manifest(spark, manifest, {"input": "string"})

    def listing(self) -> DataFrame:
        """input, path, size, modified, checksum of each file. Only files whose size or time of modification isn't that of the manifest are
        read (all files unless ``trust_times``); for the others its checksum holds."""
        files = (
            self.spark.read.format("binaryFile").option("pathGlobFilter", self.glob).option("recursiveFileLookup", "true").load(self.landing)
            .select(F.col("_metadata.file_path").alias("input"), "path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))
        )
        known = self.manifest.latest().select("input", "size", "modified", F.when(F.lit(self.trust_times), F.col("checksum")).alias("__sum"))
        files = files.join(known, ["input", "size", "modified"], "left").select("input", "path", "size", "modified", "__sum")
        return files.mapInArrow(_hashed, "input string, path string, size bigint, modified bigint, checksum bigint")

    def run(self, process: Callable[[DataFrame], DataFrame], stop: str | None = None) -> list[str]:
        """Processes what is pending with ``process``, in batches of ``MAX_INPUTS`` files; returns the names of the batches."""
        done = []
        staged = self.manifest.stage(self.manifest.pending(self.listing()), "staged")  # files that arrive from now on wait for the next run
        if stop == "staged":
            raise Stopped(stop)
        after = ""
        while True:
            part = staged.where(F.col("input") > after).orderBy("input").limit(MAX_INPUTS)
            files = part.select("input", "path").collect()
            if not files:
                break
            after, part = files[-1]["input"], staged.where((F.col("input") > after) & (F.col("input") <= files[-1]["input"]))
            seq = self.manifest.next_seq()
            batch = self.manifest.batch_name(part, seq)
            result = process(self.spark.read.parquet(*(f["path"] for f in files)).withColumn("input", F.col("_metadata.file_path")))
            if "input" not in result.columns:
                raise ValueError("the results have to keep the column input")
            result.write.mode("overwrite").parquet(f"{self.out}/batch_id={batch}")
            if stop == "written":
                raise Stopped(stop)
            self.manifest.commit(part, batch, seq, stop)
            done.append(batch)
        return done

    def results(self) -> DataFrame:
        """The rows of committed batches, of each file only those of its newest version."""
        fs, at = self.manifest.fs(self.out)
        if not fs.exists(at) or not fs.exists(self.manifest.fs(self.manifest.path)[1]):
            raise FileNotFoundError("no batch is committed")
        rows = self.spark.read.option("basePath", self.out).parquet(self.out).withColumn("batch_id", F.col("batch_id").cast("string"))
        # an uncommitted batch has no entries, and superseded ones aren't the latest
        return rows.join(self.manifest.latest().select("input", "batch_id"), ["input", "batch_id"], "left_semi")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checksums of the files that have none yet, read in pieces where the task runs."""
    from pyarrow import fs

    for batch in batches:
        sums = []
        for name, known in zip(batch.column("input").to_pylist(), batch.column("__sum").to_pylist(), strict=True):
            if known is None:
                system, at = fs.FileSystem.from_uri(name)
                h = hashlib.sha256()
                with system.open_input_stream(at) as stream:
                    while piece := stream.read(1 << 22):
                        h.update(piece)
                known = int.from_bytes(h.digest()[:8], "big", signed=True)
            sums.append(known)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], ["input", "path", "size", "modified", "checksum"])


# --- runs over growing tables -------------------------------------------------------------------------------------


def marks_of(runs: DataFrame, feed: str) -> DataFrame:
    """recorder_id, mark: the greatest ``upto`` of each recorder's ok runs. Failed, killed and running runs and ok runs without ``upto`` add nothing."""
    ok = runs.where((F.col("feed") == feed) & (F.col("run_status") == "ok") & F.col("upto").isNotNull() & F.col("recorder_id").isNotNull())
    return ok.groupBy("recorder_id").agg(F.max("upto").alias("mark"))


def changed_versions(key: list[str], order: list[str], payload: list[str]) -> Column:
    """Whether a row is the first version of its record or differs from the one just before it in ``payload``."""
    w = Window.partitionBy(*key).orderBy(*order)
    differs = F.lag(F.lit(True)).over(w).isNull()
    for c in payload:
        differs = differs | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return differs


class TableRuns:
    """Runs over tables that grow: each has recorder_id and ``arrived``, and is one feed. ``path`` gets results and manifest.

    What earlier runs processed is known from a log (``adopt``): it becomes the first batch of the manifest, with size and
    checksum of what they had read of each input by their mark. An input that has got rows since then differs from that
    and is pending, and of its rows those after the mark are taken.
    """

    KEY = {"feed": "string", "recorder_id": "bigint", "bucket": "bigint"}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.out = spark, f"{path.rstrip('/')}/rows"
        self.manifest = Manifest(spark, f"{path.rstrip('/')}/manifest", self.KEY)

    @staticmethod
    def keyed(rows: DataFrame, runs: DataFrame, feed: str) -> DataFrame:
        """The rows with feed, bucket and whether they came after the mark. The marks, one row a recorder, are broadcast only if they are small."""
        bucket = F.expr(f"unix_micros(cast(arrived as timestamp)) div {BUCKET}")
        out = rows.withColumn("feed", F.lit(feed)).withColumn("bucket", bucket).join(marks_of(runs, feed), "recorder_id", "left")
        return out.withColumn("after", F.coalesce(F.col("arrived") > F.col("mark"), F.lit(True))).drop("mark")

    @staticmethod
    def listing(keyed: DataFrame, content: list[str]) -> DataFrame:
        """feed, recorder_id, bucket, size, checksum of the inputs as they are, and size and checksum of what had been read of them by the mark."""
        low, high = checksum_parts(content)
        old = ~F.col("after")
        return (
            keyed.groupBy("feed", "recorder_id", "bucket")
            .agg(F.count(F.lit(1)).alias("size"), F.sum(low).alias("low"), F.sum(high).alias("high"), F.count(F.when(old, 1)).alias("old_size"), F.sum(F.when(old, low)).alias("old_low"), F.sum(F.when(old, high)).alias("old_high"))
            .select("feed", F.col("recorder_id").cast("bigint").alias("recorder_id"), "bucket", "size", F.xxhash64("low", "high").alias("checksum"), "old_size", F.xxhash64("old_low", "old_high").alias("old_checksum"))
        )

    def adopt(self, listing: DataFrame, stop: str | None = None) -> None:
        """Makes what the log's runs have read the first batch of the manifest. Done once: a manifest that has entries is left as it is."""
        if self.manifest.next_seq() == 1:
            read = listing.where("old_size > 0").select("feed", "recorder_id", "bucket", F.col("old_size").alias("size"), F.col("old_checksum").alias("checksum"))
            self.manifest.commit(read, "log", 1, stop)

    def run(self, tables: dict[str, tuple[DataFrame, list[str], str, list[str]]], runs: DataFrame, stop: str | None = None) -> str | None:
        """Processes the new and changed records of each feed; returns the batch's name, None if nothing is pending.

        ``tables``: feed → (rows, key of a record, id of a row, compared columns). The results, feed and row_id of
        every pending row that is the first version of its record or differs from the one before, are in ``results``.
        """
        own = {feed: rows.select(*dict.fromkeys([*key, row_id, *payload, "recorder_id", "arrived"])) for feed, (rows, key, row_id, payload) in tables.items()}
        listing = None
        for feed, (_, key, row_id, payload) in tables.items():
            part = self.listing(self.keyed(own[feed], runs, feed), [*key, row_id, *payload])
            listing = part if listing is None else listing.unionByName(part)
        listing = self.manifest.stage(listing, "listing")
        self.adopt(listing)
        pending = self.manifest.stage(self.manifest.pending(listing.drop("old_size", "old_checksum")), "staged")
        if stop == "staged":
            raise Stopped(stop)
        seq = self.manifest.next_seq()
        batch = self.manifest.batch_name(pending, seq)
        if batch is None:
            return None
        found = None
        for feed, (_, key, row_id, payload) in tables.items():
            changed = own[feed].withColumn("__changed", changed_versions(key, ["arrived", row_id], payload)).where("__changed")
            rows = self.keyed(changed.select(row_id, "recorder_id", "arrived"), runs, feed).where("after")
            now = pending.where(F.col("feed") == feed).select(*(F.col(c).alias(f"__{c}") for c in self.KEY))
            same = F.col("recorder_id").eqNullSafe(F.col("__recorder_id")) & F.col("bucket").eqNullSafe(F.col("__bucket"))
            rows = rows.join(now, same, "left_semi").select("feed", F.col(row_id).alias("row_id"))
            found = rows if found is None else found.unionByName(rows)
        found.write.mode("overwrite").parquet(f"{self.out}/batch_id={batch}")
        if stop == "written":
            raise Stopped(stop)
        self.manifest.commit(pending, batch, seq, stop)
        return batch

    def results(self, batch: str) -> DataFrame:
        """feed, row_id of a committed batch."""
        fs, at = self.manifest.fs(f"{self.manifest.path}/batch_id={batch}")
        if not fs.exists(at):
            raise FileNotFoundError(f"batch {batch} isn't committed")
        return self.spark.read.schema("feed string, row_id bigint").parquet(f"{self.out}/batch_id={batch}")
