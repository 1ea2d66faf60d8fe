"""The binary files of fixed-width records: a Spark data source that reads parts of files in parallel, and a writer.

Layout: magic, byte order mark, header size; the header (version, interval or 0 for raw, period, the three
settings); then records, 16 bytes for a point and 56 for a level row, all little-endian. A file whose tail is half
written is read up to its last whole record.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.config import RollupConfig
from tidemark.errors import FormatError

# Fixed values of the format.
MAGIC = bytes([0x48, 0x54, 0x41, 0x1A, 0xC5, 0x2C, 0xCC, 0x1D])
BOM = 0xF8F9FAFBFCFDFEFF
VERSION = 2
HEADER = struct.Struct("<QqQQqqq")  # version, interval, period numerator, denominator, interval_min, interval_factor, interval_max
PREAMBLE = struct.Struct("<8sQQ")
POINT = np.dtype([("t", "<i8"), ("v", "<f8")])
ROW = np.dtype([("t", "<i8"), ("mn", "<f8"), ("mx", "<f8"), ("s", "<f8"), ("c", "<u8"), ("i", "<f8"), ("a", "<i8")])
RECORDS_PER_PART = 4_000_000


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it. Any that Arrow knows will do, as long as all executors reach it; paths without a scheme are local."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def metric_folder(name: str) -> str:
    """A metric's folder: its name, with everything quoted that could leave the folder it is in."""
    quoted = "".join(c if c not in "/\\%:?#[]" and c >= " " else "".join(f"%{b:02X}" for b in c.encode()) for c in name)
    return quoted.replace(".", "%2E") if quoted.strip(".") == "" else quoted


def read_header(path: str, system: fs.FileSystem | None = None) -> dict[str, int]:
    """The header of a file (``path`` is one in ``system``, if that is given): interval, interval_min, interval_factor, interval_max, offset (of the records), records, width, first and last (times; None without records)."""
    system, at = (system, path) if system else _at(path)
    with system.open_input_file(at) as f:
        head = f.read(PREAMBLE.size)
        if len(head) < PREAMBLE.size:
            raise FormatError(f"{path} is too short")
        magic, bom, size = PREAMBLE.unpack(head)
        if magic != MAGIC:
            raise FormatError(f"{path} doesn't begin as it should")
        if bom != BOM:
            raise FormatError(f"{path} has another byte order")
        if size < HEADER.size:
            raise FormatError(f"{path} has a header of {size} bytes")
        head = f.read(HEADER.size)
        if len(head) < HEADER.size:
            raise FormatError(f"{path} is too short")
        version, interval, num, den, low, factor, high = HEADER.unpack(head)
        if version != VERSION:
            raise FormatError(f"{path} has version {version}")
        if (num, den) != (1, 1_000_000_000):
            raise FormatError(f"{path} doesn't count in nanoseconds")
        offset = PREAMBLE.size + size
        width = (ROW if interval else POINT).itemsize
        records = max(0, f.size() - offset) // width
        ends = [struct.unpack("<q", f.read_at(8, offset + i * width))[0] for i in (0, records - 1)] if records else [None, None]
    return {"interval": interval, "interval_min": low, "interval_factor": factor, "interval_max": high, "offset": offset, "width": width, "records": records, "first": ends[0], "last": ends[1]}


def _preamble(config: RollupConfig, interval: int) -> bytes:
    return PREAMBLE.pack(MAGIC, BOM, HEADER.size) + HEADER.pack(VERSION, interval, 1, 1_000_000_000, config.interval_min, config.interval_factor, config.interval_max)


def write_file(path: str, config: RollupConfig, records: np.ndarray, interval: int = 0) -> None:
    """Writes a file of points (interval 0) or level rows."""
    system, at = _at(path)
    with system.open_output_stream(at) as f:
        f.write(_preamble(config, interval))
        f.write(np.ascontiguousarray(records, ROW if interval else POINT).tobytes())


def write_records(rows: DataFrame, path: str, config: RollupConfig, interval: int = 0, suffix: str = "rec") -> None:
    """Writes one file a metric under ``path`` (a folder that all executors share) from points or the rows of one level.

    The format has one file a metric, so each metric streams through one task, in order of time and with the memory of a
    batch. A file appears under its name only when it is complete, so a task that is tried again leaves nothing half-written.
    """
    kind = ROW if interval else POINT
    name = f"{interval}.{suffix}" if interval else f"raw.{suffix}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _at(path)
        metric, part, file = None, "", None

        def finish() -> None:
            if file is not None:
                file.close()
                system.move(part, f"{part.rpartition('/')[0]}/{name}")

        for batch in batches:
            labels = batch.column("metric").dictionary_encode()
            code, names = labels.indices.to_numpy(zero_copy_only=False), labels.dictionary.to_pylist()
            data = np.empty(batch.num_rows, kind)
            for c in kind.names:
                data[c] = batch.column(c).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(code[1:] != code[:-1]) + 1
            for i, j in zip([0, *edges], [*edges, len(code)], strict=True) if len(code) else []:
                if names[code[i]] != metric:
                    finish()
                    metric = names[code[i]]
                    system.create_dir(f"{root}/{metric_folder(metric)}", recursive=True)
                    part = f"{root}/{metric_folder(metric)}/.{uuid.uuid4().hex}"
                    file = system.open_output_stream(part)
                    file.write(_preamble(config, interval))
                file.write(data[i:j].tobytes())
        finish()
        yield from ()

    rows = rows.where("metric is not null")
    if interval:
        rows = rows.where(F.col("interval") == interval)
    rows = rows.select("metric", *kind.names).repartition("metric").sortWithinPartitions("metric", "t")
    rows.mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()


class _Part(InputPartition):
    def __init__(self, path: str, metric: str, first: int, count: int):
        self.path, self.metric, self.first, self.count = path, metric, first, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.interval, self.metric = options["path"], int(options.get("interval", 0)), options.get("metric")

    def partitions(self):
        system, root = _at(self.path)
        wanted, parts = metric_folder(self.metric) if self.metric else None, []
        for info in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda x: x.path):
            above, _, name = info.path.rpartition("/")
            metric = above.rpartition("/")[2]
            # whatever the ending
            if info.type != fs.FileType.File or name.partition(".")[0] != (str(self.interval) if self.interval else "raw") or wanted not in (None, metric):
                continue
            n = read_header(info.path, system)["records"]
            parts += [_Part(info.path, unquote(metric), i, min(RECORDS_PER_PART, n - i)) for i in range(0, n, RECORDS_PER_PART)]
        return parts or [_Part("", "", 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system = _at(self.path)[0]
        head = read_header(partition.path, system)
        kind = ROW if head["interval"] else POINT
        step = 100_000
        with system.open_input_file(partition.path) as f:
            f.seek(head["offset"] + partition.first * kind.itemsize)
            for i in range(0, partition.count, step):
                n = min(step, partition.count - i)
                data = np.frombuffer(f.read(n * kind.itemsize), kind)
                columns = {"metric": pa.array([partition.metric] * n)}
                place = pa.array(np.arange(partition.first + i, partition.first + i + n))
                if head["interval"]:
                    columns["interval"] = pa.array(np.full(n, head["interval"], np.int64))
                    columns |= {c: pa.array(np.ascontiguousarray(data[c]).astype(np.int64 if c in "tca" else float)) for c in ROW.names}
                    columns["pos"] = place
                else:
                    columns |= {"pos": place, "t": pa.array(np.ascontiguousarray(data["t"])), "v": pa.array(np.ascontiguousarray(data["v"]))}
                yield pa.RecordBatch.from_pydict(columns)


class RecordFiles(DataSource):
    """``spark.read.format("tidemark_records").option("interval", ns)``: the points (interval 0) or one level of all metrics under ``path``, or of one."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_records"

    def schema(self) -> str:
        if int(self.options.get("interval", 0)):
            return "metric string, interval bigint, t bigint, mn double, mx double, s double, c bigint, i double, a bigint, pos bigint"
        return "metric string, pos bigint, t bigint, v double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_records(spark: SparkSession, path: str, interval: int = 0, metric: str | None = None) -> DataFrame:
    spark.dataSource.register(RecordFiles)
    reader = spark.read.format("tidemark_records").option("interval", str(interval))
    if metric is not None:
        reader = reader.option("metric", metric)
    return reader.load(path)


def describe_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: metric, file, named_interval (what its name says, 0 for raw), the header's fields, entries, first and last time. Headers are read in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column("file").to_pylist():
                h = read_header(file)
                above, _, name = unquote(file).rpartition("/")
                stem = name.partition(".")[0]
                rows.append((unquote(above.rpartition("/")[2]), name, int(stem) if stem.isdigit() else 0, *(h[c] for c in ("interval", "interval_min", "interval_factor", "interval_max", "records", "first", "last"))))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k < 2 else pa.int64()) for k, x in enumerate(columns)], ["metric", "file", *_DESCRIBED])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*").load(path).select(F.col("_metadata.file_path").alias("file"))
    return files.mapInArrow(run, "metric string, file string, " + ", ".join(f"{c} bigint" for c in _DESCRIBED))


_DESCRIBED = ("named_interval", "interval", "interval_min", "interval_factor", "interval_max", "entries", "first", "last")
