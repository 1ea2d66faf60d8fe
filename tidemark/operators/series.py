"""The current readings of each metric as an ordered stream, without ever holding a metric in one place.

The rows are range-partitioned by (metric, t), so that a metric with a third of all rows is spread over as many
tasks as its size asks for, while all versions of one reading share a task. Each task then walks its sorted
slice batch by batch. What a task can't decide at the two ends of its slice it emits, and a later step over
those few rows decides it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values beyond this are never readings.
ABSURD = 1e20


def usable(v: np.ndarray) -> np.ndarray:
    return np.isfinite(v) & (np.abs(v) <= ABSURD)


def ordered_versions(points: DataFrame) -> DataFrame:
    """All versions with t > 0 and a metric, range-partitioned and sorted by (metric, t, arrived_at, point_id)."""
    return (
        points.where("t > 0 and metric is not null")
        .select("metric", "t", "v", "arrived_at", "point_id")
        .repartitionByRange("metric", "t")
        .sortWithinPartitions("metric", "t", "arrived_at", "point_id")
        .select("metric", "t", "v")
    )


@dataclass
class Block:
    """Consecutive current readings of a task's slice; ``code`` indexes ``names`` and never decreases."""

    names: list[str]
    code: np.ndarray
    t: np.ndarray
    v: np.ndarray


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Current readings (the last version of each (metric, t), if its v isn't null) from sorted versions."""
    held = None  # the last version seen: its reading may have later ones in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        table = table.combine_chunks()
        held = table.slice(table.num_rows - 1)
        yield from _block(table, table.num_rows - 1)
    if held is not None:
        yield from _block(held.combine_chunks(), 1)


def _block(table: pa.Table, count: int) -> Iterator[Block]:
    names = table.column("metric").combine_chunks().dictionary_encode()
    if isinstance(names, pa.ChunkedArray):
        names = names.chunk(0)
    code = names.indices.to_numpy(zero_copy_only=False)
    t = table.column("t").to_numpy()
    last = np.ones(len(t), bool)
    last[:-1] = (code[1:] != code[:-1]) | (t[1:] != t[:-1])
    keep = last & ~pc.is_null(table.column("v")).to_numpy(zero_copy_only=False)
    keep[count:] = False
    if keep.any():
        v = table.column("v").to_numpy()
        yield Block(names.dictionary.to_pylist(), code[keep], t[keep], v[keep])


@dataclass
class Stretch:
    """Consecutive readings of one metric. Rows ``[lo, hi)`` are to be decided, the others are their context."""

    metric: str
    t: np.ndarray
    v: np.ndarray
    lo: int
    hi: int
    open_start: bool  # earlier readings may lie in another task
    open_end: bool


def stretches(batches: Iterator[pa.RecordBatch], halo: int, size: int = 1 << 16) -> Iterator[Stretch]:
    """Cuts a task's slice into stretches of at most about ``size`` readings with ``halo`` readings of context.

    Memory is bounded by ``size`` whatever the length of a metric. Only the first and the last metric of the
    slice are open at an end; of these the outermost readings are part of ``[lo, hi)`` without full context.
    """
    name, first = None, True
    ts: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    have, done, begun_open = 0, 0, False

    def cut(final: bool, open_end: bool) -> Iterator[Stretch]:
        nonlocal ts, vs, have, done, begun_open
        t, v = np.concatenate(ts), np.concatenate(vs)
        hi = len(t) if final else len(t) - halo
        if hi > done:
            yield Stretch(name, t, v, done, hi, begun_open, open_end and final)
            if not final:
                keep = max(0, hi - halo)
                ts, vs, have, done, begun_open = [t[keep:]], [v[keep:]], len(t) - keep, hi - keep, False

    for b in blocks(batches):
        edges = np.flatnonzero(b.code[1:] != b.code[:-1]) + 1
        for i, j in zip([0, *edges], [*edges, len(b.code)], strict=True):
            metric = b.names[b.code[i]]
            if metric != name:
                if name is not None:
                    yield from cut(True, False)
                name, ts, vs, have, done, begun_open = metric, [], [], 0, 0, first
                first = False
            ts.append(b.t[i:j])
            vs.append(b.v[i:j])
            have += j - i
            if have - done >= size:
                yield from cut(False, False)
    if name is not None:
        yield from cut(True, True)


def is_usable(v: str = "v"):
    """The same test as a Column: finite and within ±1e20; false for null."""
    return F.coalesce(F.abs(F.col(v)) <= F.lit(ABSURD), F.lit(False)) & ~F.isnan(v)
