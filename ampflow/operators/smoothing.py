"""The Kalman filter of positions over blocks of time, so that one device's history is smoothed in many tasks.

What a block does to the filter's state (value, variance) is a map of five numbers, and such maps compose
associatively: a block's map needs nothing of the blocks before it. The maps of a device, one small row a block, give
the state at each block's start; from there the blocks run by themselves. Values are taken relative to the block's first fix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampflow.operators.timeseries import DEVICE, KEY, PART, Clock, dealt
from ampflow.schema import Kalman

AXES = ("lat", "lon")
MAP = ("a", "b", "c", "e", "j")


def kalman_axis(values: list[float | None], x: float, p: float, noise: Kalman) -> tuple[list[float], float, float]:
    """A random walk seen through noise, from the state (x, p): the positions and the state after them.

    Rows without a value only predict.
    """
    out = []
    for z in values:
        p += noise.process
        if z is not None:
            gain = p / (p + noise.measurement)
            x += gain * (z - x)
            p *= 1 - gain
        out.append(x)
    return out, x, p


def maps(values: np.ndarray, noise: Kalman) -> np.ndarray:
    """The map of each row, one column each; NaN is a row that only predicts."""
    total = noise.process + noise.measurement
    gain, seen = noise.process / total, ~np.isnan(values)
    z = np.where(seen, values, 0.0)
    return np.stack(
        [
            np.where(seen, 1 - gain, 1.0),
            np.where(seen, gain * z, 0.0),
            np.where(seen, (1 - gain) * noise.process, noise.process),
            np.where(seen, z / total, 0.0),
            np.where(seen, 1 / total, 0.0),
        ]
    )


def composed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The maps of two stretches of rows as those of both."""
    a, b, c, e, j = first
    a2, b2, c2, e2, j2 = then
    d = 1 + c * j2
    return np.stack([a2 * a / d, a2 * (b + c * e2) / d + b2, a2 * a2 * c / d + c2, a * (e2 - j2 * b) / d + e, a * a * j2 / d + j])


def composed_all(rows: np.ndarray) -> np.ndarray:
    """One map of all columns, neighbours first."""
    while rows.shape[1] > 1:
        odd = rows[:, rows.shape[1] & ~1 :]
        rows = np.concatenate([composed(rows[:, 0 : rows.shape[1] & ~1 : 2], rows[:, 1::2]), odd], axis=1)
    return rows[:, 0]


def after(state: tuple[float, float], stretch: tuple[float, ...], origin: float) -> tuple[float, float]:
    """The state behind a stretch of rows whose values were taken relative to the origin."""
    (x, p), (a, b, c, e, j) = (state[0] - origin, state[1]), stretch
    d = 1 + p * j
    return a * (x + p * e) / d + b + origin, a * a * p / d + c


def composed_each(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One map for each group of neighbouring columns (starts: where the groups begin), all groups at once."""
    lengths = np.diff([*starts, rows.shape[1]])
    while rows.shape[1] > len(lengths):
        begins = np.cumsum(lengths) - lengths
        place = np.arange(rows.shape[1]) - np.repeat(begins, lengths)
        firsts = np.flatnonzero(place % 2 == 0)
        paired = place[firsts] + 1 < np.repeat(lengths, lengths)[firsts]
        kept = rows[:, firsts]
        kept[:, paired] = composed(kept[:, paired], rows[:, firsts[paired] + 1])
        rows, lengths = kept, (lengths + 1) // 2
    return rows


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(float)


def _starts(table: pa.Table, by: list[str]) -> np.ndarray:
    """Where the groups of sorted rows begin."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for c in by:
        column = table.column(c)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False) if n > 1 else False
    return np.flatnonzero(new)


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups, and where these begin. What is held is a batch and the group it breaks off in."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(pa.Table.from_batches([batch]), by)
        same = waiting and all(waiting[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in by)
        if same and len(starts) == 1:
            waiting.append(batch)
            continue
        table = pa.Table.from_batches([*waiting, batch.slice(0, starts[-1])])
        if table.num_rows:
            yield table.combine_chunks(), _starts(table, by)
        waiting = [batch.slice(starts[-1])]
    if waiting:
        table = pa.Table.from_batches(waiting).combine_chunks()
        yield table, _starts(table, by)


def _firsts(values: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each group's first value where at, else NaN."""
    found = np.minimum.reduceat(np.where(at, np.arange(len(at)), len(at)), starts)
    return np.append(values, np.nan)[found]


def smoothed(seen: DataFrame, own: list[str], fields: T.StructType, noise: Kalman, clock: Clock, block: int) -> DataFrame:
    """The rows of keyed positions (``__gps_lat``, ``__gps_lon``) with their smoothed ones; see ``gps.smooth``.

    Sorted batches hold many short blocks (block microseconds of a device), so these cost their rows and no group of their own. A
    task holds a batch and one block, and once the blocks' maps of one device.
    """
    placed = dealt(seen.select("*", (clock.us - F.pmod(clock.us, F.lit(block))).alias(PART)), [DEVICE, PART])
    blocks, names = [DEVICE, PART], [f"__{s}_{c}" for c in AXES for s in ("x", "p")]
    state = lambda columns: T.StructType([T.StructField(DEVICE, T.StringType()), T.StructField(PART, T.LongType()), *[T.StructField(c, T.DoubleType()) for c in columns]])
    mapped = state([f"{name}_{c}" for c in AXES for name in ("both", "first", *MAP)])

    def table_of(keys: list, columns: list[np.ndarray], kind: T.StructType) -> Iterator[pa.RecordBatch]:
        values = [*keys, *[pa.array(c, pa.float64()) for c in columns]]
        yield from pa.table(values, names=kind.names).combine_chunks().to_batches()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, blocks):
            values, lengths = {c: _column(table, f"__gps_{c}") for c in AXES}, np.diff([*starts, table.num_rows])
            both, out = ~np.isnan(values["lat"]) & ~np.isnan(values["lon"]), []
            for c in AXES:
                first = _firsts(values[c], ~np.isnan(values[c]), starts)
                moved = values[c] - np.repeat(np.nan_to_num(first), lengths)
                out += [_firsts(values[c], both, starts), first, *composed_each(maps(moved, noise), starts)]
            yield from table_of([table.column(c).take(pa.array(starts)) for c in blocks], out, mapped)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, [DEVICE]):
            out = {name: np.empty(table.num_rows) for name in names}
            for c in AXES:
                both, first = _column(table, f"both_{c}"), _column(table, f"first_{c}")
                begun = np.where(np.isnan(a := _firsts(both, ~np.isnan(both), starts)), np.nan_to_num(_firsts(first, ~np.isnan(first), starts)), a)
                stretches = list(zip(*[_column(table, f"{n}_{c}").tolist() for n in MAP]))
                origins = np.nan_to_num(first).tolist()
                for start, end, x in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], begun.tolist()):
                    now = (x, noise.initial)
                    for i in range(start, end):
                        out[f"__x_{c}"][i], out[f"__p_{c}"][i] = now
                        now = after(now, stretches[i], origins[i])
            yield from table_of([table.column(c) for c in blocks], [out[name] for name in names], state(names))

    short = placed.select(*blocks, KEY, *[f"__gps_{c}" for c in AXES]).sortWithinPartitions(*blocks, KEY).mapInArrow(summed, mapped)
    begun = short.repartition(DEVICE).sortWithinPartitions(*blocks).mapInArrow(carried, state(names))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, blocks):
            out = []
            for c in AXES:
                values, found = table.column(f"__gps_{c}").to_pylist(), []
                begins = [table.column(f"__{s}_{c}").take(pa.array(starts)).to_pylist() for s in ("x", "p")]
                for start, end, x, p in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], *begins):
                    found += kalman_axis(values[start:end], x, p, noise)[0]
                out.append(pa.array(found, pa.float64()))
            yield from pa.table([table.column(c) for c in own] + out, names=fields.names).combine_chunks().to_batches()

    # The rows stay where they were dealt, whichever way the states come to them.
    return placed.join(begun, blocks).sortWithinPartitions(*blocks, KEY).mapInArrow(finished, fields)
