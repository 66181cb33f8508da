"""Ordered walks over groups: rows are dealt by key and sorted, and each task goes through its groups batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


#: Parts of a group that are put together while it is held.
PARTS = 50


def same_keys(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Equality of keys in which null equals null."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in left))


def join_keys(rows: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other`` on ``on``, where null keys are keys too; the columns of ``rows``, then the others of ``other``."""
    names = {k: f"__key_{i}" for i, k in enumerate(on)}
    right = other.select(*(F.col(k).alias(n) for k, n in names.items()), *(c for c in other.columns if c not in names))
    return rows.join(right, same_keys({k: F.col(k) for k in on}, {k: F.col(n) for k, n in names.items()}), how).drop(*names.values())


def _changes(column: pa.Array) -> np.ndarray:
    """Where a key differs from the one before; null equals null, and NaN equals NaN."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_floating(column.type):
        values = pc.fill_null(column, 0.0).cast(pa.float64()).to_numpy(zero_copy_only=False)
        values = np.where(values == 0, 0.0, values).view(np.int64)
    else:
        values = (pc.fill_null(column, pa.scalar("" if pa.types.is_string(column.type) else 0).cast(column.type)) if column.null_count else column).to_numpy(zero_copy_only=False)
    return (values[1:] != values[:-1]) | (valid[1:] != valid[:-1])


def _plain(column: pa.Array) -> np.ndarray:
    """A column as an array: whole numbers stay whole, as objects where some are null."""
    if column.null_count and not pa.types.is_floating(column.type):
        out = np.empty(len(column), object)
        out[:] = column.to_pylist()
        return out
    return column.to_numpy(zero_copy_only=False)


def over_groups(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str], solve: Callable[[dict], tuple], schema: str, nullable: Sequence[str] = ()) -> DataFrame:
    """``solve`` of each group of ``keys``: it gets ``columns`` as arrays in the given order and gives the arrays of ``schema``.

    Null keys are keys. Rows without a value in one of the other columns take no part, but for the columns that are
    ``nullable``: there a missing float is NaN and anything else None. Whole numbers never pass through floats.
    """
    keys, columns = list(keys), list(dict.fromkeys([*columns, *order]))
    own = [c for c in columns if c not in keys]
    needed = [c for c in own if c not in nullable]
    dealt = df.select(*keys, *own).dropna(subset=needed) if needed else df.select(*keys, *own)
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, *order)
    target = df.sparkSession.createDataFrame([], schema).schema
    kinds = to_arrow_schema(target)

    def solved(groups: list[dict]) -> pa.RecordBatch:
        found = [solve(g) for g in groups]
        arrays = [np.concatenate([f[i] for f in found]) for i in range(len(kinds))]
        return pa.RecordBatch.from_arrays([pa.array(a, f.type, from_pandas=True) for a, f in zip(arrays, kinds, strict=True)], schema=kinds)

    def run(batches):
        held: list[dict] = []  # the parts of the group that may go on in the next batch
        large = 0  # how many of them are made of PARTS each, large enough for their memory to go back when they do

        def joined(parts: list[dict]) -> dict:
            """Parts as one, given up column by column; a key is one value."""
            if len(parts) == 1:
                return parts[0]
            whole = {k: np.broadcast_to(parts[0][k][:1].copy(), sum(len(h[k]) for h in parts)) for k in keys}
            return whole | {c: np.concatenate([h.pop(c) for h in parts]) for c in own}

        def kept(part: dict) -> dict:
            """A part apart from its batch, so that the batch can go."""
            return {c: np.broadcast_to(a[:1].copy(), len(a)) if c in keys else a.copy() for c, a in part.items()}

        last = None  # the keys of the row before, as a row
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.select(keys)
            starts = np.flatnonzero(np.r_[True, reduce(np.logical_or, (_changes(key.column(i)) for i in range(len(keys))))] if len(keys) else np.arange(batch.num_rows) == 0)
            arrays = {c: _plain(batch.column(c)) for c in batch.schema.names}
            parts = [{c: a[s:e] for c, a in arrays.items()} for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True)]
            both = pa.Table.from_batches([last, key.slice(0, 1)]).combine_chunks() if last is not None else None
            goes_on = both is not None and not any(_changes(both.column(i).combine_chunks()).any() for i in range(len(keys)))
            done = []
            if held and not goes_on:
                done.append(joined(held))
                held, large = [], 0
            held.append(kept(parts[0]))
            if len(held) - large == PARTS:
                held[large:] = [joined(held[large:])]
                large += 1
            if len(parts) > 1:
                done += [joined(held), *parts[1:-1]]
                held, large = [kept(parts[-1])], 0
            if done:
                yield solved(done)
            last = key.slice(batch.num_rows - 1, 1)
        if held:
            yield solved([joined(held)])

    return dealt.mapInArrow(run, target)
