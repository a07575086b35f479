"""Sums of products of wide vectors by group, as matrices that add up."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a packed matrix that one row carries, and bytes of matrices that a task holds before it sends them.
CHUNK, HELD = 128, 64 << 20


def packed_size(width: int) -> int:
    return width * (width + 1) // 2


def unpacked(entries: np.ndarray, width: int) -> np.ndarray:
    """The symmetric matrix of its upper triangle, row by row."""
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = entries[: packed_size(width)]
    return out + np.triu(out, 1).T


def _products(batches: Iterator[pa.RecordBatch], by: Sequence[str], width: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(by, chunk, v) of each group's sum of z z', packed; many rows become one matrix before anything is sent."""
    held: dict[tuple, np.ndarray] = {}
    upper = np.triu_indices(width)

    def sent() -> Iterator[pa.RecordBatch]:
        for key, total in held.items():
            entries = total[upper]
            entries = np.pad(entries, (0, -len(entries) % CHUNK)).reshape(-1, CHUNK)
            columns = [pa.array([k] * len(entries), schema.field(c).type) for c, k in zip(by, key)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range(len(entries)), pa.int32()), pa.array(list(entries), pa.list_(pa.float64()))], schema=schema)
        held.clear()

    for batch in batches:
        z = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(len(by))))):
            groups.setdefault(key, []).append(i)
        for key, rows in groups.items():
            own = z[rows]
            held[key] = held.get(key, 0.0) + own.T @ own
        if len(held) * width * width * 8 > HELD:
            yield from sent()
    yield from sent()


def gram_sums(df: DataFrame, by: Sequence[str], vector: str, width: int) -> DataFrame:
    """(by, v): for each group the sum of z z' over its vectors z, an array of ``width`` doubles without nulls, as the packed upper triangle.

    The plan has the same size for every ``width``. The array is padded with zeros to whole chunks; see ``unpacked``. Null keys form groups.
    """
    given = df.select(*by, vector)
    types = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    spec = ", ".join([*[f"`{c}` {types[c]}" for c in by], "chunk int", "v array<double>"])
    arrow = pa.schema([*[(c, _arrow(types[c])) for c in by], ("chunk", pa.int32()), ("v", pa.list_(pa.float64()))])
    parts = given.mapInArrow(partial(_products, by=list(by), width=width, schema=arrow), spec)
    sums = parts.groupBy(*by, "chunk").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(CHUNK)]).alias("v"))
    return sums.groupBy(*by).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "v"))), lambda c: c["v"])).alias("v"))


def _arrow(name: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "date": pa.date32(), "boolean": pa.bool_()}[name]
