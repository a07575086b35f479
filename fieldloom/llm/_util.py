"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.lineage import cut_lineage as cut_lineage

#: White space that separates words; the same six characters as ``bytes.split`` uses.
SPACE = "\\x20\\x09-\\x0D"


def size_words(text: Column) -> Column:
    """Number of words of a text, 0 for null; JVM-side."""
    squeezed = F.regexp_replace(text, f"[^{SPACE}]+", "w")
    return F.coalesce(F.length(F.regexp_replace(squeezed, f"[{SPACE}]+", "")), F.lit(0)).cast("long")


def scratch(names: list[str], *wanted: str) -> list[str]:
    """Column names for intermediate results that clash with none of ``names``."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, for a shuffled join.

    ``df`` should be cheap to count, such as one that lineage has been cut for.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread_join(left: DataFrame, right: DataFrame, on: str, by: str, parts: int = 16) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each ``on``; rows of ``left`` that share one are dealt out by ``by``.

    So a key of a large share of the rows takes ``parts`` tasks; ``right`` is copied as often.
    """
    (salt,) = scratch([*left.columns, *right.columns], "salt")
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(copies, [on, salt]).drop(salt)


def slices(batches: Iterator[pa.Array], size: int = 2 << 20) -> Iterator[pa.Array]:
    """The batches in slices of about ``size`` bytes, one row at least, so that a task's memory does not follow the batch size."""
    for batch in batches:
        step = max(1, int(len(batch) * size / max(1, batch.nbytes)))
        for start in range(0, len(batch), step):
            yield batch.slice(start, step)
    give_back()


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return the memory that Arrow and the C library have freed but hold, as a worker lives on after a task."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


_KEPT: dict[str, object] = {}


def kept_in_worker(key: str, make):
    """What ``make`` gave for ``key`` in this Python worker. Workers serve many tasks, so an object's caches outlive a task.

    A worker keeps the latest two objects. ``key`` is made on the driver and names one object for good.
    """
    if key not in _KEPT:
        while len(_KEPT) > 1:
            del _KEPT[next(iter(_KEPT))]
        _KEPT[key] = make()
    return _KEPT[key]
