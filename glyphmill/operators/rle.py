"""Run lengths: as windows over ordered rows, and the container's byte codecs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LITERAL = 0x8000
LONGEST = 0x7FFF


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, ``run``, value, ``start``, ``n``): maximal runs of equal values in order, numbered from 0 in each key."""
    w = Window.partitionBy(key).orderBy(*order)
    at = df.select(key, value, *order, F.row_number().over(w).alias("rn"), F.lag(value).over(w).alias("before"))
    changed = F.when((F.col("rn") == 1) | ~F.col(value).eqNullSafe(F.col("before")), 1).otherwise(0)
    numbered = at.withColumn("run", (F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long"))
    return numbered.groupBy(key, "run", value).agg((F.min("rn") - 1).cast("long").alias("start"), F.count("*").alias("n"))


def segments(run_rows: DataFrame, key: str) -> DataFrame:
    """(key, ``segment``, ``literal``, ``words``): runs of two or more, and neighbouring single values put together as literals."""
    w = Window.partitionBy(key).orderBy("run")
    single = F.col("n") == 1
    new = F.when(single & F.coalesce(F.lag("n").over(w) == 1, F.lit(False)), 0).otherwise(1)
    at = run_rows.withColumn("_new", new).withColumn("segment", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long"))
    return at.groupBy(key, "segment").agg((F.max("n") == 1).cast("int").alias("literal"), F.sum("n").alias("words"))


def _encode(values: np.ndarray, longest: int) -> bytes:
    if not len(values):
        return b""
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    lengths = np.diff(np.concatenate((starts, [len(values)])))
    out, held = [], []

    def literals() -> None:
        for i in range(0, len(held), longest):
            part = held[i : i + longest]
            out.append(np.array([longest + 1 | len(part), *part], values.dtype).tobytes())
        held.clear()

    for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        if n == 1:
            held.append(int(values[s]))
            continue
        literals()
        for i in range(0, n, longest):
            out.append(np.array([min(longest, n - i), values[s]], values.dtype).tobytes())
    literals()
    return b"".join(out)


def encode_words(words: np.ndarray) -> bytes:
    """Little-endian 16-bit counts and words: a count and one word for a run of two or more, a marked count and its words for others."""
    return _encode(np.asarray(words, "<u2"), LONGEST)


def encode_bytes(data: bytes) -> bytes:
    """The variant for fonts: counts are one byte and marked by their top bit."""
    return _encode(np.frombuffer(data, np.uint8), 0x7F)


def _decode(data: bytes, wanted: int, unit: str, flag: int) -> bytes:
    values = np.frombuffer(data[: len(data) // np.dtype(unit).itemsize * np.dtype(unit).itemsize], unit)
    out, at, have = [], 0, 0
    while have < wanted and at + 1 < len(values):
        n, literal = int(values[at]) & (flag - 1), int(values[at]) & flag
        part = values[at + 1 : at + 1 + n] if literal else np.full(n, values[at + 1], unit)
        at += 1 + (n if literal else 1)
        out.append(part[: wanted - have])
        have += len(out[-1])
    return np.concatenate(out).tobytes() if out else b""


def decode_words(data: bytes, wanted: int) -> np.ndarray:
    """At most ``wanted`` words; a cut-off end is left out."""
    return np.frombuffer(_decode(data, wanted, "<u2", LITERAL), "<u2")


def decode_bytes(data: bytes, wanted: int) -> bytes:
    """The variant for fonts: counts are one byte and marked by their top bit."""
    return _decode(data, wanted, "u1", 0x80)


def last_known(df: DataFrame, key: str | None, order: list[str], value: Column) -> Column:
    """The latest non-null ``value`` up to and with each row."""
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)
