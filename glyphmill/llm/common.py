"""What the operators share: the scratch folder, word splitting and hashing in numpy."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_scratch: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's path under ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is absent and Spark runs in one process (tests) a temporary folder is
    made; a cluster without the setting is refused, as its executors would not see that folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master or ""):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local_scratch:
            _local_scratch.append("file://" + tempfile.mkdtemp(prefix="scratch-"))
        root = _local_scratch[0]
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def files_for(spark: SparkSession, *, size: int = 0, rows: int | None = None) -> int:
    """How many files to write: of a small table of ``rows`` numbers one for each half million; else eight a core, or one for each 64 MB of what is read."""
    if rows is not None:
        return max(1, -(-rows // 500_000))
    return max(8 * spark.sparkContext.defaultParallelism, -(-size // (64 << 20)))


def materialize(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives lost executors.

    With ``files``, its last stage runs in at most so many tasks: where shuffle partitions are many
    and rows few, a file for each partition costs more than its contents (a file system without
    native calls starts several processes for each).
    """
    path = scratch_dir(df.sparkSession)
    (df.coalesce(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Hold the session's Arrow batches to ``size`` bytes (64 MB by default), as rows may hold long texts and each task has a batch on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, str(64 << 20)).rstrip("b")
    if not held.isdigit() or int(held) > size:
        spark.conf.set(key, str(size))


def release() -> None:
    """Give memory that was freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What clears the tables that an operator keeps in a worker from task to task.
kept: list[Callable[[], None]] = []


def forget() -> None:
    """Drop what other operators have kept in this worker, which lives on when their tasks are done."""
    for clear in kept:
        clear()
    release()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with memory given back after each batch: workers live on between tasks, and two or more share an executor.

    Unless it ``keeps`` them, tables kept by operators that ran before are dropped first.
    """

    def wrapped(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()

        def batches() -> Iterator[pa.RecordBatch]:
            for batch in it:
                yield batch
                release()

        yield from run(batches())
        release()

    return wrapped


def discard(df: DataFrame) -> None:
    """Delete the scratch files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column | str) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- words and shingles in numpy -----------------------------------------------------------------

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = bytes(c == 0x20 or 0x09 <= c <= 0x0D for c in range(256))
_ABOVE = np.arange(1, 257, dtype=np.uint64)  # a byte's value and one
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finalizer of splitmix64, elementwise."""
    x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    y = x >> _U(30)
    x ^= y
    x *= _U(0xBF58476D1CE4E5B9)
    np.right_shift(x, _U(27), out=y)
    x ^= y
    x *= _U(0x94D049BB133111EB)
    np.right_shift(x, _U(31), out=y)
    x ^= y
    return x


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least; kept between calls unless a very long text asks for more than a million."""
    global _powers, _inverses
    if len(_powers) >= n:
        return _powers, _inverses
    size = 1 << (n - 1).bit_length()
    out = []
    for base in (_BASE, _INV):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if size <= 1 << 20:
        _powers, _inverses = out
    return out[0], out[1]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and 64-bit hash of each run of non-space bytes in lower-cased UTF-8 ``data``."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    space = np.frombuffer(b"\1" + data.tobytes().translate(_SPACE) + b"\1", np.bool_)
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    powers, inverses = _grown(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    value = _ABOVE[data]
    value *= powers[: len(data)]
    np.cumsum(value, out=total[1:])
    return start, mix((total[end] - total[start]) * inverses[start] + (end - start).astype(np.uint64))


_ROLL = [_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3), _U(0x589965CC75374CC3)]


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; ``np.unique`` hashes them before it sorts, which takes several times as long."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x if new.all() else x[new]


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct 64-bit shingle hashes.

    Words are runs of bytes other than space and 09-0D after A-Z are lower-cased. A text of fewer
    words than ``width``, but not none, has its whole sequence as its one shingle; a null text or
    one without words has none.
    """
    for lo, hi in _blocks(texts):
        raw = [b"" if t is None else t.encode() for t in texts[lo:hi]]
        data = np.frombuffer(b" ".join(raw).translate(_LOWER), np.uint8)
        start, word = word_hashes(data)
        sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))
        n = len(word) - width + 1
        if n > 0:
            rolled = np.zeros(n, np.uint64)
            for j in range(width):  # a word's hash is mixed already
                rolled += word[j : j + n] * _ROLL[j % len(_ROLL)]
            rolled = mix(rolled, 77)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                yield distinct(rolled[a : b - width + 1])
            elif b > a:
                short = mix(word[a:b], 99)
                value = _U(b - a)
                for h in short:
                    value = mix(np.array([value ^ h], np.uint64), 5)[0]
                yield np.array([value], np.uint64)
            else:
                yield np.empty(0, np.uint64)


def _blocks(texts: list[str | None], chars: int = 100_000) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``chars`` characters, so that temporary arrays stay in cache."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= chars:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def bits_for(keys: int) -> int:
    """Positions of a bitmap for so many keys: sixteen for each, 2**20 to 2**26 (8 MB); a full one only lets more pass."""
    return 1 << min(26, max(20, (16 * keys - 1).bit_length()))


def bitmap_split(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``column`` may be among the one column of ``keys``, to be joined with them, and the others, which certainly aren't (nulls too).

    A bitmap of hashed positions goes to all executors, so that rows which can't match are not
    shuffled. ``keys`` is a written table: it is read twice.
    """
    bits = bits_for(keys.count())
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = dict(
        keys.select(cell(keys[keys.columns[0]]).alias("at"))
        .groupBy(F.expr("at div 64").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("b"))
        .collect()
    )
    held = df.sparkSession.createDataFrame([([words.get(i, 0) for i in range(bits // 64)],)], "bits array<long>").scalar()
    at = cell(df[column])
    inside = F.coalesce(df[column].isNotNull() & (F.getbit(F.get(held, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1), F.lit(False))
    return df.where(inside), df.where(~inside)
