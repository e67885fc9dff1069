"""Packing of token sequences: first-fit decreasing on a tournament tree, in randomised groups of documents.

A document's ids and an end id are cut at every 2048th; full pieces are sequences by themselves and
only the remainder, shorter than a sequence, is packed. The first bin that has room is found by
descending a tournament tree of capacities, in log n steps. Groups are random by a piece's place,
whatever its document, and hold about as many pieces whatever the input, so each is packed in one
bounded task; full pieces, whose sequence is given where they are made, only pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import bounded_batches, lean
from glyphmill.llm.tokens import byte_bpe, vocabulary_path

GROUP = 2000


class Tournament:
    """Capacities of ``n`` bins; each inner node holds the largest below it."""

    def __init__(self, n: int, capacity: int) -> None:
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size``, and the room that it had."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at = 2 * at if tree[2 * at] >= size else 2 * at + 1
        room = tree[at]
        tree[at] = room - size
        found = at - self.leaves
        while at > 1:
            at //= 2
            best = tree[2 * at] if tree[2 * at] >= tree[2 * at + 1] else tree[2 * at + 1]
            if tree[at] == best:
                break
            tree[at] = best
        return found, room


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; equal sizes keep their order."""
    tree = Tournament(len(sizes), capacity)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        bins[i], room = tree.put(int(sizes[i]))
        offsets[i] = capacity - room
    return bins, offsets


_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long"


def _pieces(path: str, end_id: int, capacity: int, groups: int):
    """For mapInArrow over (doc_id, text): pieces, each with a group; full ones in a sequence of their own."""
    numbers = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "pack_group")
    schema = pa.schema([pa.field(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids", *numbers[3:])])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, full = byte_bpe(path), 0
        part = TaskContext.get().partitionId()
        deal = np.random.default_rng(part)
        for whole in it:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: list[tuple] = []
                ids, bounds = bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()])
                for k, doc in enumerate(batch.column(0).to_pylist()):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(own), capacity):
                        n = min(capacity, len(own) - s)
                        # sequences of full pieces have odd numbers, by task and place in it
                        place = (2 * ((part << 36) + full) + 1, 0) if n == capacity else (None, None)
                        full += n == capacity
                        out.append((doc, s, n, own[s : s + n].tobytes(), len(own), *place))
                if out:
                    columns = [*zip(*out, strict=True), deal.integers(0, groups, len(out))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def pack(docs: DataFrame, *, path: str | None = None, end_id: int = 1, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Pieces (``doc_id``, ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset``) of ``docs`` (``doc_id``, ``text``).

    ``ids`` are little-endian unsigned 32-bit, those of the ``tokenizers`` file at ``path`` without
    special tokens added, then ``end_id``; ``doc_tokens`` counts it. Sequences hold at most
    ``capacity`` ids, without gaps from offset 0. A null or empty text is its end id alone; repeated
    rows are packed each; a null doc_id is packed as the others; an empty table gives no rows. Equal
    remainders of a group go in the order of doc_id.
    """
    path = path or vocabulary_path()
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, math.ceil((n + size / (4 * capacity)) / group))  # an id has about four bytes
    pieces = rows.mapInArrow(lean(_pieces(path, end_id, capacity, groups), keeps=True), f"{_PIECE}, sequence_id long, offset long, pack_group long")

    def pack_group(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["pack_group"])
        given = pc.is_valid(rows.column("sequence_id"))
        rest = rows.filter(pc.invert(given)).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(rest.column("length").to_numpy(), capacity)
        sequence = 2 * (bins * groups + key[0].as_py())
        rest = rest.set_column(5, "sequence_id", pa.array(sequence, pa.int64())).set_column(6, "offset", pa.array(offsets, pa.int64()))
        return pa.concat_tables([rows.filter(given), rest])

    return pieces.groupBy("pack_group").applyInArrow(pack_group, f"{_PIECE}, sequence_id long, offset long")
