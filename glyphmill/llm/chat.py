"""Chat formatting by columnar byte assembly, and its exact reading back.

A turn becomes ``### Role: text</turn>\\n``. In roles and texts a backslash goes before every
backslash, before ``###`` and before ``</turn>`` (in roles before a colon and a line end too), so no
control string is left inside and dropping each first backslash gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import bounded_batches, lean

_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|[:\n]")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
END = b"</turn>\n"
FLUSH = 4 << 20


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def header(role: str) -> str:
    """Known roles have their name with a capital; any other stands after an @, escaped."""
    name = {"system": "System", "user": "User", "assistant": "Assistant"}.get(role)
    return f"### {name or '@' + _ROLE.sub(lambda m: chr(92) + m[0], role)}: "


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end are the escaped content's places in ``formatted``."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = unescape(m[1][1:]) if m[1].startswith("@") else m[1].lower()
        out.append((role, unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def assemble(roles: list[str], texts: list[str]) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one preallocated buffer: the bytes, each turn's bounds, and the start and end of its content.

    Segment lengths give cumulative offsets; numpy scatter indices then copy all headers, contents
    and ends to their places at once.
    """
    parts = [[header(r).encode() for r in roles], [escape(t).encode() for t in texts], [END] * len(roles)]
    lengths = np.array([[len(x) for x in p] for p in parts], np.int64).reshape(3, -1).T
    starts = np.concatenate(([0], np.cumsum(lengths.ravel())))
    total = int(starts[-1])
    buffer = pa.allocate_buffer(total, resizable=False)
    out = np.frombuffer(buffer, np.uint8)
    for k, p in enumerate(parts):
        data = np.frombuffer(b"".join(p), np.uint8)
        size = lengths[:, k]
        before = np.concatenate(([0], np.cumsum(size)))[:-1]
        out[np.repeat(starts[k:-1:3] - before, size) + np.arange(len(data))] = data
    return buffer, starts[::3], starts[1:-1:3], starts[2:-1:3]


def _rows(it: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple]:
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, rows).columns), strict=True)


def format_chats(turns: DataFrame) -> DataFrame:
    """(``conv_id``, ``n_turns``, ``formatted``, ``loss_spans``) for each conversation of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``).

    Rows go by turn, then role, then text; repeated rows are turns of their own. Null roles and texts
    are empty strings; a null conv_id is a conversation like others. ``loss_spans`` are the (start,
    end) of the assistant's contents in bytes of ``formatted``. Other columns are ignored and an empty
    table gives no rows. Rows are sorted within partitions and streamed, a conversation at a time.
    """
    bounded_batches(turns.sparkSession)
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.list_(pa.int64())))])

    def whole(ids: list, roles: list[str], texts: list[str]) -> pa.RecordBatch:
        """Rows of whole conversations, in order."""
        buffer, bounds, content, end = assemble(roles, texts)
        first = np.array([i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]] + [len(ids)])
        cut = bounds[first].astype(np.int32)
        strings = pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(cut), buffer])
        spans = [[[int(content[i] - bounds[a]), int(end[i] - bounds[a])] for i in range(a, b) if roles[i] == "assistant"] for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([ids[a] for a in first[:-1]], pa.int64()), pa.array(np.diff(first), pa.int64()), strings, pa.array(spans, schema.field(3).type)], schema=schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for row in _rows(it):
            if size >= FLUSH and row[0] != held[0][-1]:
                yield whole(*held)
                held, size = ([], [], []), 0
            for x, v in zip(held, row, strict=True):
                x.append(v)
            size += len(row[2])
        if held[0]:
            yield whole(*held)

    return t.mapInArrow(lean(run), "conv_id long, n_turns long, formatted string, loss_spans array<array<long>>")


def read_chats(formatted: DataFrame) -> DataFrame:
    """Digests read back from ``format_chats``' rows: of roles and texts by turn, and of what the loss spans cover, unescaped."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, text, spans in _rows(it):
            turns, all_, loss, chars = parse(text), hashlib.sha256(), hashlib.sha256(), 0
            for role, said, _, _ in turns:
                all_.update(f"{role}\n{said}\n".encode())
            data = text.encode()
            for a, b in spans:
                said = unescape(data[a:b].decode())
                chars += len(said)
                loss.update(said.encode())
            out.append((conv, len(turns), all_.hexdigest(), chars, loss.hexdigest(), len(text)))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
