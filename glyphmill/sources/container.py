"""The glyph container: header, chunks, reading with decoder state, rendering, and writing."""

from __future__ import annotations

import io
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glyphmill.operators.rle import decode_bytes, decode_words, encode_words

# fixed values: the file format
MAGIC, VERSION, MODE = 0xA8, 1, 2
START, END, LUT, FONT, CHARS, COLOURS, CHARS_RLE, COLOURS_RLE, FONT_RLE = 0x00, 0xFF, 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07
COLUMNS, ROWS, CELLS, CHUNK_WORDS = 80, 60, 4800, 1024
CHUNKS = "seq long, frame_idx int, type int, id int, length int, data binary"


@dataclass(frozen=True)
class Header:
    version: int
    duration: int
    mode: int
    columns: int
    rows: int
    x: int
    y: int


def header(duration: int = 6) -> bytes:
    return bytes([MAGIC, VERSION, duration & 0xFF, MODE, COLUMNS, ROWS, 0, 0])


def parse_header(data: bytes) -> Header:
    if len(data) < 8:
        raise ValueError("the file is shorter than its header")
    if data[0] != MAGIC:
        raise ValueError(f"not a glyph container: magic {data[0]:#x}")
    return Header(*data[1:8])


def chunk(kind: int, ident: int, data: bytes = b"") -> bytes:
    return struct.pack("<BBH", kind, ident, len(data)) + data


def chunks_of(read: Callable[[int], bytes]) -> Iterator[tuple[int, int | None, int, int, bytes]]:
    """(sequence, frame, type, id, data) of the chunks that ``read`` gives after the header, one at a time. A cut-off chunk header is an error, cut-off data isn't."""
    seq, frame, opened = 0, None, -1
    while head := read(4):
        if len(head) < 4:
            raise ValueError("the file ends inside a chunk header")
        kind, ident, length = struct.unpack("<BBH", head)
        if kind == START:
            opened += 1
            frame = opened
        yield seq, frame, kind, ident, read(length)
        if kind == END:
            frame = None
        seq += 1


def chunks(data: bytes) -> Iterator[tuple[int, int | None, int, int, bytes]]:
    """``chunks_of`` a whole file."""
    stream = io.BytesIO(data)
    parse_header(stream.read(8))
    return chunks_of(stream.read)


_ROW = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("frame_idx", pa.int32()), ("type", pa.int32()), ("id", pa.int32()), ("length", pa.int32()), ("data", pa.binary())])


def _rows(file: str, found: Iterator[tuple], at_once: int = 256) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for s, f, k, i, d in found:
        rows.append((file, s, f, k, i, len(d), d))
        if len(rows) == at_once:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of all containers below ``path``, on any store that Spark reads, with the file; files are read in parallel, each in order."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _rows(file, chunks(content.as_py()))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, {CHUNKS}")


@dataclass
class _File(InputPartition):
    path: str


class ContainerSource(DataSource):
    """``spark.read.format("glyph_container").load(path)``: the rows of ``read_chunks``, streamed chunk by chunk from files of any size.

    Register with ``spark.dataSource.register(ContainerSource)``. A folder's files are a partition each.
    """

    @classmethod
    def name(cls) -> str:
        return "glyph_container"

    def schema(self) -> str:
        return f"file string, {CHUNKS}"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _ContainerReader(self.options["path"])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else Path(re.sub("^file:", "", path)).absolute().as_uri())


class _ContainerReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_File]:
        files, inner = _store(self.path)
        if files.get_file_info(inner).type == fs.FileType.File:
            return [_File(self.path)]
        found = files.get_file_info(fs.FileSelector(inner))
        base = self.path.rstrip("/")
        return [_File(f"{base}/{x.base_name}") for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.base_name[0] not in "._"]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        files, inner = _store(partition.path)
        with files.open_input_stream(inner, buffer_size=1 << 20) as stream:
            parse_header(stream.read(8))
            yield from _rows(partition.path, chunks_of(stream.read))


class State:
    """Colour tables and fonts by slot, overwritten in stream order and carried from frame to frame."""

    def __init__(self) -> None:
        self.fg: list[np.ndarray | None] = [None, None]
        self.bg: list[np.ndarray | None] = [None, None]
        self.fonts: list[np.ndarray | None] = [None] * 4

    def take(self, kind: int, ident: int, data: bytes) -> None:
        if kind == LUT:
            table = np.frombuffer(data[: len(data) // 4 * 4], np.uint8).reshape(-1, 4)[:, 2::-1]
            if len(data) == 1024:
                (self.bg if ident >= 2 else self.fg)[ident & 1] = table
            elif len(data) == 2048:
                self.fg[ident & 1], self.bg[ident & 1] = table[:256], table[256:]
            elif len(data) == 128:
                full = np.zeros((256, 3), np.uint8)
                full[:32] = table
                self.fg, self.bg = [full, full], [full, full]
        elif kind == FONT and len(data) == 2048:
            self.fonts[ident & 3] = np.frombuffer(data, np.uint8).reshape(256, 8)
        elif kind == FONT_RLE:
            self.fonts[ident & 3] = np.frombuffer(decode_bytes(data, 2048).ljust(2048, b"\0"), np.uint8).reshape(256, 8)


def render(chars: np.ndarray, colours: np.ndarray, state: State) -> np.ndarray:
    """(480, 640, 3): each pixel is the foreground where the glyph's bit differs from the cell's invert bit.

    A missing table falls back to the other slot and a missing font to font 0; without any font a
    cell is black, without any table there is an error. Cells beyond the data are black.
    """
    if not any(t is not None for t in state.fg):
        raise ValueError("a frame without colour table")
    n = min(len(chars), len(colours), CELLS)
    chars, colours = chars[:n].astype(np.int64), colours[:n].astype(np.int64)
    pick = lambda slots, other: np.stack([s if s is not None else slots[1 - i] if slots[1 - i] is not None else other[i] if other[i] is not None else other[1 - i] for i, s in enumerate(slots)])
    fg = pick(state.fg, state.fg)
    bg = pick(state.bg, fg) if any(t is not None for t in state.bg) else fg
    none = np.zeros((256, 8), np.uint8)
    fonts = np.stack([f if f is not None else state.fonts[0] if state.fonts[0] is not None else none for f in state.fonts])
    glyph = fonts[chars >> 8 & 3, chars & 255]
    on = np.unpackbits(glyph, axis=1).astype(bool) ^ (chars >> 12 & 1).astype(bool)[:, None]
    a, b = fg[chars >> 10 & 1, colours >> 8], bg[chars >> 11 & 1, colours & 255]
    out = np.zeros((CELLS, 64, 3), np.uint8)
    out[:n] = np.where(on[:, :, None], a[:, None, :], b[:, None, :])
    if all(f is None for f in state.fonts):
        out[:] = 0
    return out.reshape(ROWS, COLUMNS, 8, 8, 3).swapaxes(1, 2).reshape(ROWS * 8, COLUMNS * 8, 3)


def frames_of(read: Callable[[int], bytes]) -> Iterator[np.ndarray]:
    """Rendered frames of one container, as it is read; a frame cut off by the end of the file is rendered too."""
    if parse_header(read(8)).mode != MODE:
        raise ValueError("only mode 2 is supported")
    state, chars, colours, opened = State(), [], [], False
    whole = lambda: render(*(np.concatenate(x) if x else np.empty(0, "<u2") for x in (chars, colours)), state)
    for _, frame, kind, ident, body in chunks_of(read):
        if kind == START:
            chars, colours, opened = [], [], True
        elif kind in (LUT, FONT, FONT_RLE):
            state.take(kind, ident, body)
        elif frame is not None and kind in (CHARS, COLOURS, CHARS_RLE, COLOURS_RLE):
            wanted = min(CHUNK_WORDS, CELLS - ident * CHUNK_WORDS)
            words = decode_words(body, wanted) if kind in (CHARS_RLE, COLOURS_RLE) else np.frombuffer(body[: len(body) // 2 * 2], "<u2")
            (chars if kind in (CHARS, CHARS_RLE) else colours).append(words)
        elif kind == END and opened:
            yield whole()
            opened = False
    if opened:
        yield whole()


def frames(data: bytes) -> Iterator[np.ndarray]:
    """``frames_of`` a whole file."""
    return frames_of(io.BytesIO(data).read)


def render_text(chars: np.ndarray, colours: np.ndarray, font: np.ndarray | None, table: np.ndarray, columns: int = COLUMNS, rows: int = ROWS) -> np.ndarray:
    """A frame of standard text: a byte for a cell's character, and one for its colours, high half foreground, low half background.

    Foregrounds are the table's entries 0-15, backgrounds 16-31. Cells beyond the data, and all
    without a font, are black.
    """
    n = 0 if font is None else min(len(chars), len(colours), columns * rows)
    out = np.zeros((columns * rows, 64, 3), np.uint8)
    if n:
        on = np.unpackbits(font[chars[:n]], axis=1).astype(bool)
        fg, bg = table[colours[:n] >> 4][:, :3], table[16 + (colours[:n] & 15)][:, :3]
        out[:n] = np.where(on[:, :, None], fg[:, None, :], bg[:, None, :])
    return out.reshape(rows, columns, 8, 8, 3).swapaxes(1, 2).reshape(rows * 8, columns * 8, 3)


def lut(colours: np.ndarray) -> bytes:
    """(256, 3) RGB to BGRA; entry 0 is transparent."""
    out = np.full((256, 4), 255, np.uint8)
    out[: len(colours), :3] = colours[:, ::-1]
    out[len(colours) :, :3] = 0
    out[0, 3] = 0
    return out.tobytes()


def frame_chunks(chars: np.ndarray, colours: np.ndarray, rle: bool = False, before: bytes = b"") -> bytes:
    """One frame: start, tables or fonts of its own, character and colour chunks in turn, end."""
    out = [chunk(START, 0), before]
    for ident in range(-(-CELLS // CHUNK_WORDS)):
        part = slice(ident * CHUNK_WORDS, (ident + 1) * CHUNK_WORDS)
        for plain, packed, words in ((CHARS, CHARS_RLE, chars[part]), (COLOURS, COLOURS_RLE, colours[part])):
            out.append(chunk(packed, ident, encode_words(words)) if rle else chunk(plain, ident, np.asarray(words, "<u2").tobytes()))
    return b"".join([*out, chunk(END, 0)])


def assignments_to_frames(assignments: DataFrame, rle: bool = False) -> DataFrame:
    """(``frame_idx``, ``body``) from cells (``frame_idx``, ``tile_idx``, ``char_word``, ``colour_word``): 4800 cells a frame, one task each."""

    def body(key: tuple, cells: pa.Table) -> pa.Table:
        cells = cells.sort_by("tile_idx")
        return pa.table({"frame_idx": pa.array([key[0].as_py()], pa.int32()), "body": [frame_chunks(cells.column("char_word").to_numpy(), cells.column("colour_word").to_numpy(), rle)]})

    return assignments.select(F.col("frame_idx").cast("int").alias("frame_idx"), "tile_idx", "char_word", "colour_word").groupBy("frame_idx").applyInArrow(body, "frame_idx int, body binary")


def rendered(spark: SparkSession, path: str) -> DataFrame:
    """(``file``, ``frame_idx``, ``png``) of all containers below ``path``, in parallel over files."""
    from glyphmill.sources.images import png

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for i, img in enumerate(frames(content.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([i], pa.int32()), pa.array([png(img)], pa.binary())], names=["file", "frame_idx", "png"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, frame_idx int, png binary")


def write_pngs(spark: SparkSession, path: str, folder: str, progress: Callable[[int, int, str], None] | None = None) -> int:
    """Write the frames of the containers below ``path`` to ``folder``, from the tasks that render them; the number of frames.

    A picture is written under a name of its own and renamed, so a task that runs again replaces it.
    ``progress`` is called with (done, all, message) for each frame when they are written.
    """
    shots = rendered(spark, path)
    several = spark.read.format("binaryFile").load(path).select("path").limit(2).count() > 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = _store(folder)
        store.create_dir(inner, recursive=True)
        for batch in it:
            names = []
            for file, i, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lead = re.sub(r"\W+", "_", file.rsplit("/", 1)[-1]) + "_" if several else ""
                names.append(f"{lead}reconstructed_{i:04d}.png")
                part = f"{inner}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, f"{inner}/{names[-1]}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string())], names=["file", "frame_idx", "name"])

    written = shots.mapInArrow(run, "file string, frame_idx int, name string").collect()  # names, not pictures
    for k, r in enumerate(sorted(written, key=lambda r: (r.file, r.frame_idx)), 1):
        if progress:
            progress(k, len(written), r.name)
    return len(written)
