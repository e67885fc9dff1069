"""Encoding plans: one palette and font set for all frames (global), fonts by frame (hybrid), or both by frame (frame).

A frame is encoded inside one task from its image: nothing of a frame is shuffled. What all frames
share is fitted before, from rows that each task has counted for its frames: distinct colours, and
distinct patterns with their counts. Models are small arrays sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import patterns as P
from glyphmill.operators import fit
from glyphmill.operators import frames as K
from glyphmill.operators import glyphs as G
from glyphmill.operators import palettes as C
from glyphmill.sources import container
from glyphmill.sources import images as I

GLOBAL_GLYPHS, FRAME_GLYPHS = 1024, 512
CELLS = 4800


@dataclass(frozen=True)
class Config:
    mode: str = "global"
    duration: int = 6
    rle: bool = False
    coherence: int = 0
    denoise: int = 0
    high_quality: bool = False
    crop: bool = False
    split_palette: bool = False
    four_luts: bool = False

    def __post_init__(self) -> None:
        if self.mode not in ("global", "hybrid", "frame"):
            raise ValueError(f"no mode {self.mode}")
        if self.mode == "frame" and self.four_luts:
            raise ValueError("four colour tables cannot be used where each frame has its own")


@dataclass(frozen=True)
class Tables:
    """Colour tables (256, 3) of each role: one, or two."""

    fg: list[np.ndarray]
    bg: list[np.ndarray]

    def oklab(self, all_of_them: bool) -> tuple[np.ndarray, np.ndarray]:
        """What glyphs are scored with: without entry 0, of both tables or of the first."""
        use = slice(None) if all_of_them else slice(1)
        return tuple(fit.oklab(np.concatenate([t[1:] for t in role[use]])) for role in (self.fg, self.bg))


def per_frame(frames: DataFrame, crop: bool, work: Callable[[int, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Rows that ``work`` makes of each frame's number and tiles (4800, 64, 3); an image at a time in each task."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            for r in part.itertuples():
                px = I.cut(I.canvas(I.to_rgb(r.data, r.height, r.width, r.n_channels), crop)).reshape(-1, 64, 3)
                yield work(r.frame_idx, px)

    return frames.select("frame_idx", "height", "width", "n_channels", "data").mapInPandas(run, schema)


# -- what all frames share -------------------------------------------------------------------------


def native_colours(frames: DataFrame) -> DataFrame:
    """(``r``, ``g``, ``b``, ``cnt``) of every fourth pixel of each image in its own size, counted by image before the shuffle."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            for r in part.itertuples():
                px = I.to_rgb(r.data, r.height, r.width, r.n_channels).reshape(-1, 3)[::4]
                found, n = np.unique(px, axis=0, return_counts=True)
                yield pd.DataFrame({"r": found[:, 0].astype(int), "g": found[:, 1].astype(int), "b": found[:, 2].astype(int), "cnt": n})

    counted = frames.select("height", "width", "n_channels", "data").mapInPandas(run, "r int, g int, b int, cnt long")
    return counted.groupBy("r", "g", "b").agg(F.sum("cnt").alias("cnt"))


def role_colours(frames: DataFrame, crop: bool) -> DataFrame:
    """(``role``, ``r``, ``g``, ``b``) distinct: the mean colours of the tiles' sides, cut to bytes."""

    def work(_: int, px: np.ndarray) -> pd.DataFrame:
        c = K.cells_of(px)
        parts = [np.unique(x.astype(np.uint8), axis=0).astype(int) for x in (c.fg, c.bg)]
        rows = np.concatenate(parts)
        return pd.DataFrame({"role": np.repeat(["FG", "BG"], [len(p) for p in parts]), "r": rows[:, 0], "g": rows[:, 1], "b": rows[:, 2]})

    return per_frame(frames, crop, work, "role string, r int, g int, b int").distinct()


def shared_tables(frames: DataFrame, config: Config) -> Tables:
    if not (config.split_palette or config.four_luts):
        one = C.table_of(C.clustered(native_colours(frames), C.COLOURS, weight="cnt"))
        return Tables([one], [one])
    colours = role_colours(frames, config.crop).persist()
    sides = [colours.where(F.col("role") == role).select("r", "g", "b") for role in ("FG", "BG")]
    out = Tables(*[C.two_tables(s) if config.four_luts else [C.table_of(C.clustered(s, C.COLOURS))] for s in sides])
    colours.unpersist()
    return out


def pattern_stats(frames: DataFrame, crop: bool, colours: bool = False) -> DataFrame:
    """(``pattern``, ``cnt``, ``first``, and ``mean``): distinct canonical patterns, their tiles, their first place, and Oklab of the mean colours by position.

    Each frame's rows are summed in its task; sums meet by pattern.
    """

    def work(frame: int, px: np.ndarray) -> pd.DataFrame:
        pattern, n, first, sums = fit.frame_stats(px, K.cells_of(px).raw)
        out = pd.DataFrame({"pattern": pattern, "cnt": n, "first": frame * CELLS + first})
        return out.assign(sums=list(sums.reshape(-1, 192))) if colours else out

    schema = "pattern long, cnt long, first long" + ", sums array<double>" * colours
    rows = per_frame(frames, crop, work, schema)
    counts = rows.groupBy("pattern").agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first"), *([F.array(*[F.sum(F.col("sums")[i]) for i in range(192)]).alias("sums")] if colours else []))
    if not colours:
        return counts

    def oklab(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            means = np.stack(part["sums"].to_numpy()).reshape(-1, 64, 3) / part["cnt"].to_numpy()[:, None, None] if len(part) else np.zeros((0, 64, 3))
            yield part[["pattern", "cnt", "first"]].assign(mean=list(fit.oklab(means).reshape(-1, 192)))

    return counts.mapInPandas(oklab, "pattern long, cnt long, first long, mean array<double>")


def global_glyphs(frames: DataFrame, tables: Tables, config: Config, n: int = GLOBAL_GLYPHS) -> np.ndarray:
    """``n`` glyphs for all frames: by first sight if they are fewer, else medoids of clusters."""
    stats = pattern_stats(frames, config.crop, config.high_quality).persist()
    has_zero = stats.where("pattern = 0").limit(1).count()
    if (total := stats.count()) + 1 - has_zero < n:
        rows = stats.select("first", "pattern").orderBy("first").collect()
        out = fit.zero_first(fit.padded(fit.with_zero(np.array([r.pattern for r in rows], np.int64)), n))
    elif config.high_quality:
        out = G.perceptual_glyphs(stats, n, *tables.oklab(True))
    else:
        zero = frames.sparkSession.range(1 - has_zero).select(F.lit(0).cast("long").alias("pattern"), F.lit(1).cast("long").alias("cnt"))
        one = stats.select("pattern", F.lit(1).cast("long").alias("cnt")).unionByName(zero)  # each pattern counts once
        found = {r.first: r.pattern for r in G.glyph_medoids(one, n).collect()} if total + 1 - has_zero > n else dict(enumerate(r.pattern for r in one.collect()))
        out = fit.zero_first(fit.with_extremes(np.array([found.get(k, 0) for k in range(n)], np.int64)))
    stats.unpersist()
    return out


def reserved_glyphs(cells: DataFrame, n: int) -> DataFrame:
    """(``pattern``, ``frames``): the patterns of more than one frame, or if they are more than ``n`` the medoids of ``n`` clusters of all, weighted by frames."""
    found = G.coherent(cells.select("frame_idx", P.canonical("raw").alias("pattern")), "frame_idx", "pattern")
    return found.join(G.glyph_medoids(found, n, "frames"), "pattern").select("pattern", "frames")


def coherent_glyphs(frames: DataFrame, config: Config) -> np.ndarray:
    """Exactly ``config.coherence`` glyphs that frames have in common, those of more frames first; with the extremes if clustered."""

    def work(frame: int, px: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"frame_idx": frame, "raw": np.unique(K.canonical(K.cells_of(px).raw))})

    seen = per_frame(frames, config.crop, work, "frame_idx int, raw long").persist()
    recurring = G.coherent(seen, "frame_idx", "raw").count()
    rows = reserved_glyphs(seen, config.coherence).collect()
    seen.unpersist()
    found = np.array([r.pattern for r in sorted(rows, key=lambda r: (-r.frames, r.pattern))], np.int64)
    return fit.padded(fit.with_extremes(found) if recurring > config.coherence else found, config.coherence)


# -- one frame -------------------------------------------------------------------------------------


def frame_tables(px: np.ndarray, config: Config) -> Tables:
    """Tables from all pixels of one scaled frame, or from its tiles' sides."""
    if config.split_palette:
        c = K.cells_of(px)
        return Tables(*[[fit.palette_of(np.unique(x.astype(np.uint8), axis=0))] for x in (c.fg, c.bg)])
    colours, n = np.unique(px.reshape(-1, 3), axis=0, return_counts=True)
    one = fit.palette_of(colours, n)
    return Tables([one], [one])


def frame_glyphs(px: np.ndarray, tables: Tables, config: Config, reserved: np.ndarray | None, n: int = FRAME_GLYPHS) -> np.ndarray:
    """``n`` glyphs of one frame; reserved ones have the first places and the frame's others the rest. The empty glyph is first."""
    pattern, counts, _, sums = fit.frame_stats(px, K.cells_of(px).raw)
    if reserved is not None and len(reserved) >= n:
        out = reserved[:n]
    elif reserved is not None:
        own = pattern[~np.isin(pattern, reserved)]
        own = own if (reserved == 0).any() else fit.with_zero(own)
        out = np.concatenate([reserved, fit.structure_glyphs(own, n - len(reserved))])
    elif config.high_quality and len(fit.with_zero(pattern)) >= n:
        out = fit.perceptual_glyphs(pattern, counts, fit.oklab(sums / counts[:, None, None]), n, *tables.oklab(False))
    else:
        out = fit.structure_glyphs(fit.with_zero(pattern), n)
    return fit.zero_first(out)


def denoised(glyphs: np.ndarray, config: Config) -> np.ndarray:
    """The empty glyph stays empty, so it is still the first."""
    return np.array([G.denoise(int(p), config.denoise) for p in glyphs], np.int64) if config.denoise else glyphs


def font_chunks(glyphs: np.ndarray, bank: int = 0) -> bytes:
    data = glyphs.astype(">i8").tobytes()
    return b"".join(container.chunk(container.FONT, (bank + i) & 3, data[2048 * i : 2048 * i + 2048]) for i in range(len(glyphs) // 256))


def table_chunks(tables: Tables, slot: int = 0) -> bytes:
    """Foreground tables from ``slot``, then background ones two further."""
    both = [*((slot + i, t) for i, t in enumerate(tables.fg)), *((slot + 2 + i, t) for i, t in enumerate(tables.bg))]
    return b"".join(container.chunk(container.LUT, at, container.lut(t)) for at, t in both)


def frame_body(px: np.ndarray, glyphs: np.ndarray, tables: Tables, config: Config, frame: int = 0, before: bytes = b"") -> bytes:
    """One frame's chunks. Frames with fonts of their own take banks 0-1 and 2-3 in turn, and with tables of their own tables 0 and 1."""
    got = (K.assign_best if config.high_quality else K.assign)(px, glyphs, tables.fg, tables.bg)
    glyph, fg, bg, invert, fg_lut, bg_lut = got.T
    font = glyph // 256
    if config.mode != "global":
        font = (font + frame % 2 * 2) & 3
    if config.mode == "frame":
        fg_lut = bg_lut = np.full(len(glyph), frame % 2)
    chars = glyph % 256 | font << 8 | fg_lut << 10 | bg_lut << 11 | invert << 12
    return container.frame_chunks(chars, fg << 8 | bg, config.rle, before)


# -- the plan --------------------------------------------------------------------------------------


def encoded(spark: SparkSession, folder: str, config: Config = Config(), glyphs: DataFrame | np.ndarray | None = None) -> tuple[bytes, DataFrame]:
    """What comes before the frames, and (``frame_idx``, ``body``) of all images in ``folder``, each made in one task.

    ``glyphs`` (``medoid_id``, ``pattern``, or their patterns in order) replaces clustering in global mode.
    """
    frames = I.scan(spark, folder)
    if frames.isEmpty():
        raise ValueError(f"no images in {folder}")
    tables = shared_tables(frames, config) if config.mode != "frame" else None
    head = container.header(config.duration) + (table_chunks(tables) if tables else b"")
    found = reserved = None
    if config.mode == "global":
        if isinstance(glyphs, DataFrame):
            rows = sorted((r.medoid_id, r.pattern) for r in G.pad_to(glyphs, GLOBAL_GLYPHS).collect())
            glyphs = np.array([p for _, p in rows], np.int64)
        found = fit.zero_first(fit.padded(glyphs, GLOBAL_GLYPHS)) if glyphs is not None else global_glyphs(frames, tables, config)
        found = denoised(found, config)
        head += font_chunks(found)
    elif config.coherence:
        reserved = coherent_glyphs(frames, config)
    shared = spark.sparkContext.broadcast((tables, found, reserved))

    def work(frame: int, px: np.ndarray) -> pd.DataFrame:
        tables, found, reserved = shared.value
        if found is not None:
            return pd.DataFrame({"frame_idx": [frame], "body": [frame_body(px, found, tables, config)]})
        own = tables or frame_tables(px, config)
        fonts = denoised(frame_glyphs(px, own, config, reserved), config)
        before = (b"" if tables else table_chunks(own, frame % 2)) + font_chunks(fonts, frame % 2 * 2)
        return pd.DataFrame({"frame_idx": [frame], "body": [frame_body(px, fonts, own, config, frame, before)]})

    return head, per_frame(frames, config.crop, work, "frame_idx int, body binary")


def parts(spark: SparkSession, folder: str, config: Config = Config(), glyphs: DataFrame | np.ndarray | None = None) -> Iterator[bytes]:
    """The container of all images in ``folder``, piece by piece in order; the driver holds one partition of bodies at a time."""
    head, bodies = encoded(spark, folder, config, glyphs)
    yield head
    bodies = bodies.persist()  # sorting by range reads them twice, and each is dear
    for r in bodies.orderBy("frame_idx").toLocalIterator():
        yield bytes(r.body)
    bodies.unpersist()


def encode(spark: SparkSession, folder: str, config: Config = Config(), glyphs: DataFrame | np.ndarray | None = None) -> bytes:
    """``parts``, joined."""
    return b"".join(parts(spark, folder, config, glyphs))


def read_glyphs(path: str) -> np.ndarray:
    """A glyph table of 1024 x 8 bytes from a file; the empty glyph comes first."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) != 8 * GLOBAL_GLYPHS:
        raise ValueError(f"a glyph table has {8 * GLOBAL_GLYPHS} bytes, not {len(data)}")
    return fit.zero_first(np.frombuffer(data, ">i8").astype(np.int64))
