"""Kernels over the tiles of one frame, in numpy: luminance split, colour lookups, glyph matching.

A frame has 4,800 tiles, so each of these runs inside one task on arrays of bounded size. Tiles are
(n, 64, 3) bytes, patterns int64 as in ``functions.patterns``, palettes (m, 3) with entry 0 never chosen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LUMINANCE = np.array([299, 587, 114])
PERCEPTUAL = np.array([0.299, 0.587, 0.114])
BATCH = 256


def bits_of(patterns: np.ndarray) -> np.ndarray:
    """(n, 64) of 0 and 1 in row-major order."""
    return np.unpackbits(np.ascontiguousarray(patterns, np.int64).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def patterns_of(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits.astype(bool), axis=1).view(">i8").ravel().astype(np.int64)


def canonical(patterns: np.ndarray) -> np.ndarray:
    return np.where(patterns < 0, ~patterns, patterns)


@dataclass(frozen=True)
class Cells:
    """What matching needs of each tile: its pattern, whether it is flat, and the mean colour of each side."""

    raw: np.ndarray
    flat: np.ndarray
    fg: np.ndarray
    bg: np.ndarray


def cells_of(px: np.ndarray) -> Cells:
    """Integer luminance split at the median; the background's mean is the tile's own where no pixel is below."""
    lum = px.astype(np.int64) @ LUMINANCE
    middle = np.partition(lum, (31, 32), axis=1)
    up = 2 * lum >= (middle[:, 31] + middle[:, 32])[:, None]
    n = up.sum(axis=1)[:, None]
    total = px.sum(axis=1, dtype=np.int64)
    bright = (px * up[:, :, None]).sum(axis=1, dtype=np.int64)
    bg = np.where(n < 64, (total - bright) / np.maximum(64 - n, 1), total / 64)
    return Cells(patterns_of(up), (px == px[:, :1]).all(axis=(1, 2)), bright / n, bg)


def distances(colours: np.ndarray, palette: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """(n, m - 1) squared distances to the palette without its entry 0."""
    d = (colours[:, None, :] - palette[None, 1:, :].astype(np.float64)) ** 2
    return d.sum(axis=2) if weights is None else d @ weights


def match_patterns(raw: np.ndarray, glyphs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Glyph and inversion of each pattern by Hamming distance: the least, normal before inverted, then the lowest glyph."""
    unique, back = np.unique(raw, return_inverse=True)
    found, inverted = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
    g = glyphs.astype(np.int64).view(np.uint64)
    for at in range(0, len(unique), BATCH):
        d = np.bitwise_count(unique[at : at + BATCH, None].view(np.uint64) ^ g[None, :]).astype(np.int64)
        key = np.minimum(d, 64 - d) * 2 + (d > 32)
        found[at : at + BATCH] = key.argmin(axis=1)
        inverted[at : at + BATCH] = key.min(axis=1) & 1
    return found[back], inverted[back]


def _result(glyph, fg, bg, invert, fg_lut, bg_lut) -> np.ndarray:
    return np.stack([np.broadcast_to(np.asarray(x, np.int64), glyph.shape) for x in (glyph, fg, bg, invert, fg_lut, bg_lut)], axis=1)


def assign(px: np.ndarray, glyphs: np.ndarray, fgs: list[np.ndarray], bgs: list[np.ndarray]) -> np.ndarray:
    """(n, 6): glyph, foreground, background, invert, foreground table, background table, by pattern and mean colours.

    With one table a role, a background of the same number as the foreground gives way to the next
    nearest. With two, the nearer table's entry is taken, table 0 at ties, and a background of the
    same colour as the foreground gives way to the other table's. A flat tile is glyph 0 with its
    nearest background as both colours.
    """
    c = cells_of(px)
    glyph, invert = match_patterns(c.raw, glyphs)
    rows = np.arange(len(px))
    d_fg, d_bg = [distances(c.fg, p) for p in fgs], [distances(c.bg, p) for p in bgs]
    if len(fgs) == 1:
        fg, bg = d_fg[0].argmin(axis=1), d_bg[0].argmin(axis=1)
        flat = bg.copy()
        apart = d_bg[0]
        same = fg == bg
        apart[rows[same], bg[same]] = np.inf
        bg = np.where(same, apart.argmin(axis=1), bg)
        fl = bl = flat_lut = np.zeros(len(px), np.int64)
    else:
        near = lambda d: (np.stack([x.argmin(axis=1) for x in d]), np.stack([x.min(axis=1) for x in d]))
        (fg_at, fg_d), (bg_at, bg_d) = near(d_fg), near(d_bg)
        fl, bl = (fg_d[1] < fg_d[0]).astype(np.int64), (bg_d[1] < bg_d[0]).astype(np.int64)
        fg, flat, flat_lut = fg_at[fl, rows], bg_at[bl, rows], bl
        colour = lambda tables, lut, at: np.stack(tables)[lut, at + 1]
        same = (colour(fgs, fl, fg) == colour(bgs, bl, flat)).all(axis=1)
        bl = np.where(same, 1 - bl, bl)
        bg = bg_at[bl, rows]
    pick = lambda a, b: np.where(c.flat, a, b)
    return _result(pick(0, glyph), pick(flat, fg) + 1, pick(flat, bg) + 1, pick(0, invert), pick(flat_lut, fl), pick(flat_lut, bl))


def assign_best(px: np.ndarray, glyphs: np.ndarray, fgs: list[np.ndarray], bgs: list[np.ndarray], k: int | None = None) -> np.ndarray:
    """As ``assign``, by the least squared error over all glyphs and the ``k`` nearest colours of each role (3, or 6 of two tables).

    Two tables of a role are one pool; its prefilter weighs channels by luminance. For a pair of
    colours the error is that of all background plus, for each set bit, what the foreground gains
    there, so all glyphs of a batch of tiles come from one product. Order at ties: foreground rank,
    background rank, glyph, normal before inverted. Pairs of equal colours are passed over; if all
    are equal the nearest of each role stand with glyph 0.
    """
    two = len(fgs) > 1
    k = k or (6 if two else 3)
    weights = PERCEPTUAL if two else None
    pool = lambda tables: np.concatenate([t[1:] for t in tables]).astype(np.float64)
    fg_pool, bg_pool = pool(fgs), pool(bgs)
    number = lambda at, tables: (at % (len(tables[0]) - 1) + 1, at // (len(tables[0]) - 1))
    c = cells_of(px)
    ranked = lambda colours, p, n: np.argsort(distances(colours, np.vstack([p[:1], p]), weights), axis=1, kind="stable")[:, :n]
    fs, bs = ranked(c.fg, fg_pool, k), ranked(c.bg, bg_pool, k)
    bits = bits_of(glyphs).astype(np.float64).T
    out = np.zeros((len(px), 6), np.int64)
    for at in range(0, len(px), BATCH):
        part = slice(at, at + BATCH)
        x = px[part].astype(np.float64)
        best = np.full(len(x), np.inf)
        held = np.stack([np.zeros(len(x), np.int64), fs[part, 0], bs[part, 0], np.zeros(len(x), np.int64)], axis=1)
        for i in range(fs.shape[1]):
            f = fg_pool[fs[part, i]]
            ef = ((x - f[:, None, :]) ** 2).sum(axis=2)
            for j in range(bs.shape[1]):
                b = bg_pool[bs[part, j]]
                eb = ((x - b[:, None, :]) ** 2).sum(axis=2)
                gain = (ef - eb) @ bits
                errors = np.stack([eb.sum(axis=1)[:, None] + gain, ef.sum(axis=1)[:, None] - gain], axis=2).reshape(len(x), -1)
                least = errors.argmin(axis=1)
                error = errors[np.arange(len(x)), least]
                better = (error < best) & (f != b).any(axis=1)
                best[better] = error[better]
                held[better] = np.stack([least // 2, fs[part, i], bs[part, j], least % 2], axis=1)[better]
        (fg, fl), (bg, bl) = number(held[:, 1], fgs), number(held[:, 2], bgs)
        flat, flat_lut = number(bs[part, 0], bgs)
        pick = lambda a, b: np.where(c.flat[part], a, b)  # noqa: B023, E731
        out[part] = _result(pick(0, held[:, 0]), pick(flat, fg), pick(flat, bg), pick(0, held[:, 3]), pick(flat_lut, fl), pick(flat_lut, bl))
    return out
