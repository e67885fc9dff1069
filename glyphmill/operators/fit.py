"""Small models in numpy: weighted k-means, glyph features and medoids, and Oklab costs of glyphs.

They fit one frame's tiles inside a task, and serve the distributed fits with their bounded parts.
"""

from __future__ import annotations

import numpy as np

from glyphmill.functions import colour
from glyphmill.operators.frames import bits_of, canonical

# fixed values: weights of normalised edges, density and row bytes
WEIGHTS = (0.1, 0.1, 10.0)
PERCEPTUAL_WEIGHT = 8.0
CHUNK = 4096


def kmeans(x: np.ndarray, k: int, weights: np.ndarray | None = None, seed: int = 42, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels; centres start at rows drawn by their weighted distance from those before. An empty cluster moves to the farthest row."""
    x = np.ascontiguousarray(x, np.float64)
    w = np.ones(len(x)) if weights is None else np.asarray(weights, np.float64)
    k = min(k, len(x))
    r = np.random.default_rng(seed)
    norm = (x * x).sum(axis=1)
    centres = np.empty((k, x.shape[1]))
    near = np.full(len(x), np.inf)
    at = int(r.choice(len(x), p=w / w.sum()))
    for i in range(k):
        centres[i] = x[at]
        near = np.minimum(near, np.maximum(norm - 2 * (x @ x[at]) + norm[at], 0))
        p = w * near
        at = int(np.searchsorted(np.cumsum(p), r.random() * p.sum())) if p.sum() > 0 else int(r.integers(len(x)))
        at = min(at, len(x) - 1)
    labels = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        square = (centres * centres).sum(axis=1)
        least = np.empty(len(x))
        new = np.empty_like(labels)
        for a in range(0, len(x), CHUNK):
            d = square[None, :] - 2 * (x[a : a + CHUNK] @ centres.T)
            new[a : a + CHUNK] = d.argmin(axis=1)
            least[a : a + CHUNK] = d.min(axis=1) + norm[a : a + CHUNK]
        total = np.bincount(new, w, k)
        moved = np.stack([np.bincount(new, w * x[:, j], k) for j in range(x.shape[1])], axis=1)
        far = iter(np.argsort(-least, kind="stable"))
        for c in range(k):
            centres[c] = moved[c] / total[c] if total[c] else x[next(far)]
        if (new == labels).all() and total.all():
            break
        labels = new
    return centres, labels


def normalised(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)


def edges(bits: np.ndarray) -> np.ndarray:
    """(n, 64): transitions to the right and down at each place, the first two replaced by the totals."""
    b = bits.reshape(-1, 8, 8).astype(np.int64)
    right, down = np.zeros_like(b), np.zeros_like(b)
    right[:, :, :7], down[:, :7] = b[:, :, 1:] != b[:, :, :-1], b[:, 1:] != b[:, :-1]
    out = (right + down).reshape(-1, 64)
    out[:, 0], out[:, 1] = right.sum(axis=(1, 2)), down.sum(axis=(1, 2))
    return out


def structure(patterns: np.ndarray) -> np.ndarray:
    """(n, 89): edges, density and row bytes, normalised and weighted."""
    bits = bits_of(patterns)
    b = bits.reshape(-1, 8, 8)
    density = np.concatenate([bits.mean(axis=1)[:, None], b.mean(axis=2), b.mean(axis=1)], axis=1)
    rows = np.packbits(bits, axis=1).astype(np.float64)
    return np.concatenate([normalised(f.astype(np.float64)) * w for f, w in zip((edges(bits), density, rows), WEIGHTS, strict=True)], axis=1)


def oklab(rgb: np.ndarray) -> np.ndarray:
    """Oklab of 8-bit sRGB in the last axis."""
    x = rgb.astype(np.float64) / 255
    linear = np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)
    return np.cbrt(linear @ np.array(colour.LMS).T) @ np.array(colour.OKLAB).T


def perceptual(patterns: np.ndarray, means: np.ndarray) -> np.ndarray:
    """(n, 200): Oklab means by position times 8, and normalised row bytes."""
    rows = np.packbits(bits_of(patterns), axis=1).astype(np.float64)
    return np.concatenate([means.reshape(len(means), 192) * PERCEPTUAL_WEIGHT, normalised(rows)], axis=1)


def costs(glyphs: np.ndarray, means: np.ndarray, fg: np.ndarray, bg: np.ndarray) -> np.ndarray:
    """(n, g): squared error of each row of Oklab ``means`` (n, 64, 3) drawn by each glyph, each side in its nearest palette colour.

    A side's error about one colour follows from its count, sum and sum of squares, so all glyphs
    come from products. An empty side costs nothing.
    """
    out = np.zeros((len(means), len(glyphs)))
    bits = bits_of(glyphs).astype(np.float64)
    square = (means * means).sum(axis=2)
    for mask, palette in ((bits, fg), (1 - bits, bg)):
        n = mask.sum(axis=1)
        total = np.einsum("gp,npc->ngc", mask, means, optimize=True)
        centre = total / np.maximum(n, 1)[None, :, None]
        norm = (palette * palette).sum(axis=1)
        flat = centre.reshape(-1, 3)
        near = np.concatenate([(norm[None, :] - 2 * (flat[a : a + CHUNK] @ palette.T)).argmin(axis=1) for a in range(0, len(flat), CHUNK)]) if len(flat) else np.zeros(0, np.int64)
        c = palette[near].reshape(centre.shape)
        out += np.where(n[None, :] > 0, square @ mask.T - 2 * (c * total).sum(axis=2) + n[None, :] * (c * c).sum(axis=2), 0)
    return out


def set_cost(glyphs: np.ndarray, means: np.ndarray, counts: np.ndarray, fg: np.ndarray, bg: np.ndarray) -> float:
    """Weighted cost of a glyph set: each row by its cheapest glyph."""
    return float(sum((costs(glyphs, means[a : a + 256], fg, bg).min(axis=1) * counts[a : a + 256]).sum() for a in range(0, len(means), 256)))


def hamming_medoid(patterns: np.ndarray) -> int:
    """Place of the pattern with the least summed Hamming distance to all, the first at ties; from counts of set bits by position."""
    bits = bits_of(patterns).astype(np.int64)
    ones = bits.sum(axis=0)
    return int((bits * (len(bits) - ones) + (1 - bits) * ones).sum(axis=1).argmin())


def with_extremes(glyphs: np.ndarray) -> np.ndarray:
    """The set with an empty and a full glyph: if one is missing, the glyph with the fewest, or most, set bits becomes it."""
    out = glyphs.copy()
    n = np.bitwise_count(out.view(np.uint64)).astype(np.int64)
    taken = -1
    if len(out) and not (n == 0).any():
        taken = int(n.argmin())
        out[taken], n[taken] = 0, 0
    if len(out) > 1 and not (n == 64).any():
        out[int(np.where(np.arange(len(n)) == taken, -1, n).argmax())] = -1
    elif len(out) == 1 and n[0] not in (0, 64):
        out[0] = -1
    return out


def zero_first(glyphs: np.ndarray) -> np.ndarray:
    """The empty glyph has number 0: it changes places with the first one, or replaces it if there is none."""
    out = glyphs.copy()
    found = np.flatnonzero(out == 0)
    if len(found):
        out[found[0]] = out[0]
    out[0] = 0
    return out


def padded(glyphs: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([glyphs[:n], np.zeros(max(0, n - len(glyphs)), np.int64)])


def with_zero(patterns: np.ndarray) -> np.ndarray:
    return patterns if (patterns == 0).any() else np.concatenate([[0], patterns])


def structure_glyphs(patterns: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """``n`` glyphs of distinct patterns, in their order: all if they are no more, else the medoids of structure clusters, with the extremes."""
    if len(patterns) <= n:
        return padded(patterns, n)
    labels = kmeans(structure(patterns), n, weights)[1]
    found = [patterns[m][hamming_medoid(patterns[m])] if (m := labels == k).any() else 0 for k in range(n)]
    return with_extremes(np.array(found, np.int64))


def perceptual_glyphs(patterns: np.ndarray, counts: np.ndarray, means: np.ndarray, n: int, fg: np.ndarray, bg: np.ndarray, candidates: int = 2) -> np.ndarray:
    """``n`` glyphs from clusters in Oklab: of the members nearest a centre and the Hamming medoid, the one that draws the cluster best.

    ``means`` are Oklab (len, 64, 3); ``fg`` and ``bg`` Oklab palettes. The empty glyph is first.
    """
    if len(patterns) < n:
        return zero_first(padded(patterns, n))
    x = perceptual(patterns, means)
    centres, labels = kmeans(x, n, counts)
    found = np.zeros(n, np.int64)
    for k in range(len(centres)):
        m = np.flatnonzero(labels == k)
        if not len(m):
            continue
        near = m[np.argsort(((x[m] - centres[k]) ** 2).sum(axis=1), kind="stable")[:candidates]]
        options = np.unique(np.append(near, m[hamming_medoid(patterns[m])]))
        cost = (costs(patterns[options], means[m], fg, bg) * counts[m, None]).sum(axis=0)
        found[k] = patterns[options[cost.argmin()]]
    return zero_first(found)


def frame_stats(px: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct canonical patterns by first sight, their counts, first places, and sums of colours by position (n, 64, 3)."""
    unique, first, back, counts = np.unique(canonical(raw), return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sums = np.zeros((len(unique), 192))
    np.add.at(sums, place[back], px.reshape(len(px), 192).astype(np.float64))
    return unique[order], counts[order], first[order], sums.reshape(-1, 64, 3)


def palette_of(colours: np.ndarray, weights: np.ndarray | None = None, k: int = 255) -> np.ndarray:
    """(k + 1, 3) with entry 0 black: distinct colours as they are with grey 128 for the rest, or cut k-means centres."""
    out = np.full((k + 1, 3), 128, np.uint8)
    out[0] = 0
    if len(colours) <= k:
        out[1 : len(colours) + 1] = colours
    else:
        out[1:] = kmeans(colours, k, weights)[0].astype(np.uint8)
    return out


def interleaved(centres: np.ndarray) -> list[np.ndarray]:
    """Two tables from up to 510 colours by luminance: even places to table 0, odd ones to table 1."""
    order = np.argsort(centres.astype(np.int64) @ np.array([299, 587, 114]), kind="stable")
    tables = [np.full((256, 3), 128, np.uint8) for _ in range(2)]
    for t, part in zip(tables, (centres[order][0::2], centres[order][1::2]), strict=True):
        t[0] = 0
        t[1 : len(part) + 1] = part
    return tables
