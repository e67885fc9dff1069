"""Luminance, Oklab and CIELAB of 8-bit sRGB as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luminance_1000(r: Column, g: Column, b: Column) -> Column:
    """BT.601 luminance times 1000, an integer, so that ties are exact."""
    return r * 299 + g * 587 + b * 114


def linear(c: Column) -> Column:
    x = c / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


# fixed values: the published Oklab matrices
LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OKLAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
# fixed values: sRGB to XYZ and the D65 white point
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def _times(matrix: tuple, v: list[Column]) -> list[Column]:
    return [v[0] * m[0] + v[1] * m[1] + v[2] * m[2] for m in matrix]


def oklab(r: Column, g: Column, b: Column) -> list[Column]:
    """L, a, b."""
    return _times(OKLAB, [F.cbrt(x) for x in _times(LMS, [linear(r), linear(g), linear(b)])])


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    """CIELAB under D65."""
    xyz = [x / w for x, w in zip(_times(XYZ, [linear(r), linear(g), linear(b)]), WHITE, strict=True)]
    f = [F.when(x > 0.008856, F.cbrt(x)).otherwise(x * 7.787 + 16.0 / 116.0) for x in xyz]
    return [f[1] * 116.0 - 16.0, (f[0] - f[1]) * 500.0, (f[1] - f[2]) * 200.0]
