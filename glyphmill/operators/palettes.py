"""Palettes: sampled, weighted colours, clustered to 255 and a transparent black, and merged, split and interleaved tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.fit import interleaved

COLOURS = 255


def stride_sample(pixels: DataFrame, index: str = "pixel_idx", stride: int = 4) -> DataFrame:
    return pixels.where(F.col(index) % stride == 0)


def weighted_colours(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("r", "g", "b").agg(F.count("*").alias("cnt"))


def kmeans_palette(colours: DataFrame, *, k: int = COLOURS, weight: str | None = "cnt", rounded: bool = False, seed: int = 42) -> DataFrame:
    """(``idx``, ``r``, ``g``, ``b``) with entry 0 black. Up to ``k`` distinct colours are taken as they are, and grey 128 fills the rest.

    Clusters distinct colours by weight, the same objective as over all pixels on far fewer rows.
    Centres are cut to integers, or rounded.
    """
    table = table_of(clustered(colours, k, weight=weight, rounded=rounded, seed=seed)) if k == COLOURS else None
    rows = table if table is not None else np.vstack([[[0, 0, 0]], clustered(colours, k, weight=weight, rounded=rounded, seed=seed)])
    return colours.sparkSession.createDataFrame([(i, *map(int, c)) for i, c in enumerate(rows)], "idx int, r int, g int, b int")


def role_centres(tiles: DataFrame, key: str, values: str, median: str) -> DataFrame:
    """Means of the foreground (at least the median) and of the background; the tile's own mean where a side is empty."""
    v = tiles.select(key, F.col(median).alias("m"), F.explode(values).alias("v")).select(key, "m", F.col("v").cast("double").alias("v"))
    up = F.col("v") >= F.col("m")
    out = v.groupBy(key).agg(F.avg("v").alias("mean"), F.avg(F.when(up, F.col("v"))).alias("fg"), F.avg(F.when(~up, F.col("v"))).alias("bg"))
    return out.select(key, F.coalesce("fg", "mean").alias("fg_mean"), F.coalesce("bg", "mean").alias("bg_mean"))


def interleave(colours: DataFrame, light: str, ties: list[str]) -> DataFrame:
    """``colours`` with ``lut`` and ``idx``: by luminance, even places to table 0 and odd ones to table 1, entries from 1.

    Two tables have at most 510 colours, which is checked, so one window orders them.
    """
    if colours.limit(2 * COLOURS + 1).count() > 2 * COLOURS:
        raise ValueError(f"two tables have at most {2 * COLOURS} colours")
    place = F.row_number().over(Window.orderBy(light, *ties)) - 1
    return colours.withColumn("_at", place).withColumns({"lut": (F.col("_at") % 2).cast("int"), "idx": (F.floor(F.col("_at") / 2) + 1).cast("int")}).drop("_at")


def merged(*palettes: DataFrame) -> DataFrame:
    """Distinct colours of all palettes without their entry 0; one black row if there is none."""
    out = reduce(DataFrame.union, [p.where("idx > 0").select("r", "g", "b") for p in palettes]).distinct()
    black = out.agg(F.count("*").alias("n")).where("n = 0")  # of what is left, one number
    zero = [F.lit(0).cast(out.schema[c].dataType).alias(c) for c in "rgb"]
    return out.union(black.select(*zero))


def nearest(queries: DataFrame, palette: DataFrame, q: list[str], p: list[str], idx: str = "idx", top: int = 1, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, ``rank``, ``idx``, ``dist``): the ``top`` nearest entries by squared distance, the lower index at ties.

    The palette is at most a few hundred rows, which is checked before it is broadcast. The nearest
    one is a running minimum; of more, each task keeps the first ``top`` of a key before the shuffle.
    """
    if palette.limit(1025).count() > 1024:
        raise ValueError("a palette has at most 1024 entries")
    side = F.broadcast(palette.select(F.col(idx).alias("_idx"), *[F.col(c).alias(f"_{c}") for c in p]))
    dist = sum(((F.col(a) - F.col(f"_{b}")) * (F.col(a) - F.col(f"_{b}")) for a, b in zip(q, p, strict=True)), F.lit(0.0))
    met = queries.crossJoin(side).select(*keys, dist.alias("dist"), F.col("_idx").alias("idx"))
    if top == 1:
        best = met.groupBy(*keys).agg(F.min(F.struct("dist", "idx")).alias("n"))
        return best.select(*keys, F.lit(0).alias("rank"), "n.idx", "n.dist")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("dist", "idx")) - 1
    return met.withColumn("rank", place).where(F.col("rank") < top).select(*keys, "rank", "idx", "dist")


def clustered(colours: DataFrame, k: int, *, weight: str | None = None, rounded: bool = False, seed: int = 42) -> np.ndarray:
    """Up to ``k`` colours (bytes): distinct ones as they are, or k-means centres, cut to integers or rounded."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if colours.limit(k + 1).count() <= k:
        return np.array(sorted(tuple(r) for r in colours.select("r", "g", "b").collect()), np.uint8).reshape(-1, 3)
    data = colours.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in "rgb"])).alias("features"), F.col(weight).cast("double").alias("w") if weight else F.lit(1.0).alias("w"))
    centres = np.array(KMeans(k=k, seed=seed, weightCol="w").fit(data).clusterCenters())
    return np.clip(np.rint(centres) if rounded else centres, 0, 255).astype(np.uint8)


def table_of(colours: np.ndarray) -> np.ndarray:
    """(256, 3): entry 0 black, then the colours, then grey 128."""
    out = np.full((COLOURS + 1, 3), 128, np.uint8)
    out[0] = 0
    out[1 : len(colours) + 1] = colours
    return out


def two_tables(colours: DataFrame, seed: int = 42) -> list[np.ndarray]:
    """Two tables of a role: twice the same of up to 255 distinct colours, else up to 510 rounded centres, interleaved by luminance."""
    few = colours.limit(COLOURS + 1).count() <= COLOURS
    found = clustered(colours, COLOURS if few else 2 * COLOURS, rounded=True, seed=seed)
    return [table_of(found)] * 2 if few else interleaved(found)
