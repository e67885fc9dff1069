"""Pattern statistics, matching and glyph selection as relational operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import patterns as P
from glyphmill.operators import fit
from glyphmill.operators.fit import WEIGHTS

MAX_GLYPHS = 4096


def canonical_patterns(tiles: DataFrame, values: str = "embedding") -> DataFrame:
    """``tiles`` with ``pattern`` (canonical) and ``inverted``; narrow, no shuffle."""
    raw = P.pattern_of(values, F.col("_median"))  # a flat tile is all foreground, as every value is at least the median
    return tiles.withColumn("_median", P.median64(values)).withColumn("_raw", raw).withColumns({"pattern": P.canonical("_raw"), "inverted": P.is_inverted("_raw")}).drop("_raw", "_median")


def pattern_frequency(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("pattern").agg(F.count("*").alias("cnt"))


def top_glyphs(counts: DataFrame, n: int) -> DataFrame:
    """(``medoid_id``, ``pattern``): the n most frequent, ties by pattern; a top-n, so it stays small."""
    top = counts.orderBy(F.desc("cnt"), "pattern").limit(n)
    return top.select((F.row_number().over(Window.orderBy(F.desc("cnt"), "pattern")) - 1).alias("medoid_id"), "pattern")


def checked(glyphs: DataFrame) -> DataFrame:
    """A glyph table to broadcast, if its counted rows are within what a font can address."""
    if (n := glyphs.limit(MAX_GLYPHS + 1).count()) > MAX_GLYPHS:
        raise ValueError(f"{n} glyphs or more; a glyph table has at most {MAX_GLYPHS}")
    return F.broadcast(glyphs)


def hamming_assign(patterns: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(``pattern``, ``dist``, ``invert``, ``medoid_id``) for each distinct pattern: least distance, normal before inverted, then the lowest id.

    Only distinct patterns meet the bounded, broadcast glyph table; join back on ``pattern``.
    """
    d = P.hamming("pattern", "glyph")
    g = checked(glyphs.select("medoid_id", F.col("pattern").alias("glyph")))
    best = patterns.select("pattern").distinct().crossJoin(g).groupBy("pattern").agg(F.min(F.struct(F.least(d, 64 - d).alias("dist"), (d > 32).cast("int").alias("invert"), "medoid_id")).alias("m"))
    return best.select("pattern", "m.dist", "m.invert", "m.medoid_id")


def position_means(patterns: DataFrame, values: str = "embedding") -> DataFrame:
    """(``pattern``, ``pos``, ``mean_v``, ``cnt``)."""
    return patterns.select("pattern", F.posexplode(values).alias("pos", "v")).groupBy("pattern", "pos").agg(F.avg(F.col("v").cast("double")).alias("mean_v"), F.count("*").alias("cnt"))


def cluster_medoid(members: DataFrame, cluster: str, order: str) -> DataFrame:
    """For each cluster the member with the least summed Hamming distance, the first by ``order`` at ties.

    A member's sum follows from the cluster's counts of set bits at each position, so the work is
    linear in the cluster and no pairs are made.
    """
    bits = members.select(cluster, order, "pattern", F.posexplode(P.mask("pattern")).alias("pos", "bit"))
    ones = bits.groupBy(cluster, "pos").agg(F.count_if("bit").alias("ones"), F.count("*").alias("n"))
    total = bits.join(ones, [cluster, "pos"]).groupBy(cluster, order, "pattern").agg(F.sum(F.when(F.col("bit"), F.col("n") - F.col("ones")).otherwise(F.col("ones"))).alias("total"))
    return total.groupBy(cluster).agg(F.min(F.struct("total", F.col(order), "pattern")).alias("m")).select(cluster, F.col("m.total").alias("total"), F.col(f"m.{order}").alias(order), F.col("m.pattern").alias("pattern"))


def coherent(frames: DataFrame, frame: str, key: str, least: int = 2) -> DataFrame:
    """Keys that occur in at least ``least`` frames, with their number."""
    return frames.select(frame, key).distinct().groupBy(key).agg(F.count("*").alias("frames")).where(F.col("frames") >= least)


def pad_to(glyphs: DataFrame, n: int) -> DataFrame:
    """Exactly ``n`` glyphs: those of lower number, then empty ones."""
    ids = glyphs.sparkSession.range(n).select(F.col("id").cast("int").alias("medoid_id"))
    return ids.join(glyphs.where(F.col("medoid_id") < n), "medoid_id", "left").select("medoid_id", F.coalesce("pattern", F.lit(0).cast("long")).alias("pattern"))


def ensure_zero(glyphs: DataFrame) -> DataFrame:
    """The empty glyph has number 0: it changes places with the first one, or replaces it if there is none."""
    zero = glyphs.agg(F.coalesce(F.min(F.when(F.col("pattern") == 0, F.col("medoid_id"))), F.lit(-1)).alias("z"), F.max(F.when(F.col("medoid_id") == 0, F.col("pattern"))).alias("first"))
    return glyphs.crossJoin(F.broadcast(zero)).select("medoid_id", F.when(F.col("medoid_id") == 0, F.lit(0).cast("long")).when(F.col("medoid_id") == F.col("z"), F.col("first")).otherwise(F.col("pattern")).alias("pattern"))


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by their mean and population deviation plus 1e-6; the statistics are one row."""
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_{c}") for c in columns])
    return df.crossJoin(F.broadcast(stats)).select(*[x for x in df.columns if x not in columns], *[((F.col(c) - F.col(f"_{c}.m")) / (F.col(f"_{c}.s") + 1e-6)).alias(c) for c in columns])


def _islands(bits: np.ndarray) -> list[list[int]]:
    """Groups of set bits that touch, diagonals included."""
    left = {int(i) for i in np.flatnonzero(bits)}
    found = []
    while left:
        grown, edge = [], [left.pop()]
        while edge:
            i = edge.pop()
            grown.append(i)
            near = {8 * r + c for r in range(i // 8 - 1, i // 8 + 2) for c in range(i % 8 - 1, i % 8 + 2) if 0 <= r < 8 and 0 <= c < 8} & left
            left -= near
            edge += near
        found.append(grown)
    return found


def denoise(pattern: int, size: int) -> int:
    """Clear islands of set bits up to ``size``, then set islands of clear bits; empty and full patterns stay."""
    if size <= 0 or pattern in (0, -1):
        return pattern
    bits = np.unpackbits(np.frombuffer(int(pattern).to_bytes(8, "big", signed=True), np.uint8)).astype(bool)
    for value in (True, False):
        for island in _islands(bits == value):
            if len(island) <= size:
                bits[island] = not value
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def denoise_glyphs(glyphs: DataFrame, size: int) -> DataFrame:
    """``glyphs`` with denoised ``pattern`` and ``changed``, by an Arrow function over at most a few thousand rows."""

    @F.pandas_udf("long")
    def cleaned(p: pd.Series) -> pd.Series:
        return p.map(lambda x: denoise(x, size))

    return glyphs.withColumn("_p", cleaned("pattern")).withColumn("changed", F.col("_p") != F.col("pattern")).withColumn("pattern", F.col("_p")).drop("_p")


def kmeans_glyphs(counts: DataFrame, n: int, weight: str = "cnt", seed: int = 42) -> DataFrame:
    """(``medoid_id``, ``pattern``) of ``glyph_medoids``, padded to n with the empty glyph first."""
    picked = glyph_medoids(counts, n, weight, seed)
    ranked = picked.groupBy("pattern").agg(F.min("first").alias("first")).where("pattern <> 0").orderBy("first", "pattern").limit(n - 1)
    numbered = ranked.select(F.row_number().over(Window.orderBy("first", "pattern")).alias("medoid_id"), "pattern")
    zero = counts.sparkSession.createDataFrame([(0, 0)], "medoid_id int, pattern long")
    return pad_to(numbered.unionByName(zero), n)


def glyph_medoids(counts: DataFrame, n: int, weight: str = "cnt", seed: int = 42) -> DataFrame:
    """(``pattern``, ``first``): the medoid of each of n clusters, and its number, from weighted k-means on structure features.

    Features are edges, density and row bytes, each normalised over the patterns, times 0.1, 0.1 and
    10. Up to n distinct patterns are taken as they are.
    """
    if counts.count() <= n:
        return counts.select("pattern", F.lit(0).alias("first"))
    if n == 1:  # k-means needs two clusters
        found = counts.select("pattern", F.lit(0).alias("prediction"))
    else:
        found = _clustered(structure_features(counts, weight), n, seed)
    return cluster_medoid(found.select("prediction", "pattern", F.col("pattern").alias("at")), "prediction", "at").select("pattern", F.col("prediction").alias("first"))


def structure_features(counts: DataFrame, weight: str) -> DataFrame:
    """(``pattern``, ``w``, ``features``): 89 columns, normalised by one aggregate, as a vector."""
    from pyspark.ml.functions import array_to_vector

    parts = {"e": P.edge_descriptor("pattern"), "d": P.density("pattern"), "b": F.array(*[P.row_byte("pattern", r).cast("double") for r in range(8)])}
    sizes = {"e": 64, "d": 17, "b": 8}
    wide = counts.select("pattern", F.col(weight).cast("double").alias("w"), *[v.alias(k) for k, v in parts.items()])
    flat = wide.select("pattern", "w", *[F.col(k)[i].alias(f"{k}{i}") for k, n in sizes.items() for i in range(n)])
    scaled = zscore(flat, [f"{k}{i}" for k, n in sizes.items() for i in range(n)])
    columns = [F.col(f"{k}{i}") * x for (k, n), x in zip(sizes.items(), WEIGHTS, strict=True) for i in range(n)]
    return scaled.select("pattern", "w", array_to_vector(F.array(*columns)).alias("features"))


def _clustered(data: DataFrame, n: int, seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import KMeans

    return KMeans(k=n, seed=seed, weightCol="w").fit(data).transform(data)


def perceptual_glyphs(stats: DataFrame, n: int, fg: np.ndarray, bg: np.ndarray, candidates: int = 2, seed: int = 42) -> np.ndarray:
    """``n`` glyphs, the empty one first, of ``stats`` (``pattern``, ``cnt``, ``first``, ``mean`` of 64 x 3 Oklab values): clustered in Oklab, and of each cluster the candidate that draws it best.

    Candidates are the members nearest the centre and the Hamming medoid. They are at most three a
    cluster and sent to all tasks; costs are summed where the members are, so no cluster is gathered.
    """
    from pyspark.ml.functions import array_to_vector

    total = stats.count()
    if total < n:
        return fit.zero_first(fit.padded(np.array([r.pattern for r in stats.orderBy("first").select("pattern").collect()], np.int64), n))
    rows = zscore(stats.select("pattern", "cnt", "mean", *[P.row_byte("pattern", r).cast("double").alias(f"b{r}") for r in range(8)]), [f"b{r}" for r in range(8)])
    features = F.concat(F.transform("mean", lambda x: x * fit.PERCEPTUAL_WEIGHT), F.array(*[F.col(f"b{r}") for r in range(8)]))
    data = rows.select("pattern", "cnt", F.col("cnt").cast("double").alias("w"), "mean", features.alias("x"), array_to_vector(features).alias("features"))
    from pyspark.ml.clustering import KMeans

    model = KMeans(k=n, seed=seed, weightCol="w").fit(data)
    members = model.transform(data).select("pattern", "cnt", "mean", "x", F.col("prediction").alias("cluster"))
    centres = members.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    far = F.aggregate(F.zip_with("x", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    ranked = members.join(F.broadcast(centres), "cluster").withColumn("far", far)
    near = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("far", "pattern"))).where(F.col("rank") <= candidates).select("cluster", "pattern")
    medoid = cluster_medoid(members.select("cluster", "pattern", F.col("pattern").alias("at")), "cluster", "at").select("cluster", "pattern")
    options: dict[int, list[int]] = {}
    for r in near.union(medoid).distinct().collect():  # at most three a cluster
        options.setdefault(r.cluster, []).append(r.pattern)
    shared = members.sparkSession.sparkContext.broadcast(({k: np.array(sorted(v), np.int64) for k, v in options.items()}, fg, bg))

    def drawn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        options, fg, bg = shared.value
        for part in it:
            for k, own in part.groupby("cluster"):
                means = np.stack(own["mean"].to_numpy()).reshape(-1, 64, 3)
                cost = sum((fit.costs(options[k], means[a : a + 256], fg, bg) * own["cnt"].to_numpy()[a : a + 256, None]).sum(axis=0) for a in range(0, len(means), 256))
                yield pd.DataFrame({"cluster": k, "pattern": options[k], "cost": cost})

    cost = members.select("cluster", "cnt", "mean").mapInPandas(drawn, "cluster int, pattern long, cost double").groupBy("cluster", "pattern").agg(F.sum("cost").alias("cost"))
    best = {r.cluster: r.m.pattern for r in cost.groupBy("cluster").agg(F.min(F.struct("cost", "pattern")).alias("m")).collect()}
    return fit.zero_first(np.array([best.get(k, 0) for k in range(n)], np.int64))
