"""Queries over the driver's tables for the engine's own operators, with their SQL for DuckDB.

A row of ``embeddings`` is a tile of 64 luminances, its label the frame.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import colour, patterns as P, words as W
from glyphmill.operators import glyphs as G, palettes as C, rle as R
from glyphmill.sources import container as S, images as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Canonical patterns by vec_id, and the top 64 glyphs.
TILES = """
WITH px AS (SELECT vec_id, label, unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
md AS (SELECT vec_id, median(v) AS m FROM px GROUP BY vec_id),
fg AS (SELECT px.vec_id, label, pos, v, m, v >= m AS f FROM px JOIN md ON px.vec_id = md.vec_id),
f0 AS (SELECT vec_id, f AS first FROM fg WHERE pos = 0),
pat AS (SELECT fg.vec_id, any_value(label) AS label, any_value(m) AS m, bool_or(pos = 0 AND f) AS inverted,
  sum(CASE WHEN f <> first THEN (1::BIGINT << (63 - pos)::INT) ELSE 0 END)::BIGINT AS pattern
  FROM fg JOIN f0 ON fg.vec_id = f0.vec_id GROUP BY fg.vec_id),
cnt AS (SELECT pattern, count(*) AS cnt FROM pat GROUP BY pattern),
gl AS (SELECT pattern, (row_number() OVER (ORDER BY cnt DESC, pattern) - 1)::INT AS medoid_id FROM cnt QUALIFY medoid_id < 64)
"""


def query(name: str, oracle: str | None = None, tiles: bool = False):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = (TILES if tiles else "") + oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.canonical_patterns(table(spark, sf_dir, "embeddings"))


@query("tile_median", "SELECT vec_id, m AS median_v FROM md", True)
def tile_median(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", P.median64("embedding").alias("median_v"))


@query("tile_pattern", "SELECT vec_id, string_agg(f::INT::VARCHAR, '' ORDER BY pos) AS bits FROM fg GROUP BY vec_id", True)
def tile_pattern(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").select("vec_id", P.pattern_of("embedding", P.median64("embedding")).alias("raw"))
    return t.select("vec_id", F.lpad(F.bin("raw"), 64, "0").alias("bits"))


@query("canonical_pattern", "SELECT vec_id, pattern, inverted FROM pat", True)
def canonical_pattern(spark, sf_dir):
    return tiles(spark, sf_dir).select("vec_id", "pattern", "inverted")


@query("pattern_popcount", "SELECT vec_id, bit_count(pattern)::INT AS n_set FROM pat", True)
def pattern_popcount(spark, sf_dir):
    return tiles(spark, sf_dir).select("vec_id", P.popcount("pattern").alias("n_set"))


@query("pattern_edges", "SELECT vec_id, bit_count(xor(pattern, pattern >> 1) & 9187201950435737471)::INT AS horizontal, bit_count(xor(pattern, pattern >> 8) & 72057594037927935)::INT AS vertical FROM pat", True)
def pattern_edges(spark, sf_dir):
    return tiles(spark, sf_dir).select("vec_id", P.horizontal_edges("pattern").alias("horizontal"), P.vertical_edges("pattern").alias("vertical"))


@query("pattern_density", "SELECT vec_id, r::INT AS row_no, bit_count((pattern >> (56 - 8 * r)::INT) & 255) / 8.0::DOUBLE AS density FROM pat, range(0, 8) t(r)", True)
def pattern_density(spark, sf_dir):
    rows = F.slice(P.density("pattern"), 2, 8)
    return tiles(spark, sf_dir).select("vec_id", F.posexplode(rows).alias("row_no", "density"))


@query("edge_map", "SELECT vec_id, pos, (CASE WHEN pos % 8 < 7 THEN ((pattern >> (63 - pos)::INT) & 1) <> ((pattern >> (62 - pos)::INT) & 1) ELSE false END)::INT + (CASE WHEN pos < 56 THEN ((pattern >> (63 - pos)::INT) & 1) <> ((pattern >> (55 - pos)::INT) & 1) ELSE false END)::INT AS edges FROM (SELECT vec_id, pattern, unnest(range(2, 64))::INT AS pos FROM pat)", True)
def edge_map(spark, sf_dir):
    at = tiles(spark, sf_dir).select("vec_id", F.posexplode(P.edge_descriptor("pattern")).alias("pos", "e")).where("pos >= 2")
    return at.select("vec_id", "pos", F.col("e").cast("int").alias("edges"))


@query("invert_roundtrip", "SELECT vec_id, xor(pattern, -1::BIGINT) AS inverse, least(bit_count(pattern), 64 - bit_count(pattern))::INT AS n_least, (SELECT sum(bit_count(xor(xor(a.pattern, -1::BIGINT), b.pattern)))::BIGINT FROM pat b WHERE b.label = a.label) AS total FROM pat a", True)
def invert_roundtrip(spark, sf_dir):
    """The inverse, its bits, and its summed distance to the tiles of its label: 64 less the pattern's own, tile by tile."""
    t = tiles(spark, sf_dir).select("vec_id", "label", "pattern")
    ones = t.select("label", F.posexplode(P.mask("pattern")).alias("pos", "bit")).groupBy("label", "pos").agg(F.count_if("bit").alias("ones"), F.count("*").alias("n"))
    by_label = ones.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "ones", "n"))).alias("o"))
    inverse = P.invert("pattern")
    met = t.join(by_label, "label").withColumn("m", P.mask(inverse))
    total = F.aggregate(F.zip_with("o", "m", lambda o, bit: F.when(bit, o["n"] - o["ones"]).otherwise(o["ones"])), F.lit(0).cast("long"), lambda s, x: s + x)
    return met.select("vec_id", inverse.alias("inverse"), F.least(P.popcount(inverse), 64 - P.popcount(inverse)).alias("n_least"), total.alias("total"))


@query("pattern_frequency", "SELECT pattern, cnt FROM cnt", True)
def pattern_frequency(spark, sf_dir):
    return G.pattern_frequency(tiles(spark, sf_dir))


@query("pattern_position_means", "SELECT pattern, pos::INT AS pos, round(avg(v), 6) AS mean_v, count(*) AS cnt FROM fg JOIN (SELECT vec_id, pattern FROM pat) p ON fg.vec_id = p.vec_id GROUP BY ALL", True)
def pattern_position_means(spark, sf_dir):
    return G.position_means(tiles(spark, sf_dir)).withColumn("mean_v", F.round("mean_v", 6))


@query("feature_zscore", "SELECT vec_id, round((bit_count(pattern) - avg(bit_count(pattern)) OVER ()) / (stddev_pop(bit_count(pattern)) OVER () + 1e-6), 6) AS z FROM pat", True)
def feature_zscore(spark, sf_dir):
    return G.zscore(tiles(spark, sf_dir).select("vec_id", P.popcount("pattern").cast("double").alias("z")), ["z"]).withColumn("z", F.round("z", 6))


@query("hamming_assign", """SELECT vec_id, m.dist, m.invert, m.medoid_id FROM (SELECT vec_id, min(struct_pack(dist := least(bit_count(xor(pat.pattern, gl.pattern)), 64 - bit_count(xor(pat.pattern, gl.pattern)))::INT, invert := (bit_count(xor(pat.pattern, gl.pattern)) > 32)::INT, medoid_id := medoid_id)) AS m FROM pat, gl GROUP BY vec_id)""", True)
def hamming_assign(spark, sf_dir):
    t = tiles(spark, sf_dir).select("vec_id", "pattern")
    return t.join(G.hamming_assign(t, G.top_glyphs(G.pattern_frequency(t), 64)), "pattern").select("vec_id", "dist", "invert", "medoid_id")


@query("hamming_assign_inverted", """SELECT vec_id, m.dist, m.invert, m.medoid_id FROM (SELECT vec_id, min(struct_pack(dist := least(bit_count(xor(xor(pat.pattern, -1::BIGINT), gl.pattern)), 64 - bit_count(xor(xor(pat.pattern, -1::BIGINT), gl.pattern)))::INT, invert := (bit_count(xor(xor(pat.pattern, -1::BIGINT), gl.pattern)) > 32)::INT, medoid_id := medoid_id)) AS m FROM pat, gl GROUP BY vec_id)""", True)
def hamming_assign_inverted(spark, sf_dir):
    """Inverses of the patterns meet the same glyphs inverted, but for ties at 32."""
    t = tiles(spark, sf_dir).select("vec_id", "pattern")
    own = t.select("vec_id", P.invert("pattern").alias("pattern"))
    return own.join(G.hamming_assign(own, G.top_glyphs(G.pattern_frequency(t), 64)), "pattern").select("vec_id", "dist", "invert", "medoid_id")


@query("role_centers", "SELECT vec_id, round(coalesce(avg(CASE WHEN f THEN v END), avg(v)), 6) AS fg_mean, round(coalesce(avg(CASE WHEN NOT f THEN v END), avg(v)), 6) AS bg_mean FROM fg GROUP BY vec_id", True)
def role_centers(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").withColumn("m", P.median64("embedding"))
    return C.role_centres(t, "vec_id", "embedding", "m").select("vec_id", F.round("fg_mean", 6).alias("fg_mean"), F.round("bg_mean", 6).alias("bg_mean"))


@query("flat_tiles", "SELECT vec_id, min(v) = max(v) AS flat FROM px GROUP BY vec_id", True)
def flat_tiles(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", P.flat("embedding").alias("flat"))


@query("cluster_medoid", """SELECT label, m.total, m.vec_id FROM (SELECT label, min(struct_pack(total := total, vec_id := vec_id)) AS m FROM (
  SELECT a.label, a.vec_id, sum(bit_count(xor(a.pattern, b.pattern)))::BIGINT AS total FROM pat a JOIN pat b ON a.label = b.label GROUP BY ALL) GROUP BY label)""", True)
def cluster_medoid(spark, sf_dir):
    return G.cluster_medoid(tiles(spark, sf_dir), "label", "vec_id").select("label", "total", "vec_id")


@query("coherent_patterns", "SELECT pattern >> 60 AS key, count(DISTINCT label) AS frames FROM pat GROUP BY 1 HAVING count(DISTINCT label) >= 2", True)
def coherent_patterns(spark, sf_dir):
    return G.coherent(tiles(spark, sf_dir).withColumn("key", F.shiftright("pattern", 60)), "label", "key")


@query("coherence_anti_join", "SELECT vec_id, pattern >> 56 AS key FROM pat WHERE pattern >> 56 NOT IN (SELECT pattern >> 56 FROM pat GROUP BY 1 HAVING count(DISTINCT label) >= 4)", True)
def coherence_anti_join(spark, sf_dir):
    t = tiles(spark, sf_dir).select("vec_id", "label", F.shiftright("pattern", 56).alias("key"))
    return t.join(G.coherent(t, "label", "key", 4), "key", "left_anti").select("vec_id", "key")


@query("pad_to_n", "SELECT i::INT AS medoid_id, coalesce(pattern, 0) AS pattern FROM range(0, 100) t(i) LEFT JOIN gl ON i = medoid_id", True)
def pad_to_n(spark, sf_dir):
    return G.pad_to(G.top_glyphs(G.pattern_frequency(tiles(spark, sf_dir)), 64), 100)


@query("ensure_zero_row", "SELECT medoid_id, CASE WHEN medoid_id = 0 THEN 0 ELSE pattern END AS pattern FROM gl", True)
def ensure_zero_row(spark, sf_dir):
    return G.ensure_zero(G.top_glyphs(G.pattern_frequency(tiles(spark, sf_dir)), 64))


#: The palette of the next two: mean luminance by part size, 50 entries, numbered by size.
_SIZES = "sz AS (SELECT p_size AS idx, round(avg(p_retailprice) / 20, 6) AS l, round(avg(p_partkey % 256), 6) AS m FROM part GROUP BY p_size)"
_MEANS = "mn AS (SELECT vec_id, round(avg(v), 6) * 100 AS l, round(max(v), 6) * 100 AS m FROM px GROUP BY vec_id)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.groupBy(F.col("p_size").alias("idx")).agg(F.round(F.avg("p_retailprice") / 20, 6).alias("l"), F.round(F.avg(F.col("p_partkey") % 256), 6).alias("m"))


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / 64
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.round(mean, 6) * 100).alias("l"), (F.round(F.array_max(v), 6) * 100).alias("m"))


@query("topk_neighbours", f", {_SIZES}, {_MEANS} SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY (mn.l - sz.l) * (mn.l - sz.l) + (mn.m - sz.m) * (mn.m - sz.m), idx) - 1)::INT AS rank, idx FROM mn, sz QUALIFY rank < 3", True)
def topk_neighbours(spark, sf_dir):
    return C.nearest(_means(spark, sf_dir), _sizes(spark, sf_dir), ["l", "m"], ["l", "m"], top=3, keys=("vec_id",)).select("vec_id", "rank", "idx")


@query("nearest_colour", f", {_SIZES}, {_MEANS} SELECT vec_id, m.idx, round(m.d, 4) AS dist FROM (SELECT vec_id, min(struct_pack(d := (mn.l - sz.l) * (mn.l - sz.l) + (mn.m - sz.m) * (mn.m - sz.m), idx := idx)) AS m FROM mn, sz GROUP BY vec_id)", True)
def nearest_colour(spark, sf_dir):
    return C.nearest(_means(spark, sf_dir), _sizes(spark, sf_dir), ["l", "m"], ["l", "m"], keys=("vec_id",)).select("vec_id", "idx", F.round("dist", 4).alias("dist"))


@query("nearest_label_centroid", """, c AS (SELECT label, pos, round(avg(v), 9) AS c FROM px GROUP BY label, pos), d AS (SELECT px.vec_id, c.label, round(sum((v - c) * (v - c)), 9) AS d FROM px JOIN c ON px.pos = c.pos GROUP BY px.vec_id, c.label)
SELECT vec_id, m.label AS nearest, m.d AS dist FROM (SELECT vec_id, min(struct_pack(d := d, label := label)) AS m FROM d GROUP BY vec_id)""", True)
def nearest_label_centroid(spark, sf_dir):
    """Labels are a few clusters; their centres are one broadcast table, counted before."""
    px = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "label", "pos", F.col("v").cast("double").alias("v"))
    centres = px.groupBy("label", "pos").agg(F.round(F.avg("v"), 9).alias("c")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "c"))).alias("c"))
    near = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").crossJoin(G.checked(centres))
    far = F.aggregate(F.zip_with("embedding", "c", lambda v, c: (v.cast("double") - c["c"]) * (v.cast("double") - c["c"])), F.lit(0.0), lambda s, x: s + x)
    best = near.groupBy("vec_id").agg(F.min(F.struct(F.round(far, 9).alias("d"), "label")).alias("m"))
    return best.select("vec_id", F.col("m.label").alias("nearest"), F.col("m.d").alias("dist"))


@query("stride_sample", "SELECT l_orderkey, l_linenumber, l_partkey % 256 AS r FROM lineitem WHERE (l_orderkey * 8 + l_linenumber) % 4 = 0")
def stride_sample(spark, sf_dir):
    px = table(spark, sf_dir, "lineitem").withColumn("pixel_idx", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return C.stride_sample(px).select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).alias("r"))


_RGB = "SELECT DISTINCT (l_partkey % 256)::INT AS r, (l_suppkey % 256)::INT AS g, (l_orderkey % 256)::INT AS b FROM lineitem"
_LIN = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92 ELSE power(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(*[(F.col(k) % 256).cast("int").alias(c) for k, c in (("l_partkey", "r"), ("l_suppkey", "g"), ("l_orderkey", "b"))])


def _rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).distinct()


def _sql_times(matrix: tuple, names: str) -> list[str]:
    return [" + ".join(f"({m}::DOUBLE) * {n}" for m, n in zip(row, names, strict=True)) for row in matrix]


_LINEAR = f"WITH rgb AS ({_RGB}), li AS (SELECT r, g, b, {_LIN.format('r')} AS x, {_LIN.format('g')} AS y, {_LIN.format('b')} AS z FROM rgb)"
_lms, _ok, _xyz = _sql_times(colour.LMS, "xyz"), _sql_times(colour.OKLAB, "lms"), _sql_times(colour.XYZ, "xyz")


@query("rgb_to_oklab", f"{_LINEAR}, q AS (SELECT r, g, b, cbrt({_lms[0]}) AS l, cbrt({_lms[1]}) AS m, cbrt({_lms[2]}) AS s FROM li) SELECT r, g, b, round({_ok[0]}, 6) AS ok_l, round({_ok[1]}, 6) AS ok_a, round({_ok[2]}, 6) AS ok_b FROM q")
def rgb_to_oklab(spark, sf_dir):
    c = colour.oklab(*[F.col(x) for x in "rgb"])
    return _rgb(spark, sf_dir).select("r", "g", "b", *[F.round(v, 6).alias(n) for v, n in zip(c, ("ok_l", "ok_a", "ok_b"), strict=True)])


_f = "CASE WHEN {0} > 0.008856 THEN cbrt({0}) ELSE {0} * 7.787 + 16.0::DOUBLE / 116.0 END"


@query("rgb_to_lab", f"{_LINEAR}, q AS (SELECT r, g, b, ({_xyz[0]}) / {colour.WHITE[0]}::DOUBLE AS u, {_xyz[1]} AS v, ({_xyz[2]}) / {colour.WHITE[2]}::DOUBLE AS w FROM li), f AS (SELECT r, g, b, {_f.format('u')} AS u, {_f.format('v')} AS v, {_f.format('w')} AS w FROM q) SELECT r, g, b, round(v * 116.0 - 16.0, 5) AS lab_l, round((u - v) * 500.0, 5) AS lab_a, round((v - w) * 200.0, 5) AS lab_b FROM f")
def rgb_to_lab(spark, sf_dir):
    c = colour.lab(*[F.col(x) for x in "rgb"])
    return _rgb(spark, sf_dir).select("r", "g", "b", *[F.round(v, 5).alias(n) for v, n in zip(c, ("lab_l", "lab_a", "lab_b"), strict=True)])


@query("weighted_colours", "SELECT (l_partkey % 256)::INT AS r, (l_suppkey % 256)::INT AS g, (l_orderkey % 256)::INT AS b, count(*) AS cnt FROM lineitem GROUP BY ALL")
def weighted_colours(spark, sf_dir):
    return C.weighted_colours(_pixels(spark, sf_dir))


@query("rgb_luminance", "SELECT DISTINCT (l_partkey % 256)::INT AS r, (l_suppkey % 256)::INT AS g, (l_orderkey % 256)::INT AS b, ((l_partkey % 256) * 299 + (l_suppkey % 256) * 587 + (l_orderkey % 256) * 114)::INT AS lum FROM lineitem")
def rgb_luminance(spark, sf_dir):
    return _rgb(spark, sf_dir).select("r", "g", "b", colour.luminance_1000(F.col("r"), F.col("g"), F.col("b")).alias("lum"))


def _palette(spark: SparkSession, sf_dir: str, part: int) -> DataFrame:
    p = table(spark, sf_dir, "part").where(F.col("p_partkey") % 2 == part)
    return p.select((F.col("p_partkey") % 256).cast("int").alias("idx"), (F.col("p_size") * 5).cast("int").alias("r"), (F.col("p_size") * 3).cast("int").alias("g"), F.col("p_size").cast("int").alias("b"))


@query("palette_merge_distinct", "SELECT DISTINCT p_size * 5 AS r, p_size * 3 AS g, p_size AS b FROM part WHERE p_partkey % 256 > 0")
def palette_merge_distinct(spark, sf_dir):
    return C.merged(_palette(spark, sf_dir, 0), _palette(spark, sf_dir, 1))


@query("interleave_luts", "SELECT p_size AS c, ((row_number() OVER (ORDER BY p_size * 299, p_size) - 1) % 2)::INT AS lut, ((row_number() OVER (ORDER BY p_size * 299, p_size) - 1) // 2 + 1)::INT AS idx FROM (SELECT DISTINCT p_size FROM part)")
def interleave_luts(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.col("p_size").alias("c")).distinct().withColumn("lum", colour.luminance_1000(F.col("c"), F.lit(0), F.lit(0)))
    return C.interleave(c, "lum", ["c"]).drop("lum")


@query("font_slot", "SELECT p_partkey, ((p_partkey % 1024) // 256)::INT AS font_set, (p_partkey % 256)::INT AS char_idx, (((p_partkey % 1024) // 256 + (p_partkey % 3 % 2) * 2) % 4)::INT AS bank FROM part")
def font_slot(spark, sf_dir):
    font, char = W.font_slot(F.col("p_partkey") % 1024)
    return table(spark, sf_dir, "part").select("p_partkey", font.alias("font_set"), char.alias("char_idx"), W.font_bank(font, F.col("p_partkey") % 3).cast("int").alias("bank"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    bit = lambda c, n, m: F.shiftright(F.col(c), n).bitwiseAND(F.lit(m)).cast("int")
    word = W.char_word(bit("l_partkey", 0, 255), bit("l_suppkey", 0, 3), bit("l_orderkey", 0, 1), bit("l_orderkey", 1, 1), bit("l_suppkey", 2, 1))
    return li.select("l_orderkey", "l_linenumber", word.alias("char_word"), W.colour_word(bit("l_partkey", 0, 255), bit("l_suppkey", 0, 255)).alias("colour_word"))


_WORD = "((l_partkey & 255) | ((l_suppkey & 3) << 8) | ((l_orderkey & 1) << 10) | (((l_orderkey >> 1) & 1) << 11) | (((l_suppkey >> 2) & 1) << 12))::INT"


@query("char_word_pack", f"SELECT l_orderkey, l_linenumber, {_WORD} AS char_word, (((l_partkey & 255) << 8) | (l_suppkey & 255))::INT AS colour_word FROM lineitem")
def char_word_pack(spark, sf_dir):
    return _cells(spark, sf_dir)


@query("char_word_unpack", f"SELECT l_orderkey, l_linenumber, w & 255 AS char_idx, (w >> 8) & 3 AS font_set, (w >> 10) & 1 AS fg_lut, (w >> 11) & 1 AS bg_lut, (w >> 12) & 1 AS invert FROM (SELECT l_orderkey, l_linenumber, {_WORD} AS w FROM lineitem)")
def char_word_unpack(spark, sf_dir):
    return _cells(spark, sf_dir).select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in W.char_fields(F.col("char_word")).items()])


@query("chunk_split", "SELECT (o_orderkey % 4800 // 1024)::INT AS chunk, count(*) AS n, min(o_orderkey % 4800 % 1024 * 2)::INT AS first_byte, max(o_orderkey % 4800 % 1024 * 2)::INT AS last_byte FROM orders GROUP BY 1")
def chunk_split(spark, sf_dir):
    at, byte = W.chunk_of(F.col("o_orderkey") % 4800)
    return table(spark, sf_dir, "orders").select(at.alias("chunk"), byte.alias("byte")).groupBy("chunk").agg(F.count("*").alias("n"), F.min("byte").alias("first_byte"), F.max("byte").alias("last_byte"))


@query("lut_chunk_ids", "SELECT p_partkey, (p_partkey & 1)::INT AS fg_id, ((p_partkey & 1) + 2)::INT AS bg_id, (CASE WHEN p_partkey % 4 < 2 THEN p_partkey % 4 ELSE p_partkey % 4 - 2 + 2 END)::INT AS list_id FROM part")
def lut_chunk_ids(spark, sf_dir):
    fg, bg = W.lut_chunk_ids(F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", fg.cast("int").alias("fg_id"), bg.cast("int").alias("bg_id"), W.palette_chunk_id(F.col("p_partkey") % 4, F.lit(2)).cast("int").alias("list_id"))


@query("lut_bytes", "SELECT p_brand, string_agg(lpad(hex(b), 2, '0') || lpad(hex(g), 2, '0') || lpad(hex(r), 2, '0') || (CASE WHEN i = 1 THEN '00' ELSE 'FF' END), '' ORDER BY i) AS lut FROM (SELECT p_brand, p_size AS r, p_size * 3 AS g, p_size * 5 AS b, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS i FROM (SELECT DISTINCT p_brand, p_size FROM part)) GROUP BY p_brand")
def lut_bytes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_size").distinct().groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct(F.col("p_size").alias("r"), (F.col("p_size") * 3).alias("g"), (F.col("p_size") * 5).alias("b")))).alias("c"))
    return p.select("p_brand", F.hex(W.lut_bytes(F.col("c"))).alias("lut"))


_RUNS = """
WITH a AS (SELECT user_id, event_type, ts, event_id, row_number() OVER w AS rn, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum((rn = 1 OR event_type IS DISTINCT FROM before)::INT) OVER (PARTITION BY user_id ORDER BY rn) - 1 AS run FROM a),
r AS (SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, min(rn) - 1 AS start, count(*) AS n FROM b GROUP BY user_id, run)
"""


@query("rle_runs", _RUNS + "SELECT * FROM r")
def rle_runs(spark, sf_dir):
    return R.runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("rle_segments", _RUNS + ", s AS (SELECT *, CASE WHEN n = 1 AND lag(n) OVER (PARTITION BY user_id ORDER BY run) = 1 THEN 0 ELSE 1 END AS new FROM r), t AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY run) - 1 AS segment FROM s) SELECT user_id, segment::BIGINT AS segment, (max(n) = 1)::INT AS literal, sum(n)::BIGINT AS words FROM t GROUP BY user_id, segment")
def rle_segments(spark, sf_dir):
    return R.segments(rle_runs(spark, sf_dir), "user_id")


@query("lut_state_asof", "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM events")
def lut_state_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", R.last_known(e, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value"))).alias("state"))


@query("frame_parity", "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INT AS frame_idx, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) % 2)::INT AS lut_id, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) % 2 * 2)::INT AS font_base FROM orders")
def frame_parity(spark, sf_dir):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return table(spark, sf_dir, "orders").select("o_orderkey", i.alias("frame_idx")).select("o_orderkey", "frame_idx", (F.col("frame_idx") % 2).alias("lut_id"), (F.col("frame_idx") % 2 * 2).alias("font_base"))


@query("reconstruct_cell", ", c AS (SELECT vec_id, avg(CASE WHEN f THEN v END) AS a, avg(CASE WHEN NOT f THEN v END) AS b FROM fg GROUP BY vec_id) SELECT fg.vec_id, round(sum(power(v - coalesce(CASE WHEN f THEN a ELSE b END, 0), 2)), 6) AS sse FROM fg JOIN c ON fg.vec_id = c.vec_id GROUP BY fg.vec_id", True)
def reconstruct_cell(spark, sf_dir):
    t = tiles(spark, sf_dir).withColumn("m", P.median64("embedding"))
    centres = C.role_centres(t, "vec_id", "embedding", "m")
    on = F.getbit("pattern", 63 - F.col("pos")).cast("boolean") != F.col("inverted")
    v = F.col("v").cast("double")
    px = t.select("vec_id", "pattern", "inverted", F.posexplode("embedding").alias("pos", "v")).join(centres, "vec_id")
    return px.groupBy("vec_id").agg(F.round(F.sum(F.pow(v - F.when(on, F.col("fg_mean")).otherwise(F.col("bg_mean")), F.lit(2.0))), 6).alias("sse"))


@query("reconstruction_sse", """, c AS (SELECT vec_id, coalesce(avg(CASE WHEN f THEN v END), avg(v)) AS a, coalesce(avg(CASE WHEN NOT f THEN v END), avg(v)) AS b FROM fg GROUP BY vec_id),
e AS (SELECT fg.vec_id, medoid_id, sum(power(v - CASE WHEN (gl.pattern >> (63 - pos)::INT) & 1 = 1 THEN a ELSE b END, 2)) AS n, sum(power(v - CASE WHEN (gl.pattern >> (63 - pos)::INT) & 1 = 1 THEN b ELSE a END, 2)) AS i FROM fg JOIN c ON fg.vec_id = c.vec_id CROSS JOIN gl GROUP BY fg.vec_id, medoid_id)
SELECT vec_id, round(min(least(n, i)), 6) AS sse FROM e GROUP BY vec_id""", True)
def reconstruction_sse(spark, sf_dir):
    """The least error of a tile drawn in its two mean values by any of 64 glyphs, normal or inverted: all background, and what the set bits gain."""
    t = tiles(spark, sf_dir).withColumn("m", P.median64("embedding"))
    g = G.top_glyphs(G.pattern_frequency(t), 64).select("medoid_id", P.mask("pattern").alias("bits"))
    v = F.transform("embedding", lambda x: x.cast("double"))
    both = t.select("vec_id", "embedding").join(C.role_centres(t, "vec_id", "embedding", "m"), "vec_id")
    errors = lambda c: F.transform(v, lambda x: (x - F.col(c)) * (x - F.col(c)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    at = both.select("vec_id", errors("fg_mean").alias("up"), errors("bg_mean").alias("down"))
    at = at.select("vec_id", total(F.col("up")).alias("all_up"), total(F.col("down")).alias("all_down"), F.zip_with("up", "down", lambda a, b: a - b).alias("gain"))
    gained = total(F.zip_with("gain", "bits", lambda x, bit: F.when(bit, x).otherwise(0.0)))
    met = at.crossJoin(G.checked(g)).withColumn("gained", gained)
    return met.groupBy("vec_id").agg(F.round(F.min(F.least(F.col("all_down") + F.col("gained"), F.col("all_up") - F.col("gained"))), 6).alias("sse"))


def _denoised() -> str:
    """Islands by recursion: each bit reaches those of its value next to it; set islands of up to two go, then clear ones."""
    tiles_ = TILES.replace("WITH px", "WITH RECURSIVE px", 1)

    def without(given: str, value: str, out: str) -> str:
        return f"""
{out}_r(vec_id, pos, reached) AS (
  SELECT vec_id, pos, pos FROM {given} WHERE {value} UNION
  SELECT r.vec_id, r.pos, b.pos FROM {out}_r r JOIN {given} b ON r.vec_id = b.vec_id AND {value} AND abs(r.reached // 8 - b.pos // 8) <= 1 AND abs(r.reached % 8 - b.pos % 8) <= 1
),
{out}_n AS (SELECT vec_id, pos, count(*) AS n FROM {out}_r GROUP BY vec_id, pos),
{out} AS (SELECT b.vec_id, b.pos, CASE WHEN n <= 2 THEN NOT bit ELSE bit END AS bit FROM {given} b LEFT JOIN {out}_n n ON b.vec_id = n.vec_id AND b.pos = n.pos)"""

    return f"""{tiles_}
, b0 AS (SELECT vec_id, pos, (pattern >> (63 - pos)::INT) & 1 = 1 AS bit FROM (SELECT vec_id, pattern, unnest(range(0, 64))::INT AS pos FROM pat WHERE pattern <> 0)),
{without("b0", "bit", "b1")}, {without("b1", "NOT bit", "b2")},
c AS (SELECT vec_id, sum(CASE WHEN NOT bit THEN 0::HUGEINT WHEN pos = 0 THEN -9223372036854775808::HUGEINT ELSE (1::BIGINT << (63 - pos)::INT)::HUGEINT END)::BIGINT AS pattern FROM b2 GROUP BY vec_id)
SELECT pat.vec_id, coalesce(c.pattern, 0) AS pattern, coalesce(c.pattern <> pat.pattern, false) AS changed FROM pat LEFT JOIN c ON pat.vec_id = c.vec_id"""


@query("denoise_patterns", _denoised())
def denoise_patterns(spark, sf_dir):
    """Distinct patterns are cleaned, and joined back."""
    t = tiles(spark, sf_dir).select("vec_id", "pattern")
    clean = G.denoise_glyphs(t.select("pattern").distinct().withColumn("was", F.col("pattern")), 2)
    return t.withColumnRenamed("pattern", "was").join(clean, "was").select("vec_id", "pattern", "changed")


@query("kmeans_glyphs")
def kmeans_glyphs(spark, sf_dir):
    return G.kmeans_glyphs(G.pattern_frequency(tiles(spark, sf_dir)), 64)


@query("kmeans_palette")
def kmeans_palette(spark, sf_dir):
    return C.kmeans_palette(C.weighted_colours(_pixels(spark, sf_dir)))


#: A document's UTF-8 bytes as 16-bit words: runs of equal words, then segments, and their bytes in the coded form.
def _coded(unit: int) -> str:
    value = "substr(h, (2 * i - 1)::INT, 2)" if unit == 1 else "substr(h, (4 * i - 1)::INT, 2) || substr(h, (4 * i - 3)::INT, 2)"
    longest = 0x7F if unit == 1 else 0x7FFF
    digits = 2 * unit
    turn = "x" if unit == 1 else "substr(x, 3, 2) || substr(x, 1, 2)"
    coded = "printf('%02X', c)" if unit == 1 else "printf('%02X%02X', c & 255, c >> 8)"
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, {value} AS x FROM (SELECT doc_id, h, unnest(range(1, length(h) // {digits} + 1)) AS i FROM d)),
a AS (SELECT *, CASE WHEN i = 1 OR x <> lag(x) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM w),
r AS (SELECT doc_id, run, min(i) AS i, count(*) AS n, any_value(x) AS x FROM (SELECT doc_id, i, x, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM a) GROUP BY doc_id, run),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY run) AS seg FROM (SELECT *, CASE WHEN n = 1 AND lag(n) OVER (PARTITION BY doc_id ORDER BY run) = 1 THEN 0 ELSE 1 END AS new FROM r)),
p AS (SELECT doc_id, seg, n > 1 AS several, CASE WHEN n > 1 THEN unnest(range(0, n, {longest})) ELSE (row_number() OVER (PARTITION BY doc_id, seg ORDER BY i) - 1) // {longest} * {longest} END AS at_, i, n, x FROM s),
c AS (SELECT doc_id, seg, at_, CASE WHEN any_value(several) THEN least({longest}, any_value(n) - at_) ELSE {longest + 1} | count(*) END::INT AS c, string_agg({turn}, '' ORDER BY i) AS words FROM p GROUP BY doc_id, seg, at_),
o AS (SELECT doc_id, string_agg({coded} || words, '' ORDER BY seg, at_) AS coded FROM c GROUP BY doc_id)
SELECT d.doc_id, (length(coalesce(coded, '')) // 2)::BIGINT AS n_coded, sha256(coalesce(coded, '')) AS coded_sha256, sha256(substr(h, 1, length(h) // {digits} * {digits})) AS back_sha256 FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""


def _round_trip(spark: SparkSession, sf_dir: str, unit: int) -> DataFrame:
    """Each document's whole bytes as words or bytes: the coded form's length and digest, and the digest of what it decodes to."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda x: hashlib.sha256(x.hex().upper().encode()).hexdigest()
        for part in it:
            out = []
            for data in part["data"]:
                if unit == 2:
                    words = np.frombuffer(data[: len(data) // 2 * 2], "<u2")
                    coded = R.encode_words(words)
                    back = R.decode_words(coded, len(words)).tobytes()
                else:
                    coded = R.encode_bytes(data)
                    back = R.decode_bytes(coded, len(data))
                out.append((len(coded), sha(coded), sha(back)))
            yield pd.DataFrame(out, columns=["n_coded", "coded_sha256", "back_sha256"]).assign(doc_id=part["doc_id"].to_numpy())[["doc_id", "n_coded", "coded_sha256", "back_sha256"]]

    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    return docs.mapInPandas(run, "doc_id long, n_coded long, coded_sha256 string, back_sha256 string")


@query("rle_words_roundtrip", _coded(2))
def rle_words_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, 2)


@query("rle_bytes_roundtrip", _coded(1))
def rle_bytes_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, 1)


@query(
    "container_roundtrip",
    """
WITH o AS (SELECT o_orderkey // 4800 AS frame, (o_orderkey % 4800)::INT AS tile, ((o_custkey * 7 + o_orderkey) % 8192)::INT AS cw, ((o_custkey * 31) % 65536)::INT AS kw FROM orders),
f AS (SELECT DISTINCT frame FROM o), g AS (SELECT frame, unnest(range(0, 4800))::INT AS tile FROM f),
c AS (SELECT g.frame, g.tile, coalesce(cw, 0) AS cw, coalesce(kw, 0) AS kw FROM g LEFT JOIN o ON g.frame = o.frame AND g.tile = o.tile),
b AS (SELECT frame, tile // 1024 AS id, kind, string_agg(printf('%02X%02X', v & 255, v >> 8), '' ORDER BY tile) AS data FROM (SELECT frame, tile, 3 AS kind, cw AS v FROM c UNION ALL SELECT frame, tile, 4, kw FROM c) GROUP BY ALL)
SELECT frame::BIGINT AS frame, kind::INT AS type, id::INT AS id, (length(data) // 2)::INT AS length, sha256(data) AS data_sha256 FROM b""",
)
def container_roundtrip(spark, sf_dir):
    """Cells from orders, 4,800 to a frame, written as run-length coded chunks, parsed and decoded again."""
    o = table(spark, sf_dir, "orders")
    cells = o.select(F.floor(F.col("o_orderkey") / 4800).cast("int").alias("frame_idx"), (F.col("o_orderkey") % 4800).cast("int").alias("tile_idx"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 8192).cast("int").alias("char_word"), ((F.col("o_custkey") * 31) % 65536).cast("int").alias("colour_word"))
    every = cells.select("frame_idx").distinct().select("frame_idx", F.explode(F.sequence(F.lit(0), F.lit(4799))).alias("tile_idx"))
    full = every.join(cells, ["frame_idx", "tile_idx"], "left").select("frame_idx", "tile_idx", F.coalesce("char_word", F.lit(0)).alias("char_word"), F.coalesce("colour_word", F.lit(0)).alias("colour_word"))
    bodies = S.assignments_to_frames(full, rle=True)

    def parsed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = {S.CHARS_RLE: S.CHARS, S.COLOURS_RLE: S.COLOURS}
        for part in it:
            rows = []
            for frame, body in zip(part["frame_idx"], part["body"], strict=True):
                for _, _, kind, ident, data in S.chunks(S.header() + body):
                    if kind in plain:
                        words = R.decode_words(data, min(S.CHUNK_WORDS, S.CELLS - ident * S.CHUNK_WORDS)).tobytes()
                        rows.append((frame, plain[kind], ident, len(words), hashlib.sha256(words.hex().upper().encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["frame", "type", "id", "length", "data_sha256"])

    return bodies.mapInPandas(parsed, "frame long, type int, id int, length int, data_sha256 string")


def _image_sql() -> str:
    """Twice as wide and high by Lanczos: weights by formula, rows first, rounded in between."""
    weight = lambda o, s: f"(CASE WHEN abs({s} + 0.5 - ({o} + 0.5) / 2) >= 3 THEN 0 WHEN {s} + 0.5 = ({o} + 0.5) / 2 THEN 1 ELSE 3 * sin(pi() * ({s} + 0.5 - ({o} + 0.5) / 2)) * sin(pi() * ({s} + 0.5 - ({o} + 0.5) / 2) / 3) / pow(pi() * ({s} + 0.5 - ({o} + 0.5) / 2), 2) END)"
    return f"""
, b AS (SELECT vec_id, pos // 8 AS y, pos % 8 AS x, floor((v - lo) / (hi - lo) * 255) AS v FROM (SELECT px.*, min(v) OVER (PARTITION BY vec_id) AS lo, max(v) OVER (PARTITION BY vec_id) AS hi FROM px)),
w AS (SELECT o, s, k / sum(k) OVER (PARTITION BY o) AS k FROM (SELECT o, s, {weight("o", "s")} AS k FROM range(0, 16) t(o), range(0, 8) u(s))),
r AS (SELECT vec_id, o AS y, x, greatest(0, least(255, round_even(round(sum(v * k), 9), 0))) AS v FROM b JOIN w ON b.y = w.s GROUP BY ALL),
c AS (SELECT vec_id, y, o AS x, greatest(0, least(255, round_even(round(sum(v * k), 9), 0))) AS v FROM r JOIN w ON r.x = w.s GROUP BY ALL)
SELECT vec_id, y::INT AS y, string_agg(v::INT::VARCHAR, ' ' ORDER BY x) AS pixels FROM c GROUP BY vec_id, y"""


@query("image_scale", _image_sql(), True)
def image_scale(spark, sf_dir):
    """Tiles as 8x8 grey images, stretched to 0-255, scaled to 16x16."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            rows = []
            for vec, values in zip(part["vec_id"], part["embedding"], strict=True):
                v = np.asarray(values, np.float64)
                img = np.floor((v - v.min()) / (v.max() - v.min()) * 255).astype(np.uint8).reshape(8, 8, 1)
                rows += [(vec, y, " ".join(map(str, line))) for y, line in enumerate(I.resize(img, 16, 16)[:, :, 0].tolist())]
            yield pd.DataFrame(rows, columns=["vec_id", "y", "pixels"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, y int, pixels string")
