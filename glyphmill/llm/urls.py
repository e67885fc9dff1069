"""URL rules decided by a Bloom filter cascade, in Spark SQL expressions only.

A rule's shape is the number of its host's labels and the length of its path. A page has one candidate
key for each shape that some rule has: so many last labels of its host, with so many first characters
of its path. The corpus's candidate keys are the whole universe that is ever asked, so a cascade is
exact: level 0 holds the listed keys; level 1 the keys of the universe that level 0 takes for listed
and aren't; level 2 the listed keys that level 1 takes for those; and so on until a level has no false
positive. Block rules and allow rules have a cascade each.

A level is a bitmap in pages, the value of a scalar subquery, so pages are judged where they are read,
without join or shuffle, and the plan's size doesn't follow the levels'.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import ascii_lower, materialize

HASHES = 4
BITS_PER_KEY = 32
LEAST_BITS = 1 << 20
PAGE = 1 << 16


def host_of(url: Column | str) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, ascii_lower(F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*", 0))), F.lit(""))


def path_of(url: Column | str) -> Column:
    """From after the host to ``?``, ``#`` or the end; empty where there is no ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def shaped_key(host: Column, path: Column, labels: int, length: int) -> Column:
    """The last ``labels`` labels of the host with the first ``length`` characters of the path; null where there are fewer. Linear in the host's length."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    key = F.concat(F.call_function("substring_index", host, F.lit("."), F.lit(-labels)), F.substring(path, 1, length))
    return F.when((dots >= labels - 1) & (F.length(path) >= length), key)


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * HASHES + k), key), F.lit(bits)) for k in range(HASHES)]


class Cascade:
    """Exact membership in ``listed`` (one string column) for the keys of ``universe`` (one string column).

    A level has 32 bits a key and 2**20 at least, so that it takes about one key in ten thousand of
    those it doesn't hold, and of a short list none; there is no bound on the number of keys. The
    universe is read once, for level 0; the few keys that it takes are written and serve the rest.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        listed = listed.toDF("key").where("key is not null").distinct()
        if self._add(listed):
            self._end(listed, materialize(universe.toDF("key").where(self._holds(F.col("key"), 0)).distinct()))

    @classmethod
    def several(cls, listed: dict[str, DataFrame], universe: DataFrame) -> dict[str, Cascade]:
        """A cascade for each name, without those that list nothing, from one pass over the universe."""
        out, keys = {}, {}
        for name, own in listed.items():
            cascade = cls.__new__(cls)
            cascade.levels, keys[name] = [], own.toDF("key").where("key is not null").distinct()
            if cascade._add(keys[name]):
                out[name] = cascade
        if out:
            taken = reduce(lambda a, b: a | b, [c._holds(F.col("key"), 0) for c in out.values()])
            few = materialize(universe.toDF("key").where(taken).distinct())
            for name, cascade in out.items():
                cascade._end(keys[name], few.where(cascade._holds(F.col("key"), 0)))
        return out

    def _end(self, listed: DataFrame, taken: DataFrame) -> None:
        encoded, other = materialize(taken.join(listed, "key", "left_anti")), listed
        while self._add(encoded):
            if len(self.levels) > 64:
                raise RuntimeError("the cascade did not end")
            encoded, other = materialize(other.where(self._holds(F.col("key"), len(self.levels) - 1))), encoded

    def _add(self, encoded: DataFrame) -> int:
        """A level of the keys, unless there are none; their number."""
        n, level = encoded.count(), len(self.levels)
        if n:
            bits = max(LEAST_BITS, 1 << (n * BITS_PER_KEY - 1).bit_length())
            at = encoded.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("at"))
            words = at.groupBy(F.expr("at div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("b"))
            every = encoded.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("w"), "left").select(F.expr(f"id div {PAGE // 64}").alias("page"), "id", F.coalesce("b", F.lit(0)).alias("b"))
            in_order = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value])
            pages = every.groupBy("page").agg(in_order("id", "b").alias("words"))
            self.levels.append((bits, materialize(pages.agg(in_order("page", "words").alias("pages")), 1)))
        return n

    def _holds(self, key: Column, level: int) -> Column:
        bits, table = self.levels[level]
        pages = table.scalar()
        word = lambda p: F.get(F.get(pages, F.floor(p / PAGE).cast("int")), F.floor((p % PAGE) / 64).cast("int"))
        return reduce(lambda a, b: a & b, [F.getbit(word(p), (p % 64).cast("int")) == 1 for p in _positions(key, level, bits)])

    def holds(self, key: Column) -> Column:
        """True for listed keys, false for the universe's others: the first level that denies a key decides by its parity."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~self._holds(key, level), F.lit(level % 2 == 1)).otherwise(out)
        return out


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(``verdict``, ``host``, ``path``) as literals of the plan, without Python rows."""
    if not rules:
        return spark.sql("SELECT '' AS verdict, '' AS host, '' AS path WHERE false")
    each = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.explode(each).alias("r")).select("r.*")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """(``page_id``, ``host``, ``path``, ``rule``, ``verdict``) for each row of ``pages`` (``page_id``, ``url``, others ignored).

    ``rules`` are (verdict, host, path), a list or for long lists a table; one fits its host and all
    subdomains if the url's path starts with its path. The longest fitting rule decides, by the length
    of host and path together, then of the host, then block before allow. Where none fits, ``rule`` is
    null and the verdict allow. A null url or one without ``://`` has an empty host and path, which
    only a rule with an empty host could fit. Repeated rows are judged each; an empty table gives no rows.
    """
    spark = pages.sparkSession
    listed = rule_table(spark, rules) if isinstance(rules, list) else rules.select("verdict", "host", "path")
    listed = materialize(listed.select("verdict", F.concat("host", "path").alias("key"), (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("labels"), F.length("path").alias("length")), 8)
    shapes = sorted((r.labels, r.length) for r in listed.select("labels", "length").distinct().collect())  # as many as rules' shapes, not rules
    split = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    names = [f"key_{d}_{n}" for d, n in shapes]
    keyed = split.select("*", *[shaped_key(F.col("host"), F.col("path"), d, n).alias(name) for (d, n), name in zip(shapes, names, strict=True)])
    if not shapes:
        return split.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    universe = keyed.select(F.explode(F.array(*names)).alias("key")).where("key is not null")
    cascades = Cascade.several({v: listed.where(F.col("verdict") == v).select("key") for v in ("block", "allow")}, universe)
    fitting = []
    for (_, n), name in zip(shapes, names, strict=True):
        verdict = reduce(lambda rest, v: F.when(cascades[v].holds(F.col(name)), v).otherwise(rest), [v for v in ("allow", "block") if v in cascades], F.lit(None).cast("string"))  # noqa: B023
        size = F.length(name)
        fitting.append(F.when(F.col(name).isNotNull() & verdict.isNotNull(), F.struct(size.alias("size"), (size - n).alias("hosted"), F.col(name).alias("rule"), verdict.alias("verdict"))))
    best = fitting[0] if len(fitting) == 1 else F.greatest(*fitting)
    out = keyed.select("page_id", "host", "path", best.alias("best"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
