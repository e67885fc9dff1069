"""Benchmark decontamination as a prefix-filtered set join, in Spark SQL expressions only.

An item's windows are its runs of ten words; containment of a window is exact, so one necessary
token is prefix enough: the window's rarest word by its count over the whole corpus. A bitmap of
these words picks the few places of a document that are worth a look; only they leave the row, with
the words around them. The join on the word gives the window and its offset in it; the position
bound asks that the window fits into the document there, and the words decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import ascii_lower, files_for, materialize

WINDOW = 10
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 20  # positions of the bitmap of rare words; a full one only lets more places pass
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 1 << 18, 32 << 20  # beyond either, a join shuffles
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column | str) -> Column:
    """Runs of digits, a-z (A-Z lower-cased) and characters beyond 7F; none for null."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), BREAK, -1), "")


def windows(items: DataFrame) -> DataFrame:
    """(``item_id``, ``window``) distinct: each run of ten consecutive words; of a shorter item all its words."""
    w = items.select("item_id", words_of("text").alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - WINDOW, F.lit(0))
    return w.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("item_id", F.slice("w", F.col("at") + 1, WINDOW).alias("window")).distinct()


def _small(df: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Broadcast a side whose rows and bytes, counted, are within the bounds; beyond them the join shuffles."""
    return F.broadcast(df) if size[0] <= MAX_BROADCAST_ROWS and size[1] <= MAX_BROADCAST_BYTES else df


def _size(df: DataFrame, length: Column) -> tuple[int, int]:
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(length), F.lit(0))).first()
    return n, size


def _in_bitmap(words: DataFrame, column: str, n: int) -> Callable[[Column], Column]:
    """A test of a word by a bitmap of 32 positions a word, from LEAST_BITS to MOST_BITS: a literal of 128 kB at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * n).bit_length()))
    got = dict(words.select(F.pmod(F.xxhash64(column), F.lit(bits)).alias("at")).groupBy(F.expr("at div 64")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))")).collect())
    table = F.lit([got.get(i, 0) for i in range(bits // 64)]).cast("array<bigint>")
    return lambda w: F.getbit(F.get(table, F.floor(F.pmod(F.xxhash64(w), F.lit(bits)) / 64).cast("int")), F.pmod(F.xxhash64(w), F.lit(64)).cast("int")) == 1


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document (``doc_id``, ``n_words``, ``n_hit``, ``item_ids``): as ``contamination``, without ``n_items``."""
    return contamination(docs, items).drop("n_items")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document (``doc_id``, ``n_words``, ``n_hit``, ``item_ids``, ``n_items``): words inside any occurrence of a window, and the items with one.

    ``docs`` has ``doc_id`` and ``text``, ``items`` ``item_id`` and ``text``; other columns are
    ignored. Null or empty texts have no words. Each row is judged by its own text, also where ids
    repeat or are null; items that repeat count once. Items with a null item_id hit as the others;
    they are not in ``item_ids`` and are one item in ``n_items``. Without items nothing is hit;
    without documents there are no rows.
    """
    docs = docs.select("doc_id", "text")
    files = files_for(docs.sparkSession)
    windowed = materialize(windows(items.select(F.col("item_id").cast("string").alias("item_id"), "text")), files)
    vocabulary = materialize(windowed.select(F.explode("window").alias("word")).distinct(), files)
    n_vocabulary = _size(vocabulary, F.octet_length("word"))

    # rarity: how often each benchmark word occurs in all documents
    said = docs.select(F.explode(words_of("text")).alias("word")).join(_small(vocabulary, n_vocabulary), "word").groupBy("word").agg(F.count("*").alias("times"))
    times = vocabulary.join(said, "word", "left").select("word", F.coalesce("times", F.lit(0)).alias("times"))
    keyed = windowed.select("item_id", "window", F.posexplode("window").alias("off", "word")).join(_small(times, n_vocabulary), "word")
    rarest = materialize(keyed.groupBy("item_id", "window").agg(F.min(F.struct("times", "word", "off")).alias("r")).select("item_id", "window", F.size("window").alias("k"), "r.word", "r.off"), files)
    by_window = materialize(rarest.groupBy("window", "k", "word", "off").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.bool_or(F.col("item_id").isNull()).alias("unnamed")), files)

    rare = materialize(by_window.select("word").distinct(), files)
    likely = _in_bitmap(rare, "word", rare.count())
    n_windows = _size(by_window, F.octet_length(F.array_join("window", " ")) + F.coalesce(F.octet_length(F.array_join("item_ids", " ")), F.lit(0)))
    # a number for the row; not deterministic to the optimizer, which else would compute the words once an element
    w = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of("text").alias("w"))
    w = w.select("row", "doc_id", F.when(F.col("row") >= 0, F.col("w")).alias("w"))
    places = F.filter(F.transform("w", lambda x, i: F.when(likely(x), i)), lambda i: i.isNotNull())
    around = F.transform(places, lambda i: F.struct(i.alias("at"), F.get("w", i).alias("word"), F.greatest(i - (WINDOW - 1), F.lit(0)).alias("lo"), F.slice("w", F.greatest(i - (WINDOW - 2), F.lit(1)), 2 * WINDOW - 1).alias("near")))
    p = w.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.explode_outer(around).alias("p")).select("row", "doc_id", "n_words", "p.*")
    start = F.col("at") - F.col("off")
    met = p.join(_small(by_window.withColumnRenamed("word", "rare"), n_windows), (F.col("word") == F.col("rare")) & (start >= 0) & (start + F.col("k") <= F.col("n_words")) & (F.slice("near", start - F.col("lo") + 1, F.col("k")) == F.col("window")), "left")
    # the hits of one row of documents: a row for each place of a window, merged before the shuffle
    hits = met.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.collect_set(F.when(F.col("k").isNotNull(), F.struct(start.alias("at"), "k"))).alias("hits"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"), F.coalesce(F.bool_or("unnamed"), F.lit(False)).alias("unnamed"))
    inside = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["k"] - 1))))
    return hits.select("doc_id", "n_words", F.size(inside).cast("long").alias("n_hit"), F.sort_array("item_ids").alias("item_ids"), (F.size("item_ids") + F.col("unnamed").cast("int")).cast("long").alias("n_items"))
