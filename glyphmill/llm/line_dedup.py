"""Deletion of later copies of repeated line runs: a suffix array over line ids by prefix doubling, and its LCP intervals.

The corpus is a sequence of line ids. A suffix's rank by its first ``2k`` lines follows from the ranks
by ``k`` lines of itself and of the suffix ``k`` lines on: the pairs are sorted over all tasks, and a
pair's rank is the number of suffixes before it. Suffixes of one rank are an interval of the suffix
array whose longest common prefix is ``k`` lines at least; its length is the number of copies. Ranks
that one suffix has leave at each step, and so does what lies in no window, so only runs that may be
deleted are ever doubled.

A run that is repeated and has ``min_words`` words or more is the union of windows of that many words
that begin or end in it. The interval of a window of ``k`` to ``2k`` lines is given by two ranks of
``k`` lines, so doubling need go no deeper than the longest such window. Windows that are not the
first of their interval, put together, are the maximal repeated runs, and their lines go.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import bitmap_split, bounded_batches, discard, files_for, lean, materialize

MIN_WORDS = 50
KEY = ["did", "mark"]


def _keyed(docs: DataFrame) -> DataFrame:
    """A document's place among all: its id, then a hash of its text; rows equal in both are one document."""
    return docs.withColumns({"did": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "mark": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})


def _lines(docs: DataFrame, files: int) -> DataFrame:
    """(key, ``i``, ``a``, ``b``, ``words``) of each line of each document; ``a`` and ``b`` are 128 bits of its hash."""
    keyed = _keyed(docs).where("text is not null").select(*KEY, F.col("text").cast("string").alias("text"))
    often = materialize(keyed.groupBy(*KEY).agg(F.count("*").alias("times")).where("times > 1").select(*KEY), files)
    if not often.isEmpty():  # only rows that repeat are shuffled with their texts
        likely, sure = bitmap_split(keyed.withColumn("_place", F.xxhash64(*KEY)), "_place", often.select(F.xxhash64(*KEY)))
        keyed = likely.dropDuplicates(KEY).unionByName(sure).drop("_place")
    words = lambda x: F.size(F.array_remove(F.split(x, r"[\x20\x09-\x0D]+", -1), ""))
    each = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), words(x).alias("words")))
    return materialize(keyed.select(*KEY, F.explode(each).alias("x")).select(*KEY, "x.*"), files)


def _numbered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, times) in order: the number of suffixes before each in this task, and the task."""
    before, part = 0, TaskContext.get().partitionId()
    for batch in it:
        times = batch.column(2).to_numpy()
        ends = before + np.cumsum(times)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - times), pa.array(np.full(len(times), part, np.int64))], names=["a", "b", "times", "here", "part"])
        before = int(ends[-1]) if len(ends) else before


def _ranked(rows: DataFrame, files: int) -> DataFrame:
    """``rows`` of suffixes whose pair (``a``, ``b``) others have too, with ``rank``, the number of such suffixes before the pair's, for the pair.

    Counts are partial before the shuffle; pairs, not suffixes, are sorted; suffixes of no such pair
    are left out by a bitmap before they are shuffled; ranks are written before they are joined, so
    that Spark can split the suffixes of a hot pair over tasks.
    """
    pairs = rows.groupBy("a", "b").agg(F.count("*").alias("times")).where("times > 1")
    ordered = pairs.repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    numbered = materialize(ordered.mapInArrow(lean(_numbered), "a long, b long, times long, here long, part long"), files)
    sums = sorted(tuple(r) for r in numbered.groupBy("part").agg(F.sum("times")).collect())  # a number for each task
    offsets = rows.sparkSession.createDataFrame([(p, o) for (p, _), o in zip(sums, accumulate((n for _, n in sums), initial=0))], "part long, offset long")
    ranks = numbered.join(F.broadcast(offsets), "part").select("a", "b", (F.col("here") + F.col("offset")).alias("rank"))
    place = F.xxhash64("a", "b")
    likely, _ = bitmap_split(rows.withColumn("place", place), "place", numbered.select(place))
    out = materialize(likely.drop("place").join(ranks, ["a", "b"]).drop("a", "b"), files)
    discard(numbered)
    return out


def windows_of(at: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """(first line, lines) of the least windows of ``min_words`` words, from each line on and up to each line, of lines ``at`` that are repeated."""
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    found = set()
    for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])), strict=True):
        total = np.concatenate(([0], np.cumsum(words[a:b])))
        if total[-1] < min_words:
            continue
        end = np.searchsorted(total, total[:-1] + min_words, side="left")  # first end that reaches the words
        found |= {(int(at[a] + s), int(e - s)) for s, e in enumerate(end) if e <= b - a}
        start = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # last start that still does
        found |= {(int(at[a] + s), int(e + 1 - s)) for e, s in enumerate(start) if s >= 0}
    return sorted(found)


_KIND = pa.list_(pa.struct([("i", pa.int64()), ("size", pa.int64())]))
_STEP = "did long, mark long, i long, size long, a long, b long, windows array<struct<i: long, size: long>>"


def step_of(at: np.ndarray, rank: np.ndarray, windows: list[tuple[int, int]], k: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """What a document's ranks by ``k`` lines give: names of its windows of k to 2k - 1 lines, pairs of ranks for the next step, and the windows that it is for.

    A window all of whose ``k`` lines are not repeated somewhere has no copy and leaves. Pairs are
    made only inside the windows that are longer; a copy of a window is a window too, so none is missed.
    """
    if not len(at):
        return [], [], []
    first, span = int(at[0]), int(at[-1] - at[0]) + 1
    ranks = np.full(span + 1, -1, np.int64)
    ranks[at - first] = rank
    missing = np.concatenate(([0], np.cumsum(ranks[:-1] < 0)))
    named, longer, inside = [], [], np.zeros(span, bool)
    for i, n in windows:
        lo, hi = i - first, i - first + n - k + 1  # the starts of its runs of k lines
        if lo < 0 or hi > span or missing[hi] != missing[lo]:
            continue
        if n < 2 * k:
            named.append((i, n, int(ranks[lo]), int(ranks[hi - 1])))
        else:
            longer.append((i, n))
            inside[lo : hi - k] = True
    starts = np.flatnonzero(inside)
    return named, [(int(p + first), int(ranks[p]), int(ranks[p + k])) for p in starts], longer


def _steps(k: int, min_words: int = 0):
    """For mapInArrow over (key, lines in order, windows): rows of named windows, of pairs, and of documents with longer windows. Without windows they are made of the lines' words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                out: list[tuple] = []
                for did, mark, lines, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    at, rank = (np.array([x[f] for x in lines], np.int64) for f in ("i", "rank"))
                    own = windows_of(at, np.array([x["words"] for x in lines], np.int64), min_words) if windows is None else [(w["i"], w["size"]) for w in windows]
                    named, pairs, longer = step_of(at, rank, own, k)
                    out += [(did, mark, i, n, a, b, None) for i, n, a, b in named]
                    out += [(did, mark, i, None, a, b, None) for i, a, b in pairs]
                    if longer:
                        out.append((did, mark, None, None, None, None, [{"i": i, "size": n} for i, n in longer]))
                if out:
                    types = [pa.int64()] * 6 + [_KIND]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["did", "mark", "i", "size", "a", "b", "windows"])

    return run


def _joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each document, put together where they overlap or touch."""
    kind = pa.list_(pa.struct([("i", pa.int64()), ("size", pa.int64())]))
    for batch in it:
        out = []
        for windows in batch.column(2).to_pylist():
            runs: list[dict] = []
            for w in windows:  # in order of their starts
                if runs and w["i"] <= runs[-1]["i"] + runs[-1]["size"]:
                    runs[-1]["size"] = max(runs[-1]["size"], w["i"] + w["size"] - runs[-1]["i"])
                else:
                    runs.append(dict(w))
            out.append(runs)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["did", "mark", "runs"])


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(``did``, ``mark``, ``runs``): the maximal runs of lines to delete, (``i``, ``size``) in order, of each document that has any."""
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    files = files_for(docs.sparkSession, size=size)
    every = _lines(docs, files)
    level = _ranked(every, files)
    discard(every)
    lines = level.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("i", "rank", "words"))).alias("lines"))
    step = materialize(lines.select(*KEY, "lines", F.lit(None).cast("array<struct<i: long, size: long>>")).mapInArrow(lean(_steps(1, min_words)), _STEP), files)
    discard(level)
    done, k = [step], 1
    while not (longer := step.where("windows is not null").select(*KEY, "windows")).isEmpty():
        k *= 2
        level = _ranked(step.where("a is not null and size is null").select(*KEY, "i", "a", "b"), files)
        lines = level.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("i", "rank"))).alias("lines"))
        step = materialize(lines.join(longer, KEY).select(*KEY, "lines", "windows").mapInArrow(lean(_steps(k)), _STEP), files)
        discard(level)
        done.append(step)
    named = reduce(DataFrame.unionByName, done).where("size is not null").select(*KEY, "i", "size", F.col("a").alias("rank"), F.col("b").alias("tail"))
    interval = ["size", "rank", "tail"]
    first = materialize(named.groupBy(*interval).agg(F.count("*").alias("times"), F.min(F.struct(*KEY, "i")).alias("first")).where("times > 1").drop("times"), files)
    later = named.join(first, interval).where(F.struct(*KEY, "i") != F.col("first"))
    gone = later.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("i", "size"))).alias("windows"))
    runs = materialize(gone.mapInArrow(lean(_joined), "did long, mark long, runs array<struct<i: long, size: long>>"), files)
    for table in (*done, first):
        discard(table)
    return runs


def _without(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, text, runs): the row, the text without the lines of the runs, and the number of lines before and deleted."""
    for whole in it:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts, before, gone = [], [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = text.split("\n")
                keep = np.ones(len(lines), bool)
                for w in runs:
                    keep[w["i"] : w["i"] + w["size"]] = False
                texts.append("\n".join(x for x, k in zip(lines, keep, strict=True) if k))
                before.append(len(lines))
                gone.append(int((~keep).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64())], names=["row", "text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, others kept) with later copies of repeated line runs deleted, and ``n_lines`` and ``n_removed``.

    A run is consecutive lines, split at line ends, of ``min_words`` words or more together. Of equal
    runs the first by doc_id, then by a hash of the text, then by line stays, also within one
    document. Texts keep all other lines. A null text stays null, with 0 lines; an empty one has one
    line. Rows that repeat both doc_id and text are one document and share its result; a null doc_id
    comes before all. Columns named ``n_lines`` or ``n_removed`` are replaced; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed")
    rows = _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.col("text").cast("string").alias("text")))
    gone = repeated_runs(docs.select("doc_id", "text"), min_words)
    # only documents that may have deletions are shuffled with their texts
    some, others = bitmap_split(rows.withColumn("place", F.xxhash64(*KEY)), "place", gone.select(F.xxhash64(*KEY)))
    met = some.join(gone.hint("merge"), KEY, "left")  # the same join at every size, so that what is shuffled follows the input
    changed = met.where("runs is not null").select("row", "text", "runs")
    schema = changed.select("row", "text").schema.add("n_lines", "long").add("n_removed", "long")
    untouched = {"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long"), "n_removed": F.lit(0).cast("long")}
    same = met.where("runs is null").select("row", "text").unionByName(others.select("row", "text")).withColumns(untouched)
    out = changed.mapInArrow(lean(_without), schema).unionByName(same)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns], "n_lines", "n_removed")
