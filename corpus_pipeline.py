"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``documents``. Between stages tables are written as Parquet and read again.
Null and empty texts have no words and leave in the first stage; a stage that gets them all the same
keeps them where it has no reason to drop them. Null ids and rows that repeat an id are rows like
others in every stage. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import materialize, table
from glyphmill.llm.contamination import decontaminate
from glyphmill.llm.jaccard import jaccard_components
from glyphmill.llm.line_dedup import dedup_lines
from glyphmill.llm.packing import pack
from glyphmill.llm.quality import assess, fit


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``_row`` of each row, whatever its id; written, so that every read finds the same numbers."""
    return materialize(docs.withColumn("_row", F.monotonically_increasing_id()))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep, each row by its own text; labels count by id, and ids without a label teach nothing."""
    return assess(docs, fit(docs, table(spark, sf_dir, "labels"))).where("kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; ``n_chars`` follows the text, and what has no words left goes.

    Rows equal in id and text are one document here and stay alike; the Jaccard stage keeps one of them.
    """
    lean = dedup_lines(docs)
    some = F.rlike(F.col("text"), F.lit(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        lean = lean.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return lean.where((F.col("n_removed") == 0) | some).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id; repeated rows and null ids, which come last, are rows like others."""
    keyed = _keyed(docs)
    found = jaccard_components(keyed.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    members = materialize(found.join(keyed.select("_row", "doc_id"), "_row"))
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")).alias("first"))
    away = materialize(members.join(first, "component_id").where(F.col("_row") != F.col("first._row")).select("_row"))
    return keyed.join(away, "_row", "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; each row is judged by its own text, whatever its id."""
    keyed = _keyed(docs)
    hits = decontaminate(keyed.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    leaks = materialize(hits.select(F.col("doc_id").alias("_row")))
    return keyed.join(leaks, "_row", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, of every row: one without text is its end id alone."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The learned list, the ids of the tokenizer and first-fit decreasing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
