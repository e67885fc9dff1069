"""Queries against their SQL in DuckDB: over the smallest of the driver's tables, and over rows that are hard to get right."""

from pathlib import Path

import duckdb
import pytest

from glyphmill.llm.queries import ORACLES, QUERIES

TABLES = Path("/root/testdata/sf0.001")
NAMES = sorted(ORACLES)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(map(tuple, frame.where(frame.notna(), None).values.tolist()), key=str)


def compare(spark, folder, name):
    db = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    got = rows(QUERIES[name](spark, str(folder)).toPandas())
    assert got == rows(db.execute(ORACLES[name]).df())
    return got[1]


@pytest.mark.skipif(not TABLES.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    assert compare(spark, TABLES, name)


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("hard")
    lines = [f"line {i} has some seven words in it" for i in range(30)]
    text = "\n".join(lines)
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "Aa bB"), (5, "aa bb"), (6, text), (7, text), (8, "x\n" + "\n".join(lines[3:20]) + "\n\n\ny"), (9, text.replace("seven", "eight")), (10, "É é 日本 \x0b q"), (11, text.upper()), (12, "\n".join(["same line"] * 70))]
    chats = [(1, 0, "user", "a\\b ### c </turn>"), (1, 1, "assistant", "ok"), (1, 1, "assistant", "ok"), (1, 2, None, None), (2, 0, "tool:x\n", "</turn></turn>"), (2, 1, "assistant", ""), (3, 5, "system", "日本\\"), (3, 4, "user", "z")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", ["op1_ngram_jaccard", "op5_chat_format", "op8_line_dedup"])
def test_hard_rows(spark, hard, name):
    assert compare(spark, hard, name)
