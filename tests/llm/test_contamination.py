import random
import re

from glyphmill.llm import queries
from glyphmill.llm.contamination import contamination, decontaminate


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(t, items):
    w, hit, ids = words(t), set(), set()
    for i, x in items:
        v = words(x)
        k = min(len(v), 10)
        for g in {tuple(v[j : j + 10]) for j in range(max(len(v) - 9, 1))} if v else ():
            for at in range(len(w) - k + 1):
                if tuple(w[at : at + k]) == g:
                    hit |= set(range(at, at + k))
                    ids.add(str(i))
    return len(w), len(hit), sorted(ids)


def test_equals_brute_force(spark):
    r = random.Random(1)
    vocabulary = ["the", "of", "É", "ü9", "Word", "x1", "and", "zebra", "kilo"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 3, 9, 10, 10, 11, 14, 30, 12])]
    items[0] = (0, "Unseen")
    items += [(20, None), (21, ""), (22, "--"), (7, items[7][1])]
    docs = [None, "", "  --", "the", items[3][1], items[3][1] + " " + items[3][1], "Unseen, unseen"]
    for _ in range(50):
        t = [r.choice(vocabulary) for _ in range(r.randrange(60))]
        if r.random() < 0.6:
            t[r.randrange(len(t) + 1) : 0] = (r.choice(items)[1] or "").split()
        docs.append(r.choice([" ", "\n", ", "]).join(t))
    docs.append(" ".join(["the of"] * 3000) + " " + items[6][1])
    docs = list(enumerate(docs))
    got = decontaminate(spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, at int").repartition(3), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, k int")).collect()
    assert len(got) == len(docs)
    assert {(x.doc_id, x.n_words, x.n_hit, tuple(x.item_ids)) for x in got} == {(i, *(b := brute(t, items))[:2], tuple(b[2])) for i, t in docs}


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(x) for x in decontaminate(docs, none).collect()] == [(1, 2, 0, [])]
    assert decontaminate(docs.limit(0), none).collect() == []


def test_items_without_an_id_hit(spark, tmp_path):
    passage, other = "one two three four five six seven eight nine ten eleven", "red green blue"
    docs = [(1, f"so {passage} ends"), (2, other), (3, f"{passage} {other}"), (4, "nothing of it")]
    items = [(None, passage), (None, "nor this"), (5, other), (6, "ten eleven red")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, b = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "benchmark"))
    want = {(1, 13, 11, ()), (2, 3, 3, ("5",)), (3, 14, 14, ("5", "6")), (4, 3, 0, ())}
    assert {(x.doc_id, x.n_words, x.n_hit, tuple(x.item_ids)) for x in decontaminate(d, b).collect()} == want
    assert {x.doc_id: x.n_items for x in contamination(d, b).collect()} == {1: 1, 2: 1, 3: 3, 4: 0}
    assert {x.doc_id: (x.n_items, x.contaminated) for x in queries.op9(spark, str(tmp_path)).collect()} == {1: (1, True), 2: (1, True), 3: (3, True), 4: (0, False)}
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(db.execute(queries.ORACLES["op9_decontaminate"]).fetchall()) == sorted(map(tuple, queries.op9(spark, str(tmp_path)).collect()))


def test_each_row_is_judged_by_itself(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, passage), (1, "clean text of id one"), (1, passage), (None, passage + " more"), (None, "clean"), (None, None)]
    items = spark.createDataFrame([(1, passage), (2, " ".join(f"q{i}" for i in range(40)))], "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "r", 5) for i, t in rows], "doc_id long, text string, row string, n_hit int").repartition(4)
    got = sorted(((x.doc_id, x.n_words, x.n_hit) for x in contamination(docs, items).collect()), key=str)
    assert got == sorted([(1, 11, 11), (1, 5, 0), (1, 11, 11), (None, 12, 11), (None, 1, 0), (None, 0, 0)], key=str)


def test_joins_beyond_the_broadcast_bounds(spark, monkeypatch):
    from glyphmill.llm import contamination as module

    monkeypatch.setattr(module, "MAX_BROADCAST_BYTES", 10)
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(1, "a " + passage), (2, "b"), (3, " ".join(["x"] * 20_000) + " " + passage)]
    got = {x.doc_id: x.n_hit for x in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert got == {1: 30, 2: 0, 3: 30}
