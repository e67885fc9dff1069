import corpus_pipeline
from test_contamination import brute as leaks
from test_jaccard import brute as components
from test_line_dedup import brute as deduped
from test_quality import brute as counts

from glyphmill.llm.quality import fit


def test_stages_equal_brute_force(spark, tmp_path):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "se", "ti", "vo", "xu", "za", "be")]
    text = lambda seed, n: "\n".join(" ".join(words[(seed * 7919 + (i * 31 + seed) * (i + 17 + k) + k * k) % 35] for k in range(12)) for i in range(n))
    docs = [(i, text(i, 8)) for i in range(40)]
    passage = text(99, 5)
    docs += [(100 + i, text(200 + i, 6) + "\n" + passage) for i in range(3)]
    docs += [(200, docs[0][1]), (201, docs[1][1].replace("\n", " ") + " one more"), (300, "too short"), (301, None), (302, "a b c " * 100)]
    item = " ".join(text(500, 1).split())
    docs += [(400 + i, text(600 + i, 7) + "\n" + item) for i in range(2)]
    docs += [(500 + i, "\n".join(" ".join(f"{w}###" for w in line.split()) for line in text(800 + i, 8).split("\n"))) for i in range(40)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 500), 0) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rules = fit(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert rules.rules
    want = [(i, t) for i, t in docs if (c := counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0] and i < 500]
    steps = [dict(want)]
    lean = deduped(want, 50)
    steps.append({i: t for i, t in lean.items() if t == dict(want)[i] or t.split()})
    rep = {i for i, _, c in components(sorted(steps[-1].items())) if i == c}
    steps.append({i: t for i, t in steps[-1].items() if i in rep})
    steps.append({i: t for i, t in steps[-1].items() if not leaks(t, [(1, item)])[1]})
    assert len({len(s) for s in steps}) >= 3
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], steps, strict=True):
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        rows = out.collect()
        assert {r.doc_id: r.text for r in rows} == expected and len(rows) == len(expected), name
        assert all(r.n_chars == len(r.text) for r in rows)
        frame = spark.createDataFrame(rows, out.schema)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == set(steps[-1])


def test_repeated_rows_and_null_ids(spark, tmp_path):
    words = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    item = "this passage of ten words is in the benchmark table"
    rows = [(1, words(1)), (1, words(1)), (2, words(2)), (None, words(2) + " more"), (None, words(3)), (None, words(3)), (4, words(4)), (4, words(5)), (None, words(6)), (9, words(7)), (8, words(7))]
    leaks = [(None, words(10) + " " + item), (4, words(11) + " " + item)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows + leaks], "doc_id long, text string, n_chars long").repartition(3)
    want = [(1, words(1)), (2, words(2)), (None, words(3)), (4, words(4)), (4, words(5)), (None, words(6)), (8, words(7))]
    once = corpus_pipeline.jaccard_stage(spark, docs, str(tmp_path))
    assert sorted(((x.doc_id, x.text) for x in once.collect()), key=str) == sorted(want + leaks, key=str)
    clean = corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path))
    assert sorted(((x.doc_id, x.text) for x in clean.collect()), key=str) == sorted(rows, key=str)
    out = docs
    for stage in (corpus_pipeline.line_stage, corpus_pipeline.jaccard_stage, corpus_pipeline.benchmark_stage):
        out = spark.createDataFrame(stage(spark, out, str(tmp_path)).collect(), docs.schema)
    # line dedup keeps the first copy by id, where null comes before all
    assert sorted((x.text.removesuffix(" more") for x in out.collect())) == sorted(t for _, t in want)
    assert corpus_pipeline.packing_stage(spark, out, str(tmp_path)).count() == len(want)


def test_stages_of_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, schema in (("documents", docs.schema), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.collect() == [] and (stage is corpus_pipeline.packing_stage or out.columns == docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
