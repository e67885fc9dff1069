import random

from glyphmill.llm.line_dedup import dedup_lines, repeated_runs

SCHEMA = "doc_id long, text string, n_lines string, i int"


def brute(docs, least):
    """Every run with an earlier equal run and enough words goes; docs in their order."""
    lines = [(d, k, x) for d, t in docs if t is not None for k, x in enumerate(t.split("\n"))]
    places = [(d, k) for d, k, _ in lines]
    text = [x for _, _, x in lines]
    gone = set()
    first = {}
    end = {}
    for p in range(len(lines)):
        end[lines[p][0]] = p + 1
    for p in range(len(lines)):
        run, words = [], 0
        for q in range(p, end[lines[p][0]]):
            run.append(text[q])
            words += len(text[q].split())
            seen = first.setdefault(tuple(run), p)
            if seen != p and words >= least:
                gone |= set(places[p : q + 1])
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in docs}


def test_equals_brute_force(spark):
    for seed in range(3):
        r = random.Random(seed)
        line = lambda: " ".join(r.choice("abcdefgh") for _ in range(r.choice([0, 1, 2, 3, 6])))
        pool = [line() for _ in range(30)]
        runs = [[r.choice(pool) for _ in range(r.randrange(2, 9))] for _ in range(6)]
        docs = [(0, None), (1, ""), (2, "\n\n")]
        for d in range(3, 40):
            t = []
            for _ in range(r.randrange(5)):
                t += r.choice(runs) if r.random() < 0.5 else [line() for _ in range(r.randrange(4))]
            docs.append((d, "\n".join(t)))
        docs.append((50, "\n".join(["same line"] * 40)))
        frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(3)
        got = dedup_lines(frame, min_words=10).collect()
        assert {x.doc_id: x.text for x in got} == brute(docs, 10)
        assert all(x.n_lines - x.n_removed == (0 if x.text is None else len(x.text.split("\n")) if x.n_removed < x.n_lines else 0) for x in got)


def test_edges(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "\n".join(f"line {i} of it" for i in range(40))
    got = dedup_lines(spark.createDataFrame([(1, long, "", 0), (1, long, "", 0), (2, long + "\nmore", "", 0), (None, "zz", "", 0)], SCHEMA)).collect()
    assert sorted((x.doc_id or 0, x.text) for x in got) == [(0, "zz"), (1, long), (1, long), (2, "more")]


def test_long_document_and_hot_line(spark):
    """A text of many lines whose half is repeated, a line that most documents have many times, and columns named like the operator's own."""
    r = random.Random(11)
    long = [f"a{r.randrange(300)} b{r.randrange(300)} c" for _ in range(240)]
    docs = [(1, "\n".join(long)), (2, "\n".join(["new first line", *long[120:], "new last line", *long[40:60]]))]
    docs += [(10 + d, "\n".join(["hot line"] * (d % 7) + [f"own {d} {k}" for k in range(3)] + ["hot line"] * (d % 40))) for d in range(300)]
    frame = spark.createDataFrame([(d, t, d, str(d)) for d, t in docs], "doc_id long, text string, mark long, row string").repartition(5)
    got = dedup_lines(frame, min_words=20).collect()
    assert {x.doc_id: x.text for x in got} == brute(docs, 20)
    assert all(x.mark == x.doc_id and x.row == str(x.doc_id) for x in got)


def test_runs_are_maximal(spark):
    a = "\n".join(f"line {i} of it" for i in range(40))
    runs = repeated_runs(spark.createDataFrame([(1, a), (2, "x\n" + a + "\ny")], "doc_id long, text string")).collect()
    assert [(x.did, [tuple(w) for w in x.runs]) for x in runs] == [(2, [(1, 40)])]


def test_copies_and_a_shifted_copy(spark):
    text = "\n".join(f"line {i} of it" for i in range(40))
    docs = [(1, text), (2, text), (3, "a\n" + text)]
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: x.text for x in got} == brute(docs, 50)
