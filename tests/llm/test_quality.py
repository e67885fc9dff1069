import random
import re

from glyphmill.llm.quality import DecisionList, assess, fit, learn

SCHEMA = "doc_id long, text string, stats string, kept int"


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    hit = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_statistics_equal_brute_force(spark):
    r = random.Random(3)
    texts = [None, "", " \n\t", "a", "a a a a", "x y z x y z", "é\u00a0ü ñ|<>#\nq\nq\n\n q\n", "a\r\nb\x0bc\x0cd\ta"]
    texts += [(" " if r.random() < 0.8 else "\n").join(r.choice("abcdef") for _ in range(r.randrange(90))) for _ in range(60)]
    texts.append("\n".join(" ".join(r.choice(["ab", "cd", "e#"]) for _ in range(9)) for _ in range(800)))
    got = assess(spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], SCHEMA), DecisionList()).collect()
    assert len(got) == len(texts)
    for x in got:
        want = brute(texts[x.doc_id])
        assert tuple(x.stats[:5]) == want
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and x.kept == (not x.base_failed)
    assert assess(spark.createDataFrame([], SCHEMA), DecisionList()).collect() == []


def test_learned_list_finds_a_planted_conjunction():
    r = random.Random(5)
    names = ("n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "lines_per_word", "stops_per_word")
    rows = [{f: r.random() for f in names} for _ in range(3000)]
    for x in rows:
        x["bad"] = int(x["symbols_per_word"] > 0.8 or (x["mean_word"] > 0.7 and x["stops_per_word"] <= 0.3))
    rules = learn(rows)
    assert {c[0] for rule in rules.rules for c in rule} >= {"symbols_per_word", "mean_word", "stops_per_word"}
    assert learn([]).rules == [] and learn([x | {"bad": 0} for x in rows[:50]]).rules == []


def test_fit_on_labels(spark):
    docs = [(i, " ".join(f"w{i}x{j}" + ("***" if i % 3 == 0 else "") for j in range(60)), "", 0) for i in range(120)]
    frame = spark.createDataFrame(docs, SCHEMA)
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1) for i in range(90)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = assess(frame, fit(frame, labels)).collect()
    assert {x.doc_id for x in got if x.kept} == {i for i in range(120) if i % 3}
    assert fit(frame, labels.limit(0)).rules == []


def plain_features(t):
    n_words, word_chars, n_symbols, n_dup, n_repeat = brute(t)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (t or "").split("\n"))
    n = max(1, n_words)
    return dict(n_words=n_words, mean_word=word_chars / n, symbols_per_word=n_symbols / n, dup_line_share=n_dup / max(1, lines), repeat_share=n_repeat / n, lines_per_word=lines / n, stops_per_word=sum(c in ".!?" for c in t or "") / n)


def test_verdicts_equal_the_rules_applied_by_hand(spark):
    r = random.Random(12)
    docs = [(None if i % 11 == 0 else i, " ".join(r.choice(["word", "ab", "c.", "d#", "longerword", "e!"]) + (str(i) if r.random() < 0.7 else "") for _ in range(r.choice([40, 55, 90]))).replace(" ab", "\n" if i % 3 else " ab"), "", 0) for i in range(150)]
    docs += [(5, docs[5][1], "", 0), (5, "another text of the same id", "", 0), (None, None, "", 0)]
    rules = DecisionList([[("symbols_per_word", ">", 0.2), ("mean_word", "<=", 5.0)], [("stops_per_word", ">", 0.35)], [("lines_per_word", ">", 0.05), ("n_words", "<=", 80.0)]])
    got = assess(spark.createDataFrame(docs, SCHEMA), rules).collect()
    want = []
    for i, t, *_ in docs:
        f = plain_features(t)
        base = f["n_words"] < 50 or 100 * brute(t)[4] > 50 * f["n_words"]
        hit = any(all(f[k] > v if op == ">" else f[k] <= v for k, op, v in rule) for rule in rules.rules)
        want.append((i, t, base, not base and not hit))
    assert sorted(((x.doc_id, x.text, x.base_failed, x.kept) for x in got), key=str) == sorted(want, key=str)
    assert len({w[2:] for w in want}) == 3


def test_learned_thresholds_are_worth_their_precision():
    """What each rule covers of the rows at hand, counted by hand, is as bad as the documented precision asks."""
    r = random.Random(6)
    rows = [{"n_words": 100.0, "mean_word": r.random(), "symbols_per_word": r.random(), "dup_line_share": 0.0, "repeat_share": r.random(), "lines_per_word": r.random(), "stops_per_word": r.random()} for _ in range(2000)]
    for x in rows:
        x["bad"] = int(x["symbols_per_word"] > 0.9 or x["repeat_share"] > 0.85)
    left = rows
    rules = learn(rows).rules
    assert rules
    for rule in rules:
        covered = [x for x in left if all(x[f] > t if op == ">" else x[f] <= t for f, op, t in rule)]
        assert sum(x["bad"] for x in covered) >= 0.95 * len(covered) >= 4
        left = [x for x in left if x not in covered]
    assert sum(x["bad"] for x in left) < 0.1 * sum(x["bad"] for x in rows)


def test_the_bound_holds_where_ids_repeat(spark, monkeypatch):
    from glyphmill.llm import quality

    docs = [(i % 4, " ".join(f"w{i}x{j}" for j in range(60)), "", 0) for i in range(400)]
    seen = []
    monkeypatch.setattr(quality, "learn", lambda rows: seen.append(len(rows)) or DecisionList())
    fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, quality int"), max_labelled=50)
    assert seen == [50]


def test_windows_of_equal_words_only(spark):
    """A long text: every window is told apart by its words."""
    t = " ".join(f"a{i % 50021}" for i in range(100_000))
    got = assess(spark.createDataFrame([(1, t, "", 0)], SCHEMA), DecisionList()).first()
    assert tuple(got.stats[:5]) == brute(t)
