import random
import zlib

import numpy as np

from glyphmill.llm.toxicity import BITS, SCALE, WEAKEST, Model, fit, log_count_ratios, ngrams, regress, score_documents, shares, train

SCHEMA = "doc_id long, text string, score string, held_out int"


def test_score_equals_brute_force():
    model = Model(np.random.default_rng(0).normal(size=1 << BITS).astype(np.float32), 0.3)
    for t in ("", "a", "Grüße an ALLE", "x" * 5000):
        flat = np.concatenate(list(ngrams(t)) or [np.empty(0, np.uint32)]).tolist()
        z = 0.3 + SCALE * sum(float(model.weights[i]) for i in flat) / max(1, len(flat))
        assert abs(model.score(t) - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) < 1e-6
    assert model.score(None) == model.score("")
    assert len(np.unique(np.concatenate([*ngrams("abcdefgh"), *ngrams("ABCDEFGH")]))) == len(np.unique(np.concatenate(list(ngrams("abcdefgh")))))


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice(["ba", "ti", "re", "on", "el", "su"]) for _ in range(r.randrange(1, 4)))
    docs = []
    for i in range(900):
        t = [word() for _ in range(r.choice([20, 100, 400]))]
        if i % 4 == 0:
            for _ in range(max(1, len(t) // 60)):
                t.insert(r.randrange(len(t)), r.choice(["vexnog", "grulk"]))
        docs.append((i, " ".join(t), "1", 1))
    docs += [(2000, None, "1", 1), (2001, "", "1", 1), (None, "x", "1", 1), (0, docs[0][1], "1", 1)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(900)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = score_documents(frame, fit(frame, labels)).collect()
    assert len(got) == len(docs) and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 900]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got if x.doc_id is not None)
    assert sum(x.predicted == (x.doc_id % 4 == 0) for x in held) >= 0.97 * len(held)
    assert all(x.predicted == 0 for x in got if x.doc_id in (2000, 2001))
    none = fit(frame, labels.limit(0))
    assert score_documents(frame.limit(0), none).collect() == [] and none.score("x") == 0.5
    assert train(["a b c"], [1]).score("q") > 0.5


def plain_ngrams(text):
    """The hashed n-grams by Python's integers, one at a time."""
    low, m = 0xFFFFFFFF, " " + text + " "
    codes = [ord(c) for c in m.lower()]
    out = []
    for n in (3, 4, 5):
        for i in range(len(codes) - n + 1):
            h = [(c + 1) * 0x9E3779B1 & low for c in codes[i : i + n]]
            r = h[0]
            for x in h[1:]:
                r = (r * 0x85EBCA6B & low) ^ (r >> 15) ^ x
            out.append(((r ^ (r >> 16)) * 0xC2B2AE35 * (2 * n + 1) & low) >> (32 - BITS))
    return out


def test_ngrams_and_ratios_equal_plain_python():
    texts = ["", "a", "Grüße an ALLE, 日本", "aaaa aaaa", "one two three", "two three four", "three four five"]
    for t in texts:
        want = plain_ngrams(t)
        at, share = shares(t)
        assert sorted(np.concatenate(list(ngrams(t)) or [[]]).tolist()) == sorted(want)
        assert {int(a): s for a, s in zip(at, share, strict=True)} == {g: want.count(g) / len(want) for g in set(want)}
    toxic, other = [t + " bad word" for t in texts], texts
    ratio = log_count_ratios(*(np.bincount(np.concatenate([sorted(set(plain_ngrams(t))) for t in part]).astype(int), minlength=1 << BITS) for part in (toxic, other)))
    sets = [[set(plain_ngrams(t)) for t in part] for part in (toxic, other)]
    totals = [sum(map(len, s)) + (1 << BITS) for s in sets]
    for g in set().union(*sets[0], *sets[1]):
        p, q = (sum(g in s for s in part) for part in sets)
        want = np.log(((p + 1) / totals[0]) / ((q + 1) / totals[1]))
        assert abs(ratio[g] - (0 if p + q < 3 or abs(want) < WEAKEST else want)) < 1e-9
    assert np.count_nonzero(ratio) == sum(ratio[g] != 0 for g in set().union(*sets[0], *sets[1]))


def test_weights_are_at_the_minimum():
    r = np.random.default_rng(3)
    n, k = 200, 6
    dense = r.normal(size=(n, k)) * (r.random((n, k)) < 0.7)
    y = (dense @ r.normal(size=k) + r.normal(size=n) > 0).astype(float)
    row, col = np.nonzero(dense)
    w, b = regress(row, col, dense[row, col], y, rounds=4000, penalty=1e-2)
    p = 1 / (1 + np.exp(-(dense @ w[:k] + b)))
    assert np.abs(dense.T @ (p - y) / n + 1e-2 * w[:k]).max() < 1e-4 and abs((p - y).mean()) < 1e-4
    assert not w[k:].any()


def test_fit_equals_training_at_hand(spark):
    rows = [(i, ("vex nog " if i % 2 else "") + f"some text {i % 7} of {i % 5}", "", 0) for i in range(60)]
    labels = [(i, i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows + [rows[1]] * 50, SCHEMA)  # a repeated row counts once
    model = fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    used = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    want = train([rows[i][1] for i in used], [i % 2 for i in used])
    assert all(abs(model.score(x[1]) - want.score(x[1])) < 1e-3 for x in rows)
    few = fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), max_per_class=3)
    assert all(0 <= few.score(x[1]) <= 1 for x in rows)
