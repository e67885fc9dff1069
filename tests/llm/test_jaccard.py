import random
import re

import numpy as np
import pyarrow as pa

from glyphmill.llm import jaccard
from glyphmill.llm.jaccard import jaccard_components

SCHEMA = "doc_id long, text string, n long"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                u, v = sorted((root(a), root(b)))
                parent[v] = u
    return {(i, len(sets[i]), root(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    docs = []
    passage = [r.choice(words) for _ in range(30)]
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.choice([3, 8, 20, 60, 200]))]
        if r.random() < 0.5:
            base[0:0] = passage
        for _ in range(r.choice([1, 1, 2, 8])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(words)
            if r.random() < 0.3:
                copy += [r.choice(words) for _ in range(len(copy) // 8)]
            docs.append((" " if r.random() < 0.8 else "\n").join(copy))
    docs += ["", None, " \t\n", "Aa bB", "aa bb", "É x", "é x"]
    r.shuffle(docs)
    return list(enumerate(docs))


def test_links_equal_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        got = jaccard_components(spark.createDataFrame([(i, t, 9) for i, t in docs], SCHEMA).repartition(3)).collect()
        assert {tuple(r) for r in got} == brute(docs)


def test_edge_cases(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a b c d e f g h", 1), (1, "a b c d e f g h", 1), (None, "a b c d e f g h", 1), (5, "a b c d e f g h", 1)]
    got = sorted(jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect(), key=str)
    assert [r.component_id for r in got] == [1, 1, 1, None]


def test_exact_step_alone_with_blocks_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SETTLE", 0)
    monkeypatch.setattr(jaccard, "TILE", 4)
    for seed in (3, 4):
        docs = corpus(seed)
        got = jaccard_components(spark.createDataFrame([(i, t, 9) for i, t in docs], SCHEMA).repartition(3)).collect()
        assert {tuple(r) for r in got} == brute(docs)


def test_settling_joins_a_large_group(spark, monkeypatch):
    """Near copies of one text are joined in the tiles, with fewer links than documents; other components are left alone."""
    r = random.Random(5)
    base = [f"b{k}" for k in range(300)]
    docs = []
    for _ in range(700):
        copy = list(base)
        for _ in range(3):
            copy[r.randrange(300)] = f"x{r.randrange(10**6)}"
        docs.append(" ".join(copy))
    docs += [" ".join(f"o{k}_{i}" for i in range(300)) for k in range(5)]
    docs = list(enumerate(docs))
    emitted = []
    block_pairs = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda texts, pairs: emitted.append(pairs.count()) or block_pairs(texts, pairs))
    got = jaccard_components(spark.createDataFrame([(i, t, 9) for i, t in docs], SCHEMA).repartition(3)).collect()
    assert {tuple(x) for x in got} == brute(docs)
    assert sum(emitted) < 7000


def test_long_texts(spark):
    words = [f"w{k * 7919 % 60000}" for k in range(60000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:55000])), (3, " ".join(words[:30000])), (4, "y" * 200_000), (5, "Y" * 200_000)]
    got = jaccard_components(spark.createDataFrame([(i, t, 9) for i, t in docs], SCHEMA)).collect()
    assert {tuple(x) for x in got} == brute(docs)


def test_prefixes_are_dealt_evenly():
    """A prefix holds the least tokens of its set; no part may hold much more than another all the same."""
    r = np.random.default_rng(6)
    dealer = jaccard._Dealer(40)
    for i in range(200):
        s = np.unique(r.integers(0, 2**64, 800, np.uint64))
        dealer.add(s[: len(s) // 4 + 1], i, len(s))
    part, token, _, _ = dealer.packed()
    held = [len(t) // 8 for t in token]
    assert sum(held) == 200 * 201 and len(part) == 40 and max(held) < 2 * min(held)
    tokens = [np.frombuffer(t, np.uint64) for t in token]
    assert len(np.unique(np.concatenate(tokens))) == sum(len(np.unique(t)) for t in tokens)


def test_prefix_is_that_of_the_whole_order_by_few_lookups(monkeypatch):
    r = np.random.default_rng(7)
    looked = []
    held_by = jaccard.held_by
    monkeypatch.setattr(jaccard, "held_by", lambda bitmap, tokens: looked.append(len(tokens)) or held_by(bitmap, tokens))
    for n, heavy_share, bits in ((4000, 0, 0), (4000, 0.05, 0.02), (3000, 0.5, 0.4), (1, 0, 0), (3, 1, 1), (5, 0.5, 0.5)):
        s = np.unique(r.integers(0, 2**64, n, np.uint64))
        heavy = r.permutation(s)[: int(n * heavy_share)]
        known = np.zeros(1 << 10, np.uint64)
        for cell in jaccard._cell(r.permutation(s)[: int(n * bits)], 1 << 16):
            known[cell >> 6] |= np.uint64(1) << np.uint64(cell & 63)
        order = jaccard.Order(heavy, known)
        rank = {int(t): 2 + len(heavy) - k for k, t in enumerate(heavy)}
        place = [rank.get(int(t), int(held)) for t, held in zip(s, held_by(known, s), strict=True)]
        looked.clear()
        assert order.prefix(s).tolist() == [int(t) for _, t in sorted(zip(place, s, strict=True))][: n // 4 + 1]
        if n == 4000:
            assert sum(looked) < 1500


def test_small_blocks_meet_alike_in_any_batches():
    r = np.random.default_rng(8)
    base = np.unique(r.integers(0, 2**63, 400, np.int64)).view(np.uint64)
    rows = []
    for token in range(300):
        for k in range(r.integers(1, 10)):
            s = base[r.integers(0, 60) :] if r.random() < 0.7 else base[: r.integers(100, 400)]
            rows.append((token, 0, 0, 0, 1000 * token + k, int(r.integers(0, 3)), len(s), jaccard.count_vector(s).tobytes(), r.integers(-40, 0, r.integers(0, 6)).tolist()))
    names = ["token", "i", "j", "tile", "node", "component", "n", "point", "first"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    batch = jaccard._table(list(zip(*rows, strict=True)), pa.schema(list(zip(names, kinds, strict=True))))
    brute = set()
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[4] < y[4] and x[5] != y[5] and not set(x[8]) & set(y[8]) and jaccard.bounded(*(np.frombuffer(z[7], np.uint8) for z in (x, y)), x[6], y[6]):
                brute.add((x[4], y[4]))
    for size in (1, 7, 100, len(rows)):
        cut = [pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(at, size).columns], schema=batch.schema) for at in range(0, len(rows), size)]
        got = [tuple(p.values()) for out in jaccard._candidates(iter([batch.slice(0, 0), *cut])) for p in out.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == brute
    assert len(brute) > 200
