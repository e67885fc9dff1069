import random

import numpy as np
from tokenizers import Tokenizer

from glyphmill.llm.token_counts import attribute, count_tokens
from glyphmill.llm.tokens import vocabulary_path


def test_counts_equal_offsets_of_the_tokenizer(spark):
    r = random.Random(6)
    texts = [None, "", "\n", "a\nb", "one two\nthree\n", "é\n\n\n x", "x" * 500 + "\n" + "y"] + ["".join(r.choice(["ab ", "c", "\n", "\n\n", "é", "  "]) for _ in range(r.randrange(80))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, section int")
    got = count_tokens(docs, lines=2).collect()
    tokenizer = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        t = t or ""
        lines = [x + "\n" for x in t.split("\n")[:-1]] + [t.split("\n")[-1]]
        lines = lines[:-1] if len(lines) > 1 and not lines[-1] else lines
        spans, at = [], 0
        for k in range(0, len(lines), 2):
            n = sum(map(len, lines[k : k + 2]))
            spans.append((at, n))
            at += n
        mine = sorted((x for x in got if x.doc_id == i), key=lambda x: x.section)
        assert [(x.start, x.length) for x in mine] == spans
        starts = [o[0] for o in tokenizer.encode(t, add_special_tokens=False).offsets]
        # a token that starts inside a character counts at that character
        want = [sum(a <= s < a + n for s in starts) for a, n in spans]
        assert [x.n_tokens for x in mine] == want and all(x.doc_tokens == len(starts) for x in mine)
    assert count_tokens(docs.limit(0)).collect() == []


def test_rules():
    lengths, bounds = np.array([3, 3, 1, 8]), np.array([0, 2, 4, 6, 15])
    assert attribute(lengths, bounds).tolist() == [1, 1, 0, 2]
    assert attribute(lengths, bounds, "most").tolist() == [1, 0, 1, 2]


def brute(offsets, spans, rule):
    """Tokens and crossing tokens of each span, one token at a time."""
    n, crossing = [0] * len(spans), [0] * len(spans)
    for a, b in offsets:
        held = [max(0, min(b, s + size) - max(a, s)) for s, size in spans]
        first = next(k for k, x in enumerate(held) if x)
        n[first if rule == "first" else held.index(max(held))] += 1
        crossing[first] += b > spans[first][0] + spans[first][1]
    return n, crossing


def test_fields_and_paragraphs_equal_offsets(spark):
    r = random.Random(9)
    word = lambda: r.choice(["ab", "Hello", "é", "日本語", "🙂🙂", "it's", "\n\n\n", "\n", "  ", "<|endoftext|>", "12"])
    rows = [(i, "".join(word() for _ in range(r.randrange(6))), "".join(word() for _ in range(r.randrange(40))), i) for i in range(60)]
    rows += [(None, "no id", "x", 0), (5, None, None, 0), (5, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string, section int")
    tokenizer = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    for rule in ("first", "most"):
        for sep in ("\n", ""):
            got = count_tokens(docs, fields=["title", "text"], sep=sep, by="fields", rule=rule).collect()
            assert len(got) == 2 * len(rows)
            for i, title, text, _ in rows[:61]:
                whole = (title or "") + sep + (text or "")
                cut = len(title or "") + len(sep)
                offsets = tokenizer.encode(whole, add_special_tokens=False).offsets
                mine = sorted((x for x in got if x.doc_id == i and (i != 5 or x.doc_tokens == len(offsets))), key=lambda x: x.section)[:2]
                assert [(x.start, x.length) for x in mine] == [(0, cut), (cut, len(whole) - cut)]
                assert ([x.n_tokens for x in mine], [x.n_crossing for x in mine]) == brute(offsets, [(0, cut), (cut, len(whole) - cut)], rule)
    for x in count_tokens(docs, by="paragraphs").collect():
        text = next((t for i, _, t, _ in rows if i == x.doc_id), "") or ""
        part = text[x.start : x.start + x.length]
        if x.start and x.doc_id != 5:
            assert text[: x.start].endswith("\n\n") and not part.startswith("\n")
        assert "\n\n" not in part.rstrip("\n")


def test_long_text(spark):
    text = "\n".join(f"word{k} и ещё {k % 13}" for k in range(60_000))
    got = count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), lines=1000).collect()
    offsets = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).offsets
    starts = np.array([a for a, _ in offsets])
    assert len(got) == 60 and all(x.n_tokens == ((starts >= x.start) & (starts < x.start + x.length)).sum() for x in got)
    assert sum(x.n_tokens for x in got) == len(offsets) == got[0].doc_tokens
