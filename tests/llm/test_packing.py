import random

import numpy as np
from tokenizers import Tokenizer

from glyphmill.llm.packing import first_fit_decreasing, pack
from glyphmill.llm.tokens import byte_bpe, vocabulary_path

SCHEMA = "doc_id long, text string, offset int"


def reference():
    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    return lambda x: t.encode(x, add_special_tokens=False).ids


TEXTS = [
    "", " ", "a", "Hello world", " lead", "trail ", "two  spaces", "three   x", "tab\tand\nline", "\n\nx", "a\n b", "a \nb", "it's we'll 12 34,5 !? é ü x y",
    "x\x1cy \x1c z", "<|endoftext|> a", "hello <|endoftext|> you", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n", "<|endoftext|", "日本語 テキスト", "🙂 ok\n🙂", "a\r\nb", "x" * 300, "\x85a \x85", "a\n\nb c", "end\n",
]


def test_ids_equal_the_tokenizers_file():
    want, got = reference(), byte_bpe(vocabulary_path())
    r = random.Random(2)
    alphabet = ["a", "B", "é", " ", " ", "\n", "\t", "'", "s", "1", ".", " ", "ll", "🙂"]
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(3000)]
    flat, bounds = got.encode_batch(texts)
    for k, t in enumerate(texts):
        ids = flat[bounds[k] : bounds[k + 1]].tolist()
        assert ids == got.encode(t)
        assert ids == want(t), repr(t)
        assert got.byte_lengths[ids].sum() == len(t.encode())


def test_first_fit_equals_brute_force():
    r = np.random.default_rng(1)
    for _ in range(20):
        sizes = r.integers(1, 101, r.integers(1, 80))
        bins, offsets = first_fit_decreasing(sizes, 100)
        room: list[int] = []
        for i in np.argsort(-sizes, kind="stable"):
            at = next((k for k, x in enumerate(room) if x >= sizes[i]), len(room))
            if at == len(room):
                room.append(100)
            assert (bins[i], offsets[i]) == (at, 100 - room[at])
            room[at] -= sizes[i]


def test_packing_holds_every_id_once(spark):
    r = random.Random(4)
    texts = [None, *TEXTS, " ".join(str(r.random()) for _ in range(1500))] + [" ".join(r.choice(["ab", "cd", "zzx"]) for _ in range(r.randrange(400))) for _ in range(80)]
    got = pack(spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0)], SCHEMA).repartition(3), group=30).collect()
    want = reference()
    for i, t in enumerate(texts):
        mine = sorted({(x.start, x.length, bytes(x.ids), x.doc_tokens) for x in got if x.doc_id == i})
        ids = np.frombuffer(b"".join(x[2] for x in mine), "<u4").tolist()
        assert ids == [*want(t or ""), 1] and all(x[3] == len(ids) for x in mine)
        assert [x[0] for x in mine] == [sum(y[1] for y in mine[:k]) for k in range(len(mine))]
    for s in {x.sequence_id for x in got}:
        inside = sorted((x.offset, x.length) for x in got if x.sequence_id == s)
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))] and sum(n for _, n in inside) <= 2048
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_null_ids_and_long_documents(spark):
    """Repeated and null ids are dealt over all groups; a long document's full pieces are sequences by themselves."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [(7, "same text", 0)] * 400 + [(None, "no id", 0)] * 50 + [(8, long, 0)]
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(3), group=40).collect()
    ids = [*reference()(long), 1]
    mine = sorted((x for x in got if x.doc_id == 8), key=lambda x: x.start)
    assert np.frombuffer(b"".join(x.ids for x in mine), "<u4").tolist() == ids
    full = [x for x in mine if x.length == 2048]
    assert len(full) == len(ids) // 2048 and len({x.sequence_id for x in full}) == len(full)
    assert not {x.sequence_id for x in full} & {x.sequence_id for x in got if x.length < 2048}
    assert sum(x.doc_id == 7 for x in got) == 400 and sum(x.doc_id is None for x in got) == 50
    assert len({x.sequence_id for x in got if x.doc_id == 7}) > 3
    for s in {x.sequence_id for x in got}:
        inside = sorted((x.offset, x.length) for x in got if x.sequence_id == s)
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))] and sum(n for _, n in inside) <= 2048


def test_workers_of_other_operators_drop_the_vocabulary():
    from glyphmill.llm.common import lean
    from glyphmill.llm.tokens import byte_bpe, vocabulary_path

    byte_bpe(vocabulary_path())
    list(lean(lambda it: it, keeps=True)(iter([])))
    assert byte_bpe.cache_info().currsize == 1
    list(lean(lambda it: it)(iter([])))
    assert byte_bpe.cache_info().currsize == 0
