import hashlib
import random

from glyphmill.llm.chat import escape, format_chats, header, parse, read_chats, unescape

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
NASTY = ["\\", "###", "</turn>", "### Assistant: ", "\\### User: x</turn>\n", "<", "</turn", "#", ": ", "\n", "é🙂", "@", ""]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, *((r[0] or 0), r[1].encode(), r[2].encode())))
        loss = "".join(t for _, r, t in mine if r == "assistant")
        out[conv] = (len(mine), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in mine).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(header(r)) + len(escape(t)) + 8 for _, r, t in mine))
    return out


def test_round_trip(spark):
    r = random.Random(9)
    text = lambda: "".join(r.choice(NASTY) for _ in range(r.randrange(8)))
    roles = ["user", "assistant", "system", None, "User", "Assistant", "@x", "a:b\n", "###", "</turn>", "\\"]
    rows = [(c, t, r.choice(roles[: 2 if c % 2 else 11]), r.choice([None, text(), text()]), "f") for c in range(60) for t in range(r.randrange(1, 9))]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok", "f"), (-7, 1, "assistant", "\\### Assistant: </turn> ok", "f"), (None, 1, "user", "x", "f"), (3, 0, "assistant", "dup", "f"), (3, 0, "assistant", "dup", "f"), (4, None, "user", "n", "f")]
    rows += [(1000, t, "assistant", "long " * 50_000 + str(t), "f") for t in range(30)]
    formatted = format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {x[0]: tuple(x)[1:] for x in read_chats(formatted).collect()}
    assert got == brute(rows)
    assert format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_escaping_is_reversible():
    r = random.Random(1)
    for _ in range(3000):
        t, role = "".join(r.choice(NASTY) for _ in range(r.randrange(9))), "".join(r.choice(NASTY) for _ in range(3))
        assert unescape(escape(t)) == t
        assert [x[:2] for x in parse(header(role) + escape(t) + "</turn>\n" + header("user") + "x</turn>\n")] == [(role, t), ("user", "x")]
