import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import patterns as P
from glyphmill.operators import fit
from glyphmill.operators import frames as K2
from glyphmill.operators import glyphs as G
from glyphmill.operators import rle as R
from glyphmill.plans.encode import Config, encode, encoded, read_glyphs, reserved_glyphs, shared_tables
from glyphmill.sources import container as K
from glyphmill.sources import images as I


def u16(*words):
    return np.array(words, "<u2").tobytes()


@pytest.mark.parametrize(("words", "data"), [((7, 7, 7), u16(3, 7)), ((1, 2, 3), u16(0x8003, 1, 2, 3)), ((1, 2, 2, 3), u16(0x8001, 1, 2, 2, 0x8001, 3)), ((), b"")])
def test_rle_words(words, data):
    assert R.encode_words(np.array(words, "<u2")) == data
    assert R.decode_words(data, len(words)).tolist() == list(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=300))
def test_rle_round_trip(words):
    assert R.decode_words(R.encode_words(np.array(words, "<u2")), len(words)).tolist() == words


def test_rle_of_bytes_and_long_runs():
    assert R.decode_bytes(bytes([3, 9, 0x82, 1, 2, 5]), 10) == bytes([9, 9, 9, 1, 2])
    long = np.concatenate([np.full(70_000, 5), np.arange(40_000)]).astype("<u2")
    assert (R.decode_words(R.encode_words(long), len(long)) == long).all()
    assert R.decode_words(u16(5, 1), 3).tolist() == [1, 1, 1]


def bits(p):
    return np.unpackbits(np.frombuffer(p.to_bytes(8, "big", signed=True), np.uint8)).reshape(8, 8)


def test_pattern_functions(spark):
    r = np.random.default_rng(1)
    values = [0, -1, 1, -(2**63), *r.integers(-(2**63), 2**63, 40).tolist()]
    frame = spark.createDataFrame([(v,) for v in values], "p long")
    got = frame.select("p", P.canonical("p").alias("c"), P.popcount("p").alias("n"), P.horizontal_edges("p").alias("h"), P.vertical_edges("p").alias("v"), P.edge_descriptor("p").alias("e"), P.density("p").alias("d"), P.mask("p").alias("m"), P.hamming("p", F.lit(5)).alias("x"), P.hamming("p", P.invert(F.lit(5))).alias("y")).collect()
    for g in got:
        b = bits(g.p).astype(int)
        assert g.c == min(g.p & (2**64 - 1), ~g.p & (2**64 - 1)) and g.n == b.sum() and g.m == b.ravel().astype(bool).tolist()
        right, down = np.zeros((8, 8)), np.zeros((8, 8))
        right[:, :7], down[:7] = b[:, 1:] != b[:, :-1], b[1:] != b[:-1]
        assert (g.h, g.v) == (right.sum(), down.sum())
        assert g.e[:2] == [g.h, g.v] and g.e[2:] == (right + down).ravel()[2:].tolist()
        assert np.allclose(g.d, [b.mean(), *b.mean(axis=1), *b.mean(axis=0)])
        assert g.x + g.y == 64


def test_tiles_to_patterns(spark):
    half = [0.0] * 4 + [1.0] * 4
    tiles = {"flat": [3.0] * 64, "half": half * 8, "mirrored": half[::-1] * 8, "dark": [0.0] * 33 + [1.0 + i for i in range(31)]}
    got = {r.k: r for r in G.canonical_patterns(spark.createDataFrame([(k, v) for k, v in tiles.items()], "k string, embedding array<double>")).collect()}
    assert got["flat"].pattern == 0 and got["dark"].pattern == 0
    assert got["half"].pattern == got["mirrored"].pattern == 0x0F0F0F0F0F0F0F0F
    assert not got["half"].inverted and got["mirrored"].inverted


def test_hamming_ties(spark):
    glyphs = spark.createDataFrame([(0, 0xFFFFFFFF), (1, 0xFFFF0000FFFF0000 - 2**64), (2, 0)], "medoid_id int, pattern long")
    got = G.hamming_assign(spark.createDataFrame([(0,), (-1,)], "pattern long"), glyphs).collect()
    assert {(r.pattern, r.dist, r.invert, r.medoid_id) for r in got} == {(0, 0, 0, 2), (-1, 0, 1, 2)}
    tie = G.hamming_assign(spark.createDataFrame([(0,)], "pattern long"), glyphs.where("medoid_id < 2")).first()
    assert (tie.dist, tie.invert, tie.medoid_id) == (32, 0, 0)


def test_denoise():
    assert G.denoise(0, 5) == 0 and G.denoise(-1, 5) == -1 and G.denoise(1 << 40, 0) == 1 << 40
    assert G.denoise(1 << 40, 1) == 0
    assert G.denoise(~(1 << 40), 1) == -1
    block = sum(0xE0 << 8 * r for r in range(3))
    assert G.denoise(block, 8) == block and G.denoise(block, 9) == 0


def drawn(glyph, invert, f, b):
    return np.where((bits(int(glyph)).ravel() ^ invert)[:, None] == 1, f, b)


def tile_batch(r, n):
    px = r.integers(0, 256, (n, 64, 3)).astype(np.uint8)
    px[-1] = px[-1][0]
    px[-2, :40] = (9, 9, 9)  # most of it at the least luminance, so no pixel is below the median
    return px


def by_hand(px):
    lum = px.astype(int) @ np.array([299, 587, 114])
    up = lum >= np.median(lum)
    mean = px.mean(axis=0)
    return up, px[up].mean(axis=0), px[~up].mean(axis=0) if (~up).any() else mean


def test_cells_equal_one_tile_at_a_time():
    px = tile_batch(np.random.default_rng(2), 40)
    got = K2.cells_of(px)
    for t in range(len(px)):
        up, fg, bg = by_hand(px[t])
        assert (bits(int(got.raw[t])).ravel() == up).all() and got.flat[t] == (t == 39)
        assert np.allclose(got.fg[t], fg) and np.allclose(got.bg[t], bg)


@pytest.mark.parametrize("tables", [1, 2])
def test_match_by_least_error(tables):
    r = np.random.default_rng(3)
    fgs, bgs = ([r.integers(0, 256, (6, 3)).astype(np.uint8) for _ in range(tables)] for _ in "fb")
    bgs[0][3] = fgs[0][2]
    glyphs, px = r.integers(-(2**63), 2**63, 9), tile_batch(r, 30)
    w = np.array([0.299, 0.587, 0.114]) if tables == 2 else np.ones(3)
    got = K2.assign_best(px, glyphs, fgs, bgs, k=2)
    for t in range(len(px)):
        x = px[t].astype(float)
        _, fg, bg = by_hand(px[t])
        near = lambda pal, c: sorted(((lut, i) for lut in range(tables) for i in range(1, 6)), key=lambda at: (((pal[at[0]][at[1]] - c) ** 2) @ w, at))
        m, f, b, v, fl, bl = got[t]
        if t == len(px) - 1:
            assert (m, v, f, fl) == (0, 0, b, bl) and (bl, b) == near(bgs, x[0])[0]
            continue
        error = lambda m, v, f, b: ((drawn(m, v, fgs[f[0]][f[1]], bgs[b[0]][b[1]]) - x) ** 2).sum()  # noqa: E731, B023
        options = [(error(g, v, f, b), i, j, k, v) for i, f in enumerate(near(fgs, fg)[:2]) for j, b in enumerate(near(bgs, bg)[:2]) for k, g in enumerate(glyphs) for v in (0, 1) if (fgs[f[0]][f[1]] != bgs[b[0]][b[1]]).any()]
        best = min(options)
        assert np.isclose(best[0], error(glyphs[m], v, (fl, f), (bl, b)))
        assert ((fl, f), (bl, b)) == (near(fgs, fg)[best[1]], near(bgs, bg)[best[2]])


@pytest.mark.parametrize("tables", [1, 2])
def test_match_by_pattern(tables):
    r = np.random.default_rng(4)
    fgs, bgs = ([r.integers(0, 256, (6, 3)).astype(np.uint8) for _ in range(tables)] for _ in "fb")
    bgs[0][1:] = fgs[0][1:]  # equal numbers and equal colours happen
    glyphs, px = r.integers(-(2**63), 2**63, 9), tile_batch(r, 60)
    got = K2.assign(px, glyphs, fgs, bgs)
    for t in range(len(px)):
        up, fg, bg = by_hand(px[t])
        m, f, b, v, fl, bl = got[t]
        near = lambda pal, c, no=0: min((i for i in range(1, 6) if i != no), key=lambda i: (((pal[i] - c) ** 2).sum(), i))
        far = lambda pal, c: ((pal[near(pal, c)] - c) ** 2).sum()
        lut = lambda pals, c: int(tables == 2 and far(pals[1], c) < far(pals[0], c))
        if t == len(px) - 1:
            want = lut(bgs, bg)
            assert (m, v, f, b, fl, bl) == (0, 0, near(bgs[want], bg), near(bgs[want], bg), want, want)
            continue
        d = [(min(n := int((bits(int(g)).ravel() != up).sum()), 64 - n), int(n > 32), i) for i, g in enumerate(glyphs)]
        assert (v, m) == min(d)[1:]
        wf, wb = lut(fgs, fg), lut(bgs, bg)
        assert (fl, f) == (wf, near(fgs[wf], fg))
        if tables == 1:
            assert b == near(bgs[0], bg, no=0 if near(bgs[0], bg) != f else f)
        else:
            same = (fgs[wf][f] == bgs[wb][near(bgs[wb], bg)]).all()
            assert (bl, b) == (wb ^ same, near(bgs[wb ^ same], bg))


def test_costs_equal_one_glyph_at_a_time():
    r = np.random.default_rng(6)
    glyphs, means = np.array([0, -1, *r.integers(-(2**63), 2**63, 5)]), r.random((11, 64, 3))
    fg, bg = r.random((7, 3)), r.random((5, 3))
    got = fit.costs(glyphs, means, fg, bg)
    for i, x in enumerate(means):
        for j, g in enumerate(glyphs):
            m, want = bits(int(g)).ravel() == 1, 0.0
            for side, pal in ((x[m], fg), (x[~m], bg)):
                if len(side):
                    want += ((side - pal[((pal - side.mean(axis=0)) ** 2).sum(axis=1).argmin()]) ** 2).sum()
            assert np.isclose(got[i, j], want)
    counts = r.integers(1, 9, 11)
    assert np.isclose(fit.set_cost(glyphs, means, counts, fg, bg), (got.min(axis=1) * counts).sum())


def test_extremes_and_zero():
    assert fit.with_extremes(np.array([7, 1, 2**62 - 1])).tolist() == [7, 0, -1]
    assert fit.with_extremes(np.array([0, 5])).tolist() == [0, -1] and fit.with_extremes(np.array([-1, 5])).tolist() == [-1, 0]
    assert fit.with_extremes(np.array([0])).tolist() == [0]
    assert fit.zero_first(np.array([4, 0, 9])).tolist() == [0, 4, 9] and fit.zero_first(np.array([4, 9])).tolist() == [0, 9]
    assert fit.hamming_medoid(np.array([0xFF, 0x0F, 0x1F])) == 2


def test_kmeans_finds_separate_groups():
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(c, 0.1, (50, 3)) for c in (0, 5, 10, 20)])
    centres, labels = fit.kmeans(x, 4)
    assert sorted(np.rint(centres.mean(axis=1)).tolist()) == [0, 5, 10, 20] and all(len(set(labels[i : i + 50].tolist())) == 1 for i in range(0, 200, 50))
    heavy, _ = fit.kmeans(np.array([[0.0], [1.0], [10.0]]), 2, np.array([3, 1, 1]))
    assert np.allclose(sorted(heavy.ravel()), [0.25, 10])
    assert len(fit.kmeans(np.zeros((5, 2)), 3)[0]) == 3


def test_structure_features_agree(spark):
    r = np.random.default_rng(9)
    patterns = np.unique(fit.canonical(r.integers(-(2**63), 2**63, 50)))
    want = fit.structure(patterns)
    rows = G.structure_features(spark.createDataFrame([(int(p), 1) for p in patterns], "pattern long, cnt long"), "cnt").collect()
    got = {x.pattern: x.features.toArray() for x in rows}
    assert np.allclose([got[int(p)] for p in patterns], want)


def test_perceptual_glyphs_agree(spark):
    """The distributed fit draws its patterns about as well as the fit at hand, and each glyph is a pattern."""
    r = np.random.default_rng(10)
    patterns = np.unique(fit.canonical(r.integers(-(2**63), 2**63, 60)))
    px = np.array([drawn(p, 0, (200, 40, 40), (20, 60, 120)) for p in patterns]) + r.integers(0, 20, (len(patterns), 64, 3))
    means, counts = fit.oklab(px), r.integers(1, 5, len(patterns))
    pal = fit.oklab(np.array([[200, 40, 40], [20, 60, 120], [210, 50, 50]]))
    stats = spark.createDataFrame([(int(p), int(c), i, m.ravel().tolist()) for i, (p, c, m) in enumerate(zip(patterns, counts, means))], "pattern long, cnt long, first long, mean array<double>")
    one, two = G.perceptual_glyphs(stats, 12, pal, pal), fit.perceptual_glyphs(patterns, counts, means, 12, pal, pal)
    for glyphs in (one, two):
        assert len(glyphs) == 12 and glyphs[0] == 0 and set(glyphs[1:].tolist()) <= {0, *patterns.tolist()}
    a, b = (fit.set_cost(g, means, counts, pal, pal) for g in (one, two))
    assert a < 1.25 * b and b < 1.25 * a
    few = G.perceptual_glyphs(stats, 100, pal, pal)
    assert few[0] == 0 and set(few.tolist()) >= set(patterns[1:].tolist())


def test_lanczos_weights():
    for size, out in ((10, 10), (100, 37), (37, 100), (640, 1)):
        w = I._weights(size, out)
        assert np.allclose(w.sum(axis=1), 1)
        for o in range(0, out, 7):
            centre, reach = (o + 0.5) * size / out, max(size / out, 1)
            x = [(s + 0.5 - centre) / reach for s in range(size)]
            want = np.array([0 if abs(v) >= 3 else 1 if v == 0 else np.sin(np.pi * v) * np.sin(np.pi * v / 3) * 3 / (np.pi * v) ** 2 for v in x])
            assert np.allclose(w[o], want / want.sum(), atol=1e-9)
    ramp = np.tile(np.arange(0, 240, 2, dtype=np.uint8)[None, :, None], (60, 1, 3))
    half = I.resize(ramp, 60, 30)
    assert np.abs(half[15, 5:-5, 0].astype(int) - np.arange(1, 240, 4)[5:-5]).max() <= 1


def test_placement_and_png():
    assert I.placement(1280, 480) == (640, 240, 0, 120) and I.placement(480, 960) == (240, 480, 200, 0)
    img = np.random.default_rng(0).integers(0, 256, (480, 960, 3)).astype(np.uint8)
    assert I.canvas(img).shape == I.canvas(img, crop=True).shape == (480, 640, 3)
    assert (I.cut(I.canvas(np.full((30, 40, 3), 9, np.uint8))) == 9).all()


def sample_file(rle=False, end=True):
    r = np.random.default_rng(5)
    table, fonts = r.integers(0, 256, (256, 3)).astype(np.uint8), r.integers(0, 256, (4, 256, 8)).astype(np.uint8)
    chars = (r.integers(0, 1024, 4800) | r.integers(0, 2, 4800) << 12).astype("<u2")
    colours = r.integers(0, 65536, 4800).astype("<u2")
    chars[:2000] = 7
    head = b"".join(K.chunk(K.LUT, i, K.lut(table)) for i in (0, 2)) + b"".join(K.chunk(K.FONT, i, f.tobytes()) for i, f in enumerate(fonts))
    body = K.frame_chunks(chars, colours, rle)
    return K.header() + head + body + (body if end else body[:-4]), table, fonts, chars, colours


def test_container_round_trip(spark, tmp_path):
    for rle in (False, True):
        data, table, fonts, chars, colours = sample_file(rle)
        if not rle:
            assert len(data) == 10_272 + 2 * 19_248
        one, two = K.frames(data)
        assert (one == two).all()
        for cell in (0, 79, 80, 4799):
            on = np.unpackbits(fonts[chars[cell] >> 8 & 3, chars[cell] & 255]).reshape(8, 8) ^ (chars[cell] >> 12 & 1)
            y, x = cell // 80 * 8, cell % 80 * 8
            assert (one[y : y + 8, x : x + 8] == np.where(on[:, :, None] == 1, table[colours[cell] >> 8], table[colours[cell] & 255])).all()
        (tmp_path / f"{rle}.bin").write_bytes(data)
    got = K.read_chunks(spark, f"file://{tmp_path}")
    assert got.where("type = 0").count() == 4 and got.where("frame_idx = 1 and type in (3, 4)").count() == 10
    assert K.rendered(spark, f"file://{tmp_path}").count() == 4


def test_container_errors_and_legacy():
    data, *_ = sample_file(end=False)
    assert len(list(K.frames(data))) == 2
    for bad in (b"\xa8\x01", b"\x00" * 8):
        with pytest.raises(ValueError):
            K.parse_header(bad)
    with pytest.raises(ValueError):
        list(K.frames(K.header()[:3] + b"\x00" + K.header()[4:]))
    with pytest.raises(ValueError):
        list(K.chunks(data + b"\x01\x02"))
    with pytest.raises(ValueError):
        list(K.frames(K.header() + K.frame_chunks(np.zeros(4800), np.zeros(4800))))
    state = K.State()
    state.take(K.LUT, 1, bytes(2048))
    assert state.fg[0] is None and state.fg[1] is not None and state.bg[1] is not None
    state.take(K.LUT, 0, bytes([1, 2, 3, 255]) * 32)
    assert all((t[:32] == [3, 2, 1]).all() and (t[32:] == 0).all() for t in (*state.fg, *state.bg))


def test_encode_global_decodes_to_the_image(spark, tmp_path):
    img = np.zeros((480, 640, 3), np.uint8)
    img[:, 320:] = (200, 30, 90)
    img[100:104, ::8] = (10, 220, 40)
    for i in range(2):
        (tmp_path / f"f{i}.png").write_bytes(I.png(img))
    glyphs = spark.createDataFrame([(0, 0), (1, 0x0F0F0F0F0F0F0F0F)], "medoid_id int, pattern long")
    data = encode(spark, str(tmp_path), Config(rle=True), glyphs)
    got = list(K.frames(data))
    assert len(got) == 2 and (got[0] == got[1]).all()
    assert (got[0][200:300] == img[200:300]).all()
    with pytest.raises(ValueError):
        Config("other")


def picture(seed, n=6):
    """Blocks of a few colours with strokes and a gradient, of a size of its own."""
    r = np.random.default_rng(seed)
    img = np.zeros((480, 640, 3), np.uint8)
    for _ in range(n):
        y, x = r.integers(0, 400), r.integers(0, 560)
        img[y : y + 80, x : x + 90] = r.integers(0, 256, 3)
    img[200:280, :, 1] = np.linspace(0, 255, 640).astype(np.uint8)
    img[300:330] += r.integers(0, 60, (30, 640, 3)).astype(np.uint8)
    return img


@pytest.fixture(scope="module")
def animation(tmp_path_factory):
    folder = tmp_path_factory.mktemp("frames")
    for i in range(2):
        (folder / f"f{i}.png").write_bytes(I.png(picture(20 + i)))
    return folder


#: the sizes that the format gives for two frames
SIZES = {"global": 10_272 + 2 * 19_248, "hybrid": 2_064 + 2 * 23_352, "frame": 8 + 2 * 25_408}


@pytest.mark.parametrize(
    "config",
    [Config("global"), Config("hybrid"), Config("frame"), Config("hybrid", coherence=40, denoise=1), Config("frame", coherence=600), Config("frame", split_palette=True, high_quality=True), Config("hybrid", four_luts=True), Config("global", high_quality=True, four_luts=True), Config("global", split_palette=True, crop=True, rle=True)],
    ids=lambda c: "-".join([c.mode, *(k for k in ("coherence", "denoise", "high_quality", "split_palette", "four_luts", "rle") if getattr(c, k))]),
)
def test_modes_end_to_end(spark, animation, config):
    data = encode(spark, str(animation), config)
    if not config.rle:
        assert len(data) == SIZES[config.mode] + 2056 * config.four_luts
    found = list(K.chunks(data))
    fonts = [(f, i) for _, f, k, i, _ in found if k == K.FONT]
    tables = [(f, i) for _, f, k, i, _ in found if k == K.LUT]
    assert fonts == ([(None, i) for i in range(4)] if config.mode == "global" else [(0, 0), (0, 1), (1, 2), (1, 3)])
    assert tables == ([(0, 0), (0, 2), (1, 1), (1, 3)] if config.mode == "frame" else [(None, i) for i in ((0, 1, 2, 3) if config.four_luts else (0, 2))])
    assert all(body[:8] == bytes(8) for _, _, k, i, body in found if k == K.FONT and i in (0, 2) and (config.mode != "global" or i == 0))
    shots = list(K.frames(data))
    assert len(shots) == 2
    for i, got in enumerate(shots):
        want = I.canvas(picture(20 + i), config.crop).astype(float)
        if config.coherence < 512:
            assert np.abs(got - want).mean() < (9 if config.high_quality else 13), np.abs(got - want).mean()


def test_encoding_is_repeatable_and_in_order(spark, animation):
    head, bodies = encoded(spark, str(animation), Config("frame", split_palette=True))
    rows = {r.frame_idx: bytes(r.body) for r in bodies.collect()}
    assert encode(spark, str(animation), Config("frame", split_palette=True)) == head + rows[0] + rows[1]
    with pytest.raises(ValueError):
        Config("frame", four_luts=True)


def test_shared_palette_is_of_native_pixels(spark, tmp_path):
    """Colours of a letterboxed image come from the image, every fourth pixel, not from the scaled canvas."""
    img = np.zeros((10, 40, 3), np.uint8)
    img[:, ::4] = (200, 30, 90)
    img[:, 1::4] = (1, 2, 3)
    (tmp_path / "f.png").write_bytes(I.png(img))
    frames = I.scan(spark, str(tmp_path))
    table = shared_tables(frames, Config()).fg[0]
    assert table[1].tolist() == [200, 30, 90] and (table[2:] == 128).all() and (table[0] == 0).all()


def test_two_tables_interleave():
    colours = np.array([[i // 2, i // 3, i // 4] for i in range(510)], np.uint8)
    light = lambda c: c.astype(int) @ np.array([299, 587, 114])
    a, b = fit.interleaved(colours[np.random.default_rng(0).permutation(510)])
    assert sorted(map(tuple, np.concatenate([a[1:], b[1:]]).tolist())) == sorted(map(tuple, colours.tolist()))
    order = np.sort(light(colours))
    assert (light(a[1:]) == order[0::2]).all() and (light(b[1:]) == order[1::2]).all() and not a[0].any()


def test_command_line(spark, animation, tmp_path, monkeypatch, capsys):
    from glyphmill import cli

    glyphs = np.zeros((1024, 8), np.uint8)
    glyphs[0], glyphs[5] = 255, 15
    (tmp_path / "glyphs.bin").write_bytes(glyphs.tobytes())
    table = read_glyphs(str(tmp_path / "glyphs.bin"))
    assert table[0] == 0 and table[1] == -1 or (table[0] == 0 and -1 in table)
    (tmp_path / "short.bin").write_bytes(bytes(80))
    out = str(tmp_path / "out.bin")
    assert cli.main(["encode", str(animation), out, "--glyphs", str(tmp_path / "short.bin")]) == 1
    assert cli.main(["encode", str(animation), out, "--glyphs", str(tmp_path / "glyphs.bin"), "--coherence", "3", "--rle"]) == 0
    assert "no effect" in capsys.readouterr().out
    assert cli.main(["encode", str(tmp_path / "none"), out]) == 1 if (tmp_path / "none").mkdir() is None else None
    assert cli.main(["render", out, str(tmp_path / "pngs")]) == 0
    names = sorted(p.name for p in (tmp_path / "pngs").iterdir() if p.suffix == ".png")
    assert names == ["reconstructed_0000.png", "reconstructed_0001.png"]
    back = I.scan(spark, str(tmp_path / "pngs")).orderBy("frame_idx").collect()
    for r, want in zip(back, K.frames((tmp_path / "out.bin").read_bytes()), strict=True):
        assert (I.to_rgb(r.data, r.height, r.width, r.n_channels) == want).all()
    with pytest.raises(SystemExit):
        cli.main(["encode", "a", "b", "--mode", "frame", "--four-luts"])


def test_container_data_source(spark, tmp_path):
    spark.dataSource.register(K.ContainerSource)
    data = sample_file(True)[0]
    for name in ("a.bin", "b.bin"):
        (tmp_path / name).write_bytes(data)
    key = lambda rows: sorted((r.file.rsplit("/", 1)[-1], r.seq, r.frame_idx, r.type, r.id, r.length, bytes(r.data)) for r in rows)
    got = spark.read.format("glyph_container").load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 2
    assert str(key(got.collect())) == str(key(K.read_chunks(spark, f"file://{tmp_path}").collect()))
    one = spark.read.format("glyph_container").load(f"file://{tmp_path}/a.bin")
    assert one.where("type = 2").count() == 4


def test_standard_text_frame():
    font = np.arange(2048, dtype=np.uint8).reshape(256, 8)
    table = np.arange(128, dtype=np.uint8).reshape(32, 4)
    got = K.render_text(np.array([3, 9], np.uint8), np.array([0x21, 0xF0], np.uint8), font, table, columns=2, rows=2)
    on = np.unpackbits(font[3]).reshape(8, 8)
    assert (got[:8, :8] == np.where(on[:, :, None] == 1, table[2][:3], table[17][:3])).all()
    assert not got[8:].any() and not K.render_text(np.zeros(2, np.uint8), np.zeros(2, np.uint8), None, table).any()


def test_more_recurring_patterns_than_reserved_are_clustered(spark):
    left, right = [0x7F00000000000000 + i for i in range(6)], [0x0000000000FF0000 + (i << 40) for i in range(4)]
    rows = [(f, p) for p in left for f in range(5)] + [(f, p) for p in right for f in range(2)] + [(0, 77)]
    cells = spark.createDataFrame(rows, "frame_idx int, raw long")
    got = {r.pattern: r.frames for r in reserved_glyphs(cells, 2).collect()}
    assert len(got) == 2 and len(set(got) & set(left)) == 1 and len(set(got) & set(right)) == 1
    assert {r.pattern: r.frames for r in reserved_glyphs(cells, 10).collect()} == {p: 5 for p in left} | {p: 2 for p in right}
    assert reserved_glyphs(cells, 1).count() == 1


def test_frame_palette_sees_all_pixels(spark, tmp_path):
    img = np.zeros((480, 640, 3), np.uint8)
    img[:, 1::8] = (10, 220, 40)
    (tmp_path / "f.png").write_bytes(I.png(img))
    data = encode(spark, str(tmp_path), Config("frame", rle=True))
    table = next(c for c in K.chunks(data) if c[2] == K.LUT)[-1]
    assert bytes([40, 220, 10]) in {bytes(table[4 * i : 4 * i + 3]) for i in range(256)}


def test_palette_query_clusters_whole_colours(spark, tmp_path):
    from glyphmill.plans.queries import QUERIES

    spark.range(2000).selectExpr("id * 7 as l_partkey", "id * 11 as l_suppkey", "id * 13 as l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["kmeans_palette"](spark, str(tmp_path)).collect()
    assert len(got) == 256 and {r.idx for r in got} == set(range(256))
    assert max(r.r for r in got) > 200 and len({(r.r, r.g, r.b) for r in got}) > 200
