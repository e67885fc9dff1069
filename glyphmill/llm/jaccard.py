"""Similarity join of documents on shingle sets, with a count-vector R-tree.

The tree alone cannot partition the corpus: in count space the boxes of unrelated documents overlap
in every dimension. So documents meet in blocks that lose no link, and a tree in each block bounds
the overlap of boxes and points by summed coordinate minima:

1. Documents with equal sets are one node, named by a 64-bit sum of its mixed tokens.
2. The prefix theorem: under one global order (tokens that are frequent or known to be shared go
   last) linked sets share a token in their first ``n // 4 + 1``. Only tokens whose holders lie in
   more than one component matter; a document without any is done.
3. Settling: each remaining document meets others in the block of one of its tokens, in tiles of
   bounded size. The tree's leaves give pairs first, and what is verified is joined at once, so a
   group of near copies costs a number of pairs linear in its size. Each round takes another token.
4. The exact step: in the block of each token that still divides components the tree gives all
   pairs of different components whose bound allows a link, and these are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from glyphmill.llm.common import bitmap_split, bounded_batches, discard, files_for, lean, materialize, mix, release, shingle_sets
from glyphmill.llm.components import components

# Orders and sizes of work; none of them drops a pair or changes a result.
SETTLE = 4  # rounds of settling at most
TILE = 512  # rows of a block that are settled or joined together
TILE_CHARS = 4 << 20  # and the characters of their texts
LEAF = 16
FEW = 6  # rows up to which a block is met pair by pair
FINE = 512  # groups of a count vector up to which a token has a group of its own on average
HEAVY = 1 << 16  # tokens that go last by count
FREQUENT_HERE = 8  # occurrences in a task's buffer from which a token is counted
FLUSH = 1 << 19  # tokens that a task buffers
FIRST = 16  # tokens by which a pair's lesser block is found
SMALL = 1 << 18  # counted rows of two or three numbers up to which a side is broadcast


# -- count vectors and the tree ---------------------------------------------------------------------


def count_vector(tokens: np.ndarray) -> np.ndarray:
    """Tokens of each group, a byte each; the group is the token's low bits, so halves add up to the next coarser vector.

    Groups are a power of two: about one for a token up to FINE groups, beyond that one for eight
    tokens; 16 at least, and twice as many while a count doesn't fit its byte.
    """
    up = lambda x: 1 << max(0, math.ceil(x) - 1).bit_length()
    g = max(16, up(len(tokens) / 8), min(FINE, up(len(tokens))))
    while (counts := np.bincount((tokens & np.uint64(g - 1)).astype(np.int64), minlength=g)).max(initial=0) > 255:
        g *= 2
    return counts.astype(np.uint8)


def folded(vector: np.ndarray, g: int) -> np.ndarray:
    return vector.reshape(-1, g).sum(axis=0, dtype=np.uint16) if len(vector) > g else vector.astype(np.uint16)


class RTree:
    """A bulk-loaded tree of boxes over count vectors; each node also has the range of set sizes and of components.

    ``rows`` are places in ``groups``, which the caller may merge while it takes pairs.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, groups: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.sizes, self.groups, self.rows = points, sizes, groups, rows
        self.nodes: list[tuple] = []  # box high, size low, size high, group low, group high, rows or children
        self._build(np.argsort(sizes, kind="stable"), leaf)

    def _build(self, at: np.ndarray, leaf: int) -> int:
        p, s, g = self.points[at], self.sizes[at], self.groups[self.rows[at]]
        me = len(self.nodes)
        self.nodes.append(())
        inside: np.ndarray | tuple[int, int] = at
        if len(at) > leaf:
            spread = p.max(axis=0).astype(np.int64) - p.min(axis=0)
            order = at[np.argsort(s if s.max() - s.min() > 2 * spread.max() else p[:, spread.argmax()], kind="stable")]
            half = len(at) // 2
            inside = (self._build(order[:half], leaf), self._build(order[half:], leaf))
        self.nodes[me] = (p.max(axis=0).astype(np.int64), s.min(), s.max(), g.min(), g.max(), inside)
        return me

    def _meet(self, x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        gx, gy = self.groups[self.rows[x]][:, None], self.groups[self.rows[y]][None, :]
        apart = gx != gy
        if not apart.any():
            return
        low = np.minimum(self.points[x][:, None, :], self.points[y][None, :, :]).sum(axis=2, dtype=np.int64)
        sx, sy = self.sizes[x][:, None], self.sizes[y][None, :]
        good = apart & (7 * low >= 3 * (sx + sy)) & (4 * sx >= 3 * sy) & (4 * sy >= 3 * sx)
        if same:
            good = np.triu(good, 1)
        u, v = np.nonzero(good)
        if len(u):
            yield self.rows[x[u]], self.rows[y[v]]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row pairs of different groups which the bound allows to have a Jaccard similarity of 0.75; those within leaves first."""
        for n in self.nodes:
            if not isinstance(n[5], tuple):
                yield from self._meet(n[5], n[5], True)
        stack = [(0, 0)]
        while stack:
            i, j = stack.pop()
            a, b = self.nodes[i], self.nodes[j]
            if a[3] == a[4] == b[3] == b[4] or 4 * a[2] < 3 * b[1] or 4 * b[2] < 3 * a[1]:
                continue
            if i != j and 7 * np.minimum(a[0], b[0]).sum() < 3 * (a[1] + b[1]):
                continue
            down_a, down_b = isinstance(a[5], tuple), isinstance(b[5], tuple)
            if i == j:
                if down_a:
                    stack += [(a[5][0], a[5][0]), (a[5][0], a[5][1]), (a[5][1], a[5][1])]
            elif down_a or down_b:
                stack += [(x, j) for x in a[5]] if down_a else [(i, x) for x in b[5]]
            else:
                yield from self._meet(a[5], b[5], False)


def block_pairs(vectors: list[np.ndarray], sizes: np.ndarray, groups: np.ndarray, left: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of a block. Vectors of one length share a tree with all longer ones, folded. ``groups`` may be merged meanwhile."""
    dims = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for g in np.unique(dims):
        rows = np.flatnonzero(dims >= g)
        low, high = sizes[dims == g].min(), sizes[dims == g].max()
        rows = rows[(4 * sizes[rows] >= 3 * low) & (3 * sizes[rows] <= 4 * high)]
        if len(rows) < 2 or (groups[rows] == groups[rows[0]]).all():
            continue
        tree = RTree(np.stack([folded(vectors[r], g) for r in rows]), sizes[rows], groups, rows)
        for u, v in tree.pairs():
            keep = (dims[u] == g) | (dims[v] == g)
            if left is not None:  # two tiles of a large block: pairs within a tile are found elsewhere
                keep &= left[u] != left[v]
            if keep.any():
                yield u[keep], v[keep]


def bounded(x: np.ndarray, y: np.ndarray, n: int, m: int) -> bool:
    """Whether two points and their set sizes allow a similarity of 0.75: the bound of a leaf, for one pair."""
    if 4 * n < 3 * m or 4 * m < 3 * n:
        return False
    g = min(len(x), len(y))
    return 7 * int(np.minimum(folded(x, g), folded(y, g)).sum(dtype=np.int64)) >= 3 * (n + m)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets have a similarity of 0.75 or more, by exact sizes."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= 75 * (len(x) + len(y) - both)


# -- passes over texts -----------------------------------------------------------------------------


def _batches(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _node(tokens: np.ndarray) -> np.int64:
    """A set's name: its mixed tokens' sum, mixed with its size."""
    return mix(np.array([mix(tokens, 11).sum(dtype=np.uint64)], np.uint64), len(tokens))[0].view(np.int64)


def _table(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


class _Dealer:
    """Buffers (token, component, size) of many documents and deals them to ``parts`` ranges of their tokens' low halves as packed rows.

    Prefixes hold the least tokens of their sets, so ranges of whole tokens would give a quarter of the parts nearly all.
    """

    schema = pa.schema([("part", pa.int64()), ("token", pa.binary()), ("component", pa.binary()), ("n", pa.binary())])

    def __init__(self, parts: int) -> None:
        self.parts = parts
        self.clear()

    def clear(self) -> None:
        self.held: list[tuple[np.ndarray, int, int]] = []
        self.size = 0

    def add(self, tokens: np.ndarray, component: int, n: int) -> None:
        self.held.append((tokens, component, n))
        self.size += len(tokens)

    def packed(self) -> list[list]:
        lengths = [len(t) for t, _, _ in self.held]
        t = np.concatenate([t for t, _, _ in self.held])
        c = np.repeat(np.array([c for _, c, _ in self.held], np.int64), lengths)
        n = np.repeat(np.array([n for _, _, n in self.held], np.int32), lengths)
        self.clear()
        half = np.uint64(32)
        t = t << half | t >> half
        order = np.lexsort((n, c, t))
        t, c, n = t[order], c[order], n[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])
        t, c, n = t[new], c[new], n[new]
        part = ((t >> half) * np.uint64(self.parts)) >> half
        t = t << half | t >> half
        cut = np.searchsorted(part, np.arange(self.parts + 1))
        full = np.flatnonzero(np.diff(cut))
        return [full, *([x[cut[i] : cut[i + 1]].tobytes() for i in full] for x in (t, c, n))]


_SKETCH = "doc_id long, mark long, node long, n long, part long, token binary, component binary, size binary"


def _sketches(parts: int):
    """For mapInArrow over (doc_id, mark, text): a row for each document; rows of tokens frequent hereabouts (no part); prefixes by hash, dealt."""
    schema = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "mark", "node", "n", "part")], *[(c, pa.binary()) for c in ("token", "component", "size")]])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, dealer = 0, _Dealer(parts)

        def flushed() -> Iterator[pa.RecordBatch]:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= FREQUENT_HERE
            yield _table([*[[None]] * 5, [token[often].tobytes()], [times[often].astype(np.int64).tobytes()], [None]], schema)
            rows = dealer.packed()
            none = [None] * len(rows[0])
            yield _table([none, none, none, none, *rows], schema)

        for whole in it:
            for batch in _batches(whole):
                nodes, sizes = [], []
                for tokens in shingle_sets(batch.column(2).to_pylist()):
                    nodes.append(_node(tokens))
                    sizes.append(len(tokens))
                    if len(tokens):
                        held.append(tokens)
                        dealer.add(tokens[: len(tokens) // 4 + 1], nodes[-1], len(tokens))
                        size += len(tokens)
                none = [None] * len(nodes)
                yield _table([batch.column(0), batch.column(1), nodes, sizes, none, none, none, none], schema)
                if size >= FLUSH:
                    yield from flushed()
                    held.clear()
                    size = 0
        if held:
            yield from flushed()

    return run


class Order:
    """The global order of tokens: those in neither table by hash, those of the bitmap by hash, then the heavy by count."""

    def __init__(self, heavy: np.ndarray, known: np.ndarray) -> None:
        by_token = np.argsort(heavy)
        self.token, self.rank, self.known = heavy[by_token], len(heavy) - by_token, known

    def prefix(self, s: np.ndarray) -> np.ndarray:
        """The first ``len(s) // 4 + 1`` tokens; the whole set is looked up only if its least tokens by hash hold too few of neither table."""
        length = len(s) // 4 + 1
        for head in (s[: length + length // 4 + 8], s):
            place = self._place(head)
            first = head[place == 0][:length]
            if len(first) == length:
                return first
        return s[np.argsort(place, kind="stable")[:length]]

    def _place(self, s: np.ndarray) -> np.ndarray:
        place = held_by(self.known, s).astype(np.int64)
        if len(self.token):
            at = np.minimum(np.searchsorted(self.token, s), len(self.token) - 1)
            place = np.where(self.token[at] == s, 2 + self.rank[at], place)
        return place


def _prefixes(order, parts: int):
    """For mapInArrow over (doc_id, mark, text): each set's prefix, dealt."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(parts)
        for whole in it:
            for batch in _batches(whole):
                for s in shingle_sets(batch.column(2).to_pylist()):
                    if len(s):
                        dealer.add(order.value.prefix(s), _node(s), len(s))
                if dealer.size >= FLUSH:
                    yield _table(dealer.packed(), dealer.schema)
        if dealer.size:
            yield _table(dealer.packed(), dealer.schema)

    return run


_INSIDE = "node long, n long, tokens array<long>, point binary, text string"


def _inside(order, bitmap):
    """For mapInArrow over (doc_id, mark, text): documents with prefix tokens that the bitmap has, and these tokens in order."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64())), ("point", pa.binary()), ("text", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in _batches(whole, 256):
                out: list[tuple] = []
                texts = batch.column(2).to_pylist()
                for text, s in zip(texts, shingle_sets(texts), strict=True):
                    if len(s):
                        t = order.value.prefix(s)
                        t = np.sort(t[held_by(bitmap.value, t)].view(np.int64))
                        if len(t):
                            out.append((_node(s), len(s), t, count_vector(s).tobytes(), text))
                if out:
                    yield _table(list(zip(*out, strict=True)), schema)

    return run


# -- tokens that divide components -----------------------------------------------------------------


def _cell(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (mix(tokens, 31) & np.uint64(bits - 1)).astype(np.int64)


def held_by(bitmap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    cell = _cell(tokens, 64 * len(bitmap))
    return (bitmap[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1


def _divided(bits: int):
    """For applyInArrow: bitmap words of the tokens in this range that two sets of different components and of sizes near enough have."""

    def words(part: pa.Table) -> pa.Table:
        t, c, n = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in part.column(name)]) for name, kind in (("token", np.uint64), ("component", np.int64), ("n", np.int32)))
        order = np.lexsort((n, t))
        t, c, n = t[order], c[order], n[order].astype(np.int64)
        # by size, any two that may link have neighbours between them that may, and components change somewhere there
        near = (t[1:] == t[:-1]) & (c[1:] != c[:-1]) & (4 * n[:-1] >= 3 * n[1:])
        cells = np.unique(_cell(t[1:][near], bits))
        begin = np.flatnonzero(np.concatenate(([True], cells[1:] >> 6 != cells[:-1] >> 6))) if len(cells) else np.empty(0, np.int64)
        at = cells[begin] >> 6
        held = np.bitwise_or.reduceat(np.uint64(1) << (cells & 63).astype(np.uint64), begin).view(np.int64) if len(cells) else at
        return pa.table({"w": pa.array(at, pa.int64()), "b": pa.array(held, pa.int64())})

    def run(part: pa.Table) -> pa.Table:
        found = words(part)
        release()
        return found

    return run


def dividing(dealt: DataFrame, bits: int) -> np.ndarray:
    """The bitmap, of ``bits`` positions, of tokens that divide components; a token that shares a position passes too, which loses nothing."""
    found = dealt.groupBy("part").applyInArrow(_divided(bits), "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return bitmap


def _dealt(parts: int):
    """For mapInArrow over (component, n, tokens): dealt."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(parts)
        for whole in it:
            for batch in _batches(whole):
                for c, n, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    dealer.add(np.array(t, np.int64).view(np.uint64), c, n)
                if dealer.size >= FLUSH:
                    yield _table(dealer.packed(), dealer.schema)
        if dealer.size:
            yield _table(dealer.packed(), dealer.schema)

    return run


def _still(bitmap):
    """For mapInArrow over (node, component, n, point, tokens): the documents that have tokens which the bitmap has, with these."""
    schema = pa.schema([("node", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("point", pa.binary()), ("tokens", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in _batches(whole):
                out: list[tuple] = []
                for *row, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    t = np.array(tokens, np.int64)
                    t = t[held_by(bitmap.value, t.view(np.uint64))]
                    if len(t):
                        out.append((*row, t))
                if out:
                    yield _table(list(zip(*out, strict=True)), schema)

    return run


def _unpacked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for token, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (token, times)], names=["token", "times"])


# -- settling --------------------------------------------------------------------------------------


def _settle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, component, n, point, text) sorted by token: links that join different components of a tile, none that follows from others."""
    token, rows, size = None, [], 0

    def ended() -> Iterator[pa.RecordBatch]:
        groups = np.array([r[0] for r in rows], np.int64)
        if len(rows) < 2 or (groups == groups[0]).all():
            return
        sets: dict[int, np.ndarray] = {}

        def tokens(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = next(shingle_sets([rows[i][3].as_py()]))
            return sets[i]

        links = []
        for u, v in block_pairs([np.frombuffer(r[2], np.uint8) for r in rows], np.array([r[1] for r in rows], np.int64), groups):
            for x, y in zip(u.tolist(), v.tolist(), strict=True):
                if groups[x] != groups[y] and linked(tokens(x), tokens(y)):
                    a, b = sorted((groups[x], groups[y]))
                    links.append((a, b))
                    groups[groups == b] = a
        if links:
            yield _table(list(zip(*links, strict=True)), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    for batch in it:
        keys, lengths = batch.column(0).to_pylist(), batch.column(5).to_pylist()
        own = list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), batch.column(4), strict=True))
        for k, chars, row in zip(keys, lengths, own, strict=True):
            if k != token or len(rows) >= TILE or size >= TILE_CHARS:
                yield from ended()
                token, rows, size = k, [], 0
            rows.append(row)
            size += chars
    yield from ended()


# -- the exact step --------------------------------------------------------------------------------


def _candidates(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: the candidate pairs of each block.

    A pair that has a lesser token in common, among the first of both, is left to that token's block,
    where the same bound lets it pass; what still repeats is made distinct later.
    """
    key, rows = None, []

    def ended() -> Iterator[pa.RecordBatch]:
        groups = np.array([r[1] for r in rows], np.int64)
        if len(rows) < 2 or (groups == groups[0]).all():
            return
        ids = np.array([r[0] for r in rows])
        if len(rows) <= FEW and key[1] == key[2]:  # less than a leaf: the lesser tokens first, then the same bound
            firsts, vectors = [frozenset(r[5]) for r in rows], [np.frombuffer(r[3], np.uint8) for r in rows]
            met = [(x, y) for x, y in combinations(range(len(rows)), 2) if groups[x] != groups[y] and firsts[x].isdisjoint(firsts[y]) and bounded(vectors[x], vectors[y], rows[x][2], rows[y][2])]
            if met:
                u, v = (ids[list(side)] for side in zip(*met, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])
            return
        tile = np.array([r[4] for r in rows])
        before: list[frozenset] = []
        for u, v in block_pairs([np.frombuffer(r[3], np.uint8) for r in rows], np.array([r[2] for r in rows]), groups, tile if key[1] != key[2] else None):
            before = before or [frozenset(r[5]) for r in rows]
            here = np.fromiter((before[x].isdisjoint(before[y]) for x, y in zip(u.tolist(), v.tolist(), strict=True)), bool, len(u))
            u, v = ids[u[here]], ids[v[here]]
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])

    for batch in (b for b in it if b.num_rows):
        block = [batch.column(c).to_numpy() for c in range(3)]
        begin = np.concatenate(([0], np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in block])) + 1, [batch.num_rows]))
        length = np.diff(begin)
        small = (length <= FEW) & (block[1][begin[:-1]] == block[2][begin[:-1]])
        small[[0, -1]] = False  # these may go on in other batches
        yield from _few(batch, np.repeat(np.where(small, np.arange(len(small)), -1), length))
        for b in np.flatnonzero(~small).tolist():
            whole = batch.slice(begin[b], length[b])
            here = tuple(int(x[begin[b]]) for x in block)
            if here != key:
                yield from ended()
                key, rows = here, []
            rows += [(node, comp, n, point, tile, first) for tile, node, comp, n, point, first in zip(*(c.to_pylist() for c in whole.columns[3:]), strict=True)]
    yield from ended()


def _few(batch: pa.RecordBatch, block: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The candidate pairs of the blocks of FEW rows at most in a batch; ``block`` numbers them, -1 is none of them. As for others, lesser tokens first, then the bound."""
    node, comp, n = (batch.column(c).to_numpy() for c in (4, 5, 6))
    met = []
    for d in range(1, min(FEW, len(block))):
        x = np.flatnonzero((block[d:] == block[:-d]) & (block[d:] >= 0) & (comp[d:] != comp[:-d]) & (4 * n[d:] >= 3 * n[:-d]) & (4 * n[:-d] >= 3 * n[d:]))
        met.append(np.stack([x, x + d]))
    x, y = np.concatenate(met, axis=1) if met else np.empty((2, 0), np.int64)
    if not len(x):
        return
    points, firsts = batch.column(7), batch.column(8)
    at, tokens = firsts.offsets.to_numpy(), firsts.values.to_numpy()
    count = np.diff(at)
    apart = np.ones(len(x), bool)
    for i in range(count[x].max(initial=0)):  # FIRST at most
        with_i = np.flatnonzero(apart & (count[x] > i))
        mine = tokens[at[x[with_i]] + i]
        for j in range(count[y[with_i]].max(initial=0)):
            both = count[y[with_i]] > j
            apart[with_i[both]] &= tokens[at[y[with_i[both]]] + j] != mine[both]
    x, y = x[apart], y[apart]
    vectors = {i: np.frombuffer(points[i].as_buffer(), np.uint8) for i in set(x.tolist()) | set(y.tolist())}
    keep = np.fromiter((bounded(vectors[i], vectors[j], n[i], n[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)), bool, len(x))
    u, v = node[x[keep]], node[y[keep]]
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast a written table of numbers if its counted rows are few."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _blocks_of(live: DataFrame) -> DataFrame:
    """A row for each token of a document and its block: the token, or for one of more than TILE rows each pair of its tiles.

    The rows of such a token are grouped by size, and apart by each component that has more than TILE
    of them; a group's tiles meet those of groups whose sizes are near enough and whose component is
    another. Only the table of such tokens is joined. ``first`` has the least FIRST tokens of the
    document below the token.
    """
    # sizes that may link are at most one bucket apart
    rows = live.withColumn("bucket", F.floor(F.log(4 / 3, "n")).cast("int"))
    each = rows.select("component", "bucket", F.explode("tokens").alias("token"))
    counts = each.groupBy("token", "bucket", "component").agg(F.count("*").alias("here"))
    large = counts.groupBy("token").agg(F.sum("here").alias("rows")).where(F.col("rows") > TILE).select("token")
    held = counts.join(large, "token").withColumn("big", F.when(F.col("here") > TILE, F.col("component")))
    groups = held.groupBy("token", "bucket", "big").agg(F.ceil(F.sum("here") / TILE).cast("int").alias("tiles"))
    numbered = groups.withColumn("base", F.sum("tiles").over(Window.partitionBy("token").orderBy("bucket", "big")) - F.col("tiles"))
    shape = materialize(numbered.groupBy("token").agg(F.collect_list(F.struct("bucket", "big", "tiles", F.col("base").cast("int").alias("base"))).alias("shape")), files_for(live.sparkSession))
    head = rows.withColumn("head", F.slice("tokens", 1, FIRST))
    entries = head.select("node", "component", "n", "point", "head", "bucket", F.posexplode("tokens").alias("rank", "token"))
    entries = entries.withColumn("first", F.slice("head", F.lit(1), F.least("rank", F.lit(FIRST)))).drop("head", "rank")
    tiled = entries.join(_sized(shape), "token", "left")
    here = F.filter("shape", lambda g: g["bucket"] == F.col("bucket"))
    own = F.coalesce(F.get(F.filter(here, lambda g: g["big"] == F.col("component")), F.lit(0)), F.get(F.filter(here, lambda g: g["big"].isNull()), F.lit(0)))
    tiled = tiled.withColumn("own", own).withColumn("tile", F.coalesce(F.col("own.base") + F.pmod(F.xxhash64("node"), F.col("own.tiles")).cast("int"), F.lit(0)))
    met = F.filter("shape", lambda g: (F.abs(g["bucket"] - F.col("bucket")) <= 1) & F.coalesce(g["big"] != F.col("own.big"), F.lit(True)))
    others = F.coalesce(F.flatten(F.transform(met, lambda g: F.sequence(g["base"], g["base"] + g["tiles"] - 1))), F.array(F.lit(0)))
    out = tiled.select("*", F.explode(others).alias("other"))
    return out.select("token", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "component", "n", "point", "first")


def _verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text of a, text of b), those of one a together: the pairs that are links."""
    known: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
    for whole in it:
        for batch in _batches(whole, 64):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, keep = batch.column(2), []
            for k, right in enumerate(shingle_sets(batch.column(3).to_pylist())):
                if known[0] != a[k]:
                    known = (a[k], next(shingle_sets([left[k].as_py()])))
                if linked(known[1], right):
                    keep.append(k)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in keep], pa.int64()) for x in (a, b)], names=["a", "b"])


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) of nodes that are links; ``texts`` has (``node``, ``text``)."""
    some, _ = bitmap_split(texts, "node", pairs.select(F.explode(F.array("a", "b")).alias("node")))
    left = some.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = some.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text").mapInArrow(lean(_verify), "a long, b long")


# -- the operator -----------------------------------------------------------------------------------


def _merged(labels: DataFrame | None, links: DataFrame, files: int) -> DataFrame:
    """(``node``, ``component``) of all nodes that have links, after ``links`` between components."""
    more = components(links, files).withColumnRenamed("id", "node")
    if labels is None:
        return more
    to = more.select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = labels.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialize(moved.unionByName(more.join(labels.select("node"), "node", "left_anti")), files)


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(_sized(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _bits(entries: int) -> int:
    """Positions of a bitmap for the dividing among so many tokens, a few in a hundred: 2**20 to 2**28 (32 MB); a full one only lets more pass."""
    return 1 << min(28, max(20, (2 * entries).bit_length()))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``n_shingles``, ``component_id``) for each row of ``docs`` (``doc_id``, ``text``, others ignored).

    Two documents link when the Jaccard similarity of their sets of distinct five-word shingles is
    0.75 or more; ``component_id`` is the smallest doc_id that links reach. A null or empty text has
    an empty set and links with nothing; of one to four words the whole sequence is the one shingle.
    Rows that repeat a doc_id are reported each, by their own text. A row without a doc_id is counted,
    links with nothing and has a null component. An empty table gives no rows.
    Sets are told apart by 64-bit sums of their 64-bit shingle hashes.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    many, few = files_for(spark, size=size), files_for(spark, rows=total)
    entries = size // 24 + 1  # a prefix has a quarter of a set, a word some six bytes
    parts, bits = max(1, entries // 250_000), _bits(entries)
    sketch = materialize(docs.mapInArrow(lean(_sketches(parts)), _SKETCH), many)
    rows = materialize(sketch.where("n is not null").select("doc_id", "mark", "node", "n"), few)
    words = sketch.where("n is null and part is null").select("token", "component")
    heavy = words.mapInArrow(lean(_unpacked), "token long, times long").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(HEAVY).toArrow()
    known = dividing(sketch.where("part is not null").select("part", "token", "component", F.col("size").alias("n")), bits)
    discard(sketch)

    some = rows.where("n > 0 and doc_id is not null")
    classes = materialize(some.groupBy("node").agg(F.min("doc_id").alias("class")), few)
    copies = materialize(some.join(classes, "node").where("doc_id > class").select("doc_id", "mark").distinct(), few)
    likely, sure = bitmap_split(docs.where("doc_id is not null"), "doc_id", copies.select("doc_id"))
    own = likely.join(copies, ["doc_id", "mark"], "left_anti").select(*docs.columns).unionByName(sure)

    order = spark.sparkContext.broadcast(Order(heavy.column("token").to_numpy().view(np.uint64), known))
    bitmap = spark.sparkContext.broadcast(dividing(own.mapInArrow(lean(_prefixes(order, parts)), "part long, token binary, component binary, n binary"), bits))
    inside = materialize(own.mapInArrow(lean(_inside(order, bitmap)), _INSIDE), many)
    for shared in (order, bitmap):
        shared.unpersist()
    discard(copies)

    labels: DataFrame | None = None
    found = 0
    for k in range(SETTLE):
        hashed = F.transform("tokens", lambda t: F.struct(F.xxhash64(t, F.lit(k)).alias("h"), t.alias("token")))  # noqa: B023
        met = _labelled(inside, labels).select(F.array_min(hashed)["token"].alias("token"), F.array_max(hashed)["token"].alias("other"), "node", "component", "n", "point", "text")
        dealt = met.repartitionByRange("token", "other", "node").sortWithinPartitions("token", "other", "node")
        links = materialize(dealt.select("token", "component", "n", "point", "text", F.length("text").alias("chars")).mapInArrow(lean(_settle), "a long, b long").repartition(few))
        here = links.count()
        if here:
            labels = _merged(labels, links, few)
        if 8 * here <= (found := found + here):  # the exact step finds what is left
            break

    light = materialize(_labelled(inside.select("node", "n", "tokens", "point"), labels), many)
    left = spark.sparkContext.broadcast(dividing(light.select("component", "n", "tokens").mapInArrow(lean(_dealt(parts)), "part long, token binary, component binary, n binary"), bits))
    live = materialize(light.select("node", "component", "n", "point", "tokens").mapInArrow(lean(_still(left)), "node long, component long, n long, point binary, tokens array<long>"), many)
    left.unpersist()
    blocks = _blocks_of(live).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    pairs = materialize(blocks.mapInArrow(lean(_candidates), "a long, b long").distinct(), many)
    more = verified(inside.select("node", "text"), pairs)
    component = lambda c: light.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    labels = _merged(labels, (more.join(component("a"), "a").join(component("b"), "b").select(F.col("a_c").alias("a"), F.col("b_c").alias("b"))), few)

    # a component's id is the smallest of its nodes' ids; most nodes have no link
    named = materialize(classes.join(labels, "node"), few)
    least = named.groupBy("component").agg(F.min("class").alias("component_id"))
    reached = named.join(least, "component").select("node", "component_id")
    of_node = classes.join(reached, "node", "left").select("node", F.coalesce("component_id", "class").alias("component_id"))
    full = some.select("doc_id", "node", "n").join(of_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = rows.where("not (n > 0 and doc_id is not null)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    for done in (inside, light, live, pairs):
        discard(done)
    return full.unionByName(rest)
