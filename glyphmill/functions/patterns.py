"""8x8 two-colour patterns as one BIGINT: byte r of the big-endian number is row r, its top bit the left column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = -1


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def median64(values: Column | str) -> Column:
    """The mean of the 32nd and 33rd of 64 values."""
    a = F.sort_array(_c(values))
    return (F.get(a, F.lit(31)).cast("double") + F.get(a, F.lit(32)).cast("double")) / 2


def pack_bits(bits: list[Column]) -> Column:
    """64 booleans in row-major order to a pattern; one flat expression, so it stays in generated code without explode or shuffle."""
    terms = [F.when(b, F.lit(1 << (63 - i) if i else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i, b in enumerate(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), terms)


def pattern_of(values: Column | str, median: Column) -> Column:
    """Foreground where a value is at least the median."""
    v = _c(values)
    return pack_bits([F.get(v, F.lit(i)).cast("double") >= median for i in range(64)])


def invert(p: Column | str) -> Column:
    return F.bitwise_not(_c(p))


def is_inverted(p: Column | str) -> Column:
    return _c(p) < 0


def canonical(p: Column | str) -> Column:
    """The lower of a pattern and its inverse as unsigned bytes: the one whose first bit is clear."""
    return F.when(_c(p) < 0, F.bitwise_not(_c(p))).otherwise(_c(p))


def popcount(p: Column | str) -> Column:
    return F.bit_count(_c(p))


def hamming(p: Column | str, q: Column | str) -> Column:
    return F.bit_count(_c(p).bitwiseXOR(_c(q)))


def mask(p: Column | str) -> Column:
    """64 booleans in row-major order."""
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(_c(p), 63 - i) == 1)


def row_byte(p: Column | str, r: int) -> Column:
    return F.shiftrightunsigned(_c(p), 56 - 8 * r).bitwiseAND(F.lit(255)).cast("int")


def horizontal_edges(p: Column | str) -> Column:
    """Neighbours in a row that differ: 7 to a row."""
    return F.bit_count(_c(p).bitwiseXOR(F.shiftright(_c(p), 1)).bitwiseAND(F.lit(0x7F7F7F7F7F7F7F7F)))


def vertical_edges(p: Column | str) -> Column:
    return F.bit_count(_c(p).bitwiseXOR(F.shiftright(_c(p), 8)).bitwiseAND(F.lit(0x00FFFFFFFFFFFFFF)))


def edge_descriptor(p: Column | str) -> Column:
    """Array of 64: transitions to the right and down at each place, the first two replaced by the totals."""
    right = _c(p).bitwiseXOR(F.call_function("shiftleft", _c(p), F.lit(1))).bitwiseAND(F.lit(~0x0101010101010101))
    down = _c(p).bitwiseXOR(F.call_function("shiftleft", _c(p), F.lit(8))).bitwiseAND(F.lit(~0xFF))
    at = lambda i: (F.getbit(right, F.lit(63 - i)) + F.getbit(down, F.lit(63 - i))).cast("double")
    return F.array(horizontal_edges(p).cast("double"), vertical_edges(p).cast("double"), *[at(i) for i in range(2, 64)])


def density(p: Column | str) -> Column:
    """Array of 17: share of set bits in all, in each row, in each column."""
    rows = [F.bit_count(_c(p).bitwiseAND(F.lit(_signed(0xFF << (56 - 8 * r))))) / 8 for r in range(8)]
    cols = [F.bit_count(_c(p).bitwiseAND(F.lit(_signed(0x0101010101010101 << (7 - k))))) / 8 for k in range(8)]
    return F.array(F.bit_count(_c(p)) / 64, *rows, *cols)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def flat(values: Column | str) -> Column:
    """All 64 values equal."""
    return F.array_min(_c(values)) == F.array_max(_c(values))
