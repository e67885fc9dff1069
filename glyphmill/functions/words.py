"""Cell words, chunk ranges and colour table bytes of the container, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_WORDS = 1024


def char_word(char: Column, font: Column, fg_lut: Column, bg_lut: Column, invert: Column) -> Column:
    """Bits 0-7 character, 8-9 font bank, 10 foreground table, 11 background table, 12 invert."""
    up = lambda c, n: F.shiftleft(c.cast("int"), n)
    return char.cast("int").bitwiseOR(up(font, 8)).bitwiseOR(up(fg_lut, 10)).bitwiseOR(up(bg_lut, 11)).bitwiseOR(up(invert, 12))


def char_fields(word: Column) -> dict[str, Column]:
    bits = lambda n, m: F.shiftright(word, n).bitwiseAND(F.lit(m))
    return {"char_idx": bits(0, 255), "font_set": bits(8, 3), "fg_lut": bits(10, 1), "bg_lut": bits(11, 1), "invert": bits(12, 1)}


def colour_word(fg: Column, bg: Column) -> Column:
    """Low byte background, high byte foreground."""
    return F.shiftleft(fg.cast("int"), 8).bitwiseOR(bg.cast("int"))


def font_bank(font_set: Column, frame_idx: Column) -> Column:
    """Frames take banks 0-1 and 2-3 in turn where each frame brings its own fonts."""
    return (font_set + (frame_idx % 2) * 2) % 4


def font_slot(medoid_id: Column) -> tuple[Column, Column]:
    """Font set and character of a glyph number."""
    return F.floor(medoid_id / 256).cast("int"), (medoid_id % 256).cast("int")


def chunk_of(tile_idx: Column) -> tuple[Column, Column]:
    """Chunk id and byte offset of a cell's word: 1024 words to a chunk."""
    return F.floor(tile_idx / CHUNK_WORDS).cast("int"), (tile_idx % CHUNK_WORDS * 2).cast("int")


def lut_chunk_ids(lut: Column) -> tuple[Column, Column]:
    """Chunk ids of a foreground and a background table."""
    return lut.bitwiseAND(F.lit(1)), lut.bitwiseAND(F.lit(1)) + 2


def palette_chunk_id(idx: Column, fg_count: Column) -> Column:
    """Chunk id of a table in a list of the foreground tables, then the background ones."""
    return F.when(idx < fg_count, idx).otherwise(idx - fg_count + 2)


def lut_bytes(colours: Column) -> Column:
    """BGRA bytes of an ordered array of (r, g, b); entry 0 is transparent, all others opaque."""
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    entry = F.transform(colours, lambda c, i: F.concat(two(c["b"]), two(c["g"]), two(c["r"]), F.when(i == 0, "00").otherwise("FF")))
    return F.unhex(F.array_join(entry, ""))
