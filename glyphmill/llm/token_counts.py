"""Token counts of fields and sections, from one encoding of each whole document.

A token's span is in characters, as ``tokenizers`` gives its offsets: byte-level ids cover the text's
bytes without gaps, so their byte lengths give byte spans, and the count of characters that begin
before a byte turns these into characters; tokens that share a character overlap there. Sections are
spans of the same text, in order and without gaps; the interval join is a merge of two sorted lists.
A token that crosses a boundary is allocated by an explicit rule.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import bounded_batches, lean
from glyphmill.llm.tokens import byte_bpe, vocabulary_path

RULES = ("first", "most")
SECTIONS = ("lines", "paragraphs", "fields")


def char_spans(lengths: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each token in characters, from byte lengths; and the number of characters that begin before each byte."""
    begun = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    end = np.cumsum(lengths)
    start = end - lengths
    return begun[np.minimum(start + 1, len(data))] - 1, begun[end], begun


def attribute_spans(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section ``[bounds[i], bounds[i + 1])``, and those that begin in it and reach beyond.

    ``first``: a token belongs to the section of its first character. ``most``: to the section that
    holds most of its characters, the earlier one at a tie. ``bounds`` start at 0, end at the text's
    length and may repeat: such a section is empty and has no token.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    first = np.searchsorted(bounds, start, side="right") - 1
    last = np.maximum(np.searchsorted(bounds, end, side="left") - 1, first)
    n = len(bounds) - 1
    crossing = np.bincount(first[last > first], minlength=n)
    home = first.copy()
    if rule == "most":
        best = np.minimum(bounds[np.minimum(first + 1, n)], end) - start
        for step in range(1, int((last - first).max(initial=0)) + 1):
            at = np.minimum(first + step, n - 1)
            held = np.where(first + step <= last, np.minimum(bounds[at + 1], end) - bounds[at], 0)
            home = np.where(held > best, at, home)
            best = np.maximum(best, held)
    return np.bincount(home, minlength=n), crossing


def attribute(token_lengths: np.ndarray, bounds: np.ndarray, rule: str = "first") -> np.ndarray:
    """``attribute_spans`` for tokens one after another."""
    end = np.cumsum(token_lengths)
    return attribute_spans(end - token_lengths, end, bounds, rule)[0]


def _sections(data: bytes, by: str, lines: int) -> np.ndarray:
    """Bounds in bytes: ``lines`` lines with their line ends, or paragraphs with the empty lines after them; an empty text is one empty section."""
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    if by == "paragraphs":  # the last of line ends that follow each other
        ends = breaks[(np.diff(breaks, append=-1) != 1) & (np.diff(breaks, prepend=-1) == 1)]
    else:
        ends = breaks[lines - 1 :: lines]
    return np.concatenate(([0], ends[ends < len(data)], [len(data)]))


def count_tokens(docs: DataFrame, *, path: str | None = None, fields: Sequence[str] = ("text",), sep: str = "\n", by: str = "lines", lines: int = 1, rule: str = "first") -> DataFrame:
    """(``doc_id``, ``section``, ``start``, ``length``, ``n_tokens``, ``n_crossing``, ``doc_tokens``) for each section of each row of ``docs``.

    A document is its ``fields`` with ``sep`` between them, encoded as one text. Sections are
    ``lines`` lines with their line ends, paragraphs, or the fields, each with the separator after it;
    ``start`` and ``length`` are in characters. ``n_crossing`` counts the tokens that begin in a
    section and reach beyond it. The sections' ``n_tokens`` add up to ``doc_tokens``. Null fields are
    empty; an empty document has one empty section, or one a field; repeated rows and null ids are
    counted each; an empty table gives no rows. Other columns are ignored.
    """
    if by not in SECTIONS or rule not in RULES:
        raise ValueError(f"by must be one of {SECTIONS}, rule one of {RULES}")
    path = path or vocabulary_path()
    bounded_batches(docs.sparkSession)
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "section", "start", "length", "n_tokens", "n_crossing", "doc_tokens")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for whole in it:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids_of, out = [], []
                parts = [[x or "" for x in row] for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
                texts = [sep.join(p) for p in parts]
                ids, cut = bpe.encode_batch(texts)
                for k, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), texts, strict=True)):
                    data = text.encode()
                    start, end, begun = char_spans(bpe.byte_lengths[ids[cut[k] : cut[k + 1]]], data)
                    if by == "fields":
                        bounds = np.cumsum([0, *(len(p) + len(sep) for p in parts[k][:-1]), len(parts[k][-1])])
                    else:
                        bounds = begun[_sections(data, by, lines)]
                    n, crossing = attribute_spans(start, end, bounds, rule)
                    ids_of += [doc] * len(n)
                    out.append(np.stack([np.arange(len(n)), bounds[:-1], np.diff(bounds), n, crossing, np.full(len(n), len(start))]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(ids_of, pa.int64()), *map(pa.array, np.concatenate(out, axis=1).astype(np.int64))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in fields]).mapInArrow(lean(run, keeps=True), ", ".join(f"{f.name} long" for f in schema))
