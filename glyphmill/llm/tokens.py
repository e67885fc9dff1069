"""Byte-level BPE ids, equal to those that ``tokenizers`` gives with the same file and ``add_special_tokens=False``, and their spans."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from functools import lru_cache
from itertools import count, islice

import numpy as np

from glyphmill.llm.common import kept

MAX_KNOWN = 600_000  # words kept in a worker's table, which begins anew beyond it


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others in order from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encodes whole texts. The file's added tokens are found in texts, as ``tokenizers`` does, and what is between them is encoded apart.

    Where single spaces and line ends are all the white space, and none is at either end, each of
    them starts a piece of its own in the vocabulary's splitting pattern. Such texts are put
    together from a bounded table of words seen before; words that are new to it are encoded in one
    call for a batch, a line each. Any other text is encoded by itself.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte_of = _bytes_of_letters()
        added = {x["content"]: x["id"] for x in file["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in file["model"]["vocab"].items() if piece not in added}
        self._plain = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._added = added
        self._split = re.compile("|".join(f"({re.escape(x)})" for x in sorted(added, key=len, reverse=True))) if added else None
        self.byte_lengths = np.zeros(max([*ranks.values(), *added.values()]) + 1, np.int64)
        for piece, i in [*ranks.items(), *((x.encode(), i) for x, i in added.items())]:
            self.byte_lengths[i] = len(piece)
        self._line_end = self._whole("\n")[0]
        self._forget()

    def _whole(self, text: str) -> list[int]:
        if not any(x in text for x in self._added):
            return self._plain(text)
        out: list[int] = []
        for part in self._split.split(text):
            out += [self._added[part]] if part in self._added else self._plain(part or "")
        return out

    def _forget(self) -> None:
        self._known: dict[str, int] = defaultdict(count().__next__)  # a word to its number, by first sight
        self._flat = np.zeros(1 << 16, np.uint32)
        self._from = np.zeros(1 << 14, np.int64)
        self._size = np.zeros(1 << 14, np.int64)
        self._used = 0

    def _learn(self, new: list[str]) -> None:
        """Words as they stand in the table: after a line end, first of a text (marked by a return), or after a space."""
        ids = np.array(self._whole("\n".join(w[1:] if w[0] in "\n\r" else " " + w for w in new)), np.uint32)
        cut = np.flatnonzero(ids == self._line_end)
        start, end = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(ids)]))
        if self._used + len(ids) + len(new) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros(max(len(self._flat), len(ids) + len(new)), np.uint32)])
        n = len(self._known) - len(new)
        if n + len(new) > len(self._from):
            more = np.zeros(max(len(self._from), len(new)), np.int64)
            self._from, self._size = np.concatenate([self._from, more]), np.concatenate([self._size, more])
        # each word's ids keep one place before them, for the line end of those that begin with one
        led = np.fromiter((w[0] == "\n" for w in new), bool, len(new))
        self._flat[self._used] = self._line_end
        self._flat[self._used + 1 : self._used + 1 + len(ids)] = ids
        self._from[n : n + len(new)] = self._used + 1 + start - led
        self._size[n : n + len(new)] = end - start + led
        self._used += len(ids) + 1

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the bounds of each text's."""
        if len(self._known) > MAX_KNOWN:
            self._forget()
        words: list[str] = []
        counts, odd = [], {}
        for i, t in enumerate(texts):
            mine = t.replace("\n", " \n").split(" ")
            if t.replace("\n", " ").split(" ") != t.split() or any(x in t for x in self._added):
                odd[i] = np.array(self._whole(t), np.uint32)
                counts.append(0)
            else:
                counts.append(len(mine))
                mine[0] = "\r" + mine[0]  # as no word begins with white space, this one is like no other
                words += mine
        known, before = self._known, len(self._known)
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if len(known) > before:
            new = list(islice(reversed(known), len(known) - before))[::-1]
            self._learn(new)
        size = self._size[at]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self._flat[np.repeat(self._from[at] - ends[:-1], size) + np.arange(ends[-1])]
        bounds = ends[np.concatenate(([0], np.cumsum(counts)))]
        if odd:
            parts = [odd.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
            ids = np.concatenate(parts)
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return ids, bounds

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


kept.append(byte_bpe.cache_clear)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
