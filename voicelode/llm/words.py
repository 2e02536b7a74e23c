"""Words of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from voicelode.llm.common import SpanHasher, mix64

#: Byte classes: letters and digits in ASCII, and every byte of other characters.
ALNUM = np.array([(48 <= b <= 57) or (65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)])
#: All but the space and the control characters 9 to 13.
NOT_BLANK = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lowered(column) -> list[bytes]:
    """The texts of an Arrow column as bytes, A to Z lower-cased, null as empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass").translate(LOWER) for t in column.to_pylist()]


class Words:
    """The words of some texts: `hashes`, `starts`, `ends` (bytes of `data`), and `at`, the first word of each text (with the end)."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, hasher: SpanHasher):
        joined = b"\n".join([b"", *texts, b""])
        self.data = np.frombuffer(joined, np.uint8)
        inside = is_word[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        self.begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.at = np.searchsorted(self.starts, self.begins)
        self.hashes = hasher(self.data, self.starts, self.ends)


_STEP = np.uint64(0xA0761D6478BD642F)


def shingles(words: Words, size: int) -> list[np.ndarray]:
    """The set of each text's shingles of `size` words, sorted; a shorter text with words has one, of all its words."""
    h, out = words.hashes, []
    if len(h) >= size:
        rolled = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            rolled = rolled * _STEP + h[k : len(h) - size + 1 + k]
        rolled = mix64(rolled)
    for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for i in range(a, b):
                whole = mix64(whole * _STEP + h[i : i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
