"""Token ids of whole texts by a byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import sys
from array import array

import numpy as np

#: The id behind each document's end.
END_ID = 1


def vocabulary_path() -> str:
    """The rank file of the installed vocabulary: the one of `byte_bpe_50k.json` of the tokenizers library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Tokenizer:
    """Ids as the tokenizers library gives them without special tokens (it is several times slower)."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def __call__(self, text: str | None) -> bytes:
        """The ids of a text (null: empty) and its end, as 16-bit little-endian numbers; no id needs more."""
        ids = array("H", self._encode(text) if text else ())
        ids.append(END_ID)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def ids_of(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2")
