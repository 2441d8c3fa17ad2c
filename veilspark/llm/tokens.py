"""Byte-level BPE ids, from vocabulary files whose path is a parameter."""

from __future__ import annotations

import base64
import functools

import numpy as np


#: Taken as one id wherever a text holds it, as the tokenizers library does.
END_OF_TEXT = {"<|endoftext|>": 50256}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def encoder(path: str):
    """A tiktoken encoding of the ranks in a file, loaded once in each Python worker. Its one special token is END_OF_TEXT."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=END_OF_TEXT)


def encode(text: str | None, path: str, special: bool = True) -> np.ndarray:
    """Ids of the whole text as unsigned 32-bit numbers; none for a null. Unless special, END_OF_TEXT is spelt in ordinary ids."""
    return encoder(path).encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=()).astype(np.uint32) if text else np.empty(0, np.uint32)
