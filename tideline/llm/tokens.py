"""Byte-level BPE ids, built once per worker process from the public vocabulary files."""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np

_encoders: dict[tuple[str, str], Callable[[str], list[int]]] = {}
END_OF_TEXT = "<|endoftext|>"


def default_paths() -> tuple[str, str]:
    """The tokenizer and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(paths: tuple[str, str] | None = None, special: bool = True) -> Callable[[str], list[int]]:
    """text -> ids. With special, the end-of-text string in a text is its special id, as the tokenizer file
    has it; without, it is ordinary text and its id never comes up."""
    import public_tokenizers
    import tiktoken

    paths = paths or default_paths()
    if paths not in _encoders:
        with open(paths[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("tideline", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        full: list = []

        def encode(text: str, special: bool) -> list[int]:
            if special and END_OF_TEXT in text:
                if not full:
                    from tokenizers import Tokenizer

                    full.append(Tokenizer.from_file(paths[0]))
                return full[0].encode(text, add_special_tokens=False).ids
            return own.encode_ordinary(text)

        _encoders[paths] = encode
    e = _encoders[paths]
    return lambda text: e(text, special)


def as_array(ids: list[int], dtype: str) -> np.ndarray:
    return np.fromiter(ids, dtype, len(ids))
