"""Byte-level BPE of batches of texts."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

from .common import tokenizer_path


@lru_cache(2)
def encoding(name: str = "byte_bpe_50k.tiktoken"):
    """The vocabulary of byte_bpe_50k.json, from its ranks; special tokens' strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_path(name), "rb"))}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def token_bytes(name: str = "byte_bpe_50k.tiktoken") -> np.ndarray:
    """The number of bytes of each token."""
    enc = encoding(name)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)


def encode(text: str | None) -> np.ndarray:
    """The ids of a whole text; none for null."""
    return np.array(encoding().encode_ordinary(text), np.uint32) if text else np.zeros(0, np.uint32)
