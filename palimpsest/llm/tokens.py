"""Public tokenizers inside tasks: loaded once per Python worker from a path that is a parameter."""

from __future__ import annotations

import base64
import functools

import numpy as np

#: Where the vocabulary lies on every machine; the file is read there and never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that splits text before the merges of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The tokenizer of a rank file; no special tokens, so their strings are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def token_bytes(path: str = VOCABULARY) -> np.ndarray:
    """Length in bytes of each token id."""
    enc = encoding(path)
    out = np.zeros(enc.n_vocab, dtype=np.int32)
    for token in enc.token_byte_values():
        out[enc.encode_single_token(token)] = len(token)
    return out
