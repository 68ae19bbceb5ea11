"""Byte-level BPE through the public vocabulary files, in tasks of Spark."""

from __future__ import annotations

import base64
import functools

import numpy as np

SPECIAL = "<|endoftext|>"
RANKS = "byte_bpe_50k.tiktoken"


@functools.cache
def encoding(ranks: str = RANKS):
    """The vocabulary in the tiktoken library, one for each worker.

    It gives the ids of the tokenizers library for byte_bpe_50k.json (tests compare them), about four times as fast.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={SPECIAL: len(known)})


def ids(text: str, ranks: str = RANKS) -> np.ndarray:
    """The ids of a text; where it names the special token, that token, as is the default of the tokenizers library."""
    return encoding(ranks).encode_to_numpy(text, allowed_special="all")


@functools.cache
def id_bytes(ranks: str = RANKS) -> list[bytes]:
    """The bytes of each id."""
    x = encoding(ranks)
    return [*(x.decode_single_token_bytes(i) for i in range(x.n_vocab - 1)), SPECIAL.encode()]


@functools.cache
def id_lengths(ranks: str = RANKS) -> np.ndarray:
    """The number of bytes of each id."""
    return np.array([len(x) for x in id_bytes(ranks)])
