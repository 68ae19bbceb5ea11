"""Token counts; huge documents are encoded in overlapping chunks, spliced where both encodings must agree.

Two neighbouring chunks are spliced at a place in their overlap that is a token boundary in both and stable. A place is stable, whatever stands further left or right,

* before a space that follows a character other than white space, and between a letter, an ASCII digit and ASCII punctuation (but the apostrophe) if these differ:
  the pre-tokenizer always splits there;
* inside a run of letters, digits or such punctuation, away from its begin and end, if the two tokens that meet there are what their own text is encoded as.
  A sequence of tokens within a piece is its encoding if each two neighbours are; so the tokens left of the place and those right of it are.

If there is none, the overlap is widened, in the end to the whole of the chunk before, and the work goes on with both as one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_map

LIMIT = 512
#: Characters of a chunk, and of the first overlap.
CHUNK, OVERLAP = 32_768, 256
SPLITTING = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def boundaries(part: str, encode) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a chunk and the offset in bytes at which each begins."""
    got = encode(part)
    ends = np.cumsum(bpe.id_lengths()[got])
    return got, np.concatenate(([0], ends[:-1])) if len(got) else ends


def kind(c: str) -> str:
    """l for a letter, d for an ASCII digit, p for ASCII punctuation that splits, else nothing."""
    return "l" if c.isalpha() else "d" if c in "0123456789" else "p" if c in SPLITTING else ""


def always_splits(text: str, at: int) -> bool:
    a, b = text[at - 1], text[at]
    return b == " " and not a.isspace() or kind(a) != kind(b) and kind(a) != "" and kind(b) != ""


def inside_run(text: str, at: int) -> bool:
    kinds = {kind(c) for c in text[max(0, at - 4) : at + 2]}
    return len(kinds) == 1 and "" not in kinds and at >= 4


def splice_at(text: str, start: int, end: int, left, right, encode=bpe.ids) -> tuple[int, int, int] | None:
    """In text[start:end], the overlap of two chunks: a stable place at which both have a boundary, and the numbers of the ids before it.

    left and right give (text position at which the chunk begins, its ids, their offsets in bytes).
    """
    low = max(start, right[0]) + 1
    sizes = np.fromiter((len(c.encode()) for c in text[low:end]), np.int64, end - low) if end > low else np.empty(0, np.int64)
    places = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    both = []
    for begin, _, starts in (left, right):
        offsets = places + len(text[begin:low].encode())
        k = np.searchsorted(starts, offsets)
        both.append(np.where((k < len(starts)) & (starts[np.minimum(k, len(starts) - 1)] == offsets), k, -1))
    common = [i for i in np.flatnonzero((both[0] > 0) & (both[1] > 0)).tolist() if bpe.SPECIAL not in text[max(0, low + i - len(bpe.SPECIAL) + 1) : low + i + len(bpe.SPECIAL) - 1]]
    for i in common:
        if always_splits(text, low + i):
            return low + i, int(both[0][i]), int(both[1][i])
    for i in common:
        if inside_run(text, low + i):
            pair = [int(left[1][both[0][i] - 1]), int(right[1][both[1][i]])]
            met = b"".join(bpe.id_bytes()[x] for x in pair).decode(errors="replace")
            if encode(met).tolist() == pair:
                return low + i, int(both[0][i]), int(both[1][i])
    return None


def spliced(text: str, encode=bpe.ids, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The ids of a whole text, of which no more than some chunks are encoded at once."""
    parts, start, end = [], 0, min(len(text), chunk)
    got, starts = boundaries(text[start:end], encode)
    while end < len(text):
        further, wide = min(len(text), end + chunk), overlap
        while True:
            begin = max(start, end - wide)
            if begin == start:  # no agreement: both chunks as one
                end = further
                got, starts = boundaries(text[start:end], encode)
                break
            more, more_starts = boundaries(text[begin:further], encode)
            if found := splice_at(text, begin, end, (start, got, starts), (begin, more, more_starts), encode):
                at, before, skipped = found
                parts.append(got[:before])
                got, start, end = more[skipped:], at, further
                starts = more_starts[skipped:] - (more_starts[skipped] if skipped < len(more_starts) else 0)
                break
            wide *= 4
    return np.concatenate([*parts, got])


def n_tokens(text: str) -> int:
    return len(bpe.ids(text) if len(text) <= CHUNK else spliced(text))


def token_counts(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit for each row of docs, repeats included.

    A null text counts as empty, with 0 tokens; a null doc_id stays null; an empty table gives no rows; other columns don't matter. A text of any length is counted whole.
    """

    def make():
        return lambda doc_ids, texts, sizes: {
            "doc_id": doc_ids, "n_bytes": sizes, "n_tokens": (n := [n_tokens(x or "") for x in texts]), "over_limit": [x > limit for x in n],
        }

    sized = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return arrow_map(sized, ["doc_id", "text", "n"], make, SCHEMA)
