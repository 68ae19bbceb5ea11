"""Sets of word shingles as sorted hashes, computed over many texts at once, and their min-hash bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words of a shingle, and the similarity of sets from which on texts are near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands of min-hashes, and min-hashes in each: of pairs of similarity 0.8 a share of (1 - 0.8 ** BAND) ** BANDS = 7e-5 has no band in common, of pairs of 0.85 3e-6.
BANDS, BAND, SEED = 24, 5, 42
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that are hashed together.
GROUP = 1 << 18
_rng = np.random.default_rng(SEED)
MIXERS, ODD = _rng.integers(0, 1 << 32, BANDS * BAND, np.uint32), _rng.integers(0, 1 << 32, BANDS * BAND, np.uint32) | np.uint32(1)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers; the longest series of each base is held, some megabytes a worker."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(1 << max(16, n.bit_length()), base, np.uint64)
        out[:1] = 1
        _powers[base] = np.cumprod(out)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about GROUP bytes, cut before white space."""
    at = 0
    while len(text) - at > 2 * GROUP:
        window = np.flatnonzero(SPACE[np.frombuffer(text, np.uint8, GROUP, at + GROUP)])
        if not len(window):
            break
        to = at + GROUP + int(window[0])
        yield text[at:to]
        at = to
    yield text[at:]


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of raw and the place at which it begins; a word's hash is the same wherever it stands."""
    data = np.frombuffer(raw, np.uint8)
    space = np.concatenate(([True], SPACE[data], [True]))
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(int(BASE), len(data)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(int(INVERSE), len(data))[starts]), starts


def word_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, A-Z lower-cased; words are what stands between the six ASCII white spaces."""
    raw = [x.encode().lower() for x in texts]  # of bytes: A-Z alone
    i = 0
    while i < len(raw):
        j, size = i + 1, len(raw[i])
        while j < len(raw) and size + len(raw[j]) <= GROUP:
            size += len(raw[j])
            j += 1
        if j == i + 1:
            yield np.concatenate([hashed_words(x)[0] for x in pieces(raw[i])])
        else:
            found, starts = hashed_words(b" ".join(raw[i:j]))
            edges = np.cumsum([len(x) + 1 for x in raw[i:j]])
            yield from np.split(found, np.searchsorted(starts, edges[:-1]))
        i = j


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes of the shingles; of the whole sequence if it is shorter, of nothing if there is no word."""
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        out = (out + words[j : j + len(out)]) * BASE
        out ^= out >> np.uint64(31)
    return np.unique(mixed(out))


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    return map(shingle_set, word_hashes(texts))


def band_keys(x: np.ndarray) -> np.ndarray:
    """A key for each band of a set: two sets share a band's key if all its min-hashes agree, which each does with a chance of their similarity."""
    low = (x >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(MIXERS), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 256):
        part = (low[i : i + 256, None] ^ MIXERS[None, :]) * ODD[None, :]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        part ^= part >> np.uint32(12)
        np.minimum(least, part.min(0), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND).T.astype(np.uint64):
        out = (out ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)
