"""Secrets in texts: fixed patterns, and random strings found by token efficiency.

Under a BPE vocabulary prose takes few tokens for its characters, random strings many. A run of the characters of keys and encoded bytes is
split at / _ - and =. Neighbouring parts that are no words are judged together, characters against tokens, and if that says nothing each on its own: with too few characters for
a token they are a random string. Left out are known digests (hexadecimal digits alone, what
follows the name of a hash function, with its length), identifiers (digits alone, UUIDs), embedded files and encoded prose. Short strings and letters of one case alone,
which words of some languages and names in code resemble, must be less efficient still; the shortest must have digits and letters of both cases. All steps take time in proportion to the text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame

from . import bpe
from .common import arrow_map

#: The kinds in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # the shorter ones fail, and no longer one begins inside them
HEX = re.compile(r"[0-9a-f]{32,}")  # likewise
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
PART = re.compile(r"[A-Za-z0-9+]+")
PLAIN = re.compile(r"[0-9a-fA-F]+|[0-9+]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: A hash function's name, before or at the beginning of a run, and the lengths of its digests in base32 or base64, padded or not.
HASH = re.compile(r"(?i)\b(?:sha-?(?:1|224|256|384|512)|md5|blake2[bs]|blake3)[:=-]")
DIGESTS = frozenset((22, 24, 26, 27, 28, 32, 38, 39, 40, 43, 44, 52, 56, 64, 77, 80, 86, 88, 103, 104))
ONE_CASE = re.compile(r"[a-z]+|[A-Z]+|[A-Z][a-z]+")
#: What has digits and letters of both cases, and what stands before an embedded file.
MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])[^A-Z]*[A-Z]")
EMBEDDED = ";base64,"
#: Characters of a random string, of one that isn't very short, and of one that isn't short; it is random with fewer characters for a token than the ratio: of any, of a short one, of a
#: very short one, of letters of one case. A part of one case with so many characters for a token is a word.
LEAST, SHORT, LONG = 12, 16, 20
RATIO, SHORT_RATIO, SHORTEST_RATIO, ONE_CASE_RATIO, WORD_RATIO = 2.0, 1.8, 1.6, 1.9, 3
#: Tokens are counted over stretches of so many characters.
STRETCH = 4096
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the fixed patterns match, in code points."""
    found = []
    low = text.lower()
    if any(x in low for x in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@lru_cache(1 << 14)
def tokens(part: str) -> int:
    return sum(len(bpe.ids(part[i : i + STRETCH])) for i in range(0, len(part), STRETCH))


def is_random(parts: list[tuple[str, int]], ratio: float = RATIO) -> bool:
    """Whether parts, given with their tokens, are one random string."""
    size, n = sum(len(x) for x, _ in parts), sum(n for _, n in parts)
    if size < LEAST or all(PLAIN.fullmatch(x) for x, _ in parts):
        return False
    if size < SHORT and not MIXED.match("".join(x for x, _ in parts)):
        return False
    least = min(ratio, SHORTEST_RATIO if size < SHORT else SHORT_RATIO if size < LONG else ratio, ONE_CASE_RATIO if all(ONE_CASE.fullmatch(x) for x, _ in parts) else ratio)
    return size < least * n


def is_encoded(text: str, start: int, end: int) -> bool:
    """Whether a run is an embedded file, or base64 of plain text."""
    if text.startswith(EMBEDDED, max(0, start - len(EMBEDDED))) and start >= len(EMBEDDED):
        return True
    run = text[start:end].rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1 or "=" in run:
        return False
    got = base64.b64decode(run + "=" * (-len(run) % 4))
    return got.isascii() and all(c >= 32 or c in (9, 10, 13) for c in got)


def digest_end(text: str, start: int, end: int) -> int:
    """The end of the digest that a run begins with, by the name of its hash function; start if it doesn't."""
    m = None
    for m in HASH.finditer(text, max(0, start - 12), min(end, start + 12)):
        pass
    if not m or m.end() < start:
        return start
    run = re.compile(r"[A-Za-z0-9+/_-]+={0,6}").match(text, m.end())
    return run.end() if run and len(run[0]) in DIGESTS else start


def groups(text: str, start: int, end: int) -> list[list[tuple[int, str, int]]]:
    """Neighbouring parts of a run that are neither words nor digests nor inside a UUID: (start, part, tokens) of each."""
    out: list[list[tuple[int, str, int]]] = [[]]
    known = digest_end(text, start, end)
    named = [(u.start(), u.end()) for u in UUID.finditer(text, start, end)]
    i = 0
    for x in PART.finditer(text, start, end):
        while i < len(named) and named[i][1] <= x.start():
            i += 1
        own = out[-1]
        if own and x.start() - own[-1][0] - len(own[-1][1]) > 1:
            out.append([])
        n = tokens(x[0]) if len(x[0]) <= STRETCH else tokens.__wrapped__(x[0])  # long ones aren't remembered
        word = ONE_CASE.fullmatch(x[0]) and len(x[0]) >= WORD_RATIO * n
        if word or x.start() < known or (i < len(named) and named[i][0] <= x.start()) or HEX.fullmatch(x[0].lower()):
            out.append([])
        else:
            out[-1].append((x.start(), x[0], n))
    return [x for x in out if x]


def random_spans(text: str, base: list[tuple[int, int, int]], ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """Those of random strings that don't touch a base span; base is in order."""
    found: list[tuple[int, int, int]] = []
    for m in RUN.finditer(text):
        if (m.end() - m.start() < SHORT and not MIXED.match(m[0])) or is_encoded(text, m.start(), m.end()):
            continue
        for parts in groups(text, m.start(), m.end()):
            if is_random([x[1:] for x in parts], ratio):
                found.append((parts[0][0], 3, parts[-1][0] + len(parts[-1][1])))
            else:
                found += [(at, 3, at + len(x)) for at, x, n in parts if is_random([(x, n)], ratio)]
    starts, ends = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    clear = lambda x: not (i := bisect_left(starts, x[2])) or ends[i - 1] <= x[0]
    return [x for x in found if clear(x)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def secret_spans(docs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """For each row of docs: doc_id, the counts of spans by kind, base_sha256 over the base spans and spans, which lists all.

    A null text counts as empty: no spans, and the digest of the empty string. Rows that repeat give repeated results; an empty table gives
    no rows; a null doc_id stays null; other columns don't matter. Texts of any length are searched whole.
    """

    def one(text: str | None) -> tuple:
        base = base_spans(text) if text else []
        random = random_spans(text, base, ratio) if text else []
        n = [sum(k == i for _, k, _ in base) for i in range(3)]
        return *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + random), len(random)

    def make():
        names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")

        def f(doc_ids, texts):
            rows = [one(x) for x in texts]
            return {"doc_id": doc_ids} | {k: [r[i] for r in rows] for i, k in enumerate(names)}

        return f

    return arrow_map(docs, ["doc_id", "text"], make, SCHEMA)
