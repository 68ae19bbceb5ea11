"""Order-preserving packing of token sequences by dynamic programming.

The documents of a partition follow one another as one stream of ids, each closed by the end id. Windows of at most 1024
ids are cut from it so that padding plus penalties is least: no penalty for a cut between documents, a small one for a cut after a
sentence, more for a cut elsewhere, which is offered every few ids of a sentence, and anywhere near the end. With
cost(i) = penalty(i) + min over j of cost(j) + 1024 - (i - j), only cost(j) + j matters, and a
monotone queue holds its minimum over the last 1024 ids. A window whose length is a power of two isn't padded: its ten transitions are looked at beside the queue. The stream is worked off in blocks; the open window of a block begins the next.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe

WINDOW, END_ID = 1024, 0
#: Penalties, in ids of padding, of a cut after a sentence and of any other.
SENTENCE, ELSEWHERE = 1, 3
#: Inside a sentence a cut is offered every STEP ids, and within a window of the stream's end at each id.
STEP = 8
#: A block of the stream has about so many ids.
BLOCK = 400_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sentence_ends() -> np.ndarray:
    """For each id, whether it ends a sentence: by its last character, or by a line's end."""
    return np.array([x.strip()[-1:] in (b".", b"!", b"?") or b"\n" in x for x in bpe.id_bytes()])


def cut_places(stream: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which the stream may be cut, and the penalty of each. last: the stream ends there, and isn't gone on with."""
    n = len(stream)
    penalty = np.full(n + 1, -1, np.int32)
    penalty[np.flatnonzero(ends[stream]) + 1] = SENTENCE
    penalty[doc_ends] = 0
    penalty[0] = penalty[n] = 0
    place = np.arange(n + 1, dtype=np.int32)
    begin = np.maximum.accumulate(np.where(penalty >= 0, place, np.int32(0)))
    offered = (place - begin) % STEP == 0
    if last:
        offered |= place > n - WINDOW
    penalty[(penalty < 0) & offered] = ELSEWHERE
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cuts of least cost among the places at, its first and last included; neighbours are at most a window apart. A window is padded unless its length is a power of two."""
    places = at.tolist()
    powers = np.array([1 << k for k in range(window.bit_length()) if 1 << k <= window])
    number = np.full(places[-1] + 1 + window, -1, np.int32)  # of the place at each position, which counts from -window
    number[at + window] = np.arange(len(at), dtype=np.int32)
    # the places a power of two before each place, of those that are offered; looked up for all at once
    of = number[at[:, None] + (window - powers)]
    bounds = np.concatenate(([0], np.cumsum((of >= 0).sum(axis=1)))).tolist()
    of = of[of >= 0].tolist()
    cost, key, back = [0] * len(places), [0] * len(places), [0] * len(places)  # key: cost + place
    queue = deque([0])  # its keys rise; the first is the least within the window
    for i, (place, more) in enumerate(zip(places[1:], penalty[1:].tolist(), strict=True), 1):
        while places[queue[0]] < place - window:
            queue.popleft()
        j = queue[0]
        least = key[j] + window - place
        for k in of[bounds[i] : bounds[i + 1]]:
            if cost[k] < least:
                j, least = k, cost[k]
        back[i], cost[i] = j, least + more
        key[i] = k = least + more + place
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(i)
    cuts, i = [], len(places) - 1
    while i:
        cuts.append(places[i])
        i = back[i]
    return [0, *reversed(cuts)]


class Packer:
    """Takes documents and gives pieces, column by column, in the order of SCHEMA."""

    def __init__(self, first_sequence: int):
        self.sequence, self.ends = first_sequence, sentence_ends()
        self.docs: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, start of what is held, ids of all, what is held
        self.held = 0

    def add(self, doc_id: int | None, got: np.ndarray) -> None:
        got = np.append(got, END_ID).astype("<u4")
        self.docs.append((doc_id, 0, len(got), got))
        self.held += len(got)

    def pieces(self, last: bool) -> list[list]:
        """Cuts what is held and gives the pieces of all windows but the open one, which stays held (with last, of all)."""
        if not self.docs:
            return [[] for _ in range(7)]
        stream = np.concatenate([x[3] for x in self.docs])
        ends = np.cumsum([len(x[3]) for x in self.docs])
        cuts = best_cuts(*cut_places(stream, ends, self.ends, last))
        if not last:
            cuts.pop()
        done = cuts[-1]
        edges = np.unique(np.concatenate((cuts, ends[ends < done])))
        doc = np.searchsorted(ends, edges[:-1], "right")
        window = np.searchsorted(cuts, edges[:-1], "right") - 1
        begins = np.concatenate(([0], ends[:-1]))
        raw = memoryview(stream.tobytes())
        a, b = edges[:-1].tolist(), edges[1:].tolist()
        out = [
            [self.docs[i][0] for i in doc.tolist()],
            (edges[:-1] - begins[doc] + np.array([x[1] for x in self.docs])[doc]).tolist(),
            np.diff(edges).tolist(),
            [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a, b, strict=True)],
            [self.docs[i][2] for i in doc.tolist()],
            (window + self.sequence).tolist(),
            (edges[:-1] - np.array(cuts)[window]).tolist(),
        ]
        self.sequence += len(cuts) - 1
        rest = []
        for (doc_id, start, size, got), begin, end in zip(self.docs, begins.tolist(), ends.tolist(), strict=True):
            if end > done:
                used = max(0, done - begin)
                rest.append((doc_id, start + used, size, got[used:]))
        self.docs, self.held = rest, int(ends[-1]) - done
        return out


def pack(docs: DataFrame) -> DataFrame:
    """The pieces of all rows of docs in sequences of at most 1024 ids; nothing is shuffled, and a task holds about a block of ids.

    A null text counts as empty: its document is the end id alone. A row that repeats is packed as often; a null doc_id stays null. An empty table
    gives no rows; other columns don't matter. sequence_id holds the partition's number in its upper bits.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId() << 36)
        give = lambda last: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in packer.pieces(last)], schema=schema)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, bpe.ids(text.as_py() or ""))
                if packer.held >= BLOCK:
                    yield give(False)
        yield give(True)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
