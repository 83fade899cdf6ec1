"""Byte-level BPE as a monoid: texts are encoded by halves whose ends are mended where they meet, and decoded by concatenation.

A list of ids is the encoding of its bytes exactly if each two neighbours are the encoding of theirs. For take the first
merge that crosses from one token into the next: up to then both are merged as they would be alone, in the same order,
so the two alone would make that merge as well. So two encodings are joined by looking at the pair where they meet. If
it isn't its own encoding, a window around the seam is encoded anew and grown until the pairs at both its ends are:
no token outside it can then change. The join is associative, as its result is the encoding of all the bytes.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder

#: Bytes of a leaf of the tree; its merges are made one by one.
LEAF = 6
#: Leaves, pairs and windows whose encoding a task remembers, at most; beyond that it forgets all and goes on.
REMEMBERED = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary: lines of a token in base 64 and its rank. Ranks are the ids."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
    return ranks


class Tree:
    """Encodings of byte strings under merges by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.leaves: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> tuple[int, ...]:
        """The encoding by definition: the pair of least rank is merged, the leftmost first, until no pair has one."""
        if len(data) > 64:
            return self._merged_long(data)
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        found = [ranks.get(data[i : i + 2]) for i in range(len(data) - 1)]
        while known := [r for r in found if r is not None]:
            i = found.index(min(known))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i < len(found):
                found[i] = ranks.get(parts[i] + parts[i + 1])
            if i:
                found[i - 1] = ranks.get(parts[i - 1] + parts[i])
        return tuple(ranks[p] for p in parts)

    def _merged_long(self, data: bytes) -> tuple[int, ...]:
        """The same with a heap of pairs and links between parts."""
        n, ranks = len(data), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if end[i] != middle or middle == n or end[middle] != stop:
                continue  # one of the two has been merged since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (j := before[i]) >= 0 and (r := ranks.get(data[j:stop])) is not None:
                heapq.heappush(heap, (r, j, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _known(self, data: bytes) -> tuple[int, ...]:
        """merged(data), remembered where it is short."""
        known = self.leaves.get(data)
        if known is None:
            known = self.merged(data)
            if len(data) <= 64:
                if len(self.leaves) >= REMEMBERED:
                    self.leaves.clear()
                self.leaves[data] = known
        return known

    def _stands(self, a: int, b: int) -> bool:
        """Whether two tokens beside each other stay as they are."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[a, b] = self._known(self.token[a] + self.token[b]) == (a, b)
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of both, from their encodings."""
        if not left or not right or self._stands(left[-1], right[0]):
            return left + right
        a = b = 1  # tokens of either side inside the window; a side that doesn't settle is taken in twice as far
        while True:
            rest, more = left[: len(left) - a], right[b:]
            window = self._known(b"".join(map(self.token.__getitem__, left[len(rest) :] + right[:b])))
            settled_left, settled_right = not rest or self._stands(rest[-1], window[0]), not more or self._stands(window[-1], more[0])
            if settled_left and settled_right:
                return rest + window + more
            if not settled_left:
                a = min(len(left), 2 * a)
            if not settled_right:
                b = min(len(right), 2 * b)

    def encode(self, data: bytes) -> tuple[int, ...]:
        """The encoding of data by halves, down to leaves."""
        if len(data) > LEAF:
            half = len(data) // 2
            return self.join(self.encode(data[:half]), self.encode(data[half:]))
        return self._known(data)

    def match(self, data: bytes) -> tuple[int, ...]:
        """Ids of one match of the pattern: a token of its own, whether or not merges lead to it, or its encoding."""
        known = self.ranks.get(data)
        return self.encode(data) if known is None else (known,)


class TreeEncoder(Encoder):
    """Ids of whole texts: texts are cut into matches of a pattern, each encoded by its tree.

    Where a lone space between two other characters always begins a match (as in patterns that take an optional
    space into a word), texts are cut there first and each different piece is encoded once.
    """

    def __init__(self, path: str, pattern: str, lone_space_begins: bool):
        import regex

        self.matches = regex.compile(pattern).findall
        self.tree = Tree(read_ranks(path))
        self.cut = lone_space_begins
        self._start()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        match = self.tree.match
        return [np.array([i for m in self.matches(t) for i in match(m.encode())], np.uint32) for t in texts]

    def _together(self, pieces: list[str]) -> None:
        """Each piece by itself: a tree gains nothing by longer texts, and bytes that no match covers have no ids."""


def encode(docs: DataFrame, path: str, pattern: str, lone_space_begins: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every whole text by a vocabulary of ranks, no special tokens; what no match covers has no ids.

    Null and empty texts have no ids. Rows are encoded where they lie, repeated ones each; a very long text is held whole by
    its task, in pieces at its matches. Other columns are ignored and an empty table gives no rows.
    """

    def run(batches):
        encoder = TreeEncoder(path, pattern, lone_space_begins)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids, n = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                ends = pa.array(np.append(0, np.cumsum(n)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (id, ids) with decoded, the bytes of its ids one after another. Null ids have no bytes; an id outside the vocabulary is an error."""

    def run(batches):
        ranks = read_ranks(path)
        sizes = np.full(max(ranks.values()) + 1, -1, np.int64)
        sizes[list(ranks.values())] = [len(t) for t in ranks]
        starts = np.zeros(len(sizes), np.int64)
        order = sorted(ranks, key=ranks.get)
        starts[[ranks[t] for t in order]] = np.cumsum([0, *[len(t) for t in order[:-1]]])
        table = np.frombuffer(b"".join(order), np.uint8)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                column = part.column(1)
                ids = np.asarray(column.flatten(), np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes) or sizes[ids].min() < 0):
                    raise ValueError("an id is not in the vocabulary")
                n = sizes[ids]
                ends = np.cumsum(n)
                data = table[np.arange(int(n.sum())) + np.repeat(starts[ids] - (ends - n), n)]
                lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
                at = np.append(0, ends)[np.append(0, np.cumsum(lengths))]
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column(0), column, texts.cast(pa.binary())], names=["id", "ids", "decoded"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, ids array<int>, decoded binary")
