"""Benchmark decontamination: q-gram counts in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, collapsed, materialize, text_slices

Q = 8
#: Benchmark items are searched in pieces of this many collapsed bytes, each half over the one before.
PIECE = 120
#: They are searched in shorter pieces too, one every SHORT_STEP bytes, so that each excerpt of EXCERPT collapsed
#: bytes (13 words or so) holds a whole one, wherever it begins.
SHORT, SHORT_STEP = 56, 17
EXCERPT = SHORT + SHORT_STEP - 1
#: Edits allowed for each byte of a piece.
BUDGET = 0.08
#: Bytes of benchmark text in one index of a task, some 70 bytes of memory for each.
PASS_BYTES = 2 << 20
#: Bytes of benchmark text that one scan of the documents is searched for, index after index; the driver holds so much of it
#: and sends it to the tasks. More text takes more scans.
SCAN_BYTES = 64 << 20
#: Bytes of text that a task searches at a time, a longer text by itself; some 100 bytes of memory for each.
SLICE_BYTES = 1 << 18


def _plain(text: str) -> bytes:
    raw = np.frombuffer(text.encode(), np.uint8)
    return collapsed(raw, np.array([0, len(raw)]))[0].tobytes().strip()


class PieceIndex:
    """The different pieces of some collapsed benchmark items, and their q-grams, sorted, with place and class.

    Equal pieces are one, of several items. A q-gram at a place that many pieces share is one entry, whose class stands for all of
    them: wording that items have in common is counted once and not once for each item.
    """

    def __init__(self, items: list[tuple[int, bytes]], size: int, step: int, least: int):
        found: dict[bytes, list[int]] = {}
        for key, plain in items:
            if len(plain) < least:
                continue
            last = max(0, len(plain) - size)
            for start in sorted({*range(0, last, step), last}):
                found.setdefault(plain[start : start + size], []).append(key)
        self.items = list(found.values())
        self.piece = [np.frombuffer(p, np.uint8) for p in found]
        self.length = np.array([len(p) for p in self.piece], np.int64)
        self.edits = np.floor(self.length * BUDGET).astype(np.int64)
        self.need = np.maximum(1, self.length - Q + 1 - Q * self.edits)
        grams = [_grams(p) for p in self.piece]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams), dtype=np.int64), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g), dtype=np.int16) for g in grams]) if grams else np.zeros(0, np.int16)
        order = np.lexsort((owner, place, flat))
        flat, owner, place = flat[order], owner[order], place[order]
        first = np.append(True, (flat[1:] != flat[:-1]) | (place[1:] != place[:-1])) if len(flat) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        ends = np.append(at[1:], len(flat))
        self.gram, self.place, self.group = flat[at], place[at], owner[at].copy()
        # classes: a piece by itself has its own number; sets of pieces follow
        sets: dict[bytes, int] = {}
        members: list[np.ndarray] = []
        for k in np.flatnonzero(ends - at > 1).tolist():
            who = owner[at[k] : ends[k]]
            name = who.tobytes()
            if name not in sets:
                sets[name] = len(self.piece) + len(members)
                members.append(who)
            self.group[k] = sets[name]
        self.member_ends = np.append(np.arange(len(self.piece) + 1), len(self.piece) + np.cumsum([len(m) for m in members], dtype=np.int64)).astype(np.int64)
        self.members = np.concatenate([np.arange(len(self.piece)), *members]).astype(np.int64)

    def spread(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of each of these classes: (which of the classes, piece)."""
        n = self.member_ends[group + 1] - self.member_ends[group]
        rep = np.repeat(np.arange(len(group)), n)
        return rep, self.members[self.member_ends[group][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)]


class PassIndex:
    """What the texts are searched for in one pass: long pieces, short ones of items that are longer than one of
    them, and, under their collapsed text, the items that are too short for a q-gram."""

    def __init__(self, items: tuple[tuple[int, str], ...]):
        plain = [(key, _plain(text)) for key, text in items]
        both = [PieceIndex(plain, PIECE, PIECE // 2, Q), PieceIndex(plain, SHORT, SHORT_STEP, SHORT + 1)]
        self.pieces = [x for x in both if x.piece]
        self.whole: dict[bytes, list[int]] = {}
        for key, norm in plain:
            if 0 < len(norm) < Q:
                self.whole.setdefault(norm, []).append(key)
        # some sixteen slots for each q-gram, so that most of a text's q-grams end here
        self.bits = min(26, max(22, (16 * sum(len(x.gram) for x in self.pieces)).bit_length()))
        self.seen = []
        for x in self.pieces:
            seen = np.zeros(1 << self.bits, bool)
            seen[_slot(x.gram, self.bits)] = True
            self.seen.append(seen)


@lru_cache(maxsize=1)
def _pass_index(items: tuple[tuple[int, str], ...]) -> PassIndex:
    """Made once by each Python worker, from the items that its tasks were sent."""
    return PassIndex(items)


def _grams(data: np.ndarray) -> np.ndarray:
    """Every run of Q = 8 bytes as one integer."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


def _slot(grams: np.ndarray, bits: int) -> np.ndarray:
    return ((grams * GOLDEN) >> np.uint64(64 - bits)).astype(np.int64)


#: Places that are aligned side by side, at most.
SIDE_BY_SIDE = 1 << 15


def aligned_places(pieces: list[np.ndarray], which: np.ndarray, texts: list[np.ndarray], text: np.ndarray, first: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each k the fewest edits that turn pieces[which[k]] into some stretch of texts[text[k]] on the diagonals first[k] .. first[k] + width - 1.

    Both ends of the stretch are free. Returns the edits, above most as most + 1, and the ends of the stretches in the text.
    All places go through the table of edits side by side, one byte of their pieces after the other. Pieces that begin alike
    share their rows at a place up to the byte where they part.
    """
    edits, ends = np.full(len(which), most + 1, np.int64), np.zeros(len(which), np.int64)
    if not len(which):
        return edits, ends
    used, compact = np.unique(which, return_inverse=True)
    by_bytes = sorted(range(len(used)), key=lambda k: pieces[used[k]].tobytes())
    rank = np.empty(len(used), np.int64)
    rank[by_bytes] = np.arange(len(used))
    order = np.lexsort((rank[compact], first, text))
    for a in range(0, len(order), SIDE_BY_SIDE):
        part = order[a : a + SIDE_BY_SIDE]
        edits[part], ends[part] = _aligned(pieces, which[part], texts, text[part], first[part], width, most)
    return edits, ends


def banded_edits(piece: np.ndarray, text: np.ndarray, first: int, width: int, most: int) -> tuple[int, int]:
    """aligned_places of one piece at one place."""
    edits, ends = aligned_places([piece], np.zeros(1, np.int64), [text], np.zeros(1, np.int64), np.array([first]), width, most)
    return int(edits[0]), int(ends[0])


def _aligned(pieces, which, texts, text, first, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """aligned_places of places in order of text, first and bytes of the piece."""
    n, big = len(which), most + 1
    length = np.array([len(pieces[p]) for p in which])
    longest = int(length.max())
    used, compact = np.unique(which, return_inverse=True)
    table = np.full((len(used), longest), -1, np.int16)
    for k, p in enumerate(used.tolist()):
        table[k, : len(pieces[p])] = pieces[p]
    new = np.append(True, (text[1:] != text[:-1]) | (first[1:] != first[:-1]))
    place = np.cumsum(new) - 1
    # what each place shows of its text: -1 outside it
    reach = np.arange(width + longest)
    shown = np.full((int(place[-1]) + 1, len(reach)), -1, np.int16)
    lasts = np.zeros(len(shown), np.int64)
    for k, at in enumerate(np.flatnonzero(new).tolist()):
        t, f = texts[text[at]], int(first[at])
        lo, hi = max(0, f), min(len(t), f + len(reach))
        if hi > lo:
            shown[k, lo - f : hi - f] = t[lo:hi]
        lasts[k] = len(t)
    starts = first[new]
    # the byte at which each piece parts from the one before it at the same place
    parts = np.zeros(n, np.int64)
    if n > 1:
        differ = table[compact[1:]] != table[compact[:-1]]
        parts[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), longest)
    parts[new] = -1
    edits, ends = np.full(n, big, np.int64), np.zeros(n, np.int64)
    alive = np.arange(n)  # places that may still do; group is the row of each
    group = place.copy()
    leader = np.flatnonzero(new)  # one place for each row
    d = np.arange(width)
    at = starts[:, None] + d
    row = np.where((at >= 0) & (at <= lasts[:, None]), 0, big).astype(np.int16)
    for i in range(1, longest + 1):
        splits = parts[alive] < i
        if int(splits.sum()) > len(leader):
            heads = np.flatnonzero(splits)
            row = row[group[heads]]
            group = np.cumsum(splits) - 1
            leader = alive[heads]
        chars = shown[place[leader], i - 1 : i - 1 + width]
        best = np.where(chars >= 0, row + (chars != table[compact[leader], i - 1][:, None]), big)
        best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + 1)  # byte of the piece left out
        j = starts[place[leader]][:, None] + (d + i)
        best = np.where((j >= 0) & (j <= lasts[place[leader]][:, None]), best, big)
        best = np.minimum.accumulate(best - d, axis=1) + d  # bytes of the text left out
        row = np.minimum(best, big).astype(np.int16)
        done = length[alive] == i
        if done.any():
            low = row.min(axis=1)
            where = row.argmin(axis=1)
            k = alive[done]
            edits[k], ends[k] = low[group[done]], first[k] + where[group[done]] + i
        if i % 8 == 0 or done.any():
            stay = ~done & (row.min(axis=1) <= most)[group]
            if not stay.any():
                break
            if int(stay.sum()) < len(alive):
                # a row whose leading place goes is led by the next that stays; a place that goes may have parted the others
                kept = np.flatnonzero(stay)
                gone = np.minimum.reduceat(parts[alive], np.append(0, kept[:-1] + 1)) if len(kept) else parts[:0]
                old = group[kept]
                alive = alive[kept]
                parts = parts.copy()
                parts[alive] = np.minimum(parts[alive], gone)
                head = np.append(True, old[1:] != old[:-1])
                row, group, leader = row[old[head]], np.cumsum(head) - 1, alive[head]
                parts[leader] = np.minimum(parts[leader], i)
    return edits, ends


def _search(items: tuple[tuple[int, str], ...] | Broadcast):
    """Finds pieces of items, or of each of the broadcast tuples of items, in batches of texts."""

    def in_run(index: PieceIndex, norm: np.ndarray, offsets: np.ndarray, grams: np.ndarray, hit: np.ndarray):
        """(text, piece, start, end, edits) of each piece found, in collapsed positions inside the text."""
        longest, n_pieces, n_groups = int(index.length.max()), len(index.piece), len(index.member_ends) - 1
        slack = int(index.edits.max())
        step = max(1, slack)
        # bands can only fill where enough q-grams of any piece stand within one piece's reach
        sums = np.zeros(len(grams) + 1, np.int64)
        np.cumsum(hit, out=sums[1:])
        reach = longest + slack
        at = np.flatnonzero(hit)
        least = int(index.need.min())
        ahead = sums[np.minimum(at + reach, len(grams))] - sums[at]
        dense = np.zeros(len(grams) + 1, np.int64)
        full = at[ahead >= least]
        np.add.at(dense, full, 1)
        np.add.at(dense, np.minimum(full + reach, len(grams)), -1)
        at = at[np.cumsum(dense)[at] > 0]
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + Q <= offsets[doc + 1]
        at, doc = at[inside], doc[inside]
        lo, hi = np.searchsorted(index.gram, grams[at], "left"), np.searchsorted(index.gram, grams[at], "right")
        n = hi - lo
        rep = np.repeat(np.arange(len(at)), n)
        entry = lo[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        group = index.group[entry]
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not len(group):
            return found
        # a text that holds too few of a piece's q-grams in all has no band with enough
        pair, which, held = np.unique(doc[rep] * n_groups + group, return_inverse=True, return_counts=True)
        of, piece = index.spread(pair % n_groups)
        text_piece, back = np.unique(pair[of] // n_groups * n_pieces + piece, return_inverse=True)
        enough = np.bincount(back, held[of], len(text_piece)).astype(np.int64) >= index.need[text_piece % n_pieces]
        some = np.bincount(of, enough[back], len(pair)) > 0
        rep, entry, which = rep[some[which]], entry[some[which]], which[some[which]]
        if not len(rep):
            return found
        # q-grams of each class in each band, then of each of its pieces
        band = (at[rep] - offsets[doc[rep]] - index.place[entry]) // step
        shift = int(-band.min()) + 1
        span = int(band.max()) + shift + 2
        class_keys, class_counts = np.unique(which * span + band + shift, return_counts=True)
        pair = pair[class_keys // span]
        of, piece = index.spread(pair % n_groups)
        text_piece_here = pair[of] // n_groups * n_pieces + piece
        kept = enough[np.searchsorted(text_piece, text_piece_here)]
        of, text_piece_here = of[kept], text_piece_here[kept]
        keys, back = np.unique(text_piece_here * span + class_keys[of] % span, return_inverse=True)
        counts = np.bincount(back, class_counts[of], len(keys)).astype(np.int64)
        # band b covers diagonals from step * b to step * (b + 2) - 1; one that starts empty holds no more than the next
        follows = np.append(keys[1:] == keys[:-1] + 1, False)
        counts = counts + np.where(follows, np.append(counts[1:], 0), 0)
        good = counts >= index.need[keys // span % n_pieces]
        keys, counts = keys[good], counts[good]
        text_piece, band = keys // span, keys % span - shift
        d, piece = text_piece // n_pieces, text_piece % n_pieces
        texts = {k: norm[offsets[k] : offsets[k + 1]] for k in np.unique(d).tolist()}
        # a piece without edits needs no alignment; all its q-grams stand on one diagonal of its band
        for k in np.flatnonzero(counts >= index.length[piece] - Q + 1).tolist():
            here, p = int(d[k]), int(piece[k])
            if (here, p) in found:
                continue
            first = int(band[k]) * step
            low = max(0, first)
            exact = texts[here][low : max(0, first + 2 * step + int(index.length[p]))].tobytes().find(index.piece[p].tobytes())
            if exact >= 0:
                found[here, p] = (low + exact, low + exact + int(index.length[p]), 0)
        open_ = np.array([(x, y) not in found for x, y in zip(d.tolist(), piece.tolist())], bool)
        d, piece, band, text_piece = d[open_], piece[open_], band[open_], text_piece[open_]
        # two bands of a piece that follow each other are one place
        runs = np.append(True, (text_piece[1:] != text_piece[:-1]) | (band[1:] != band[:-1] + 1)) if len(d) else np.zeros(0, bool)
        starts = np.flatnonzero(runs)
        in_row = np.arange(len(d)) - (starts[np.cumsum(runs) - 1] if len(d) else 0)
        one = in_row % 2 == 0
        d, piece, band = d[one], piece[one], band[one]
        edits, ends = aligned_places(index.piece, piece, texts, d, (band - 1) * step, 5 * step, slack)
        for here, p, e, end in zip(d.tolist(), piece.tolist(), edits.tolist(), ends.tolist()):
            if e <= index.edits[p] and ((here, p) not in found or found[here, p][2] > e):
                found[here, p] = (max(0, end - int(index.length[p]) - e), end, e)
        return found

    def short_texts(whole: dict[bytes, list[int]], norm: np.ndarray, offsets: np.ndarray):
        """(text, item, start, end) of texts that hold nothing but an item without a q-gram."""
        for d in np.flatnonzero(np.diff(offsets) <= Q + 1).tolist() if whole else ():
            text = norm[offsets[d] : offsets[d + 1]].tobytes()
            plain = text.strip()
            start = len(text) - len(text.lstrip())
            for item in whole.get(plain, ()):
                yield d, item, start, start + len(plain)

    def searched(index: PassIndex, batch, number: int, rows: list[tuple]) -> int:
        """Adds what a batch holds of an index, whose pieces are numbered from number on; gives the next number."""
        ids = batch.column(0)
        for a, _, data, offsets in text_slices(batch.column(1), SLICE_BYTES, max_rows=4096):
            norm, noffs, at = collapsed(data, offsets)
            grams = _grams(norm)
            slots = _slot(grams, index.bits)

            def add(d: int, item: int, piece: int, start: int, end: int, edits: int):
                base = noffs[d]
                raw = (int(at[base + start] - offsets[d]), int(at[base + end - 1] - offsets[d]) + 1)
                rows.append((ids[a + d].as_py(), item, piece, *raw, edits))

            ahead = number
            for pieces, seen in zip(index.pieces, index.seen, strict=True):
                for (d, p), (start, end, edits) in in_run(pieces, norm, noffs, grams, seen[slots]).items():
                    for item in pieces.items[p]:
                        add(d, item, ahead + p, start, end, edits)
                ahead += len(pieces.piece)
            for d, item, start, end in short_texts(index.whole, norm, noffs):
                add(d, item, ahead, start, end, 0)
        return number + sum(len(pieces.piece) for pieces in index.pieces) + 1

    def run(batches):
        passes = items.value if isinstance(items, Broadcast) else [items]
        for batch in batches:
            rows: list[tuple] = []
            number = 0
            for each in passes:
                number = searched(_pass_index(each), batch, number, rows)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "item_id", "piece", "start", "end", "edits"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, piece, start, end, edits): every piece of a benchmark item that stands in a text of docs.

    Texts are compared with ASCII letters in lower case and each run of other ASCII bytes than letters and
    digits as one space. Items are cut into pieces of PIECE bytes, half over each other; shorter items are one
    piece. Items longer than SHORT are also cut into pieces of SHORT bytes, so that any excerpt of EXCERPT
    unedited bytes holds a whole piece. A piece is found where at most BUDGET of its bytes are edited. By the q-gram lemma such a place keeps
    length - Q + 1 - Q * edits q-grams within a diagonal band; overlapping bands that hold as many are verified by
    banded alignment, and the best place of each piece and text is reported in bytes of the text. start is at
    most the number of edits too far left. Wording that many items share is counted once for all of them and aligned once
    at each place, so that a prompt ahead of every item costs little.

    Null and empty texts hold nothing; items of fewer than Q collapsed bytes have no q-gram and are found where
    they are the whole text; items without a letter or digit are not searched; null ids or item ids are left out;
    repeated rows give repeated rows; an empty table on either side gives no rows. A batch of texts is searched by
    one index of PASS_BYTES (or one longer item) after another, in one scan up to SCAN_BYTES of benchmark; the driver holds as much,
    and where there is more, each scan's rows are written before the next. Pieces are numbered within a scan.
    Time and memory of a task grow in proportion to its longest text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("k"), F.col(item_text).alias("t")).where("k is not null and t is not null")
    schema = "id long, item_id long, piece long, start long, end long, edits long"
    out: list[DataFrame] = []
    passes: list[tuple[tuple[int, str], ...]] = []
    held: list[tuple[int, str]] = []
    size = total = 0

    def scan() -> DataFrame:
        """The documents searched for the passes at hand; small ones go with the tasks, more are broadcast."""
        return rows.mapInArrow(_search(passes[0] if len(passes) == 1 else docs.sparkSession.sparkContext.broadcast(passes)), schema)

    for key, text in items.orderBy("k").toLocalIterator():
        n = len(text.encode())
        if held and size + n > PASS_BYTES:
            passes.append(tuple(held))
            held, size = [], 0
        if passes and total + n > SCAN_BYTES:
            out.append(materialize(scan(), "leaks"))
            passes, total = [], size
        held.append((key, text))
        size, total = size + n, total + n
    if held:
        passes.append(tuple(held))
        out.append(scan())
    return reduce(DataFrame.union, out) if out else docs.sparkSession.createDataFrame([], schema)


def contaminated(found: DataFrame) -> DataFrame:
    """(id, item_id, pieces, start, end, edits) of each text and item: pieces found, where the first begins and the last ends, and the fewest edits."""
    return found.groupBy("id", "item_id").agg(F.count("*").alias("pieces"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("edits").alias("edits"))
