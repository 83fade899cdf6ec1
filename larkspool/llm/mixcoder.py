"""Adaptive context-mixing range coder of token ids: blocks run side by side, each reset and checksummed by itself."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids in a block at most, and at least where a segment is long enough; blocks of a segment are alike in length,
#: LANES of them or more where they aren't of the least length.
BLOCK, LEAST_BLOCK, LANES = 1 << 14, 1 << 12, 64
MAGIC = b"LKT3"
#: Order-0 counts of a block are scaled to the sum 2**TOTAL_BITS, weights of the orders to 2**WEIGHT_BITS.
TOTAL_BITS, WEIGHT_BITS = 14, 12
#: Contexts of order 2 are hashed to so many bits.
SLOT_BITS = 12
#: Weights follow the outcomes once in so many ids. They start from START outcomes of each state.
CHUNK, START = 64, 2
#: Blocks that are encoded side by side, at most; all of a segment are decoded so.
ENCODED_LANES = 512
_TABLE = 1 << 17  # ids below this are ranked by a table, others by sorting
_TOTAL = 1 << TOTAL_BITS
_MOST = 3  # confidence of a prediction, 0 (none yet) to 3, in the low two bits of its entry
_STATES = 4 * 4 * 2
_LEAST = np.int64(1 << 31)  # a range below this takes in a word of 32 bits; ranges stay below 2**63
_WINDOW = np.int64((1 << 63) - 1)
# Operands as arrays of the other side's type: NumPy spends as long on finding the type of a number as on a step of all lanes.
_LEAST_ARRAY, _WINDOW_ARRAY = np.array(_LEAST), np.array(_WINDOW)
_UNIT, _SIGN, _WORD, _FIVE = (np.array(x, np.int64) for x in (TOTAL_BITS + WEIGHT_BITS, 63, 32, 5))
_ZERO, _ONE, _TWO, _TRUST = (np.array(x, np.int32) for x in (0, 1, 2, _MOST))
_SLOT_FACTOR, _SLOT_MASK = np.array(40503, np.uint16), np.array((1 << SLOT_BITS) - 1, np.uint16)
_SLOT_FACTOR_WIDE, _SLOT_MASK_WIDE = _SLOT_FACTOR.astype(np.int64), _SLOT_MASK.astype(np.int64)
_SPLIT, _MASKS, _TOP = np.array([[TOTAL_BITS + 1], [0]], np.int32), np.array([[-1], [(2 << TOTAL_BITS) - 1]], np.int32), np.array(31, np.uint32)


class _Encoder:
    """A range coder in every lane. Steps go to it in chunks, and what they give out is put in place after each."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, _WINDOW)
        self.words = np.zeros((lanes, steps + 4), np.uint32)
        self.n = np.zeros(lanes, np.int32)

    def narrow(self, before: np.ndarray, width: np.ndarray) -> None:
        """Steps of all lanes: (steps, lanes)."""
        lows, full = np.empty(before.shape, np.int64), np.empty(before.shape, bool)
        unit, shift = np.empty_like(self.low), np.empty_like(self.low)
        low, span = self.low, self.range
        for b, w, reached, out in zip(before, width, lows, full, strict=True):
            np.right_shift(span, _UNIT, unit)
            np.multiply(b, unit, reached)
            np.add(reached, low, reached)  # below 2**64: the sign bit is the carry
            np.multiply(w, unit, span)
            np.less(span, _LEAST_ARRAY, out)
            np.copyto(shift, out)
            np.left_shift(shift, _FIVE, shift)
            np.left_shift(span, shift, span)
            np.left_shift(reached, shift, low)
            np.bitwise_and(low, _WINDOW_ARRAY, low)
        self._put(lows, full)

    def _put(self, lows: np.ndarray, full: np.ndarray) -> None:
        """Append the words of lanes whose range was too small, and run carries back into words that are out already."""
        past = np.cumsum(full, axis=0, dtype=np.int32)
        past += self.n
        out = np.flatnonzero(full)
        self.words[out % len(self.n), past.ravel()[out] - 1] = (lows.ravel()[out] & _WINDOW) >> 31
        over = np.flatnonzero(lows < 0)
        lane, at = over % len(self.n), past.ravel()[over] - full.ravel()[over] - 1
        while lane.size:
            np.add.at(self.words, (lane, at), np.uint32(1))
            more = self.words[lane, at] == 0
            lane, at = lane[more], at[more] - 1
        self.n = past[-1].copy()

    def codes(self) -> list[bytes]:
        rows = np.arange(len(self.low))
        self.words[rows, self.n] = self.low >> 31
        self.words[rows, self.n + 1] = (self.low & (_LEAST - 1)) << 1
        return [w[: n + 2].astype(">u4").tobytes() for w, n in zip(self.words, self.n.tolist(), strict=True)]


class _Decoder:
    """Reads what _Encoder writes: the code less the low end of the range, which is never needed by itself."""

    def __init__(self, codes: list[bytes]):
        lanes, width = len(codes), max(len(c) for c in codes) // 4 + 2
        words = np.zeros((lanes, width), np.int64)
        for i, c in enumerate(codes):
            w = np.frombuffer(c[: len(c) // 4 * 4], ">u4")
            words[i, : len(w)] = w
        # the window holds 63 bits, so each word that follows comes one bit late
        self.both = np.stack([(words[:, 0] << 31) | (words[:, 1] >> 1), np.full(lanes, _WINDOW)])
        self.code, self.range = self.both
        self.late = (((words[:, 1:-1] & 1) << 31) | (words[:, 2:] >> 1)).ravel()
        self.at = np.arange(lanes) * (width - 2)
        self.unit, self.place, self.full, self.shift = (np.empty(lanes, np.int64) for _ in range(4))

    def aim(self) -> np.ndarray:
        np.right_shift(self.range, _UNIT, self.unit)
        return np.floor_divide(self.code, self.unit, self.place)

    def narrow(self, shares: np.ndarray) -> None:
        """Range before the ids of one step, and of them: (2, lanes)."""
        code, span, full, place = self.code, self.range, self.full, self.place
        np.multiply(shares, self.unit, shares)
        np.subtract(code, shares[0], code)
        np.copyto(span, shares[1])
        # all ones in lanes that take in a word
        np.subtract(span, _LEAST_ARRAY, full)
        np.right_shift(full, _SIGN, full)
        np.bitwise_and(full, _WORD, self.shift)
        np.left_shift(self.both, self.shift, self.both)
        self.late.take(self.at, out=place, mode="clip")
        np.bitwise_and(place, full, place)
        np.bitwise_or(code, place, code)
        np.bitwise_and(code, _WINDOW_ARRAY, code)
        np.subtract(self.at, full, self.at)


def _slots(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where order 2 keeps what follows two ids. Products of 16 bits do, as more than SLOT_BITS of them are dropped."""
    return (before * _SLOT_FACTOR + last) & _SLOT_MASK


def _predicted(found: np.ndarray, slots: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """What a context in these slots predicts at each step of a lane, and its confidence, when found[t] follows slots[t].

    A slot predicts the id that followed it last (``none`` at first), with a confidence of 1, or more if it was right
    the last time or two. Sorting by slot puts what follows it side by side.
    """
    order = np.argsort(slots, kind="stable")
    names, first = found[order], np.diff(slots[order], prepend=slots[order[:1]]) != 0
    first[0] = True
    guess = np.where(first, np.uint16(none), np.roll(names, 1))
    right = np.zeros(len(found) + 2, np.uint8)
    np.equal(guess, names, out=right[2:].view(bool))
    trust = (1 + right[1:-1] + (right[1:-1] & right[:-2])) * ~first
    guesses, trusts = np.empty_like(guess), np.empty_like(trust)
    guesses[order], trusts[order] = guess, trust
    return guesses, trusts


class _Contexts:
    """Predictions of order 1 and 2 in every lane, step by step: the id that followed the context last, and how often in a row.

    Arrays hold order 1 in row 0 and order 2 in row 1. An entry is name * 4 + confidence; any names will do that
    differ for the ids of a block. Without confidence it bears the name ``none``, which no id has.
    """

    def __init__(self, lanes: int, width: int, none: int):
        self.base = np.stack([np.arange(lanes) * width, lanes * width + (np.arange(lanes) << SLOT_BITS)])
        self.table = np.full(lanes * (width + (1 << SLOT_BITS)), none << 2, np.int32)
        self.slots = self.base.copy()
        self.last = np.zeros(lanes, np.int64)
        self.entry, self.guess, self.trust, self.next, self.parts = (np.empty((2, lanes), np.int32) for _ in range(5))
        self.scale = np.repeat(np.array([[2], [8]], np.int32), lanes, axis=1)
        self.name, self.same = np.empty(lanes, np.int32), np.empty(lanes, bool)

    def predict(self, state: np.ndarray) -> np.ndarray:
        """Names predicted by order 1 and 2; the state that chooses weights is put out: both confidences, and whether the names agree."""
        guess, parts = self.guess, self.parts
        self.table.take(self.slots, out=self.entry, mode="clip")
        np.right_shift(self.entry, _TWO, guess)
        np.bitwise_and(self.entry, _TRUST, self.trust)
        np.multiply(self.trust, self.scale, parts)
        np.add(parts[0], parts[1], state)
        np.equal(guess[0], guess[1], self.same)
        np.add(state, self.same, state)
        return guess

    def learn(self, found: np.ndarray, name: np.ndarray, hit: np.ndarray) -> None:
        """The id that came: its rank, its name, and 1 for each order that predicted it."""
        entry, slots, slot = self.next, self.slots, self.last
        np.minimum(self.trust, _TWO, entry)
        np.multiply(entry, hit, entry)
        np.left_shift(name, _TWO, self.name)
        np.add(self.name, _ONE, self.name)
        np.add(entry, self.name, entry)
        self.table[slots] = entry
        np.add(self.base[0], found, slots[0])
        np.multiply(slot, _SLOT_FACTOR_WIDE, slot)
        np.add(slot, found, slot)
        np.bitwise_and(slot, _SLOT_MASK_WIDE, slot)
        np.add(self.base[1], slot, slots[1])
        np.copyto(slot, found)


class _Weights:
    """How often order 1, order 2 and order 0 came true in each state of a lane, and the orders' weights by that."""

    def __init__(self, lanes: int):
        first = np.zeros((4, 4, 2, 3))
        for two in range(4):
            for one in range(4):
                for same in range(2):
                    hit2 = two / (two + 1)
                    hit1 = 0.0 if same and two else (1 - hit2) * one / (one + 4)
                    first[two, one, same] = hit1, hit2, 1 - hit1 - hit2
        counts = np.maximum(np.round(first * START * 64), [0, 0, 1]).astype(np.int64).reshape(_STATES, 3)
        self.counts = np.tile(counts.T, (lanes, 1, 1))  # lane, order, state
        self.base = np.arange(lanes) * _STATES
        self.table = np.empty((3, lanes * _STATES), np.int32)
        self.at, self.found = np.empty(lanes, np.int64), np.empty((3, lanes), np.int32)
        self._share()

    def _share(self) -> None:
        # parts of 2**WEIGHT_BITS, rounded down: order 0 keeps one at least; quotients of numbers so small are exact below the point
        one, two, rest = (self.counts[:, k] for k in range(3))
        parts = ((self.counts[:, :2] << WEIGHT_BITS) / (one + two + rest)[:, None]).astype(np.int32)
        for k in range(2):
            np.left_shift(parts[:, k], TOTAL_BITS, out=self.table[k].reshape(-1, _STATES))
        np.subtract((1 << WEIGHT_BITS) - parts[:, 0], parts[:, 1], out=self.table[2].reshape(-1, _STATES))

    def of(self, state: np.ndarray) -> np.ndarray:
        """Ranges of order 1 and of order 2, and the weight of order 0, for states of all lanes: (3, lanes)."""
        np.add(self.base, state, self.at)
        return self.table.take(self.at, axis=1, out=self.found, mode="clip")

    def of_many(self, states: np.ndarray) -> list[np.ndarray]:
        """The same for states of some steps: three of (lanes, steps)."""
        at = self.base[:, None] + states
        return [t.take(at, mode="clip") for t in self.table]

    def learn(self, outcomes: np.ndarray) -> None:
        """Outcomes of some steps, (lanes, steps)."""
        seen = np.bincount((self.base[:, None] * 3 + outcomes).ravel(), minlength=self.counts.size)
        self.counts += (seen << 6).reshape(self.counts.shape)
        self._share()


def _outcomes(states: np.ndarray, hit1: np.ndarray, hit2: np.ndarray) -> np.ndarray:
    """The state of a step, and which order came true: none is added for order 1, _STATES for order 2 and twice as much for order 0."""
    return states + np.uint8(_STATES) * np.where(hit2, np.uint8(1), np.uint8(2) - np.uint8(2) * hit1)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts as parts of 2**TOTAL_BITS, each 1 at least; what rounding leaves goes to the most frequent."""
    parts = 1 + counts.astype(np.int64) * (_TOTAL - len(counts)) // max(1, int(counts.sum()))
    parts[int(counts.argmax())] += _TOTAL - int(parts.sum())
    return parts


class _Mixer:
    """The mixed prediction of every lane. An id's share of the range is the weighted sum of its order-0 part and
    of the whole of each order that predicts it; ids follow each other in order, so shares before it add up."""

    def __init__(self, parts: list[np.ndarray], width: int):
        lanes = len(parts)
        self.base = np.arange(lanes) * width
        both = np.zeros((lanes, width), np.int32)
        for i, p in enumerate(parts):
            both[i, : len(p)] = ((np.cumsum(p) - p) << (TOTAL_BITS + 1)) + p
        self.both = both.ravel()
        self.starts = np.arange(lanes) * float(_TOTAL)
        self.place, self.quotient, self.aim, self.found = np.empty(lanes, np.int64), np.empty(lanes), np.empty(lanes, np.int32), np.empty(lanes, np.int32)
        self.past, self.behind, self.own = (np.empty((2, lanes), np.int32) for _ in range(3))
        #: Whether each order's guess comes before the id, and whether it is the id; and that times the order's range.
        self.told, self.parts = np.empty((2, 2, lanes), np.int32), np.empty((2, 2, lanes), np.int32)
        self.shares = np.empty((2, lanes), np.int64)

    def order0(self, found: np.ndarray) -> np.ndarray:
        """Order-0 parts before ids, which name them, and of them: (2, lanes)."""
        np.add(self.base, found, self.place)
        self.both.take(self.place, out=self.found, mode="clip")
        np.right_shift(self.found, _SPLIT, self.own)
        return np.bitwise_and(self.own, _MASKS, self.own)

    def locate(self, aim: np.ndarray, guess: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The order-0 place that aim stands for, counted through all lanes: the ranges of predictions before it are taken off. guess names ids by their places."""
        past, behind, both, q0 = self.past, self.behind, weights[:2], weights[2]
        np.copyto(self.aim, aim, casting="unsafe")
        np.multiply(guess, q0, past)
        np.subtract(self.aim, past, past)
        # one where the other order's guess comes before
        np.subtract(guess[::-1], guess, behind)
        np.right_shift(behind.view(np.uint32), _TOP, behind.view(np.uint32))
        np.multiply(behind, both[::-1], behind)
        np.subtract(past, behind, past)
        np.maximum(past, _ZERO, past)
        np.minimum(past, both, past)
        np.subtract(self.aim, past[0], self.aim)
        np.subtract(self.aim, past[1], self.aim)
        np.divide(self.aim, q0, self.quotient)
        np.add(self.quotient, self.starts, self.quotient)
        np.copyto(self.place, self.quotient, casting="unsafe")
        return self.place

    def share(self, own: np.ndarray, guess: np.ndarray, hits: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Range before the ids of one step, and of them, from their order-0 parts; hits is told which orders predict them."""
        told, parts = self.told, self.parts
        behind = told[0]
        np.subtract(guess, own[0], behind)
        np.equal(behind, _ZERO, hits)
        np.right_shift(behind.view(np.uint32), _TOP, behind.view(np.uint32))
        np.copyto(told[1], hits)
        np.multiply(told, weights[:2], parts)
        np.multiply(own, weights[2], self.past)
        np.add(self.past, parts[:, 0], self.past)
        np.add(self.past, parts[:, 1], self.past)
        np.copyto(self.shares, self.past)
        return self.shares

    def share_many(self, found: np.ndarray, guess1: np.ndarray, guess2: np.ndarray, one: np.ndarray, two: np.ndarray, q0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range before ids and of them for some steps, (lanes, steps), named by their ranks."""
        both = self.both.take(self.base[:, None] + found, mode="clip")
        low = q0 * (both >> (TOTAL_BITS + 1)) + one * (guess1 < found) + two * (guess2 < found)
        return low, q0 * (both & ((2 << TOTAL_BITS) - 1)) + one * (guess1 == found) + two * (guess2 == found)


def _encode_lanes(ranks: np.ndarray, width: int) -> tuple[np.ndarray, list[bytes]]:
    """Order-0 counts and a code for each row of ranks, all of them below width.

    An id counts for order 0 where neither order 1 nor order 2 predicts it, and each id of a block does so once.
    """
    lanes, steps = ranks.shape
    guesses, states, outcomes = np.empty((2, lanes, steps), np.uint16), np.empty(ranks.shape, np.uint8), np.empty(ranks.shape, np.uint8)
    counts = np.zeros((lanes, width), np.int64)
    for i, found in enumerate(ranks):
        last = np.zeros(steps + 1, np.uint16)
        last[2:] = found[:-1]
        (guess1, trust1), (guess2, trust2) = _predicted(found, last[1:], width), _predicted(found, _slots(last[:-1], last[1:]), width)
        hit1, hit2 = guess1 == found, guess2 == found
        guesses[0, i], guesses[1, i] = guess1, guess2
        states[i] = (trust2 << 3) + (trust1 << 1) + (guess1 == guess2)
        outcomes[i] = _outcomes(states[i], hit1, hit2)
        counts[i] = np.bincount(found[~(hit1 | hit2)], minlength=width)
    sizes = ranks.max(axis=1).astype(np.int64) + 1
    mixer, weights, coder = _Mixer([scaled(c[:n]) for c, n in zip(counts, sizes, strict=True)], width), _Weights(lanes), _Encoder(lanes, steps)
    for a in range(0, steps, CHUNK):
        part = slice(a, a + CHUNK)
        low, own = mixer.share_many(ranks[:, part], guesses[0, :, part], guesses[1, :, part], *weights.of_many(states[:, part]))
        coder.narrow(low.T.astype(np.int64, order="C"), own.T.astype(np.int64, order="C"))
        weights.learn(outcomes[:, part])
    return counts, coder.codes()


def _decode_lanes(codes: list[bytes], steps: int, counts: list[np.ndarray]) -> np.ndarray:
    """The ranks that _encode_lanes coded, (steps, lanes)."""
    lanes, width = len(codes), max(len(c) for c in counts)
    parts = [scaled(c) for c in counts]
    lookup = np.concatenate([np.repeat(np.arange(len(p), dtype=np.uint16), p) for p in parts])
    contexts, mixer, weights, coder = _Contexts(lanes, width, _TOTAL), _Mixer(parts, width), _Weights(lanes), _Decoder(codes)
    out = np.empty((steps, lanes), np.uint16)
    states, hits = np.empty((CHUNK, lanes), np.int32), np.empty((CHUNK, 2, lanes), bool)
    with np.errstate(all="ignore"):  # a damaged code may lead anywhere; the checksum tells
        for t in range(steps):
            k = t % CHUNK
            guess = contexts.predict(states[k])
            shares = weights.of(states[k])
            found = lookup.take(mixer.locate(coder.aim(), guess, shares), out=out[t], mode="clip")
            own = mixer.order0(found)
            coder.narrow(mixer.share(own, guess, hits[k], shares))
            contexts.learn(found, own[0], mixer.told[1])
            if k == CHUNK - 1:
                weights.learn(_outcomes(states.astype(np.uint8), hits[:, 0], hits[:, 1]).T)
    return out


def _varints(x: np.ndarray) -> bytes:
    """Numbers in groups of 7 bits, the lowest first; a set high bit says that more follow."""
    x = x.astype(np.int64)
    n = max(1, -(-int(x.max(initial=0)).bit_length() // 7))
    groups = np.stack([(x >> (7 * k)) & 127 for k in range(n)], axis=1)
    more = np.stack([x >> (7 * k + 7) > 0 for k in range(n)], axis=1)
    used = np.concatenate([np.ones((len(x), 1), bool), more[:, :-1]], axis=1)
    return (groups | (more << 7))[used].astype(np.uint8).tobytes()


def _read_varints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(b < 128)
    if not len(ends) or ends[-1] != len(b) - 1:
        raise ValueError("a block's list of ids is damaged")
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127) << (7 * np.minimum(place, 8)), starts)


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and the place of each id among them: by a table where ids are small, else by sorting."""
    most = int(ids.max())
    if most >= _TABLE:
        return np.unique(ids, return_inverse=True)
    there = np.zeros(most + 1, bool)
    there[ids] = True
    return np.flatnonzero(there).astype(ids.dtype), (np.cumsum(there, dtype=np.int32) - 1)[ids]


def encode_ids(ids: np.ndarray) -> bytes:
    """A segment of blocks: magic, numbers of ids and of steps, lengths, checksum of the ids, their list, and code.

    The list holds a block's distinct ids as differences and how often each comes unpredicted by orders 1 and 2;
    codes speak of places in it. Blocks are alike in length; one that is an id short repeats its last id as a step
    more. Every block can be read by itself.
    """
    if not len(ids):
        return b""
    n_blocks = -(-len(ids) // min(BLOCK, max(LEAST_BLOCK, len(ids) // LANES)))
    blocks = np.array_split(ids.astype(np.uint32, copy=False), n_blocks)
    steps = len(blocks[0])
    lists, ranks = [], np.empty((n_blocks, steps), np.uint16)
    for i, b in enumerate(blocks):
        distinct, place = _distinct(b)
        lists.append(distinct)
        ranks[i, : len(b)] = place
        ranks[i, len(b) :] = place[-1]
    counts, codes = [], []
    for a in range(0, n_blocks, ENCODED_LANES):
        some = _encode_lanes(ranks[a : a + ENCODED_LANES], max(len(d) for d in lists[a : a + ENCODED_LANES]))
        counts += list(some[0])
        codes += some[1]
    out: list[bytes] = []
    for b, distinct, c, code in zip(blocks, lists, counts, codes, strict=True):
        known = zlib.compress(_varints(np.diff(distinct, prepend=np.uint32(0))) + _varints(c[: len(distinct)]), 9)
        out.append(MAGIC + struct.pack("<IIIII", len(b), steps, len(known), len(code), zlib.crc32(b.astype("<u4").tobytes())) + known + code)
    return b"".join(out)


def decode_ids(segment: bytes) -> np.ndarray:
    """The ids of a segment; a block that is damaged or doesn't match its checksum raises ValueError."""
    at, heads = 0, []
    while at < len(segment):
        if segment[at : at + 4] != MAGIC or at + 24 > len(segment):
            raise ValueError(f"no block at byte {at}")
        n, steps, known, size, crc = struct.unpack_from("<IIIII", segment, at + 4)
        at += 24
        if at + known + size > len(segment) or not 0 < n <= steps <= BLOCK:
            raise ValueError("the segment ends inside a block")
        heads.append((n, steps, *_list_of(segment[at : at + known], steps), segment[at + known : at + known + size], crc))
        at += known + size
    found: list[np.ndarray | None] = [None] * len(heads)
    for steps in {h[1] for h in heads}:
        same = [i for i, h in enumerate(heads) if h[1] == steps]
        ranks = _decode_lanes([heads[i][4] for i in same], steps, [heads[i][3] for i in same])
        for lane, i in enumerate(same):
            n, _, distinct, _, _, crc = heads[i]
            ids = distinct[ranks[:n, lane]].astype(np.uint32)
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError("a block doesn't match its checksum")
            found[i] = ids
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def _list_of(known: bytes, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct ids and their order-0 counts."""
    try:
        numbers = _read_varints(zlib.decompress(known))
    except zlib.error as e:
        raise ValueError("a block's list of ids is damaged") from e
    half = len(numbers) // 2
    if len(numbers) % 2 or not 0 < half <= steps or not 0 < numbers[half:].sum() <= steps:
        raise ValueError("a block's list of ids is damaged")
    return np.cumsum(numbers[:half]), numbers[half:]
