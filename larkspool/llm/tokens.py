"""Token ids in a binary format: segments of blocks coded by an adaptive context-mixing range coder."""

from __future__ import annotations

import re
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .mixcoder import decode_ids, encode_ids

#: Ids in a segment, about: whole documents, whose blocks are coded side by side.
SEGMENT = 16 << 20
#: Documents for each range of the file, about.
RANGE_ROWS = 12_000
#: Pieces that a task remembers the ids of, and their characters; beyond that it keeps those seen again, or none, and goes on.
PIECES, PIECE_CHARS = 300_000, 16 << 20
#: Pieces that go through the library as one text.
TOGETHER = 256
#: Words that a task remembers the ids of, and their bytes, in the same way; bytes of text that are cut into words at once.
WORDS, WORD_BYTES, AT_ONCE = 1_000_000, 16 << 20, 8 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WIDE = re.compile(r"\s\s")


def _cuts_are_safe(tokenizer) -> bool:
    """Whether no token of any text goes over a single space between two characters that are none, but starts there.

    So it is in byte-level tokenizers that split by their own pattern and change no text before: a lone space
    always begins a new word. Special tokens must not take in the spaces beside them or hold one.
    """
    split = tokenizer.pre_tokenizer
    if tokenizer.normalizer is not None or type(split).__name__ != "ByteLevel" or split.add_prefix_space or not split.use_regex:
        return False
    return not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in tokenizer.get_added_tokens_decoder().values())


class _Known(dict):
    """Numbers of pieces; a new piece gets the next one and is noted."""

    def __init__(self, lead: str, new: list[str], count: list[int]):
        self.lead, self.new, self.count = lead, new, count

    def __missing__(self, piece: str) -> int:
        n = self[piece] = self.count[0]
        self.count[0] += 1
        self.new.append(self.lead + piece)
        return n


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library.

    Texts are cut where the tokenizer starts anew in any case, and each different piece goes through it once,
    together with others; where cuts are not safe, texts go through it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = _cuts_are_safe(self.tokenizer)
        self._start()

    def _start(self) -> None:
        """No piece is known."""
        self.new: list[str] = []
        self.count, self.chars = [0], 0
        self.first, self.later = _Known("", self.new, self.count), _Known(" ", self.new, self.count)
        #: By number: where a piece's ids begin, how many they are, and how often it was seen.
        self.ids, self.starts, self.sizes, self.seen = np.zeros(0, np.uint32), *(np.zeros(0, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Forget the pieces seen once; all of them where that leaves more than half of what may be remembered."""
        again = self.seen > 1
        chars = sum(len(p) + len(d.lead) for d in (self.first, self.later) for p, n in d.items() if again[n])
        if 2 * np.count_nonzero(again) > PIECES or 2 * chars > PIECE_CHARS:
            again[:], chars = False, 0
        number = np.cumsum(again) - 1
        for known in (self.first, self.later):
            kept = {p: int(number[n]) for p, n in known.items() if again[n]}
            known.clear()
            known.update(kept)
        self.count[0], self.chars = int(np.count_nonzero(again)), chars
        starts, self.sizes = self.starts[again], self.sizes[again]
        self.seen = np.zeros(self.count[0], np.int64)
        self.ids, self.starts = _runs(self.ids, starts, self.sizes)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @cached_property
    def _token_bytes(self) -> np.ndarray:
        """UTF-8 bytes that each id stands for: one for each character of a byte-level token, added ones as they are."""
        known = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(known.values(), default=0) + 1, np.int64)
        for token, n in known.items():
            out[n] = len(token)
        for n, t in self.tokenizer.get_added_tokens_decoder().items():
            out[n] = len(t.content.encode())
        return out

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces that begin with a lone space and end in none, end to end, and the number of each.

        The tokenizer starts anew at each of them, so bytes tell where; None if the ids don't stand for all bytes.
        """
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, pieces)), np.int64, len(pieces)))
        return self._parts(["".join(pieces[a : a + TOGETHER]) for a in range(0, len(pieces), TOGETHER)], ends)

    def _parts(self, texts: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of texts end to end, and the number of each part, which end at these bytes."""
        ids = np.concatenate([np.zeros(0, np.uint32), *self._whole(texts)])
        at = np.append(0, np.cumsum(self._token_bytes[ids]))
        past = np.searchsorted(at, ends)
        if at[-1] != ends[-1] or (at[past] != ends).any():
            return None
        return ids, np.diff(past, prepend=0)

    def _learn(self) -> None:
        """Ids of the new pieces."""
        joins = np.array([len(p) > 1 and p[0] == " " and not p[1].isspace() and not p[-1].isspace() for p in self.new])
        sizes = np.zeros(len(self.new), np.int64)
        found = [self.ids]
        if joins.any() and (shared := self._together([self.new[i] for i in np.flatnonzero(joins)])):
            found.append(shared[0])
            sizes[joins] = shared[1]
        else:
            joins[:] = False
        rest = np.flatnonzero(~joins)
        alone = self._whole([self.new[i] for i in rest])
        sizes[rest] = [len(x) for x in alone]
        order = np.concatenate([np.flatnonzero(joins), rest])
        starts = np.empty(len(order), np.int64)
        starts[order] = len(self.ids) + np.cumsum(sizes[order]) - sizes[order]
        self.ids = np.concatenate([*found, *alone])
        self.starts, self.sizes = np.append(self.starts, starts), np.append(self.sizes, sizes)
        self.seen = np.append(self.seen, np.zeros(len(order), np.int64))
        self.chars += sum(map(len, self.new))
        self.new.clear()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts laid end to end, and the number of each."""
        if not self.cut:
            found = self._whole(texts)
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)
        if self.count[0] > PIECES or self.chars > PIECE_CHARS:
            self._forget()
        numbers, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            pieces = _CUT.split(text) if _WIDE.search(text) else text.split(" ")
            sizes[i] = len(pieces)
            numbers.append(self.first[pieces[0]])
            numbers += map(self.later.__getitem__, pieces[1:])
        if self.new:
            self._learn()
        at = np.array(numbers, np.int64)
        self.seen += np.bincount(at, minlength=len(self.seen))
        lengths = self.sizes[at]
        out, _ = _runs(self.ids, self.starts[at], lengths)
        return out, np.diff(np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(sizes))])


#: Classes of bytes: of a character beyond ASCII, an ASCII letter, another ASCII character, white space in any case, and
#: what may be white space or not; the first byte of characters that may be so is told apart.
_OTHER, _LETTER, _SIGN, _WHITE, _DOUBT, _LEAD = range(6)
_CLASSES = bytes(
    _LETTER if chr(b).isascii() and chr(b).isalpha() else _WHITE if b in b" \t\n\r" else _DOUBT if b in b"\x0b\x0c\x1c\x1d\x1e\x1f" else _LEAD if b in b"\xc2\xe1\xe2\xe3" else _SIGN if b < 128 else _OTHER
    for b in range(256)
)
_DOUBTFUL = [c.encode() for c in "\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000"]


def _begins(data: bytes) -> np.ndarray:
    """Whether a token begins at each byte of UTF-8 in any case, and white space behind it doesn't depend on what is ahead.

    So it is in a tokenizer that takes runs of letters, of digits and of other signs, each with at most one space
    ahead, or of white space: where white space follows anything else, where another ASCII character
    follows an ASCII letter, and behind a line feed that stands alone.
    """
    kinds = np.frombuffer(data.translate(_CLASSES), np.uint8)
    lead = np.flatnonzero(kinds == _LEAD)
    if lead.size:
        kinds, padded = kinds.copy(), np.frombuffer(data + b"\0\0", np.uint8)
        kinds[lead] = _OTHER
        for c in _DOUBTFUL:
            at = lead[np.logical_and.reduce([padded[lead + i] == b for i, b in enumerate(c)])]
            for i in range(len(c)):
                kinds[at + i] = _DOUBT
    white, solid = kinds == _WHITE, kinds < _WHITE
    begins = np.zeros(len(data), bool)
    begins[1:] = (solid[:-1] & white[1:]) | ((kinds[:-1] == _LETTER) & (kinds[1:] == _SIGN))
    alone = (np.frombuffer(data, np.uint8) == 10)[1:-1] & solid[:-2]
    begins[2:] |= alone & solid[2:]
    return begins


def _laid(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """UTF-8 of texts laid end to end, and where each ends in it."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return b"", np.zeros(0, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    first, ends = int(ends[0]), ends[1:] - ends[0]
    return texts.buffers()[2].slice(first, int(ends[-1])).to_pybytes() if ends[-1] else b"", ends


def _solid_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which words begin with a space, and which begin, or go on behind it, and end with what is no white space in any case."""
    data, ends = _laid(words)
    text, starts = np.frombuffer(b"\0\0" + data, np.uint8), np.append(0, ends[:-1])
    kinds = np.frombuffer(b"\0\0" + data.translate(_CLASSES), np.uint8)
    spaced = text[starts + 2] == 32
    head = np.minimum(starts + spaced, ends - 1)
    # a character of two or three bytes at the end may be white space if it begins as such do
    doubtful = (kinds[ends + 1] == _OTHER) & ((kinds[ends] == _LEAD) | (kinds[ends - 1] == _LEAD))
    return spaced, (kinds[head + 2] < _WHITE) & (kinds[ends + 1] < _WHITE) & ~doubtful


class WordEncoder(Encoder):
    """Ids of whole texts, which are cut into words and what stands between them; Arrow numbers the different ones.

    Each different word goes through the tokenizer once, together with others. Texts that hold a special token are cut
    at lone spaces only; where cuts are not safe, texts go through the tokenizer whole.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget_words(np.zeros(0, bool))

    def _forget_words(self, kept: np.ndarray) -> None:
        """Keep these of the words that are known."""
        if not kept.any():
            self.words = pa.array([], pa.string())
            self.word_ids, self.word_starts, self.word_sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            self.words = self.words.filter(pa.array(kept))
            self.word_sizes = self.word_sizes[kept]
            self.word_ids, self.word_starts = _runs(self.word_ids, self.word_starts[kept], self.word_sizes)
        self.word_seen = np.zeros(len(self.words), np.int64)

    def _learn_words(self, new: pa.StringArray) -> None:
        """Ids of words that come behind those known. Most share a text, behind a space or else a line feed."""
        for a in range(0, len(new), 64 * TOGETHER):
            words = new[a : a + 64 * TOGETHER]
            spaced, joins = _solid_words(words)
            feeds = pc.if_else(pa.array(spaced[joins]), "", "\n")
            shared, ends = _laid(pc.binary_join_element_wise(feeds, words.filter(pa.array(joins)), ""))
            texts = [shared[b:e].decode() for b, e in zip(np.append(0, ends[TOGETHER - 1 : -1 : TOGETHER]).tolist(), np.append(ends[TOGETHER - 1 : -1 : TOGETHER], len(shared)).tolist(), strict=True)]
            if (found := self._parts(texts, ends)) is None:
                joins[:] = False
                found = np.zeros(0, np.uint32), np.zeros(0, np.int64)
            ids, size = found
            ahead = ~spaced[joins]  # a line feed that is put ahead is one token
            alone = self._whole(words.filter(pa.array(~joins)).to_pylist())
            starts, sizes, lone = np.empty(len(words), np.int64), np.empty(len(words), np.int64), np.array([len(x) for x in alone], np.int64)
            starts[joins], sizes[joins] = np.cumsum(size) - size + ahead, size - ahead
            starts[~joins], sizes[~joins] = len(ids) + np.cumsum(lone) - lone, lone
            self.word_starts = np.append(self.word_starts, len(self.word_ids) + starts)
            self.word_ids = np.concatenate([self.word_ids, ids, *alone])
            self.word_sizes = np.append(self.word_sizes, sizes)
        self.word_seen = np.append(self.word_seen, np.zeros(len(new), np.int64))

    def encode_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and the number of each; null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        special = np.zeros(len(texts), bool)
        for token in self.special:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not self.cut or special.all():
            return self.encode(texts.to_pylist())
        if special.any():
            return self._mixed(texts, special)
        if len(self.words) > WORDS or self.words.nbytes > WORD_BYTES:
            again = self.word_seen > 1
            self._forget_words(again if 2 * np.count_nonzero(again) <= WORDS and 2 * self.words.filter(pa.array(again)).nbytes <= WORD_BYTES else again & False)
        data, ends = _laid(texts)
        if not data:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        begins = _begins(data)
        begins[0] = True
        begins[ends[ends < len(data)]] = True
        starts = np.append(np.flatnonzero(begins), len(data))
        kind, place = (np.int32, pa.string()) if len(data) < 1 << 31 else (np.int64, pa.large_string())
        found = pa.Array.from_buffers(place, len(starts) - 1, [None, pa.py_buffer(starts.astype(kind)), pa.py_buffer(data)])
        numbers = pa.concat_arrays([self.words.cast(place), found]).dictionary_encode()
        known, at = len(self.words), numbers.indices.to_numpy()[len(self.words) :]
        if len(numbers.dictionary) > known:
            self._learn_words(numbers.dictionary[known:])
            self.words = numbers.dictionary.cast(pa.string())
        self.word_seen += np.bincount(at, minlength=len(self.word_seen))
        lengths = self.word_sizes[at]
        ids, _ = _runs(self.word_ids, self.word_starts[at], lengths)
        return ids, np.diff(np.append(0, np.cumsum(lengths))[np.searchsorted(starts, ends)], prepend=0)

    def _mixed(self, texts: pa.Array, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Some of the texts hold special tokens."""
        sizes, starts, ids, at = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [], 0
        for these in (special, ~special):
            found, n = self.encode_arrow(texts.filter(pa.array(these)))
            sizes[these], starts[these] = n, at + np.cumsum(n) - n
            ids.append(found)
            at += len(found)
        return _runs(np.concatenate(ids), starts, sizes)[0], sizes


@lru_cache(1)
def _encoder(path: str) -> WordEncoder:
    """The encoder of a Python worker: the words that its tasks saw stay known."""
    return WordEncoder(path)


def _portions(texts: pa.Array) -> list[tuple[int, int]]:
    """First row and number of rows, of AT_ONCE bytes each or of one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    out, a, size = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > AT_ONCE:
            out.append((a, i - a))
            a, size = i, 0
        size += n
    return [*out, (a, len(sizes) - a)]


def _runs(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values laid end to end, and where each begins then."""
    begins = np.cumsum(sizes) - sizes
    at = np.repeat(starts - begins, sizes)
    at += np.arange(len(at), dtype=np.int32 if len(at) < 1 << 31 else np.int64)
    return values[at], begins


def _writer(tokenizer_path: str, end_id: int):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        encoder = _encoder(tokenizer_path)
        part, seq = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal seq, docs, lengths, held, size
            ids = np.concatenate(held)
            held = []
            row = [[part], [seq], [docs], [lengths], [size], [encode_ids(ids)]]
            seq, docs, lengths, size = seq + 1, [], [], 0
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "seq", "docs", "lengths", "n_ids", "blocks"])

        for batch in batches:
            for a, rows in _portions(batch.column(1)):
                ids, n = encoder.encode_arrow(batch.column(1).slice(a, rows))
                held.append(np.insert(ids, np.cumsum(n), np.uint32(end_id)).astype(np.uint32))
                docs += batch.column(0).slice(a, rows).to_pylist()
                lengths += (n + 1).tolist()
                size += len(held[-1])
                if size >= SEGMENT:
                    yield flush()
        if held:
            yield flush()

    return run


SEGMENT_SCHEMA = "part long, seq long, docs array<long>, lengths array<long>, n_ids long, blocks binary"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, each followed by end_id, in ascending order of the id (null first).

    The folder holds segments: rows of part, seq (their order), ids and lengths of whole documents, and coded
    blocks. Null texts are empty; rows of one id follow each other by a hash of their text, so that many of them
    (or many without an id) spread over ranges; other columns are ignored; an empty table writes no segment. A
    very long text is held whole by its task, and its ids fill blocks like others.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    order = [F.col("id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(_writer(tokenizer_path, end_id), SEGMENT_SCHEMA).write.mode("overwrite").parquet(path)


def _reader(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            r = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
            ids = decode_ids(r["blocks"]).astype("<u4")
            ends = np.cumsum(r["lengths"])
            starts = ends - r["lengths"]
            if len(ids) != ends[-1]:
                raise ValueError("a segment has another number of ids than its documents")
            crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
            n = len(crcs)
            cols = [pa.array(r["docs"], pa.int64()), pa.array([r["part"]] * n, pa.int64()), pa.array([r["seq"]] * n, pa.int64()), pa.array(starts), pa.array(r["lengths"], pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "part", "seq", "at", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document of the files, decoded and checked.

    start counts the ids of all documents before it. Only one row per segment is summed in one task.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    ahead = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("part", "seq", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("from"))
    found = segments.mapInArrow(_reader, "id long, part long, seq long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "seq"]).select("id", (F.col("from") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, ids) of every document of the files."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                ids = decode_ids(r["blocks"]).astype(np.int32)
                offsets = pa.array(np.concatenate([[0], np.cumsum(r["lengths"])]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(r["docs"], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=["id", "ids"])

    return spark.read.schema(SEGMENT_SCHEMA).parquet(path).mapInArrow(run, "id long, ids array<int>")
