"""Exact substring removal: repeated 200-byte strings found by suffix arrays that are built by linear grouping."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, _BYTE_KEYS, _power_tables, golden, materialize, mix64, scratch, text_slices

#: Length of the strings, and of the grams that anchor them.
LENGTH, GRAM = 200, 50
_REACH = LENGTH - GRAM
#: Starts of the strings around an anchor are split into this many classes.
CLASSES = 4
#: Strings of one group that one suffix array holds, at most; and symbols after which a suffix array is built.
GROUP, CHUNK = 256, 1 << 14
#: Bytes of texts whose anchors are looked for at once: their arrays of 64-bit numbers stay near the processor.
SLICE = 1 << 17
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- suffix array by linear grouping


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a list of positive integers, by linear grouping (Baier 2016).

    Phase 1 sorts suffixes into groups of equal Lyndon prefix. Groups are taken in descending order; each
    suffix of a group points to the nearest suffix before it of a smaller group, and the suffixes so pointed to
    leave their groups for new ones right behind them, once for each number of pointers: their prefix has
    grown by the group's. Phase 2 emits the order: the suffix before each one already placed, and all it
    points to in turn, take the next free places of their groups. Nothing is renamed and nothing recurses.
    """
    n = len(text) + 1
    s = [*text, 0]
    order = sorted(range(n), key=s.__getitem__)
    place = [0] * n
    start = [0] * n  # first place of the suffix's group
    size = [0] * n  # by first place
    at = 0
    for p, i in enumerate(order):
        if p and s[i] != s[order[p - 1]]:
            at = p
        start[i], place[i] = at, p
        size[at] += 1
    previous = [-1] * n
    end = n
    while end:
        first = start[order[end - 1]]
        members = order[first:end] if end - first == 1 else sorted(order[first:end])
        pointers: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and start[j] >= first:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        if pointers:
            if len(pointers) == 1 or max(pointers.values()) == 1:
                classes = [list(pointers)]
            else:
                by_count: dict[int, list[int]] = {}
                for j, c in pointers.items():
                    by_count.setdefault(c, []).append(j)
                classes = [by_count[c] for c in sorted(by_count, reverse=True)]
            for some in classes:
                moved: dict[int, int] = {}
                for j in some:
                    g = start[j]
                    k = moved.get(g, 0) + 1
                    moved[g] = k
                    to = g + size[g] - k
                    other, p = order[to], place[j]
                    order[p], order[to] = other, j
                    place[other], place[j] = p, to
                for g, k in moved.items():
                    size[g] -= k
                    fresh = g + size[g]
                    if k and fresh != g:
                        size[fresh] = k
                        for p in range(fresh, fresh + k):
                            start[order[p]] = fresh
                    else:
                        size[g] = k
        end = first
    array = [-1] * n
    array[0] = n - 1
    filled = [0] * n
    done = [False] * n
    done[n - 1] = True
    for p in range(n):
        j = array[p] - 1
        while j >= 0 and not done[j]:
            g = start[j]
            array[g + filled[g]] = j
            filled[g] += 1
            done[j] = True
            j = previous[j]
    return array[1:]


def repeated_windows(strings: list[bytes], groups: list[int], leads: list[int], cores: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each string, whether each of its windows of LENGTH bytes stands as far from the anchor in another string of its group.

    Every window of a string holds its core, from one byte to before another, which lies alike in windows that are as
    far from the anchor. So a core is one symbol, the same for the same bytes. All strings lie in one suffix array,
    apart by a smaller symbol; equal windows are neighbours in it.
    """
    names: dict[bytes, int] = {}
    symbols = [258 + names.setdefault(x[a:b], len(names)) for x, (a, b) in zip(strings, cores, strict=True)]
    flat = np.frombuffer(b"".join([x[:a] + b"\0" + x[b:] + b"\0" for x, (a, b) in zip(strings, cores, strict=True)]), np.uint8).astype(np.int64) + 2
    inside = np.array(cores, np.int64).reshape(-1, 2)
    widths = LENGTH + 1 - (inside[:, 1] - inside[:, 0])
    windows = np.array([len(x) for x in strings]) - LENGTH + 1
    ends = np.cumsum(windows + widths)
    starts = ends - (windows + widths)
    flat[ends - 1], flat[starts + inside[:, 0]] = 1, symbols
    sa = np.array(suffix_array(flat.tolist()), np.int64)
    owner = np.repeat(np.arange(len(strings)), windows + widths)
    offset = np.arange(len(flat)) - starts[owner]
    sa = sa[(offset < windows[owner])[sa]]
    marked = np.zeros(len(flat), bool)
    if len(sa) > 1:
        steps = np.arange(widths.max())
        held = np.append(flat, np.zeros(len(steps), np.int64))[sa[:, None] + steps]
        held[steps >= widths[owner[sa]][:, None]] = 0
        run = np.concatenate([[0], np.cumsum((held[1:] != held[:-1]).any(axis=1))])
        group = np.array(groups)[owner[sa]]
        lead = offset[sa] - np.array(leads)[owner[sa]]
        order = np.lexsort((lead, group, run))
        r, g, d = run[order], group[order], lead[order]
        same = (r[1:] == r[:-1]) & (g[1:] == g[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        marked[sa[order[twice]]] = True
    return [marked[x : x + n] for x, n in zip(starts.tolist(), windows.tolist(), strict=True)]


# ---------------------------------------------------------------- anchors


def _sliding(v: np.ndarray, width: int, best) -> np.ndarray:
    """best of v[i : i + width] for every i, shorter at the end."""
    out, done = v.copy(), 1
    while 2 * done <= width:
        out[:-done] = best(out[:-done], out[done:])
        done *= 2
    if rest := width - done:
        out[:-rest] = best(out[:-rest], out[rest:])
    return out


def _sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[data] * _power_tables(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def _span_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64((sums[b] - sums[a]) * _power_tables(len(sums))[1][a])


def _owned(p: np.ndarray, v: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors that are the first smallest gram of some string, and the first and last starts of these strings."""
    starts = np.flatnonzero(least)
    near = np.searchsorted(p, starts)
    open_ = np.arange(len(starts))
    while open_.size:
        wrong = v[p[near[open_]]] != least[starts[open_]]
        open_ = open_[wrong]
        near[open_] += 1
    owners, at, n = np.unique(near, return_index=True, return_counts=True)
    return p[owners], starts[at], starts[at + n - 1]


def _anchors(batches):
    """Places whose gram has the smallest hash in some string of LENGTH bytes: equal strings hold equal anchors.

    A context is what the strings cover whose first smallest gram the anchor is: back bytes before it, ahead from it on."""
    for batch in batches:
        for a, _, data, offsets in text_slices(batch.column(1), SLICE):
            n = len(data)
            if n < LENGTH:
                continue
            sums = _sums(data)
            at = np.arange(n - GRAM + 1)
            v = np.full(n, _TOP, np.uint64)
            v[at] = _span_hash(sums, at, at + GRAM)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            last = offsets[doc + 1]
            place = np.arange(n)
            v[place + GRAM > last] = _TOP
            least = _sliding(v, _REACH + 1, np.minimum)
            least[place + LENGTH > last] = 0
            most = _sliding(least[::-1].copy(), _REACH + 1, np.maximum)[::-1]
            p = np.flatnonzero((most == v) & (v != _TOP))
            p, first, last_start = _owned(p, v, least)
            if not len(p):
                continue
            begin, end = first, last_start + LENGTH
            back, ahead = p - begin, end - p
            cid = mix64(_span_hash(sums, begin, end) ^ mix64(v[p] + golden(3)) ^ (back * 1024 + ahead).astype(np.uint64) * GOLDEN)
            ids = batch.column(0).take(pa.array(a + doc[p]))
            cols = [pa.array(v[p].view(np.int64)), pa.array(cid.view(np.int64)), ids, pa.array(p - offsets[doc[p]]), pa.array(back), pa.array(ahead)]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "cid", "doc", "pos", "back", "ahead"])


ANCHORS = "h long, cid long, doc long, pos long, back long, ahead long"


def _class_bounds(back: int, ahead: int):
    """For each class the range of distances from a string's start to the anchor that fit the context."""
    step = -(-(_REACH + 1) // CLASSES)
    for c in range(CLASSES):
        lo, hi = max(c * step, LENGTH - ahead), min((c + 1) * step - 1, _REACH, back)
        if lo <= hi:
            yield c, lo, hi


def _core(lo: int, hi: int) -> tuple[int, int]:
    """Where what all strings of the class share lies in a string that covers distances lo to hi."""
    step = -(-(_REACH + 1) // CLASSES)
    c = lo // step
    return hi - c * step, LENGTH + hi - min((c + 1) * step - 1, _REACH)


def _classes(with_strings: bool):
    """Classes of contexts, from (doc, text, contexts): the hash of what all strings of the class share, and of all they cover."""

    def run(batches):
        for batch in batches:
            contexts = batch.column(2).to_pylist()
            for a, _, data, offsets in text_slices(batch.column(1)):
                sums = _sums(data)
                rows = []
                for d in range(len(offsets) - 1):
                    for x in contexts[a + d]:
                        p = int(offsets[d]) + x["pos"]
                        wanted = x["classes"] if with_strings else None
                        for c, lo, hi in _class_bounds(x["back"], x["ahead"]):
                            if wanted is None or c in wanted:
                                rows.append((x["h"], x["cid"], c, p, lo, hi))
                if not rows:
                    continue
                h, cid, c, p, lo, hi = (np.array(v, np.int64) for v in zip(*rows, strict=True))
                step = -(-(_REACH + 1) // CLASSES)
                # what all strings of the class share, the same bytes for every context of the anchor
                shared = _span_hash(sums, np.maximum(p - c * step, 0), np.minimum(p + LENGTH - np.minimum((c + 1) * step - 1, _REACH), len(data)))
                key = mix64(h.view(np.uint64) + golden(5) * (c + 1).astype(np.uint64)) ^ shared
                full = mix64(_span_hash(sums, p - hi, p + LENGTH - lo) ^ (lo * 256 + hi).astype(np.uint64) * GOLDEN)
                cols = [pa.array(mix64(key).view(np.int64)), pa.array(full.view(np.int64)), pa.array(h), pa.array(cid), pa.array(c), pa.array(lo), pa.array(hi)]
                names = ["key", "full", "h", "cid", "c", "lo", "hi"]
                if with_strings:
                    cols.append(pa.array([data[i:j].tobytes() for i, j in zip(p - hi, p + LENGTH - lo, strict=True)], pa.binary()))
                    names.append("string")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _search(batches):
    """Suffix arrays over the strings of one group after another; emits found ranges, and what split groups left open."""
    held: list[dict] = []
    size = 0

    def flush():
        nonlocal held, size
        names = sorted({(r["key"], r["part"]) for r in held})
        number = {k: i for i, k in enumerate(names)}
        cores = [_core(r["lo"], r["hi"]) for r in held]
        marks = repeated_windows([r["string"] for r in held], [number[r["key"], r["part"]] for r in held], [r["hi"] for r in held], cores)
        out = []
        settled: set[tuple[bytes, int]] = set()
        for r, m in zip(held, marks, strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], m, [False]]).astype(np.int8)))
            for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                out.append((r["h"], r["cid"], r["hi"] - y + 1, r["hi"] - x, None))
            if r["parts"] > 1:
                for o in range(len(m)):
                    digest = hashlib.blake2b(r["string"][o : o + LENGTH], digest_size=16).digest()
                    if not m[o]:
                        out.append((r["h"], r["cid"], r["hi"] - o, r["hi"] - o, digest))
                    elif (digest, o) not in settled:  # once for all that are found here, for other parts
                        settled.add((digest, o))
                        out.append((None, None, r["hi"] - o, r["hi"] - o, digest))
        held, size = [], 0
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.binary())], names=["h", "cid", "lo", "hi", "open"])

    for batch in batches:
        for r in batch.to_pylist():
            if held and size >= CHUNK and (r["key"], r["part"]) != (held[-1]["key"], held[-1]["part"]):
                yield flush()
            held.append(r)
            a, b = _core(r["lo"], r["hi"])
            size += len(r["string"]) - (b - a) + 1
    if held:
        yield flush()


def _runs(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs that spans of documents cover, in order: the document's number, and first and past-the-end byte."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, shift = doc[order], doc[order] * (int(b.max()) + 1)
    begin, end = a[order] + shift, np.maximum.accumulate(b[order] + shift)
    first = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], begin[first] - shift[first], end[last] - shift[last]


def _removed(batches):
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        lists = batch.column(2)
        spans = pc.list_flatten(lists)
        doc, a, b = _runs(*(np.asarray(x).astype(np.int64) for x in (pc.list_parent_indices(lists), pc.struct_field(spans, "a"), pc.struct_field(spans, "b"))))
        sizes = np.array([len(t) for t in texts], np.int64)
        removed = np.zeros(len(texts), np.int64)
        np.add.at(removed, doc, b - a)
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        begins, ends, digests = a.tolist(), b.tolist(), []
        for text, x, y in zip(texts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            kept = b"".join([text[i:j] for i, j in zip([0, *ends[x:y]], [*begins[x:y], len(text)], strict=True)]) if y > x else text
            digests.append(hashlib.sha256(kept).hexdigest())
        pairs = pa.ListArray.from_arrays(pa.array(2 * np.arange(len(a) + 1), pa.int32()), pa.array(np.stack([a, b], axis=1).ravel(), pa.int64()))
        runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(removed), runs, pa.array(digests, pa.string())], names=["id", "n_bytes", "n_removed", "runs", "kept_sha256"])


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(doc, a, b): byte ranges of strings of LENGTH bytes that start twice or more in rows (doc, text); ranges may overlap.

    Anchors whose gram stands once hold no repeated string. Anchors with the same bytes all around are one context; one
    that occurs twice is repeated all over. Contexts of a gram that differ are cut into classes of strings by their
    distance to the anchor; equal classes again are one, and what differs inside a class goes into suffix
    arrays of at most GROUP strings. Contexts and classes are told apart by two hashes of 64 bits, one of the gram
    and one of all their bytes. Strings of a larger group that its parts leave open are counted over all parts.
    """
    anchors = materialize(rows.where(F.octet_length("text") >= LENGTH).mapInArrow(_anchors, ANCHORS), "anchors")
    often = materialize(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "often")
    anchors = materialize(anchors.join(often, "h"), "repeated")
    contexts = anchors.groupBy("h", "cid").agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos", "back", "ahead")).alias("one"))
    contexts = materialize(contexts.select("h", "cid", "n", "one.*"), "contexts")
    several = materialize(contexts.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h"), "several")
    found = [contexts.where("n > 1").select("h", "cid", (F.lit(LENGTH) - F.col("ahead")).alias("lo"), F.col("back").alias("hi"))]

    open_contexts = materialize(contexts.join(several, "h"), "open")
    by_doc = open_contexts.groupBy("doc").agg(F.collect_list(F.struct("h", "cid", "pos", "back", "ahead")).alias("contexts"))
    classes = rows.join(by_doc, "doc").select("doc", "text", "contexts").mapInArrow(_classes(False), "key long, full long, h long, cid long, c long, lo long, hi long")
    classes = materialize(classes, "classes")
    kinds = classes.groupBy("key", "full").agg(F.count("*").alias("n"), F.min(F.struct("h", "cid", "c")).alias("one"))
    kinds = materialize(kinds.select("key", "full", "n", "one.*"), "kinds")
    found.append(classes.join(kinds.where("n > 1").select("key", "full"), ["key", "full"]).select("h", "cid", "lo", "hi"))
    mixed = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = materialize(mixed, "mixed")
    parts = F.ceil(F.col("kinds") / GROUP)
    wanted = kinds.join(mixed, "key").select("key", "full", "h", "cid", "c", parts.alias("parts"), F.pmod(F.xxhash64("full"), parts).alias("part"))
    wanted = materialize(wanted, "wanted")
    picks = open_contexts.join(wanted.groupBy("h", "cid").agg(F.collect_set("c").alias("classes")), ["h", "cid"])
    by_doc = picks.groupBy("doc").agg(F.collect_list(F.struct("h", "cid", "pos", "back", "ahead", "classes")).alias("contexts"))
    strings = rows.join(by_doc, "doc").select("doc", "text", "contexts").mapInArrow(_classes(True), "key long, full long, h long, cid long, c long, lo long, hi long, string binary")
    strings = strings.join(wanted.select("h", "cid", "c", "parts", "part"), ["h", "cid", "c"]).select("key", "part", "parts", "full", "h", "cid", "lo", "hi", "string")
    dealt = strings.repartition("key", "part").sortWithinPartitions("key", "part", "full")
    searched = materialize(dealt.mapInArrow(_search, "h long, cid long, lo long, hi long, open binary"), "searched")
    ranges = searched.where("open is null").select("h", "cid", "lo", "hi")
    left = searched.where("open is not null")
    again = materialize(left.groupBy("open", "lo").agg(F.count("*").alias("n")).where("n > 1").select("open", "lo"), "again")
    single = ranges.union(left.where("cid is not null").join(again, ["open", "lo"]).select("h", "cid", "lo", "hi"))
    single = materialize(single.groupBy("h", "cid").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "single")
    found.append(single.select("h", "cid", F.inline("ranges")))
    ranges = materialize(found[0].union(found[1]).union(found[2]).groupBy("h", "cid").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "ranges")
    spans = anchors.select("h", "cid", "doc", "pos").join(ranges, ["h", "cid"]).select("doc", "pos", F.inline("ranges"))
    return spans.select("doc", (F.col("pos") - F.col("hi")).alias("a"), (F.col("pos") - F.col("lo") + LENGTH).alias("b"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, runs, kept_sha256): what is left of each text without the bytes that repeated strings of LENGTH bytes cover.

    Texts are UTF-8 bytes, null is empty, strings never cross texts; a string is repeated where it starts at
    another place of any text of the table, its own included. Repeated rows repeat each other; ids may be null;
    shorter texts lose nothing; an empty table gives no rows.
    """
    doc = F.xxhash64(F.col(id_col), F.isnull(id_col), F.col(text_col))
    rows = docs.select(doc.alias("doc"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession):
        spans = repeated_spans(rows).groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
        spans = materialize(spans, "spans", keep=True)
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), doc.alias("doc"))
    return whole.join(spans, "doc", "left").select("id", "text", "spans").mapInArrow(_removed, "id long, n_bytes long, n_removed long, runs array<array<long>>, kept_sha256 string")
