"""Near duplicates by SuperMinHash signatures, banding, verification on full sets and union-find grouping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, golden, materialize, mix64, scratch, shingle_sets, text_slices
from .groups import components

#: 32 bands of 5 registers: a pair at similarity 0.8 shares none with probability 3e-6.
BANDS, ROWS = 32, 5
_LOW = np.uint64(0xFFFFFFFF)
_SHIFT = np.uint64(32)


def superminhash(elements: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (Ertl 2017): an (n_docs, m) array of unsigned 64-bit registers.

    elements are the hashes of the sets' members and doc the number of the set each belongs to. In step j every
    element draws a number in [j, j + 1) for the j-th place of its own random permutation of the registers; a
    register keeps its smallest number. A set stops as soon as all its registers are below j + 1, since later
    steps can't lower them: all elements advance together, so this is the early stop of the published method.
    Empty sets keep the largest number everywhere.
    """
    h = np.full(n_docs * m, np.iinfo(np.uint64).max, np.uint64)
    slots = None  # each remaining element's permutation so far
    pending = np.unique(doc)
    for j in range(m):
        u = mix64(elements + golden(j + 1))
        k = j + (((u >> _SHIFT) * np.uint64(m - j)) >> _SHIFT).astype(np.int64)
        if slots is None:
            at = k
        else:
            rows = np.arange(len(k))
            at = slots[rows, k].astype(np.int64)
            slots[rows, k] = slots[:, j]
        np.minimum.at(h, doc * m + at, (np.uint64(j) << _SHIFT) | (u & _LOW))
        done = h.reshape(n_docs, m)[pending].max(axis=1) < (np.uint64(j + 1) << _SHIFT)
        if done.all():
            break
        live = np.zeros(n_docs, bool)
        live[pending[~done]] = True
        pending = pending[~done]
        keep = live[doc]
        if slots is None:
            kept = k[keep]
            slots = np.tile(np.arange(m, dtype=np.uint16), (len(kept), 1))
            slots[np.arange(len(kept)), kept] = 0
        else:
            slots = slots[keep]
        elements, doc = elements[keep], doc[keep]
    return h.reshape(n_docs, m)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _profile(k: int):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1), 1 << 19):
                sets = shingle_sets(data, offsets, k)
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets)
                doc = np.repeat(np.arange(len(sets)), sizes)
                sums = []
                for seed in (1, 2):  # order-free 128-bit fingerprint of the set
                    total = np.zeros(len(flat) + 1, np.uint64)
                    np.cumsum(mix64(flat ^ (golden(seed))), out=total[1:])
                    ends = np.cumsum(sizes)
                    sums.append(total[ends] - total[ends - sizes])
                registers = superminhash(flat, doc, len(sets), BANDS * ROWS).reshape(len(sets), BANDS, ROWS)
                bands = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(sets), axis=0)
                for r in range(ROWS):
                    bands = mix64(bands * GOLDEN + registers[:, :, r])
                lists = pa.ListArray.from_arrays(np.arange(0, BANDS * len(sets) + 1, BANDS, dtype=np.int32), _signed(bands.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(sizes), pa.array(_signed(sums[0])), pa.array(_signed(sums[1])), lists],
                    names=["id", "n", "f1", "f2", "bands"],
                )

    return run


def _full_sets(k: int):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(data, offsets, k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(sets, pa.binary())], names=["id", "members"])

    return run


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs with an id.

    A text's set holds its distinct shingles of that many words (ASCII letters lower-cased, words
    ``[^\\x20\\x09-\\x0D]+``); fewer words make one shingle of the whole sequence. Texts are linked where 100 *
    intersection >= percent * union; component_id is the smallest id reachable over links.

    Equal sets are one class, stood for by its smallest id; only classes are banded. Bands propose each member
    with the first id of its bucket; proposals are confirmed on the full sets, the most promising of each
    member first, and grouped. Where a bucket still holds several groups, every pair across them is confirmed
    as well, so no proposal is lost to the size of a bucket and none is made inside a settled group.

    Null and empty texts and texts without words have the empty set, are linked with nothing and are their own
    component. Null ids are left out. Repeated ids count as one document per distinct set. An empty table gives
    no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    profile = materialize(rows.mapInArrow(_profile(shingle), "id long, n long, f1 long, f2 long, bands array<long>"), "profile")
    named = _components_of_sets(rows, profile.where("n > 0"), shingle, percent)
    return profile.select("id", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _components_of_sets(rows: DataFrame, filled: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(f1, f2, n, component) of every distinct set."""
    with scratch(rows.sparkSession):
        classes = materialize(filled.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("bands").alias("bands")), "classes")
        buckets = classes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
        full = buckets.groupBy("band", "key").agg(F.min("rep").alias("leader"), F.min_by("n", "rep").alias("leader_n"), F.count("*").alias("size")).where("size > 1")
        full = materialize(full, "buckets")
        members = materialize(buckets.join(full, ["band", "key"]), "members")

        def close(x: str, y: str):
            return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)

        proposals = members.where((F.col("leader") != F.col("rep")) & close("n", "leader_n"))
        proposals = materialize(proposals.groupBy(F.col("leader").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("shared")), "proposals")
        best = proposals.groupBy("b").agg(F.max(F.struct(F.col("shared"), -F.col("a"))).alias("best")).select((-F.col("best.col2")).alias("a"), "b")
        best = materialize(best, "pairs")
        links = _confirm(rows, best, shingle, percent)
        group = components(links)

        rest = proposals.select("a", "b").join(best.select("a", "b"), ["a", "b"], "left_anti")
        rest = materialize(_across(rest, group), "pairs")
        links = materialize(links.union(_confirm(rows, rest, shingle, percent)), "links")
        group = components(links)

        tried = best.union(rest)
        labelled = materialize(_labelled(members.select("band", "key", "rep", "n"), group), "labelled")
        spread = labelled.groupBy("band", "key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("band", "key")
        mixed = materialize(labelled.join(materialize(spread, "spread"), ["band", "key"]), "mixed")
        open_rows = mixed.groupBy(F.col("rep").alias("id"), "g").agg(F.count("*").alias("n_buckets")).drop("n_buckets")
        across = materialize(_prefix_pairs(rows, open_rows, shingle, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
        links = links.union(_confirm(rows, across, shingle, percent))
        group = components(links)

        named = classes.select("f1", "f2", "n", "rep").join(group.withColumnRenamed("node", "rep"), "rep", "left")
        return materialize(named.select("f1", "f2", "n", F.coalesce("component", "rep").alias("component")), "named", keep=True)


def _labelled(df: DataFrame, group: DataFrame) -> DataFrame:
    return df.join(group.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("g", F.coalesce("component", "rep")).drop("component")


def _across(pairs: DataFrame, group: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different groups."""
    for end in ("a", "b"):
        pairs = pairs.join(group.select(F.col("node").alias(end), F.col("component").alias(f"g{end}")), end, "left")
    return pairs.where(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select("a", "b")


def _confirm(rows: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full sets, made anew from the whole texts of both ends, meet the threshold."""
    with scratch(rows.sparkSession):
        wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
        sets = rows.join(wanted, "id", "left_semi").mapInArrow(_full_sets(shingle), "id long, members binary")
        sets = materialize(sets, "sets")
        both = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
        both = both.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").select("a", "b", "x", "y")
        return materialize(both.mapInArrow(_confirmed(percent), "a long, b long"), "confirmed", keep=True)


def _prefix_pairs(rows: DataFrame, open_rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b), a < b: pairs of open_rows (id, g) of different g that may meet the threshold; none that does is missing.

    Each set is put in order of how few of the sets hold a member. Two sets that share enough have a common
    member among their first n - percent / 100 * n + 1, and where that member stands bounds what they can share
    behind it (prefix and position filters of exact set joins). Members of one set alone only take up places.
    """
    open_rows = materialize(open_rows, "open")
    sets = rows.join(open_rows, "id").select("id", "text", "g").mapInArrow(_open_sets(shingle), "id long, g long, members array<long>")
    sets = materialize(sets, "open_sets")
    each = sets.select("id", "g", F.size("members").alias("n"), F.explode("members").alias("member"))
    often = materialize(each.groupBy("member").agg(F.count("*").alias("often")).where("often > 1"), "often")
    ranked = each.join(often, "member").groupBy("id", "g", "n").agg(F.sort_array(F.collect_list(F.struct("often", "member"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    prefix = ranked.where(length > 0).select("id", "g", "n", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), length.cast("int"))).alias("p", "s"))
    prefix = materialize(prefix.select("id", "g", "n", (F.col("p") + F.col("alone")).alias("at"), F.col("s.member").alias("member")), "prefix")
    left = prefix.select("member", F.col("id").alias("a"), F.col("g").alias("ag"), F.col("n").alias("an"), F.col("at").alias("aa"))
    right = prefix.select("member", F.col("id").alias("b"), F.col("g").alias("bg"), F.col("n").alias("bn"), F.col("at").alias("ba"))
    reach = F.least(F.col("an") - F.col("aa"), F.col("bn") - F.col("ba"))
    fits = (F.col("a") < F.col("b")) & (F.col("ag") != F.col("bg")) & (reach * (100 + percent) >= percent * (F.col("an") + F.col("bn")))
    return left.join(right, "member").where(fits).groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b")


def _open_sets(k: int):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                sets = shingle_sets(data, offsets, k)
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, _signed(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), batch.column(2).slice(a, b - a), lists], names=["id", "g", "members"])

    return run
