"""Ranked lexical search by TPUT: heads of the postings lists, one threshold for all lists of a query, exact lookups.

Lists are partitioned by term and sorted by the score their entries add (a BM25 of whole numbers). Round one takes the
k highest entries of each list and sums up what their documents have in all lists of a query: the k-th best sum is a floor
that an answer must reach. Round two fetches every entry of at least floor / (PARTS x lists), the same for all lists of a
query. A document with none of them stays below floor / PARTS; one with some is left only if they and the most that
its unseen lists could add reach the floor. Round three looks those missing entries up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, free_name, materialize, sized, text_slices, word_hashes

#: Terms: ASCII letters and digits and all other characters; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The threshold of a query's lists is its floor over so many times their number. At 1 a single entry above it may make an
#: answer, at 4 what is seen of a document must reach three quarters of the floor, so far fewer are looked up.
PARTS = 4
_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Postings:
    """lists: term (a number), row, id, score (what the entry adds for one occurrence in a query). terms: term, word."""

    lists: DataFrame
    terms: DataFrame
    n_terms: int


def words(text: Column) -> Column:
    """Terms of a text in order."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), 0)


class _Vocabulary:
    """Terms by hash, for finding those of a text. Equal hashes are confirmed by bytes."""

    def __init__(self, numbers: list[int], terms: list[str]):
        raw = [t.encode() for t in terms]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        hashes = word_hashes(data, offsets, apart=_APART)[0] if raw else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], np.array(numbers, np.int64)[order]
        self.starts, self.sizes, self.data = offsets[:-1][order], np.diff(offsets)[order], data

    def distinct(self) -> bool:
        return len(np.unique(self.hashes)) == len(self.hashes)

    def find(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are terms, and the numbers of those. data is lower-cased."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == h) & (self.sizes[at] == ends - starts))
        at, sizes = at[hit], self.sizes[at[hit]]
        ahead = np.cumsum(sizes) - sizes
        step = np.arange(int(sizes.sum()))
        same = data[step + np.repeat(starts[hit] - ahead, sizes)] == self.data[step + np.repeat(self.starts[at] - ahead, sizes)]
        good = np.logical_and.reduceat(same, ahead) if len(hit) else np.zeros(0, bool)
        return hit[good], self.numbers[at[good]]


_COUNTS = "term long, word string, row long, id long, tf long, n long"


def _counter(known):
    """Entries of each text: term (by known) or word, the text's row and id, occurrences, and the text's terms in all.

    Each run of texts adds an entry without term or word: how many of them have terms (tf), and their terms (n).
    """

    def run(batches):
        from pyspark import TaskContext

        from .common import LOWER

        row = TaskContext.get().partitionId() << 33
        vocabulary = None if known is None else _Vocabulary(*known.value)
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(0), np.int64)
            missing = np.asarray(batch.column(0).is_null())
            for first, last, data, offsets in text_slices(batch.column(1)):
                h, doc, starts, ends = word_hashes(data, offsets, apart=_APART)
                n = np.bincount(doc, minlength=last - first)
                low = LOWER[data]
                if vocabulary is not None:
                    hit, number = vocabulary.find(h, low, starts, ends)
                    word = None
                    order = np.lexsort((number, doc[hit]))
                    d, number = doc[hit][order], number[order]
                    new = np.append(True, (d[1:] != d[:-1]) | (number[1:] != number[:-1])) if len(d) else np.zeros(0, bool)
                else:
                    # words themselves: equal bytes, not only equal hashes, make one entry
                    texts = [low[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
                    word, number = np.unique(np.array(texts, object), return_inverse=True) if texts else (np.zeros(0, object), np.zeros(0, np.int64))
                    order = np.lexsort((number, doc))
                    d, number = doc[order], number[order]
                    new = np.append(True, (d[1:] != d[:-1]) | (number[1:] != number[:-1])) if len(d) else np.zeros(0, bool)
                at = np.flatnonzero(new)
                tf = np.diff(np.append(at, len(d)))
                d, number = d[at], number[at]
                rows, gone = row + d, missing[first + d]
                term = pa.array(number, pa.int64()) if word is None else pa.nulls(len(at), pa.int64())
                named = pa.nulls(len(at), pa.string()) if word is None else pa.array([w.decode() for w in word[number]], pa.string())
                yield pa.RecordBatch.from_arrays([term, named, pa.array(rows), pa.array(ids[first + d], mask=gone), pa.array(tf, pa.int64()), pa.array(n[d], pa.int64())], names=_COUNT_NAMES)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=_COUNT_NAMES)
                row += last - first

    return run


_COUNT_NAMES = [c.split()[0] for c in _COUNTS.split(", ")]


def build(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Postings:
    """Postings of the given terms (term, word, each word once) in all whole texts.

    Texts are read once. Up to BROADCAST_ROWS terms go to the tasks, which keep entries of those alone; with more, all
    entries are made and joined to the terms. Null texts have no terms. Each row is a document, repeated ids or not.
    """
    spark = docs.sparkSession
    n_terms, known = terms.count(), None
    if n_terms <= BROADCAST_ROWS:
        pairs = [(r.term, r.word) for r in terms.select("term", "word").collect()]
        known = [p[0] for p in pairs], [p[1] for p in pairs]
        known = spark.sparkContext.broadcast(known) if _Vocabulary(*known).distinct() else None
    counts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_counter(known), _COUNTS)
    counts = materialize(counts, "counts")
    total = counts.where("row is null").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    entries = counts.where("row is not null").select("term", "word", "row", "id", "tf", "n")
    if known is None:
        entries = entries.drop("term").join(sized(terms, n_terms), "word")
    entries = entries.select("term", "row", "id", "tf", "n")
    weight = F.floor(1000 * F.log((F.lit(2.0 * total.docs) + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
    weights = entries.groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("weight"))
    length = F.lit(100 - 75) + F.expr(f"(75 * n * {total.docs}L) div {max(1, total.terms)}L")
    entries = entries.join(sized(weights, n_terms), "term").withColumn("length", length)
    score = F.col("weight") * F.expr("(1000000000L * tf) div (1000 * tf + 8 * length)")
    scored = entries.select("term", "row", "id", score.alias("score"))
    # one list after another, its highest entries first: long lists lie in several parts
    order = [F.col("term"), F.col("score").desc()]
    lists = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    return Postings(materialize(lists, "postings"), terms, n_terms)


def _kth(df: DataFrame, value: str, k: int) -> DataFrame:
    """(q, floor): the k-th highest value of each q, 0 where there are fewer."""
    best = df.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(value)))).where(F.col("_n") <= k)
    return best.groupBy("q").agg(F.when(F.count("*") == k, F.min(value)).otherwise(F.lit(0).cast("long")).alias("floor"))


def tput(postings: Postings, wanted: DataFrame, k: int) -> DataFrame:
    """(q, rank, id, score) of the k highest sums above 0 of each q. wanted: q, term, times; equal sums go by id, null last."""
    lists, n = postings.lists, wanted.count()
    # Round one: the heads of all lists.
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "row"))
    heads = materialize(lists.withColumn("_n", place).where(F.col("_n") <= k).drop("_n"), "heads")
    asked = wanted.join(sized(heads.groupBy("term").agg(F.max("score").alias("most")), postings.n_terms), "term")
    met = materialize(sized(wanted, n).join(heads, "term").select("q", "row").distinct(), "met")
    # What stands in a head is summed over all lists: a floor that is reached, and higher than the heads alone give.
    rows = met.select("row").distinct()
    whole = lists.join(sized(rows, rows.count()), "row", "left_semi").select("row", "term", "score")
    sums = whole.join(met, "row").join(sized(wanted, n), ["q", "term"]).groupBy("q", "row").agg(F.sum(F.col("times") * F.col("score")).alias("low"))
    first = _kth(sums, "low", k)
    # One threshold for all lists of a query: a share of the floor over their number, rounded up for the entries of each.
    share = F.greatest(F.lit(0).cast("long"), F.expr(f"(floor + times * lists * {PARTS} - 1) div (times * lists * {PARTS})"))
    sizes = asked.groupBy("q").agg(F.count("*").alias("lists"))
    asked = asked.join(sizes, "q").join(first, "q").select("q", "term", "times", share.alias("least"), "most")
    asked = materialize(asked.withColumn("unseen", F.col("times") * F.least(F.col("most"), F.greatest(F.lit(0).cast("long"), F.col("least") - 1))), "asked")
    # Round two: every entry from the threshold on, by the least threshold of its list first, then by each query's own. Entries
    # travel once, by their row, and meet the queries there; what can't reach the floor even with all unseen lists ends there.
    lowest = asked.groupBy("term").agg(F.min("least").alias("lowest"))
    high = lists.join(sized(lowest, postings.n_terms), "term").where(F.col("score") >= F.col("lowest")).drop("lowest").repartition("row")
    seen = high.join(sized(asked, n), "term").where(F.col("score") >= F.col("least"))
    added = F.col("times") * F.col("score")
    found = seen.groupBy("q", "row").agg(F.min("id").alias("id"), F.sum(added).alias("low"), F.sum(added - F.col("unseen")).alias("gain"))
    bounds = materialize(asked.groupBy("q").agg(F.sum("unseen").alias("all_unseen")).join(first, "q"), "bounds")
    able = F.col("all_unseen") + F.col("gain") >= F.col("floor")
    found = materialize(found.join(sized(bounds, n), "q").where(able).select("q", "row", "id", "low", "gain"), "candidates")
    second = bounds.join(_kth(found, "low", k).withColumnRenamed("floor", "_floor"), "q").withColumn("floor", F.greatest("floor", "_floor"))
    left = materialize(found.join(sized(second, n), "q").where(able).select("q", "row", "id", "low"), "left")
    # Round three: the entries below the threshold of those that may still be among the k.
    rows = left.select("row").distinct()
    missing = left.join(sized(asked, n), "q").select("q", "row", "term", "times", "least")
    below = lists.join(sized(rows, rows.count()), "row", "left_semi").select("row", "term", "score").join(missing, ["row", "term"]).where(F.col("score") < F.col("least"))
    more = below.groupBy("q", "row").agg(F.sum(added).alias("more"))
    exact = left.join(more, ["q", "row"], "left").select("q", "row", "id", (F.col("low") + F.coalesce("more", F.lit(0).cast("long"))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row"))
    return exact.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k).select("q", "rank", "id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """The k best documents of each row of queries: (query_id, rank, id_col, score), rank from 1, equal scores by id (null last).

    A score sums what each term of the query adds, repeats included; documents and queries without terms in common
    don't appear. Every row of queries and of docs counts for itself, repeated or without an id. Very long texts are
    cut into terms whole by one task; other columns are ignored; empty tables give no rows.
    """
    asked = materialize(queries.select(F.col(query_id).alias("item"), F.col(query_text).alias("text")).withColumn("q", F.monotonically_increasing_id()), "queries")
    wanted = asked.select("q", F.explode(words(F.col("text"))).alias("word")).groupBy("q", "word").agg(F.count("*").alias("times"))
    terms = materialize(wanted.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
    postings = build(docs, terms, id_col, text_col)
    wanted = materialize(wanted.join(sized(terms, postings.n_terms), "word").select("q", "term", "times"), "wanted")
    name = free_name(id_col, [query_id, "rank", "score"])
    return tput(postings, wanted, k).join(asked.select("q", "item"), "q").select(F.col("item").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(name), "score")
