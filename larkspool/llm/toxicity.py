"""Toxicity by maximum-scoring segments of token log-odds, with extreme-value calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_LETTER, free_name, in_sample, materialize, sample_key, sized, text_slices, word_hashes

#: Labelled texts of each class that the model is fitted on, about.
SAMPLE = 8000
#: Weight of the Dirichlet prior, shaped like all words of the sample, as a share of the sample's words.
PRIOR = 0.01
#: A word's log-odds count where the signed root of its likelihood-ratio statistic reaches this.
SIGNIFICANT = 4.2
#: Largest score of one word.
MOST = 6.0


@dataclass(frozen=True)
class SegmentModel:
    words: np.ndarray  # sorted hashes of words that score above 0
    scores: np.ndarray
    other: float  # score of any other word, below 0
    k: float  # extreme-value law of the clean class: k * n * exp(-decay * score) segments of that score in n words
    decay: float
    intercept: float
    slope: float


def segments(at: np.ndarray, scores: np.ndarray, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa 1999) of a text whose words score ``other`` < 0, but for
    those at the given places: (first place, last place, score).

    Each candidate links to the nearest one before it with a smaller sum before, so the search for a partner
    passes over each candidate once and the scan is linear in those places.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, link
    total, previous = 0.0, -1
    for p, s in zip(at.tolist(), scores.tolist(), strict=True):
        total += other * (p - previous - 1)
        first, before = p, total
        total += s
        previous = p
        j = len(stack) - 1
        while j >= 0:
            if stack[j][2] >= before:
                j = stack[j][4]
            elif stack[j][3] >= total:
                break
            else:  # one segment from there on; its own link leads on
                first, _, before, _, link = stack[j]
                del stack[j:]
                j = link
        stack.append((first, p, before, total, j))
    return [(a, b, hi - lo) for a, b, lo, hi, _ in stack]


def _evidence(model: SegmentModel, data: np.ndarray, offsets: np.ndarray):
    """For each text its evidence and its significant segments (first byte, last byte + 1, score, p)."""
    h, doc, starts, ends = word_hashes(data, offsets, apart=NO_LETTER)
    n_docs = len(offsets) - 1
    place = np.searchsorted(model.words, h)
    hit = np.zeros(len(h), bool)
    if len(model.words):
        place[place == len(model.words)] = 0
        hit = model.words[place] == h
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    at = np.flatnonzero(hit)
    own = doc[at]
    evidence = np.zeros(n_docs)
    spans: list[list[tuple[int, int, float, float]]] = [[] for _ in range(n_docs)]
    for d in np.unique(own).tolist():
        mine = at[own == d] if len(at) < 64 else at[np.searchsorted(own, d) : np.searchsorted(own, d, "right")]
        base, n = first[d], first[d + 1] - first[d]
        noise = np.log(model.k * n)
        for a, b, score in segments(mine - base, model.scores[place[mine]], model.other):
            p = float(-np.expm1(-np.exp(min(50.0, noise - model.decay * score))))
            if p <= 0.05:
                evidence[d] += model.decay * score - max(0.0, noise)
                spans[d].append((int(starts[base + a] - offsets[d]), int(ends[base + b] - offsets[d]), score, p))
    return evidence, spans


def _scored(shared, n_keep: int, with_spans: bool):
    def run(batches):
        m: SegmentModel = shared.value
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(0)):
                evidence, spans = _evidence(m, data, offsets)
                x = np.log1p(np.maximum(0.0, evidence))
                score = 1.0 / (1.0 + np.exp(-(m.intercept + m.slope * x)))
                cols = [pa.array(score), pa.array(evidence)]
                if with_spans:
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p", pa.float64())]))
                    cols.append(pa.array([[dict(zip(("start", "end", "score", "p"), s, strict=True)) for s in own] for own in spans], kind))
                names = ["toxicity", "evidence", "passages"][: len(cols)]
                yield pa.RecordBatch.from_arrays([*cols, *[batch.column(1 + i).slice(a, b - a) for i in range(n_keep)]], names=[*names, *batch.schema.names[1:]])

    return run


def _words(batches):
    """Hashes of words with the number of toxic and of clean texts that hold them, from one run of texts."""
    for batch in batches:
        for a, b, data, offsets in text_slices(batch.column(0)):
            h, doc, _, _ = word_hashes(data, offsets, apart=NO_LETTER)
            labels = np.array(batch.column(1).slice(a, b - a).to_pylist(), np.int64)
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            words, label = h[new], labels[doc[new]]
            keys, inverse = np.unique(words, return_inverse=True)
            toxic = np.bincount(inverse, weights=label, minlength=len(keys)).astype(np.int64)
            count = np.bincount(inverse, minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(toxic), pa.array(count - toxic)], names=["word", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> SegmentModel:
    """A model from labelled texts; labels holds id and 0 or 1, its other values, nulls and unknown ids are left out.

    About SAMPLE labelled rows of each class are used, those whose hashed id is smallest in share; equal texts
    of them count once. A word counts once a text. Word log-odds of the two classes are smoothed by a
    Dirichlet prior in the shape of both together; words that are significantly likelier in toxic texts keep
    their log-odds, all others share the log-odds of the rest. The sample's ids, the significant words and one
    number per sampled text reach the driver. Without both classes the model scores every text alike.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    totals = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    key = sample_key("id", F.lit(5))
    bound = F.when(F.col("y") == 1, F.lit(totals.get(1, 0))).otherwise(F.lit(totals.get(0, 0)))
    chosen = materialize(known.where(in_sample(key, bound, SAMPLE)), "chosen")
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = text.join(sized(chosen, chosen.count()), "id").groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.first("text").alias("text"), F.max("y").alias("y"))
    sample = materialize(sample.select("text", "y"), "sample")
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    flat = float(np.log((share + 1e-6) / (1 - share + 1e-6))) if totals else -5.0
    empty = SegmentModel(np.zeros(0, np.uint64), np.zeros(0), -1.0, 1e-9, 1.0, flat, 0.0)
    if not (totals.get(0) and totals.get(1)):
        return empty
    counts = sample.mapInArrow(_words, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = materialize(counts, "words")
    n_toxic, n_clean = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not n_toxic or not n_clean:
        return empty
    n_all = n_toxic + n_clean
    mass = max(1.0, PRIOR * n_all)
    prior = (F.col("toxic") + F.col("clean")) * F.lit(mass / n_all)
    yt, yc = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(yt / (F.lit(n_toxic + mass) - yt)) - F.log(yc / (F.lit(n_clean + mass) - yc))
    expected = (F.col("toxic") + F.col("clean")) * F.lit(n_toxic / n_all)
    rest = (F.col("toxic") + F.col("clean")) * F.lit(n_clean / n_all)
    ratio = 2 * (F.col("toxic") * F.log(F.col("toxic") / expected) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / rest)).otherwise(0.0))
    rated = counts.where("toxic > 0").select("word", odds.alias("s"), F.sqrt(F.greatest(ratio, F.lit(0.0))).alias("root"), (yt / F.lit(n_toxic + mass)).alias("pt"), (yc / F.lit(n_clean + mass)).alias("pc"))
    picked = rated.where((F.col("root") >= SIGNIFICANT) & (F.col("s") > 0.5)).collect()
    if not picked:
        return empty
    words = np.array([r[0] for r in picked], np.int64).view(np.uint64)
    order = np.argsort(words)
    scores = np.minimum(MOST, np.array([r[1] for r in picked]))[order]
    other = min(-1e-4, float(np.log((1 - min(0.99, sum(r[3] for r in picked))) / (1 - min(0.98, sum(r[4] for r in picked))))))
    model = SegmentModel(words[order], scores, other, 1e-9, 1.0, flat, 0.0)
    seen = sample.mapInArrow(_largest(model), "y int, n long, top double").where("y = 0 and n > 0").collect()
    k, decay = _extremes(np.array([r[1] for r in seen], float), np.array([r[2] for r in seen], float))
    model = SegmentModel(words[order], scores, other, k, decay, flat, 0.0)
    shared = spark.sparkContext.broadcast(model)
    fitted = sample.mapInArrow(_scored(shared, 1, False), "toxicity double, evidence double, y int").select("evidence", "y").collect()
    x = np.log1p(np.maximum(0.0, np.array([r[0] for r in fitted])))
    y = np.array([r[1] for r in fitted], float)
    weight = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    a, b = _logistic(x, y, weight)
    return SegmentModel(words[order], scores, other, k, decay, a, max(0.0, b))


def _extremes(n: np.ndarray, top: np.ndarray) -> tuple[float, float]:
    """Scale and decay of the law of clean texts' largest segments, from their words and largest scores.

    Scores above a level fall off exponentially: their mean excess over it is 1 / decay. How many texts exceed
    the level gives the scale. Log-odds decay by 1 in theory; too few large scores leave it at that.
    """
    level = 1.0
    over = top[top >= level]
    decay = float(np.clip(1 / max(1e-9, (over - level).mean()), 0.5, 2.0)) if len(over) >= 30 else 1.0
    return max(len(over), 1) * float(np.exp(decay * level)) / max(1.0, float(n.sum())), decay


def _largest(model: SegmentModel):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(0)):
                h, doc, _, _ = word_hashes(data, offsets, apart=NO_LETTER)
                n_docs = len(offsets) - 1
                place = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
                hit = np.flatnonzero(model.words[place] == h)
                first = np.searchsorted(doc, np.arange(n_docs + 1))
                top = np.zeros(n_docs)
                for d in np.unique(doc[hit]).tolist():
                    mine = hit[doc[hit] == d]
                    top[d] = max(s for _, _, s in segments(mine - first[d], model.scores[place[mine]], model.other))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(np.diff(first)), pa.array(top)], names=["y", "n", "top"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one feature by Newton steps, lightly drawn to 0."""
    m = np.stack([np.ones_like(x), x], axis=1)
    beta = np.zeros(2)
    weight = weight / weight.mean()
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(m @ beta, -30, 30)))
        grad = m.T @ (weight * (y - p)) - 1e-2 * beta
        hess = (m * (weight * p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def score(docs: DataFrame, model: SegmentModel, text_col: str = "text", with_passages: bool = True) -> DataFrame:
    """docs with toxicity (0 to 1), evidence and, if asked for, passages: start and end byte, score and p of every
    segment that a clean text of this length holds with a chance of at most 5 %.

    Words are runs of letters, ASCII ones in lower case. Evidence sums the significant segments' scores above the noise of
    the text's length; a logistic curve turns it into the chance of label 1. Null and empty texts and texts without words have no evidence. Columns of docs that bear one of the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["toxicity", "evidence", *(["passages"] if with_passages else [])]
    kept = [c for c in docs.columns if c not in added]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = "toxicity double, evidence double, " + ("passages array<struct<start:long,end:long,score:double,p:double>>, " if with_passages else "") + ", ".join(f"`{c}` {types[c]}" for c in kept)
    rows = docs.select(F.col(text_col).alias(free_name("_text", kept)), *kept)
    return rows.mapInArrow(_scored(shared, len(kept), with_passages), schema).select(*kept, *added)
