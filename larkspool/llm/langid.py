"""Language identification by nearest centroid of normalised TF-IDF n-gram vectors, with rejection by distance."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, LOWER, NO_LETTER, free_name, in_sample, materialize, sample_key, sized, text_slices

DIMS_BITS = 12
DIMS = 1 << DIMS_BITS
#: Labelled texts of each language that the centroids are fitted on, about; counts of n-grams cover all texts.
SAMPLE = 400
CENTROIDS = 3
#: A text is rejected by what texts of as many distinct n-grams reach: below MARGIN of the way from random words (all but
#: this quantile of them) up to this quantile of labelled texts of its language. Bands are powers of two; excerpts of
#: EXCERPTS letters of the fitted texts fill them.
REJECT_QUANTILE, MARGIN = 0.005, 1 / 3
EXCERPTS = tuple(8 << k for k in range(11))
BANDS = DIMS_BITS + 1
#: Fewer excerpts in a band, or fitted texts of a language, are too few for a quantile.
CALIBRATE = 20
_SLICE_ROWS = 256


@dataclass(frozen=True)
class CentroidModel:
    languages: tuple[str, ...]
    owner: np.ndarray  # language number of each centroid
    centroids: np.ndarray  # (centroids, DIMS), unit length
    floor: np.ndarray  # (languages, BANDS), cosine under which a text is rejected
    idf: np.ndarray


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, DIMS) counts of hashed byte trigrams; letters in lower case, all else a space, one at either end."""
    n_docs = len(offsets) - 1
    size = len(data) + 2 * n_docs
    norm = np.full(size, 32, np.uint32)
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(n_docs), lengths)
    at = np.arange(len(data)) + 2 * doc + 1
    norm[at] = np.where(NO_LETTER[data], np.uint8(32), LOWER[data])
    grams = (norm[:-2] << np.uint32(16)) | (norm[1:-1] << np.uint32(8)) | norm[2:]
    keep = (norm[1:-1] != 32) | ((norm[:-2] != 32) & (norm[2:] != 32))
    starts = offsets[:-1] + 2 * np.arange(n_docs)
    owner = np.repeat(np.arange(n_docs), lengths + 2)[: len(grams)]
    last = starts + lengths + 1  # a gram that starts at a text's last two places would cross into the next
    for back in (0, 1):
        keep[(last - back)[last - back < len(grams)]] = False
    slots = ((grams[keep].astype(np.uint64) * GOLDEN) >> np.uint64(64 - DIMS_BITS)).astype(np.int64)
    return np.bincount(owner[keep] * DIMS + slots, minlength=n_docs * DIMS).reshape(n_docs, DIMS)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.zeros(counts.shape, np.float32)
    rows, cols = np.nonzero(counts)
    x[rows, cols] = (1.0 + np.log(counts[rows, cols])) * idf[cols]
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-12)[:, None]


def _document_counts(batches):
    total, texts = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column(0), max_rows=_SLICE_ROWS):
            total += (_counts(data, offsets) > 0).sum(axis=0)
            texts += len(offsets) - 1
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], texts))], names=["slot", "n"])


def _bands(counts: np.ndarray) -> np.ndarray:
    """Band of each text: the whole part of log2 of its number of distinct n-grams."""
    return np.log2(np.maximum(1, (counts > 0).sum(axis=1))).astype(np.int64)


def _excerpts(texts: list[str]) -> list[str]:
    """Each text, and for each length a stretch of it; one too short is followed by the texts after it."""
    rng = np.random.default_rng(1)
    stream, starts = " ".join(texts), np.cumsum([0] + [len(t) + 1 for t in texts])
    out = list(texts)
    for size in EXCERPTS:
        for start, t in zip(starts.tolist(), texts, strict=False):
            a = start + int(rng.integers(0, max(0, len(t) - size) + 1))
            out.append(stream[a : a + size])
    return out


def _noise() -> list[str]:
    """Words of random letters, of each length of EXCERPTS."""
    rng = np.random.default_rng(2)
    out = []
    for size in EXCERPTS:
        letters = rng.integers(97, 123, (CALIBRATE, size)).astype(np.uint8)
        letters[rng.random(letters.shape) < 1 / 6] = 32
        out += [row.tobytes().decode() for row in letters]
    return out


def _floors(texts: list[str], centres: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Floor of each band from texts of one language and excerpts of them; nan where they are too few to tell."""
    floor = np.full(BANDS, np.nan)
    if len(texts) < CALIBRATE:
        return floor

    def reached(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for _, _, d, o in text_slices(pa.array(texts, pa.string()), max_rows=_SLICE_ROWS):
            counts = _counts(d, o)
            found.append(((_vectors(counts, idf) @ centres.T).max(axis=1), _bands(counts)))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    (clean, band), (noise, noise_band) = reached(_excerpts(texts)), reached(_noise())
    low = high = 0.0
    for b in range(BANDS):
        own, other = clean[band == b], noise[noise_band == b]
        if len(own) >= CALIBRATE:
            low = float(np.quantile(own, REJECT_QUANTILE, method="lower"))
        if len(other):
            high = float(np.quantile(other, 1 - REJECT_QUANTILE))
        floor[b] = min(low, high + (low - high) * MARGIN) if low > high else low
    return floor


def _cluster(idf: np.ndarray):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Spherical k-means over the sample of one language, started from texts far from each other."""
        group = group.sort_values(["key", "text"])
        parts = [_vectors(_counts(d, o), idf) for _, _, d, o in text_slices(pa.array(group["text"], pa.string()), max_rows=_SLICE_ROWS)]
        x = np.concatenate(parts)
        centres = x.mean(axis=0, keepdims=True)
        while len(centres) < min(CENTROIDS, len(x)):
            centres = np.concatenate([centres, x[[(x @ centres.T).max(axis=1).argmin()]]])
        for _ in range(12):
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
            near = (x @ centres.T).argmax(axis=1)
            centres = np.stack([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        used = np.unique((x @ centres.T).argmax(axis=1))
        floor = _floors(group["text"].tolist(), centres[used], idf).tobytes()
        rows = [(group["lang"].iloc[0], centres[c].astype(np.float32).tobytes(), floor) for c in used]
        return pd.DataFrame(rows, columns=["lang", "centre", "floor"])

    return run


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> CentroidModel | None:
    """Centroids from labelled texts; None where no row has a language and a text with a letter.

    Document frequencies cover all labelled texts. Centroids are fitted on about SAMPLE texts of each language,
    those whose hashed id and text are smallest in share; only centroids and one count per n-gram slot reach the driver.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    found = {r[0]: r[1] for r in rows.select("text").mapInArrow(_document_counts, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect()}
    texts = found.pop(-1, 0)
    if not texts:
        return None
    df = np.zeros(DIMS)
    df[list(found)] = list(found.values())
    idf = (np.log((1.0 + texts) / (1.0 + df)) + 1.0).astype(np.float32)
    per_lang = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    key = sample_key("id", "text", F.lit(1)).alias("key")
    sample = rows.select("lang", "text", key).join(sized(per_lang, per_lang.count()), "lang").where(in_sample(F.col("key"), F.col("n"), SAMPLE)).drop("n")
    fitted = sample.groupBy("lang").applyInPandas(_cluster(idf), "lang string, centre binary, floor binary").collect()
    fitted.sort(key=lambda r: (r[0], bytes(r[1])))
    languages = tuple(sorted({r[0] for r in fitted}))
    by_lang = {r[0]: np.frombuffer(r[2]) for r in fitted}
    floor = np.stack([by_lang[k] for k in languages])
    # a language of too few texts takes the lowest floors of the others; without any, nothing is too far
    lowest = np.where(np.isnan(floor), np.inf, floor).min(axis=0)
    floor = np.where(np.isnan(floor), np.where(np.isinf(lowest), 0.0, lowest), floor)
    return CentroidModel(languages, np.array([languages.index(r[0]) for r in fitted]), np.stack([np.frombuffer(r[1], np.float32) for r in fitted]), floor, idf)


def _predict(shared, names: list[str]):
    """names: of the output's columns after the three new ones; the first batch column is the text, the second tells of letters."""

    def run(batches):
        m: CentroidModel = shared.value
        starts = np.array([np.flatnonzero(m.owner == k)[0] for k in range(len(m.languages))])
        for batch in batches:
            letters = np.array(batch.column(1).to_pylist(), bool)
            for a, b, data, offsets in text_slices(batch.column(0), max_rows=_SLICE_ROWS):
                counts = _counts(data, offsets)
                x = _vectors(counts, m.idf)
                cosine = x @ m.centroids.T
                by_lang = np.maximum.reduceat(cosine, starts, axis=1)
                best = by_lang.argmax(axis=1)
                score = np.clip(by_lang.max(axis=1), 0.0, 1.0).astype(np.float64)
                usable = letters[a:b]
                found = pa.array([m.languages[k] if ok else "und" for k, ok in zip(best, usable, strict=True)], pa.string())
                rejected = ~usable | (cosine.max(axis=1) < m.floor[best, _bands(counts)] - 1e-5)
                rest = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns) if i != 1]
                yield pa.RecordBatch.from_arrays([found, pa.array(np.where(usable, score, 0.0)), pa.array(rejected), *rest], names=["lang_pred", "score", "rejected", *names])

    return run


def identify(docs: DataFrame, model: CentroidModel | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected.

    The whole text of each row is compared with every centroid. A null text or one without a letter is ``und``
    with score 0 and rejected; so is every text if no model could be fitted. Another text is rejected where it
    lies nearly as far from its nearest centroid as random words of as many distinct n-grams, measured against
    labelled texts and excerpts of that language; its nearest language is named all the same. Columns of docs that
    bear one of the new names are replaced; other columns, repeated rows and ids play no part.
    """
    spark = docs.sparkSession
    added = ("lang_pred", "score", "rejected")
    kept = [c for c in docs.columns if c not in added]
    if model is None:
        return docs.select(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), *kept).select(*kept, *added)
    shared = spark.sparkContext.broadcast(model)  # CENTROIDS * languages * DIMS floats
    # the text goes over once, first; all other columns follow it
    rest = [text_col, *[c for c in kept if c != text_col]]
    if text_col in added:  # a text of one of these names is replaced too
        rest = [free_name("_text", kept), *kept]
    text = F.col(text_col)
    rows = docs.select(text.alias(rest[0]), has_letter(text).alias(free_name("_letter", rest)), *[F.col(f"`{c}`") for c in rest[1:]])
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = "lang_pred string, score double, rejected boolean, " + ", ".join(f"`{c}` {types[c]}" for c in rest)
    return rows.mapInArrow(_predict(shared, rest), schema).select(*kept, *added)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def fold_of(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds
