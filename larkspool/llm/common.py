"""Helpers shared by the corpus operators: shared scratch tables, sized joins, flat text kernels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many narrow rows may be broadcast (about 10 MB).
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir. Where that is unset, a new local one if all runs on this machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths of the tables that are removed at the end of each open scope, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and lost executors cost nothing.

    Inside a scratch() the table is removed at its end; with keep, at the end of the scratch() around that one, if any.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if scopes := _scopes.get()[: -1 if keep else None]:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables materialized inside, but for kept ones. What is read afterwards must be a kept table or not need any other."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sized(df: DataFrame, n_rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def free_name(name: str, columns: list[str]) -> str:
    """name, with underscores ahead until no column bears it."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_bytes(text: Column) -> Column:
    """Length of the text in UTF-8 bytes, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: Hashed keys that draw a sample are below this.
KEYS = 1 << 40


def sample_key(*cols: str | Column) -> Column:
    """A hash of the columns, uniform below KEYS."""
    return F.pmod(F.xxhash64(*cols), F.lit(KEYS))


def in_sample(key: Column, n: Column, size: int) -> Column:
    """Whether a row of n is in a sample of about size, by its key. In double: key * n overflows from 2**23 rows on."""
    return key.cast("double") <= F.lit(float(size * KEYS)) / F.greatest(n.cast("double"), F.lit(1.0))


# ---------------------------------------------------------------- flat text kernels (used inside Arrow tasks)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def golden(k: int) -> np.uint64:
    """k times the golden-ratio constant, modulo 2**64."""
    return np.uint64(k * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def text_slices(column, max_bytes: int = 1 << 20, max_rows: int = 1 << 20):
    """Cut an Arrow string column into runs of whole texts of about max_bytes.

    Yields (first row, last row + 1, bytes of these rows as uint8, offsets from 0). Null texts are empty. A
    text longer than max_bytes is a run of its own; a run has at most max_rows rows.
    """
    import pyarrow as pa

    for chunk_start, arr in _chunks(column):
        if not pa.types.is_string(arr.type) and not pa.types.is_binary(arr.type):
            arr = arr.cast(pa.string())
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) else "")
        n = len(arr)
        if not n:
            continue
        buffers = arr.buffers()
        offsets = np.frombuffer(buffers[1], np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        a = 0
        while a < n:
            b = int(np.searchsorted(offsets, offsets[a] + max_bytes, side="right")) - 1
            b = min(n, a + max_rows, max(a + 1, b))
            yield chunk_start + a, chunk_start + b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            a = b


def _chunks(column):
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        at = 0
        for c in column.chunks:
            yield at, c
            at += len(c)
    else:
        yield 0, column


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: ASCII bytes that are no letter; bytes of other characters count as letters.
NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_KEYS = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes outside those marked in apart: 0x20 and 0x09-0x0D) of texts laid end to end.

    Returns their 64-bit hashes, their text's number, and their first and past-the-end byte positions. Words
    never cross texts.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    inside = ~apart[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    here = np.zeros(n + 1, bool)
    here[:n] = inside
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[_LOWER[data] if lower else data] * power[:n], out=sums[1:])
    h = mix64((sums[ends] - sums[starts]) * inverse[starts])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return h, doc, starts, ends


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct hashes of k-word shingles (ASCII letters lower-cased).

    A text of 1 to k - 1 words has its whole sequence as one shingle; a text without words has none.
    """
    h, doc, _, _ = word_hashes(data, offsets)
    n_docs = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    out: list[np.ndarray] = []
    grams = np.zeros(0, np.uint64)
    if len(h) >= k:
        grams = np.full(len(h) - k + 1, np.uint64(k))
        for j in range(k):
            grams = mix64(grams * GOLDEN + h[j : len(h) - k + 1 + j])
    for d in range(n_docs):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            g = np.array([b - a], np.uint64)
            for x in h[a:b]:
                g = mix64(g * GOLDEN + np.array([x]))
            out.append(g)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


LOWER = _LOWER


def collapsed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end, ASCII lower-cased, each run of bytes that are neither letters nor digits as one space.

    Returns the bytes, the new offsets, and each byte's position in data. Runs never cross texts.
    """
    gap = _GAP[data]
    follows = np.zeros(len(data), bool)
    follows[1:] = gap[:-1]
    follows[offsets[:-1][offsets[:-1] < len(data)]] = False
    keep = ~(gap & follows)
    at = np.flatnonzero(keep)
    out = np.where(gap, np.uint8(32), LOWER[data])[at]
    counts = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=counts[1:])
    return out, counts[offsets], at


_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
