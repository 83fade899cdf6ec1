"""Media files as recordings, windows of samples, and a registry of decoders."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stem
from ..operators.audio import normalise, resample_part, resampled_length
from ..operators.windows import SAMPLE_RATE
from .wav import read_frames, read_layout

# File types offered for recordings.
MEDIA_TYPES = ("wav", "mp3", "m4a", "aac", "flac", "ogg", "opus", "mp4", "mov", "mkv", "webm")


@dataclass(frozen=True)
class Samples:
    """Mono samples before normalisation and their rate."""

    values: np.ndarray
    rate: int


def decode_wav(content: bytes) -> Samples:
    """WAV of 8, 16, 24 or 32 bit integers or 32 or 64 bit floats, its header plain or extensible: channels are averaged to one."""
    f = io.BytesIO(content)
    layout = read_layout(f)
    return Samples(read_frames(f, layout, 0, layout.frames), layout.rate)


#: Decoders by lower-case suffix. Other formats need a decoder of their own, registered here.
DECODERS: dict[str, Callable[[bytes], Samples]] = {"wav": decode_wav}


def resample(samples: Samples, rate: int = SAMPLE_RATE) -> np.ndarray:
    """All samples at another rate, by the filter bank of both rates."""
    x = samples.values.astype(np.float32)
    if not len(x):
        return x
    return resample_part(lambda a, b: x[a:b], len(x), 0, resampled_length(len(x), samples.rate, rate), samples.rate, rate)


def decode(content: bytes, suffix: str, decoders: dict[str, Callable[[bytes], Samples]] | None = None) -> np.ndarray:
    """Normalised mono float32 samples at SAMPLE_RATE; an unknown format or a file without samples is an error."""
    decoders = DECODERS if decoders is None else decoders
    if suffix not in decoders:
        raise ValueError(f"no decoder for .{suffix} files; known: {', '.join(sorted(decoders))}")
    x = resample(decoders[suffix](content))
    if not len(x):
        raise ValueError("the file has no samples")
    return normalise(x)


#: Files of recordings by name.
MEDIA_GLOB = f"*.{{{','.join([*MEDIA_TYPES, *[k.upper() for k in MEDIA_TYPES]])}}}"


def scan(spark: SparkSession, path: str, only_media: bool = False) -> DataFrame:
    """(recording_id, path, stem, suffix, content) of each file; with only_media, of the file types of recordings."""
    reader = spark.read.format("binaryFile")
    if only_media:
        reader = reader.option("pathGlobFilter", MEDIA_GLOB).option("recursiveFileLookup", "true")
    return named(reader.load(path))


def named(files: DataFrame) -> DataFrame:
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return files.select(F.col("path").alias("recording_id"), "path", stem(F.col("path")).alias("stem"), suffix.alias("suffix"), "content")


WINDOW_SCHEMA = "recording_id string, stem string, duration double, cnt long, idx long, core_start double, core_end double, infer_start double, infer_end double, pcm binary"


def unreadable(files: DataFrame) -> DataFrame:
    """(recording_id, error) of the files that don't decode."""
    decoders = dict(DECODERS)  # goes to the tasks as it is here

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for r in batch.itertuples():
                try:
                    decode(r.content, r.suffix, decoders)
                except Exception as e:  # noqa: BLE001  whatever a decoder says about a bad file
                    errors.append((r.recording_id, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(errors, columns=["recording_id", "error"])

    return files.mapInPandas(run, "recording_id string, error string")


def window_samples(files: DataFrame, window: float, overlap: float, skip_unreadable: bool = False) -> DataFrame:
    """One row per window of each file with its float32 samples as bytes.

    A file is decoded once, in one task; its samples leave it window by window and never as one row. A file that
    doesn't decode is an error, or has no windows with skip_unreadable. Spark bounds the bytes of a batch of such
    large rows by itself; the session is left as it is. Formats that can be read in ranges have a way without this
    (ranges.py); this one is for those that must be decoded from their start.
    """
    window, overlap = float(window), float(overlap)
    decoders = dict(DECODERS)  # goes to the tasks as it is here

    def bounds(duration: float):
        cnt = max(1, int(np.ceil(duration / window)))
        for idx in range(cnt):
            core = idx * window, min(duration, (idx + 1) * window)
            yield cnt, idx, *core, max(0.0, core[0] - overlap * (idx > 0)), min(duration, core[1] + overlap * (idx + 1 < cnt))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                try:
                    x = decode(r.content, r.suffix, decoders)
                except Exception:
                    if not skip_unreadable:
                        raise
                    continue
                duration = len(x) / SAMPLE_RATE
                for cnt, idx, core_start, core_end, start, end in bounds(duration):
                    pcm = x[int(np.rint(start * SAMPLE_RATE)) : int(np.rint(end * SAMPLE_RATE))].tobytes()
                    yield pd.DataFrame([(r.recording_id, r.stem, duration, cnt, idx, core_start, core_end, start, end, pcm)], columns=[c.split()[0] for c in WINDOW_SCHEMA.split(", ")])

    return files.mapInPandas(run, WINDOW_SCHEMA)
