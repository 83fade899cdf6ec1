"""Recordings read in ranges: windows are planned from headers and dealt over tasks, each of which reads its own samples.

No file is a row, none is read whole by one task, and the size of a file has no limit. Headers are read by tasks; the
plan is a DataFrame of one narrow row for each window. The peak of a recording is known before its windows are scaled: where
it may pass 1, a first pass gives each window's peak, and one aggregate the recording's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rint_long, stem
from ..operators.audio import resample_part, scaled
from ..operators.windows import SAMPLE_RATE, plan_windows, sample_range
from .media import DECODERS, MEDIA_GLOB, WINDOW_SCHEMA, named, unreadable, window_samples
from .wav import Layout, read_frames, read_layout

#: Suffixes of the formats that can be read in ranges.
RANGED = ("wav",)
#: Windows of a task, at most, and tasks for each core if there are fewer windows.
TASK_WINDOWS, TASKS_PER_CORE = 64, 4


def open_file(path: str) -> BinaryIO:
    """A file opened for reading at any place: on a local or mounted file system, or on a store that Arrow knows by its scheme."""
    if path.startswith("file:") or "://" not in path:
        return open("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path, "rb")
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(f"{urlsplit(path).scheme}://{urlsplit(path).netloc}/")
    return store.open_input_file(path.split("://", 1)[1] if urlsplit(path).scheme in ("s3", "s3a", "gs") else urlsplit(path).path)


def listed(spark: SparkSession, path: str, only_media: bool = False) -> DataFrame:
    """(recording_id, path, stem, suffix, length) of each file, whose content is not read. Spark's file source passes over files of no bytes."""
    reader = spark.read.format("binaryFile")
    if only_media:
        reader = reader.option("pathGlobFilter", MEDIA_GLOB).option("recursiveFileLookup", "true")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return reader.load(path).select(F.col("path").alias("recording_id"), "path", stem(F.col("path")).alias("stem"), suffix.alias("suffix"), "length")


_LAYOUT = "kind int, width int, channels int, rate int, at long, frames long, error string"


def with_layouts(files: DataFrame) -> DataFrame:
    """files (path, suffix) of ranged formats with their layouts, or with error, what is wrong with them."""
    kept = [c for c in files.columns if c in ("recording_id", "path", "stem", "suffix")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["path"]:
                try:
                    with open_file(path) as f:
                        x = read_layout(f)
                    found.append((x.kind, x.width, x.channels, x.rate, x.at, x.frames, None if x.frames else "ValueError: the file has no samples"))
                except Exception as e:  # noqa: BLE001  whatever is wrong with the file
                    found.append((0, 0, 0, 0, 0, 0, f"{type(e).__name__}: {e}"))
            columns = [c.split()[0] for c in _LAYOUT.split(", ")]
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(found, columns=columns)], axis=1)

    return files.select(*kept).mapInPandas(run, ", ".join(f"{c} string" for c in kept) + ", " + _LAYOUT)


def plan_ranges(files: DataFrame, window: float, overlap: float, skip_unreadable: bool = False) -> DataFrame:
    """One row for each window of files (of ranged formats): window columns, layout, sample_start and sample_end.

    A file that can't be read is an error, or has no windows with skip_unreadable.
    """
    df = with_layouts(files)
    if skip_unreadable:
        df = df.where("error is null")
    else:
        df = df.withColumn("frames", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("path", F.lit(": "), "error")).cast("long")).otherwise(F.col("frames")))
    n = F.greatest(F.lit(1).cast("long"), rint_long(F.col("frames") * F.lit(float(SAMPLE_RATE)) / F.col("rate")))
    df = df.drop("error").withColumn("duration", n.cast("double") / F.lit(float(SAMPLE_RATE)))
    return sample_range(plan_windows(df, window, overlap))


def spread(windows: DataFrame, tasks: int | None = None) -> DataFrame:
    """windows dealt over tasks by recording and number, so that one long recording keeps all executors busy.

    Without tasks, the windows are counted (from headers alone): there are as many tasks as windows up to TASKS_PER_CORE
    for each core, and more where a task would get more than TASK_WINDOWS.
    """
    if tasks is None:
        n = windows.count()
        tasks = max(1, min(n, TASKS_PER_CORE * windows.sparkSession.sparkContext.defaultParallelism), n // TASK_WINDOWS)
    return windows.repartition(tasks, "recording_id", "idx")


def _samples(r, start: int, stop: int, files: dict) -> np.ndarray:
    """Resampled samples start to stop of a recording, before its peak is known. The file stays open for the next window."""
    if files.get("path") != r.path:
        if "file" in files:
            files["file"].close()
        files.update(path=r.path, file=open_file(r.path))
    layout = Layout(r.kind, r.width, r.channels, r.rate, r.at, r.frames)
    return resample_part(lambda a, b: read_frames(files["file"], layout, a, b), layout.frames, start, stop, layout.rate, SAMPLE_RATE)


def _peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files: dict = {}
    for batch in batches:  # Arrow and not pandas, which would make nulls of NaN
        rows = list(batch.to_pandas().itertuples())
        found = [np.abs(_samples(r, int(np.rint(r.core_start * SAMPLE_RATE)), int(np.rint(r.core_end * SAMPLE_RATE)), files)).max(initial=0.0) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("recording_id"), pa.array(np.array(found, np.float64))], names=["recording_id", "peak"])


def with_peaks(ranges: DataFrame, tasks: int | None = None) -> DataFrame:
    """ranges with peak, the largest value of their whole recording.

    Only recordings that can pass 1 are read for it, floats and those of another rate; the others' peak is 0. Cores cover
    every sample once. The aggregate takes the peaks of windows part by part; NaN counts as the largest.
    """
    may = (F.col("kind") == 3) | (F.col("rate") != SAMPLE_RATE)
    parts = spread(ranges.where(may), tasks).mapInArrow(_peaks, "recording_id string, peak double")
    peaks = parts.groupBy("recording_id").agg(F.max("peak").alias("peak"))
    return ranges.join(peaks, "recording_id", "left").withColumn("peak", F.coalesce("peak", F.lit(0.0)))


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    files: dict = {}
    columns = [c.split()[0] for c in WINDOW_SCHEMA.split(", ")]
    for batch in batches:
        for r in batch.itertuples():
            x = scaled(_samples(r, r.sample_start, r.sample_end, files), r.peak)
            yield pd.DataFrame([(r.recording_id, r.stem, r.duration, r.cnt, r.idx, r.core_start, r.core_end, r.infer_start, r.infer_end, x.tobytes())], columns=columns)


def range_samples(ranges: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per window with its normalised float32 samples as bytes, the same as window_samples gives of whole files."""
    return spread(with_peaks(ranges, tasks), tasks).mapInPandas(_windows, WINDOW_SCHEMA)


def recording_windows(spark: SparkSession, path: str, window: float, overlap: float, only_media: bool = False, tasks: int | None = None, scratch: str | None = None) -> DataFrame:
    """Windows of all recordings of a path with their samples, dealt over tasks.

    Formats of RANGED are read in ranges. Files of other registered decoders are decoded whole by one task each (and must
    fit in a row), their windows dealt afterwards. A file of any other format is an error. With scratch, a folder that
    all executors share, the plan is written there first, so that each header is read once.
    """
    files = listed(spark, path, only_media)
    whole = sorted(set(DECODERS) - set(RANGED))
    known = F.col("suffix").isin(*RANGED, *whole)
    problem = F.concat(F.lit("no decoder for ."), "suffix", F.lit(f" files; known: {', '.join(sorted(DECODERS))}"))
    files = files.withColumn("suffix", F.when(known, F.col("suffix")).otherwise(F.raise_error(problem)))
    ranges = plan_ranges(files.where(F.col("suffix").isin(*RANGED)), window, overlap)
    if scratch:
        ranges.write.parquet(f"{scratch}/ranges")
        ranges = spark.read.schema(ranges.schema).parquet(f"{scratch}/ranges")
    windows = range_samples(ranges, tasks)
    if whole:  # by their names, so that no other file's content is read
        reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join([*whole, *map(str.upper, whole)])}}}")
        contents = named((reader.option("recursiveFileLookup", "true") if only_media else reader).load(path))
        rest = spread(window_samples(contents, window, overlap), tasks or TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
        windows = windows.unionByName(rest)
    return windows


def file_windows(files: DataFrame, window: float, overlap: float, tasks: int | None = None) -> DataFrame:
    """Windows of files that are rows already (as named() gives them, their content a column), but for those that can't be read.

    Of ranged formats the content isn't used.
    """
    ranged = F.col("suffix").isin(*RANGED)
    windows = range_samples(plan_ranges(files.where(ranged), window, overlap, skip_unreadable=True), tasks)
    if set(DECODERS) <= set(RANGED):
        return windows
    return windows.unionByName(window_samples(files.where(~ranged), window, overlap, skip_unreadable=True).repartition(tasks or TASKS_PER_CORE * files.sparkSession.sparkContext.defaultParallelism, "recording_id", "idx"))


def file_errors(files: DataFrame) -> DataFrame:
    """(recording_id, error) of such files that can't be read; of ranged formats only headers are looked at."""
    ranged = F.col("suffix").isin(*RANGED)
    errors = with_layouts(files.where(ranged)).where("error is not null").select("recording_id", "error")
    return errors.unionByName(unreadable(files.where(~ranged)))
