"""Overlapping inference windows over recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rint_long

SAMPLE_RATE = 16_000


def window_count(duration: Column, window: float) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(duration / F.lit(float(window))))


def bounds(df: DataFrame, window: float, overlap: float) -> DataFrame:
    """df (duration, idx, cnt) with core and inference bounds in seconds."""
    w, v, idx, duration = F.lit(float(window)), F.lit(float(overlap)), F.col("idx"), F.col("duration")
    df = df.withColumns({"core_start": idx * w, "core_end": F.least(duration, (idx + 1) * w)})
    before = F.when(idx > 0, v).otherwise(F.lit(0.0))
    after = F.when(idx + 1 < F.col("cnt"), v).otherwise(F.lit(0.0))
    return df.withColumns({"infer_start": F.greatest(F.lit(0.0), F.col("core_start") - before), "infer_end": F.least(duration, F.col("core_end") + after)})


def plan_windows(recordings: DataFrame, window: float = 120.0, overlap: float = 4.0) -> DataFrame:
    """One row per window of each recording (with a column duration): tumbling cores, inference bounds that overlap both neighbours.

    A recording shorter than a window, or of no length, has one window.
    """
    numbered = recordings.withColumn("cnt", window_count(F.col("duration"), window)).withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cnt") - 1)))
    return bounds(numbered, window, overlap)


def sample_range(df: DataFrame) -> DataFrame:
    """Half-open range of samples of each inference window."""
    rate = F.lit(float(SAMPLE_RATE))
    return df.withColumns({"sample_start": rint_long(F.col("infer_start") * rate), "sample_end": rint_long(F.col("infer_end") * rate)})


def windows_that_hear(points: DataFrame, at: str, window: float = 120.0, overlap: float = 4.0) -> DataFrame:
    """points (duration, a time in seconds) once for each window whose inference bounds hold the time.

    Only the windows a time can fall in are looked at, so this needs no join.
    """
    t, w, v = F.col(at), float(window), float(overlap)
    guess = F.array_distinct(F.array(*[F.floor((t + d) / w) for d in (-v, 0.0, v)]))
    df = points.withColumn("cnt", window_count(F.col("duration"), window)).withColumn("idx", F.explode(guess))
    df = bounds(df.where((F.col("idx") >= 0) & (F.col("idx") < F.col("cnt"))), window, overlap)
    return df.where((t >= F.col("infer_start")) & (t < F.col("infer_end")))


def hopping_windows(points: DataFrame, at_ms: str, window: float = 120.0, overlap: float = 4.0) -> DataFrame:
    """The same assignment by Spark's hopping window(): points (duration, time in ms) once per hop that is a window of the recording.

    The first and last windows of a recording reach no further than its bounds, so hops before the first and
    behind the last are left out.
    """
    ts = F.timestamp_millis(F.col(at_ms))
    hop = F.window(ts, f"{window + 2 * overlap:g} seconds", f"{window:g} seconds", f"{window - overlap:g} seconds")
    df = points.withColumn("hop", hop)
    idx = F.floor((F.unix_millis(F.col("hop.start")) + int(overlap * 1000)) / F.lit(int(window * 1000)))
    df = df.withColumns({"idx": idx, "cnt": window_count(F.col("duration"), window)}).drop("hop")
    return df.where((F.col("idx") >= 0) & (F.col("idx") < F.col("cnt")))


def windows_that_touch(spans: DataFrame, start: str, end: str, window: float = 120.0, overlap: float = 4.0) -> DataFrame:
    """spans (duration, start and end in seconds) once for each window whose inference bounds they share a stretch with.

    A span goes straight to the windows from the first to the last that it can touch, so this needs no join and grows
    with what it gives.
    """
    s, e, w, v = F.col(start), F.col(end), float(window), float(overlap)
    df = spans.withColumn("cnt", window_count(F.col("duration"), window))
    first = F.greatest(F.lit(0).cast("long"), F.floor((s - v) / w))
    last = F.least(F.col("cnt") - 1, F.floor((e + v) / w))
    df = df.where(first <= last).withColumn("idx", F.explode(F.sequence(first, last)))
    return bounds(df, window, overlap).where((s < F.col("infer_end")) & (e > F.col("infer_start")))


#: What becomes of a span at a boundary between two windows: both hear it whole, only the left or the right one does, or neither.
BOUNDARY_CASES = ("both", "left", "right", "split")


def boundary_cases(spans: DataFrame, start: str, end: str, window: float = 120.0, overlap: float = 4.0) -> DataFrame:
    """spans with a count of each of BOUNDARY_CASES, over the boundaries whose overlap they touch.

    Where a recogniser cuts what it hears at its window's edges, midpoints keep a span once, and once more for each split.
    """
    s, e, w, v = F.col(start), F.col(end), float(window), float(overlap)
    first = F.greatest(F.lit(1).cast("long"), F.ceil((s - v) / w))
    last = F.least(window_count(F.col("duration"), window) - 1, F.floor((e + v) / w))
    near = F.when(first <= last, F.transform(F.sequence(first, last), lambda k: k.cast("double") * w)).otherwise(F.array().cast("array<double>"))
    near = F.filter(near, lambda b: (s < b + v) & (e > b - v))
    rules = {
        "both": lambda b: (s >= b - v) & (e <= b + v),
        "left": lambda b: (s < b - v) & (e < b + v),
        "right": lambda b: (s >= b - v) & (e > b + v),
        "split": lambda b: (s < b - v) & (e >= b + v),
    }
    df = spans.withColumn("_near", near)
    return df.withColumns({case: F.size(F.filter("_near", rules[case])).cast("long") for case in BOUNDARY_CASES}).drop("_near")
