"""Run metrics and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clock, fixed, rint_long

BAR = 28


def real_time_factor(elapsed: Column, duration: Column) -> Column:
    """Seconds of work per second of audio, 0 for no audio."""
    return F.when(duration > 0, elapsed / duration).otherwise(F.lit(0.0))


def progress_ratio(done: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), done / total))


def progress_bar(ratio: Column) -> Column:
    filled = F.least(F.lit(BAR).cast("long"), rint_long(ratio * BAR)).cast("int")
    return F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), F.lit(BAR) - filled))


def remaining(ratio: Column, elapsed: Column) -> Column:
    """Estimated time left: nothing before any progress, 00:00 at the end."""
    left = F.when((ratio > 0) & (ratio < 1), elapsed * (1.0 / ratio - 1.0))
    return F.when(left.isNotNull(), F.concat(F.lit(" ETA "), clock(F.greatest(F.lit(0.0), left)))).when(ratio >= 1, F.lit(" ETA 00:00")).otherwise(F.lit(""))


def progress_line(done: Column, total: Column, elapsed: Column, idx: Column, cnt: Column) -> Column:
    """One line of progress: bar, percentage, clocks, window and time left."""
    ratio = progress_ratio(done, total)
    percent = F.lpad(fixed(ratio * 100, 1), 5, " ")
    place = F.concat(F.lit("window "), idx.cast("string"), F.lit("/"), cnt.cast("string"))
    return F.concat(F.lit("["), progress_bar(ratio), F.lit("] "), percent, F.lit("%  "), clock(done), F.lit(" / "), clock(total), F.lit("  "), place, remaining(ratio, F.greatest(F.lit(0.0), elapsed)))


def run_metric(results: DataFrame) -> DataFrame:
    """(recording_id, variant, duration, elapsed, rtf) of the results of a run: what its windows took, added up."""
    df = results.groupBy("recording_id", "variant").agg(F.max("duration").alias("duration"), F.sum("elapsed").alias("elapsed"))
    return df.withColumn("rtf", real_time_factor(F.col("elapsed"), F.col("duration")))


def _clock_text(seconds: float) -> str:
    whole = max(0, round(seconds))
    hour, minute, second = whole // 3600, whole % 3600 // 60, whole % 60
    return f"{hour}:{minute:02d}:{second:02d}" if hour else f"{minute:02d}:{second:02d}"


def progress_text(done: float, total: float, elapsed: float, idx: int, cnt: int) -> str:
    """progress_line for the driver, while a run goes on."""
    ratio = 1.0 if total <= 0 else min(1.0, done / total)
    filled = min(BAR, round(ratio * BAR))
    left = f" ETA {_clock_text(max(0.0, elapsed * (1.0 / ratio - 1.0)))}" if 0 < ratio < 1 else " ETA 00:00" if ratio >= 1 else ""
    return f"[{'#' * filled}{'-' * (BAR - filled)}] {ratio * 100:5.1f}%  {_clock_text(done)} / {_clock_text(total)}  window {idx}/{cnt}{left}"
