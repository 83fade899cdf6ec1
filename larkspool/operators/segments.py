"""From recogniser results to segments: clean-up, clamping, midpoint ownership, fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_max, first_min, strip

CHUNK = "struct<ordinal:int,start_ts:double,end_ts:double,text:string>"
SHORTEST = 0.05


def _times() -> tuple[Column, Column]:
    """Clamped absolute start and end of a chunk."""
    d, at, begin = F.col("duration"), F.col("infer_start"), F.col("start_ts")
    return first_min(d, at + first_max(F.lit(0.0), begin)), first_min(d, at + first_max(F.col("end_ts"), begin + SHORTEST))


def _timed(kept: Column) -> Column:
    """kept, but a chunk without a time is an error. Part of a filter, so that it is looked at whatever columns are wanted."""
    missing = F.col("start_ts").isNull() | F.col("end_ts").isNull()
    return F.when(missing, F.raise_error(F.lit("a chunk has no time stamp")).cast("boolean")).otherwise(kept)


def _owned() -> Column:
    """Whether the midpoint of start and end lies in the window's core, whose end belongs to the last window alone."""
    middle = (F.col("start") + F.col("end")) / 2.0
    last = F.col("idx") == F.col("cnt") - 1
    return (middle >= F.col("core_start")) & F.when(last, middle <= F.col("core_end")).otherwise(middle < F.col("core_end"))


def own_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (window columns, ordinal, start_ts, end_ts, text), one row each, to the segments their windows own.

    Blank texts go. What two windows hear in their overlap is kept once, by its midpoint. Ends are stretched to
    the shortest length afterwards and may then pass the recording's end by as much.
    """
    start, end = _times()
    df = chunks.withColumn("text", strip(F.col("text"))).where(F.col("text") != "").withColumns({"start": start, "end": end})
    return df.where(_timed(_owned())).withColumn("end", first_max(F.col("end"), F.col("start") + SHORTEST))


def to_segments(results: DataFrame, with_silent: bool = False) -> DataFrame:
    """Results (window columns, chunks, texts, repr), one row per window, to segments, in one pass.

    Windows with chunks give the chunks they own, none if they own none. Windows without give one segment over
    the core with the first text, or the result's own text form if there are no texts, unless it is blank. With
    with_silent, each recording also has one row without text, so that recordings without segments stay known.
    """
    keys = [c for c in results.columns if c not in ("chunks", "texts", "repr")]
    kind = "array<struct<ordinal:int,start_ts:double,end_ts:double,text:string,kind:int>>"
    said = F.when(F.coalesce(F.size("texts"), F.lit(0)) > 0, F.element_at("texts", 1)).otherwise(F.col("repr"))
    heard = F.transform("chunks", lambda c: F.struct(c["ordinal"], c["start_ts"], c["end_ts"], c["text"], F.lit(0))).cast(kind)
    plain = F.array(F.struct(F.lit(0), F.lit(0.0), F.lit(0.0), said, F.lit(1))).cast(kind)
    items = F.when(F.coalesce(F.size("chunks"), F.lit(0)) > 0, heard).otherwise(plain)
    if with_silent:
        mark = F.array(F.struct(F.lit(-1), F.lit(0.0), F.lit(0.0), F.lit(None).cast("string"), F.lit(2))).cast(kind)
        items = F.when(F.col("idx") == 0, F.concat(items, mark)).otherwise(items)
    df = results.select(*keys, F.inline(items)).withColumn("text", strip(F.col("text")))
    df = df.where((F.col("kind") == 2) | (F.col("text") != ""))
    start, end = _times()
    chunk = F.col("kind") == 0
    df = df.withColumns({"start": F.when(chunk, start).otherwise(F.col("core_start")), "end": F.when(chunk, end).otherwise(F.col("core_end"))})
    df = df.where(~chunk | _timed(_owned()))
    end = F.when(chunk, first_max(F.col("end"), F.col("start") + SHORTEST)).otherwise(F.col("end"))
    return df.withColumn("end", end).select(*keys, "ordinal", "start", "end", "text")
