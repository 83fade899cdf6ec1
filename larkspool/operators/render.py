"""Ordered transcripts and subtitles of segments.

A recording may have any number of segments: they are numbered and rendered by spans of time, each a group of its own,
and only one narrow row for each span is put in order for a whole recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import BYTE_ORDER_MARK, first_max, strip, subtitle_time

#: Seconds of a span.
SPAN = 600.0
#: Span of rows without text, behind all others.
_LAST = (1 << 63) - 1


def _spans(segments: DataFrame) -> DataFrame:
    """segments with span, in the order of start; starts that are NaN or past all bounds share the last span of rows with text."""
    at = F.when(F.isnan("start") | (F.col("start") > 1e15), F.lit(1e15)).otherwise(F.greatest(F.lit(-1e15), F.col("start")))
    return segments.withColumn("span", F.when(F.col("text").isNull(), F.lit(_LAST)).otherwise(F.floor(at / F.lit(SPAN))))


def numbered(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with n, their number from 1 in their recording: by start, end, then window and place in it; rows without text last.

    Segments are counted by span, and numbered in their span from what is ahead of it; n is a long.
    """
    df = _spans(segments)
    ahead = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, "span").agg(F.count("*").alias("_size")).select(*keys, "span", F.coalesce(F.sum("_size").over(ahead), F.lit(0).cast("long")).alias("_ahead"))
    order = Window.partitionBy(*keys, "span").orderBy("start", "end", "idx", "ordinal")
    a, b = df.alias("a"), counts.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "span")]
    return a.join(b, same).select("a.*", "_ahead").withColumn("n", F.col("_ahead") + F.row_number().over(order)).drop("span", "_ahead")


def subtitle_block(df: DataFrame) -> DataFrame:
    """Numbered segments with their subtitle block; blocks of blank texts are null but keep their number."""
    text = strip(F.col("text"))
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), subtitle_time(F.col("start")), F.lit(" --> "), subtitle_time(F.col("end")), F.lit("\n"), text, F.lit("\n"))
    return df.withColumn("block", F.when(text != "", block))


def _whole(duration: Column, said: Column) -> Column:
    """The one block of a recording that has text but no blocks."""
    return F.concat(F.lit("1\n"), subtitle_time(F.lit(0.0)), F.lit(" --> "), subtitle_time(first_max(duration, F.lit(0.5))), F.lit("\n"), said, F.lit("\n"))


def _joined(rows: str, field: str) -> Column:
    return F.expr(f"array_join(transform(filter({rows}, r -> r.{field} is not null), r -> r.{field}), '\\n')")


def _any(rows: str, field: str) -> Column:
    return F.expr(f"exists({rows}, r -> r.{field} is not null)")


def render(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, duration, txt, srt): the joined text with a line end, and all subtitle blocks, of each recording.

    Segments carry duration. Where no block was made but there is text, one block spans the recording. Spans are joined
    first, then a recording's spans; write_lines writes transcripts that are too long for a row.
    """
    blocks = _spans(subtitle_block(numbered(segments, keys)))
    line = F.when(strip(F.col("text")) != "", F.col("text"))
    spans = blocks.groupBy(*keys, "span").agg(F.max("duration").alias("duration"), F.sort_array(F.collect_list(F.struct("n", line.alias("line"), "block"))).alias("rows"))
    spans = spans.select(*keys, "span", "duration", *[F.when(_any("rows", f), _joined("rows", f)).alias(f) for f in ("line", "block")])
    rows = spans.groupBy(*keys).agg(F.max("duration").alias("duration"), F.sort_array(F.collect_list(F.struct("span", "line", "block"))).alias("rows"))
    said, joined = strip(_joined("rows", "line")), _joined("rows", "block")
    return rows.select(*keys, "duration", F.concat(said, F.lit("\n")).alias("txt"), F.when((joined == "") & (said != ""), _whole(F.col("duration"), said)).otherwise(joined).alias("srt"))


def file_lines(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, n, line) of the .txt and .srt files of each recording, in order of n, each line without the line feed behind it.

    segments are those of to_segments with_silent, none of them blank. No file is built as one value. Recordings without
    text have one line in each file: the byte order mark, and in .srt nothing behind it, not even a line feed (line is null).
    """
    blocks = subtitle_block(numbered(segments, keys))
    mark = F.lit(BYTE_ORDER_MARK)
    silent = F.col("text").isNull()
    # rows without text come last, so a recording has some text exactly if its row without text isn't the first
    kept = blocks.where(~silent | (F.col("n") == 1))
    first = F.col("n") == 1
    said = F.when(silent, mark).otherwise(F.concat(F.when(first, mark).otherwise(""), F.col("text")))
    shown = F.when(~silent, F.concat(F.when(first, mark).otherwise(F.lit("\n")), F.regexp_replace("block", r"\n\z", "")))
    each = F.array(F.struct(F.lit("txt").alias("kind"), said.alias("line")), F.struct(F.lit("srt").alias("kind"), shown.alias("line")))
    return kept.select(*keys, "n", F.inline(each)).select(*keys, "kind", "n", "line")
