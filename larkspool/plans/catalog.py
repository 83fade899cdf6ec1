"""The registered queries of the transcript operators and their SQL counterparts."""

from __future__ import annotations

import io
import uuid
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clock, config_text, fixed, rint_long, shortened, stem, strip, subtitle_time
from ..operators.audio import normalise_parts, normalised_array
from ..operators.metrics import progress_line, real_time_factor
from ..operators.render import numbered, render
from ..operators.segments import own_chunks, to_segments
from ..operators.windows import boundary_cases, hopping_windows, plan_windows, sample_range, windows_that_touch
from ..shipping import shared_folder, ship
from ..sources.media import decode_wav
from ..sources.ranges import listed, plan_ranges, range_samples
from .fixtures import HEARD_SQL, LONG_SQL, UTTERANCE_SQL, heard, one_recording, recordings, table, utterances, write_recordings
from .options import VARIANTS

QUERIES = {}
ORACLES = {}

WS_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_SQL = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS_SQL}+|{WS_SQL}+\z', '', 'g')"


def _ms_sql(x: str) -> str:
    return f"CAST(round_even({x} * 1000.0::DOUBLE, 0) AS BIGINT)"


def _subtitle_sql(x: str) -> str:
    ms = f"CAST(round_even(greatest(0.0::DOUBLE, {x}) * 1000.0::DOUBLE, 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def _clock_sql(x: str) -> str:
    s = f"greatest(0, CAST(round_even({x}, 0) AS BIGINT))"
    return f"CASE WHEN {s} >= 3600 THEN printf('%d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60) ELSE printf('%02d:%02d', {s} // 60, {s} % 60) END"


def _register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _ms(c: str):
    return rint_long(F.col(c) * F.lit(1000.0))


@_register(f"WITH {UTTERANCE_SQL} SELECT recording_id, idx, cnt, core_start, core_end, infer_start, infer_end FROM win")
def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_windows(recordings(spark, sf_dir)).select("recording_id", "idx", "cnt", "core_start", "core_end", "infer_start", "infer_end")


@_register(
    f"""WITH {UTTERANCE_SQL} SELECT recording_id, idx, CAST(round_even(infer_start * 16000.0::DOUBLE, 0) AS BIGINT) AS sample_start,
    CAST(round_even(infer_end * 16000.0::DOUBLE, 0) AS BIGINT) AS sample_end FROM win"""
)
def sample_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_range(plan_windows(recordings(spark, sf_dir))).select("recording_id", "idx", "sample_start", "sample_end")


@_register(
    f"""WITH {HEARD_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start, "end", idx, ordinal) AS n FROM seg)
    SELECT recording_id, n, idx, ordinal, {_ms_sql("start")} AS start_ms, {_ms_sql('"end"')} AS end_ms, {_subtitle_sql("start")} AS start_text,
    {_subtitle_sql('"end"')} AS end_text, text FROM n"""
)
def overlap_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(own_chunks(heard(spark, sf_dir)), ["recording_id"])
    return rows.select("recording_id", F.col("n").cast("long").alias("n"), "idx", "ordinal", _ms("start").alias("start_ms"), _ms("end").alias("end_ms"), subtitle_time(F.col("start")).alias("start_text"), subtitle_time(F.col("end")).alias("end_text"), "text")


@_register(
    f"""WITH {UTTERANCE_SQL}, p AS (SELECT recording_id, ordinal, CAST(round_even(s0 * 1000, 0) AS BIGINT) AS t FROM utt)
    SELECT p.recording_id, p.ordinal, w.idx FROM p JOIN win w ON p.recording_id = w.recording_id
    AND p.t >= w.idx * 120000 - 4000 AND p.t < (w.idx + 1) * 120000 + 4000"""
)
def hopping_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = utterances(spark, sf_dir).withColumn("ms", _ms("s0"))
    return hopping_windows(points, "ms").select("recording_id", "ordinal", "idx")


@_register(
    f"""WITH {LONG_SQL},
    chunk AS (SELECT w.*, u.ordinal, u.text, greatest(u.s0, w.infer_start) - w.infer_start AS start_ts, least(u.s0 + u.len, w.infer_end) - w.infer_start AS end_ts
      FROM utt u JOIN win w ON u.recording_id = w.recording_id AND u.s0 < w.infer_end AND u.s0 + u.len > w.infer_start),
    c1 AS (SELECT *, least(duration, infer_start + greatest(0.0::DOUBLE, start_ts)) AS s, least(duration, infer_start + greatest(end_ts, start_ts + 0.05::DOUBLE)) AS e FROM chunk WHERE text <> ''),
    kept AS (SELECT recording_id, ordinal, count(*) AS kept FROM c1 WHERE (s + e) / 2.0::DOUBLE >= core_start
      AND ((s + e) / 2.0::DOUBLE < core_end OR (idx = cnt - 1 AND (s + e) / 2.0::DOUBLE <= core_end)) GROUP BY recording_id, ordinal),
    edge AS (SELECT recording_id, core_start AS b FROM win WHERE idx > 0),
    near AS (SELECT u.recording_id, u.ordinal, u.s0, u.s0 + u.len AS e, b FROM utt u JOIN edge ON u.recording_id = edge.recording_id AND u.s0 < b + 4 AND u.s0 + u.len > b - 4),
    cases AS (SELECT recording_id, ordinal, count(*) FILTER (s0 >= b - 4 AND e <= b + 4) AS "both", count(*) FILTER (s0 < b - 4 AND e < b + 4) AS "left",
      count(*) FILTER (s0 >= b - 4 AND e > b + 4) AS "right", count(*) FILTER (s0 < b - 4 AND e >= b + 4) AS split FROM near GROUP BY recording_id, ordinal)
    SELECT u.recording_id, u.ordinal, coalesce(kept, 0) AS kept, coalesce("both", 0) AS "both", coalesce("left", 0) AS "left", coalesce("right", 0) AS "right", coalesce(split, 0) AS split
    FROM utt u LEFT JOIN kept k ON k.recording_id = u.recording_id AND k.ordinal = u.ordinal LEFT JOIN cases c ON c.recording_id = u.recording_id AND c.ordinal = u.ordinal"""
)
def boundary_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long utterances, cut by each window that hears a part of them: how often each is kept, and how it lies at boundaries."""
    spans = utterances(spark, sf_dir, per=10.0).withColumn("e", F.col("s0") + F.col("len"))
    heard_by = windows_that_touch(spans, "s0", "e")
    at = F.col("infer_start")
    chunks = heard_by.withColumns({"start_ts": F.greatest("s0", at) - at, "end_ts": F.least("e", "infer_end") - at})
    kept = own_chunks(chunks).groupBy("recording_id", "ordinal").agg(F.count("*").alias("kept"))
    df = boundary_cases(spans, "s0", "e").join(kept, ["recording_id", "ordinal"], "left")
    return df.select("recording_id", "ordinal", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), "both", "left", "right", "split")


@_register(
    """WITH s AS (SELECT event_id AS ordinal, CAST(epoch_us(ts) AS DOUBLE) / 1000000.0::DOUBLE AS start, CAST(epoch_us(ts) AS DOUBLE) / 1000000.0::DOUBLE + value / 100.0::DOUBLE AS "end", event_type AS text
    FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL)
    SELECT row_number() OVER (ORDER BY start, "end", ordinal) AS n, ordinal, text FROM s"""
)
def single_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events numbered as the segments of one recording, which no task gets whole."""
    return numbered(one_recording(spark, sf_dir), ["recording_id"]).select("n", "ordinal", "text")


@_register(f"SELECT conv_id, turn, {_strip_sql('text')} AS text FROM conversations WHERE {_strip_sql('text')} <> ''")
def blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").withColumn("text", strip(F.col("text")))
    return df.where(F.col("text") != "").select("conv_id", "turn", "text")


def _turn_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as the result of one window: chunks for every third, texts for others, else the text form."""
    df = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    size = df.groupBy("conv_id").agg((F.max("turn") + 1).alias("cnt"))
    df = df.join(size, "conv_id").select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("idx"), "cnt", (F.col("cnt") * F.lit(120.0)).alias("duration"), "text", "role")
    kind = F.pmod(F.col("recording_id") + F.col("idx"), F.lit(3))
    at = F.col("idx") * F.lit(120.0)
    chunks = F.when(kind == 0, F.array(F.struct(F.lit(0).alias("ordinal"), F.lit(5.0).alias("start_ts"), F.lit(7.5).alias("end_ts"), F.col("text").alias("text"))))
    chunks = F.coalesce(chunks, F.array().cast("array<struct<ordinal:int,start_ts:double,end_ts:double,text:string>>"))
    texts = F.when(kind == 1, F.array("text", F.lit("not this"))).otherwise(F.array().cast("array<string>"))
    return df.select("recording_id", "idx", "cnt", "duration", at.alias("core_start"), (at + 120.0).alias("core_end"), F.greatest(F.lit(0.0), at - 4.0).alias("infer_start"), (at + 124.0).alias("infer_end"), chunks.alias("chunks"), texts.alias("texts"), F.col("role").alias("repr"))


@_register(
    f"""WITH c AS (SELECT conv_id AS recording_id, turn AS idx, max(turn) OVER (PARTITION BY conv_id) + 1 AS cnt, text, role, (((conv_id + turn) % 3) + 3) % 3 AS kind FROM conversations
      WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    t AS (SELECT recording_id, idx, {_strip_sql("CASE WHEN kind = 2 THEN role ELSE text END")} AS text, kind FROM c)
    SELECT recording_id, idx, CAST(0 AS INTEGER) AS ordinal,
      CASE WHEN kind = 0 THEN CAST(greatest(0, idx * 120 - 4) * 1000 + 5000 AS BIGINT) ELSE CAST(idx * 120000 AS BIGINT) END AS start_ms,
      CASE WHEN kind = 0 THEN CAST(greatest(0, idx * 120 - 4) * 1000 + 7500 AS BIGINT) ELSE CAST((idx + 1) * 120000 AS BIGINT) END AS end_ms, text
    FROM t WHERE text <> ''"""
)
def fallback_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_segments(_turn_windows(spark, sf_dir)).select("recording_id", "idx", "ordinal", _ms("start").alias("start_ms"), _ms("end").alias("end_ms"), "text")


@_register(
    f"""WITH {HEARD_SQL} SELECT recording_id, string_agg(text, chr(10) ORDER BY start, "end", idx, ordinal) || chr(10) AS txt FROM seg GROUP BY recording_id"""
)
def ordered_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(own_chunks(heard(spark, sf_dir)), ["recording_id"]).select("recording_id", "txt")


@_register(
    f"""WITH {HEARD_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start, "end", idx, ordinal) AS n FROM seg)
    SELECT recording_id, string_agg(n || chr(10) || {_subtitle_sql("start")} || ' --> ' || {_subtitle_sql('"end"')} || chr(10) || text || chr(10), chr(10) ORDER BY n) AS srt
    FROM n GROUP BY recording_id"""
)
def srt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(own_chunks(heard(spark, sf_dir)), ["recording_id"]).select("recording_id", "srt")


@_register(f"SELECT event_id, {_subtitle_sql('value * 37.5::DOUBLE - 100')} AS shown FROM events WHERE value IS NOT NULL")
def srt_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", subtitle_time(F.col("value") * 37.5 - 100).alias("shown"))


@_register(f"SELECT l_orderkey, l_linenumber, {_clock_sql('l_extendedprice / 8.0::DOUBLE - 200')} AS shown FROM lineitem")
def clock_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", clock(F.col("l_extendedprice") / 8.0 - 200).alias("shown"))


@_register("SELECT l_orderkey, l_linenumber, printf('%.0f', l_extendedprice / 7) AS d0, printf('%.1f', l_extendedprice / 7) AS d1, printf('%.2f', l_tax / 3) AS d2 FROM lineitem")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") / 7
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fixed(price, 0).alias("d0"), fixed(price, 1).alias("d1"), fixed(F.col("l_tax") / 3, 2).alias("d2"))


def _config_sql(name: str, key: str, text: str) -> str:
    lines = rf"regexp_split_to_array(regexp_replace(coalesce({text}, ''), '\A\x{{feff}}', ''), '{LINE_SQL}')"
    entries = f"list_filter(list_transform({lines}, lambda x: {_strip_sql('x')}), lambda x: x <> '' AND NOT starts_with(x, '#'))"
    return f"SELECT '{name}' AS origin, CAST({key} AS BIGINT) AS key, {_strip_sql(f"array_to_string({entries}, ', ')")} AS entries FROM {name}"


@_register(" UNION ALL ".join(_config_sql(*x) for x in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text"))))
def config_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, n).select(F.lit(n).alias("origin"), F.col(k).cast("long").alias("key"), config_text(F.col(t)).alias("entries")) for n, k, t in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@_register(
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x * 3 AS FLOAT)) AS x FROM embeddings),
    p AS (SELECT *, CAST(list_max(list_transform(x, lambda v: abs(v))) AS DOUBLE) AS peak FROM s),
    n AS (SELECT vec_id, list_transform(x, lambda v: greatest(CAST(-1 AS FLOAT), least(CAST(1 AS FLOAT), CAST(CAST(v AS DOUBLE) / CASE WHEN peak > 1.05 THEN peak ELSE 1.0::DOUBLE END AS FLOAT)))) AS x FROM p)
    SELECT vec_id, CAST(len(x) AS BIGINT) AS n_samples, CAST(list_sum(list_transform(x, lambda v: CAST(round_even(CAST(v AS DOUBLE) * 1000000, 0) AS BIGINT))) AS BIGINT) AS total,
    CAST(round_even(CAST(list_max(x) AS DOUBLE) * 1000000, 0) AS BIGINT) AS top FROM n"""
)
def peak_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = F.transform("embedding", lambda x: (x * F.lit(3).cast("float")).cast("float"))
    df = table(spark, sf_dir, "embeddings").select("vec_id", normalised_array(signal).alias("x"))
    micro = F.transform("x", lambda v: rint_long(v.cast("double") * 1000000))
    return df.select("vec_id", F.size("x").cast("long").alias("n_samples"), F.aggregate(micro, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), rint_long(F.array_max("x").cast("double") * 1000000).alias("top"))


@_register(
    """WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x * 3 AS FLOAT)) AS x FROM embeddings),
    p AS (SELECT *, max(CAST(list_max(list_transform(x, lambda v: abs(v))) AS DOUBLE)) OVER (PARTITION BY label) AS peak FROM s),
    n AS (SELECT vec_id, label, list_transform(x, lambda v: greatest(CAST(-1 AS FLOAT), least(CAST(1 AS FLOAT), CAST(CAST(v AS DOUBLE) / CASE WHEN peak > 1.05 THEN peak ELSE 1.0::DOUBLE END AS FLOAT)))) AS x FROM p)
    SELECT vec_id, label, CAST(len(x) AS BIGINT) AS n_samples, CAST(list_sum(list_transform(x, lambda v: CAST(round_even(CAST(v AS DOUBLE) * 1000000, 0) AS BIGINT))) AS BIGINT) AS total,
    CAST(round_even(CAST(list_max(x) AS DOUBLE) * 1000000, 0) AS BIGINT) AS top FROM n"""
)
def peak_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label as parts of one recording, scaled by the peak of all of them."""
    signal = F.transform("embedding", lambda x: (x * F.lit(3).cast("float")).cast("float"))
    df = normalise_parts(table(spark, sf_dir, "embeddings").select("vec_id", "label", signal.alias("x")), ["label"], "x")
    micro = F.transform("x", lambda v: rint_long(v.cast("double") * 1000000))
    return df.select("vec_id", "label", F.size("x").cast("long").alias("n_samples"), F.aggregate(micro, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), rint_long(F.array_max("x").cast("double") * 1000000).alias("top"))


@_register(
    f"""WITH {UTTERANCE_SQL}, m AS (SELECT recording_id, max(duration) AS duration, sum(CAST(round_even(len * 1000, 0) AS BIGINT)) / 1000.0::DOUBLE AS elapsed FROM utt GROUP BY recording_id)
    SELECT recording_id, printf('%.2f', CASE WHEN duration > 0 THEN elapsed / duration ELSE 0 END) AS rtf, {_clock_sql("elapsed")} AS elapsed_text FROM m"""
)
def rtf_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = utterances(spark, sf_dir).groupBy("recording_id").agg(F.max("duration").alias("duration"), (F.sum(_ms("len")) / F.lit(1000.0)).alias("elapsed"))
    return df.select("recording_id", fixed(real_time_factor(F.col("elapsed"), F.col("duration")), 2).alias("rtf"), clock(F.col("elapsed")).alias("elapsed_text"))


_RATIO = "CASE WHEN duration <= 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, core_end / duration) END"


@_register(
    f"""WITH {UTTERANCE_SQL}, r AS (SELECT *, {_RATIO} AS ratio, (idx + 1) * 1.7::DOUBLE AS elapsed FROM win)
    SELECT recording_id, idx, '[' || repeat('#', CAST(least(28, round_even(ratio * 28, 0)) AS BIGINT)) || repeat('-', 28 - CAST(least(28, round_even(ratio * 28, 0)) AS BIGINT)) || '] '
      || lpad(printf('%.1f', ratio * 100), 5, ' ') || '%  ' || {_clock_sql("core_end")} || ' / ' || {_clock_sql("duration")} || '  window ' || (idx + 1) || '/' || cnt
      || CASE WHEN ratio > 0 AND ratio < 1 THEN ' ETA ' || {_clock_sql("greatest(0.0::DOUBLE, elapsed * (1.0::DOUBLE / ratio - 1.0::DOUBLE))")} WHEN ratio >= 1 THEN ' ETA 00:00' ELSE '' END AS shown FROM r"""
)
def progress_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = plan_windows(recordings(spark, sf_dir))
    return df.select("recording_id", "idx", progress_line(F.col("core_end"), F.col("duration"), (F.col("idx") + 1) * F.lit(1.7), F.col("idx") + 1, F.col("cnt")).alias("shown"))


@_register(
    f"""WITH {HEARD_SQL}, v(variant, suffix) AS (VALUES ('INT8', '_INT8'), ('FP16', '_FP16'))
    SELECT recording_id, variant, recording_id || suffix || '.srt' AS name, count(*) AS n_segments, CAST(sum({_ms_sql("start")}) AS BIGINT) AS start_ms FROM seg, v GROUP BY recording_id, variant, suffix"""
)
def variant_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = own_chunks(heard(spark, sf_dir))
    both = F.array(*[F.struct(F.lit(v.label).alias("variant"), F.lit(v.suffix).alias("suffix")) for v in VARIANTS])
    rows = seg.select("*", F.inline(both))
    out = rows.groupBy("recording_id", "variant", "suffix").agg(F.count("*").alias("n_segments"), F.sum(_ms("start")).alias("start_ms"))
    return out.select("recording_id", "variant", F.concat(F.col("recording_id").cast("string"), "suffix", F.lit(".srt")).alias("name"), "n_segments", "start_ms")


@_register(r"SELECT page_id, regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS stem, CASE WHEN length(html) > 160 THEN substring(html, 1, 160) || '...' ELSE html END AS head FROM pages")
def result_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", stem(F.col("url")).alias("stem"), shortened(F.col("html")).alias("head"))


@_register(
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round_even(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CAST(x AS DOUBLE))) * 32767, 0) AS BIGINT)) AS x FROM embeddings)
    SELECT vec_id, CAST(len(x) AS BIGINT) AS n_samples, CAST(list_sum(x) AS BIGINT) AS total, CAST(list_max(list_transform(x, lambda v: abs(v))) AS BIGINT) AS peak FROM s"""
)
def media_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 16-bit WAV files and back through the decoder."""
    ship(spark)

    def run(batches):
        for batch in batches:
            rows = []
            for vec_id, x in zip(batch["vec_id"], batch["embedding"], strict=True):
                pcm = np.rint(np.clip(np.asarray(x, np.float64), -1, 1) * 32767).astype("<i2")
                out = io.BytesIO()
                with wave.open(out, "wb") as f:
                    f.setnchannels(1)
                    f.setsampwidth(2)
                    f.setframerate(16_000)
                    f.writeframes(pcm.tobytes())
                y = np.rint(decode_wav(out.getvalue()).values.astype(np.float64) * 32768).astype(np.int64)
                rows.append((vec_id, len(y), int(y.sum()), int(np.abs(y).max())))
            yield pd.DataFrame(rows, columns=["vec_id", "n_samples", "total", "peak"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, n_samples long, total long, peak long")


@_register(
    """WITH v AS (SELECT label, unnest(list_transform(embedding, lambda x: CAST(x * 3 AS FLOAT))) AS x, unnest(range(len(embedding))) AS i, vec_id FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    s AS (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS pos FROM v),
    r AS (SELECT label, count(*) AS n, CAST(max(abs(x)) AS DOUBLE) AS peak FROM s GROUP BY label),
    w AS (SELECT *, unnest(range(0, greatest(1, (n + 3999) // 4000))) AS idx, greatest(1, (n + 3999) // 4000) AS cnt FROM r),
    b AS (SELECT *, CASE WHEN idx = 0 THEN 0 ELSE idx * 4000 - 1000 END AS a, CASE WHEN idx + 1 < cnt THEN least(n, (idx + 1) * 4000 + 1000) ELSE n END AS z FROM w),
    y AS (SELECT b.label, idx, greatest(CAST(-1 AS FLOAT), least(CAST(1 AS FLOAT), CAST(CAST(x AS DOUBLE) / CASE WHEN peak > 1.05 THEN peak ELSE 1.0::DOUBLE END AS FLOAT))) AS x FROM b JOIN s ON s.label = b.label AND pos >= a AND pos < z)
    SELECT CAST(label AS VARCHAR) AS recording, idx, count(*) AS n_samples, CAST(sum(CAST(round_even(CAST(x AS DOUBLE) * 1000000, 0) AS BIGINT)) AS BIGINT) AS total,
    CAST(round_even(CAST(max(x) AS DOUBLE) * 1000000, 0) AS BIGINT) AS top FROM y GROUP BY label, idx"""
)
def ranged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each label as a recording on disk, read back window by window: a quarter of a second with a sixteenth on either side."""
    folder = f"{shared_folder(spark)}/recordings-{uuid.uuid4().hex}"
    write_recordings(spark, sf_dir, folder)

    def sums(batches):
        for batch in batches:
            rows = []
            for name, idx, pcm in zip(batch["stem"], batch["idx"], batch["pcm"], strict=True):
                y = np.rint(np.frombuffer(pcm, np.float32).astype(np.float64) * 1_000_000).astype(np.int64)
                rows.append((name, idx, len(y), int(y.sum()), int(y.max())))
            yield pd.DataFrame(rows, columns=["recording", "idx", "n_samples", "total", "top"])

    windows = range_samples(plan_ranges(listed(spark, folder), 0.25, 0.0625))
    return windows.select("stem", "idx", "pcm").mapInPandas(sums, "recording string, idx long, n_samples long, total long, top long")
