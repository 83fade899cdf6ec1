"""Inputs of the registered queries, derived from the driver's tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.windows import SAMPLE_RATE, windows_that_hear
from ..shipping import ship
from ..sources.wav import float_header


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str, per: float = 100.0) -> DataFrame:
    """One recording per user: recording_id, duration, ordinal, s0 (start within an hour), len (value / per), text. One shuffle, by user."""
    events = table(spark, sf_dir, "events").where("ts is not null and value is not null")
    user = Window.partitionBy("user_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    df = events.select("user_id", "event_id", "value", "event_type", us.alias("us")).withColumn("min_us", F.min("us").over(user))
    df = df.withColumns({"s0": F.expr("(us - min_us) div 1000 % 3600000").cast("double") / F.lit(1000.0), "len": F.col("value") / F.lit(per)})
    df = df.withColumn("duration", F.max(F.col("s0") + F.col("len")).over(user) + 1.0)
    return df.select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("ordinal"), "s0", "len", F.col("event_type").alias("text"), "duration")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utterances(spark, sf_dir).groupBy("recording_id").agg(F.max("duration").alias("duration"))


def one_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as segments of a single recording: recording_id, idx, ordinal, start, end, text."""
    events = table(spark, sf_dir, "events").where("ts is not null and value is not null and event_type is not null")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    start = us.cast("double") / F.lit(1e6)
    return events.select(F.lit(1).cast("long").alias("recording_id"), F.lit(0).cast("long").alias("idx"), F.col("event_id").alias("ordinal"), start.alias("start"), (start + F.col("value") / F.lit(100.0)).alias("end"), F.col("event_type").alias("text"))


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of an ideal recogniser: each utterance in every window in whose inference bounds it starts."""
    df = windows_that_hear(utterances(spark, sf_dir), "s0")
    return df.withColumns({"start_ts": F.col("s0") - F.col("infer_start"), "end_ts": F.col("s0") + F.col("len") - F.col("infer_start")})


def write_recordings(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """One float WAV file for each label of embeddings: its vectors, three times as loud, end to end by vec_id.

    Samples of a label pass its task in order and go to its file as they come; a file appears when it is whole.
    """
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError(f"{folder} is no folder that tasks can write files to")
    ship(spark)
    signal = F.transform("embedding", lambda x: (x * F.lit(3).cast("float")).cast("float"))
    df = table(spark, sf_dir, "embeddings").select("label", "vec_id", signal.alias("x"))

    def write(batches):
        import os
        import uuid

        top = "/" + folder.removeprefix("file:").lstrip("/")
        os.makedirs(top, exist_ok=True)
        label = temporary = out = None
        done = []

        def close():
            frames = (out.tell() - len(float_header(0, SAMPLE_RATE))) // 4
            out.seek(0)
            out.write(float_header(frames, SAMPLE_RATE))
            out.close()
            os.replace(temporary, f"{top}/{label}.wav")
            done.append(label)

        for batch in batches:
            for r in batch.itertuples():
                if out is None or r.label != label:
                    if out is not None:
                        close()
                    label, temporary = r.label, f"{top}/.{uuid.uuid4().hex}"
                    out = open(temporary, "wb")
                    out.write(float_header(0, SAMPLE_RATE))
                out.write(np.asarray(r.x, "<f4").tobytes())
        if out is not None:
            close()
        yield pd.DataFrame({"label": done})

    df.where("label is not null and x is not null").repartition("label").sortWithinPartitions("label", "vec_id").mapInPandas(write, "label long").write.format("noop").mode("overwrite").save()


UTTERANCE_SQL = """
ev AS (SELECT user_id, event_id, value, event_type, epoch_us(ts) AS us, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS min_us
       FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
u0 AS (SELECT user_id AS recording_id, event_id AS ordinal, CAST((us - min_us) // 1000 % 3600000 AS DOUBLE) / 1000.0::DOUBLE AS s0,
              value / 100.0::DOUBLE AS len, event_type AS text FROM ev),
utt AS (SELECT *, max(s0 + len) OVER (PARTITION BY recording_id) + 1.0::DOUBLE AS duration FROM u0),
rec AS (SELECT recording_id, max(duration) AS duration FROM utt GROUP BY recording_id),
w0 AS (SELECT recording_id, duration, greatest(1, CAST(ceil(duration / 120.0::DOUBLE) AS BIGINT)) AS cnt FROM rec),
w1 AS (SELECT *, unnest(range(0, cnt)) AS idx FROM w0),
w2 AS (SELECT *, idx * 120.0::DOUBLE AS core_start, least(duration, (idx + 1) * 120.0::DOUBLE) AS core_end FROM w1),
win AS (SELECT *, greatest(0.0::DOUBLE, core_start - CASE WHEN idx > 0 THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END) AS infer_start,
               least(duration, core_end + CASE WHEN idx + 1 < cnt THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END) AS infer_end FROM w2)
"""

HEARD_SQL = (
    UTTERANCE_SQL
    + """,
chunk AS (SELECT w.*, u.ordinal, u.text, u.s0 - w.infer_start AS start_ts, u.s0 + u.len - w.infer_start AS end_ts
          FROM utt u JOIN win w ON u.recording_id = w.recording_id AND u.s0 >= w.infer_start AND u.s0 < w.infer_end),
c1 AS (SELECT *, least(duration, infer_start + greatest(0.0::DOUBLE, start_ts)) AS s,
              least(duration, infer_start + greatest(end_ts, start_ts + 0.05::DOUBLE)) AS e FROM chunk WHERE text <> ''),
seg AS (SELECT recording_id, duration, idx, ordinal, s AS start, greatest(e, s + 0.05::DOUBLE) AS "end", text FROM c1
        WHERE (s + e) / 2.0::DOUBLE >= core_start
          AND ((s + e) / 2.0::DOUBLE < core_end OR (idx = cnt - 1 AND (s + e) / 2.0::DOUBLE <= core_end)))
"""
)

LONG_SQL = UTTERANCE_SQL.replace("value / 100.0::DOUBLE AS len", "value / 10.0::DOUBLE AS len")
