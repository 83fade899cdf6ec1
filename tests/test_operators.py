"""Unit tables and properties of the transcript operators."""

import io
import math
import struct
import wave

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspool.functions import text as T
from larkspool.operators.audio import normalise
from larkspool.operators.metrics import progress_bar, progress_line, progress_ratio
from larkspool.operators.recognise import Recognised, loudness_stub
from larkspool.operators.render import render
from larkspool.operators.segments import own_chunks, to_segments
from larkspool.operators.windows import plan_windows, sample_range
from larkspool.plans.options import RunOptions, Variant, model_complete, require_device
from larkspool.plans.transcribe import transcribe, transcribe_files
from larkspool.sources import media
from larkspool.sources.config import optional_entries
from larkspool.sources.media import decode, resample, scan
from larkspool.sources.media import Samples
from larkspool.sources.sinks import write_documents
from larkspool.streaming.media import transcribe_stream


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_subtitle_time(spark):
    values = [-1.0, 0.0, 0.0005, 0.0015, 59.9995, 3599.9999, 360000.0, 1.5, float("nan")]
    want = ["00:00:00,000", "00:00:00,000", "00:00:00,000", "00:00:00,002", "00:01:00,000", "01:00:00,000", "100:00:00,000", "00:00:01,500", "00:00:00,000"]
    assert column(spark, values, "double", T.subtitle_time) == want


def test_clock(spark):
    assert column(spark, [-3.0, 0.5, 1.5, 59.5, 3599.5, 36000.0], "double", T.clock) == ["00:00", "00:00", "00:02", "01:00", "1:00:00", "10:00:00"]


def test_fixed_follows_binary_value(spark):
    values = [0.05, 0.15, 0.25, 2.675, 1.005, 1234.5]
    assert column(spark, values, "double", lambda c: T.fixed(c, 1)) == [f"{v:.1f}" for v in values]
    assert column(spark, values, "double", lambda c: T.fixed(c, 2)) == [f"{v:.2f}" for v in values]


def test_strip_and_config_text(spark):
    values = ["　 a \x1c", " ", "", None, "﻿# no\r\n b # in\x0bc \x85 # d\n\n e"]
    assert column(spark, values, "string", T.strip)[:4] == ["a", "", "", None]
    assert column(spark, values, "string", T.config_text)[-2:] == ["", "b # in, c, e"]


def test_python_max_min(spark):
    nan, inf = float("nan"), float("inf")
    pairs = [(a, b) for a in (nan, 0.0, 1.0, -2.0, inf) for b in (nan, 0.0, 1.0, -2.0, inf)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a double, b double")
    rows = df.select("i", T.first_max(F.col("a"), F.col("b")), T.first_min(F.col("a"), F.col("b"))).orderBy("i").collect()
    for (a, b), (_, hi, lo) in zip(pairs, rows, strict=True):
        assert repr(float(hi)) == repr(max(a, b)) and repr(float(lo)) == repr(min(a, b))


def test_stem(spark):
    assert column(spark, ["/x/a.b.wav", "talk.mp3", "/y/plain"], "string", T.stem) == ["a.b", "talk", "plain"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0.01, 2000), min_size=1, max_size=5), st.sampled_from([30.0, 45.5, 120.0]), st.sampled_from([0.0, 4.0, 14.9]))
def test_windows_cover(spark, durations, window, overlap):
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(durations)], "recording_id string, duration double")
    for i, d in enumerate(durations):
        rows = plan_windows(df.where(F.col("recording_id") == str(i)), window, overlap).orderBy("idx").collect()
        assert len(rows) == max(1, math.ceil(d / window)) == rows[0].cnt
        assert rows[0].core_start == 0 and rows[-1].core_end == d
        assert all(a.core_end == b.core_start for a, b in zip(rows, rows[1:]))
        assert all(r.infer_start <= r.core_start and r.infer_end >= r.core_end for r in rows)


WINDOW = "duration double, idx long, cnt long, core_start double, core_end double, infer_start double, infer_end double"


def test_ownership_edges(spark):
    nan = float("nan")
    rows = [
        (240.0, 0, 2, 0.0, 120.0, 0.0, 124.0, 0, 119.0, 121.0, "on the edge"),  # midpoint 120 belongs to the next
        (240.0, 1, 2, 120.0, 240.0, 116.0, 240.0, 0, 3.0, 5.0, "on the edge"),
        (240.0, 1, 2, 120.0, 240.0, 116.0, 240.0, 1, 124.0, 124.0, " end "),  # last window owns its end
        (240.0, 0, 2, 0.0, 120.0, 0.0, 124.0, 1, -5.0, -4.0, "negative"),  # start clamps, end doesn't
        (240.0, 0, 2, 0.0, 120.0, 0.0, 124.0, 2, 1.0, nan, "nan end"),  # ends with the recording: midpoint past the core
        (240.0, 0, 2, 0.0, 120.0, 0.0, 124.0, 3, 1.0, 2.0, " 　"),
    ]
    df = spark.createDataFrame(rows, f"{WINDOW}, ordinal int, start_ts double, end_ts double, text string")
    got = {(r.idx, r.text): (r.start, round(r.end, 6)) for r in own_chunks(df).collect()}
    assert got == {(1, "on the edge"): (119.0, 121.0), (1, "end"): (240.0, 240.05)}


def test_missing_time_is_an_error(spark):
    df = spark.createDataFrame([(10.0, 0, 1, 0.0, 10.0, 0.0, 10.0, 0, None, 1.0, "x")], f"{WINDOW}, ordinal int, start_ts double, end_ts double, text string")
    with pytest.raises(Exception, match="no time stamp"):
        own_chunks(df).collect()


def test_long_utterances_are_kept_once_or_twice(spark):
    """Utterances up to twice the overlap are kept once; longer ones that span a boundary are kept on both sides."""
    d, w, v = 500.0, 120.0, 4.0
    utt = [(i, 3.7 * i + 0.123, (i % 40) / 2 + 0.2) for i in range(120)]
    rows, want = [], {}
    for i, s, n in utt:
        e = s + n
        want[i] = 1 + sum(s < b - v and e >= b + v for b in (120.0, 240.0, 360.0, 480.0))
        for k in range(5):
            lo, hi = max(0.0, k * w - v * (k > 0)), min(d, (k + 1) * w + v * (k < 4))
            if s < hi and e > lo:
                rows.append((d, k, 5, k * w, min(d, (k + 1) * w), lo, hi, i, max(s, lo) - lo, min(e, hi) - lo, str(i)))
    df = spark.createDataFrame(rows, f"{WINDOW}, ordinal int, start_ts double, end_ts double, text string")
    got = {int(r.text): r["count"] for r in own_chunks(df).groupBy("text").count().collect()}
    assert got == {i: c for i, c in want.items() if i in got} and set(got) == {i for i, s, _ in utt if s < d}


def test_fallback(spark):
    kind = "array<struct<ordinal:int,start_ts:double,end_ts:double,text:string>>"
    base = (10.0, 0, 1, 0.0, 10.0, 0.0, 10.0)
    rows = [("a", *base, [], ["", "x"], "repr"), ("b", *base, [], [], " repr "), ("c", *base, [(0, 1.0, 2.0, " ")], ["no"], "no"), ("d", *base, None, None, "r")]
    df = spark.createDataFrame(rows, f"recording_id string, {WINDOW}, chunks {kind}, texts array<string>, repr string")
    got = {r.recording_id: (r.start, r.end, r.text) for r in to_segments(df).collect()}
    assert got == {"b": (0.0, 10.0, "repr"), "d": (0.0, 10.0, "r")}


def test_render_orders_ties_and_keeps_silent_recordings(spark):
    rows = [("a", 9.0, 1, 0, 1.0, 2.0, "second"), ("a", 9.0, 0, 5, 1.0, 2.0, "first\nline"), ("a", 9.0, 0, 0, 0.0, 1.0, "start"), ("b", 9.0, 0, -1, 0.0, 9.0, None)]
    df = spark.createDataFrame(rows, "recording_id string, duration double, idx long, ordinal int, start double, end double, text string")
    for n in (1, 5):
        got = {r.recording_id: r for r in render(df.repartition(n), ["recording_id"]).collect()}
        assert got["a"].txt == "start\nfirst\nline\nsecond\n"
        assert got["a"].srt == "1\n00:00:00,000 --> 00:00:01,000\nstart\n\n2\n00:00:01,000 --> 00:00:02,000\nfirst\nline\n\n3\n00:00:01,000 --> 00:00:02,000\nsecond\n"
        assert (got["b"].txt, got["b"].srt) == ("\n", "")


def test_progress(spark):
    assert column(spark, [0.0, 0.5, 1.0, 1 / 56, 3 / 56], "double", progress_bar) == ["-" * 28, "#" * 14 + "-" * 14, "#" * 28, "-" * 28, "##" + "-" * 26]
    df = spark.createDataFrame([(60.0, 120.0, 30.0, 1, 2), (0.0, 120.0, 1.0, 0, 2), (5.0, 0.0, 1.0, 1, 1)], "d double, t double, e double, i long, c long")
    lines = [r[0] for r in df.select(progress_line(F.col("d"), F.col("t"), F.col("e"), F.col("i"), F.col("c"))).collect()]
    assert lines[0].endswith(" 50.0%  01:00 / 02:00  window 1/2 ETA 00:30") and lines[1].endswith("window 0/2") and lines[2].endswith("ETA 00:00")
    assert df.select(progress_ratio(F.col("d"), F.col("t"))).first()[0] == 0.5


@pytest.mark.parametrize("peak", [0.9, 1.03, 1.2])
def test_normalise(peak):
    x = np.linspace(-peak, peak, 101, dtype=np.float32)
    want = np.clip(x / np.float32(np.abs(x).max()) if peak > 1.05 else x, -1, 1)
    assert np.array_equal(normalise(x), want.astype(np.float32))
    assert np.isnan(normalise(np.array([np.nan, 2.0], np.float32))[0])


def wav(samples, rate=16_000, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        x = np.repeat(np.asarray(samples), channels)
        f.writeframes(np.rint(x * 32767).astype("<i2").tobytes() if width == 2 else np.rint(x * 127 + 128).astype(np.uint8).tobytes())
    return out.getvalue()


def test_decode():
    x = np.sin(np.arange(16_000) / 20) * 0.5
    assert np.allclose(decode(wav(x), "wav"), x, atol=1e-4)
    assert np.allclose(decode(wav(x, channels=2), "wav"), x, atol=1e-4)
    assert np.allclose(decode(wav(x, width=1), "wav"), x, atol=1e-2)
    assert len(decode(wav(x, rate=44_100), "wav")) == round(16_000 * 16_000 / 44_100)
    assert len(resample(Samples(np.zeros(0, np.float32), 8000))) == 0
    with pytest.raises(ValueError, match="no decoder"):
        decode(b"", "mp3")
    with pytest.raises(ValueError, match="no samples"):
        decode(wav([]), "wav")


def test_run_and_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    x = np.zeros(16_000 * 130)
    x[16_000 * 3 : 16_000 * 5] = 0.5
    x[16_000 * 119 : 16_000 * 122] = 0.5
    (src / "talk.v1.wav").write_bytes(wav(x))
    (src / "quiet.wav").write_bytes(wav(np.zeros(16_000)))
    (src / "notes.txt").write_text("not media")
    options = RunOptions(variants=(Variant("A", suffix="_A"), Variant("B", suffix="_B")))
    docs = transcribe(spark, str(src), loudness_stub, options, only_media=True)
    write_documents(docs, str(out))
    write_documents(docs, str(out))
    assert sorted(p.name for p in out.iterdir()) == sorted(f"{n}_{v}.{k}" for n in ("talk.v1", "quiet") for v in "AB" for k in ("txt", "srt"))
    assert (out / "talk.v1_A.txt").read_text("utf-8") == "﻿sound 2\nsound 3\n"
    assert (out / "quiet_B.srt").read_text("utf-8") == "﻿"
    assert "2\n00:01:59,000 --> 00:02:02,000" in (out / "talk.v1_B.srt").read_text("utf-8-sig")
    (src / "broken.wav").write_bytes(b"RIFF no")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    transcribe_stream(spark, str(src), str(tmp_path / "again"), str(tmp_path / "check"), loudness_stub, errors=str(tmp_path / "errors")).awaitTermination()
    assert [r.recording_id.rpartition("/")[2] for r in spark.read.json(str(tmp_path / "errors")).collect()] == ["broken.wav"]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert sorted(p.name for p in (tmp_path / "again").iterdir()) == ["quiet.srt", "quiet.txt", "talk.v1.srt", "talk.v1.txt"]


def test_each_window_is_recognised_once(spark, tmp_path):
    """A run of two variants over files of 1 and 2 windows calls the recogniser six times; clashing names call it never."""
    src, calls = tmp_path / "in", tmp_path / "calls"
    src.mkdir()
    calls.mkdir()
    (src / "a.wav").write_bytes(wav(np.zeros(16_000 * 130)))
    (src / "b.wav").write_bytes(wav(np.zeros(16_000)))

    def counting(variant, config, top=str(calls)):
        import uuid

        from larkspool.operators.recognise import Recognised

        def run(samples, config):
            open(f"{top}/{uuid.uuid4().hex}", "w").close()
            return Recognised([], ["x"], "")

        return run

    options = RunOptions(variants=(Variant("A", suffix="_A"), Variant("B", suffix="_B")))
    transcribe_files(spark, str(src), str(tmp_path / "out"), counting, options)
    assert len(list(calls.iterdir())) == 6 and len(list((tmp_path / "out").iterdir())) == 8
    with pytest.raises(ValueError, match="2 results"):
        transcribe_files(spark, str(src), str(tmp_path / "out"), counting, RunOptions(variants=(Variant("A"), Variant("B"))))
    assert len(list(calls.iterdir())) == 6


def test_run_and_plan_cut_alike(spark, tmp_path):
    """The windows of a run are those of plan_windows, samples included."""
    for i, n in enumerate((0.3, 119.99, 120.0, 120.01, 240.0, 367.25)):
        (tmp_path / f"{i}.wav").write_bytes(wav(np.zeros(int(16_000 * n))))
    rows = media.window_samples(scan(spark, str(tmp_path)), 120.0, 4.0).select("recording_id", "duration", "cnt", "idx", "core_start", "core_end", "infer_start", "infer_end", (F.length("pcm") / 4).cast("long").alias("samples")).collect()
    durations = spark.createDataFrame(sorted({(r.recording_id, r.duration) for r in rows}), "recording_id string, duration double")
    plan = sample_range(plan_windows(durations)).select("recording_id", "duration", "cnt", "idx", "core_start", "core_end", "infer_start", "infer_end", (F.col("sample_end") - F.col("sample_start")).alias("samples")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, plan))


def test_float_and_extensible_wav():
    x = np.array([0.5, -2.0, 1.0, 0.25], np.float32)

    def riff(kind, bits, body, more=b""):
        fmt = struct.pack("<HHIIHH", kind, 1, 16_000, 16_000 * bits // 8, bits // 8, bits) + more
        return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body)) + body

    extended = struct.pack("<HHI", 22, 32, 0) + struct.pack("<H", 3) + bytes(14)
    for content in (riff(3, 32, x.tobytes()), riff(3, 64, x.astype("<f8").tobytes()), riff(0xFFFE, 32, x.tobytes(), extended)):
        assert np.array_equal(media.decode_wav(content).values, x)
        assert np.allclose(media.decode(content, "wav"), x / 2)  # a peak of 2 is scaled down
    for bad in (b"", b"RIFF no", riff(7, 8, b"x"), riff(3, 16, b"xx")):
        with pytest.raises(ValueError):
            media.decode(bad, "wav")


def test_resampling_down_does_not_alias():
    """A tone above the new band is gone, one inside it stays."""
    t = np.arange(48_000) / 48_000
    high, low = (media.resample(media.Samples(np.sin(2 * np.pi * f * t).astype(np.float32), 48_000)) for f in (11_000, 1_000))
    assert len(high) == 16_000 and np.abs(high[200:-200]).max() < 0.02 and abs(np.abs(low[200:-200]).max() - 1) < 0.02


def test_clashing_names_are_refused(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", "y"), ("a", "x", "z")], "name string, txt string, srt string")
    with pytest.raises(ValueError, match="2 results"):
        write_documents(df, str(tmp_path))


def test_scan_and_config_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"1")
    (tmp_path / "b.TXT").write_bytes("﻿# x\n one \ntwo".encode())
    assert scan(spark, str(tmp_path)).count() == 2
    assert [r.stem for r in scan(spark, str(tmp_path), only_media=True).collect()] == ["a"]
    assert optional_entries(spark, str(tmp_path / "none.txt")) == ""
    assert optional_entries(spark, str(tmp_path / "b.TXT")) == "one, two"
    with pytest.raises(ValueError):
        optional_entries(spark, str(tmp_path))


def test_options(tmp_path):
    for bad in ({"beams": 0}, {"window_seconds": 29.0}, {"window_seconds": float("nan")}, {"overlap_seconds": 60.0}, {"overlap_seconds": -1.0}, {"window_seconds": float("inf")}):
        with pytest.raises(ValueError):
            RunOptions(**bad)
    assert RunOptions(beams=3, hotwords="x").generation().num_beams == 3
    assert RunOptions(device="gpu.1").cache_name("FP16") == "cache_fp16_GPU_1" and RunOptions(device="CPU").cache_name("x") is None
    assert require_device("npu", ["CPU", "NPU.0"]) == "NPU.0"
    with pytest.raises(ValueError):
        require_device("GPU", ["CPU"])
    assert not model_complete(str(tmp_path))


def test_stub_is_a_recogniser():
    load = loudness_stub(Variant("x"), RunOptions().generation())
    assert load(np.zeros(16_000, np.float32), None) == Recognised([], [], "")


def test_stream_names(spark, tmp_path):
    """A name belongs to the recording that came first; later ones are noted and pass, and do so again if a batch is repeated."""
    src, out, check, errors = (tmp_path / n for n in ("in", "out", "check", "errors"))
    (src / "a").mkdir(parents=True)
    (src / "b").mkdir()

    def go(options=None):
        transcribe_stream(spark, str(src / "*"), str(out), str(check), loudness_stub, options, errors=str(errors), metrics=str(tmp_path / "metrics")).awaitTermination()

    loud, quiet = wav(np.full(16_000 * 3, 0.5)), wav(np.zeros(16_000))
    (src / "a" / "talk.wav").write_bytes(loud)
    (src / "b" / "talk.wav").write_bytes(quiet)
    go()
    assert sorted(p.name for p in out.iterdir()) == ["talk.srt", "talk.txt"] and (out / "talk.txt").read_text("utf-8-sig") == "sound 3\n"
    (src / "b" / "talk.wav").unlink()
    (src / "b" / "talk.ogg").write_bytes(b"?")
    (src / "b" / "new.wav").write_bytes(quiet)
    go()
    assert (out / "talk.txt").read_text("utf-8-sig") == "sound 3\n" and (out / "new.txt").read_text("utf-8-sig") == "\n"
    noted = {(r.recording_id.rpartition("/in/")[2], r.error.split(":")[1].strip()[:7]) for r in spark.read.json(str(errors)).collect()}
    assert noted == {("b/talk.wav", "another"), ("b/talk.ogg", "another")}
    assert sorted(r.recording_id.rpartition("/")[2] for r in spark.read.parquet(str(tmp_path / "metrics")).collect()) == ["new.wav", "talk.wav"]


def test_progress_text_is_the_column(spark):
    from larkspool.operators.metrics import progress_text

    rows = [(60.0, 120.0, 30.0, 1, 2), (0.0, 120.0, 1.0, 0, 2), (5.0, 0.0, 1.0, 1, 1), (3599.5, 9000.0, 77.7, 3, 9), (9000.0, 9000.0, 1.0, 9, 9), (1.0, 56.0, 2.5, 1, 3)]
    df = spark.createDataFrame(rows, "d double, t double, e double, i long, c long")
    got = {(r.d, r.t): r.x for r in df.withColumn("x", progress_line(F.col("d"), F.col("t"), F.col("e"), F.col("i"), F.col("c"))).collect()}
    assert got == {r[:2]: progress_text(*r) for r in rows}
