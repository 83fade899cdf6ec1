"""Recordings read in ranges: very large files, equal windows however they are cut, many tasks, peaks, resampling."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspool.operators import audio
from larkspool.operators.recognise import Recognised, device_profile, loudness_stub, recognise
from larkspool.plans.options import RunOptions, Variant
from larkspool.plans.transcribe import results_of, transcribe_files
from larkspool.sources import media, ranges
from larkspool.sources.wav import read_frames, read_layout


def header(kind, bits, channels, rate, size, long=False):
    fmt = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    ds64 = b"ds64" + struct.pack("<IQQQI", 28, size + 100, size, 0, 0) if long else b""
    known = 0xFFFFFFFF if long else size
    return (b"RF64" if long else b"RIFF") + struct.pack("<I", 0xFFFFFFFF if long else min(size + 36, 0xFFFFFFFF)) + b"WAVE" + ds64 + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", known)


def wav(samples, rate=16_000, kind=1, bits=16, channels=1):
    x = np.repeat(np.asarray(samples, np.float64), channels)
    body = x.astype(f"<f{bits // 8}").tobytes() if kind == 3 else np.rint(np.clip(x, -1, 1) * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()
    return header(kind, bits, channels, rate, len(body)) + body


@pytest.mark.parametrize("long", [False, True])
def test_more_than_a_row_can_hold(spark, tmp_path, long):
    """A sparse recording of 2.2 GiB (or 4.4 GiB, in RF64): its windows are read by many tasks, sounds far behind 2 GiB included."""
    frames = (1_180_000_000, 2_360_000_000)[long]
    spots = [3_000_000, 1_100_000_000, frames - 100]
    with open(tmp_path / "day.wav", "wb") as f:
        f.write(header(1, 16, 1, 16_000, 2 * frames, long))
        at = f.tell()
        f.truncate(at + 2 * frames)
        for s in spots:
            f.seek(at + 2 * s)
            f.write(struct.pack("<h", 20_000))
    plan = ranges.plan_ranges(ranges.listed(spark, str(tmp_path)), 1200.0, 4.0)
    windows = ranges.range_samples(plan)
    assert windows.rdd.getNumPartitions() >= 16
    got = windows.select("idx", "cnt", "duration", "infer_start", F.spark_partition_id().alias("task"), F.octet_length("pcm").alias("n"))
    if not long:  # all of it; the longer one only around its marks
        rows = got.orderBy("idx").collect()
        assert len(rows) == rows[0].cnt == -(-frames // (1200 * 16_000)) and rows[0].duration == frames / 16_000
        assert len({r.task for r in rows}) > 8 and sum(r.n for r in rows) == 4 * (frames + 8 * 16_000 * (len(rows) - 1))
    # windows around the marks hold them, at their places
    for s in spots:
        idx = s // (1200 * 16_000)
        near = ranges.range_samples(plan.where(F.col("idx") == idx), tasks=1).select("infer_start", "pcm").first()
        x = np.frombuffer(near.pcm, np.float32)
        assert np.flatnonzero(x).tolist() == [s - round(near.infer_start * 16_000)] and abs(x.max() - 20_000 / 32_768) < 1e-6


def test_ranges_cut_as_whole_files(spark, tmp_path):
    """Windows read in ranges equal those of whole files bit by bit: rates, kinds, channels, lengths at window edges, loud and broken peaks."""
    rng = np.random.default_rng(4)
    cases = {"plain": dict(), "stereo": dict(channels=2), "slow": dict(rate=8000), "cd": dict(rate=44_100), "studio": dict(rate=48_000, kind=3, bits=32), "deep": dict(kind=3, bits=64), "wide": dict(bits=32, rate=22_050)}
    for name, how in cases.items():
        for i, seconds in enumerate((0.0001, 29.99, 30.0, 30.01, 75.3)):
            n = max(1, round(seconds * how.get("rate", 16_000)))
            x = rng.uniform(-0.9, 0.9, n)
            if how.get("kind") == 3:
                x[n * (i + 1) // 7] = (1.04, 3.0, -2.5, 1.2, np.nan)[i]
            (tmp_path / f"{name}{i}.wav").write_bytes(wav(x, **how))
    columns = media.WINDOW_SCHEMA.replace(",", "").split()[::2]
    want = media.window_samples(media.scan(spark, str(tmp_path)), 30.0, 4.0).select(*columns).collect()
    for tasks in (1, 7):
        plan = ranges.plan_ranges(ranges.listed(spark, str(tmp_path)), 30.0, 4.0)
        got = ranges.range_samples(plan, tasks).select(*columns).collect()
        assert len(got) == len(want) == 56
        assert sorted(map(tuple, got), key=lambda r: (r[0], r[4])) == sorted(map(tuple, want), key=lambda r: (r[0], r[4]))


def test_filter_bank():
    """Parts equal the whole bit by bit; tones pass or are at least 60 dB down."""
    rng = np.random.default_rng(0)
    for old in (8000, 11_025, 44_100, 48_000, 16_001):
        x = rng.standard_normal(old // 2).astype(np.float32)
        n, m = len(x), audio.resampled_length(len(x), old, 16_000)
        whole = media.resample(media.Samples(x, old))
        cuts = sorted({0, m, *rng.integers(0, m, 15).tolist()})
        parts = [audio.resample_part(lambda a, b: x[a:b], n, a, b, old, 16_000) for a, b in zip(cuts, cuts[1:])]
        assert len(whole) == m and np.array_equal(np.concatenate(parts), whole)
    t = np.arange(44_100) / 44_100
    level = {f: media.resample(media.Samples(np.sin(2 * np.pi * f * t).astype(np.float32), 44_100))[500:-500].astype(float).std() * np.sqrt(2) for f in (100, 3000, 6000, 8200, 11_000, 21_000)}
    assert all(abs(level[f] - 1) < 0.005 for f in (100, 3000, 6000)) and all(level[f] < 1e-3 for f in (8200, 11_000, 21_000))
    t = np.arange(8000) / 8000
    y = media.resample(media.Samples(np.sin(2 * np.pi * 3000 * t).astype(np.float32), 8000))[1000:-1000]
    power = np.abs(np.fft.rfft(y * np.hanning(len(y))))
    assert power[np.fft.rfftfreq(len(y), 1 / 16_000) > 4200].max() < 1e-3 * power.max()
    assert np.array_equal(media.resample(media.Samples(np.full(3000, 0.25, np.float32), 44_100)), np.full(1088, 0.25, np.float32))


def test_layouts():
    x = np.linspace(-0.5, 0.5, 101)
    raw = wav(x, channels=2)
    f = io.BytesIO(raw[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + raw[12:] + b"odd tail")
    layout = read_layout(f)
    assert (layout.frames, layout.channels, layout.rate) == (101, 2, 16_000)
    assert np.allclose(read_frames(f, layout, 10, 20), x[10:20], atol=1e-4) and len(read_frames(f, layout, 5, 5)) == 0
    cut = read_layout(io.BytesIO(raw[:-7]))
    assert cut.frames == 99
    with pytest.raises(ValueError, match="ends before"):
        read_frames(io.BytesIO(raw[:-7]), layout, 0, 101)
    assert read_layout(io.BytesIO(wav([]))).frames == 0


def test_one_long_recording_keeps_many_tasks_busy(spark, tmp_path):
    """One file: its windows are recognised by more tasks than there are files, each once for each variant."""
    calls = tmp_path / "calls"
    calls.mkdir()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "long.wav").write_bytes(wav(np.zeros(16_000 * 400)))

    def counting(variant, config, top=str(calls)):
        import uuid

        from pyspark import TaskContext

        from larkspool.operators.recognise import Recognised

        def run(samples, config):
            open(f"{top}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}", "w").close()
            return Recognised([], ["x"], "")

        return run

    options = RunOptions(window_seconds=30.0, variants=(Variant("A", suffix="_A"), Variant("B", suffix="_B")))
    lines = []
    found = transcribe_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), counting, options, metrics=str(tmp_path / "metrics"), show=lines.append)
    made = [p.name for p in calls.iterdir()]
    assert len(made) == 14 * 2 and len({n.split("-")[0] for n in made}) >= 8
    # metrics of the real run, and its progress
    rows = spark.read.parquet(str(tmp_path / "metrics")).collect()
    assert sorted((r.variant, r.duration) for r in rows) == [("A", 400.0), ("B", 400.0)]
    assert all(0 < r.elapsed < 60 and r.rtf == r.elapsed / r.duration for r in rows)
    assert (found.transcripts, found.duration) == (2, 800.0) and abs(found.elapsed - sum(r.elapsed for r in rows)) < 1e-9
    assert lines[0].startswith("[----") and "window 0/14" in lines[0]
    assert lines[-1].startswith("[" + "#" * 28 + "] 100.0%  06:40 / 06:40  window 14/14 ETA 00:00")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["long_A.srt", "long_A.txt", "long_B.srt", "long_B.txt"]


def test_formats_without_ranges(spark, tmp_path, monkeypatch):
    """Another decoder's files are decoded whole and their windows dealt; a format without one is an error."""
    monkeypatch.setitem(media.DECODERS, "ogg", media.decode_wav)
    (tmp_path / "a.wav").write_bytes(wav(np.full(16_000 * 70, 0.1)))
    (tmp_path / "b.ogg").write_bytes(wav(np.full(16_000 * 70, 0.1)))
    rows = ranges.recording_windows(spark, str(tmp_path), 30.0, 4.0).select("stem", "idx", "pcm").collect()
    assert sorted((r.stem, r.idx) for r in rows) == [(s, i) for s in "ab" for i in range(3)]
    assert {(r.idx, bytes(r.pcm)) for r in rows if r.stem == "a"} == {(r.idx, bytes(r.pcm)) for r in rows if r.stem == "b"}
    (tmp_path / "c.mp3").write_bytes(b"?")
    with pytest.raises(Exception, match="no decoder for .mp3"):
        ranges.recording_windows(spark, str(tmp_path), 30.0, 4.0).count()


def test_bad_files(spark, tmp_path):
    (tmp_path / "bad.wav").write_bytes(b"RIFF no")
    (tmp_path / "none.wav").write_bytes(wav([]))
    (tmp_path / "good.wav").write_bytes(wav([0.1] * 100))
    files = ranges.listed(spark, str(tmp_path))
    with pytest.raises(Exception, match="not a WAV file|no samples"):
        ranges.range_samples(ranges.plan_ranges(files, 30.0, 4.0)).count()
    assert [r.stem for r in ranges.range_samples(ranges.plan_ranges(files, 30.0, 4.0, skip_unreadable=True)).collect()] == ["good"]
    assert {r.recording_id.rpartition("/")[2] for r in ranges.file_errors(media.scan(spark, str(tmp_path))).collect()} == {"bad.wav", "none.wav"}


@pytest.mark.parametrize("at", [0, 3, 6])
def test_peaks_of_parts(spark, at):
    """Parts are scaled as the whole signal would be, wherever its peak lies; NaN scales nothing; nulls and empty parts stay."""
    rng = np.random.default_rng(at)
    x = rng.uniform(-1, 1, (7, 50)).astype(np.float32)
    x[at, 11] = -2.5
    rows = [("a", i, v.tolist()) for i, v in enumerate(x)] + [("b", 0, [0.5, 1.04]), ("b", 1, []), ("b", 2, None), (None, 0, [4.0]), (None, 1, [2.0])]
    df = spark.createDataFrame(rows, "k string, i int, x array<float>").repartition(4)
    got = {(r.k, r.i): r.x for r in audio.normalise_parts(df, ["k"], "x").collect()}
    want = audio.normalise(x.ravel()).reshape(7, 50)
    assert all(np.array_equal(np.array(got["a", i], np.float32), want[i]) for i in range(7))
    assert got["b", 0] == [0.5, 1.0] and got["b", 1] == [] and got["b", 2] is None and got[None, 0] == [1.0] and got[None, 1] == [0.5]


def test_device_profile_is_on_the_plan(spark, tmp_path):
    """The stage of recognition asks for its devices; without a profile it asks for none."""
    profile = device_profile("NPU", 2, cores=4)
    assert profile.executorResources["npu"].amount == 2 and profile.taskResources["npu"].amount == 1.0 and profile.taskResources["cpus"].amount == 2.0
    (tmp_path / "a.wav").write_bytes(wav([0.1] * 100))
    windows = ranges.recording_windows(spark, str(tmp_path), 30.0, 4.0)
    for p in (None, profile):
        df = recognise(windows, loudness_stub, (Variant("x"),), RunOptions().generation(), p)
        node = df._jdf.queryExecution().logical()
        assert node.profile().isDefined() == (p is not None)
    assert [r.repr for r in results_of(windows, lambda v, c: lambda s, c: Recognised([], [], "said"), RunOptions()).collect()] == ["said"]
