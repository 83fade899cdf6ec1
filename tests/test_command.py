"""Exit codes and results of the command line."""

import io
import wave

import numpy as np

from larkspool.__main__ import main


def test_command(spark, tmp_path, capsys):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(16_000)
        f.writeframes(np.full(32_000, 9000, "<i2").tobytes())
    (tmp_path / "talk.wav").write_bytes(out.getvalue())
    (tmp_path / "bad.wav").write_bytes(b"no audio")
    model, talk = ["--model-dir", str(tmp_path)], str(tmp_path / "talk.wav")
    assert main([talk, *model, "--beams", "0"]) == 2
    assert main([str(tmp_path / "none.wav"), *model]) == 2
    assert main([talk, "--model-dir", str(tmp_path / "none")]) == 3
    assert main([str(tmp_path / "bad.wav"), *model], spark) == 1
    assert main([talk, *model, "--devices-per-executor", "-1"]) == 2
    assert main([talk, *model, "--output-suffix", "_x", "--metrics-dir", str(tmp_path / "metrics")], spark) == 0
    said = capsys.readouterr()
    assert "transcripts: 1, audio: 2.0 s, recognition: " in said.out and "100.0%  00:02 / 00:02  window 1/1 ETA 00:00" in said.err
    assert [(r.variant, r.duration) for r in spark.read.parquet(str(tmp_path / "metrics")).collect()] == [("", 2.0)]
    assert (tmp_path / "talk_x.txt").read_text("utf-8-sig") == "sound 2\n"
    assert main([talk, *model, "--compare", "--output-dir", str(tmp_path / "o")], spark) == 0
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["talk_FP16.srt", "talk_FP16.txt", "talk_INT8.srt", "talk_INT8.txt"]


def test_devices_are_asked_for(spark, tmp_path, monkeypatch):
    """The command's option becomes the resources of recognition."""
    import larkspool.__main__ as command

    asked = []

    def run(*args, profile=None, **more):
        asked.append(profile)
        raise KeyboardInterrupt

    monkeypatch.setattr(command, "transcribe_files", run)
    (tmp_path / "talk.wav").write_bytes(b"")
    for extra in ([], ["--devices-per-executor", "2", "--device", "NPU"]):
        assert main([str(tmp_path / "talk.wav"), "--model-dir", str(tmp_path), *extra], spark) == 130
    assert asked[0] is None and asked[1].executorResources["npu"].amount == 2 and asked[1].taskResources["npu"].amount == 1.0
