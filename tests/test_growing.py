"""Growing recordings: pieces in any split and order, and a restart in the middle, give the transcript of the whole file."""

import io
import wave

import numpy as np
import pytest

from larkspool.operators.recognise import loudness_stub
from larkspool.plans.options import RunOptions, Variant
from larkspool.plans.transcribe import transcribe_files
from larkspool.streaming.growing import PIECES, transcribe_growing


def signal(seed, seconds):
    rng = np.random.default_rng(seed)
    x = np.zeros(int(16_000 * seconds))
    for _ in range(int(seconds / 4)):
        a = int(rng.uniform(0, len(x)))
        x[a : a + int(rng.uniform(0.3, 6) * 16_000)] = 0.5
    return np.rint(x * 32_767).astype("<i2")


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_pieces_give_the_whole(rocks, tmp_path):
    spark = rocks
    lengths = {"a": 95.3, "b": 30.0, "c": 60.0, "d": 0.2, "e": 34.0, "f": 150.01}
    files, pieces = tmp_path / "files", tmp_path / "pieces"
    files.mkdir()
    rng = np.random.default_rng(8)
    batches: list[list[tuple]] = [[] for _ in range(4)]
    for i, (name, seconds) in enumerate(lengths.items()):
        x = signal(i, seconds)
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(2)
            f.setframerate(16_000)
            f.writeframes(x.tobytes())
        (files / f"{name}.wav").write_bytes(out.getvalue())
        y = (x.astype(np.float64) / 32_768).astype(np.float32)
        cuts = sorted({0, len(y), *rng.integers(0, len(y), 9).tolist()})
        made = [(f"{name}.wav", k, y[a:b].tobytes(), b == len(y)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        made.append((f"{name}.wav", len(made) - 1, made[-1][2], True))  # sent twice
        for row in made:
            batches[int(rng.integers(0, 4))].append(row)  # in any order, over all batches
    options = RunOptions(window_seconds=30.0, variants=(Variant("A", suffix="_A"), Variant("B", suffix="_B")))

    def send(batch):
        spark.createDataFrame(batch, PIECES).repartition(2).write.mode("append").parquet(str(pieces))

    def go():
        stream = spark.readStream.schema(PIECES).option("maxFilesPerTrigger", 1).parquet(str(pieces))
        transcribe_growing(stream, str(tmp_path / "out"), str(tmp_path / "check"), loudness_stub, options).awaitTermination()

    send(batches[0])
    send(batches[1])
    go()  # the stream ends in the middle
    send(batches[2])
    send(batches[3])
    go()
    transcribe_files(spark, str(files), str(tmp_path / "want"), loudness_stub, options)
    got, want = ({p.name: p.read_bytes() for p in (tmp_path / d).iterdir()} for d in ("out", "want"))
    assert got == want and len(want) == 24
