"""Recordings that are still growing: pieces of samples come as a stream, and each window is recognised once it is complete.

The state of a recording is what its unfinished windows need: about a window and its overlaps of samples, and pieces
that came too early. At the end mark the last windows follow, the state goes, and the transcript is rendered from the
results of all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.recognise import RESULT_SCHEMA, Loader
from ..operators.render import file_lines
from ..operators.windows import SAMPLE_RATE
from ..plans.options import RunOptions
from ..plans.transcribe import KEYS, results_of, segments_of, with_names
from ..shipping import ship
from ..sources.sinks import Store, write_lines

#: Pieces of recordings: samples are float32 at SAMPLE_RATE, mono; seq counts a recording's pieces from 0; last marks its end.
PIECES = "recording_id string, seq long, pcm binary, last boolean"
#: Complete windows, and a row without pcm at a recording's end, of which alone cnt and duration are known.
WINDOWS = "recording_id string, stem string, duration double, cnt long, idx long, core_start double, core_end double, infer_start double, infer_end double, pcm binary"
_NAMES = [c.split()[0] for c in WINDOWS.split(", ")]
#: What is known of a recording: the next piece and window, the place of the first sample kept, and whether it has ended.
_KNOWN = "next_seq long, next_idx long, base long, ended boolean, kept binary"


class WindowCutter(StatefulProcessor):
    """Cuts each recording into its windows as pieces come, in any order and number; repeated pieces are passed over."""

    def __init__(self, window: float, overlap: float):
        self.window, self.overlap = float(window), float(overlap)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", _KNOWN)
        self.early = handle.getMapState("early", "seq long", "pcm binary, last boolean")

    def close(self) -> None:
        pass

    def _window(self, recording: str, idx: int, end: float, last: bool, base: int, samples: np.ndarray) -> tuple:
        """A window's row, from the samples from base on. end is the recording's, or far off while that isn't known."""
        core = idx * self.window, min(end, (idx + 1) * self.window)
        start, stop = max(0.0, core[0] - self.overlap * (idx > 0)), min(end, core[1] + self.overlap * (not last))
        a, b = int(np.rint(start * SAMPLE_RATE)), int(np.rint(stop * SAMPLE_RATE))
        pcm = np.clip(samples[a - base : b - base], -1.0, 1.0).astype(np.float32).tobytes()
        stem = recording.rpartition("/")[2]
        return recording, stem.rpartition(".")[0] or stem, None, None, idx, *core, start, stop, pcm

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recording = key[0]
        next_seq, idx, base, ended, kept = self.known.get() if self.known.exists() else (0, 0, 0, False, b"")
        for batch in rows:
            for r in batch.itertuples():
                if not ended and r.seq >= next_seq:
                    self.early.updateValue((int(r.seq),), (r.pcm or b"", bool(r.last)))
        held, last = [np.frombuffer(kept, np.float32)], False
        while not ended and not last and self.early.containsKey((next_seq,)):
            pcm, last = self.early.getValue((next_seq,))
            self.early.removeKey((next_seq,))
            held.append(np.frombuffer(pcm, np.float32))
            next_seq += 1
        samples = np.concatenate(held)
        out, n = [], base + len(samples)
        while True:
            core_end = (idx + 1) * self.window
            if n <= int(np.rint(core_end * SAMPLE_RATE)) or n < int(np.rint((core_end + self.overlap) * SAMPLE_RATE)):
                break
            out.append(self._window(recording, idx, float("inf"), False, base, samples))
            idx += 1
        if last and n:
            end = n / SAMPLE_RATE
            cnt = max(1, int(np.ceil(end / self.window)))
            out += [self._window(recording, i, end, i == cnt - 1, base, samples) for i in range(idx, cnt)]
            out.append((recording, None, end, cnt, *[None] * 6))
        if last or ended:
            self.early.clear()
            self.known.update((next_seq, idx, base, True, b""))  # so that what comes late starts no new recording
        else:
            first = max(base, int(np.rint(max(0.0, idx * self.window - self.overlap) * SAMPLE_RATE)))
            self.known.update((next_seq, idx, first, False, samples[first - base :].tobytes()))
        yield pd.DataFrame(out, columns=_NAMES)


def growing_windows(pieces: DataFrame, window: float, overlap: float) -> DataFrame:
    """Windows of a stream of pieces (PIECES) as they are complete, and a row for each end (WINDOWS).

    Where the samples of a recording are cut into pieces doesn't matter. A recording without any sample gives nothing.
    Samples past 1 are clipped: a peak is known at the end only, so signals that pass LOUD must be scaled before.
    """
    return pieces.groupBy("recording_id").transformWithStateInPandas(WindowCutter(window, overlap), WINDOWS, "Append", "None")


_ENDS = "recording_id string, duration double, cnt long"


def transcribe_growing(pieces: DataFrame, out: str, checkpoint: str, load: Loader, options: RunOptions | None = None, mounted: bool = False):
    """Recognise each window of growing recordings as it is complete, and write a recording's transcripts at its end.

    Results are kept below the checkpoint, one folder for each batch. A repeated batch overwrites its own. The session's state
    store must be one for such state (RocksDB).
    """
    options, spark = options or RunOptions(), pieces.sparkSession
    results, ends = f"{checkpoint}/results", f"{checkpoint}/ends"
    Store(spark, out, mounted)
    ship(spark)

    def batch(df: DataFrame, number: int) -> None:
        session = df.sparkSession
        df.write.mode("overwrite").parquet(f"{checkpoint}/windows")  # the state moves on once, whatever reads its rows
        df = session.read.schema(WINDOWS).parquet(f"{checkpoint}/windows")
        complete = df.where("pcm is not null").withColumns({"duration": F.lit(0.0), "cnt": F.lit(0).cast("long")})
        results_of(complete.repartition("recording_id", "idx"), load, options).write.mode("overwrite").parquet(f"{results}/batch={number}")
        df.where("pcm is null").select("recording_id", "duration", "cnt").write.mode("overwrite").parquet(f"{ends}/batch={number}")
        ended = session.read.schema(_ENDS).parquet(f"{ends}/batch={number}")
        if ended.isEmpty():
            return
        found = session.read.schema(RESULT_SCHEMA + ", batch long").parquet(results).where(F.col("batch") <= number).drop("batch", "duration", "cnt").join(ended, "recording_id")
        write_lines(with_names(file_lines(segments_of(found), KEYS), options), out, mounted)

    return growing_windows(pieces, options.window_seconds, options.overlap_seconds).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
