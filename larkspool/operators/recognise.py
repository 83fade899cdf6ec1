"""Recognisers: what turns the samples of a window into timed text."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.accumulators import Accumulator, AccumulatorParam
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame

from ..plans.options import GenerationConfig, Variant

RESULT_SCHEMA = (
    "recording_id string, stem string, variant string, suffix string, duration double, cnt long, idx long, core_start double, core_end double, infer_start double, infer_end double, "
    "elapsed double, chunks array<struct<ordinal:int,start_ts:double,end_ts:double,text:string>>, texts array<string>, repr string"
)


@dataclass
class Recognised:
    """Chunks (start, end, text), whole texts, and the result's own text form, used in this order."""

    chunks: list[tuple[float, float, str]] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    repr: str = ""


#: Takes a variant and a configuration; returns the function that recognises the samples of a window.
Loader = Callable[[Variant, GenerationConfig], Callable[[np.ndarray, GenerationConfig], Recognised]]


def loudness_stub(variant: Variant, config: GenerationConfig) -> Callable[[np.ndarray, GenerationConfig], Recognised]:
    """A stand-in without a model: one chunk for each run of whole seconds that are not silent."""

    def recognise(samples: np.ndarray, config: GenerationConfig) -> Recognised:
        rate = 16_000
        loud = [bool(np.abs(samples[i : i + rate]).max() > 0.01) for i in range(0, len(samples), rate)]
        chunks, start = [], None
        for i, on in enumerate([*loud, False]):
            if on and start is None:
                start = i
            elif not on and start is not None:
                chunks.append((float(start), float(min(i, len(samples) / rate)), f"sound {i - start}"))
                start = None
        return Recognised(chunks, [], "")

    return recognise


class WindowsDone(AccumulatorParam):
    """Adds up (seconds of audio, windows)."""

    def zero(self, value: tuple[float, int]) -> tuple[float, int]:
        return 0.0, 0

    def addInPlace(self, a: tuple[float, int], b: tuple[float, int]) -> tuple[float, int]:
        return a[0] + b[0], a[1] + b[1]


def device_profile(device: str, amount: int = 1, cores: int | None = None) -> ResourceProfile:
    """Resources of the recognition stage: so many devices of a kind for each executor and one for each task, so that a
    device has one model at a time. Executors need the kind's discovery script in their configuration."""
    executor = ExecutorResourceRequests().resource(device.lower(), amount)
    if cores:
        executor = executor.cores(cores)
    return ResourceProfileBuilder().require(executor).require(TaskResourceRequests().cpus(max(1, (cores or amount) // amount)).resource(device.lower(), 1)).build


def recognise(windows: DataFrame, load: Loader, variants: tuple[Variant, ...], config: GenerationConfig, profile: ResourceProfile | None = None, done: Accumulator | None = None) -> DataFrame:
    """Results of every window by every variant, and elapsed, the seconds each took. A model is loaded once by each Python worker that needs it.

    An error in a window fails its task, which Spark repeats. With profile (see device_profile), the stage runs where its
    resources are. done, a WindowsDone
    accumulator, adds up what all variants have recognised, as tasks end.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {}
        for batch in batches:
            out = []
            for r in batch.itertuples():
                samples = np.frombuffer(r.pcm, np.float32)
                for v in variants:
                    if v.label not in models:
                        models[v.label] = load(v, config)
                    began = time.perf_counter()
                    found = models[v.label](samples, config)
                    elapsed = time.perf_counter() - began
                    if done is not None:
                        done.add((r.core_end - r.core_start, 1))
                    chunks = [{"ordinal": i, "start_ts": s, "end_ts": e, "text": str(t)} for i, (s, e, t) in enumerate(found.chunks)]
                    out.append((r.recording_id, r.stem, v.label, v.suffix, r.duration, r.cnt, r.idx, r.core_start, r.core_end, r.infer_start, r.infer_end, elapsed, chunks, list(found.texts), found.repr))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT_SCHEMA.split(", ")])

    return windows.mapInPandas(run, RESULT_SCHEMA, profile=profile)
