"""The whole run: recordings to windows, results, segments and files."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import progress_text, run_metric
from ..operators.recognise import Loader, WindowsDone, recognise
from ..operators.render import file_lines, render
from ..operators.segments import to_segments
from ..shipping import ship
from ..sources.ranges import listed, recording_windows
from ..sources.sinks import Store, check_names, result_names, run_folder, write_lines
from .options import RunOptions

KEYS = ["recording_id", "stem", "variant", "suffix"]


def results_of(windows: DataFrame, load: Loader, options: RunOptions, profile: ResourceProfile | None = None, done=None) -> DataFrame:
    """Results of each window by each variant. Windows come dealt over tasks; their samples are read once for all variants."""
    ship(windows.sparkSession)
    return recognise(windows, load, options.variants, options.generation(), profile, done)


def segments_of(results: DataFrame) -> DataFrame:
    """Segments of each recording by each variant, and a row without text for each."""
    return to_segments(results.drop("elapsed"), with_silent=True)


def with_names(df: DataFrame, options: RunOptions) -> DataFrame:
    """df (stem, suffix) with name, that of its result files."""
    return result_names(df.withColumn("suffix", F.concat(F.coalesce("suffix", F.lit("")), F.lit(options.output_suffix))))


def documents_of(segments: DataFrame, options: RunOptions) -> DataFrame:
    """(recording_id, stem, variant, suffix, duration, txt, srt, name), one row per recording and variant."""
    return with_names(render(segments, KEYS), options)


def names_of(files: DataFrame, options: RunOptions) -> DataFrame:
    """(name) of every document that files will give, without decoding any."""
    suffixes = F.array(*[F.lit(v.suffix or "") for v in options.variants])
    return with_names(files.select("stem", F.explode(suffixes).alias("suffix")), options).select("name")


def transcribe(spark: SparkSession, path: str, load: Loader, options: RunOptions | None = None, only_media: bool = False, tasks: int | None = None) -> DataFrame:
    """Transcripts of the recordings of a path, one row each; nothing is written."""
    options = options or RunOptions()
    windows = recording_windows(spark, path, options.window_seconds, options.overlap_seconds, only_media, tasks)
    return documents_of(segments_of(results_of(windows, load, options)), options)


class _Progress:
    """Shows a line whenever more windows are done, until it is left."""

    def __init__(self, show: Callable[[str], None], done, total: float, windows: int, variants: int):
        self.show, self.done, self.total, self.windows, self.variants = show, done, total, windows, variants
        self.began, self.over = time.perf_counter(), threading.Event()
        self.thread = threading.Thread(target=self._watch, daemon=True)

    def _line(self) -> None:
        seconds, count = self.done.value
        self.show(progress_text(seconds / self.variants, self.total, time.perf_counter() - self.began, count // self.variants, self.windows))

    def _watch(self) -> None:
        last = None
        while not self.over.wait(0.5):
            if self.done.value != last:
                last = self.done.value
                self._line()

    def __enter__(self):
        self._line()
        self.thread.start()

    def __exit__(self, *error):
        self.over.set()
        self.thread.join()
        if error[0] is None:
            self._line()


def write_run(windows: DataFrame, store: Store, scratch: str, load: Loader, options: RunOptions, metrics: str | None = None, profile: ResourceProfile | None = None, done=None, mounted: bool = False) -> Row:
    """Recognise windows once into a table below scratch, and write transcripts and metrics from it. Gives the run's transcripts, duration and elapsed."""
    spark = windows.sparkSession
    results = results_of(windows, load, options, profile, done)
    results.write.parquet(f"{scratch}/results")
    results = spark.read.schema(results.schema).parquet(f"{scratch}/results")
    write_lines(with_names(file_lines(segments_of(results), KEYS), options), str(store), mounted)
    found = run_metric(results)
    if metrics:
        found.write.mode("append").parquet(metrics)
    zero = F.lit(0.0)
    return found.agg(F.count("*").alias("transcripts"), F.coalesce(F.sum("duration"), zero).alias("duration"), F.coalesce(F.sum("elapsed"), zero).alias("elapsed")).first()


def transcribe_files(
    spark: SparkSession,
    path: str,
    out: str,
    load: Loader,
    options: RunOptions | None = None,
    only_media: bool = False,
    metrics: str | None = None,
    profile: ResourceProfile | None = None,
    show: Callable[[str], None] | None = None,
    tasks: int | None = None,
    mounted: bool = False,
) -> Row:
    """The whole run with its files: names are checked first, then every window is recognised once by each variant.

    Results go to a table in a hidden folder of out, which is gone at the end; transcripts are rendered and written from
    it. metrics is a folder of Parquet that a row (recording_id, variant, duration, elapsed, rtf) is added to for each
    transcript. show is given lines of progress. profile holds the resources of recognition. Gives the number of
    transcripts, their recordings' seconds (once for each variant) and the seconds that recognition took.
    """
    options = options or RunOptions()
    store = Store(spark, out, mounted)
    check_names(names_of(listed(spark, path, only_media), options))
    with run_folder(store) as scratch:
        windows = recording_windows(spark, path, options.window_seconds, options.overlap_seconds, only_media, tasks, scratch)
        if show is None:
            return write_run(windows, store, scratch, load, options, metrics, profile, mounted=mounted)
        done = spark.sparkContext.accumulator((0.0, 0), WindowsDone())
        ranges = spark.read.parquet(f"{scratch}/ranges").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("core_end") - F.col("core_start")), F.lit(0.0)).alias("seconds")).first()
        with _Progress(show, done, ranges.seconds, ranges.n, len(options.variants)):
            return write_run(windows, store, scratch, load, options, metrics, profile, done, mounted)
