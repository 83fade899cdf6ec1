"""New recordings as a stream: each file is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.recognise import Loader
from ..plans.options import RunOptions
from ..plans.transcribe import write_run
from ..shipping import ship
from ..sources.media import MEDIA_GLOB, named
from ..sources.ranges import file_errors, file_windows
from ..sources.sinks import Store, run_folder


def new_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings of a folder as they come; files of other types are passed over."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return named(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", MEDIA_GLOB).load(folder))


_CLAIMS = "recording_id string, name string, batch long"


def _refused(files: DataFrame, claims: str, number: int, options: RunOptions) -> tuple[DataFrame, DataFrame]:
    """Claims of the batch's recordings to names, and the recordings that want a name another one has.

    A name belongs to the recording of the earliest batch, in one batch to the first path. Claims of this batch
    itself, from a run that was cut off, don't count.
    """
    spark = files.sparkSession
    wanted = _names_of_each(files, options).withColumn("batch", F.lit(number).cast("long"))
    store = Store(spark, claims, mounted=True)
    there = store.fs.exists(store.path)
    earlier = (spark.read.schema(_CLAIMS).parquet(claims) if there else spark.createDataFrame([], _CLAIMS)).where(F.col("batch") < number)
    order = Window.partitionBy("name").orderBy("batch", "recording_id")
    # only claims to names of this batch are put in order
    rivals = earlier.select("recording_id", "name", "batch").join(wanted.select("name").distinct(), "name", "left_semi").unionByName(wanted)
    lost = rivals.withColumn("place", F.row_number().over(order)).where((F.col("place") > 1) & (F.col("batch") == number))
    return wanted, lost.select("recording_id").distinct()


def _names_of_each(files: DataFrame, options: RunOptions) -> DataFrame:
    """(recording_id, name) of every result of each file."""
    names = F.array(*[F.concat("stem", F.lit((v.suffix or "") + options.output_suffix)) for v in options.variants])
    return files.select("recording_id", F.explode(F.array_distinct(names)).alias("name"))


def transcribe_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, load: Loader, options: RunOptions | None = None, errors: str | None = None, metrics: str | None = None, mounted: bool = False):
    """Write the transcripts of each new recording. A repeated batch overwrites its own results.

    Recordings that don't decode are left out, and so are those whose results would get the name of an earlier recording's
    (names are kept below the checkpoint); with errors, a folder of JSON rows (recording_id, error), they are noted
    there, one folder for each batch.
    """
    options = options or RunOptions()
    claims = f"{checkpoint}/names"
    ship(spark)

    def batch(df: DataFrame, number: int) -> None:
        store = Store(df.sparkSession, out, mounted)
        wanted, refused = _refused(df, claims, number, options)
        with run_folder(store) as scratch:
            refused.write.parquet(f"{scratch}/refused")
            refused = df.sparkSession.read.schema("recording_id string").parquet(f"{scratch}/refused")
            wanted.join(refused, "recording_id", "left_anti").drop("batch").write.mode("overwrite").parquet(f"{claims}/batch={number}")
            files = df.join(refused, "recording_id", "left_anti")
            if errors:
                taken = refused.select("recording_id", F.lit("ValueError: another recording's results have its name").alias("error"))
                file_errors(files).unionByName(taken).write.mode("overwrite").json(f"{errors}/batch={number}")
            windows = file_windows(files, options.window_seconds, options.overlap_seconds)
            write_run(windows, store, scratch, load, options, metrics, mounted=mounted)

    return new_recordings(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
