"""Transcripts as .txt and .srt files beside each other, under the name of their recording.

Tasks write below a hidden folder of the results' folder, through the committer of Spark's own file writer; when all have,
the files are renamed to their places. A task that fails or is lost leaves nothing behind, nor does a run. No row passes the
driver, and any store that Spark can write to will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BYTE_ORDER_MARK

#: Renames under way at a time.
RENAMES = 16


def result_names(documents: DataFrame, suffix: str = "suffix") -> DataFrame:
    """documents (stem, a suffix column) with name, the stem and suffix of its result files."""
    return documents.withColumn("name", F.concat("stem", F.coalesce(F.col(suffix), F.lit(""))))


def check_names(documents: DataFrame) -> None:
    """ValueError where two results would get one name."""
    clash = documents.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"{clash[0].n} results would be written as {clash[0].name}")


class Store:
    """A folder on the file system that Spark would use for its path."""

    def __init__(self, spark: SparkSession, folder: str, mounted: bool = False):
        self.jvm = spark.sparkContext._jvm
        path = self.jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.path = fs.makeQualified(path)
        self.local = fs.getUri().getScheme() == "file"
        if self.local:
            if spark.sparkContext.master.split("[")[0] != "local" and not mounted:
                raise ValueError(f"{folder} is a local path, which executors don't share; if it is mounted on all of them, say so (mounted)")
            fs = fs.getRawFileSystem()  # without the checksum files of the other
        self.fs = fs

    def __str__(self) -> str:
        return self.path.toString()

    def remove(self, folder: str) -> None:
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(folder), True)

    def parts(self, folder: str) -> Iterator[tuple[str, str, object]]:
        """(name, kind, path) of each data file below folder/name=.../kind=..."""
        unescape = self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        files = self.fs.listFiles(self.jvm.org.apache.hadoop.fs.Path(folder), True)
        while files.hasNext():
            path = files.next().getPath()
            if path.getName().startswith("part-"):
                kind = path.getParent()
                yield unescape(kind.getParent().getName().partition("=")[2]), kind.getName().partition("=")[2], path

    def move(self, source, name: str) -> None:
        """Renames a file to name in the folder, over one that is there."""
        target = self.jvm.org.apache.hadoop.fs.Path(f"{self}/{name}")  # as one string: a name may hold a colon
        if not self.local and self.fs.exists(target):  # a local rename replaces by itself
            self.fs.delete(target, False)
        if not self.fs.rename(source, target):
            raise OSError(f"{source} can't be renamed to {target}")


@contextmanager
def run_folder(store: Store) -> Iterator[str]:
    """A hidden folder in the store, gone at the end, however it comes."""
    folder = f"{store}/.run-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        store.remove(folder)


def write_lines(lines: DataFrame, folder: str, mounted: bool = False) -> None:
    """Write the lines (name, kind, n, line) of each name.kind in order of n, each with a line feed; a null line is a byte order mark without one.

    A file is written by one task, line by line, whatever its length. Existing files of these names are replaced, each
    by one rename once all are written. lines are computed twice, so they should come from a written table.
    """
    store = Store(lines.sparkSession, folder, mounted)
    # columns that can't be null are not rewritten by the writer, which then keeps the order of lines
    rows = lines.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("kind", F.lit("")).alias("kind"), "n", "line")
    with run_folder(store) as staging:
        for part, end, some in (("lines", "\n", rows.where("line is not null")), ("marks", BYTE_ORDER_MARK, rows.where("line is null").withColumn("line", F.lit("")))):
            ordered = some.repartition("name", "kind").sortWithinPartitions("name", "kind", "n").select("name", "kind", "line")
            ordered.write.partitionBy("name", "kind").option("lineSep", end).text(f"{staging}/{part}")
        with ThreadPoolExecutor(RENAMES) as pool:
            moves = [pool.submit(store.move, path, f"{name}.{kind}") for part in ("lines", "marks") for name, kind, path in store.parts(f"{staging}/{part}")]
        for m in moves:
            m.result()


def write_documents(documents: DataFrame, folder: str, names: DataFrame | None = None, mounted: bool = False) -> None:
    """Write name.txt and name.srt for each row (name, txt, srt), in UTF-8 with a byte order mark; a body without a line feed at its end gets one.

    names holds the names that documents will have, one row each, where they are known without computing the
    documents: clashes are then found before. See write_lines.
    """
    check_names(documents if names is None else names)
    rows = documents.select("name", F.explode(F.create_map(F.lit("txt"), F.col("txt"), F.lit("srt"), F.col("srt"))).alias("kind", "body"))
    line = F.when(F.col("body") != "", F.concat(F.lit(BYTE_ORDER_MARK), F.regexp_replace("body", r"\n\z", "")))
    write_lines(rows.select("name", "kind", F.lit(0).alias("n"), line.alias("line")), folder, mounted)
