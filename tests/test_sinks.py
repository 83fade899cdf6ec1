"""Writing transcripts: all or nothing, on any store, files of any length, and numbering in two levels."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspool.operators import render
from larkspool.plans.fixtures import heard, one_recording
from larkspool.operators.segments import own_chunks
from larkspool.sources.sinks import Store, write_documents, write_lines

LINES = "name string, kind string, n long, line string"


def content(folder):
    return {p.name: p.read_bytes().decode() for p in folder.iterdir()}


def test_a_lost_task_leaves_nothing(spark, tmp_path):
    """A worker dies in the middle of its file, others have written theirs: the folder holds what it held before."""
    (tmp_path / "a1.txt").write_text("before")
    rows = spark.range(40).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("name"), F.lit("txt").alias("kind"), F.lit(1).cast("long").alias("n"), F.lit("x").alias("line"))

    def dies(batches):
        import os

        for batch in batches:
            for i in range(len(batch)):
                yield batch.iloc[i : i + 1]
                if batch["name"].iloc[i] == "a17":
                    os._exit(1)

    with pytest.raises(Exception):
        write_lines(rows.repartition(4).mapInPandas(dies, LINES), str(tmp_path))
    assert content(tmp_path) == {"a1.txt": "before"}
    write_lines(rows, str(tmp_path))
    assert len(content(tmp_path)) == 40 and content(tmp_path)["a1.txt"] == "x\n"


def test_names_and_marks(spark, tmp_path):
    """Names of any characters, empty subtitles, files that are replaced and others that stay; nothing is collected but names."""
    names = ["plain", "a=b", "50%", "two words", "dots.v1.", "c:d", "日本", "q'\"[x]*?", "#1", "{y}"]
    docs = spark.createDataFrame([(n, f"text of {n}\n", "" if i % 2 else f"1\n{n}\n") for i, n in enumerate(names)], "name string, txt string, srt string")
    (tmp_path / "stays.txt").write_text("x")
    for _ in range(2):
        write_documents(docs, str(tmp_path))
    want = {"stays.txt": "x"} | {f"{n}.txt": f"﻿text of {n}\n" for n in names} | {f"{n}.srt": "﻿" + ("" if i % 2 else f"1\n{n}\n") for i, n in enumerate(names)}
    assert content(tmp_path) == want


def test_no_row_passes_the_driver(spark, tmp_path, monkeypatch):
    lines = spark.range(300).select((F.col("id") % 3).cast("string").alias("name"), F.lit("txt").alias("kind"), F.col("id").alias("n"), F.col("id").cast("string").alias("line"))
    for f in ("collect", "toLocalIterator", "toPandas", "head", "first", "take"):
        monkeypatch.setattr(DataFrame, f, None)
    write_lines(lines, str(tmp_path))
    assert content(tmp_path) == {f"{k}.txt": "".join(f"{i}\n" for i in range(k, 300, 3)) for k in range(3)}


def test_a_long_file_keeps_its_order(spark, tmp_path):
    n = 300_000
    lines = spark.range(n).select(F.lit("long").alias("name"), F.lit("txt").alias("kind"), ((F.col("id") * 7919) % n).alias("n")).withColumn("line", F.concat(F.lit("line "), F.col("n").cast("string")))
    write_lines(lines.repartition(13), str(tmp_path))
    assert (tmp_path / "long.txt").read_text() == "".join(f"line {i}\n" for i in range(n))


def test_a_store_behind_another_scheme(spark, tmp_path):
    """A mount table of Hadoop's: tasks write and the driver renames through it."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.shelf.link./box", f"file://{tmp_path}")
    docs = spark.createDataFrame([("a", "one\n", ""), ("b", "two\n", "1\nx\n")], "name string, txt string, srt string")
    for _ in range(2):
        write_documents(docs, "viewfs://shelf/box/out")
    got = {p.name: p.read_text("utf-8-sig") for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
    assert got == {"a.txt": "one\n", "a.srt": "", "b.txt": "two\n", "b.srt": "1\nx\n"}


def test_local_paths_on_a_cluster(spark, tmp_path, monkeypatch):
    """A local path isn't shared: it is refused on a cluster unless it is said to be mounted everywhere."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError, match="executors don't share"):
        Store(spark, str(tmp_path))
    assert str(Store(spark, str(tmp_path), mounted=True)) == f"file:{tmp_path}"


def test_two_levels_number_as_one(spark, small):
    """All events as one recording: the numbers of a plain row_number, no span with more than a small share of the rows."""
    segments = one_recording(spark, small)
    order = Window.partitionBy("recording_id").orderBy("start", "end", "idx", "ordinal")
    plain = {r.ordinal: r.n for r in segments.withColumn("n", F.row_number().over(order)).collect()}
    assert {r.ordinal: r.n for r in render.numbered(segments, ["recording_id"]).collect()} == plain
    sizes = [r["count"] for r in render._spans(segments).groupBy("recording_id", "span").count().collect()]
    assert sum(sizes) == len(plain) and max(sizes) < 0.05 * len(plain)


def test_odd_times(spark):
    """Negative, equal, huge, infinite and NaN starts, rows without text, and a key that is null."""
    nan, inf = float("nan"), float("inf")
    starts = [0.0, -5.0, 599.99, 600.0, 600.0, 1e18, inf, nan, -1e18, 1199.0]
    rows = [(k, 0, i, s, s, "x") for k in ("a", None) for i, s in enumerate(starts)] + [("a", 0, -1, 0.0, 9.0, None), ("b", 0, -1, 0.0, 9.0, None)]
    df = spark.createDataFrame(rows, "k string, idx long, ordinal int, start double, end double, text string")
    order = Window.partitionBy("k").orderBy(F.col("text").isNull(), "start", "end", "idx", "ordinal")
    want = {(r.k, r.ordinal): r.n for r in df.withColumn("n", F.row_number().over(order)).collect()}
    assert {(r.k, r.ordinal): r.n for r in render.numbered(df, ["k"]).collect()} == want


def test_files_by_lines_are_the_rendered_ones(spark, small, tmp_path):
    """What is written line by line is what render makes of a recording; recordings without text included."""
    seg = own_chunks(heard(spark, small)).select("recording_id", "duration", "idx", "ordinal", "start", "end", "text")
    silent = spark.createDataFrame([(i, 9.0, 0, -1, 0.0, 9.0, None) for i in (-1, -2)], seg.schema)
    seg = seg.union(silent).withColumn("text", F.when(F.col("ordinal") % 5 == 0, F.concat("text", F.lit("\nsecond line"))).otherwise(F.col("text")))
    rows = render.render(seg, ["recording_id"]).collect()
    lines = render.file_lines(seg, ["recording_id"]).withColumn("name", F.col("recording_id").cast("string"))
    write_lines(lines, str(tmp_path))
    want = {f"{r.recording_id}.{k}": "﻿" + r[k] for r in rows for k in ("txt", "srt")}
    assert content(tmp_path) == want and want["-1.srt"] == "﻿" and want["-1.txt"] == "﻿\n"
