"""Optional vocabulary and prompt files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import config_text


def optional_entries(spark: SparkSession, path: str) -> str:
    """Entries of a text file, '' if it is missing. What can't be read as one UTF-8 file raises."""
    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return ""
        raise
    rows = files.select(config_text(F.decode("content", "UTF-8")).alias("entries")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one text file")
    return rows[0].entries
