"""op4: all documents without the bytes that repeated 200-byte strings cover."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .substrings import remove_repeats


def op4_grouped_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("runs").cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {"op4_grouped_suffixes": op4_grouped_suffixes}
ORACLES = {}
