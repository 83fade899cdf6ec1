"""op10: near duplicates of all documents on two-word shingles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .neardup import near_duplicates


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


QUERIES = {"op10_superminhash": op10_superminhash}
ORACLES = {}
