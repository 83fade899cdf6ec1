"""op8: benchmark passages in all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contaminated, leaks


def op8_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(F.col("id").alias("doc_id"), "item_id", "pieces", "start", "end", "edits")


QUERIES = {"op8_qgram_leaks": op8_qgram_leaks}
ORACLES = {}
