"""op3: licence notices in all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .licences import fit, scan


def op3_licence_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, fit(docs)).withColumnRenamed("id", "doc_id").withColumn("paragraph", F.col("paragraph").cast("int"))


QUERIES = {"op3_licence_notices": op3_licence_notices}
ORACLES = {}
