"""op5: toxicity of every document, learnt from four fifths of the labels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .langid import fold
from .toxicity import fit, score


def op5_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = fit(docs.where(~held_out), labels.where(~held_out))
    found = score(docs.select("text", "doc_id"), model)
    n_passages = F.size("passages").cast("long")
    return found.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), n_passages.alias("n_passages"))


QUERIES = {"op5_segment_toxicity": op5_segment_toxicity}
ORACLES = {}
