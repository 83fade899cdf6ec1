"""op1: language of every document, learnt from three quarters of them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .langid import fit, fold, identify


def op1_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op1_centroid_langid": op1_centroid_langid}
ORACLES = {}
