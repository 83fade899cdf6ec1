"""op2: all documents mixed by source to 150 % of their words."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .mixing import mix


def op2_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, with_text=False).select("doc_id", "size", "source_size", "target", "taken", "first_shard", "first_slot")


QUERIES = {"op2_block_mix": op2_block_mix}
ORACLES = {}
