"""op9: all documents from 16 shards by a hash of the text to 24 shards of near-equal bytes, written and read back."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table
from .reshard import reshard, write_shards

OLD_SHARDS, NEW_SHARDS = 16, 24


def old_layout():
    """The layout before: 16 shards by a hash of the text."""
    return F.pmod(F.xxhash64("text", F.lit(9)), F.lit(OLD_SHARDS))


def op9_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(reshard(docs, old_layout(), OLD_SHARDS, NEW_SHARDS), path, existing=False)
    placed = spark.read.schema("doc_id long, text string, size long, slot long, old_shard int, shard int").parquet(path)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


QUERIES = {"op9_flow_reshard": op9_flow_reshard}
ORACLES = {}
