"""op7: token ids of all documents in the binary format, read back from it."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from .common import shared_dir, table
from .tokens import read_digests, write_tokens


def op7_mixed_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_digests(spark, path).withColumnRenamed("id", "doc_id")


QUERIES = {"op7_mixed_range_coder": op7_mixed_range_coder}
ORACLES = {}
