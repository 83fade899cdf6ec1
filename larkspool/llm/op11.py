"""op11: ids of all documents by the multilingual ranks, and their bytes back from the ids."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode, encode
from .common import table


def op11_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # PATTERN takes an optional space into each kind of word, so a lone space between two other characters begins a match
    found = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, lone_space_begins=True), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op11_bpe_tree": op11_bpe_tree}
ORACLES = {}
