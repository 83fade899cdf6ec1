"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, source mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of
documents, but for the last, which adds the place of each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspool.llm import langid
from larkspool.llm.common import free_name, materialize, scratch, sized, table
from larkspool.llm.decontaminate import leaks
from larkspool.llm.mixing import mix, repeated
from larkspool.llm.neardup import near_duplicates
from larkspool.llm.reshard import reshard
from larkspool.shipping import ship

OLD_SHARDS, NEW_SHARDS = 16, 24


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for the rows whose doc_id is in ids; rows without an id stay."""
    ids = materialize(ids.select("doc_id").distinct(), "dropped")
    return docs.join(sized(ids, ids.count()), "doc_id", "left_anti").select(*docs.columns)


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """docs as the named columns and all others in one, so that an operator's new columns clash with none."""
    return docs.select(*names, F.struct(F.lit(0).alias(free_name("_", docs.columns)), *[c for c in docs.columns if c not in names]).alias("_all"))


def _unpacked(columns: list[str], *names: str) -> list[Column]:
    return [F.col(c if c in names else f"_all.{c}").alias(c) for c in columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text is in no known language; fills in missing languages.

    Learnt from the rows that bear a language. Texts that are null or without a letter go; rows of a table
    without any language all go, as nothing can be recognised. Rows without an id and repeated rows are judged
    one by one.
    """
    found = langid.identify(_packed(docs, "text", "lang"), langid.fit(docs), "text").where(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*_unpacked(docs.columns, "text", "lang"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: five-word shingles, similarity 0.8 or more, smallest id.

    Rows of one id are one document; rows without an id, and texts without words, stay.
    """
    found = near_duplicates(docs, shingle=5, percent=80)
    return _without(docs, found.where("id <> component_id").select(F.col("id").alias("doc_id")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a passage of the benchmark.

    Rows of one id are one document and go together; rows without an id and null texts stay; an empty benchmark
    drops nothing.
    """
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select(F.col("id").alias("doc_id")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them, weights 3, 1, 2 in turn and half as many words again in all.

    Rows without words are in no mix; rows without a source are a source; rows without an id and repeated rows
    each count by themselves.
    """
    return repeated(mix(_packed(docs, "doc_id", "text", "source"))).select(*_unpacked(docs.columns, "doc_id", "text", "source"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their new shard of near-equal bytes, their slot in it and their shard before.

    Null texts count as texts of no bytes; rows without an id and repeated rows each get a slot; columns size,
    shard, slot and old_shard of docs are replaced.
    """
    old = F.pmod(F.xxhash64("text", F.lit(9)), F.lit(OLD_SHARDS))
    return reshard(docs, old, OLD_SHARDS, NEW_SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
    ("shard", shard),
]

#: No stage can be told in SQL: trained vectors, sketches, alignments, hashed permutations and a flow.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again.

    Once a stage is written, the tables that it made on the way are removed; the last one's stay for its reader.
    """
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
