"""The registered corpus queries and the pipeline over the small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspool.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    want = duck.sql(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(got[cols].values.tolist()) == sorted(want[cols].values.tolist())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_language_accuracy(spark, small):
    got = queries.QUERIES["op1_centroid_langid"](spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.95 and held["score"].between(0, 1).all()


def test_toxicity_is_a_score(spark, small):
    got = queries.QUERIES["op5_segment_toxicity"](spark, small).toPandas()
    assert len(got) == 200 and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got.predicted == 1)).all()


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        from larkspool.llm.common import materialize

        docs = materialize(stage(spark, docs, small), name)
        seen.append((name, docs.count()))
        if name != "shard":
            assert docs.columns == columns
    counts = dict(seen)
    assert counts["language_id"] >= counts["near_dedup"] >= counts["decontaminate"] > 0
    assert counts["mix"] == counts["shard"]
    load = docs.groupBy("shard").agg(F.sum("size")).toPandas()
    assert len(load) == 24 and np.ptp(load.iloc[:, 1]) <= docs.agg(F.max("size")).first()[0]


def test_empty_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0


def test_stages_over_odd_rows(spark, small):
    """Nulls, repeated and missing ids, and columns whose names operators use: rows keep all their columns."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    some = docs.limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in some] + [(some[0].doc_id, some[0].text, some[0].lang, some[0].source, some[0].n_chars)]
    rows += [(None, some[1].text, None, None, None), (None, None, None, None, 0), (9001, "", "en", None, 0), (9002, None, None, "s", None), (9003, "1 2 3", None, "s", 5)]
    extra = ("size", "target", "taken", "score", "rejected", "lang_pred", "id", "component_id", "_row", "_copy", "_text", "_all_")
    full = [(*r, *[f"{c}{i}" for c in extra]) for i, r in enumerate(rows)]
    odd = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    known = {r[5:]: r[:5] for r in full}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, small)
        assert name == "shard" or got.columns == odd.columns
        kept = got.select([c for c in odd.columns if c not in ("lang", "size")]).collect()
        texts = {r.text for r in kept}
        for r in kept:
            # each row still holds the columns it came with
            own = next(v for k, v in known.items() if k[1] == r.target)
            assert (r.doc_id, r.text, r.source) == (own[0], own[1], own[3]) and r._row[4:] == r.target[6:] == r._copy[5:]
        counts = len(kept)
        if name == "language_id":
            assert None not in texts and "1 2 3" not in texts and counts >= 55
        elif name in ("near_dedup", "decontaminate"):
            assert sum(r.doc_id is None for r in kept) == 2 and None in texts
        elif name == "mix":
            assert None not in texts and "" not in texts
        else:
            assert counts == len(rows)
