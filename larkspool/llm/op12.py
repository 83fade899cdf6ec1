"""op12: the ten best documents of each benchmark item."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .search import search


def op12_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

QUERIES = {"op12_tput_search": op12_tput_search}
ORACLES = {
    "op12_tput_search": f"""
WITH i AS (
  SELECT row_number() OVER () AS q, item_id, {_TERMS} AS terms FROM benchmark
), w AS (
  SELECT q, term, count(*) AS times FROM (SELECT q, unnest(terms) AS term FROM i) GROUP BY q, term
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents
), s AS (
  SELECT count(*) FILTER (len(terms) > 0) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d
), e AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM w) GROUP BY r, term
), f AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * CAST(count(*) AS DOUBLE) + 1))) AS BIGINT) AS weight FROM e, s GROUP BY term, docs
), m AS (
  SELECT r, doc_id, 100 - 75 + (75 * len(terms) * docs) // total AS m FROM d, s WHERE len(terms) > 0
), t AS (
  SELECT q, m.r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM e JOIN f ON e.term = f.term JOIN m ON e.r = m.r JOIN w ON w.term = e.term GROUP BY q, m.r, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM t WHERE score > 0) b JOIN i ON i.q = b.q
WHERE rank <= 10
"""
}
