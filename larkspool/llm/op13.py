"""op13: damaged conversations and their cheapest repair."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .dialogue import digests, repair


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of sentence ends, repeated or given the role user, by the checksum of conversation and turn."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    df = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("harm"))
    df = df.where("harm <> 0").withColumns(
        {
            "text": F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "role": F.when(F.col("harm") == 4, "user").otherwise(F.col("role")),
            "copies": F.array_repeat(F.lit(0), F.when(F.col("harm") == 3, 2).otherwise(1)),
        }
    )
    return df.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def op13_signature_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair(damaged(conversations))
    c, r, d = conversations.select("conv_id").distinct().alias("c"), found.conversations.alias("r"), digests(found.turns).alias("d")
    df = c.join(r, F.col("c.conv_id").eqNullSafe(F.col("r.conv")), "left").join(d, F.col("c.conv_id").eqNullSafe(F.col("d.conv")), "left")
    numbers = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return df.select("c.conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def _plus(key: str, cost: int | str, letter: str) -> str:
    """A way (nine digits of cost, then its edits) with one more edit."""
    return f"(lpad(CAST(CAST(substr({key}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({key}, 10) || '{letter}')"


def _kept(key: str, role: str) -> str:
    """The way with the row kept where it has the role, else given it; null where it must go."""
    letter = f"CASE WHEN initial = '{role}' THEN {_plus(key, 'cut', 'K')} ELSE {_plus(key, '3 + cut', 'R')} END"
    return f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {letter} END"


# Ways by what has been put out: z nothing, s a system row, u an open pair, a whole pairs. Insertions come first, then the row.
_OPENED = f"least(u, {_plus('z', 3, 'I')}, {_plus('s', 3, 'I')}, {_plus('a', 3, 'I')})"
_CLOSED = f"least(a, {_plus('u', 3, 'I')}, {_plus('z', 6, 'II')}, {_plus('s', 6, 'II')})"
_SQL = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), h AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 20 AS harm FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE harm <> 0
), c AS (
  SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)
), n AS (
  SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM d JOIN c ON d.conv_id IS NOT DISTINCT FROM c.conv_id
), f AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY n) AS former,
    CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 'truncated' ELSE '' END AS fault FROM n
), g AS (
  SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM f
), w AS (
  SELECT conv, CAST(0 AS BIGINT) AS n, '000000000' AS z, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM (SELECT DISTINCT conv FROM g)
  UNION ALL
  SELECT conv, n, {_plus("z", 4, "D")}, least({_plus("s", 4, "D")}, CASE WHEN initial = 's' AND fault NOT IN ('blank', 'duplicate') THEN {_plus("z", "cut", "K")} END),
    least({_plus("u", 4, "D")}, {_kept("z", "u")}, {_kept("s", "u")}, {_kept("a", "u")}), least({_plus("a", 4, "D")}, {_kept("u", "a")})
  FROM (SELECT w.conv, g.n, initial, fault, cut, z, s, {_OPENED} AS u, {_CLOSED} AS a FROM w JOIN g ON g.conv = w.conv AND g.n = w.n + 1)
), best AS (
  SELECT w.conv, w.n, least(z, a, {_plus("u", 3, "I")}, {_plus("s", 6, "II")}) AS way FROM w JOIN (SELECT conv, max(n) AS n FROM g GROUP BY conv) USING (conv, n)
), e AS (
  SELECT conv, CAST(substr(way, 1, 9) AS BIGINT) AS cost, substr(way, 10) AS audit FROM best
), p AS (
  SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS i FROM e
), q AS (
  SELECT conv, i, substr(audit, i, 1) AS edit, length(regexp_replace(substr(audit, 1, i), 'I', '', 'g')) AS n, length(regexp_replace(substr(audit, 1, i), 'D', '', 'g')) AS place FROM p
), o AS (
  SELECT q.conv, q.i, edit, place, CASE WHEN edit = 'I' THEN '' ELSE g.text END AS text, CASE WHEN edit = 'K' THEN g.role END AS role FROM q LEFT JOIN g ON g.conv = q.conv AND g.n = q.n WHERE edit <> 'D'
), r AS (
  SELECT *, max(CASE WHEN place = 1 AND starts_with(role, 's') THEN 1 ELSE 0 END) OVER (PARTITION BY conv) AS ahead FROM o
), t AS (
  SELECT conv, sha256(string_agg(coalesce(role, CASE WHEN (place - ahead) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY i)) AS repaired_sha256 FROM r GROUP BY conv
), m AS (
  SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (former || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM c LEFT JOIN m ON m.conv = c.conv LEFT JOIN e ON e.conv = c.conv LEFT JOIN t ON t.conv = c.conv
"""

QUERIES = {"op13_signature_repair": op13_signature_repair}
ORACLES = {"op13_signature_repair": _SQL}
