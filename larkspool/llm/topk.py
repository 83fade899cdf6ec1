"""Exact top-k inner products by norm-bucketed retrieval: length and coordinate pruning inside blocks of like norm."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Rows of a block on either side; a pair of blocks is shipped as a whole and searched by slices of its queries.
CANDIDATE_ROWS, QUERY_ROWS, SLICE_ROWS = 4096, 4096, 512
#: From this local cosine threshold on, a query looks at its strongest coordinates first.
COORDINATE_FROM = 0.7
FOCUS = 3
_PAIR_SALTS = 16


def _packed(vecs: np.ndarray) -> bytes:
    """Whole vectors as bytes, in the narrowest of 16, 32 and 64 bits a component that holds them all."""
    for kind in (np.int16, np.int32):
        if not vecs.size or np.iinfo(kind).min <= vecs.min() and vecs.max() <= np.iinfo(kind).max:
            return vecs.astype(kind).tobytes()
    return vecs.tobytes()


def _vectors(data: bytes, rows: int, dim: int) -> np.ndarray:
    width = len(data) // max(1, rows * dim)
    return np.frombuffer(data, {2: np.int16, 4: np.int32}.get(width, np.int64)).astype(np.int64).reshape(rows, dim)


def _cut(rows_per_block: int):
    """Blocks of rows that come in order of falling norm, one row each: ids and whole vectors as bytes."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, int]] = []

        def block(ids, vecs):
            norms = np.sqrt((vecs.astype(np.float64) ** 2).sum(axis=1))
            return [int(vecs.shape[1]), float(norms.max()), len(ids), ids.tobytes(), _packed(vecs)]

        def flush(rest: bool):
            out = []
            while held:
                dim = held[0][1].shape[1]
                same = [h for h in held if h[1].shape[1] == dim]
                other = [h for h in held if h[1].shape[1] != dim]
                ids, vecs = np.concatenate([h[0] for h in same]), np.concatenate([h[1] for h in same])
                while len(ids) >= rows_per_block or ((rest or other) and len(ids)):
                    out.append(block(ids[:rows_per_block], vecs[:rows_per_block]))
                    ids, vecs = ids[rows_per_block:], vecs[rows_per_block:]
                held[:] = ([(ids, vecs, 0)] if len(ids) else []) + other
                if not (rest or other):
                    break
            return out

        def emit(out):
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], names=["dim", "top", "rows", "ids", "vecs"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = np.asarray(lists.value_lengths())
            starts = np.cumsum(lengths) - lengths
            a = 0
            while a < len(ids):  # runs of one dimension
                b = a
                while b < len(ids) and lengths[b] == lengths[a]:
                    b += 1
                held.append((ids[a:b].astype(np.int64), flat[starts[a] : starts[b - 1] + lengths[b - 1]].reshape(b - a, int(lengths[a])), 0))
                a = b
            if out := flush(False):
                yield emit(out)
        if out := flush(True):
            yield emit(out)

    return run


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point where every sum stays below 2**53, else in integers."""
    if q.size and c.size and float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2.0**53:
        return np.rint(q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def search_block(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query place, ids, scores) of the best k rows of a block for each query, of those that reach its floor.

    floor holds a score that k other candidates of the query are known to reach, or a very low one. A query
    passes over the block, or over its short rows, where norms can't reach the floor. Where the floor asks for a
    high cosine with the block's longest row, rows whose strongest query coordinates lie outside the range
    that such a cosine allows are passed over too. All products of what is left are computed.
    """
    qn = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    cn = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-cn, kind="stable")
    c_ids, c, cn = c_ids[order], c[order], cn[order]
    slack = 1 - 1e-9
    need = np.where((floor > 0) & (qn > 0), floor / np.maximum(qn, 1e-300) * slack, 0.0)  # least norm of a row
    reach = np.searchsorted(-cn, -need, side="right")  # rows that are long enough stand first
    cosine = np.where(need > 0, need / max(cn[0], 1e-300), 0.0)
    by_length = np.flatnonzero((reach > 0) & (cosine < COORDINATE_FROM))
    by_coordinate = np.flatnonzero((reach > 0) & (cosine >= COORDINATE_FROM))
    found = []

    def best(i: int, scores: np.ndarray, ids: np.ndarray):
        if len(scores) > 4 * k:
            least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]  # the query itself may be among them
            keep = scores >= max(least, floor[i])
        else:
            keep = scores >= floor[i]
        keep &= ids != q_ids[i]
        s, x = scores[keep], ids[keep]
        top = np.lexsort((x, -s))[:k]
        if len(top):
            found.append((i, x[top], s[top]))

    if len(by_length):
        widest = int(reach[by_length].max())
        products = _products(q[by_length], c[:widest])
        for row, i in enumerate(by_length.tolist()):
            best(i, products[row, : reach[i]], c_ids[: reach[i]])
    if len(by_coordinate):
        unit = c / np.maximum(cn, 1e-300)[:, None]
        for i in by_coordinate.tolist():
            direction = q[i] / qn[i]
            t = min(1.0, cosine[i])
            rows = np.arange(reach[i])
            for f in np.argsort(-np.abs(direction))[:FOCUS]:
                spread = np.sqrt(max(0.0, (1 - direction[f] ** 2) * (1 - t * t))) + 1e-9
                # a row whose cosine is t or more lies within this range; above the upper end only if its cosine is higher still
                lo = direction[f] * t - spread
                hi = direction[f] * t + spread
                if direction[f] >= t:
                    hi = 1.0
                elif -direction[f] >= t:
                    lo = -1.0
                x = unit[rows, f]
                rows = rows[(x >= lo) & (x <= hi)]
            if len(rows):
                best(i, _products(q[i : i + 1], c[rows])[0], c_ids[rows])
    return found


LOWEST = -(2**62)


def _pairs(k: int, seeds: bool):
    """Searches (query block, candidate block) rows. With seeds, emits each query's hits in its first block as bytes."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                r = {n: batch.column(j)[row].as_py() for j, n in enumerate(batch.schema.names)}
                q_ids, c_ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, c = _vectors(r["q_vecs"], len(q_ids), r["dim"]), _vectors(r["vecs"], len(c_ids), r["dim"])
                floor = np.full(len(q_ids), LOWEST, np.int64) if seeds else np.frombuffer(r["floor"], np.int64)
                found = []
                for a in range(0, len(q_ids), SLICE_ROWS):
                    part = slice(a, a + SLICE_ROWS)
                    found += [(a + i, x, s) for i, x, s in search_block(q_ids[part], q[part], floor[part], c_ids, c, k)]
                queries = np.concatenate([np.full(len(x), q_ids[i]) for i, x, _ in found]) if found else np.zeros(0, np.int64)
                ids = np.concatenate([x for _, x, _ in found]) if found else queries
                scores = np.concatenate([s for _, _, s in found]) if found else queries
                if seeds:
                    floor = floor.copy()
                    for i, x, s in found:
                        if len(x) >= k:
                            floor[i] = s[k - 1]
                    names = ["q_block", "floor", "low", "queries", "hits", "scores"]
                    low = float(floor.min())
                    yield pa.RecordBatch.from_arrays([pa.array([r["q_block"]], pa.int64()), pa.array([floor.tobytes()], pa.binary()), pa.array([low], pa.float64()), *[pa.array([v.astype(np.int64).tobytes()], pa.binary()) for v in (queries, ids, scores)]], names=names)
                elif len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (queries, ids, scores)], names=["query_id", "vec_id", "score"])

    return run


def _unpack(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            cols = [pa.array(np.frombuffer(batch.column(j)[row].as_py(), np.int64), pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score"])


def _blocks(rows: DataFrame, per_block: int, name: str) -> DataFrame:
    """Blocks of at most per_block vectors of like norm, numbered."""
    parts = max(1, -(-rows.count() // per_block))
    dealt = rows.repartitionByRange(parts, F.size("v"), F.desc("norm"), "id").coalesce(parts).sortWithinPartitions(F.size("v"), F.desc("norm"), "id")
    cut = dealt.select("id", "v").mapInArrow(_cut(per_block), "dim long, top double, rows long, ids binary, vecs binary")
    return materialize(cut.withColumn("block", F.monotonically_increasing_id()), name)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to the smaller id.

    Components become floor(scale * x). Vectors are cut into blocks by falling norm; every query first searches
    the block of the longest vectors, and the score it reaches k times there is its floor in all other blocks.
    Pairs of blocks whose norms can't reach the lowest floor are never formed, others are searched by
    search_block; only candidates at or above a query's floor are emitted. Exact: what is passed over can't reach a floor.

    Null vectors, those with a null or non-finite component and rows with a null id take no part; a vector is
    compared with those of its own length only; rows of the query's own id are its own; an empty vector scores
    0; fewer candidates than k give fewer rows; an empty table gives none. Other columns are ignored.
    """
    v, x = F.col(vector_col), F.col(id_col).cast("long")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.where(x.isNotNull() & v.isNotNull() & finite).select(x.alias("id"), F.transform(v, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long")).alias("v"), is_query.alias("is_query"))
    rows = rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda acc, e: acc + e.cast("double") * e.cast("double")))
    rows = materialize(rows, "vectors")
    candidates = _blocks(rows.drop("is_query"), CANDIDATE_ROWS, "candidates")
    queries = _blocks(rows.where("is_query").drop("is_query"), QUERY_ROWS, "queries")
    queries = queries.select(F.col("block").alias("q_block"), "dim", F.col("top").alias("q_top"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    # one row for each length of vector: the block of the longest
    first = materialize(candidates.groupBy("dim").agg(F.max_by("block", F.struct("top", -F.col("block"))).alias("block")), "first")
    longest = candidates.join(first.select("block"), "block", "left_semi").select("dim", "ids", "vecs")
    seeded = queries.join(longest, "dim").select("q_block", "dim", "q_ids", "q_vecs", "ids", "vecs")
    seeded = materialize(seeded.mapInArrow(_pairs(k, True), "q_block long, floor binary, low double, queries binary, hits binary, scores binary"), "seeded")
    asks = queries.join(seeded.select("q_block", "low"), "q_block").select("q_block", "dim", "q_top", "low").withColumn("salt", F.pmod(F.col("q_block"), F.lit(_PAIR_SALTS)))
    offers = candidates.join(first.select("block"), "block", "left_anti").select("block", "dim", "top").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_PAIR_SALTS - 1).cast("long"))))
    pairs = asks.join(offers, ["dim", "salt"]).where((F.col("low") <= 0) | (F.col("q_top") * F.col("top") * (1 + 1e-9) >= F.col("low"))).select("q_block", "block")
    pairs = materialize(pairs, "block_pairs")
    whole = pairs.join(candidates.select("block", "ids", "vecs"), "block").join(queries.select("q_block", "dim", "q_ids", "q_vecs").join(seeded.select("q_block", "floor"), "q_block"), "q_block")
    hits = whole.select("q_block", "dim", "q_ids", "q_vecs", "ids", "vecs", "floor").mapInArrow(_pairs(k, False), "query_id long, vec_id long, score long")
    hits = hits.union(seeded.select("queries", "hits", "scores").mapInArrow(_unpack, "query_id long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
