"""Connected components over links: union-find inside each partition, then rounds of contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _forest(batches):
    """Union-find over the links of one partition; emits (node, root) of every node that isn't its root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(x, find(x)) for x in parent]
    pairs = [p for p in pairs if p[0] != p[1]]
    if schema is not None:
        for i in range(0, len(pairs), 10_000):
            part = pairs[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a long, b long); component is its smallest connected node.

    Each partition first shrinks its links to a forest. Each round then hooks every node to the neighbour (or
    itself) that comes first in a hashed order and contracts; hashed order keeps chains short, so rounds grow
    with the logarithm of the longest chain. Nulls and links of a node to itself are ignored; no links give no
    rows. Nothing is collected: each round is a written table.
    """
    links = links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    links = materialize(links.mapInArrow(_forest, "a long, b long"), "links")
    moves = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id")))
        hooks = both.groupBy("a").agg(first.alias("m")).select(
            F.col("a").alias("node"),
            F.when(F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id")) < F.col("m"), F.col("a")).otherwise(F.col("m.id")).alias("up"),
        )
        hooks = materialize(hooks, "hooks")
        moves.append(hooks)
        left = links.join(hooks.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").select("ua", "b")
        right = left.join(hooks.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        contracted = right.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
        links = materialize(contracted.mapInArrow(_forest, "a long, b long"), "links")
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    top = moves[-1].select("node", F.col("up").alias("root"))
    for hooks in reversed(moves[:-1]):
        # a node whose parent has no later move is a root by then
        step = hooks.join(top.withColumnRenamed("node", "up"), "up", "left")
        top = materialize(step.select("node", F.coalesce("root", "up").alias("root")), "roots")
    smallest = top.groupBy("root").agg(F.min(F.least("node", "root")).alias("component"))
    return materialize(top.join(smallest, "root").select("node", "component"), "components")
