"""Resharding by minimum-cost flow: keep what can stay, move the fewest bytes, renumber what moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, sized, utf8_bytes

#: Blocks that one old shard is cut into; the solver sees old shards x this many block sizes and no rows.
BLOCKS = 1024
#: A text whose rows weigh more than capacity / HOT_PART is cut by id instead of staying together.
HOT_PART = 8
#: Rows per numbering window, about.
SLOT_ROWS = 20_000


def min_cost_flow(supply: list[int], capacity: list[int]) -> list[dict[int, int]]:
    """Bytes to send from each old shard to new ones: all supply placed, no capacity exceeded, and as few bytes as
    possible to a shard of another number.

    The network has an arc from every old shard to every new one; staying costs 0, moving costs 1. With just these
    two costs no augmenting path can beat filling the stay arcs: an arc i to i carries min(supply, capacity) at
    most, all of them can do so at once, and every other byte costs 1 wherever it goes. So the stay arcs are filled
    first, and what is left runs from shards with too much to shards with room, each pair once: linear in the
    shards, and at most as many arcs as shards bear flow.
    """
    assert sum(supply) <= sum(capacity)
    room = list(capacity)
    flow: list[dict[int, int]] = [{} for _ in supply]
    left = list(supply)
    for i in range(min(len(supply), len(capacity))):
        if stay := min(left[i], room[i]):
            flow[i][i] = stay
            left[i] -= stay
            room[i] -= stay
    to = 0
    for i, rest in enumerate(left):
        while rest:
            while not room[to]:
                to += 1
            amount = min(rest, room[to])
            flow[i][to] = flow[i].get(to, 0) + amount
            rest -= amount
            room[to] -= amount
    return flow


def place_blocks(blocks: list[tuple[int, int, int]], n_old: int, n_new: int) -> dict[tuple[int, int], int]:
    """New shard of each block (old shard, block, bytes).

    The flow gives the bytes of each transfer; blocks fill the transfers of their shard, the largest first and
    into the fullest remaining one. What whole blocks can't match is evened out at the end: blocks go from the
    fullest shard to the emptiest as long as that narrows the difference.
    """
    supply = [0] * n_old
    for old, _, size in blocks:
        supply[old] += size
    total = sum(supply)
    capacity = [total // n_new + (j < total % n_new) for j in range(n_new)]
    open_flow = min_cost_flow(supply, capacity)
    placed: dict[tuple[int, int], int] = {}
    load = [0] * n_new
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(n_new)]
    for old, block, size in sorted(blocks, key=lambda x: (-x[2], x[0], x[1])):
        to = max(open_flow[old], key=lambda j: (open_flow[old][j], j == old, -j), default=old % n_new)
        open_flow[old][to] = open_flow[old].get(to, 0) - size
        placed[old, block] = to
        load[to] += size
        held[to].append((size, old, block))
    for _ in range(20 * n_new):
        full, empty = max(range(n_new), key=lambda j: (load[j], -j)), min(range(n_new), key=lambda j: (load[j], j))
        gap = load[full] - load[empty]
        fit = [x for x in held[full] if 0 < x[0] < gap]
        if not fit:
            break
        best = min(fit, key=lambda x: (abs(2 * x[0] - gap), x[1] != empty, x))
        held[full].remove(best)
        held[empty].append(best)
        placed[best[1], best[2]] = empty
        load[full] -= best[0]
        load[empty] += best[0]
    return placed


def reshard(docs: DataFrame, old_shard: Column, n_old: int, n_new: int = 24, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str, str] = ("size", "shard", "slot", "old_shard")) -> DataFrame:
    """docs with its size (UTF-8 bytes + 8), new shard, gapless slot in that shard, and old shard.

    old_shard gives 0 .. n_old - 1 and must be a function of the row. New shards get near-equal bytes. Rows are
    dealt to blocks by a hash of their text, so rows of equal texts and one old shard stay together, unless they
    weigh more than an eighth of a shard: those are dealt by id and text. Only block sizes reach the driver,
    n_old * BLOCKS of them, and at most HOT_PART * n_new heavy texts. Slots follow a hash of id and text, so rows
    without an id are dealt alike; equal rows are interchangeable. A null text has 0 bytes and counts as a text; a
    very long text is a large row and no more; an empty table gives no rows; columns of docs that bear one of
    the new names are replaced, whatever the others are called.
    """
    size, shard, slot, old = names
    spark = docs.sparkSession
    text_key = F.xxhash64(F.col(text_col), F.lit(1))
    id_key = F.xxhash64(F.col(id_col), F.isnull(F.col(id_col)), text_key, F.lit(2))
    kept = [c for c in docs.columns if c not in names]
    # the caller's columns go packed, so that their names can't clash
    rows = docs.select(F.struct(*kept).alias("_doc"), (utf8_bytes(F.col(text_col)) + 8).alias("_size"), old_shard.cast("int").alias("_old"), text_key.alias("_text_key"), id_key.alias("_id_key"))
    narrow = rows.select("_old", "_text_key", "_id_key", F.col("_size").alias("bytes"))

    def blocks(heavy: list[int]) -> Column:
        plain = F.pmod("_text_key", F.lit(BLOCKS))
        return (F.when(F.col("_text_key").isin(heavy), F.pmod("_id_key", F.lit(BLOCKS)) + BLOCKS).otherwise(plain) if heavy else plain).cast("int")

    def totals(heavy: list[int]):
        return [tuple(r) for r in narrow.groupBy("_old", blocks(heavy).alias("block")).agg(F.sum("bytes"), F.count("*")).collect()]

    found = totals([])
    limit = max(1, sum(r[2] for r in found) // (n_new * HOT_PART))
    suspects = [F.struct(F.lit(r[0]), F.lit(r[1])) for r in found if r[2] > limit and r[3] > 1]
    heavy: list[int] = []
    if suspects:
        inside = narrow.where(F.struct(F.col("_old"), blocks([])).isin(suspects))
        heavy = sorted(r[0] for r in inside.groupBy("_text_key").agg(F.sum("bytes").alias("b"), F.count("*").alias("c")).where((F.col("b") > limit) & (F.col("c") > 1)).collect())
        found = totals(heavy) if heavy else found
    placed = place_blocks([r[:3] for r in found], n_old, n_new)
    plan = spark.createDataFrame([(o, b, s) for (o, b), s in placed.items()], "_old int, _block int, _shard int")
    # bounded: at most 2 * BLOCKS rows of three integers for each old shard
    moved = rows.withColumn("_block", blocks(heavy)).join(sized(plan, len(placed)), ["_old", "_block"])
    n_rows = sum(r[3] for r in found)
    salts = max(64, n_rows // SLOT_ROWS)
    moved = moved.withColumn("_salt", F.pmod("_id_key", F.lit(salts)).cast("int"))
    counts = moved.groupBy("_shard", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select("_shard", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "starts")
    moved = moved.join(sized(starts, n_new * salts), ["_shard", "_salt"])
    place = Window.partitionBy("_shard", "_salt").orderBy("_id_key", f"_doc.{id_col}", "_text_key")
    moved = moved.withColumn("_slot", F.col("_start") + F.row_number().over(place) - 1)
    return moved.select("_doc.*", F.col("_size").alias(size), F.col("_shard").alias(shard), F.col("_slot").alias(slot), F.col("_old").alias(old))


def write_shards(placed: DataFrame, path: str, names: tuple[str, str, str, str] = ("size", "shard", "slot", "old_shard"), existing: bool = True) -> None:
    """Rewrite the shards that rows came to or left, one folder each; shards left empty are removed.

    With existing, path holds the old layout, and a shard none of whose rows came or went keeps its files;
    otherwise all shards are written. placed must not be read from path itself. The files are those of placed's own
    tasks, whose rows already lie together by shard and range of slots: no shuffle is added.
    """
    _, shard, slot, old = names
    spark = placed.sparkSession
    out, emptied = placed, []
    if existing:
        arcs = placed.where(F.col(old) != F.col(shard)).select(F.col(old).alias("a"), F.col(shard).alias("b")).distinct().collect()  # at most the pairs of shards that bear flow
        filled = {r[0] for r in placed.select(shard).distinct().collect()}
        affected = {x for r in arcs for x in r}
        emptied = sorted(affected - filled)
        out = placed.where(F.col(shard).isin(sorted(affected & filled)))
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        out.sortWithinPartitions(shard, slot).write.mode("overwrite").partitionBy(shard).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k in emptied:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top, f"{shard}={k}"), True)
