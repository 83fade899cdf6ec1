"""Mixing sources to target weights: packed blocks, multinomial counts per output shard, index permutations. Native Spark only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, sized

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 128
#: Slots of an output shard, at least; no more than MOST_SHARDS shards are made.
SHARD_SLOTS, MOST_SHARDS = 4096, 1 << 16
#: Numbers looked up in a table of ranges go by runs of this many.
RUN = 4096
ROUNDS = 16


def permuted(x: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 for any n >= 1, chosen by seed: the swap-or-not shuffle.

    Each round pairs x with (k - x) mod n, k drawn for the round, and one hashed bit of the pair's larger
    member decides whether the two change places; so every round, and all of them, are one to one.
    """

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *seed), n) - at, n)
        return F.when(F.xxhash64(F.greatest(at, other), r, *seed).bitwiseAND(1) == 1, other).otherwise(at)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), x.cast("long"), step)


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (source, source_size) with source_no, weight and target.

    Sources in order of code points, null last, bear the weights in turn and share ratio times all words by
    weight; no target exceeds cap times its source's words, and what a capped source leaves over is shared
    again by weight among the others. In order of words per weight the capped sources come first, so two
    running sums give the level at which this ends. One row per source: small enough for one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = sources.withColumn("source_no", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns(
        {
            "total": F.sum("source_size").over(everything) * F.lit(float(ratio)),
            "cap_before": F.coalesce(F.sum("cap").over(by_need), F.lit(0.0)),
            "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_need), F.lit(0)),
        }
    )
    fits = F.col("cap_before") + F.col("cap") / F.col("weight") * F.col("weight_left") <= F.col("total")
    level = F.max(F.when(~fits, (F.col("total") - F.col("cap_before")) / F.col("weight_left"))).over(everything)
    ranked = ranked.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return ranked.select("source", "source_size", "source_no", "weight", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0, block: int = BLOCK_WORDS, seed: int = 0, with_text: bool = True) -> DataFrame:
    """docs with size, source_size, target and taken: the words of this row that all output shards take, repeats counted.

    See mixture() for how shards are filled; taken adds up what they hold, for each source its rounded target to the word. A
    word is taken twice at most when cap is 2. first_shard and first_slot are where the first of them stand (null if none do),
    as the draws put them.

    A null or empty text has no words and is taken 0 times; a null source is a source; equal rows each hold
    their own words; an empty table gives no rows; a very long text costs one row for each block it reaches
    into. Columns that bear one of the new names are replaced, whatever the others are called. The same rows and
    seed give the same result. Without with_text, docs of id, text and source come back as id and source alone,
    and no text is shuffled.
    """
    added = ("size", "source_size", "target", "taken", "first_shard", "first_slot")
    kept = [c for c in docs.columns if c not in added]
    packed = _Packed(docs, id_col, text_col, source_col, weights, ratio, cap, block)
    per_row = packed.contents(seed).groupBy("source_no", "_bucket", "_rn").agg(F.sum("words").alias("taken"), F.min(F.struct("shard", "slot")).alias("_first"))
    out = packed.rows.select("source_no", "_bucket", "_rn", "_id", "_src", "_row", "size").join(per_row, ["source_no", "_bucket", "_rn"], "left")
    out = out.join(sized(packed.wanted.select("source_no", "source_size", "target"), packed.n_sources), "source_no")
    out = out.select("_id", "_src", "_row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("_first.shard").alias("first_shard"), F.col("_first.slot").alias("first_slot"))
    if set(kept) <= {id_col, text_col, source_col} and not with_text:
        return out.select(F.col("_id").alias(id_col), F.col("_src").alias(source_col), *added)
    # the other columns, packed so that their names can't clash, come back by a hash of the row; equal rows are told apart by number
    same = Window.partitionBy("_row").orderBy("_row")
    out = materialize(out.select("_row", *added), "mixed").withColumn("_n", F.row_number().over(same))
    whole = docs.select(F.struct(*kept).alias("_doc"), _row_key(id_col, text_col, source_col).alias("_row")).withColumn("_n", F.row_number().over(same))
    return whole.join(out, ["_row", "_n"]).select("_doc.*", *added)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0, block: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """(shard, slot, source, block, id, first, words): what every slot of every output shard holds, in runs of one row's words.

    The words of each source, its rows in a hashed order, lie end to end in blocks of ``block`` words, the last
    one shorter. Every slot of a shard draws its source by the targets, so a shard's counts of sources are
    multinomial; what the draws of a source are over its target, all shards together, goes to those that are
    short of theirs, so only totals are put right. A source's slots are numbered through all shards; a
    permutation of the source's own maps their numbers to numbers of blocks, and slots join blocks by number. All
    blocks of a source are taken before any comes again; the last turn takes blocks of full length first, and its last
    slot only the words that the target still needs. first counts from 0 in the row's own words. Rows that agree in id, source and text are numbered
    in one window; any others, without an id or not, are dealt by hash.
    """
    packed = _Packed(docs, id_col, text_col, source_col, weights, ratio, cap, block)
    held = packed.contents(seed).join(packed.rows.select("source_no", "_bucket", "_rn", F.col("_id").alias("id"), F.col("_src").alias("source")), ["source_no", "_bucket", "_rn"])
    return held.select("shard", "slot", "source", "block", "id", "first", "words")


def _row_key(id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(id_col, F.isnull(id_col), source_col, F.isnull(source_col), F.xxhash64(text_col, F.lit(7)))


class _Packed:
    """Rows with their place in their source's words, and what each source must give."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], ratio: float, cap: float, block: int):
        self.block = block
        words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
        key = F.xxhash64(id_col, F.xxhash64(text_col, F.lit(7)), F.lit(0))
        narrow = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), words.alias("size"), key.alias("_key"), _row_key(id_col, text_col, source_col).alias("_row"))
        rows = materialize(narrow, "sized")
        sources = materialize(rows.groupBy(F.col("_src").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), "sources")
        n_rows = sources.agg(F.sum("n_rows")).first()[0] or 0
        self.n_sources = sources.count()
        wanted = targets(sources.drop("n_rows"), weights, ratio, cap)
        size, goal = F.col("source_size"), F.round("target").cast("long")
        wanted = wanted.withColumns({"blocks": F.ceil(size / block), "full": F.floor(size / block), "passes": F.when(size > 0, F.floor(goal / size)).otherwise(0), "rest": F.when(size > 0, goal % size).otherwise(0)})
        wanted = wanted.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block))
        self.wanted = materialize(wanted, "targets")

        # positions of rows in their source's words: sums inside hashed buckets, then sums of buckets
        buckets = max(64, int(n_rows**0.5))
        names = sized(self.wanted.select(F.col("source").alias("_name"), "source_no"), self.n_sources)
        rows = rows.join(names, F.col("_src").eqNullSafe(F.col("_name"))).drop("_name").withColumn("_bucket", F.pmod("_key", F.lit(buckets)).cast("int"))
        inside = Window.partitionBy("source_no", "_bucket").orderBy("_key", "_row")
        rows = rows.withColumns({"_rn": F.row_number().over(inside), "_at": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
        self.rows = materialize(rows, "packed")
        ahead = Window.partitionBy("source_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = self.rows.groupBy("source_no", "_bucket").agg(F.sum("size").alias("words")).withColumn("_from", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
        self.starts = sized(materialize(starts, "starts"), self.n_sources * buckets)

    def contents(self, seed: int) -> DataFrame:
        """(shard, slot, source_no, block, _bucket, _rn, first, words): the runs of rows that slots take."""
        block = self.block
        spans = self.rows.select("source_no", "_bucket", "_rn", "size", "_at").where("size > 0").join(self.starts, ["source_no", "_bucket"])
        spans = spans.select("source_no", "_bucket", "_rn", "size", (F.col("_from") + F.col("_at")).alias("at"))
        spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
        held = spans.join(slots(self.wanted, block, seed), ["source_no", "block"])
        begin = F.greatest(F.col("at"), F.col("block") * block)
        end = F.least(F.col("at") + F.col("size"), F.col("block") * block + F.coalesce("part", F.lit(block)))
        return held.withColumns({"words": end - begin, "first": begin - F.col("at")}).where("words > 0").select("shard", "slot", "source_no", "block", "_bucket", "_rn", "first", "words")


def _owners(numbers: DataFrame, number: str, ranges: DataFrame, total: int, n_ranges: int) -> DataFrame:
    """numbers joined with the one of ranges (lo, n, more columns) that holds each number below total, by runs of numbers."""
    ranges = ranges.where("n > 0").withColumn("_run", F.explode(F.sequence(F.floor(F.col("lo") / RUN), F.floor((F.col("lo") + F.col("n") - 1) / RUN))))
    found = numbers.withColumn("_run", F.floor(F.col(number) / RUN)).join(sized(ranges, n_ranges + total // RUN + 1), "_run")
    return found.where((F.col(number) >= F.col("lo")) & (F.col(number) < F.col("lo") + F.col("n"))).drop("_run")


def drawn(wanted: DataFrame, seed: int = 0) -> DataFrame:
    """(shard, slot, source_no) of every slot: independent draws, each source as likely as it has slots among all."""
    total = wanted.agg(F.sum("slots")).first()[0] or 0
    per_shard = max(SHARD_SLOTS, -(-total // MOST_SHARDS))
    draws = wanted.sparkSession.range(total).select(F.floor(F.col("id") / per_shard).alias("shard"), F.pmod("id", F.lit(per_shard)).alias("slot"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, total))).alias("ticket"))
    lo = F.sum("slots").over(Window.orderBy("source_no")) - F.col("slots")
    ranges = wanted.select("source_no", lo.alias("lo"), F.col("slots").alias("n"))
    return _owners(draws, "ticket", ranges, total, wanted.count()).select("shard", "slot", "source_no")


def slots(wanted: DataFrame, block: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """Every slot of the mix: shard, slot, source_no, block, and part, the words it takes of a block it doesn't take whole.

    wanted holds source_no, slots, blocks, full (those of full length; all, if it isn't there), passes and rest.
    """
    wanted = wanted if "full" in wanted.columns else wanted.withColumn("full", F.col("blocks"))
    draws = materialize(drawn(wanted, seed), "drawn")
    n_sources = wanted.count()
    counts = draws.groupBy("source_no", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("_from", F.coalesce(F.sum("n").over(before), F.lit(0))), "shard_counts")
    got = counts.groupBy("source_no").agg(F.sum("n").alias("got"))
    plan = wanted.select("source_no", "blocks", "full", "passes", "rest", "slots").join(sized(got, n_sources), "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    over, short = F.greatest(F.col("got") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("got"), F.lit(0))
    by = Window.orderBy("source_no")
    plan = materialize(plan.withColumns({"short": short, "over_lo": F.sum(over).over(by) - over, "short_lo": F.sum(short).over(by) - short}), "plan")

    inside = Window.partitionBy("source_no", "shard").orderBy("slot")
    numbered = draws.withColumn("_rn", F.row_number().over(inside)).join(sized(counts.select("source_no", "shard", "_from"), counts.count()), ["source_no", "shard"])
    numbered = numbered.join(sized(plan.select("source_no", "slots", "got", "over_lo"), n_sources), "source_no")
    number = F.col("_from") + F.col("_rn") - 1
    # of a source drawn too often, its permuted numbers from its target on are given away
    order = F.when(F.col("got") > F.col("slots"), permuted(number, F.col("got"), F.lit(seed + 2), F.col("source_no"))).otherwise(number)
    numbered = materialize(numbered.select("shard", "slot", "source_no", "slots", "over_lo", order.alias("order")), "numbered")
    given = numbered.where("order >= slots").select("shard", "slot", (F.col("over_lo") + F.col("order") - F.col("slots")).alias("given"))
    total = plan.agg(F.sum("short")).first()[0] or 0
    taken = _owners(given, "given", plan.select("source_no", "got", F.col("short_lo").alias("lo"), F.col("short").alias("n")), total, n_sources)
    taken = taken.select("shard", "slot", "source_no", (F.col("got") + F.col("given") - F.col("lo")).alias("order"))
    final = numbered.where("order < slots").select("shard", "slot", "source_no", "order").union(taken)
    final = final.join(sized(plan.select("source_no", "blocks", "full", "passes", "rest"), n_sources), "source_no")
    turn, index = F.floor(F.col("order") / F.col("blocks")), F.pmod("order", F.col("blocks"))
    whole = (turn < F.col("passes")) | (index < F.floor(F.col("rest") / block))
    # the last turn, which takes only some blocks, is dealt over those of full length; a shorter one comes behind them
    among = F.when(turn < F.col("passes"), F.col("blocks")).otherwise(F.col("full"))
    chosen = F.when(index < among, permuted(index, F.greatest(among, F.lit(1)), F.lit(seed + 1), F.col("source_no"), turn)).otherwise(index)
    return final.select("shard", "slot", "source_no", chosen.alias("block"), F.when(~whole, F.col("rest") % block).alias("part"))


def repeated(mixed: DataFrame, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """Rows of a mix as often as it takes them: once for each whole taking, and once more with a chance of the
    remaining share of their words, by a hash of the id. Rows of no words are not in a mix; rows without an id
    or with one id share one hash; equal rows are each repeated by what is taken of them."""
    share = F.col("taken") / F.greatest(F.col("size"), F.lit(1))
    chance = F.pmod(F.xxhash64(id_col, F.lit(seed + 11)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    copies = F.floor(share) + (chance < share - F.floor(share)).cast("long")
    return mixed.select(F.struct(*mixed.columns).alias("_doc"), F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)))).select("_doc.*")
