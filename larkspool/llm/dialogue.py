"""Conversation structure repair: role and fault sequences as short signatures, each solved once, their edits replayed.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Rows may be kept (K, free), given the
role user or assistant (R, 3), deleted (D, 4), and empty rows of either role inserted anywhere (I, 3). Blank rows and
repeats must go; a truncated row that stays adds 3. Of the cheapest audits, the least in ASCII order is taken.

Rows are put in order by ranges of (conversation, turn, role, text), so that a conversation of any length lies in
several tasks, and cut into runs of at most RUN rows. A run's signature has one letter a row. Each distinct
signature is solved once, for every state in front of it and behind it; a conversation's runs are then chained by their
tables of costs, one row for RUN rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized

#: Rows in a signature, at most.
RUN = 64
RETRO, RETIRE, FILL, CUT_OFF = 3, 4, 3, 3

#: What has been put out so far: nothing, only a system row, an open pair (assistant is next), whole pairs.
START, SYSTEM, OPEN, CLOSED = range(4)
#: The role that comes next, and the state behind it.
_NEXT = {START: ("u", OPEN), SYSTEM: ("u", OPEN), OPEN: ("a", CLOSED), CLOSED: ("u", OPEN)}
#: Cost, edits and roles that end a conversation in each state.
TAILS = ((0, "", ""), (2 * FILL, "II", "ua"), (FILL, "I", "a"), (0, "", ""))


def _edits(symbol: str, state: int):
    """Edits of one row without insertions before it: (letter, cost, role put out, next state), in ASCII order."""
    yield "D", RETIRE, "", state
    if symbol == "-":
        return
    role, cut_off = symbol.lower(), CUT_OFF * symbol.isupper()
    wanted, then = _NEXT[state]
    if role == "s" and state == START:
        yield "K", cut_off, "s", SYSTEM
    if role == wanted:
        yield "K", cut_off, wanted, then
    else:
        yield "R", RETRO + cut_off, wanted, then


def solve(signature: str) -> dict[tuple[int, int], tuple[int, str, tuple[str, ...]]]:
    """(state before, state behind) -> (cost, edits, roles put out at each row) of the cheapest way through a run.

    Memoised recursion over the places of the signature: the best ways from a place and state to each state at its end.
    Insertions stand right before a row that is kept or given a role; those behind the last row are TAILS. So the
    edits of two ways through the same rows never begin with each other, and the first that differs decides ties.
    The recursion starts at the last place and goes forward, so it is never deeper than one call.
    """
    memo: dict[tuple[int, int], dict[int, tuple[int, str, tuple[str, ...]]]] = {}

    def ways(at: int, state: int) -> dict[int, tuple[int, str, tuple[str, ...]]]:
        if at == len(signature):
            return {state: (0, "", ())}
        if (at, state) in memo:
            return memo[at, state]
        best: dict[int, tuple[int, str, tuple[str, ...]]] = {}
        ahead, cost, roles, now = "", 0, "", state
        for _ in range(3):  # no, one or two insertions; three would put out what one does
            for letter, price, role, then in _edits(signature[at], now):
                if letter == "D" and ahead:
                    continue  # the same as deleting first
                for end, (rest, edits, put) in ways(at + 1, then).items():
                    way = (cost + price + rest, ahead + letter + edits, (roles + role, *put))
                    if end not in best or way[:2] < best[end][:2]:
                        best[end] = way
            role, now = _NEXT[now]
            ahead, cost, roles = ahead + "I", cost + FILL, roles + role
        memo[at, state] = best
        return best

    for at in range(len(signature) - 1, -1, -1):
        for state in range(4):
            ways(at, state)
    return {(a, b): way for a in range(4) for b, way in ways(0, a).items()}


_WAYS = "array<struct<before:int,behind:int,cost:long,edits:string,put:array<string>>>"


def _solver(batches):
    for batch in batches:
        signatures = batch.column(0).to_pylist()
        ways = [[{"before": a, "behind": b, "cost": c, "edits": e, "put": list(p)} for (a, b), (c, e, p) in solve(s).items()] for s in signatures]
        kind = pa.list_(pa.struct([("before", pa.int32()), ("behind", pa.int32()), ("cost", pa.int64()), ("edits", pa.string()), ("put", pa.list_(pa.string()))]))
        yield pa.RecordBatch.from_arrays([pa.array(signatures, pa.string()), pa.array(ways, kind)], names=["signature", "ways"])


def _place(batches):
    """Adds part, run and place to rows in order: the task, the number of the row's run in its conversation here, and its place in the run."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, n = object(), 0
    for batch in batches:
        runs, places = [], []
        for conv in batch.column(0).to_pylist():
            n = n + 1 if conv == last else 0
            last = conv
            runs.append(n // RUN)
            places.append(n % RUN)
        extra = [pa.array([part] * len(runs), pa.int64()), pa.array(runs, pa.int64()), pa.array(places, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "part", "run", "place"])


def _costs_behind(batches):
    """Runs of each conversation, the last first -> the same with what it costs to finish behind them in each state."""
    last, rest = object(), []
    for batch in batches:
        out = []
        for conv, ways in zip(batch.column("conv").to_pylist(), batch.column("ways").to_pylist(), strict=True):
            if conv != last:
                last, rest = conv, [c for c, _, _ in TAILS]
            out.append(rest)
            rest = [min(w["cost"] + rest[w["behind"]] for w in ways if w["before"] == a) for a in range(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, "rest"])


_LEGAL = {"su", "ua", "au"}


def _choose(batches):
    """Runs of each conversation in order -> the way taken through each, and the end behind the last."""
    names = ["conv", "part", "run", "cost", "edits", "put", "tail", "illegal"]
    last, state, role = object(), START, ""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["conv"] != last:
                last, state, role = r["conv"], START, ""
            way = min((w for w in r["ways"] if w["before"] == state), key=lambda w: (w["cost"] + r["rest"][w["behind"]], w["edits"]))
            state = way["behind"]
            cost, edits, tail = TAILS[state] if r["final"] else (0, "", "")
            seen = role + r["roles"]
            illegal = sum(seen[i : i + 2] not in _LEGAL for i in range(len(seen) - 1))
            role = r["roles"][-1]
            rows.append((r["conv"], r["part"], r["run"], way["cost"] + cost, way["edits"] + edits, way["put"], tail, illegal))
        kinds = (batch.schema.field("conv").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)


@dataclass(frozen=True)
class Repaired:
    """turns: conv, part, run, place, sub (their order), role, text of the repaired rows. conversations: one row each, see repair."""

    turns: DataFrame
    conversations: DataFrame


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """Repairs every conversation of turns, in order of turn (null first), then role and text.

    conversations has conv, gaps (turns missing between the least and the largest; 0 if none is known), blank, duplicate,
    truncated (rows by their first fault), illegal (neighbours whose roles don't follow each other), cost and audit.

    Null roles and texts are one space, so a null text is blank. A null conversation is one of its own. Rows of one
    turn follow each other by role and text, equal rows stay beside each other. A very long text is one row and is
    only looked at by JVM functions; rows that are equal in conversation, turn, role and text share a task. Other columns are
    ignored, an empty table gives no rows.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    kind = dict(rows.dtypes)["conv"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_place, f"conv {kind}, turn long, role string, text string, part long, run long, place long")
    placed = materialize(placed, "turns")

    at = ["part", "conv", "run", "place"]
    initial = F.substring("role", 1, 1)
    looked = placed.select(
        *at,
        "turn",
        F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x")).alias("initial"),
        (~_has(F.col("text"), r"[^\x20\x09-\x0D]")).alias("is_blank"),
        (~_has(F.col("text"), r"[.!?][\x20\x09-\x0D]*\z")).alias("is_cut"),
        F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("said"),
    )
    # Of equal rows the first in order stands. It is found by a partial aggregate and joined by its own place, so no text is hot.
    first = looked.groupBy("conv", "said").agg(F.min(F.struct("part", "run", "place")).alias("at")).select("conv", "at.*", F.lit(False).alias("is_repeat"))
    a, b = looked.drop("said").alias("a"), first.alias("b")
    same = F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.run") == F.col("b.run")) & (F.col("a.place") == F.col("b.place"))
    fault = F.when(F.col("is_blank"), "blank").when(F.col("b.is_repeat").isNull(), "duplicate").when(F.col("is_cut"), "truncated")
    faulty = a.join(b, same, "left").select("a.*", fault.alias("fault"))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    letters = F.sort_array(F.collect_list(F.struct("place", symbol.alias("symbol"), "initial")))
    counts = [F.sum((F.coalesce(F.col("fault"), F.lit("")) == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")]
    runs = faulty.groupBy("conv", "part", "run").agg(letters.alias("rows"), *counts)
    runs = runs.select("conv", "part", "run", "blank", "duplicate", "truncated", F.array_join("rows.symbol", "").alias("signature"), F.array_join("rows.initial", "").alias("roles"))
    runs = materialize(runs, "runs")

    solved = materialize(runs.select("signature").distinct().mapInArrow(_solver, f"signature string, ways {_WAYS}"), "signatures")
    known = runs.select("conv", "part", "run", "signature", "roles").join(sized(solved, solved.count() * 16), "signature").drop("signature")
    backward = known.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("run")).mapInArrow(_costs_behind, f"conv {kind}, part long, run long, roles string, ways {_WAYS}, rest array<long>")
    final = runs.groupBy("conv").agg(F.max(F.struct("part", "run")).alias("end"))
    x, y = backward.alias("x"), final.alias("y")
    ended = x.join(y, F.col("x.conv").eqNullSafe(F.col("y.conv"))).select("x.*", (F.struct("x.part", "x.run") == F.col("y.end")).alias("final"))
    chosen = ended.repartition("conv").sortWithinPartitions("conv", "part", "run").mapInArrow(_choose, f"conv {kind}, part long, run long, cost long, edits string, put array<string>, tail string, illegal long")
    chosen = materialize(chosen, "edits")

    return Repaired(_replay(placed, chosen), _audits(placed, runs, chosen))


def _replay(placed: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows that stay, with their roles, and those put in before and behind them."""
    p, c = placed.alias("p"), chosen.select("conv", "part", "run", "put", "tail").alias("c")
    same = F.col("p.conv").eqNullSafe(F.col("c.conv")) & (F.col("p.part") == F.col("c.part")) & (F.col("p.run") == F.col("c.run"))
    df = p.join(c, same).select("p.*", F.element_at("put", (F.col("place") + 1).cast("int")).alias("put"), F.when(F.col("place") + 1 == F.size("put"), F.col("tail")).otherwise("").alias("tail"))

    def named(initial: Column) -> Column:
        return F.when(initial == "u", "user").otherwise("assistant")

    def empty(initials: Column) -> Column:
        each = F.filter(F.split(initials, ""), lambda c: c != "")
        return F.transform(each, lambda c: F.struct(named(c).alias("role"), F.lit("").alias("text")))

    stays, initial = F.length("put") > 0, F.right("put", F.lit(1))
    kept = F.when(F.substring("role", 1, 1) == initial, F.col("role")).otherwise(named(initial))
    own = F.when(stays, F.array(F.struct(kept.alias("role"), F.col("text").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    ahead = empty(F.substring(F.col("put"), F.lit(1), F.length("put") - 1))
    return df.select("conv", "part", "run", "place", F.posexplode(F.concat(ahead, own, empty(F.col("tail")))).alias("sub", "row")).select("conv", "part", "run", "place", "sub", "row.*")


def _audits(placed: DataFrame, runs: DataFrame, chosen: DataFrame) -> DataFrame:
    turns = placed.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    audit = F.array_join(F.expr("transform(array_sort(collect_list(struct(part, run, edits))), r -> r.edits)"), "")
    edits = chosen.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))
    faults = runs.groupBy("conv").agg(*[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    t, f, e = turns.alias("t"), faults.alias("f"), edits.alias("e")
    df = t.join(f, F.col("t.conv").eqNullSafe(F.col("f.conv"))).join(e, F.col("t.conv").eqNullSafe(F.col("e.conv")))
    return df.select("t.conv", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of repaired turns: of ``role:text``, joined by line feeds. Rows go by one at a time, none are gathered."""
    import hashlib

    kind = dict(turns.dtypes)["conv"]

    def run(batches):
        last, hasher = None, None
        for batch in batches:
            done = []
            for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "role", "text")], strict=True):
                if hasher is None or conv != last:
                    if hasher is not None:
                        done.append((last, hasher.hexdigest()))
                    last, hasher = conv, hashlib.sha256()
                else:
                    hasher.update(b"\n")
                hasher.update(f"{role}:{text}".encode())
            yield digest_rows(done, batch.schema.field("conv").type)
            kept = batch.schema.field("conv").type
        if hasher is not None:
            yield digest_rows([(last, hasher.hexdigest())], kept)

    def digest_rows(rows, conv_type):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], conv_type), pa.array([r[1] for r in rows], pa.string())], names=["conv", "repaired_sha256"])

    at = ["conv", "part", "run", "place", "sub"]
    return turns.repartition("conv").sortWithinPartitions(*at).mapInArrow(run, f"conv {kind}, repaired_sha256 string")
