"""Conversation repair: against a search over all audits, long conversations, odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from larkspool.llm import dialogue, op13

WHITE = " \t\n\x0b\x0c\r"
FORM = re.compile(r"(s?(ua)+)?")


def all_audits(symbols):
    """The cheapest, then ASCII-least audit of a short signature, by trying every edit string."""
    best = None
    for edits in itertools.product("DKR", repeat=len(symbols)):
        if any(s == "-" and e != "D" for s, e in zip(symbols, edits)):
            continue
        base = sum({"D": 4, "K": 0, "R": 3}[e] + (3 if e != "D" and s.isupper() else 0) for s, e in zip(symbols, edits))
        for gaps in itertools.product(range(3), repeat=len(symbols) + 1):
            cost = base + 3 * sum(gaps)
            audit = "".join("I" * g + e for g, e in zip(gaps, edits)) + "I" * gaps[-1]
            if best is not None and (cost, audit) >= best:
                continue
            options = []
            for g, s, e in zip(gaps, symbols, edits):
                options += ["ua"] * g + ([] if e == "D" else [s.lower()] if e == "K" else ["ua"])
            options += ["ua"] * gaps[-1]
            if any(FORM.fullmatch("".join(o)) for o in itertools.product(*options)):
                best = cost, audit
    return best


@pytest.mark.parametrize("n", range(5))
def test_signatures_against_all_audits(n):
    rng = random.Random(n)
    for symbols in {"".join(rng.choices("suaxSUAX-", k=n)) for _ in range(25)}:
        ways = dialogue.solve(symbols)
        ends = [(c + dialogue.TAILS[b][0], e + dialogue.TAILS[b][1]) for (a, b), (c, e, _) in ways.items() if a == dialogue.START]
        assert min(ends) == all_audits(symbols), symbols


def expected(rows):
    """One conversation's digest columns, by a plain dynamic programme over whole strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.strip(WHITE)
        faults.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    names = {"u": "user", "a": "assistant"}

    def with_insertions(best):
        for _ in range(3):
            for (state, (cost, audit, out)), role in itertools.product(list(best.items()), "ua"):
                to = follow.get((state, role))
                if to and (to not in best or (cost + 3, audit + "I") < best[to][:2]):
                    best[to] = cost + 3, audit + "I", (out, (names[role], ""))
        return best

    best = {"": (0, "", None)}
    for (_, role, text), fault in zip(rows, faults):
        found, late = {}, with_insertions(dict(best))
        for state, (cost, audit, out) in late.items():
            options = [(state, cost + 4, audit + "D", out)]
            if fault not in ("b", "d"):
                more = 3 if fault == "t" else 0
                options += [(follow[state, r], cost + 3 + more, audit + "R", (out, (names[r], text))) for r in "ua" if (state, r) in follow]
                if (state, role[:1]) in follow:
                    options.append((follow[state, role[:1]], cost + more, audit + "K", (out, (role, text))))
            for to, *way in options:
                if to not in found or tuple(way[:2]) < found[to][:2]:
                    found[to] = tuple(way)
        best = found
    cost, audit, out = min((w for s, w in with_insertions(best).items() if s in ("", "a")), key=lambda w: w[:2])
    lines = []
    while out:
        out, row = out
        lines.append("{}:{}".format(*row))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *[faults.count(f) for f in "bdt"], illegal, cost, audit, hashlib.sha256("\n".join(lines[::-1]).encode()).hexdigest()


def harmed(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        kept += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return out


def run(spark, rows, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string, conv string, run int").repartition(3).write.parquet(path)
    got = op13.op13_signature_repair(spark, str(tmp_path)).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r[0]: tuple(r)[1:] for r in got}


def test_odd_and_long_conversations(spark, tmp_path):
    rng = random.Random(13)
    roles = ["user", "assistant", "system", "tool", "", None, "Ünknown"]
    texts = ["Fine.", "Fine! ", "cut off", "a\n?\t", "", " ", None, "　", "é.", "x" * 200_000 + "."]
    rows = [(c, rng.choice([None, *range(12)]), rng.choices(roles, [5, 5, 2, 1, 1, 1, 1])[0], rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randrange(1, 14))]
    # conversations of many runs: regular, random, all blank, all equal
    rows += [(100, t, ("user", "assistant")[t % 2], f"Line {t}.") for t in range(1500)]
    rows += [(101, t, rng.choice(roles), rng.choice([f"Line {t}.", f"line {t}", " "])) for t in range(2000)]
    rows += [(102, t, "user", " ") for t in range(300)] + [(103, 5, "user", "Same.")] * 400 + [(104, None, "system", "Only.")]
    full = [(*r, "z", "z", 7) for r in rows]
    got = run(spark, full, tmp_path)
    want = {c: expected(kept) if kept else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, kept in harmed(rows).items()}
    assert got == want


def test_each_distinct_signature_is_solved_once(spark, tmp_path, monkeypatch):
    """Copies of a conversation under other numbers share signatures: the table of ways has one row for each."""
    made = []
    real = dialogue.materialize
    monkeypatch.setattr(dialogue, "materialize", lambda df, name, keep=False: made.append((name, out := real(df, name, keep))) or out)
    rows = [(c, t, ("user", "assistant")[t % 2], f"Yes {t}.") for c in range(500) for t in range(4)]
    dialogue.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(1)).conversations.collect()
    solved = dict(made)["signatures"]
    assert solved.count() == solved.select("signature").distinct().count() < 12
    assert dict(made)["runs"].count() >= 500


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert op13.op13_signature_repair(spark, str(tmp_path)).count() == 0
