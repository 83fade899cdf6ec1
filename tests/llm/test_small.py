"""Odd tables for every corpus operator and stage: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspool.llm import common, decontaminate, langid, licences, mixcoder, mixing, neardup, reshard, substrings, tokens, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, score string, h string, a string"


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = words(1, 30_000)
    rows = [(1, "the cat sat on the mat and the dog lay by the door", "en"), (2, None, "en"), (3, "", None), (4, " \t\n", "fr"), (5, "1234 !!", "fr"), (6, long, "en"), (7, long, "en"), (7, long, "en")]
    rows += [(None, "le chat est sur le tapis et le chien est dans la maison", "fr"), (8, "\U0001f600 日本語 テキスト", "en"), (9, "x", "en"), (10, "x", None)]
    full = [(i, t, g, None if i == 5 else "s", None, "z", "z", "z", "z", "z") for i, t, g in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_language(spark, odd, none):
    model = langid.fit(odd)
    got = langid.identify(odd, model)
    assert set(odd.columns) <= set(got.columns) and got.count() == 12
    rows = {r.doc_id: r for r in got.collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].rejected and rows[i]["score"] == 0 for i in (2, 3, 4, 5))
    assert rows[1].lang_pred == "en" and rows[None].lang_pred == "fr" and not rows[1].rejected
    assert langid.fit(none) is None
    assert langid.identify(odd, None).where("rejected").count() == 12
    assert langid.identify(none, model).count() == 0


def test_language_by_hand(spark, small):
    """Nearest centroid and cosine, recomputed text by text from the model's numbers."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs)
    for r in langid.identify(docs, model).limit(40).collect():
        raw = " " + "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) if b >= 128 or chr(b).isalpha() else " " for b in (r.text or "").encode()) + " "
        tri = {}
        for i in range(len(raw) - 2):
            g = raw[i : i + 3]
            if g[1] != " " or (g[0] != " " and g[2] != " "):
                slot = ((ord(g[0]) << 16 | ord(g[1]) << 8 | ord(g[2])) * int(common.GOLDEN) & (2**64 - 1)) >> (64 - langid.DIMS_BITS)
                tri[slot] = tri.get(slot, 0) + 1
        v = np.zeros(langid.DIMS)
        for k, n in tri.items():
            v[k] = (1 + np.log(n)) * model.idf[k]
        v /= max(1e-12, np.linalg.norm(v))
        cosine = model.centroids @ v
        if r.lang_pred != "und":
            assert model.languages[model.owner[cosine.argmax()]] == r.lang_pred and abs(min(1, max(0, cosine.max())) - r.score) < 1e-4


def test_language_rejects_by_length(spark, small):
    """Foreign and random texts of ordinary length go, labelled texts and their first words stay."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs)
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."
    code = base64.b64encode(np.random.default_rng(5).bytes(450)).decode()
    far = [polish, polish * 10, code, words(11, 100), words(12, 1000), words(13, 5000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(far)], "doc_id long, text string")
    assert langid.identify(df, model).where("not rejected").count() == 0
    clean = docs.where("length(text) > 600")
    for n in (2, 5, 20, 2000):
        first = clean.select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, n), " ").alias("text"))
        assert langid.identify(first, model).where("rejected").count() <= 0.01 * clean.count()


def test_samples_of_many_rows(spark):
    """More than 2**23 labelled rows of a class or language neither overflow nor take all."""
    labels = spark.range(9_000_000).select(F.col("id").alias("doc_id"), (F.col("id") % 900_000 == 0).cast("int").alias("toxic"))
    docs = spark.createDataFrame([(i * 900_000, "a bad word") for i in range(10)], "doc_id long, text string")
    assert toxicity.fit(docs, labels) is not None
    rows = spark.range(100_000).select(common.sample_key("id", F.lit(1)).alias("key"))
    got = rows.where(common.in_sample(F.col("key"), F.lit(1 << 40), (1 << 40) // 100)).count()
    assert 800 < got < 1200


def test_language_sample_of_null_ids(spark):
    """Rows without an id are sampled one by one: their language is learnt."""
    text = ["the cat sat on the mat number ", "le chat est sur le tapis de la maison "]
    rows = [(None, text[i % 2] + words(i, 2), ("en", "fr")[i % 2]) for i in range(4000)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("en", "fr")
    assert (~np.isnan(model.floor)).all() and (model.floor > 0).any()


def test_mix(spark, odd, none):
    got = mixing.mix(odd.where("text is null or length(text) < 100"), block=4).collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in got) and len(got) == 9
    assert mixing.mix(none).count() == 0
    same = [sorted((str(r.doc_id), r["size"], r.taken) for r in mixing.mix(odd).collect()) for _ in range(2)]
    assert same[0] == same[1]
    assert "a" in mixing.mix(odd).columns


@pytest.mark.parametrize("sizes", [(200, 129, 183), (1, 127, 128), (129, 255, 256), (257, 300, 5000), (3, 20_000, 40)])
def test_mix_takes_targets_to_the_word(spark, sizes):
    """Sources of one, two, three and many blocks, the last one short or not: each gives its rounded target, whatever is drawn."""
    rng = np.random.default_rng(sum(sizes))
    rows, n = [], 0
    for source, size in zip("abc", sizes):
        left = size
        while left:
            k = min(left, int(rng.integers(1, 70)))
            rows.append((n, words(n, k), source))
            n, left = n + 1, left - k
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    firsts = []
    for seed in (0, 1):
        got = mixing.mix(df, seed=seed).collect()
        for source in "abc":
            own = [r for r in got if r.source == source]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5, source
            assert all(r.taken <= 2 * r["size"] for r in own)
        assert all((r.first_shard is None) == (r.taken == 0) for r in got)
        firsts.append({r.doc_id: (r.first_shard, r.first_slot) for r in got})
    assert len(rows) < 5 or firsts[0] != firsts[1]  # another draw puts rows elsewhere


def test_mix_by_hand(spark):
    """Targets by repeated sharing of the excess; taken words by walking all slots."""
    rows = [(i, words(i, 5 + i % 40), "abcd"[i % 4] if i % 7 else None) for i in range(200)] + [(900 + i, words(i, 3), "e") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block=16).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split(" "))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, rest, free = {}, 1.5 * sum(size.values()), set(order)
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            want.update(share)
            break
        for s in over:
            want[s] = 2.0 * size[s]
            rest -= want[s]
            free.discard(s)
    by = {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        assert abs(r.target - want[by[r.doc_id]]) < 1e-6 and r.source_size == size[by[r.doc_id]] and r.taken <= 2 * r["size"]
        taken[by[r.doc_id]] = taken.get(by[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in order)
    # walk all slots: each holds one block of one source, in runs of rows that add up to what is taken
    held, walked, pieces = {}, {}, {}
    for r in mixing.mixture(df, block=16).collect():
        held.setdefault((r.shard, r.slot), set()).add((r.source, r.block))
        walked[r.id] = walked.get(r.id, 0) + r.words
        pieces.setdefault((r.source, r.block), {}).setdefault((r.shard, r.slot), []).append((r.id, r["first"], r.words))
    assert all(len(s) == 1 for s in held.values())
    assert {r.doc_id: r.taken for r in got} == {i: walked.get(i, 0) for i, _, _ in rows}
    for (s, _), turns in pieces.items():
        assert len(turns) <= 2 and all(sum(w for _, _, w in runs) <= 16 for runs in turns.values())
        assert all(a + w <= len(dict((i, t) for i, t, _ in rows)[i].split(" ")) for runs in turns.values() for i, a, w in runs)


def test_draws_fill_shards(spark, monkeypatch):
    """Counts of sources per shard are multinomial; another seed of the draw puts other blocks into a shard; totals are those asked for."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 100)
    rows = [(0, 300, 2, 0, 600), (1, 900, 1, 0, 900), (2, 3000, 0, 100 * 64, 500), (3, 700, 1, 0, 700)]
    wanted = spark.createDataFrame([(n, b, p, r, s) for n, b, p, r, s in rows], "source_no int, blocks long, passes long, rest long, slots long")
    wanted = wanted.withColumn("rest", F.when(F.col("source_no") == 2, F.lit(500 * 16).cast("long")).otherwise(F.col("rest")))
    total = 2700
    draws = mixing.drawn(wanted, 5).toPandas()
    assert len(draws) == total and draws.groupby("shard").size().eq(100).all()
    counts = draws.groupby(["shard", "source_no"]).size().unstack(fill_value=0)
    p = np.array([600, 900, 500, 700]) / total
    chi = ((counts.to_numpy() - 100 * p) ** 2 / (100 * p)).sum()
    freedom = 27 * 3
    assert abs(chi - freedom) < 4 * (2 * freedom) ** 0.5 and counts.to_numpy().std(axis=0).min() > 1
    one, two = (mixing.slots(wanted, 16, seed).toPandas() for seed in (5, 6))
    for got in (one, two):
        assert got.groupby("source_no").size().tolist() == [600, 900, 500, 700] and not got.duplicated(["shard", "slot"]).any()
        first = got[got.source_no == 0].groupby("block").size()
        assert len(first) == 300 and (first == 2).all()
    for k in (0, 5, 26):
        assert set(map(tuple, one[one.shard == k][["source_no", "block"]].to_numpy())) != set(map(tuple, two[two.shard == k][["source_no", "block"]].to_numpy()))
    # only what the totals need is moved
    both = one.merge(draws, on=["shard", "slot"])
    surplus = np.maximum(counts.sum().to_numpy() - np.array([600, 900, 500, 700]), 0).sum()
    assert (both.source_no_x != both.source_no_y).sum() == surplus


def test_mix_keeps_other_columns(spark):
    rows = [(i if i % 3 else None, words(i, 9), "ab"[i % 2], f"r{i}", f"n{i}", f"c{i}", f"d{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _row string, _n string, _copy string, _doc string")
    got = mixing.mix(df)
    assert {tuple(r) for r in got.select(df.columns).collect()} == set(rows)
    assert {r._copy for r in mixing.repeated(got).collect()} <= {f"c{i}" for i in range(30)}


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3))).collect()]
    assert sorted(got) == list(range(n))


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_licences(spark, odd, none):
    notes = {
        100: ("Words here.\nReleased under the MIT License.\nMore", {(1, "MIT")}),
        101: ("LICENSED!! UNDER CC BY-NC 4.0.", {(0, "CC-BY-NC")}),
        102: ("The driver had a licence for years", set()),
        103: (None, set()),
        104: ("SPDX-License-Identifier: AGPL-3.0-only", {(0, "AGPL")}),
        105: ("Distributed under the ISC license.", {(0, "ISC")}),
        106: ("Licensed under the Eclipse Public License v2.0", {(0, "EPL")}),
        107: ("Apache helicopters landed under the bridge", set()),
        108: ("/* x.c */\n\n" + MIT, {(2, "MIT")}),
        109: ("\n".join("# " + x for x in GPL.split("\n")), {(0, "GPL")}),
        110: ("This work is licensed under the GNU Affero General Public License, version 3.", {(0, "AGPL")}),
        111: ("Licensed under the Python Software Foundation License Version 2", set()),
        112: ("SPDX-License-Identifier: OFL-1.1", set()),
        113: ("of MIT and then it was under the terms of the bridge", set()),
        114: ("SPDX-License-Identifier: GPL-3.0-or-later\r\nSPDX-License-Identifier: MIT", {(0, "GPL"), (1, "MIT")}),
        115: ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {(0, "CC-BY-SA")}),
    }
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(k, t) for k, (t, _) in notes.items()], "doc_id long, text string"))
    model = licences.fit(docs)
    assert licences.LEAST <= model.floor <= 0.95
    found = licences.scan(docs, model).collect()
    got = {}
    for r in found:
        got.setdefault(r.id, set()).add((r.paragraph, r.family))
    assert got == {k: want for k, (_, want) in notes.items() if want}
    assert sorted(map(tuple, licences.scan(docs, model, everywhere=True).collect())) == sorted(map(tuple, found))
    assert licences.scan(none, model).count() == 0
    assert licences.scan(none, licences.fit(none)).count() == 0
    # the scores are those of the weights, worked out by hand
    for r in found:
        w = licences.split_words(r.said)
        grams = set(w) | set(licences.split_pairs(r.said))
        m = np.array(model.intercepts) + sum((np.array(model.weights[g]) for g in grams if g in model.weights), np.zeros(len(model.classes)))
        p = np.exp((m - m.max()) / model.temperature)
        assert abs(p.max() / p.sum() - r.probability) < 1e-9 and model.classes[m.argmax()] == r.family
        shares = [len(set(split) & set(licences.split_pairs(r.said))) / max(3, min(len(split), len(licences.split_pairs(r.said)))) for split in map(licences.split_pairs, licences.TEMPLATES[r.family])]
        assert abs(max(shares) - r.similarity) < 1e-9


def covered(texts):
    seen = {}
    for t in texts:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    out = []
    for t in texts:
        on = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                on[i : i + 200] = True
        out.append((len(t), int(on.sum()), int((np.diff(np.concatenate([[0], on.astype(np.int8)])) == 1).sum()), hashlib.sha256(bytes(b for b, o in zip(t, on) if not o)).hexdigest()))
    return out


def test_scratch_tables_are_removed(spark):
    def there(df):
        return os.path.exists(os.path.dirname(df.inputFiles()[0].removeprefix("file://")))

    with common.scratch(spark):
        with common.scratch(spark):
            a, b = (common.materialize(spark.range(3), "t", keep=k) for k in (False, True))
            both = common.materialize(a.union(b), "t", keep=True)
            names = [x.inputFiles()[0] for x in (a, b, both)]
        gone = [not os.path.exists(n.removeprefix("file://")) for n in names]
        assert gone == [True, False, False] and both.count() == 6 and there(both)
    c = common.materialize(spark.range(3), "t")
    assert not os.path.exists(names[1].removeprefix("file://")) and there(c) and c.count() == 3


@pytest.mark.parametrize("group", [256, 2])
def test_substrings(spark, odd, none, group, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", group)
    p, q = words(5, 60), words(6, 45)
    texts = [words(i, 30) + p[: 230 + 13 * i] + words(i + 50, 20) for i in range(6)] + ["a" * 450, "ab" * 300, p + q + p, q, "é" * 150, None, "", words(9, 20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("a", F.lit(1))
    got = {r.id: (r.n_bytes, r.n_removed, len(r.runs), r.kept_sha256) for r in substrings.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == covered([(t or "").encode() for t in texts])
    assert substrings.remove_repeats(none).count() == 0
    if group > 2:
        whole = {r.id: r for r in substrings.remove_repeats(odd).collect()}
        assert whole[7].n_removed == whole[7].n_bytes > 100_000 and whole[1].n_removed == 0 and whole[None].n_removed == 0


def test_strings_of_a_class_are_searched_without_what_they_share(monkeypatch):
    """Suffix arrays take what all strings of a class share as one symbol; windows found are those of comparing all."""
    rng = np.random.default_rng(4)
    sizes = []
    build = substrings.suffix_array
    monkeypatch.setattr(substrings, "suffix_array", lambda text: sizes.append(len(text)) or build(text))
    rows, want = [], set()
    for key in range(60):
        c = int(rng.integers(0, 4))
        first, last = c * 38, min(c * 38 + 37, 150)
        # around byte 0, the anchor: few different bytes away from it, the same for all in what they share
        shared = rng.integers(97, 123, 400)
        kinds = [np.where(rng.random(400) < 0.01, 200, shared) for _ in range(5)]
        for k in kinds:
            k[200 - first : 400 - last] = shared[200 - first : 400 - last]
        seen, own = {}, []
        for i, k in enumerate(kinds):
            lo, hi = int(rng.integers(first, first + 6)), int(rng.integers(last - 6, last + 1))
            text = k.astype(np.uint8).tobytes()
            own.append((i, lo, hi, text))
            for d in range(lo, hi + 1):
                seen.setdefault((d, text[200 - d : 400 - d]), []).append(i)
        want |= {(key, i, d) for (d, _), owners in seen.items() if len(owners) > 1 for i in owners}
        rows += [{"key": key, "part": 0, "parts": 1, "full": i, "h": key, "cid": i, "lo": lo, "hi": hi, "string": text[200 - hi : 400 - lo]} for i, lo, hi, text in own]
    found = substrings._search(pa.RecordBatch.from_pylist(rows[a : a + 100]) for a in range(0, len(rows), 100))
    got = [(r["h"], r["cid"], d) for out in found for r in out.to_pylist() for d in range(r["lo"], r["hi"] + 1)]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < sum(r["hi"] - r["lo"] + 1 for r in rows)
    assert sum(sizes) <= 76 * len(rows)


def test_removed_runs():
    """Spans in any order, nested, touching and apart; texts without spans, null and of several bytes a character."""
    rng = np.random.default_rng(8)
    texts = [None, "", "é" * 40] + [words(i, 30) for i in range(40)]
    spans = [None, [], None] + [[{"a": int(a), "b": int(a + n)} for a, n in zip(rng.integers(0, 60, k), rng.integers(1, 25, k), strict=True)] for k in rng.integers(0, 6, 40)]
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(-2, 43)), pa.array(["x", "y", *texts]), pa.array([[{"a": 0, "b": 1}], None, *spans], kind)], names=["id", "text", "spans"])
    (out,) = substrings._removed([batch.slice(2)])
    for t, own, r in zip(texts, spans, out.to_pylist(), strict=True):
        data = (t or "").encode()
        on = np.zeros(len(data) + 1, bool)
        for x in own or ():
            on[x["a"] : x["b"]] = True
        edges = np.flatnonzero(np.diff(np.append(False, on).astype(np.int8)))
        assert r["runs"] == edges.reshape(-1, 2).tolist() and (r["n_bytes"], r["n_removed"]) == (len(data), on.sum())
        assert r["kept_sha256"] == hashlib.sha256(bytes(b for b, o in zip(data, on) if not o)).hexdigest()


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.integers(1, rng.integers(2, 6), rng.integers(0, 40)).tolist()
        assert substrings.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_toxicity(spark, odd, none):
    bad = [(200 + i, words(i, 40) + (" vile vile dreck " + words(i + 99, 5) if i % 2 else ""), i % 2) for i in range(60)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([b[:2] for b in bad], "doc_id long, text string"))
    labels = spark.createDataFrame([(b[0], b[2]) for b in bad] + [(1, 0), (2, None), (None, 1), (3, 5), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all((got[b[0]].toxicity >= 0.5) == bool(b[2]) for b in bad)
    text, span = dict((b[0], b[1]) for b in bad)[201], got[201].passages[0]
    assert text.encode()[span.start : span.end] == b"vile vile dreck"
    assert all(0 <= r.toxicity < 0.5 and not r.passages for k, r in got.items() if k is None or k < 200)
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    alike = {round(r.toxicity, 9) for r in toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).collect()}
    assert len(alike) == 1 and alike.pop() < 0.05


def test_segments_take_linear_time():
    import time

    at, began = np.arange(0, 160_000 * 50, 50), time.process_time()
    assert len(toxicity.segments(at, np.full(len(at), 2.0), -0.1)) == len(at)
    assert time.process_time() - began < 5


def test_toxicity_by_hand(spark):
    """Evidence, passages and score of each text from the model's numbers, by a search over all stretches."""
    rows = [(i, words(i, 30) + (" vile vile dreck " + words(i + 99, 5) if i % 2 else "") + (" vile" if i % 3 == 0 else ""), i % 2) for i in range(60)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumns({"toxicity": F.lit(1), "evidence": F.lit("x"), "passages": F.lit(None).cast("int"), "_text": F.lit(3)})
    model = toxicity.fit(df, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    weight = dict(zip(model.words.tolist(), model.scores.tolist(), strict=True))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all(r._text == 3 for r in got.values())
    for i, text, _ in rows:
        h, _, _, _ = common.word_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), apart=common.NO_LETTER)
        x = [weight.get(int(v), model.other) for v in h.tolist()]

        def best(lo, hi):
            tops = [(sum(x[a : b + 1]), -a, -b) for a in range(lo, hi) for b in range(a, hi) if x[a] > 0 and x[b] > 0]
            if not tops:
                return []
            s, a, b = max(tops)
            return [*best(lo, -a), s, *best(1 - b, hi)]

        noise = np.log(model.k * len(x))
        strong = [s for s in best(0, len(x)) if -np.expm1(-np.exp(noise - model.decay * s)) <= 0.05]
        evidence = sum(model.decay * s - max(0.0, noise) for s in strong)
        assert abs(got[i].evidence - evidence) < 1e-6 and len(got[i].passages) == len(strong)
        assert abs(got[i].toxicity - 1 / (1 + np.exp(-(model.intercept + model.slope * np.log1p(max(0.0, evidence)))))) < 1e-6


def test_segments_are_those_of_the_definition():
    """Ruzzo and Tompa's segments, against a recursive search for the best subsequence."""
    rng = np.random.default_rng(3)

    def best(x, lo, hi):
        top = None
        for i in range(lo, hi):
            s = 0.0
            for j in range(i, hi):
                s += x[j]
                if top is None or s > top[0] + 1e-12:
                    top = (s, i, j)
        if top is None or top[0] <= 0:
            return []
        return [*best(x, lo, top[1]), (top[1], top[2]), *best(x, top[2] + 1, hi)]

    for _ in range(60):
        n = int(rng.integers(1, 14))
        at = np.flatnonzero(rng.random(n) < 0.4)
        scores = rng.integers(1, 5, len(at)) + rng.random(len(at))
        x = np.full(n, -1.3)
        x[at] = scores
        assert [(a, b) for a, b, _ in toxicity.segments(at, scores, -1.3)] == best(x, 0, n)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1 + i % 5, 8).tolist()) for i in range(300)] + [(300, None), (301, [float("nan")] * 8), (302, [None] * 8), (303, [0.0] * 8), (304, [1.0, 2.0]), (305, []), (None, [1.0] * 8), (306, [1e5] * 8)]
    rows += [(400 + i, [0.5] * 8) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    for sizes in ((4096, 512), (16, 7)):
        topk.CANDIDATE_ROWS, topk.QUERY_ROWS = sizes
        try:
            got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()}
        finally:
            topk.CANDIDATE_ROWS, topk.QUERY_ROWS = 4096, 4096
        good = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
        want = {}
        for q in good:
            if q % 20 == 0:
                scores = sorted((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q and len(good[c]) == len(good[q]))
                want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(scores[:20])}
        assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("spread,apart", [(2.0, 1.0), (0.02, 0.05)])
def test_prunings_pass_over_rows(monkeypatch, spread, apart):
    """Norms that fall fast are pruned by length, like norms and close neighbours by coordinate; hits are those of all products."""
    rng = np.random.default_rng(2)
    q = rng.normal(0, 64, (40, 16))
    c = np.repeat(q, 50, axis=0) + rng.normal(0, 64 * apart, (2000, 16))
    rng.shuffle(c)
    c *= (np.exp(-spread * np.arange(2000) / 2000) / np.linalg.norm(c, axis=1) * 6400)[:, None]
    q, c = np.floor(q).astype(np.int64), np.floor(c).astype(np.int64)
    ids, q_ids = np.arange(2000), np.arange(5000, 5040)
    every = q @ c.T
    floor = np.sort(every, axis=1)[:, -5].copy()
    computed = [0]
    products = topk._products

    def counted(a, b):
        computed[0] += len(a) * len(b)
        return products(a, b)

    monkeypatch.setattr(topk, "_products", counted)
    got = {i: list(zip(x.tolist(), s.tolist())) for i, x, s in topk.search_block(q_ids, q, floor, ids, c, 5)}
    for i in range(40):
        order = np.lexsort((ids, -every[i]))[:5]
        assert got[i] == list(zip(order.tolist(), every[i][order].tolist()))
    assert computed[0] < every.size * 0.8


def test_token_files(spark, odd, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens.write_tokens(odd, str(tmp_path / "t"), path)
    t = Tokenizer.from_file(path)
    want, at = [], 0
    for r in sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted(tokens.read_digests(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in got] == want
    assert {r.id: len(r.ids) for r in tokens.read_ids(spark, str(tmp_path / "t")).collect()}[9] == 2
    tokens.write_tokens(none, str(tmp_path / "e"), path)
    assert tokens.read_digests(spark, str(tmp_path / "e")).count() == 0


def test_pieces_give_the_ids_of_whole_texts():
    """Every way white space, special tokens and letters can meet; a task that forgets its pieces goes on."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, encoder = Tokenizer.from_file(path), tokens.Encoder(path)
    assert encoder.cut
    rng = np.random.default_rng(6)
    bits = ["a", "the", "'s", "don't", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\u200b", "7", "123", "é", "日本", "!", "...", "<|endoftext|>", "\U0001f600", "\r\n", "_"]
    texts = ["", " ", "a <|endoftext|> b", " a", "a ", words(3, 3000), "x" * 5000] + ["".join(bits[k] for k in rng.integers(0, len(bits), rng.integers(1, 30))) for _ in range(3000)]
    for a in range(0, len(texts), 500):
        ids, n = encoder.encode(texts[a : a + 500])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole.encode(t, add_special_tokens=False).ids for t in texts[a : a + 500]]
        if a == 1000:
            encoder.chars = tokens.PIECE_CHARS + 1
    encoder.cut = False
    ids, n = encoder.encode(texts[:9])
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole.encode(t, add_special_tokens=False).ids for t in texts[:9]]


def test_pieces_go_together_and_frequent_ones_are_kept(monkeypatch):
    """New pieces share a text, those seen again outlast forgetting, and ids stay those of whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, encoder = Tokenizer.from_file(path), tokens.Encoder(path)
    asked: list[str] = []
    ask = encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda texts: asked.extend(texts) or ask(texts))

    def check(texts):
        ids, n = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]

    common = [f"w{i}é" for i in range(200)]
    check([" ".join(["x", *common, *common, *(f"q{i}日" for i in range(5000))])])
    assert len(asked) < 30
    monkeypatch.setattr(tokens, "PIECES", 1000)
    asked.clear()
    check([" ".join(["x", *common, "fresh"])])
    assert sorted(t.strip() for t in asked) == ["fresh", "x"] and encoder.count[0] == 202
    # a frequent set that is too large is forgotten as well
    monkeypatch.setattr(tokens, "PIECES", 100)
    check([" ".join(["x", *common])])
    assert encoder.count[0] == 201
    # ids that don't stand for all bytes: each piece by itself
    encoder._token_bytes = np.zeros(1 << 17, np.int64)
    asked.clear()
    check(["x new words  here <|endoftext|> and there"])
    assert len(asked) > 3


def test_words_give_the_ids_of_whole_texts(monkeypatch):
    """Cuts inside and between words, doubtful white space, special tokens, nulls, slices; a worker that forgets its words goes on."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, encoder = Tokenizer.from_file(path), tokens.WordEncoder(path)
    rng = np.random.default_rng(8)
    bits = ["a", "The", "'s", "don't", "'S", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\u00a0", "\u180e", "\u2003", "\u200b", "\u3000", "7", "12", "\u00e9", "\u0301", "\u00aa", "日本", "!", ", ", "...", "_", "\x00", "\U0001f600"]
    texts = [None, "", " ", "\n", "a\n", "\nA", "x" * 5000]
    texts += ["".join(bits[k] for k in rng.integers(0, len(bits), rng.integers(1, 30))) for _ in range(4000)]
    texts += [t + "<|endoftext|>" + t for t in texts[7:60]]

    def check(some):
        ids, n = encoder.encode_arrow(pa.array(["left out", *some], pa.string()).slice(1))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole.encode(t or "", add_special_tokens=False).ids for t in some]

    check(texts)
    monkeypatch.setattr(tokens, "WORDS", 300)
    for a in range(0, len(texts), 400):
        check(texts[a : a + 400])
    encoder._token_bytes = np.zeros(1 << 17, np.int64)  # ids that don't stand for all bytes: each word by itself
    check(["new words, and\nmore of them"])
    encoder.cut = False
    check(texts[-20:])
    assert encoder.encode_arrow(pa.array([], pa.string()))[0].size == 0
    monkeypatch.setattr(tokens, "AT_ONCE", 10)
    assert tokens._portions(pa.array(["x" * 6, None, "x" * 4, "y", "", "z" * 30, "a"])) == [(0, 3), (3, 2), (5, 1), (6, 1)]
    assert tokens._portions(pa.array([], pa.string())) == [(0, 0)]


def test_words_go_through_the_library_once(monkeypatch):
    """Whatever stands behind a word, in whatever text and task of a worker: the library gets it once."""
    import public_tokenizers
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens._encoder.cache_clear()
    encoder, asked = tokens._encoder(path), []
    ask = encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda texts: asked.extend(texts) or ask(texts))
    some = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    for behind in (",", ".", ";", "?!", ")", ":"):
        encoder.encode_arrow(pa.array(["".join(f" {w}{behind}" for w in some)] * 3))
    assert sum(map(len, asked)) < 2 * sum(len(w) + 1 for w in some)
    asked.clear()
    assert tokens._encoder(path) is encoder
    encoder.encode_arrow(pa.array([" ".join(["", *some[::-1]])]))
    assert not asked
    tokens._encoder.cache_clear()


def test_range_coder_keeps_its_format():
    """The bytes are those that earlier versions wrote, also where lanes go in groups."""
    ids = (np.cumsum(np.arange(70_000) * 2654435761 % 97) % 3001).astype(np.uint32)
    code = mixcoder.encode_ids(ids)
    assert (len(code), zlib.crc32(code)) == (106904, 225215840)
    assert np.array_equal(mixcoder.decode_ids(code), ids)


def test_range_coder_encodes_in_groups(monkeypatch):
    ids = np.random.default_rng(3).zipf(1.2, 60_000).astype(np.uint32) % 5000
    code = mixcoder.encode_ids(ids)
    monkeypatch.setattr(mixcoder, "ENCODED_LANES", 3)
    assert mixcoder.encode_ids(ids) == code


@pytest.mark.parametrize("n", [0, 1, 5, 4096, 9000])
def test_range_coder(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_000, n), rng.zipf(1.3, n) % 300, np.full(n, 7), np.arange(n) * 5):
        code = mixcoder.encode_ids(ids.astype(np.uint32))
        assert np.array_equal(mixcoder.decode_ids(code), ids)
        if n == 5:
            for at in (len(code) - 3, 10, 30):
                broken = bytearray(code)
                broken[at] ^= 64
                try:
                    assert np.array_equal(mixcoder.decode_ids(bytes(broken)), ids)
                except ValueError:
                    pass
        if n:
            with pytest.raises(ValueError):
                mixcoder.decode_ids(code[:-1])
    assert len(mixcoder.encode_ids(np.full(9000, 7, np.uint32))) < 400


def test_range_coder_learns(small):
    """Blocks with their lists take less than the order-0 entropy of all ids; each block is read by itself."""
    import public_tokenizers
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{small}/documents.parquet", columns=["text"])["text"].to_pylist()
    ids, _ = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode([t or "" for t in texts])
    _, counts = np.unique(ids, return_counts=True)
    order0 = -(counts / len(ids) * np.log2(counts / len(ids))).sum()
    blocks = [b for b in np.array_split(ids, 8)]
    codes = [mixcoder.encode_ids(b) for b in blocks]
    assert np.array_equal(np.concatenate([mixcoder.decode_ids(c) for c in codes[::-1]][::-1]), ids)
    assert np.array_equal(mixcoder.decode_ids(b"".join(codes)), ids)
    # text whose ids follow from the two before, but not from their own frequency
    chain = np.tile(np.random.default_rng(1).integers(0, 4000, 300).astype(np.uint32), 100)
    assert 8 * len(mixcoder.encode_ids(chain)) < 2 * len(chain)
    assert 8 * len(mixcoder.encode_ids(ids)) < (order0 + 0.6) * len(ids)


def test_leaks(spark, odd, none):
    item = words(77, 60)
    edited = item[:40] + "zz" + item[44:150] + item[151:]
    docs = [(1, words(2, 50) + " " + item + words(3, 9)), (2, words(2, 50) + edited.upper() + "!!"), (3, words(2, 300)), (4, item[60:190]), (5, None), (6, ""), (7, item[:50])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame([(9, item), (10, None), (11, ""), (12, "short"), (None, item)], "item_id long, text string")
    found = decontaminate.contaminated(decontaminate.leaks(df, bench)).collect()
    assert {(r.id, r.item_id) for r in found} == {(1, 9), (2, 9), (4, 9)}
    one = next(r for r in found if r.id == 1)
    assert docs[0][1].encode()[one.start : one.end].decode().strip() == item and one.edits == 0
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.leaks(odd, bench).count() == 0


def test_leaks_excerpts(spark):
    """Every excerpt of the stated length is found, wherever it begins; random prose of the same length is not."""
    item, size = words(78, 60), decontaminate.EXCERPT
    assert size <= 80
    n = len(item) - size + 1
    docs = [(i, words(900 + i, 30) + " " + item[i : i + size] + " " + words(90 + i, 30)) for i in range(n)] + [(9000 + i, words(5000 + i, 90)) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (10, words(79, 60))], "item_id long, text string")
    found = decontaminate.contaminated(decontaminate.leaks(df, bench)).collect()
    assert sorted((r.id, r.item_id) for r in found) == [(i, 9) for i in range(n)]


def least_edits(piece: bytes, text: bytes) -> int:
    """Fewest edits that turn piece into some stretch of text, by the whole table."""
    t, j = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for c in piece:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (t != c))
        row = np.minimum.accumulate(new - j) + j
    return int(row.min())


def test_leaks_equal_all_pairs(spark, monkeypatch):
    """Every piece of every item against every text, by whole edit tables; in one pass and in several."""
    rng = np.random.default_rng(12)
    bench = [(i, words(600 + i, n)) for i, n in enumerate((45, 30, 14, 12, 9))] + [(50, "Yes!"), (51, "no way"), (52, "?!")]
    docs = [(0, "yes"), (1, " YES. "), (2, "yes yes"), (3, "no-way"), (4, "oh no way at all"), (5, "?!"), (6, None), (7, "")]
    for k in range(60):
        text = list(bench[k % 5][1])
        a = int(rng.integers(0, 1 + len(text) // 2))
        text = text[a : a + int(rng.integers(50, 260))]
        for _ in range(int(rng.integers(0, 12))):
            x = int(rng.integers(0, len(text)))
            text[x : x + int(rng.integers(0, 2))] = ["", "q", "z", "mm"][int(rng.integers(0, 4))]
        docs.append((100 + k, words(7000 + k, 8) + " " + "".join(text) + " " + words(8000 + k, 8)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    index = decontaminate.PassIndex(tuple(bench))
    want, number = set(), 0
    for x in index.pieces:
        for p, piece in enumerate(x.piece):
            for d, text in docs:
                edits = least_edits(piece.tobytes(), decontaminate._plain(text or ""))
                if edits <= len(piece) * decontaminate.BUDGET:
                    want |= {(d, item, number + p, edits) for item in x.items[p]}
        number += len(x.piece)
    assert {e for *_, e in want} >= {0, 1, 2, 3, 4, 5}
    want |= {(d, item, number, 0) for d, item in ((0, 50), (1, 50), (3, 51))}
    found = decontaminate.leaks(df, benchmark).collect()
    assert sorted((r.id, r.item_id, r.piece, r.edits) for r in found) == sorted(want)
    assert next((r.start, r.end) for r in found if r.id == 1) == (1, 4)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 150)
    for most, scans in ((1 << 20, 1), (300, 3)):  # several indexes in one scan, and several scans
        monkeypatch.setattr(decontaminate, "SCAN_BYTES", most)
        made = []
        monkeypatch.setattr(decontaminate, "materialize", lambda df, name: made.append(name) or common.materialize(df, name))
        several = decontaminate.contaminated(decontaminate.leaks(df, benchmark)).collect()
        assert {(r.id, r.item_id, r.edits) for r in several} == {(d, i, min(e for a, b, _, e in want if (a, b) == (d, i))) for d, i, _, _ in want}
        assert len(made) + 1 >= scans and (scans > 1 or not made)


def test_leaks_of_items_that_begin_alike(spark):
    """Items with one instruction ahead, and equal items: found where a text holds their own words, not where it holds the instruction."""
    rng = np.random.default_rng(31)
    ahead = words(500, 18)
    bench = [(i, ahead + " " + words(510 + i, 14)) for i in range(12)] + [(90, ahead + " " + words(510, 14)), (91, words(600, 12)), (92, words(600, 12))]
    docs = [(0, ahead), (1, " ".join(ahead + " " + words(700 + k, 6) for k in range(8))), (2, words(3, 40)), (3, words(600, 12))]
    for k in range(24):
        text = bench[k % 14][1]
        cut = text[int(rng.integers(0, 60)) :][: int(rng.integers(70, 220))]
        x = int(rng.integers(1, len(cut)))
        docs.append((10 + k, words(800 + k, 5) + " " + cut[:x] + "qz"[: k % 3] + cut[x + k % 2 :] + " " + words(900 + k, 5)))
    index = decontaminate.PassIndex(tuple(bench))
    want, number = set(), 0
    for x in index.pieces:
        for p, piece in enumerate(x.piece):
            for d, text in docs:
                edits = least_edits(piece.tobytes(), decontaminate._plain(text))
                if edits <= len(piece) * decontaminate.BUDGET:
                    want |= {(d, item, number + p, edits) for item in x.items[p]}
        number += len(x.piece)
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r.id, r.item_id, r.piece, r.edits) for r in found) == sorted(want) and len(want) > 100
    both = [{(r.id, r.piece) for r in found if r.item_id == i} for i in (91, 92)]
    assert both[0] == both[1] != set()


def test_shared_wording_is_cheap():
    """A thousand items with one instruction, a text that holds it a hundred times: seconds of work, not many minutes."""
    import time

    import pyarrow as pa

    ahead = words(500, 18)[:90]
    bench = tuple((i, ahead + " " + words(1000 + i, 25)) for i in range(1000))
    text = " ".join(ahead + " " + words(3000 + k, 250) for k in range(100)) + " " + bench[17][1]
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], names=["id", "text"])
    search = decontaminate._search(bench)
    list(search([batch]))  # the index is made once
    began = time.process_time()
    (found,) = search([batch])
    assert time.process_time() - began < 10
    # all hold the instruction itself; longer pieces are found of the one item whose own words stand there
    assert {r["item_id"] for r in found.to_pylist() if r["end"] - r["start"] > 80} == {17}


def test_banded_edits():
    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    rng = np.random.default_rng(4)
    for _ in range(80):
        p, t = rng.integers(0, 3, rng.integers(1, 12)).astype(np.uint8), rng.integers(0, 3, rng.integers(1, 20)).astype(np.uint8)
        want = plain(p.tolist(), t.tolist())
        assert decontaminate.banded_edits(p, t, -len(p) - 1, len(p) + len(t) + 3, 30)[0] == want


def test_reshard(spark, odd, none):
    rows = [(i, words(i, i % 50)) for i in range(600)] + [(1000 + i, "hot " * 40) for i in range(300)] + [(5000, None), (5001, None), (None, "x"), (7, words(7, 7))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash"))
    got = reshard.reshard(df, F.pmod(F.xxhash64("text"), F.lit(5)), 5, 8).collect()
    assert len(got) == len(rows)
    load, slots, where = {}, {}, {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r.slot)
        where.setdefault(r.text, set()).add(r["shard"])
        assert r["size"] == len((r.text or "").encode()) + 8
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 400
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for t, s in where.items() if t is None or not t.startswith("hot"))
    assert reshard.reshard(none, F.lit(0), 1, 4).count() == 0
    assert reshard.reshard(odd, F.lit(0), 1, 4).count() == 12


def test_min_cost_flow_moves_least():
    """Against a general solver of the same network, by shortest augmenting paths."""

    def cheapest(supply, capacity):
        n, m = len(supply), len(capacity)
        arcs = {(("s", 0), ("o", i)): [supply[i], 0] for i in range(n)} | {(("o", i), ("n", j)): [10**9, int(i != j)] for i in range(n) for j in range(m)} | {(("n", j), ("t", 0)): [capacity[j], 0] for j in range(m)}
        arcs |= {(b, a): [0, -c] for (a, b), (_, c) in arcs.items()}
        cost = 0
        while True:
            dist, came, changed = {("s", 0): 0}, {}, True
            while changed:
                changed = False
                for (a, b), (room, c) in arcs.items():
                    if room and a in dist and dist[a] + c < dist.get(b, 10**9):
                        dist[b], came[b], changed = dist[a] + c, a, True
            if ("t", 0) not in dist:
                return cost
            path, at = [], ("t", 0)
            while at in came:
                path.append((came[at], at))
                at = came[at]
            amount = min(arcs[e][0] for e in path)
            for a, b in path:
                arcs[a, b][0] -= amount
                arcs[b, a][0] += amount
            cost += amount * dist["t", 0]

    rng = np.random.default_rng(2)
    for n, m in ((3, 3), (5, 7), (7, 4), (1, 5), (4, 1)):
        for _ in range(4):
            supply = rng.integers(0, 100, n).tolist()
            capacity = [sum(supply) // m + (j < sum(supply) % m) for j in range(m)]
            flow = reshard.min_cost_flow(supply, capacity)
            assert [sum(f.values()) for f in flow] == supply and all(sum(f.get(j, 0) for f in flow) == capacity[j] for j in range(m))
            assert sum(x for i, f in enumerate(flow) for j, x in f.items() if i != j) == cheapest(supply, capacity)


@pytest.mark.parametrize("n_old, n_new", [(4, 2), (2, 4), (3, 3)])
def test_write_shards(spark, tmp_path, n_old, n_new):
    """A rewrite over the old layout leaves each row once, in its new shard; untouched shards keep their files."""
    df = spark.createDataFrame([(i, words(i, 20)) for i in range(200)], "doc_id long, text string")
    old = F.pmod(F.xxhash64("text"), F.lit(n_old)).cast("int")
    first = df.withColumns({"size": F.length("text").cast("long"), "slot": F.lit(0).cast("long"), "old_shard": old, "shard": old})
    path = str(tmp_path / "s")
    reshard.write_shards(first, path, existing=False)
    placed = reshard.reshard(df, old, n_old, n_new)
    reshard.write_shards(placed, path)
    rows = placed.collect()
    changed = {x for r in rows if r.old_shard != r["shard"] for x in (r.old_shard, r["shard"])}
    want = sorted((r.doc_id, r["shard"], r.slot if r["shard"] in changed else 0) for r in rows)
    got = spark.read.parquet(path).select("doc_id", "shard", "slot").collect()
    assert sorted((r.doc_id, r["shard"], r.slot) for r in got) == want and changed
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "s").rglob("*.parquet")}
    reshard.write_shards(placed.withColumn("old_shard", F.col("shard")), path)
    assert files == {f: f.stat().st_mtime_ns for f in (tmp_path / "s").rglob("*.parquet")}


def test_reshard_keeps_other_columns(spark):
    rows = [(None if i % 2 else i, words(i % 7, 9), i, i * 2, i * 3, i * 5, i * 7, i * 11) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _salt long, _block long, _n long, _start long, _text_key long, _doc long")
    assert sorted(map(tuple, reshard.reshard(df, F.lit(0), 1, 4).select(df.columns).collect()), key=str) == sorted(rows, key=str)


def exact_groups(rows, k, percent):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, odd, none, k):
    rng = np.random.default_rng(8)
    base = words(11, 80).split()
    rows = []
    for i in range(60):  # a chain of drifting copies and a cloud of edits of one text
        w = list(base)
        for j in rng.integers(0, 80, i % 9):
            w[j] = f"edit{i}x{j}"
        rows.append((i, " ".join(w)))
    rows += [(100, "A b"), (101, "a B"), (102, "a"), (103, "A"), (104, ""), (105, None), (106, " ".join(base).upper()), (107, words(3, 80)), (108, words(3, 79))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    got = {r.id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, k, 80).collect()}
    assert got == exact_groups(rows, k, 80)
    if k == 5:
        assert neardup.near_duplicates(none, k).count() == 0
        by = {(r.id, r.component_id) for r in neardup.near_duplicates(odd, k).collect()}
        assert (7, 6) in by and (10, 9) in by and (2, 2) in by and (3, 3) in by


def test_superminhash_is_the_published_one():
    """Registers against element-wise permutations without early stop; equal registers estimate similarity."""
    from larkspool.llm.common import golden, mix64

    m = 16
    elements = mix64(np.arange(1, 8, dtype=np.uint64))
    doc = np.array([0, 0, 0, 1, 1, 1, 1])
    want = np.full((2, m), np.iinfo(np.uint64).max, np.uint64)
    for e, d in zip(elements, doc):
        p = list(range(m))
        for j in range(m):
            u = int(mix64(np.array([e]) + golden(j + 1))[0])
            k = j + ((u >> 32) * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            want[d, p[j]] = min(int(want[d, p[j]]), j << 32 | u & 0xFFFFFFFF)
    assert np.array_equal(neardup.superminhash(elements, doc, 2, m), want)
    a = mix64(np.arange(1000, dtype=np.uint64))
    both = np.concatenate([a[:900], a[100:]])
    sig = neardup.superminhash(both, np.repeat([0, 1], 900), 2, 400)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.08
