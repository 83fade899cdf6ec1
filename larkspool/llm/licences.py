"""Licence scan: a trained paragraph classifier over word n-grams, confirmed by comparison with templates. Native Spark only."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

# Notices by which the licence families are known.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE for details.",
        "This project is distributed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
        "Licensed under the GPL v2 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause license",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "This work is dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the AGPL v3 or later",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "ISC": (
        "Distributed under the ISC license.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ),
    "EPL": (
        "Licensed under the Eclipse Public License v2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "zlib": (
        "Released under the zlib license.",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ),
    "Artistic-2.0": (
        "This library is free software; you can redistribute it under the terms of the Artistic License 2.0",
        "SPDX-License-Identifier: Artistic-2.0",
    ),
}
# Words, apart by single spaces, that a notice of each family says; without them none is confirmed.
NAMES: dict[str, str] = {
    "MIT": "mit licen|identifier mit|granted free of charge to any person",
    "Apache-2.0": "apache",
    "GPL": "gpl|gnu general public",
    "LGPL": "lgpl|lesser general public|library general public",
    "BSD": "bsd|redistribution and use in source and binary",
    "MPL-2.0": "mpl|mozilla public",
    "CC-BY": "cc by (?!sa|nc|nd)|creative commons attribution (?!share|non|no)",
    "CC-BY-SA": "cc by sa|attribution sharealike|attribution share alike",
    "CC-BY-NC": "cc by nc|attribution noncommercial|attribution non commercial",
    "public-domain": "public domain|cc0|unencumbered software",
    "AGPL": "agpl|affero general public",
    "ISC": "isc|permission to use copy modify and or distribute this software",
    "EPL": "epl|eclipse public",
    "BSL-1.0": "bsl|boost software",
    "zlib": "zlib|liable for any damages arising from the use of this software",
    "Artistic-2.0": "artistic license|artistic 2",
}
# Sentences that use words of licences and are none.
NO_LICENCE = (
    "The driver had no licence and the version of events was released under oath.",
    "A license is required to sell food in a public place.",
    "All rights reserved by the author of this general report.",
    "The company licensed the film to a network under a new contract.",
    "Free software and public transport were topics of the general meeting.",
    "The creative team used common words and attribution by name.",
    "The foundation published the terms of the grant in version two of the report.",
    "Permission is required to enter, and a copy of the ticket must be kept.",
    "The source of the river is subject to the weather; redistribution of water is permitted.",
    "Released last year, the work was distributed under her own name.",
    "Apache helicopters landed under the bridge.",
    "Students of MIT and other universities released a study on software licences.",
    "The eclipse was seen by the public under a clear sky in version two of the programme.",
    "Licensed under the terms of another license, version 1.0.",
    "Distributed under a license of its own.",
    "SPDX-License-Identifier: LicenseRef-Internal",
)
UNKNOWN = "unknown"
#: Corpus paragraphs that the unknown class is fitted and calibrated on, about.
SAMPLE = 4000
#: A paragraph is confirmed where it shares this part of a template's word pairs and says a family's name.
CONFIRM = 0.6
#: No family is reported below this chance, nor below what all but this share of calibration paragraphs without a licence reach.
LEAST, QUANTILE = 0.5, 0.995
_APART = r"[^\p{L}\p{N}]+"
#: Lines of 50 characters or more that don't end a sentence go on in the next line, but for one that is a licence tag.
_WRAPPED = r"(?=[\r\n])(?<=[^\r\n]{50})(?<=[^\s.!?:;][ \t]{0,3})(?:\r\n|\r|\n)(?!\W*SPDX-)(?=[^\r\n]*[\p{L}\p{N}])"
_GRID_T = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
_GRID_B = (-2.0, -1.0, 0.0, 1.0, 2.0, 4.0)


@dataclass(frozen=True)
class LicenceModel:
    classes: tuple[str, ...]  # unknown is the first
    intercepts: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]  # by n-gram
    temperature: float
    floor: float  # least chance of a family that is reported


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _APART), lambda w: w != "")


def pairs(w: Column) -> Column:
    """Neighbouring words of an array of words."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def grams(w: Column) -> Column:
    """Distinct words and word pairs."""
    return F.array_distinct(F.concat(w, pairs(w)))


def paragraphs(text: Column) -> Column:
    """Lines of a text that hold anything, with their number; lines that were wrapped are one."""
    lines = F.split(F.regexp_replace(text, _WRAPPED, " "), r"\r\n|\r|\n")
    return F.filter(F.transform(lines, lambda p, i: F.struct(i.alias("paragraph"), p.alias("said"))), lambda p: F.trim(p["said"]) != "")


def split_words(text: str) -> list[str]:
    """words() of a fixed text."""
    return [x for x in re.split(r"[^\w]+|_", text.lower()) if x]


def split_pairs(text: str) -> list[str]:
    w = split_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def _examples() -> list[tuple[str, list[str]]]:
    """(family, words): templates and their cuts to three fifths or more that still say the family's name, and sentences that are no licence."""
    out = []
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, NO_LICENCE)]:
        for text in texts:
            w = split_words(text)
            for n in sorted({len(w), math.ceil(len(w) * 0.8), math.ceil(len(w) * 0.6)}):
                cuts = [w[i : i + n] for i in range(len(w) - n + 1)]
                out += [(family, c) for c in cuts if family == UNKNOWN or re.search(rf"\b({NAMES[family]})", " ".join(c) + " ")]
    return out


def _vocabulary() -> list[str]:
    """Words and word pairs of all fixed texts."""
    texts = [t for ts in [*TEMPLATES.values(), NO_LICENCE] for t in ts]
    return sorted({g for t in texts for g in [*split_words(t), *split_pairs(t)]})


def fit(docs: DataFrame, text_col: str = "text") -> LicenceModel:
    """Sparse multinomial logistic regression on word n-grams.

    Positive examples are the templates and their cuts; the unknown class has the other sentences and about
    SAMPLE paragraphs of the corpus, those whose hashed text is smallest in share, but for those that are
    confirmed as a template's. N-grams of the fixed texts are the features. Every second example of each class, by
    a hash, fits the weights; the others, which the weights have not seen, choose the temperature and the weight
    of the unknown class by log loss, and the chance below which no family is reported. Only weights reach the driver.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.length(F.col(text_col)))).first()[0] or 0
    # about SAMPLE paragraphs of 150 characters: whole documents are drawn by hash, then paragraphs
    share = min(1.0, SAMPLE * 150.0 / max(1, total))
    root = math.sqrt(share)
    span = float(1 << 40)
    some = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text", F.lit(31)), F.lit(1 << 40)) <= F.lit(root * span))
    some = some.select(F.inline(paragraphs(F.col("text")))).where(F.pmod(F.xxhash64("said", F.lit(32)), F.lit(1 << 40)) <= F.lit(root * span))
    some = some.select(words(F.col("said")).alias("w"), _names_any(F.col("said")).alias("named")).where(F.size("w") > 0)
    some = some.where(~F.col("named") | ~F.exists(F.array(*[F.lit(k) for k in TEMPLATES]), lambda k: (likeness(F.col("w"), k) >= CONFIRM) & named(F.col("w"), k))).select(F.lit(UNKNOWN).alias("family"), "w")
    fixed = spark.createDataFrame(_examples(), "family string, w array<string>").coalesce(1)
    data = fixed.unionByName(some).distinct().select("family", grams(F.col("w")).alias("grams"), F.xxhash64("w").alias("h"))
    # a few thousand rows: one window for each class
    half = (F.row_number().over(Window.partitionBy("family").orderBy("h")) % 2).alias("half")
    data = materialize(data.select("family", "grams", half).coalesce(2), "examples")
    classes = (UNKNOWN, *sorted(TEMPLATES))
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")).cast("double") - 1
    # rare families weigh as much as common ones in all
    size = {r[0]: r[1] for r in data.groupBy("family").count().collect()}
    weight = F.element_at(F.create_map(*[F.lit(x) for k, n in size.items() for x in (k, 200.0 / n if k != UNKNOWN else 2000.0 / n)]), F.col("family"))
    data = data.select(label.alias("label"), weight.alias("weight"), "grams", "half")
    vectors = CountVectorizerModel.from_vocabulary(_vocabulary(), inputCol="grams", outputCol="features", minTF=1.0).setBinary(True)
    regression = LogisticRegression(featuresCol="features", weightCol="weight", family="multinomial", elasticNetParam=1.0, regParam=0.002, maxIter=40, standardization=False)
    fitted = regression.fit(vectors.transform(data.where("half = 1")).select("label", "weight", "features"))
    matrix = fitted.coefficientMatrix.toArray()
    raw = {g: tuple(float(x) for x in matrix[:, j]) for j, g in enumerate(vectors.vocabulary) if abs(matrix[:, j]).max() > 1e-9}
    intercepts = [float(x) for x in fitted.interceptVector.toArray()]
    model = LicenceModel(classes, tuple(intercepts), raw, 1.0, LEAST)
    scored = materialize(data.where("half = 0").select("label", "weight", margins(model, F.col("grams")).alias("m")), "scored")
    grid = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(b).alias("b")) for t in _GRID_T for b in _GRID_B])
    tried = scored.withColumn("g", F.explode(grid)).select("label", "weight", "g.t", "g.b", _shifted(F.col("g.t"), F.col("g.b")).alias("e"))
    chosen = F.element_at("e", (F.col("label") + 1).cast("int")) / F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    losses = tried.groupBy("t", "b").agg(F.sum(-F.log(chosen + 1e-12) * F.col("weight")).alias("loss")).collect()
    temperature, shift = min(((r.loss, r.t, r.b) for r in losses), default=(0.0, 1.0, 0.0))[1:]
    intercepts[0] += shift
    clean = scored.where("label = 0").select(_shifted(F.lit(temperature), F.lit(shift)).alias("e"))
    reached = clean.select((F.array_max(F.slice("e", 2, len(classes) - 1)) / F.aggregate("e", F.lit(0.0), lambda a, x: a + x)).alias("p"))
    floor = reached.agg(F.percentile_approx("p", QUANTILE)).first()[0] or 0.0
    return LicenceModel(classes, tuple(intercepts), raw, temperature, min(0.95, max(LEAST, floor)))


def _shifted(temperature: Column, unknown: Column) -> Column:
    """Unnormalised chances from margins m, those of the unknown class raised first."""
    return F.transform("m", lambda x, i: F.exp((x + F.when(i == 0, unknown).otherwise(0.0)) / temperature))


def _row(values) -> str:
    return f"array({', '.join(values)})"


def margins(model: LicenceModel, g: Column) -> Column:
    """Score of each class for an array of distinct n-grams."""
    cells = [f"'{k}', {_row(f'{v!r}D' for v in w)}" for k, w in sorted(model.weights.items())] or [f"'', {_row('0D' for _ in model.classes)}"]
    table = F.expr(f"map({', '.join(cells)})")
    known = F.filter(F.transform(g, lambda x: F.try_element_at(table, x)), lambda w: w.isNotNull())
    start = F.array(*[F.lit(x) for x in model.intercepts])
    return F.aggregate(known, start, lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b))


def likeness(w: Column, family: Column) -> Column:
    """Largest share of a template's word pairs, of that family, that an array of words holds; the paragraph's own pairs if they are fewer, but three at least."""
    cells = [f"'{k}', {_row(_row(repr(p) for p in split_pairs(t)) for t in ts)}" for k, ts in TEMPLATES.items()]
    mine = F.array_distinct(pairs(w))
    shares = F.transform(F.try_element_at(F.expr(f"map({', '.join(cells)})"), family), lambda t: F.size(F.array_intersect(mine, t)) / F.greatest(F.least(F.size(t), F.size(mine)), F.lit(3)))
    return F.coalesce(F.array_max(shares), F.lit(0.0))


def named(w: Column, family: Column) -> Column:
    """Whether an array of words says a name of that family."""
    pattern = F.expr(f"map({', '.join(f"'{k}', '(?:^| )(?:{p})'" for k, p in NAMES.items())})")
    return F.coalesce(F.rlike(F.concat(F.array_join(w, " "), F.lit(" ")), F.try_element_at(pattern, family)), F.lit(False))


def _names_any(text: Column) -> Column:
    """Whether a text says any family's name; a few more texts may pass."""
    said = "|".join(p.replace(" ", _APART) for p in NAMES.values())
    return text.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{said})")


def scan(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text", everywhere: bool = False) -> DataFrame:
    """(id, paragraph, family, probability, similarity, said): every paragraph that is a licence's.

    Paragraphs are the lines of a whole text, wrapped lines joined. The classifier names the likeliest family; it
    is reported where its chance reaches the model's floor and a template confirms it: the paragraph says
    the family's name and is like a template of it. A paragraph without any family's name can't be confirmed, so only those
    with one are scored; with everywhere, all are, to the same result. Null and empty texts have no paragraphs;
    ids may be null or repeated, each row is scanned by itself; other columns are ignored; an empty table gives
    no rows; a very long text is cut into paragraphs in one row's memory.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = rows.where(F.lit(everywhere) | _names_any(F.col("text"))).select("id", F.inline(paragraphs(F.col("text"))))
    lines = lines.where(F.lit(everywhere) | _names_any(F.col("said"))).withColumn("w", words(F.col("said")))
    lines = lines.withColumn("m", margins(model, grams(F.col("w"))))
    top = F.array_max("m")
    odds = F.transform("m", lambda x: F.exp((x - top) / model.temperature))
    family = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.array_position("m", top).cast("int"))
    lines = lines.select("id", "paragraph", "said", "w", family.alias("family"), (1.0 / F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)).alias("probability"))
    lines = lines.where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.floor)).withColumn("similarity", likeness(F.col("w"), F.col("family")))
    return lines.where((F.col("similarity") >= CONFIRM) & named(F.col("w"), F.col("family"))).select("id", "paragraph", "family", "probability", "similarity", "said")
