"""Licence scans: which licence family each paragraph names, in DataFrame functions only.

A paragraph is a line, with the lines that it is hard-wrapped into joined again.  Its features are
its words and pairs of successive words; letters and digits are words of their own, and the v of a
version too (``GPLv3`` is ``gpl v 3``).  A softmax regression over the families, a class for unknown
licences and one for none is fitted on the fixed texts below, with penalties that leave few n-grams
a weight.  A family is only kept if its probability reaches a limit that is calibrated on names of
known and unknown licences, whole names in all citations, which that fit hasn't seen; below it the paragraph is of an unknown
licence.  Comparison with templates, the part of a template's features that the paragraph has,
confirms a prediction if the family's best template fits well, and better than any other family's
or any of the licences that are no family here.  An SPDX identifier is read whole and decides.

A paragraph none of whose n-grams speaks more for some licence than for none can't be anything
else than ``none``, so the scan passes it over after a look at its words; that follows from the
weights and loses nothing.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import Ftrl, probabilities

UNKNOWN, NONE = "unknown", "none"
CONFIRMED = 0.5
#: By so much a family's best template must fit better than any other family's.
MARGIN = 0.02
#: Places of the table of weights.
SHELVES = 4_096
#: Characters of a line that may go on in the next one.
WRAPPED = (40, 100)

# Sentences by which licences are named or granted.
TEMPLATES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Licensed under the AGPL.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GPL.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the LGPL.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
# Sentences by which licences that are no family here are granted; they are compared like templates.
OTHER_TEMPLATES = [
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.",
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "This software is provided 'as-is', without any express or implied warranty; permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License.",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
]
# Identifiers of the families after SPDX-License-Identifier, as whole words.
IDENTIFIERS = {
    "agpl": "agpl-[0-9.]+(-only|-or-later|\\+)?",
    "apache-2.0": "apache-2\\.0",
    "bsd": "bsd-[0-4]-clause",
    "cc-by": "cc-by-[0-9.]+",
    "cc-by-nc": "cc-by-nc-[0-9.]+",
    "cc-by-sa": "cc-by-sa-[0-9.]+",
    "cc0": "cc0-[0-9.]+",
    "gpl": "gpl-[0-9.]+(-only|-or-later|\\+)?",
    "isc": "isc",
    "lgpl": "lgpl-[0-9.]+(-only|-or-later|\\+)?",
    "mit": "mit(-0)?",
    "mpl-2.0": "mpl-2\\.0(-no-copyleft-exception)?",
}
# Names of the families, with which they are cited.
NAMES = {
    "agpl": ["AGPL", "AGPLv3", "AGPL-3.0", "GNU AGPL", "GNU Affero General Public License", "Affero GPL"],
    "apache-2.0": ["Apache License", "Apache 2.0", "Apache-2.0", "Apache License, Version 2.0", "Apache2", "ASL 2.0"],
    "bsd": ["BSD", "BSD License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "3-clause BSD"],
    "cc-by": ["CC BY", "CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution", "Creative Commons Attribution 3.0"],
    "cc-by-nc": ["CC BY-NC", "CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial"],
    "cc-by-sa": ["CC BY-SA", "CC BY-SA 4.0", "CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike"],
    "cc0": ["CC0", "CC0 1.0", "CC0-1.0", "CC0 Public Domain Dedication", "Creative Commons Zero"],
    "gpl": ["GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0-or-later", "GNU GPL", "GNU General Public License"],
    "isc": ["ISC", "ISC License", "ISC licence"],
    "lgpl": ["LGPL", "LGPLv2.1", "LGPLv3", "LGPL-2.1", "GNU LGPL", "GNU Lesser General Public License"],
    "mit": ["MIT License", "MIT-License", "MIT-Lizenz", "MIT", "MIT licence", "MIT (Expat) License", "the MIT terms"],
    "mpl-2.0": ["MPL", "MPL 2.0", "MPL-2.0", "Mozilla Public License", "Mozilla Public License 2.0"],
}
# Names of licences that are no family here.
OTHER_NAMES = ["EPL-2.0", "Eclipse Public License", "CDDL", "Artistic License 2.0", "zlib License", "WTFPL", "Unlicense", "OFL-1.1", "SIL Open Font License", "PSF License", "OpenSSL License", "Ruby License", "Vim License",
    "CC BY-ND 4.0", "CC BY-ND", "CC-BY-ND-4.0", "CC BY-NC-SA 4.0", "CC BY-NC-SA", "CC-BY-NC-SA-4.0", "CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0", "Creative Commons Attribution-NoDerivatives", "Creative Commons Attribution-NonCommercial-ShareAlike",
    "Boost Software License", "BSL-1.0", "EUPL-1.2", "EUPL", "European Union Public Licence", "CeCILL", "CPL", "Common Public License", "Academic Free License", "OSL-3.0", "Open Database License", "GFDL", "Beerware", "Microsoft Public License", "MS-PL", "a proprietary license", "its own license", "the licence of the firm"]
# How licences are cited.
CITATIONS = ["Released under the {}.", "Licensed under {}.", "This work is licensed under the {}", "SPDX-License-Identifier: {}", "Distributed under the terms of the {}", "This module is {}", "License: {}", "Available under {}, see LICENSE", "published under the {} licence", "The {} applies.", "{} licence", "{}", "Dieses Werk steht unter der {}.", "Lizenziert unter {}", "publié sous licence {}", "bajo la licencia {}"]
# Sentences that speak of a licence that is none of the above.
UNKNOWN_SENTENCES = [
    "All rights reserved.",
    "Licensed under the terms of the agreement between the parties.",
    "All rights reserved; no license is granted.",
    "This work is licensed to you for personal use only.",
    "Released under a proprietary license.",
    "Distributed under its own license, see the file.",
    "Copyright the authors, license available on request.",
    "This software is licensed, not sold.",
    "See the license for the permissions.",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    "The licensee may not sublicense the work under this licence.",
]
# Sentences with the same words that speak of no licence.
NONE_SENTENCES = [
    "She renewed her driving license in the public office.",
    "He lost his driver's licence at the party.",
    "A driving license was found in the park.",
    "The license plate was found near the source of the river.",
    "A fishing licence costs ten pounds a year.",
    "The pub lost its licence to sell beer.",
    "Poetic license allows this.",
    "The general spoke in public about the free press.",
    "They asked permission to copy the painting.",
    "The version of the story that he told was modified.",
    "The commons were open to the public and the creative class was free.",
    "He studied at mit before the redistribution of land.",
    "He has a commercial license for the truck.",
    "A licence for the car is needed in this town.",
    "She left the meeting of the club.",
    *[f"{who} {x} {what}" for x in ("BSD", "MIT", "ISC", "GPL", "MPL", "LGPL") for who, what in (("She left the", "meeting."), ("He works at", "in the town."))],
    "They came with the boost of the wind.",
    "Mit.",
    "Mit der Mit.",
    "Sie kam mit dem Zug und das mit Freude.",
    "Der Mann mit dem Hut ging mit der Frau.",
    "The apache rode out with a copy of the map.",
    "The eclipse was seen by the public in the open.",
    "A ruby of the first academic and artistic class.",
    "A work of attribution in the domain of the arts.",
    "The software of the loom was granted a second form.",
    "This module is new and available, see the file.",
    "It was released and distributed under the bridge in its own terms.",
    "This work is done; this version applies to the file.",
    "Published in 2004, version 2.0, section 3, clause 4.",
    "Available on request under the conditions of the firm.",
]
# Words that any text may have; no feature consists of them alone.
PLAIN = "a all and any are as at be between by can could das der die do each el en es et for from have has he her his how i if im in into is ist it its la las le les los may more must no not of on one only or other our own que see she so some such than that the their them then there these they this to two un und une up was we were what when which who will with without would you your".split()


def _words(text: str) -> list[str]:
    """Letters and digits apart, in lower case; must say the same as ``_word_column``."""
    text = re.sub(r"([a-z])v(?=[0-9])", r"\1 v ", text.lower())
    text = re.sub(r"([a-z])(?=[0-9])", r"\1 ", text)
    return [w for w in re.split(r"[^a-z0-9]+", text) if w]


def _word_column(text: Column) -> Column:
    low = F.regexp_replace(F.regexp_replace(F.lower(text), "([a-z])v(?=[0-9])", "$1 v "), "([a-z])(?=[0-9])", "$1 ")
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")


def _grams(words: list[str]) -> set[str]:
    """The words and pairs of successive words that aren't plain words only."""
    return {*(w for w in words if w not in PLAIN), *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a not in PLAIN or b not in PLAIN)}


def _examples() -> list[tuple[str, str, int]]:
    """(text, class, part): parts 0 to 2 of the names and sentences, part 3 what is always fitted."""
    rows = []
    for name, names in [*NAMES.items(), (UNKNOWN, OTHER_NAMES)]:
        rows += [(c.format(n), name, k % 3) for k, n in enumerate(names) for c in CITATIONS]
    for name, texts in [*TEMPLATES.items(), (UNKNOWN, UNKNOWN_SENTENCES + OTHER_TEMPLATES), (NONE, NONE_SENTENCES)]:
        for text in texts:
            words = _words(text)
            rows.append((text, name, 3))
            rows += [(" ".join(words[:k] + words[k + 1 :]), name, 3) for k in range(0, len(words), 4)]  # a word lost
            if len(words) > 12 and name != NONE:
                rows += [(" ".join(words[k : k + 12]), name, 3) for k in range(0, len(words) - 11, 12)]
    return rows + [("", NONE, 3)] * 20


def _train(rows: list[tuple[str, str, int]], classes: list[str], place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    model = Ftrl(len(place), len(classes), alpha=0.5, l1=0.02, l2=0.01)
    vectors = [_vector(text, place) for text, *_ in rows]
    targets = np.eye(len(classes))[[classes.index(name) for _, name, _ in rows]]
    for epoch in range(8):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            model.learn(*vectors[k], targets[k])
    return model.weights()


def _vector(text: str, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    grams = _grams(_words(text))
    known = sorted(place[g] for g in grams if g in place)
    return np.array(known, int), np.full(len(known), 1 / np.sqrt(max(1, len(grams))))


@functools.lru_cache(maxsize=1)
def fit() -> dict:
    """classes, the weights of each n-gram that has any, bias, limit, and each template's n-grams."""
    classes, rows = [*sorted(TEMPLATES), UNKNOWN, NONE], _examples()
    terms = sorted({g for text, *_ in rows for g in _grams(_words(text))})
    place = {g: k for k, g in enumerate(terms)}
    # the limit: a third of the names of every family, and of the other licences, in all citations, by a model that has seen none of these names
    weights, bias = _train([r for r in rows if r[2] != 0], classes, place)
    right, wrong = [], []
    for text, name, part in rows:
        if part == 0:
            at, value = _vector(text, place)
            p = probabilities((value @ weights[at] + bias)[None])[0]
            if classes[int(p.argmax())] not in (UNKNOWN, NONE):
                (right if classes[int(p.argmax())] == name else wrong).append(float(p.max()))
    levels = sorted({*right, *wrong, 0.0})
    limit = min(levels, key=lambda x: (sum(v < x for v in right) + sum(v >= x for v in wrong), -x))  # of equally good ones the strictest
    weights, bias = _train(rows, classes, place)
    used = np.abs(weights).sum(axis=1) > 0
    templates = [{"family": f, "grams": sorted(_grams(_words(t)))} for f, ts in [*TEMPLATES.items(), (UNKNOWN, OTHER_TEMPLATES)] for t in ts]
    return {"classes": classes, "terms": [t for t, u in zip(terms, used, strict=True) if u], "weights": weights[used].round(9), "bias": bias.round(9), "limit": float(limit), "templates": templates}


def _cues(model: dict) -> list[str]:
    """The words one of which a paragraph must have to be anything else than ``none``: of each n-gram that speaks for
    some licence against none, the word that fewest other such n-grams need."""
    none = model["classes"].index(NONE)
    if (model["bias"] - model["bias"][none] > 0).any():
        return []  # not the case with these texts: everything would have to be scored
    margin = (model["weights"] - model["weights"][:, [none]]).max(axis=1)
    strong = [t.split() for t, m in zip(model["terms"], margin, strict=True) if m > 0]
    single = {t[0] for t in strong if len(t) == 1}
    return sorted(single | {next(w for w in t if w not in PLAIN) for t in strong if not single & set(t)})


def _constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps({"v": value})), f"struct<v:{kind}>")["v"]


def paragraphs(text: Column) -> Column:
    """The lines of a text; a break after a line of WRAPPED characters that ends no sentence is a blank, unless the next line is empty."""
    low, high = WRAPPED
    # the break first, so that what stands before it is looked at for breaks only
    return F.split(F.regexp_replace(text, f"\\n(?<=(?:^|\\n)[^\\n]{{{low},{high}}}\\n)(?<![.!?:;]\\n)(?=[^\\n])", " "), "\n")


def licence_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, family, probability, similarity, confirmed, paragraph_text) of each paragraph that speaks of a licence.

    ``paragraph`` counts the text's paragraphs (see ``paragraphs``) from 0.  family is ``unknown``
    where the model sees a licence that it can't tell, and never confirmed.  Paragraphs of class ``none``, and null and
    empty texts, give no row; repeated rows give theirs each, rows with a null id too.  An empty
    table gives an empty result.  Nothing is shuffled: the model and the templates are constants
    of the plan.
    """
    model = fit()
    k, cues = len(model["classes"]), _cues(model)
    lines = docs.select(F.col(id_col).alias("_doc"), F.posexplode(paragraphs(F.col(text_col))).alias("_par", "_line"))
    lines = lines.withColumn("_words", _word_column(F.col("_line")))
    if cues:
        lines = lines.where(F.exists("_words", lambda w: w.isin(cues)))
    pairs = F.zip_with("_words", F.slice(F.col("_words"), 2, 1 << 30), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.filter(pairs, lambda p: p["b"].isNotNull() & ~(p["a"].isin(PLAIN) & p["b"].isin(PLAIN)))
    grams = F.array_distinct(F.concat(F.filter("_words", lambda w: ~w.isin(PLAIN)), F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"]))))
    # a sparse dot product: the weights of the n-grams that have any, found by a hash of the n-gram
    shelves: list[list[dict]] = [[] for _ in range(SHELVES)]
    for term, w in zip(model["terms"], model["weights"], strict=True):
        shelves[zlib.crc32(term.encode()) % SHELVES].append({"g": term, "w": w.tolist()})
    table = _constant(shelves, "array<array<struct<g:string,w:array<double>>>>")
    shelf = lambda g: F.get(table, (F.crc32(g.cast("binary")) % SHELVES).cast("int"))
    known = F.filter("_grams", lambda g: g.isin(model["terms"]))
    found = F.transform(known, lambda g: F.get(F.filter(shelf(g), lambda x: x["g"] == g), F.lit(0))["w"])
    rows = lines.select("_doc", "_par", "_line", grams.alias("_grams")).withColumn("_found", found)
    sums = F.aggregate("_found", F.array(*[F.lit(0.0)] * k), lambda acc, w: F.zip_with(acc, w, lambda x, y: x + y))
    scale = F.sqrt(F.greatest(F.size("_grams"), F.lit(1)))
    rows = rows.withColumn("_scores", F.zip_with(sums, F.array(*[F.lit(float(b)) for b in model["bias"]]), lambda x, y: x / scale + y)).withColumn("_top", F.array_max("_scores"))
    named = _constant(model["classes"], "array<string>")[(F.array_position("_scores", F.col("_top")) - 1).cast("int")]
    sure = F.lit(1.0) / F.aggregate("_scores", F.lit(0.0), lambda acc, s: acc + F.exp(s - F.col("_top")))
    # exploding what isn't ``none`` instead of a filter, which the optimizer would expand below the projections
    hits = F.filter(F.array(F.struct(named.alias("_class"), sure.alias("probability"))), lambda h: h["_class"] != NONE)
    rows = rows.select("*", F.inline(hits))
    rows = rows.withColumn("family", F.when(F.col("probability") >= model["limit"], F.col("_class")).otherwise(UNKNOWN))
    # an identifier is read whole: what isn't one of a family's is of another licence, whatever it begins with
    identifier = F.lower(F.regexp_extract("_line", r"(?i)SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)", 1))
    alone = ~F.col("_line").rlike(r"(?i)SPDX-License-Identifier:\s*\S+\s+(OR|AND|WITH)\s")
    rows = rows.withColumn("_id", F.coalesce(*[F.when(identifier.rlike(f"^({pattern})$"), F.lit(name)) for name, pattern in IDENTIFIERS.items()], F.when(identifier != "", UNKNOWN)))
    rows = rows.withColumn("family", F.coalesce("_id", "family"))
    # a template's share of n-grams that the paragraph has, of the predicted family and of all others
    shares = F.transform(_constant(model["templates"], "array<struct<family:string,grams:array<string>>>"), lambda t: F.struct(t["family"].alias("f"), (F.size(F.array_intersect(t["grams"], F.col("_grams"))) / F.size(t["grams"])).alias("s")))
    rows = rows.withColumn("_shares", shares)
    most = lambda keep: F.coalesce(F.array_max(F.transform(F.filter("_shares", keep), lambda t: t["s"])), F.lit(0.0))
    rows = rows.withColumn("similarity", most(lambda t: t["f"] == F.col("family"))).withColumn("_rival", most(lambda t: t["f"] != F.col("family")))
    fits = F.coalesce(alone & (F.col("_id") == F.col("family")), (F.col("similarity") >= CONFIRMED) & (F.col("similarity") - F.col("_rival") >= MARGIN))
    confirmed = (F.col("family") != UNKNOWN) & fits
    return rows.select(F.col("_doc").alias(id_col), F.col("_par").alias("paragraph"), "family", "probability", "similarity", confirmed.alias("confirmed"), F.col("_line").alias("paragraph_text"))
