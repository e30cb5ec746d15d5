"""Licence scans on texts that are no templates: wrapped, unlisted, odd rows."""

import random
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardmill.llm import licenses
from boardmill.llm.licenses import _grams, _words, fit, licence_paragraphs, probabilities

DOC = "doc_id long, text string"
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
#: (text, families that are right)
SEEN_NOWHERE = [
    ("This module is GPLv3", {"gpl"}),
    ("AGPLv3 or later", {"agpl"}),
    ("the code is LGPLv2.1 only", {"lgpl"}),
    ("Code is under the terms of the MIT license", {"mit"}),
    ("We release this under Apache License 2.0", {"apache-2.0"}),
    ("Photos: CC BY-SA 4.0 by the authors", {"cc-by-sa"}),
    ("The EUPL licence applies.", {"unknown"}),
    ("BSL-1.0 Boost Software License", {"unknown"}),
    ("Licensed under the Zope Public License", {"unknown"}),
    ("JSON License", {"unknown"}),
    ("This is licensed under the Frobnicate License of the parties.", {"unknown"}),
    ("She lost her driving license in the public park", set()),
    ("He was granted a licence to fish", set()),
    ("Die Frau kam mit dem Hund und mit der Katze.", set()),
    ("The public was free to copy the form.", set()),
]


LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
AGPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"
#: (text, family or None for no row, confirmed)
TOLD_APART = [
    (LGPL, "lgpl", True),
    (AGPL, "agpl", True),
    (GPL, "gpl", True),
    (MIT, "mit", True),
    (BOOST, "unknown", False),
    ("This is free and unencumbered software released into the public domain.", "unknown", False),
    ("SPDX-License-Identifier: CC-BY-ND-4.0", "unknown", False),
    ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "unknown", False),
    ("SPDX-License-Identifier: CC-BY-NC-4.0", "cc-by-nc", True),
    ("// SPDX-License-Identifier: GPL-2.0+", "gpl", True),
    ("SPDX-License-Identifier: LGPL-3.0-only", "lgpl", True),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "mit", False),
    ("SPDX-License-Identifier: Frob-1.0", "unknown", False),
    ("Released under CC BY-NC-SA 4.0", "unknown", False),
    ("EUPL-1.2", "unknown", False),
    ("Dieses Werk steht unter der MIT-Lizenz.", "mit", False),
    ("He has a commercial license for the truck.", None, False),
    ("She left the BSD meeting.", None, False),
]


def test_licences_with_shared_words_are_told_apart(spark):
    got = {r.doc_id: (r.family, r.confirmed) for r in scanned(spark, [(k, t) for k, (t, _, _) in enumerate(TOLD_APART)])}
    wrong = [(t[:60], got.get(k)) for k, (t, family, sure) in enumerate(TOLD_APART) if got.get(k) != (None if family is None else (family, sure)) and not (sure is False and family not in (None, "unknown") and got.get(k, ("",))[0] == family)]
    assert not wrong
    assert not [t for k, (t, _, sure) in enumerate(TOLD_APART) if got.get(k, ("", False))[1] and TOLD_APART[k][1] == "unknown"]


def scanned(spark, rows):
    return licence_paragraphs(spark.createDataFrame(rows, DOC)).collect()


def test_texts_that_are_no_templates(spark):
    got = {}
    for r in scanned(spark, [(k, t) for k, (t, _) in enumerate(SEEN_NOWHERE)]):
        got.setdefault(r.doc_id, set()).add(r.family)
    wrong = [(t, got.get(k)) for k, (t, want) in enumerate(SEEN_NOWHERE) if got.get(k, set()) != want]
    assert not wrong


@pytest.mark.parametrize("text, family", [(MIT, "mit"), (GPL, "gpl"), (BSD, "bsd")])
@pytest.mark.parametrize("width", [60, 75, 90])
def test_wrapped_licences_are_one_paragraph(spark, text, family, width):
    wrapped = textwrap.fill(text, width)
    got = scanned(spark, [(1, f"/* A file. */\n\n{wrapped}\n\nint main")])
    assert [(r.paragraph, r.family, r.confirmed) for r in got] == [(2, family, True)]
    assert got[0].paragraph_text.split() == text.split()


def test_scores_equal_a_plain_version(spark):
    """All paragraphs, those that the cue words pass over too, scored one by one in Python."""
    rng = random.Random(6)
    model = fit()
    vocabulary = [t for t in model["terms"] if " " not in t] + ["zebra", "GPLv3", "Mit", "été"]
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts] + licenses.UNKNOWN_SENTENCES + licenses.NONE_SENTENCES
    lines = []
    for _ in range(300):
        words = rng.choice(texts).split()
        at = rng.randrange(len(words))
        words[at : at + rng.randint(0, 3)] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 3))]
        lines.append(" ".join(words[: rng.randint(1, 20)]))
    place = {t: k for k, t in enumerate(model["terms"])}
    want = set()
    for k, line in enumerate(lines):
        grams = _grams(_words(line))
        at = [place[g] for g in grams if g in place]
        p = probabilities((model["weights"][at].sum(axis=0) / np.sqrt(max(1, len(grams))) + model["bias"])[None])[0]
        name = model["classes"][int(p.argmax())]
        if name != licenses.NONE:
            named = re.search(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)", line, re.I)
            family = name if p.max() >= model["limit"] else licenses.UNKNOWN
            if named:
                family = next((f for f, i in licenses.IDENTIFIERS.items() if re.fullmatch(i, named[1].lower())), licenses.UNKNOWN)
            want.add((k, family, round(float(p.max()), 6)))
    got = scanned(spark, list(enumerate(lines)))
    assert {(r.doc_id, r.family, round(r.probability, 6)) for r in got} == want and len(want) > 30


def test_odd_rows(spark):
    line = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, line), (5, line), (5, line), (6, "word " * 60_000 + "\n" + line)]
    frame = spark.createDataFrame(rows, DOC).withColumn("family", F.lit("x")).withColumn("_line", F.lit(1)).withColumn("_words", F.lit(2))
    got = sorted((str(r.doc_id), r.paragraph, r.family) for r in licence_paragraphs(frame).collect())
    assert got == sorted([("None", 0, "mit"), ("5", 0, "mit"), ("5", 0, "mit"), ("6", 1, "mit")])
    assert licence_paragraphs(frame.limit(0)).count() == 0
