"""What a page's text says about each of its diagrams: captions in two tiers, and the page's own declaration.

A page's lines and its boxes are packed before they travel and meet as one row.  Relations, votes, claims and tiers
are array functions of that row, which is of bounded size: nothing is shuffled, sorted or multiplied by the boxes again.
Only lines that belong to a diagram are parsed, each once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text
from .pages import CAPTION_WORDS
from .similarity import BOX

RADIUS = 60.0


def _packed(lines: DataFrame, page: list[str]) -> DataFrame:
    """(page, _lines): the lines of each page, in order."""
    own = (F.col("diagram") if "diagram" in lines.columns else F.lit(None)).cast("long")
    group = F.struct(F.coalesce(own, F.lit(-1).cast("long")).alias("of"), F.col("group_id").cast("long").alias("id"))
    row = F.struct("line", "text", "origin", F.col("confidence").cast("double").alias("confidence"), "block_words", own.alias("own"), group.alias("group"), *[F.col(c).cast("double").alias(c) for c in BOX])
    return lines.dropna(subset=page).groupBy(*page).agg(F.array_sort(F.collect_list(row)).alias("_lines"))


def _said(line: Column) -> Column:
    """What a line says by itself; a paragraph says less than a caption."""
    short, words = line["block_words"] <= CAPTION_WORDS, line["text"]
    said = {
        "line": line["line"],
        "text": words,
        "origin": line["origin"],
        "confidence": line["confidence"],
        "caption": short,
        "side": text.side_of_line(words, short),
        "exercise": F.when(short, text.exercise_number(words)),
        "players": F.when(short, text.players(words)),
        "dated": F.when(short, text.event_year(words)),
        **{c: line[c] for c in BOX},
    }
    return F.struct(*[v.alias(k) for k, v in said.items()])


def _side(tier: Column) -> Column:
    """struct(side, evidence, origin, confidence) that a tier's lines agree on; where they don't, that of its text layer if
    it agrees with itself.  Of equal sides the text layer's first line is named."""
    sides = lambda rows: F.size(F.array_distinct(F.transform(rows, lambda r: r["side"])))

    def decided(spoken: Column) -> Column:
        printed = F.filter(spoken, lambda r: r["origin"] == "text")
        first = F.coalesce(F.get(printed, F.lit(0)), F.get(spoken, F.lit(0)))
        return F.when(sides(spoken) == 1, first).when(sides(printed) == 1, F.get(printed, F.lit(0)))

    return text.let(F.transform(F.filter(tier, lambda r: r["side"].isNotNull()), lambda r: F.struct(r["side"]["side"].alias("side"), r["side"]["evidence"].alias("evidence"), r["origin"].alias("origin"), r["confidence"].alias("confidence"))), decided)


def _first(rows: Column, field: str, good=None) -> Column:
    """The first value of a field that is there (and passes)."""
    values = F.transform(rows, lambda r: r[field])
    return F.get(F.filter(values, lambda v: v.isNotNull() if good is None else v.isNotNull() & good(v)), F.lit(0))


def _firsts(rows: Column, *key: str) -> Column:
    """The first row of each key; the key's fields come first in the rows."""
    same = lambda a, b: reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in key])
    return text.let(F.array_sort(rows), lambda s: F.filter(s, lambda r, n: (n == 0) | ~same(F.get(s, n - 1), r)))


def _near(lines: Column, boxes: Column, radius: float) -> Column:
    """A row for each line and box within the radius, by the line's group and the diagram."""

    def row(line: Column, at: Column, box: Column) -> Column:
        values = {"group": line["group"], "idx": box["idx"], "r": geometry.relation(line, box), "line": line["line"], "y0": line["y0"], "at": at, "own": line["own"]}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    pairs = F.flatten(F.transform(boxes, lambda b: F.transform(lines, lambda line, at: row(line, at, b))))
    near = F.filter(pairs, lambda p: p["r"]["distance"] <= radius)
    return F.transform(near, lambda p: F.struct(p["group"], p["idx"], p["r"]["distance"].alias("distance"), p["line"], p["r"]["side"].alias("side"), p["y0"], p["at"], p["own"]))


def _heard(near: Column, boxes: Column) -> Column:
    """Lines that were read for one diagram count on their page if no line of the text layer is near that diagram."""
    spoken = F.transform(F.filter(near, lambda r: r["own"].isNull()), lambda r: r["idx"])
    silent = F.array_except(F.transform(boxes, lambda b: b["idx"]), spoken)
    return text.let(silent, lambda some: F.filter(near, lambda r: r["own"].isNull() | F.array_contains(some, r["own"])))


def _dominant(votes: Column) -> Column:
    """Above or below, where more diagrams have their nearest group, or have it nearer; null if none has."""
    of = lambda side: F.transform(F.filter(votes, lambda v: v["side"] == side), lambda v: v["distance"])
    mean = lambda d: F.try_divide(F.aggregate(d, F.lit(0.0), lambda a, x: a + x), F.size(d))
    n, m = F.size(of("above")), F.size(of("below"))
    above = (n > m) | ((n == m) & (mean(of("above")) <= mean(of("below"))))
    return F.when(F.size(votes) > 0, F.when(above, "above").otherwise("below"))


def _claims(stands: Column, dominant: Column) -> Column:
    """struct(idx, group): groups on the dominant side claim diagrams by (distance, diagram, group), each once."""
    some = F.filter(stands, lambda s: s["side"] == dominant)
    order = F.array_sort(F.transform(some, lambda s: F.struct(s["distance"], s["idx"], s["group"])))
    pair = "struct<idx:bigint,group:struct<of:bigint,id:bigint>>"
    none = F.array().cast(f"array<{pair}>")

    def claim(acc: Column, c: Column) -> Column:
        free = ~F.exists(acc, lambda p: (p["idx"] == c["idx"]) | (p["group"] == c["group"]))
        return F.when(free, F.concat(acc, F.array(F.struct(c["idx"].alias("idx"), c["group"].alias("group"))))).otherwise(acc)

    return F.aggregate(order, none, claim)


def _owners(pairs: Column, homes: Column) -> Column:
    """struct(idx, group, primary): the diagram that each group goes to: the one that it claims, else the nearest."""
    owner = lambda r, primary: F.struct(r["idx"].alias("idx"), r["group"].alias("group"), F.lit(primary).alias("primary"))
    rest = F.filter(homes, lambda h: ~F.exists(pairs, lambda p: p["group"] == h["group"]))
    return F.concat(F.transform(pairs, lambda p: owner(p, True)), F.transform(rest, lambda h: owner(h, False)))


def _met(lines: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """(page, _all, _boxes, _lines) of every page that has boxes."""
    idx = F.col("idx").cast("long")
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in page])  # lines never meet the others
    box = F.when(known, F.struct(idx.alias("idx"), *[F.col(c).cast("double").alias(c) for c in BOX]))
    placed = boxes.groupBy(*page).agg(F.collect_set(idx).alias("_all"), F.collect_list(box).alias("_boxes"))
    return placed.join(_packed(lines, page), page, "left")


def _diagrams(met: DataFrame, radius: float) -> DataFrame:
    """The pages' other columns, idx and lines of every diagram of ``_met``'s rows."""
    kept = [c for c in met.columns if c not in ("_all", "_boxes", "_lines")]
    col = F.col
    met = met.withColumn("_near", _near(F.coalesce("_lines", F.array()), col("_boxes"), radius))
    met = met.withColumn("_near", _heard(col("_near"), col("_boxes")))
    # a group stands to a diagram as its nearest line does
    met = met.withColumn("_stands", _firsts(col("_near"), "group", "idx"))
    beside = F.filter("_stands", lambda s: s["side"].isin("above", "below"))
    votes = _firsts(F.transform(beside, lambda s: F.struct(s["side"], s["idx"], s["distance"])), "side", "idx")
    homes = _firsts(F.transform("_stands", lambda s: F.struct(s["group"], s["distance"], s["idx"])), "group")
    met = met.withColumn("_votes", votes).withColumn("_homes", homes)
    met = met.withColumn("_pairs", text.let(_dominant(col("_votes")), lambda side: _claims(col("_stands"), side)))
    met = met.withColumn("_owners", _owners(col("_pairs"), col("_homes")))

    def of_diagram(i: Column) -> Column:
        rows = lambda o: F.transform(F.filter("_near", lambda r: (r["idx"] == i) & (r["group"] == o["group"])), lambda r: F.struct((~o["primary"]).alias("other"), r["distance"], r["y0"], r["line"], r["at"]))
        return F.array_sort(F.flatten(F.transform(F.filter("_owners", lambda o: o["idx"] == i), rows)))

    found = met.select(*kept, "_lines", F.inline(F.transform("_all", lambda i: F.struct(i.alias("idx"), of_diagram(i).alias("_own")))))
    picked = F.transform("_own", lambda r: F.struct((~r["other"]).alias("primary"), F.get("_lines", r["at"]).alias("line")))
    said = F.transform(picked, lambda r: F.struct(r["primary"], _said(r["line"]).alias("said")))
    return found.select(*kept, "idx", said.alias("lines"))


def diagram_lines(lines: DataFrame, boxes: DataFrame, page: list[str], radius: float = RADIUS) -> DataFrame:
    """(page, idx, lines) of every diagram: its parsed lines, its own caption's (``primary``) first, then by distance, height and number.

    See ``page_contexts`` for the columns.  A group of lines goes to one diagram as a whole.
    """
    return _diagrams(_met(lines, boxes, page), radius)


def page_contexts(lines: DataFrame, boxes: DataFrame, page: list[str], margins: DataFrame | None = None, numbers: DataFrame | None = None, radius: float = RADIUS) -> DataFrame:
    """(page, idx, caption, side, evidence, side_origin, side_confidence, exercise, white, black, event, year) of every diagram.

    ``lines`` has the page, line, group_id, text, x0, y0, x1, y1, block_words, origin (text or ocr), confidence and,
    for lines that were read around one diagram, ``diagram``; ``boxes`` the page, idx and x0 to y1;
    ``margins`` the page, line, text, origin and confidence of lines in the margin bands; ``numbers`` the page and its printed number.

    The caption's own group decides; the neighbourhood answers where it is silent or says two
    things.  On a page where no side has captions all lines are one tier.  What only a caption can say
    (exercise, players, event and year) isn't taken from paragraphs, and an exercise is never the
    page's own number.  A side that the margin declares fills what is left null: the text layer's
    declaration, or OCR's where the text layer has none; a layer that names both sides ends it.
    A diagram without lines has an empty caption and nulls.  Pages may be null; such rows match nothing.
    """
    met = _met(lines, boxes, page)
    if numbers is not None:
        met = met.join(numbers.select(*page, F.col("number").alias("_number")), page, "left")
    if margins is not None:
        met = met.join(_declared(margins, page), page, "left")
    found = _diagrams(met, radius)
    said = lambda rows: F.transform(rows, lambda r: r["said"])
    found = found.withColumn("_led", F.exists("lines", lambda r: r["primary"]))
    found = found.withColumn("_first", said(F.filter("lines", lambda r: r["primary"] | ~F.col("_led")))).withColumn("_rest", said(F.filter("lines", lambda r: ~r["primary"] & F.col("_led"))))
    number = F.col("_number") if numbers is not None else F.lit(None)
    found = found.withColumn("_side", F.coalesce(_side(F.col("_first")), _side(F.col("_rest")))).withColumn("_captions", F.filter(said(F.col("lines")), lambda r: r["caption"]))
    players, dated = _first(F.col("_captions"), "players"), _first(F.col("_captions"), "dated")
    side = {"side": F.col("_side.side"), "evidence": F.col("_side.evidence"), "side_origin": F.col("_side.origin"), "side_confidence": F.coalesce("_side.confidence", F.lit(1.0))}
    if margins is not None:
        scope = F.col("_scope")
        filled = {"side": scope["_s"]["side"], "evidence": scope["_s"]["evidence"], "side_origin": F.concat(scope["origin"], F.lit("-page-scope")), "side_confidence": scope["confidence"]}
        side = {c: F.when(F.col("_side.side").isNull() & scope.isNotNull(), filled[c]).otherwise(v) for c, v in side.items()}
    return found.select(
        *page,
        "idx",
        F.array_join(F.transform(said(F.col("lines")), lambda r: r["text"]), "\n").alias("caption"),
        *[v.alias(c) for c, v in side.items()],
        _first(F.col("_captions"), "exercise", lambda n: ~n.eqNullSafe(number)).alias("exercise"),
        players["white"].alias("white"),
        players["black"].alias("black"),
        dated["event"].alias("event"),
        dated["year"].alias("year"),
    )


def _declared(margins: DataFrame, page: list[str]) -> DataFrame:
    """(page, _scope): the side that a page's margin declares."""
    declared = margins.withColumn("_s", text.side_of_line("text", F.lit(True))).where("_s is not null")
    row = F.struct("line", "_s", "origin", F.col("confidence").cast("double").alias("confidence"))
    layers = declared.groupBy(*page).agg(*[F.array_sort(F.collect_list(F.when(F.col("origin") == o, row))).alias(f"_{o}") for o in ("text", "ocr")])
    speaking = F.when(F.size("_text") > 0, F.col("_text")).otherwise(F.col("_ocr"))
    agreed = F.size(F.array_distinct(F.transform(speaking, lambda r: r["_s"]["side"]))) == 1
    return layers.select(*page, F.when(agreed, F.get(speaking, F.lit(0))).alias("_scope"))
