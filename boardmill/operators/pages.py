"""Scanned pages: text lines, detected boxes, captions by tiers, censuses, surveys and field evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, score
from ..functions.board import disputed_squares
from .datasets import histogram
from .similarity import BOX, by_page, merge_tiles, per_page
from .similarity import _overlaps as overlaps

MARGIN = 0.07
CAPTION_WORDS = 25
COLLAPSED = 15


def board_font_row(text: Column) -> Column:
    """Whether a line is a rank of a chess font (eight glyphs, four empty squares or more) or the letters under a board."""
    t = F.regexp_replace(F.trim(text), r"\s+", "")
    rank = t.rlike(r"^[0-9A-Za-z+.\-]{8,10}$") & (F.length(t) - F.length(F.regexp_replace(t, "[0Zz]", "")) >= 4)
    return rank | (F.lower(t) == "abcdefgh")


def body_lines(lines: DataFrame, page: list[str], height: str, book: list[str], repeated: int = 3) -> DataFrame:
    """Lines without chess-font rows and without running heads: texts in the margin band that, digits aside, stand on
    ``repeated`` pages of the book or more."""
    rows = lines.where(~board_font_row(F.col("text")))
    margin = (F.col("y1") <= F.col(height) * MARGIN) | (F.col("y0") >= F.col(height) * (1 - MARGIN))
    rows = rows.withColumn("_m", margin).withColumn("_t", F.regexp_replace(F.lower(F.trim("text")), r"\d+", "#"))
    heads = rows.where("_m").groupBy(*book, "_t").agg(F.count_distinct(*page).alias("_n")).where(F.col("_n") >= repeated).drop("_n").withColumn("_head", F.lit(True))
    return rows.join(heads, [*book, "_t"], "left").where("not (_m and coalesce(_head, false))").drop("_m", "_t", "_head")


def margin_lines(lines: DataFrame, height: str) -> DataFrame:
    """Lines in the top or bottom band."""
    return lines.where((F.col("y1") <= F.col(height) * MARGIN) | (F.col("y0") >= F.col(height) * (1 - MARGIN)))


def image_candidates(boxes: DataFrame, page: list[str], page_area: Column, least_native: int = 120, aspect: float = 0.2, least_side: float = 72.0, coverage: float = 0.7) -> DataFrame:
    """Embedded images that may be boards, with score: not the whole page, large enough, nearly square."""
    b = F.struct(*BOX)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ratio = w / F.nullif(h, F.lit(0.0))
    good = (geometry.area(b) <= page_area * coverage) & (F.least("native_width", "native_height") >= least_native) & (F.abs(ratio - 1) <= aspect) & (F.least(w, h) >= least_side)
    return boxes.where(good).withColumn("score", F.greatest(F.lit(0.0), 1 - F.abs(ratio - 1) / aspect))


def merged_images(boxes: DataFrame, page: list[str], least: int = 2) -> DataFrame:
    """Tiles that touch as one box, if there are ``least`` of them or more."""
    return merge_tiles(boxes, page).where(F.col("tiles") >= least)


def union_candidates(embedded: DataFrame, contour: DataFrame, page: list[str], most_iou: float = 0.5, inside: float = 0.7) -> DataFrame:
    """Embedded boxes and the contour boxes that don't show the same region (merged boxes: are mostly inside)."""
    # equal boxes show the same region, so only different ones meet
    e = embedded.select(*page, F.struct(*BOX).alias("_e"), F.coalesce("merged", F.lit(False)).alias("_merged")).distinct()
    c = contour.select(*page, F.struct(*BOX).alias("_c")).distinct()
    same = (geometry.iou(F.col("_c"), F.col("_e")) > most_iou) | (F.col("_merged") & (geometry.containment(F.col("_c"), F.col("_e")) >= inside))
    taken = by_page(c, page).join(by_page(e, page), page).where(same).select(*page, "_c").distinct()
    left = contour.withColumn("_c", F.struct(*BOX)).join(taken, [*page, "_c"], "left_anti").select(*contour.columns)
    return embedded.unionByName(left, allowMissingColumns=True)


def predupe(boxes: DataFrame, page: list[str], most_iou: float = 0.9, relative_area: float = 0.02) -> DataFrame:
    """Boxes by falling score without near repeats and without those that are tiny beside the largest.

    Of equal boxes with an area only the first can stay, so the others aren't compared.
    """

    def kernel(rows: list[dict]) -> list[tuple]:
        size = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
        least, kept = relative_area * max(map(size, rows)), []
        held = np.empty((len(rows), 4))
        for r in sorted(rows, key=lambda r: (-r["score"], r["idx"])):
            if size(r) < least:
                continue
            held[len(kept)] = [r[c] for c in BOX]
            if not (overlaps(held[len(kept) : len(kept) + 1], held[: len(kept)]) > most_iou).any():
                kept.append(r)
        return [(r["idx"],) for r in kept]

    real = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & F.lit(most_iou < 1)
    once = boxes.select(*page, "idx", "score", *BOX).withColumn("_own", F.when(~real, F.col("idx")))
    once = once.groupBy(*page, *BOX, "_own").agg(F.min(F.struct((-F.col("score")).alias("_s"), "idx", "score")).alias("_m")).select(*page, "_m.idx", "_m.score", *BOX)
    return boxes.join(per_page(once, page, kernel, f"idx {dict(boxes.dtypes)['idx']}"), [*page, "idx"], "left_semi")


def box_state(saved: Column, confirmed: Column, fatal: Column, low: Column) -> Column:
    """What is most worth saying about a box."""
    return score.first_rule([(saved, F.lit("saved")), (confirmed, F.lit("confirmed")), (fatal, F.lit("fatal")), (low, F.lit("low"))], F.lit("read"))


def flagged(boxes: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """Boxes with a flag that says whether their key is among ``keys``."""
    return boxes.join(keys.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def tier_side(lines: DataFrame, group: list[str]) -> DataFrame:
    """(group, side): the side a tier's lines agree on; if they don't, the one its text-layer lines agree on, else null.

    Lines have tier, side and origin (text or ocr).
    """
    sides = F.collect_set("side")
    printed = F.collect_set(F.when(F.col("origin") == "text", F.col("side")))
    found = lines.where("side is not null").groupBy(*group, "tier").agg(sides.alias("_s"), printed.alias("_p"))
    one = F.when(F.size("_s") == 1, F.get("_s", F.lit(0))).when(F.size("_p") == 1, F.get("_p", F.lit(0)))
    tiers = found.select(*group, "tier", one.alias("side"))
    # the primary tier decides if it says anything at all, even if it contradicts itself
    return tiers.groupBy(*group).agg(F.min_by("side", F.when(F.col("tier") == "primary", 0).otherwise(1)).alias("side"))


def page_scope(contexts: DataFrame, declarations: DataFrame, page: list[str]) -> DataFrame:
    """Contexts whose null sides are filled by the page's one declared side; sources: text before ocr."""
    said = declarations.where("side is not null").groupBy(*page, "origin").agg(F.collect_set("side").alias("_s")).where(F.size("_s") == 1)
    scope = said.groupBy(*page).agg(F.min_by(F.get("_s", F.lit(0)), F.when(F.col("origin") == "text", 0).otherwise(1)).alias("_scope"))
    filled = contexts.join(scope, page, "left").withColumn("side_origin", F.when(F.col("side").isNotNull(), "caption").when(F.col("_scope").isNotNull(), "page"))
    return filled.withColumn("side", F.coalesce("side", "_scope")).drop("_scope")


def gap_fill(text_lines: DataFrame, ocr_lines: DataFrame, diagrams: DataFrame, near: DataFrame, key: list[str]) -> DataFrame:
    """Text lines, and OCR lines of those diagrams only that no text line is near; group ids stay distinct."""
    silent = diagrams.join(near.select(*key).distinct(), key, "left_anti")
    more = ocr_lines.join(silent.select(*key), key, "left_semi").withColumn("group_id", -1 - F.col("group_id"))
    return text_lines.unionByName(more, allowMissingColumns=True)


def saved_by_page(labels: DataFrame, book: str) -> DataFrame:
    """(page, diagrams), both from 0, of a book's labels, whose pages and diagrams are text counted from 1."""
    rows = labels.where(F.col("source_pdf") == book).select((F.col("source_page").try_cast("int") - 1).alias("page"), (F.col("source_diagram").try_cast("int") - 1).alias("diagram"))
    return rows.where("page >= 0 and diagram >= 0").groupBy("page").agg(F.array_sort(F.collect_set("diagram")).alias("diagrams"))


def position_of(entries: DataFrame, page: int, diagram: int = 0) -> DataFrame:
    """One row (position): that of the diagram, else of the page's first one, else null.  Entries have position, page, diagram."""
    exact = F.min(F.when((F.col("page") == page) & (F.col("diagram") == diagram), F.col("position")))
    return entries.agg(F.coalesce(exact, F.min(F.when(F.col("page") == page, F.col("position")))).alias("position"))


def agreement(a: Column, b: Column) -> Column:
    """struct(agreement, collapsed) of two readings of a board."""
    n = F.size(disputed_squares(a, b))
    return F.struct(((64 - n) / F.lit(64.0)).alias("agreement"), (n > COLLAPSED).alias("collapsed"))


def choose_books(df: DataFrame, book: str, parts: list[str]) -> DataFrame:
    """Rows of books whose name holds one of the parts, whatever the case; no parts choose all."""
    return df if not parts else df.where(F.exists(F.array(*[F.lit(p.lower()) for p in parts]), lambda p: F.contains(F.lower(F.col(book)), p)))


def sides_survey(df: DataFrame, book: str, source: str) -> DataFrame:
    """(book, total, default, resolved_share) per book and, with book null, for all; what isn't default is resolved."""
    sums = df.rollup(book).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(source) == "default").alias("defaults"))
    return sums.withColumn("resolved_share", score.safe_ratio(F.col("total") - F.col("defaults"), F.col("total")))


def detection_census(candidates: DataFrame, book: str, suspect_below: float = 72.0) -> DataFrame:
    """Per book and in total: candidates, suspects, trimmed, pages, pages with small and large boxes."""
    per = candidates.groupBy(book, "page").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("side_pt") < suspect_below).alias("s"), F.count_if("trimmed").alias("t"))
    return per.rollup(book).agg(F.sum("n").alias("candidates"), F.sum("s").alias("suspects"), F.sum("t").alias("trimmed"), F.count(F.lit(1)).alias("pages"), F.count_if((F.col("s") > 0) & (F.col("s") < F.col("n"))).alias("mixed_pages"))


def rejection_reasons(rejections: DataFrame) -> DataFrame:
    """How often each reason occurs."""
    return histogram(rejections, F.col("reason"), "reason")


def census_pages(count: Column, wanted: int, front: int, sample) -> Column:
    """The sampled pages and the first ``front`` ones, in order."""
    first = F.when(F.least(count, F.lit(front)) > 0, F.sequence(F.lit(0), (F.least(count, F.lit(front)) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_union(sample(count, F.lit(wanted)), first))


def field_counters(annotated: DataFrame, read: DataFrame, matches: DataFrame, page: list[str], accept: float = score.ACCEPT_CONFIDENCE) -> DataFrame:
    """Per page: annotated, detected, matched, false_positives, exported, exact; unreviewed pages don't count."""
    a = annotated.where("reviewed").select(*page, F.col("idx").alias("annotation"), F.col("placement").alias("_want"))
    r = read.join(annotated.where("reviewed").select(*page).distinct(), page, "left_semi").select(*page, F.col("idx").alias("reading"), F.col("placement").alias("_got"), "min_confidence", "is_fatal")
    pairs = a.join(matches, [*page, "annotation"], "left").join(r, [*page, "reading"], "left")
    gate = F.coalesce((F.col("min_confidence") >= accept) & ~F.coalesce("is_fatal", F.lit(False)), F.lit(False))
    sums = pairs.groupBy(*page).agg(
        F.count("annotation").alias("annotated"), F.count("_got").alias("matched"), F.count_if(gate).alias("exported"), F.count_if(F.coalesce((F.col("_got") == F.col("_want")) & gate, F.lit(False))).alias("exact")
    )
    detected = r.groupBy(*page).agg(F.count(F.lit(1)).alias("detected"))
    return sums.join(detected, page, "left").withColumn("detected", F.coalesce("detected", F.lit(0))).withColumn("false_positives", F.col("detected") - F.col("matched"))


def training_scan(labels: DataFrame, splits: DataFrame, files: DataFrame, wanted: str, key: str, syntactic: Column, fatal: Column, accepted: Column) -> DataFrame:
    """Labels with the first reason that keeps each from training on a split, null if none does."""
    rows = labels.join(splits.select(key, F.col("split").alias("_split")), key, "left").join(files.select(F.col(key).alias("_file")).distinct(), F.col(key) == F.col("_file"), "left")
    reason = score.first_rule([(~syntactic, F.lit("syntax")), (F.coalesce(F.col("_split"), F.lit("")) != wanted, F.lit("split")), (fatal & ~accepted, F.lit("fatal")), (F.col("_file").isNull(), F.lit("missing"))])
    return rows.withColumn("reason", reason).drop("_split", "_file")


def migrated_sides(side: Column, fen_side: Column, proven: Column) -> Column:
    """struct(side, outcome): the stored side, else the FEN's, else what legality proves, never a default."""
    answer = lambda s, o: F.struct(s.alias("side"), F.lit(o).alias("outcome"))
    return score.first_rule([(side.isin("w", "b"), answer(side, "kept")), (fen_side.isin("w", "b"), answer(fen_side, "fen")), (proven.isNotNull(), answer(proven, "legality"))], answer(F.lit(""), "unknown"))


def validated_update(fen: Column, side: Column, syntactic: Column, fatal: Column, allow: Column) -> Column:
    """The full FEN to store; a malformed one, or a fatal one that isn't allowed, is an error when the plan runs."""
    whole = F.concat_ws(" ", F.split_part(fen, F.lit(" "), F.lit(1)), side, F.lit("- - 0 1"))
    return F.when(~syntactic, F.raise_error(F.concat(F.lit("malformed position: "), fen))).when(fatal & ~allow, F.raise_error(F.concat(F.lit("illegal position: "), fen))).otherwise(whole)


def markdown(results: DataFrame, name: str, value: str, reference: str) -> DataFrame:
    """(line) of a table of results with the difference to the reference row; a report of few rows."""
    base = results.where(F.col(name) == reference).select(F.col(value).alias("_base"))
    rows = results.crossJoin(F.broadcast(base))  # one row
    return rows.select(name, F.format_string("| %s | %.4f | %+.4f |", F.col(name), F.col(value), F.col(value) - F.col("_base")).alias("line"))


def search_by_name(games: DataFrame, hits: DataFrame, pair: Column, game: list[str]) -> DataFrame:
    """Games of a pair: verified where the position occurs, with its move; else move 0, no side and verified false."""
    found = hits.select(*game, F.col("move_number").alias("_move"), F.col("side").alias("_side"), F.lit(True).alias("_hit"))
    rows = games.where(pair).join(found, game, "left")
    return rows.withColumn("move_number", F.coalesce("_move", F.lit(0))).withColumn("side", F.coalesce("_side", F.lit(""))).withColumn("verified", F.coalesce("_hit", F.lit(False))).drop("_move", "_side", "_hit")


def groups_of(df: DataFrame, group: list[str], member: str) -> DataFrame:
    """(group, leader, size, member): a row for each member of groups of two or more; the leader is the smallest member."""
    sums = df.groupBy(*group).agg(F.min(member).alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return df.select(*group, member).join(sums, group)


def same_game_nearby(entries: DataFrame, book: list[str], position: str, games: str, chosen: str, radius: int = 3) -> DataFrame:
    """Entries that take the chosen game of an entry up to ``radius`` away that they also hold, the nearest first."""
    c = entries.where(F.col(chosen).isNotNull()).select(*book, F.col(position).alias("_p"), F.col(chosen).alias("_g"))
    near = entries.select(*book, position, games, chosen, F.explode(F.sequence(F.col(position) - radius, F.col(position) + radius)).alias("_p"))
    pairs = near.join(c, [*book, "_p"]).where((F.col("_p") != F.col(position)) & F.array_contains(F.col(games), F.col("_g")) & F.col(chosen).isNull())
    return pairs.groupBy(*book, position).agg(F.min_by("_g", F.struct(F.abs(F.col("_p") - F.col(position)), "_p")).alias("taken"))
