"""Contexts of a page's diagrams: tiers, claims, OCR lines where text is silent, the margin's declaration."""

import pytest

import __spark_entry__ as entry
from boardmill.operators.contexts import page_contexts

LINES = "page int, line int, group_id int, text string, x0 double, y0 double, x1 double, y1 double, block_words int, origin string, confidence double, diagram int"
BOXES = "page int, idx int, x0 double, y0 double, x1 double, y1 double"
MARGINS = "page int, line int, text string, origin string, confidence double"


def line(n, group, text, y0, x0=100.0, words=5, origin="text", sure=1.0, diagram=None, page=1):
    return (page, n, group, text, x0, float(y0), x0 + 100, y0 + 10.0, words, origin, sure, diagram)


def box(idx, y0, x0=100.0, page=1):
    return (page, idx, x0, float(y0), x0 + 100, y0 + 100.0)


def contexts(spark, lines, boxes, margins=(), numbers=None):
    margin = spark.createDataFrame(list(margins), MARGINS) if margins is not None else None
    number = None if numbers is None else spark.createDataFrame(numbers, "page int, number int")
    rows = page_contexts(spark.createDataFrame(lines, LINES), spark.createDataFrame(boxes, BOXES), ["page"], margin, number).collect()
    assert len(rows) == len(boxes)
    return {(r.page, r.idx): r for r in rows}


def test_a_group_goes_to_one_diagram_as_a_whole(spark):
    # captions stand above; the second one's number is nearer to the first board's foot than to its own board
    lines = [line(0, 0, "No. 5", 60), line(1, 0, "Tal - Botvinnik", 75), line(2, 0, "Moscow, 1960", 88), line(3, 1, "No. 6", 205), line(4, 1, "Spassky - Fischer", 220), line(5, 1, "White to move", 236)]
    got = contexts(spark, lines, [box(0, 100), box(1, 250)])
    assert (got[1, 0].exercise, got[1, 0].white, got[1, 0].black, got[1, 0].event, got[1, 0].year) == (5, "Tal", "Botvinnik", "Moscow", 1960)
    assert (got[1, 1].exercise, got[1, 1].white, got[1, 1].side, got[1, 1].side_origin) == (6, "Spassky", "w", "text")
    assert got[1, 1].caption == "White to move\nSpassky - Fischer\nNo. 6"


@pytest.mark.parametrize(
    ("own", "beside", "want"),
    [
        (["White to move"], ["Black to move"], "w"),  # the caption decides
        (["White to move", "Black to move"], ["Black to move"], "b"),  # it says two things: the neighbourhood answers
        (["Study"], ["Black to move"], "b"),
        (["Study"], ["White to move", "Black to move"], None),
    ],
)
def test_the_neighbourhood_answers_where_the_caption_doesn_t(spark, own, beside, want):
    lines = [line(k, 0, t, 78 + 12 * k) for k, t in enumerate(own)] + [line(10 + k, 1 + k, t, 230 + 12 * k) for k, t in enumerate(beside)]
    assert contexts(spark, lines, [box(0, 100)])[1, 0].side == want


def test_paragraphs_say_less(spark):
    lines = [line(0, 0, "No. 7, it was White to move", 80, words=80), line(1, 1, "Black to move and win, he said", 230, words=80)]
    got = contexts(spark, lines, [box(0, 100)])[1, 0]
    assert (got.side, got.exercise) == ("b", None) and got.caption.startswith("No. 7")


def test_symbols_come_before_phrases(spark):
    assert contexts(spark, [line(0, 0, "□ Black to move", 80)], [box(0, 100)])[1, 0].side == "w"


def test_ocr_fills_only_silent_diagrams_and_text_wins(spark):
    lines = [line(0, 0, "White to move", 80), line(0, 0, "Black to move", 82, origin="ocr", sure=0.6, diagram=0), line(0, 0, "Black to move", 305, origin="ocr", sure=0.7, diagram=1)]
    got = contexts(spark, lines, [box(0, 100), box(1, 320)])
    assert (got[1, 0].side, got[1, 0].side_origin, got[1, 0].caption) == ("w", "text", "White to move")
    assert (got[1, 1].side, got[1, 1].side_origin, round(got[1, 1].side_confidence, 3)) == ("b", "ocr", 0.7)
    both = [line(0, 0, "White to move", 80), line(1, 0, "Black to move", 70, origin="ocr", sure=0.6)]
    assert contexts(spark, both, [box(0, 100)])[1, 0].side == "w"


def test_the_margin_fills_what_captions_leave_open(spark):
    lines = [line(0, 0, "Black to move", 80)]
    boxes = [box(0, 100), box(1, 400)]
    said = lambda *m: {k[1]: (r.side, r.side_origin) for k, r in contexts(spark, lines, boxes, [(1, n, t, o, 0.5) for n, (t, o) in enumerate(m)]).items()}
    assert said(("WHITE TO MOVE", "text")) == {0: ("b", "text"), 1: ("w", "text-page-scope")}
    assert said(("Chapter 2", "text"), ("White to move", "ocr"))[1] == ("w", "ocr-page-scope")
    assert said(("White to move", "text"), ("Black to move", "text"), ("White to move", "ocr"))[1] == (None, None)
    assert said()[1] == (None, None)


def test_the_page_s_number_is_no_exercise(spark):
    lines = [line(0, 0, "41", 70), line(1, 0, "12", 82), line(0, 0, "41", 80, page=2)]
    got = contexts(spark, lines, [box(0, 100), box(0, 100, page=2)], None, [(1, 41)])
    assert (got[1, 0].exercise, got[2, 0].exercise) == (12, 41)


def test_diagrams_without_lines_and_empty_tables(spark):
    got = contexts(spark, [line(0, 0, "White to move", 900)], [box(0, 100), box(0, 100, page=3)])
    assert all((r.caption, r.side, r.side_confidence, r.exercise) == ("", None, 1.0, None) for r in got.values()) and set(got) == {(1, 0), (3, 0)}
    assert contexts(spark, [], []) == {}


def test_lines_meet_their_page_in_one_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines, boxes = spark.createDataFrame([line(0, 0, "No. 5", 60)], LINES), spark.createDataFrame([box(0, 100)], BOXES)
        plan = page_contexts(lines, boxes, ["page"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # the lines' and the boxes'


def test_pages_travel_packed_and_are_not_sorted_by_diagram(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()["diagram_contexts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3  # the line items, the boxes and the margins
    assert plan.count("Window ") == 1  # the numbers of the lines


def test_equal_numbers_null_pages_and_repeated_diagrams(spark):
    twice = [line(3, 0, "No. 5", 80), line(3, 0, "White to move", 80), line(3, 1, "Black to move", 205)]
    lost = [line(0, 0, "White to move", 80, page=None), line(1, 1, "Black to move", 80, page=None)]
    rows = page_contexts(*[spark.createDataFrame(r, s) for r, s in ((twice + lost, LINES), ([box(0, 100), box(1, 250), box(0, 100, page=None), box(4, 300, page=None)], BOXES))], ["page"]).collect()
    got = {(r.page, r.idx): (r.caption, r.side, r.exercise) for r in rows}
    assert got == {(1, 0): ("No. 5\nWhite to move", "w", 5), (1, 1): ("Black to move", "b", None), (None, 0): ("", None, None), (None, 4): ("", None, None)}
