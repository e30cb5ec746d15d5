"""Column functions, readers and writers on small rows: what the queries don't reach."""

import json
import math

import pytest
from pyspark.sql import functions as F

from boardmill.functions import board, geometry, replay, score, text
from boardmill.operators import datasets, merges, metrics, pages, review, search, tables
from boardmill.sources import artifacts, records, sinks
from boardmill.streaming import incremental

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR"


def values(spark, rows, schema, column):
    return [r.v for r in spark.createDataFrame(rows, schema).select("*", column.alias("v")).collect()]


def test_sides_of_lines_and_pairs_of_captions(spark):
    rows = [("White to move", True), ("it was White to move", False), ("White to move and win", False), ("□ Black to move", True), ("□ x", False), ("if White to play", True), ("nothing", True), (None, True)]
    got = values(spark, rows, "t string, c boolean", text.side_of_line("t", F.col("c"))["side"])
    assert got == ["w", None, "w", "w", None, None, None, None]
    pairs = values(spark, [("12. Tal, M - Botvinnik, Moscow 1960",), ("Spassky – Fischer",), ("e4 - e5",), (None,)], "t string", text.caption_pair("t"))
    assert pairs[1] == pairs[1] and pairs[1] is not None and pairs[2] is None and pairs[3] is None
    swapped = values(spark, [("Fischer - Spassky",)], "t string", text.caption_pair("t"))
    assert swapped[0] == pairs[1]


def test_text_helpers(spark):
    assert values(spark, [("a1b2",), ("zz",), (None,)], "t string", text.allowed_only("t", "ab]^-")) == ["ab", None, None]
    assert values(spark, [(34_000_000,), (1_200_000_000,)], "n long", text.human_size("n")) == ["34 MB", "1,2 GB"]


def test_boxes(spark):
    box = lambda *n: F.struct(*[F.lit(float(x)).alias(c) for x, c in zip(n, ("x0", "y0", "x1", "y1"), strict=True)])
    one = spark.range(1)
    ask = lambda c: one.select(c.alias("v")).first().v
    lit = lambda x: F.lit(float(x))
    assert ask(geometry.axis_overlap(lit(0), lit(10), lit(5), lit(40))) == 0.5 and ask(geometry.axis_overlap(lit(0), lit(0), lit(0), lit(9))) == 0.0
    places = [((0, 0, 10, 4), "above"), ((0, 30, 10, 34), "below"), ((-20, 12, -12, 16), "left"), ((30, 12, 40, 16), "right"), ((2, 12, 8, 14), "overlapping"), ((-90, -90, -80, -80), None)]
    for at, want in places:
        got = ask(geometry.relation(box(*at), box(0, 10, 20, 20)))
        assert (got and got["side"]) == want
    assert ask(geometry.relation(box(0, 0, 10, 4), box(0, 10, 20, 20)))["distance"] == 6.0
    assert ask(geometry.visible_ratio(box(-5, 0, 5, 10), lit(100), lit(100))) == 0.5 and ask(geometry.visible_ratio(box(1, 1, 1, 1), lit(9), lit(9))) == 0.0
    assert ask(geometry.geometry_score(box(0, 0, 10, 10), lit(500))) == 1.0 and ask(geometry.geometry_score(box(0, 0, 0, 0), lit(500))) == 0.0


def test_board_helpers(spark):
    assert values(spark, [(f"{START} b KQkq - 0 1",), (START,), ("x y",)], "f string", board.fen_turn("f")) == ["b", "", ""]
    assert values(spark, [("8/8 w - - 0 1",)], "f string", board.analysis_url("f"))[0].endswith("8/8_w_-_-_0_1")
    assert values(spark, [(START,)], "f string", board.count_of(board.square_text("f"), "Pp")) == [16]
    assert values(spark, [(f"{START} w - - 0 1", f"{START} b KQkq - 3 9"), (START, START)], "a string, b string", board.placement("a") == board.placement("b")) == [True, True]


def test_cascades(spark):
    rows = [(True, False), (False, True), (True, True), (False, False)]
    assert values(spark, rows, "w boolean, b boolean", score.turn_proven(F.col("w"), F.col("b"))) == ["w", "b", None, None]
    sides = [("w", "caption", None), ("w", "caption", "w"), ("w", "caption", "b"), (None, None, "b"), (None, None, None)]
    got = values(spark, sides, "d string, s string, p string", score.side_to_move(F.col("d"), F.col("s"), F.col("p")))
    assert [tuple(g) for g in got] == [("w", "caption", False), ("w", "caption", False), ("b", "legality", True), ("b", "legality", False), ("w", "default", False)]
    rules = [("human", True, 1), ("", True, 1), ("", True, 5), (None, True, None), ("", False, 1), (None, None, None)]
    assert values(spark, rules, "s string, f boolean, n int", score.inferred_rule(F.col("s"), F.col("f"), F.col("n"))) == ["human", "unique", "date", "date", "", ""]
    second = values(spark, [([0.2, 0.5, 0.3],), ([0.4, 0.4, 0.2],)], "p array<double>", score.runner_up(F.col("p")))
    assert [tuple(s) for s in second] == [(2, 0.3), (1, 0.4)]
    moved = spark.createDataFrame([("a", 1, None), ("b", 2, 2)], "n string, x int, y int")
    names = moved.select(merges.changed_only({"n": F.col("n"), "x": F.col("x")}, {"n": F.lit("a"), "x": F.col("y")}).alias("v")).collect()
    assert [r.v for r in names] == [["x"], ["n"]]


def test_board_font_rows(spark):
    rows = [("0Z0Z0ZkZ",), ("8Z0Z0Z0Z0",), ("abcdefgh",), ("a b c d e f g h",), ("White to move",), ("Kasparov",)]
    assert values(spark, rows, "t string", pages.board_font_row(F.col("t"))) == [True, True, True, True, False, False]


def test_histograms_and_reasons(spark):
    boards = spark.createDataFrame([(START,), ("8/8/8/8/8/8/8/K6k",), ("broken",), (None,)], "fen string")
    counts = {r["class"]: r["count"] for r in datasets.class_histogram(boards, board.squares("fen")).collect()}
    assert counts["."] == 32 + 62 and counts["P"] == counts["p"] == 8 and counts["K"] == counts["k"] == 2 and sum(counts.values()) == 128
    reasons = spark.createDataFrame([("overlap",), ("overlap",), ("limit",)], "reason string")
    assert {(r.reason, r["count"]) for r in pages.rejection_reasons(reasons).collect()} == {("overlap", 2), ("limit", 1)}


def test_acceptance_and_parity(spark):
    items = spark.createDataFrame([(k, 0, float(k), 0.9 if k % 2 else 0.1, ["illegal"] if k > 7 else []) for k in range(10)], "page int, diagram int, priority double, conf double, reasons array<string>")
    rows = {r["sample"]: r.error_rate for r in review.acceptance(items, 4, 1, F.col("conf"), F.col("reasons")).collect()}
    assert rows["top"] == 0.75 and rows["all"] == 0.6 and 0 <= rows["drawn"] <= 1
    same = spark.createDataFrame([([0.1, 0.9], [0.1, 0.9]), ([0.6, 0.4], [0.4, 0.6])], "a array<double>, b array<double>")
    got = metrics.parity(same, "a", "b").first()
    assert math.isclose(got.largest, 0.2) and math.isclose(got["mean"], 0.1) and got.argmax_differs == 1 and got.within is False
    assert metrics.parity(same.limit(1), "a", "b").first().within is True


def test_answers_of_diagrams(spark):
    diagrams = spark.createDataFrame([(1, "p"), (2, "q"), (3, "none")], "d int, placement string")
    index = spark.createDataFrame([("p", 3, ["g1", "g2"]), ("q", 0, [])], "placement string, count int, hits array<string>")
    got = {r.d: (r["count"], r.hits, r.best) for r in search.match_positions(diagrams, index, ["placement"]).collect()}
    assert got == {1: (3, ["g1", "g2"], "g1"), 2: (0, [], None)}


def test_rows_in_order_and_partitions(spark):
    df = spark.createDataFrame([("x", "f", "b1"), ("y", "g", "b2")], "extra string, fen string, book string")
    assert tables.with_columns_in_order(df, ["filename", "fen"]).columns == ["filename", "fen", "extra", "book"]
    fresh = spark.createDataFrame([("n", "h", "b2"), ("m", "i", "b2")], df.schema)
    assert {tuple(r) for r in tables.replace_partition(df, fresh, "book").select(*df.columns).collect()} == {("x", "f", "b1"), ("n", "h", "b2"), ("m", "i", "b2")}
    shuffled = datasets.shuffle_in_windows(spark.range(300).withColumn("g", F.col("id") % 100), "g", 7, window=10)
    rows = shuffled.collect()
    assert sorted(r.id for r in rows) == list(range(300)) and len({r.run for r in rows}) == 10
    assert all(len({r.run for r in rows if r.g == g}) == 1 for g in range(100))
    assert [r.id for r in rows] == [r.id for r in shuffled.collect()] != list(range(300))


def test_watermarks(spark):
    done = spark.createDataFrame([("a", 0), ("a", 4), ("b", 1)], "book string, page int")
    assert {tuple(r) for r in incremental.watermark(done).collect()} == {("a", 5), ("b", 2)}


def test_split_and_census_files(spark, tmp_path):
    splits = spark.createDataFrame([("b.png", "val"), ("a.png", "train")], "filename string, split string")
    sinks.write_splits(splits, str(tmp_path / "splits"))
    assert {tuple(r) for r in records.read_splits(spark, str(tmp_path / "splits")).collect()} == {("a.png", "train"), ("b.png", "val")}
    (tmp_path / "bad.csv").write_text("filename,split\na.png,dev\n")
    with pytest.raises(Exception, match="dev"):
        records.read_splits(spark, str(tmp_path / "bad.csv")).collect()
    census = spark.createDataFrame([("x.pdf", 3, 0, "embedded", 90.5, 300, 310, False, 0.8, 0.1, 1.0, 2.0, 3.0, 4.0)], artifacts.CENSUS)
    sinks.write_census(census, str(tmp_path / "census"))
    assert artifacts.read_census(spark, str(tmp_path / "census")).collect() == census.collect()
    rejected = spark.createDataFrame([("x.pdf", 3, "overlap", 0.2, 0.1, 90.0, 1.0, 2.0, 3.0, 4.0)], artifacts.REJECTION)
    sinks.write_rejections(rejected, str(tmp_path / "rejections"))
    assert artifacts.read_census(spark, str(tmp_path / "rejections"), artifacts.REJECTION).collect() == rejected.collect()
    assert records.schema_version(records.LABEL_COLUMNS) == 2 and records.schema_version(["filename", "fen"]) == 1


def test_json_files(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "page int, fen string")
    sinks.write_json_lines(rows, str(tmp_path / "lines"), ["page"])
    files = sorted((tmp_path / "lines").glob("part-*"))
    assert [json.loads(line)["page"] for f in files for line in f.read_text().splitlines()] == [1, 2, 3]
    assert {tuple(r) for r in records.read_json_lines(spark, str(tmp_path / "lines"), "page int, fen string").collect()} == {(1, "a"), (2, "b"), (3, None)}
    sinks.write_report(spark.createDataFrame([(1, 0.5)], "n int, share double"), str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("part-*"))) == 1 and spark.read.json(str(tmp_path / "report")).first().share == 0.5
    entry = {"page_index": 4, "diagram_index": 1, "placement": START, "side_to_move": "w", "side_to_move_source": "caption", "min_confidence": 0.9, "is_legal": True, "image_path": "", "caption": "x"}
    (tmp_path / "index.json").write_text(json.dumps({"source_pdf": "x.pdf", "last_page_done": 9, "complete": False, "entries": [entry, {**entry, "page_index": 5}]}))
    (tmp_path / "empty.json").write_text(json.dumps({"source_pdf": "y.pdf", "entries": []}))
    (tmp_path / "torn.json").write_text('{"source_pdf": "z')
    got = artifacts.read_index(spark, str(tmp_path / "*.json")).collect()
    assert [(r.book, r.last_page_done, r.complete, r.page_index, r.placement) for r in got] == [("x.pdf", 9, False, 4, START), ("x.pdf", 9, False, 5, START)]


def test_gated_texts_and_books(spark, tmp_path):
    rows = spark.createDataFrame([("accepted", 2, 0, "two"), ("accepted", 1, 0, "one"), ("rejected", 1, 1, "bad")], "verdict string, page int, diagram int, pgn string")
    sinks.write_gated(rows, str(tmp_path / "pgn"))
    lines = [line for f in sorted((tmp_path / "pgn/verdict=accepted").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ["one", "two"] and len(list((tmp_path / "pgn").glob("verdict=*"))) == 2
    books = spark.createDataFrame([("a", 1), ("b", 1)], "book string, n int")
    sinks.write_by_book(books, str(tmp_path / "books"))
    sinks.write_by_book(spark.createDataFrame([("b", 2)], "book string, n int"), str(tmp_path / "books"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "books")).select("book", "n").collect()} == {("a", 1), ("b", 2)}


def test_the_gate_s_plan_stays_small(spark, tmp_path, monkeypatch):
    """Placements that are themselves long expressions are stored before the gate spells them out."""
    rows = spark.range(40).select(F.regexp_replace(F.concat(F.lit("8/8/8/8/8/8/8/K6"), F.element_at(F.split(F.lit("k,q,r"), ","), (F.col("id") % 3 + 1).cast("int"))), "q", "k").alias("placement"))
    seen, real = [], replay.gate_for
    monkeypatch.setattr(replay, "gate_for", lambda wanted: seen.append(wanted) or real(wanted))
    games = spark.createDataFrame([(1, "1. e4 e5", None)], "k int, movetext string, setup_fen string")
    assert replay.replay(games, ["k"], wanted=rows).count() == 0
    plan = seen[0].select(board.occupancy("placement"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000 and "regexp_replace" not in plan


def test_provenance_of_old_rows_is_recovered(spark):
    kind = "k int, move_number int, side_to_move string, headers map<string,string>, filled_from string, filled_fields array<string>"
    rows = [(1, 5, "w", {"White": "Tal", "Black": "typed"}, "g", []), (2, 5, "w", {"White": "Tal"}, "", []), (3, 5, "w", {}, "g", ["side_to_move"]), (4, None, "b", None, "g", None), (5, 5, "w", {}, "g", [])]
    matches = [(k, None if k == 4 else 5, "w", {"White": "Tal", "Black": "Koblenz", "Event": ""}) for k in (1, 2, 3, 4)]
    got = merges.recover_provenance(spark.createDataFrame(rows, kind), spark.createDataFrame(matches, "k int, move_number int, side_to_move string, headers map<string,string>"), ["k"])
    assert {r.k: r.filled_fields for r in got.collect()} == {1: ["move_number", "side_to_move", "header:White"], 2: [], 3: ["side_to_move"], 4: ["move_number"], 5: []}
    sides = values(spark, [("w", "x b"), ("", "x b"), ("z", "x"), (None, None)], "s string, f string", board.resolved_side("s", "f"))
    assert sides[:3] == ["w", "b", ""] and not sides[3]
