"""Operators against plain Python, on small inputs with nulls, ties and empty tables."""

import itertools
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boardmill.functions import board, decode, replay, score, text
from boardmill.operators import leaders as near_leaders
from boardmill.operators import merges, metrics, review, search, similarity, tables
from boardmill.sources import records, sinks
from boardmill.streaming import incremental


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def column(spark, values, kind, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[1] for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


# boards and moves


def test_board_functions(spark):
    fens = ["rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", "8/8/8/8/8/8/8/8", "k7/8/8/8/8/8/8/7K b - - 0 1", "9/8/8/8/8/8/8/8", "", None, "44/8/8/8/8/8/8/8", "8/8/8/8/8/8/8"]
    expanded = column(spark, fens, "string", board.square_text)
    assert expanded[1] == "." * 64 and expanded[3] is None and expanded[4] is None and expanded[5] is None
    assert [len(x) for x in expanded[:3]] == [64] * 3
    assert column(spark, fens, "string", lambda c: board.fen_of_labels(board.labels_of(c)))[:3] == ["rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR", "8/8/8/8/8/8/8/8", "k7/8/8/8/8/8/8/7K"]
    assert column(spark, fens, "string", board.is_syntactic) == [True, True, True, False, False, False, False, False]
    masks = column(spark, fens[:3], "string", board.occupancy)
    assert [m & (2**64 - 1) for m in masks] == [0xFFFF00000000FFFF, 0, 1 << 56 | 1 << 7]
    assert column(spark, fens[:3], "string", board.structure_problems) == [[], ["empty", "no_white_king", "no_black_king"], []]
    assert column(spark, fens[:3], "string", board.pawn_direction) == [5.0, None, None]
    assert column(spark, [0, 7, 56, 63], "int", board.square_name) == ["a8", "h8", "a1", "h1"]
    assert column(spark, [0, 7, 56, 63], "int", board.board_square) == [56, 63, 0, 7]
    assert column(spark, fens[:1], "string", lambda c: board.full_fen(c, F.lit("b"), F.lit(7))) == ["rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR b KQkq - 0 7"]
    assert column(spark, fens[2:3], "string", lambda c: board.with_turn(c, F.lit("w"))) == ["k7/8/8/8/8/8/8/7K w - - 0 1"]


def perft(game, depth):
    """How many lines of legal moves there are, by trying every written move."""
    if depth == 0:
        return 1
    n = 0
    squares = [f + r for f in "abcdefgh" for r in "12345678"]
    moves = [f"{p}{s[0]}{s[1]}{t}" for p in "KQRBN" for s in squares for t in squares if s != t] + ["O-O", "O-O-O"]
    moves += [f"{s[0]}{s[1]}{t}{q}" for s in squares for t in squares if abs(ord(s[0]) - ord(t[0])) <= 1 and s[1] != t[1] for q in ([""] if t[1] not in "18" else ["=Q", "=R", "=B", "=N"])]
    for m in moves:
        g = replay.Game.__new__(replay.Game)
        g.__dict__ = {**game.__dict__, "castling": set(game.castling)}
        if g.play(m):
            n += perft(g, depth - 1)
    return n


@pytest.mark.parametrize("fen, depth, lines", [(replay.START + " w KQkq - 0 1", 2, 400), ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", 1, 48), ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", 2, 191), ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", 1, 44), ("r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", 1, 6)])
def test_move_generation_counts(fen, depth, lines):
    assert perft(replay.Game.of_fen(fen), depth) == lines


def test_replay(spark):
    rows = [(1, "1. e4 e5 2. Nf3 (2. f4 exf4 (2... d5)) Nc6!? {good} 3. Bb5 a6 *", None), (2, "1. e4 e5 2. Ke3 d6", None), (3, "1... Kb8", "k7/8/8/8/8/8/8/7K b - - 0 5"), (4, None, None), (5, "e4", "nonsense"), (6, "1. e4 d5 2. e5 f5 3. exf6 ( Nf6", None)]
    got = replay.replay(spark.createDataFrame(rows, "g int, movetext string, setup_fen string"), ["g"]).orderBy("g", "ply").collect()
    of = lambda g: [(r.ply, r.placement, r.move_number, r.white_to_move) for r in got if r.g == g]
    assert of(1)[-1] == (6, "r1bqkbnr/1ppp1ppp/p1n5/1B2p3/4P3/5N2/PPPP1PPP/RNBQK2R", 4, True)
    assert len(of(2)) == 2 and of(4) == [] and of(5) == []
    assert of(3) == [(0, "k7/8/8/8/8/8/8/7K", 5, False), (1, "1k6/8/8/8/8/8/8/7K", 6, True)]
    assert of(6)[-1][1] == "rnbqkbnr/ppp1p1pp/5P2/3p4/8/8/PPPP1PPP/RNBQKBNR"


def test_position_checks(spark):
    fens = ["k7/8/8/8/8/8/8/K6r w - - 0 1", "k7/8/8/8/8/8/8/K6r b - - 0 1", "8/8/8/8/8/8/8/K7", "xx", None, "k7/8/8/8/8/8/8/K6r w - - 0 1"]
    got = [r.check for r in replay.check_positions(spark.createDataFrame([(f,) for f in fens], "fen string"), "fen").orderBy("fen").collect()]
    by = {f: c for f, c in zip(sorted(fens, key=lambda f: (f is not None, f)), got, strict=True)}
    assert by[fens[0]].legal and by[fens[0]].legal_turn == "w"
    assert not by[fens[1]].legal and by[fens[1]].flip_needed and by[fens[1]].legal_turn == "w"
    assert by[fens[2]].fatal and by["xx"] is None and by[None] is None


def test_decoder():
    rng = np.random.default_rng(1)
    wanted = "rnbqkbnrpppppppp" + "." * 32 + "PPPPPPPPRNBQKBNR"
    p = np.full((64, 13), 0.01)
    for k, c in enumerate(wanted):
        p[k, board.LETTERS.index(c)] = 0.88
    assert decode.decode_board(p)[::2] == (wanted, 0) or decode.decode_board(p) == (wanted, 0.0, 0, True)
    p[60] = 0.01
    p[60, board.LETTERS.index("Q")] = 0.5
    p[60, board.LETTERS.index("K")] = 0.4
    assert decode.decode_board(p)[0] == wanted and decode.decode_board(p)[2:] == (1, True)
    for _ in range(20):
        squares, cost, changed, solved = decode.decode_board(rng.dirichlet(np.full(13, 0.2), 64))
        assert changed <= 6 and cost >= 0 and (not solved or not decode.violations(list(squares)))


# captions and cells


def test_text_functions(spark):
    assert column(spark, ["Straße  É–x", None, ""], "string", text.fold) == ["strasse e-x", None, ""]
    assert column(spark, [" nan ", None, " a "], "string", text.clean_cell) == ["", "", "a"]
    assert column(spark, ["20.0", "x", "3.5", None, "7"], "string", text.integer_text) == ["20", "x", "3.5", "", "7"]
    assert column(spark, ["3", "3.0", "0", "-1", "+4", None], "string", text.positive_int) == [3, None, None, None, 4, None]
    sides = {"Brancas jogam": "w", "White to move": "w", "Juegan las negras": "b", "Schwarz am Zug": "b", "Trait aux blancs": "w", "if black to move wins": None, "White to move, black to play": None, "Weiß zieht": "w", "nothing": None}
    assert [r and r["side"] for r in column(spark, list(sides), "string", text.side_phrase)] == list(sides.values())
    assert column(spark, ["12.", "nº 7. Mate", "Diagram 3", "abc", "l2."], "string", text.exercise_number) == [12, 7, 3, None, 12]
    assert column(spark, [["a", " ", 'b "c"']], "array<string>", text.flat_caption) == ["a / b 'c'"]
    assert [tuple(r) for r in column(spark, ['{"results":[{"fen":"x"}]}', "no", "{}", '{"results":[{"fen":""}]}'], "string", score.remote_reading)] == [("x", None), (None, "no_json"), (None, "no_results"), (None, "no_fen")]


def test_board_confidence(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(13), 64)
    got = column(spark, [p.ravel().tolist()], "array<double>", score.board_confidence)[0]
    assert got["classes"] == p.argmax(axis=1).tolist() and got["min_confidence"] == pytest.approx(p.max(axis=1).min())
    assert got["mean_entropy"] == pytest.approx(float(-(p * np.log(p)).sum(axis=1).mean()))
    best = p.max(axis=1)
    assert got["uncertain"] == [k for _, k in sorted((b, k) for k, b in enumerate(best) if b < 0.9)]


# kernels


def iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / u if u else 0.0


def boxes(seed, n):
    rng = random.Random(seed)
    return [(k, *(lambda x, y, s: (x, y, x + s, y + s))(rng.randint(0, 60), rng.randint(0, 60), rng.randint(5, 30))) for k in range(n)]


def frame(spark, rows, kind="page int, idx int, x0 double, y0 double, x1 double, y1 double"):
    return spark.createDataFrame([tuple(float(v) if isinstance(v, int) and k > 1 else v for k, v in enumerate(r)) for r in rows], kind).repartition(3)


def test_box_matching(spark):
    one_side = [(p, *b) for p in range(4) for b in boxes(p, 8)]
    other = [(p, i, a + 2, b, c + 2, d) for p, i, a, b, c, d in one_side if i % 3] + [(9, 0, 0, 0, 5, 5)]
    got = {(r.page, r.annotation, r.reading) for r in similarity.match_boxes(frame(spark, one_side), frame(spark, other), ["page"]).collect()}
    want = set()
    for p in range(4):
        pairs = sorted(((iou(a[2:], b[2:]), a[1], b[1]) for a in one_side for b in other if a[0] == b[0] == p and iou(a[2:], b[2:]) >= 0.5), reverse=True)
        seen_a, seen_b = set(), set()
        for _, a, b in pairs:
            if a not in seen_a and b not in seen_b:
                seen_a.add(a), seen_b.add(b), want.add((p, a, b))
    assert got == want and want
    assert similarity.match_boxes(frame(spark, one_side), frame(spark, other).limit(0), ["page"]).count() == 0


def test_suppression_and_tiles(spark):
    rows = [(0, *b, ((b[0] * 37) % 50) / 50) for b in boxes(5, 25)]
    df = frame(spark, rows, "page int, idx int, x0 double, y0 double, x1 double, y1 double, score double")
    got = {r.idx: r.reason for r in similarity.suppress(df, ["page"], most=4).collect()}
    kept, want = [], {}
    ranked = sorted(rows, key=lambda r: (-r[6], r[1]))
    for r in ranked:
        if r[6] < max(0.06, 0.25 * ranked[0][6]):
            want[r[1]] = "low_score"
        elif any(iou(r[2:6], k[2:6]) > 0.25 for k in kept):
            want[r[1]] = "overlap"
        elif len(kept) >= 4:
            want[r[1]] = "limit"
        else:
            kept.append(r)
            want[r[1]] = ""
    assert got == want and set(want.values()) == {"", "low_score", "overlap", "limit"}
    merged = similarity.merge_tiles(frame(spark, [(0, 0, 0, 0, 10, 10), (0, 1, 11, 0, 20, 10), (0, 2, 21, 5, 30, 15), (0, 3, 60, 60, 70, 70)]), ["page"]).collect()
    assert sorted((r.x0, r.x1, r.tiles) for r in merged) == [(0, 30, 3), (60, 70, 1)]


def test_near_duplicates_and_nearest(spark):
    rng = random.Random(4)
    base = [[rng.getrandbits(64) - 2**63 for _ in range(4)] for _ in range(6)]
    rows = []
    for k in range(40):
        words = list(base[k % 6])
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(4)] ^= 1 << rng.randrange(62)
        rows.append((f"f{k:02d}", f"p{k % 2}", f"book{k % 5}", words))
    df = spark.createDataFrame(rows, "name string, placement string, book string, words array<long>").repartition(3)
    ham = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True))
    want = set()
    for p in ("p0", "p1"):
        leaders, groups = [], {}
        for name, _, _, w in sorted(r for r in rows if r[1] == p):
            lead = next((n for n, v in leaders if ham(v, w) <= 3), None)
            if lead is None:
                leaders.append((name, w))
            groups.setdefault(lead or name, []).append(name)
        want |= {(g, n) for g, ns in groups.items() if len(ns) > 1 for n in ns}
    assert {tuple(r) for r in near_leaders.near_duplicate_groups(df, "name", "placement", "words").collect()} == want and want
    samples = df.select(F.col("name").alias("sample"), "words")
    index = df.withColumnRenamed("name", "row")
    for most in (None, 6):
        got = {r.sample: (r.row, r.distance, r.ambiguous) for r in similarity.nearest(samples, index.where("row > 'f20'"), "sample", "row", "book", "words", most).collect()}
        for name, _, _, w in rows:
            ranked = sorted((ham(w, v), n, b) for n, _, b, v in rows if n > "f20")
            d, n, b = ranked[0]
            other = min((x for x, _, c in ranked if c != b), default=None)
            if most is None or d <= most:
                assert got[name] == (n, d, other is not None and other - d < 4)
            else:
                assert name not in got


def test_diff_runs(spark):
    kind = "pdf string, page int, side_pt double, x0 double, y0 double, x1 double, y1 double"
    rows = [("a", 1, 80.0, 0.0, 0.0, 10.0, 10.0), ("a", 1, 50.0, 50.0, 50.0, 60.0, 60.0), ("a", 2, 90.0, 0.0, 0.0, 9.0, 9.0)]
    after = [("a", 1, 80.0, 0.0, 0.0, 10.0, 10.0), ("a", 1, 50.0, 51.0, 50.0, 61.0, 60.0), ("b", 1, 80.0, 0.0, 0.0, 9.0, 9.0)]
    named = lambda r: spark.createDataFrame(r, kind).withColumn("rx", F.bround("x0")).withColumn("ry", F.bround("y0"))
    got = similarity.diff_runs(named(rows), named(after), ["pdf", "page", "rx", "ry"], ["pdf", "page"]).collect()
    assert sorted((r.pdf, r.page, r.change, r.suspect) for r in got) == [("a", 1, "moved", True), ("a", 2, "lost", False), ("b", 1, "gained", False)]


def test_lines_to_diagrams(spark):
    diagrams = frame(spark, [(0, 0, 100, 100, 200, 200), (0, 1, 100, 250, 200, 350)])
    lines = spark.createDataFrame([(0, 0, 7, 100.0, 204.0, 200.0, 214.0), (0, 1, 8, 100.0, 354.0, 200.0, 364.0), (0, 2, 9, 100.0, 366.0, 200.0, 372.0), (0, 3, 5, 600.0, 0.0, 700.0, 9.0)], "page int, line int, group_id int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.group_id, r.idx) for r in similarity.assign_lines(lines, diagrams, ["page"]).collect()) == [(7, 0), (8, 1), (9, 1)]
    assert similarity.dominant_side(similarity.group_relations(similarity.lines_near(lines, diagrams, ["page"]), ["page"]), ["page"]).first().placement == "below"


def test_reading_order_columns(spark):
    rows = [(0, 0, 0, 50, 10, 60), (0, 1, 0, 0, 10, 10), (0, 2, 50, 0, 60, 10), (0, 3, 51, 40, 61, 50)]
    got = {r.idx: r.position for r in similarity.reading_order(frame(spark, rows), ["page"]).collect()}
    assert got == {1: 0, 0: 1, 2: 2, 3: 3}


# tables, merges, searches


def test_changes(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, None, "y")], "k int, v string, w string")
    patch = spark.createDataFrame([(2, "B", "new"), (9, "z", "new")], "k int, v string, extra string")
    assert sorted(map(tuple, tables.update(t, patch, ["k"]).collect())) == [(1, "a", None, None), (2, "B", "x", "new"), (3, None, "y", None)]
    source, target = tables.move(t, t.limit(0), spark.createDataFrame([(1,), (7,)], "k int"), ["k"], {"why": F.lit("old")}, ["w"])
    assert source.count() == 2 and [tuple(r) for r in target.select("k", "v", "why").collect()] == [(1, "a", "old")]
    assert tables.upsert(t, patch, ["k"]).count() == 4 and tables.delete(t, patch, ["k"]).count() == 2
    assert [r.k for r in tables.page_of(t, ["k"], 99, 2).collect()] == [3]
    assert tables.keep_first(t.union(t), ["k"], ["v"]).count() == 3


def test_ledger_keeps_misses(spark):
    positions = spark.createDataFrame([(k % 3, k) for k in range(100)], "key int, n int")
    asked = spark.createDataFrame([(0,), (1,), (50,), (0,)], "key int")
    found = search.inverted_search(positions, asked, ["key"], ["n"])
    ledger = search.record_answers(found.limit(0), asked, found, ["key"])
    rows = {r.key: (r["count"], [h.n for h in r.hits]) for r in ledger.collect()}
    assert rows == {0: (34, list(range(0, 96, 3))), 1: (33, list(range(1, 97, 3))), 50: (0, [])}
    assert search.never_asked(spark.createDataFrame([(2,), (50,)], "key int"), ledger, ["key"]).collect()[0].key == 2
    assert search.valid_ledger(ledger, "a", "b").count() == 0
    assert search.inverted_search(positions.limit(0), asked, ["key"], ["n"]).count() == 0


def test_fair_share_quota(spark):
    rng = random.Random(9)
    for _ in range(4):
        rows = [(g, k) for g in "abc" for k in range(rng.randint(0, 9))]
        limit = rng.randint(1, 12)
        df = spark.createDataFrame(rows or [("a", 0)], "g string, k int")
        groups = {g: [k for h, k in (rows or [("a", 0)]) if h == g] for g in sorted({g for g, _ in (rows or [("a", 0)])})}
        quota = max(1, limit // len(groups))
        want = [(g, k) for g, ks in groups.items() for k in ks[:quota]] + [(g, k) for g, ks in groups.items() for k in ks[quota:]]
        assert sorted(map(tuple, search.fair_share(df, ["g"], ["k"], limit).collect())) == sorted(want[:limit])


def test_duplicate_pointer_and_queue(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, None), (3, 1, None)], "page int, diagram int, key string")
    got = {(r.page, r.diagram): r.duplicate_of and tuple(r.duplicate_of) for r in review.duplicate_pointers(df, ["key"], ["page", "diagram"]).collect()}
    assert got == {(1, 1): None, (1, 2): None, (2, 1): (1, 1), (2, 2): None, (3, 1): (2, 2)}
    items = spark.createDataFrame([(1, 1, 5.0, ["a"]), (1, 2, 9.0, []), (0, 9, 5.0, ["b"])], "page int, diagram int, priority double, reasons array<string>")
    assert [(r.page, r.diagram) for r in review.queue(items).collect()] == [(0, 9), (1, 1)]


def test_pgn_text(spark):
    df = spark.createDataFrame([("x", {"Site": 'A "B"'})], "event string, typed map<string,string>")
    pgn = review.pgn_text(df, [("Event", F.col("event")), ("Site", F.lit("?")), ("FEN", F.lit(None).cast("string"))], F.col("typed"), F.lit("seen")).first().pgn
    assert pgn == '[Event "x"]\n[Site "A \\"B\\""]\n\n{ seen } *\n'


def test_auc_and_thresholds(spark):
    rng = random.Random(8)
    rows = [(rng.choice([0.0, 0.1, 0.25, 0.5, 0.5, 0.9, 1.0]), rng.random() < 0.6) for _ in range(80)]
    df = spark.createDataFrame(rows, "c double, ok boolean")
    pos, neg = [c for c, ok in rows if ok], [c for c, ok in rows if not ok]
    want = sum((a > b) + (a == b) / 2 for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert metrics.auc(df, "c", F.col("ok")).first().auc == pytest.approx(want)
    assert np.isnan(metrics.auc(df.where("ok"), "c", F.col("ok")).first().auc)
    assert metrics.confidence_for_accuracy(df, "c", "ok", 1.1).first().threshold is None
    assert metrics.reliability(df.limit(0), "c", "ok").count() == 0
    logits = spark.createDataFrame([([2.0 * (k == j) + rng.gauss(0, 1) for j in range(5)], k) for k in range(5) for _ in range(60)], "z array<double>, y int")
    t = metrics.temperature(logits, "z", "y")
    loss = lambda x: logits.agg(F.avg(metrics.cross_entropy(F.col("z"), F.col("y"), x))).first()[0]
    assert loss(t) <= min(loss(t * 1.1), loss(t * 0.9), loss(1.0)) + 1e-9


def test_merge_keeps_human_values(spark):
    conflict = spark.createDataFrame([({"White": "A", "Site": "b"}, ["Site"], {"White": "B", "Site": "c"})], "h map<string,string>, f array<string>, c map<string,string>")
    assert conflict.select(merges.conflicts(F.col("h"), F.col("f"), F.col("c"))).first()[0] == ["White"]
    assert conflict.select(merges.revert_headers(F.col("h"), {"White": "A", "Site": "x"})).first()[0] == {"Site": "b"}
    assert conflict.select(merges.apply_headers(F.col("h"), {"White": "Z"})).first()[0] == {"White": "Z", "Site": "b"}


# files and streams


def test_game_archive(spark, tmp_path):
    games = "﻿[Event \"A\"]\n[White \"Kasparov, G\"]\n[Black \"A. Réti\"]\n[Annotator \"x\"]\n\n1. e4 e5 *\n\n[Event \"B \\\"q\\\"\"]\n[FEN \"k7/8/8/8/8/8/8/7K b - - 0 1\"]\n[White \"\"]\n\n1... Kb8 *\n"
    (tmp_path / "one.pgn").write_text(games, encoding="utf-8")
    (tmp_path / "Two.pgn").write_text('[Event "C"]\r\n\r\n1. d4 *\r\n', encoding="utf-8")
    rows = {r.headers["Event"]: r for r in records.read_games(spark, str(tmp_path / "*.pgn")).collect()}
    assert set(rows) == {"A", 'B "q"', "C"}
    assert (rows["A"].white, rows["A"].black, rows["A"].movetext) == ("kasparov", "reti", "1. e4 e5 *")
    assert rows['B "q"'].setup_fen.startswith("k7/") and "White" not in rows['B "q"'].headers and "Annotator" not in rows["A"].headers
    files = records.list_files(spark, str(tmp_path))
    assert [r.path.split("/")[-1] for r in files.orderBy("file_id").collect()] == ["one.pgn", "Two.pgn"]
    assert records.fingerprint(files).first()[0].count("|") == 1


def test_label_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("filename, fen,source_page,note\na.png,8/8,20.0,nan\nb.png,,x,hi\n")
    df = records.read_labels(spark, str(tmp_path / "l.csv"))
    assert df.columns == [*records.LABEL_COLUMNS, "note"] and {r.note for r in df.collect()} == {"", "hi"}
    sinks.write_labels(df, str(tmp_path / "out"))
    again = records.read_labels(spark, str(tmp_path / "out"))
    assert sorted(r.source_page for r in again.collect()) == ["20", "x"] and again.columns == df.columns
    (tmp_path / "bad.csv").write_text("filename\na\n")
    with pytest.raises(ValueError):
        records.read_labels(spark, str(tmp_path / "bad.csv"))


def test_json_lines(spark, tmp_path):
    lines = ["// note", json.dumps({"a": 1}), "", json.dumps({"a": 2}), '{"a": ', json.dumps({"a": 3})]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    read = lambda policy: sorted(r.a for r in records.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int", policy).collect())
    assert read("skip") == [1, 2, 3] and read("torn") == [1, 2]
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        read("fail")


def test_resumed_scan(spark, tmp_path):
    folder, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    spark.range(10).repartition(3).write.parquet(folder)
    stream = incremental.scan(spark, folder, spark.range(0).schema, 1)
    incremental.run_available(stream, [incremental.batch_sink(out)], mark)
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(folder)
    incremental.run_available(incremental.scan(spark, folder, spark.range(0).schema, 1), [incremental.batch_sink(out)], mark)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(15))
    assert incremental.compatible({"a": 1}, {"a": 1}, "m", "") and not incremental.compatible({"a": 1}, {"a": 1}, "m", "n")
    assert pd.Series(incremental.parameters_key({"b": 2, "a": "x/y"})).iloc[0] == "a=x_y_b=2"


def test_legality_classes(spark):
    df = spark.createDataFrame([(1, False, None, None), (2, True, True, False), (3, True, False, False), (4, True, False, True)], "k int, s boolean, f boolean, l boolean")
    got = [r[0] for r in df.orderBy("k").select(score.legality(F.col("s"), F.col("f"), F.col("l"))).collect()]
    assert got == score.LEGALITY


def test_artifacts(spark, tmp_path):
    from boardmill.sources import artifacts

    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "source_name": "book", "diagrams": {"3.1": {"headers": {"White": "A"}, "filled_rule": "date"}, "x": {}}}))
    (tmp_path / "b.json").write_text("{broken")
    rows = artifacts.read_annotations(spark, str(tmp_path / "*.json")).collect()
    assert [(r.book, r.page, r.diagram, r.headers) for r in rows] == [("book", 3, 1, {"White": "A"})]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "one.json").write_text(json.dumps({"version": 1, "books": {"book": [{"page_index": 1, "diagram_index": 2, "games_matched": 3}]}}))
    match = artifacts.read_matches(spark, str(tmp_path / "m")).first()
    assert (match.book, match.games_matched, match.candidates) == ("book", 3, [])
    hash_lines = [{"kind": "header", "version": 1}, {"source_pdf": "b", "source_page": 1, "source_diagram": 1, "hash": "f" * 16 + "0" * 47 + "1"}, {"source_pdf": "b", "hash": "zz"}]
    (tmp_path / "h.jsonl").write_text("\n".join(map(json.dumps, hash_lines)))
    found = artifacts.read_hash_index(spark, str(tmp_path / "h.jsonl")).orderBy("readable").collect()
    assert [r.readable for r in found] == [False, True] and found[1].words == [-1, 0, 0, 1]
    (tmp_path / "q.json").write_text(json.dumps({"version": 2, "items": [{"page_index": 1}]}))
    assert artifacts.read_queue(spark, str(tmp_path / "q.json")).count() == 0


def test_page_operators(spark):
    from boardmill.operators import pages

    lines = spark.createDataFrame([("b", p, "Chapter %d" % p, 0.0, 5.0) for p in range(4)] + [("b", 1, "0Z0Z0Z0s", 50.0, 60.0), ("b", 1, "White to move", 50.0, 60.0)], "book string, page int, text string, y0 double, y1 double").withColumn("height", F.lit(100.0))
    assert [r.text for r in pages.body_lines(lines, ["page"], "height", ["book"]).collect()] == ["White to move"]
    assert pages.margin_lines(lines, "height").count() == 4
    entries = spark.createDataFrame([(0, 3, 1), (1, 3, 2), (2, 5, 1)], "position int, page int, diagram int")
    assert [pages.position_of(entries, *at).first().position for at in ((3, 2), (3, 9), (4, 1))] == [1, 0, None]
    got = spark.range(1).select(pages.agreement(F.lit("8/8/8/8/8/8/8/8"), F.lit("PPPPPPPP/PPPPPPPP/8/8/8/8/8/8")).alias("a")).first().a
    assert (got.agreement, got.collapsed) == (0.75, True)
    with pytest.raises(Exception, match="illegal position"):
        spark.range(1).select(pages.validated_update(F.lit("8/8"), F.lit("w"), F.lit(True), F.lit(True), F.lit(False))).collect()


def test_occurrences_are_counted_before_they_meet_targets_and_unused_lists_are_left_away(spark):
    positions = spark.createDataFrame([(k % 3, k) for k in range(120)] + [(None, 1)], "key int, n int")
    asked = spark.createDataFrame([(1,), (2,), (7,), (None,)], "key int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.inverted_search(positions, asked, ["key"], ["n"])
        counts = found.select("key", "count")
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.key, r["count"], len(r.hits), r.hits[0].n) for r in found.collect()) == [(1, 40, 32, 1), (2, 40, 32, 2)]
        assert sorted(map(tuple, counts.collect())) == [(1, 40), (2, 40)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Window" not in plan and plan.count("Join") == 1
    assert plan.index("LeftSemi") < plan.index("partial_count")  # the count is below the join
