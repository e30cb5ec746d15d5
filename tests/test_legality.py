"""Faults of positions, and groups of lines given to boxes, against plain versions."""

import random

import numpy as np

from boardmill.functions import replay
from boardmill.functions.replay import status
from boardmill.operators import similarity


def attacked_from(board, at):
    """The squares that the piece on a square attacks."""
    piece, (row, col), out = board[at], divmod(at, 8), []
    lines, diagonals = [(0, 1), (0, -1), (1, 0), (-1, 0)], [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    far = {"b": diagonals, "r": lines, "q": lines + diagonals}.get(piece.lower(), [])
    near = {"n": [(a, b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a) != abs(b)], "k": lines + diagonals, "P": [(-1, -1), (-1, 1)], "p": [(1, -1), (1, 1)]}.get(piece if piece in "Pp" else piece.lower(), [])
    for steps, most in ((far, 7), (near, 1)):
        for dr, dc in steps:
            for n in range(1, most + 1):
                r, c = row + dr * n, col + dc * n
                if not (0 <= r < 8 and 0 <= c < 8):
                    break
                out.append(r * 8 + c)
                if board[r * 8 + c] != ".":
                    break
    return out


def plain_status(board, white):
    n = lambda letters: sum(c in letters for c in board)
    checkers = lambda king, own: [k for k in range(64) if board[k] != "." and board[k].isupper() != own and king in attacked_from(board, k)]
    flags = [(1, n("K") == 0), (2, n("k") == 0), (4, n("K") > 1 or n("k") > 1), (8, n("P") > 8), (16, n("p") > 8), (32, any(board[k] in "Pp" for k in [*range(8), *range(56, 64)]))]
    flags += [(64, n("PNBRQK") > 16), (128, n("pnbrqk") > 16), (256, n(".") == 64)]
    waiting, moving = ("k", "K") if white else ("K", "k")
    flags.append((512, any(board[k] == waiting and checkers(k, waiting == "K") for k in range(64))))
    if n(moving) == 1:
        king = board.index(moving)
        found = checkers(king, moving == "K")
        flags.append((1024, len(found) > 2))
        if len(found) == 2:
            (r, c), (a, b), (d, e) = (divmod(k, 8) for k in (king, *found))
            flags.append((2048, (a - r) * (e - c) == (d - r) * (b - c)))
    return sum(f for f, on in flags if on)


def test_status_equals_a_plain_version():
    rng = random.Random(2)
    seen = set()
    for k in range(3_000):
        board = ["."] * 64
        for _ in range(rng.choice([0, 3, 6, 12, 40])):
            board[rng.randrange(64)] = rng.choice("PNBRQpnbrq" + "Kk" * (k % 3))
        if k % 2:
            board[rng.randrange(64)], board[rng.randrange(64)] = "K", "k"
        for white in (True, False):
            want = plain_status(board, white)
            assert status(board, white) == want, ("".join(board), white)
            seen |= {1 << b for b in range(12) if want >> b & 1}
    assert len(seen) == 12


def plain_assignment(lines, boxes, radius=60.0):
    """{(page, group): box} of lines (page, line, group, box) and boxes (page, idx, box)."""
    near = []
    for page, line, group, (x0, y0, x1, y1) in lines:
        for p, idx, (a0, b0, a1, b1) in boxes:
            if p != page:
                continue
            dx, dy = max(0, a0 - x1, x0 - a1), max(0, b0 - y1, y0 - b1)
            part = lambda s, e, t, f: max(0, min(e, f) - max(s, t)) / min(e - s, f - t)
            across, along = part(x0, x1, a0, a1), part(y0, y1, b0, b1)
            side = "overlapping" if dx == dy == 0 else "above" if across >= 0.25 and y1 <= b0 else "below" if across >= 0.25 and y0 >= b1 else "left" if along >= 0.25 and x1 <= a0 else "right" if along >= 0.25 and x0 >= a1 else None
            if side and (dx * dx + dy * dy) ** 0.5 <= radius:
                near.append((page, line, group, idx, (dx * dx + dy * dy) ** 0.5, side))
    out = {}
    for page in {n[0] for n in near}:
        own = [n for n in near if n[0] == page]
        pairs = {}
        for _, line, group, idx, distance, side in own:
            pairs[group, idx] = min(pairs.get((group, idx), (1e9,)), (distance, line, side))
        votes = []
        for side in ("above", "below"):
            nearest = {}
            for (_, idx), (distance, _, own_side) in pairs.items():
                if own_side == side:
                    nearest[idx] = min(nearest.get(idx, 1e9), distance)
            if nearest:
                votes.append((-len(nearest), sum(nearest.values()) / len(nearest), side))
        best = min(votes)[2] if votes else None
        ranked = sorted((d, idx, group, side) for (group, idx), (d, _, side) in pairs.items())
        claimed = set()
        for _, idx, group, side in ranked:
            if side == best and idx not in claimed and (page, group) not in out:
                claimed.add(idx)
                out[page, group] = idx
        for _, idx, group, _ in ranked:
            out.setdefault((page, group), idx)
    return out


def test_assignment_equals_a_plain_version(spark):
    rng = random.Random(8)
    box = lambda w, h: (x := float(rng.randrange(0, 300)), y := float(rng.randrange(0, 300)), x + w, y + h)
    boxes = [(p, k, box(60.0, 60.0)) for p in range(15) for k in range(rng.randint(1, 6))]
    lines = [(p, k, k // 2, box(50.0, 8.0)) for p in range(15) for k in range(rng.randint(0, 14))]
    flat = lambda rows: [(*r[:-1], *r[-1]) for r in rows]
    b = spark.createDataFrame(flat(boxes), "page int, idx int, x0 double, y0 double, x1 double, y1 double")
    a = spark.createDataFrame(flat(lines), "page int, line int, group_id int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.page, r.group_id): r.idx for r in similarity.assign_lines(a, b, ["page"]).collect()}
    assert got == plain_assignment(lines, boxes) and len(got) > 30


def test_crowded_pages_are_assigned_without_rows_of_pairs(spark, monkeypatch):
    rng = random.Random(9)
    # equal boxes and lines, groups of several lines, and results handed back after each page
    box = lambda w, h: (x := float(rng.randrange(0, 20) * 15), y := float(rng.randrange(0, 20) * 15), x + w, y + h)
    boxes = [(p, k, box(rng.choice([40.0, 60.0]), 60.0)) for p in range(3) for k in range(120)]
    lines = [(p, k, k % 70, box(50.0, 8.0)) for p in range(3) for k in range(200)]
    flat = lambda rows: [(*r[:-1], *r[-1]) for r in rows]
    b = spark.createDataFrame(flat(boxes), "page int, idx int, x0 double, y0 double, x1 double, y1 double")
    a = spark.createDataFrame(flat(lines), "page int, line int, group_id int, x0 double, y0 double, x1 double, y1 double")
    monkeypatch.setattr(similarity, "FEW_ROWS", 1)
    monkeypatch.setattr(similarity, "FEW_PAIRS", 8 * 120 * 7)
    found = similarity.assign_lines(a, b, ["page"])
    got = {(r.page, r.group_id): r.idx for r in found.collect()}
    assert got == plain_assignment(lines, boxes) and len(got) == 210
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_relations_in_blocks_equal_the_columns(spark, monkeypatch):
    rng = random.Random(10)
    box = lambda: (x := rng.uniform(0, 200), y := rng.uniform(0, 200), x + rng.uniform(-5, 60), y + rng.uniform(-5, 30))
    one, two = [box() for _ in range(60)] + [(5.0, 5.0, None, 9.0)], [box() for _ in range(40)] + [(0.0, 0.0, 0.0, 0.0)]
    kind = "x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame([(0, k, k, *r) for k, r in enumerate(one)], f"page int, line int, group_id int, {kind}")
    b = spark.createDataFrame([(0, k, *r) for k, r in enumerate(two)], f"page int, idx int, {kind}")
    want = sorted((r.line, r.idx, r.distance, r.placement) for r in similarity.lines_near(a, b, ["page"]).collect())
    for pairs in (8, 8 * 41 * 9, 1 << 22):
        monkeypatch.setattr(similarity, "FEW_PAIRS", pairs)
        got = zip(*(x.tolist() for x in similarity._relations(np.array(one, float), np.array(two, float), 60.0)), strict=True)
        assert sorted((i, j, d, similarity._SIDES[side]) for i, j, d, side in got) == want
    assert len({r[3] for r in want}) == 5


def test_a_game_ends_where_no_wanted_placement_can_follow():
    text = "1. e4 e5 2. Nf3 Nc6 3. d4 exd4 4. Nxd4 Nf6 5. Nc3 Bb4 {x} (5... Bc5) 6. Nxc6 bxc6"
    whole = list(replay.positions(text))
    assert len(whole) == 12 and list(replay.positions(text)) == whole and len(replay._openings) >= 3
    kept = [p for p in whole if p[1].split("/")[6].count("P") >= 7]
    assert list(replay.positions(text, least=(0, 7, 0))) == kept and len(kept) == 4
    assert [p[0] for p in replay.positions(text, least=(31, 0, 0))] == list(range(1, 7))
    # a pawn that a malformed set-up has behind its home rank may still come there
    assert len(list(replay.positions("1. e2 e6 2. e4", "4k3/4p3/8/8/8/8/8/K3P3 w - - 0 1", least=(0, 1, 0)))) == 4


def test_shared_openings_keep_their_castling_rights():
    one = list(replay.positions("1. Nf3 Nf6 2. g3 g6 3. Bg2 Bg7 4. Kf1 O-O"))
    two = list(replay.positions("1. Nf3 Nf6 2. g3 g6 3. Bg2 Bg7 4. O-O Kf8"))
    assert len(one) == len(two) == 8
