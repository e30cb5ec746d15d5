"""The constrained decoder against exhaustive search and on broken boards."""

import itertools

import numpy as np
import pytest

from boardmill.functions import decode
from boardmill.functions.board import LETTERS
from boardmill.functions.replay import TURN_FLAGS, compress, expand, status


def probabilities(placement, sure=0.95, changed=()):
    p = np.full((64, 13), (1 - sure) / 12)
    for k, c in enumerate(expand(placement)):
        p[k, LETTERS.index(c)] = sure
    for k, values in changed:
        p[k] = (1 - sum(values.values())) / (13 - len(values))
        for c, v in values.items():
            p[k, LETTERS.index(c)] = v
    return p


FAULTS = ["no white king", "no black king", "no king", "two kings", "pawns on the edge", "nine pawns", "too many promoted"]


def drawn(rng, fault):
    """A board of our own, drawn at random, that breaks one rule (its pieces stand anywhere)."""
    inner, board = rng.permutation(np.arange(8, 56)).tolist(), ["."] * 64
    put = lambda letters: [board.__setitem__(inner.pop(), c) for c in letters]
    put({"no white king": "k", "no black king": "K", "no king": "", "two kings": "KKk"}.get(fault, "Kk"))
    put(rng.choice(list("QRBNqrbn"), rng.integers(1, 5)))
    put({"nine pawns": "P" * 9, "too many promoted": "p" * 8 + "qqrrr"}.get(fault, "Pp"))
    if fault == "pawns on the edge":
        for k in rng.choice([*range(8), *range(56, 64)], 2, replace=False):
            board[k] = rng.choice(list("Pp"))
    return compress(board)


def broken(board):
    return decode.violations(list(board))


def exhaustive(p, most):
    """The cheapest board without a broken rule among all that differ in at most ``most`` squares, by the same options."""
    logs = np.log(np.maximum(p, 1e-12))
    best = logs.argmax(axis=1)
    loss = logs.max(axis=1, keepdims=True) - logs
    options = decode._options(loss, best)
    base = [LETTERS[c] for c in best]
    missing = [LETTERS.index(k) for k in "Kk" if k not in base]
    found = None
    for n in range(most + 1):
        for squares in itertools.combinations(range(64), n):
            for classes in itertools.product(*[[c for c in dict.fromkeys([*options[k], *missing]) if c != best[k]] for k in squares]):
                cost = sum(loss[k, c] for k, c in zip(squares, classes, strict=True))
                if found is None or cost < found - 1e-12:
                    board = base[:]
                    for k, c in zip(squares, classes, strict=True):
                        board[k] = LETTERS[c]
                    if not broken(board):
                        found = cost
    return found


@pytest.mark.parametrize("seed", range(14))
def test_cost_equals_exhaustive_search(monkeypatch, seed):
    monkeypatch.setattr(decode, "MAX_CHANGES", 2)
    rng = np.random.default_rng(seed)
    placement = drawn(rng, FAULTS[seed % 7])
    p = probabilities(placement, 0.9)
    p = p + rng.dirichlet(np.full(13, 0.3), 64) * 0.8
    p /= p.sum(axis=1, keepdims=True)
    p[p.argmax(axis=1) != probabilities(placement).argmax(axis=1)] = 1 / 13
    for k, c in enumerate(expand(placement)):
        p[k, LETTERS.index(c)] = max(p[k, LETTERS.index(c)], p[k].max() + 1e-3)
    p /= p.sum(axis=1, keepdims=True)
    squares, cost, changed, solved = decode.decode_board(p)
    want = exhaustive(p, 2)
    assert solved == (want is not None)
    if solved:
        assert cost == pytest.approx(want) and changed <= 2 and not broken(squares)


@pytest.mark.parametrize("seed", range(21))
def test_repaired_boards_have_no_fatal_fault(seed):
    placement = drawn(np.random.default_rng(100 + seed), FAULTS[seed % 7])
    squares, cost, changed, solved = decode.decode_board(probabilities(placement))
    assert solved and 0 < changed <= decode.MAX_CHANGES and cost > 0
    assert not status(list(squares), True) & ~TURN_FLAGS and len(compress(list(squares)).split("/")) == 8


def test_legal_boards_stay():
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR"
    assert decode.decode_board(probabilities(start)) == ("".join(expand(start)), 0.0, 0, True)


@pytest.mark.parametrize("seed", range(5))
def test_the_likeliest_square_becomes_the_missing_king(seed):
    rng = np.random.default_rng(seed)
    board = expand(drawn(rng, "no white king"))
    at = int(rng.choice([k for k in range(64) if board[k] == "."]))
    board[at], sure = str(rng.choice(list("QRBN"))), rng.uniform(0.51, 0.7)
    squares, _, changed, solved = decode.decode_board(probabilities(compress(board), changed=[(at, {board[at]: sure, "K": 0.95 - sure})]))
    assert solved and changed == 1 and squares[at] == "K"


def test_more_tallies_than_are_kept(monkeypatch):
    """With few tallies kept a board is still allowed, though it may not be the cheapest."""
    p = probabilities(drawn(np.random.default_rng(7), "nine pawns"), 0.6)
    best = decode.decode_board(p)
    monkeypatch.setattr(decode, "MAX_TALLIES", 3)
    few = decode.decode_board(p)
    assert best[3] and few[1] >= best[1] - 1e-12


def test_boards_beyond_the_changes():
    squares, _, changed, solved = decode.decode_board(probabilities("PPPPPPPP/8/8/8/4k3/8/8/K6p"))
    assert not solved and changed <= decode.MAX_CHANGES


def test_violations_name_all_rules():
    assert [r for r, _ in broken(expand("PPPPPPPP/PPPPPPPP/8/8/8/8/8/7k"))] == ["no K", "too many P", "too many promoted PNBRQK", "pawns on the edge"]
    assert [(r, len(s)) for r, s in broken(expand("4k3/PPPPPPP1/QQQ5/8/8/8/8/4K3"))] == [("too many promoted PNBRQK", 11)]
