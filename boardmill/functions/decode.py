"""The most probable board that the rules of set and promotion allow, from 64 x 13 class probabilities.

Objective: the least sum of lost log probability, subject to one king a side, no pawn on the first
or last rank, and no more pawns and promoted pieces together than a side has pawns to begin with.
At most ``MAX_CHANGES`` squares may differ from their most probable class, each by one of its
``ALTERNATIVES`` next classes or empty; a missing king may be anywhere.

Every change costs something, so a cheapest board changes only squares of a side, or kings, that
break a rule or that other changes could make break one.  Those squares are taken one after
another; a table holds the least cost of each tally (changes and pieces of each class, packed into
one number), all its rows at once as arrays; rows that cost more than an allowed board go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .board import LETTERS

# The limits of the search, and how many of a piece a side has before pawns must have been promoted.
MAX_CHANGES, MAX_TALLIES, ALTERNATIVES = 6, 5_000, 4
MAX_PAWNS, MAX_PIECES = 8, 16
AT_START = {"N": 2, "B": 2, "R": 2, "Q": 1}

_SIDES = ["PNBRQK", "pnbrqk"]
_CLASS = {c: k for k, c in enumerate(LETTERS)}
_EDGE = np.r_[np.arange(8), np.arange(56, 64)]
_START_COUNT = np.array([AT_START[c] for c in "NBRQ"])


def _load(counts: np.ndarray, side: int) -> np.ndarray:
    """Pawns and promoted pieces of a side, from counts of the 13 classes in the last axis."""
    first = 1 + 6 * side
    return counts[..., first] + np.maximum(0, counts[..., first + 1 : first + 5] - _START_COUNT).sum(axis=-1)


def _faults(counts: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """How many rules are broken, for counts of the 13 classes in the last axis and pawns on the edge."""
    total = (edge > 0).astype(int)
    for side in (0, 1):
        first = 1 + 6 * side
        total += (counts[..., first + 5] != 1).astype(int) + (_load(counts, side) > MAX_PAWNS) + (counts[..., first : first + 6].sum(axis=-1) > MAX_PIECES)
    return total


def violations(board: list[str]) -> list[tuple[str, list[int]]]:
    """(rule, squares at which a change may mend it) of each broken rule."""
    at = lambda letters: [k for k in range(64) if board[k] in letters]
    found = []
    for side in _SIDES:
        kings, pieces = at(side[5]), at(side)
        counts = np.array([len(at(c)) for c in LETTERS])
        if len(kings) != 1:
            found.append((f"{'no' if not kings else 'more than one'} {side[5]}", kings or [k for k in range(64) if board[k] != side[5]]))
        if len(at(side[0])) > MAX_PAWNS:
            found.append((f"too many {side[0]}", at(side[0])))
        if len(pieces) > MAX_PIECES:
            found.append((f"too many {side}", pieces))
        elif _load(counts, _SIDES.index(side)) > MAX_PAWNS:
            found.append((f"too many promoted {side}", pieces))
    if edge := [k for k in at("Pp") if k in _EDGE]:
        found.append(("pawns on the edge", edge))
    return found


def _options(loss: np.ndarray, best: np.ndarray) -> list[list[int]]:
    """The classes that each square may change to."""
    ranked = np.argsort(loss, axis=1, kind="stable")
    return [list(dict.fromkeys([*[c for c in ranked[k].tolist() if c != best[k]][:ALTERNATIVES], *([0] if best[k] else [])])) for k in range(64)]


def _touched(best: np.ndarray, options: list[list[int]]) -> tuple[list[int], list[str]]:
    """The squares that a cheapest board may change, beside those that only take a missing king, and the kings that are missing."""
    counts = np.bincount(best, minlength=13)
    missing = [s[5] for s in _SIDES if not counts[_CLASS[s[5]]]]
    edge = {int(k) for k in _EDGE if LETTERS[best[k]] in "Pp"}
    groups = [([6 + 6 * side], 1 - int(counts[6 + 6 * side])) for side in (0, 1)]
    groups += [(list(range(1 + 6 * side, 6 + 6 * side)), MAX_PAWNS - int(_load(counts, side))) for side in (0, 1)]
    squares = set(edge)
    grown = True
    while grown:  # classes that are over their limit, or may come to be by what goes into them
        grown = False
        for classes, room in groups:
            incoming = sum(any(c in classes for c in options[k]) and best[k] not in classes for k in squares)
            if room < 0 or incoming > room:
                new = {k for k in range(64) if best[k] in classes} - squares
                squares |= new
                grown |= bool(new)
    return sorted(squares), missing


def decode_board(probabilities: np.ndarray) -> tuple[str, float, int, bool]:
    """(64 squares, cost, changed squares, solved): the cheapest allowed board; else the one with the fewest broken rules.

    Cheapest as long as no more than MAX_TALLIES tallies are open at once; beyond that only the cheapest of them are
    gone on with, so a cheaper board, or the only allowed one, may be missed.
    """
    p = np.log(np.maximum(np.asarray(probabilities, float).reshape(64, 13), 1e-12))
    best = p.argmax(axis=1)
    loss = p.max(axis=1, keepdims=True) - p
    counts = np.bincount(best, minlength=13)
    edge = np.isin(np.arange(64), _EDGE) & np.isin(best, [_CLASS["P"], _CLASS["p"]])
    letters = lambda b: "".join(LETTERS[c] for c in b)
    if not _faults(counts, edge.sum()):
        return letters(best), 0.0, 0, True
    options = _options(loss, best)
    free, missing = _touched(best, options)
    squares = list(range(64)) if missing else free
    kings = [_CLASS[m] for m in missing]
    # a tally: counts of the 13 classes, changes, and pawns left on the edge
    tally = np.r_[counts, 0, edge.sum()][None, :].astype(np.int8)
    cost, steps = np.zeros(1), []
    weight = np.random.default_rng(13).integers(1, 1 << 62, 15)
    for k in squares:
        grown, costs, came, took = [tally], [cost], [np.arange(len(tally))], [np.full(len(tally), best[k])]
        room = np.flatnonzero(tally[:, 13] < MAX_CHANGES)
        for c in dict.fromkeys([*(options[k] if k in free else ()), *(x for x in kings if x != best[k])]):
            new = tally[room].copy()
            new[:, best[k]] -= 1
            new[:, c] += 1
            new[:, 13] += 1
            new[:, 14] += int(k in _EDGE and LETTERS[c] in "Pp") - int(edge[k])
            grown.append(new), costs.append(cost[room] + loss[k, c]), came.append(room), took.append(np.full(len(room), c))
        tally, cost, parent, choice = (np.concatenate(x) for x in (grown, costs, came, took))
        key = tally.astype(np.int64) @ weight
        order = np.lexsort((cost, key))
        order = order[np.r_[True, np.diff(key[order]) != 0]]
        # a tally stands for a whole board, the squares to come unchanged; what costs more than an allowed one can't be cheapest
        allowed = _faults(tally[order, :13].astype(int), tally[order, 14]) == 0
        if allowed.any():
            order = order[cost[order] <= cost[order][allowed].min()]
        if len(order) > MAX_TALLIES:
            order = order[np.argsort(cost[order], kind="stable")[:MAX_TALLIES]]
        tally, cost = tally[order], cost[order]
        steps.append((parent[order], choice[order]))
    faults = _faults(tally[:, :13].astype(int), tally[:, 14])
    end = int(np.lexsort((cost, faults))[0])
    board, at = best.copy(), end
    for k, (parent, choice) in zip(reversed(squares), reversed(steps), strict=True):
        board[k], at = choice[at], parent[at]
    return letters(board), float(cost[end]), int(tally[end, 13]), not faults[end]


def decode_boards(df: DataFrame, keys: list[str], probabilities: str) -> DataFrame:
    """(keys, squares, cost, changed, solved) of rows with array<double>(832); of null all are null."""
    kinds = dict(df.dtypes)

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*r[:-1], *((None,) * 4 if r[-1] is None else decode_board(r[-1]))) for r in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[*keys, "squares", "cost", "changed", "solved"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "squares string, cost double, changed int, solved boolean"])
    return df.select(*keys, probabilities).mapInPandas(kernel, schema)
