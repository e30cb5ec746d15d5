"""Chess rules as far as data needs them: replaying recorded moves and judging positions.

Boards are lists of 64 letters in reading order (a8 first), '.' for empty.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .board import occupancy

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR"
VARIATION_DEPTH = 12
_LINES = [(0, 1), (0, -1), (1, 0), (-1, 0)]
_DIAGONALS = [(1, 1), (1, -1), (-1, 1), (-1, -1)]
_KNIGHT = [(1, 2), (2, 1), (-1, 2), (-2, 1), (1, -2), (2, -1), (-1, -2), (-2, -1)]
_SAN = re.compile(r"^([KQRBN])?([a-h])?([1-8])?x?([a-h][1-8])(?:=?([QRBNqrbn]))?[+#]*$")
_CASTLE = re.compile(r"^[O0]-[O0](-[O0])?[+#]*$")


def expand(placement: str) -> list[str] | None:
    """The 64 squares of a placement, or None if it is malformed."""
    ranks = placement.split("/")
    rows = ["".join("." * int(c) if c.isdigit() else c for c in r) for r in ranks]
    if len(rows) != 8 or any(len(r) != 8 or set(r) - set(".PNBRQKpnbrqk") for r in rows):
        return None
    return list("".join(rows))


def compress(board: list[str]) -> str:
    """The placement of 64 squares."""
    text = "".join(board)
    text = "/".join([text[k : k + 8] for k in range(0, 64, 8)])
    for n in range(8, 0, -1):
        text = text.replace("." * n, str(n))
    return text


def _place(name: str) -> int:
    return (8 - int(name[1])) * 8 + "abcdefgh".index(name[0])


def _ray(at: int, step: tuple[int, int], far: int = 7) -> tuple[int, ...]:
    """The squares from one square on in a direction, nearest first."""
    row, col = divmod(at, 8)
    line = [(row + step[0] * n, col + step[1] * n) for n in range(1, far + 1)]
    return tuple(r * 8 + c for r, c in line if 0 <= r < 8 and 0 <= c < 8)


_LINE_RAYS = [[r for d in _LINES if (r := _ray(k, d))] for k in range(64)]
_DIAGONAL_RAYS = [[r for d in _DIAGONALS if (r := _ray(k, d))] for k in range(64)]
_LEAPS = [[k for d in _KNIGHT for k in _ray(at, d, 1)] for at in range(64)]
_BESIDE = [[k for d in _LINES + _DIAGONALS for k in _ray(at, d, 1)] for at in range(64)]
#: From which squares a white (True) or black pawn attacks a square.
_PAWN_FROM = {w: [[k for d in ((1 if w else -1, -1), (1 if w else -1, 1)) for k in _ray(at, d, 1)] for at in range(64)] for w in (True, False)}
_RAYS_OF = {"B": [_DIAGONAL_RAYS], "R": [_LINE_RAYS], "Q": [_DIAGONAL_RAYS, _LINE_RAYS]}
#: The bit of a square in a board's occupancy (a1 is bit 0).
_BIT = [1 << ((7 - k // 8) * 8 + k % 8) for k in range(64)]


def attackers(board: list[str], at: int, white: bool) -> list[int]:
    """The places of the pieces of one side that attack a square."""
    knight, king, pawn, bishop, rook, queen = "NKPBRQ" if white else "nkpbrq"
    out = [k for k in _LEAPS[at] if board[k] == knight]
    out += [k for k in _BESIDE[at] if board[k] == king]
    out += [k for k in _PAWN_FROM[white][at] if board[k] == pawn]
    for rays, piece in ((_LINE_RAYS, rook), (_DIAGONAL_RAYS, bishop)):
        for ray in rays[at]:
            for k in ray:
                if (held := board[k]) != ".":
                    if held == piece or held == queen:
                        out.append(k)
                    break
    return out


def in_check(board: list[str], white: bool) -> bool:
    king = "K" if white else "k"
    return any(board[k] == king and attackers(board, k, not white) for k in range(64))


@functools.lru_cache(maxsize=20_000)
def _parsed(move: str) -> tuple | None:
    """(piece, column, rank, target, promoted) of a move's text, ("O", long) of castling, None of anything else."""
    if _CASTLE.match(move):
        return ("O", move.count("-") == 2)
    m = _SAN.match(move)
    return m and (m[1] or "P", -1 if m[2] is None else "abcdefgh".index(m[2]), -1 if m[3] is None else 8 - int(m[3]), _place(m[4]), m[5])


class Game:
    """A position that recorded moves are played on."""

    def __init__(self, placement: str = START, white: bool = True, castling: str = "KQkq", passing: str = "-", number: int = 1):
        board = expand(placement)
        if board is None:
            raise ValueError("malformed placement")
        self.board, self.white, self.castling, self.number = board, white, set(castling) - {"-"}, number
        self.passing = _place(passing) if re.fullmatch("[a-h][36]", passing) else -1
        self.occupied = sum(_BIT[k] for k in range(64) if board[k] != ".")
        self.kings = {"K": board.index("K") if "K" in board else -1, "k": board.index("k") if "k" in board else -1}

    @staticmethod
    def of_fen(fen: str) -> Game:
        parts = fen.split() + ["w", "-", "-", "0", "1"][max(0, len(fen.split()) - 1) :]
        if parts[1] not in ("w", "b"):
            raise ValueError("malformed side")
        return Game(parts[0], parts[1] == "w", parts[2], parts[3], int(parts[5]) if parts[5].isdigit() else 1)

    def copy(self) -> Game:
        """The same position; boards and places of kings are replaced by moves, not changed, so both may hold them."""
        twin = object.__new__(Game)
        twin.__dict__.update(self.__dict__, castling=set(self.castling))
        return twin

    def play(self, san: str) -> bool:
        """Plays a move; False, and nothing changes, if it isn't legal or not unique."""
        move = _parsed(san)
        if move is None or not (self._castle(move[1]) if move[0] == "O" else self._ordinary(*move)):
            return False
        self.number += not self.white
        self.white = not self.white
        return True

    def _castle(self, long: bool) -> bool:
        row = 56 if self.white else 0
        right = ("Q" if long else "K") if self.white else ("q" if long else "k")
        rook, king_to, rook_to = (row, row + 2, row + 3) if long else (row + 7, row + 6, row + 5)
        king, board = row + 4, self.board
        between = range(rook + 1, king) if long else range(king + 1, rook)
        if right not in self.castling or any(board[k] != "." for k in between) or any(attackers(board, k, not self.white) for k in (king, (king + king_to) // 2, king_to)):
            return False
        board = self.board = board[:]
        board[king_to], board[rook_to] = board[king], board[rook]
        board[king] = board[rook] = "."
        self.occupied = (self.occupied | _BIT[king_to] | _BIT[rook_to]) & ~(_BIT[king] | _BIT[rook])
        self.kings = {**self.kings, "K" if self.white else "k": king_to}
        self.castling -= set("KQ" if self.white else "kq")
        self.passing = -1
        return True

    def _sources(self, letter: str, piece: str, to: int) -> list[int]:
        board = self.board
        if piece in "NK":
            return [k for k in (_LEAPS if piece == "N" else _BESIDE)[to] if board[k] == letter]
        if piece == "P":
            out = []
            if board[to] == ".":
                back = 8 if self.white else -8
                if 0 <= to + back < 64:
                    if board[to + back] == letter:
                        out.append(to + back)
                    elif board[to + back] == "." and to // 8 == (4 if self.white else 3) and board[to + 2 * back] == letter:
                        out.append(to + 2 * back)
            if board[to] != "." or to == self.passing:
                out += [k for k in _PAWN_FROM[self.white][to] if board[k] == letter]
            return out
        out = []
        for rays in _RAYS_OF[piece]:
            for ray in rays[to]:
                for k in ray:
                    if (held := board[k]) != ".":
                        if held == letter:
                            out.append(k)
                        break
        return out

    def _ordinary(self, piece: str, column: int, rank: int, to: int, promoted: str | None) -> bool:
        board, white = self.board, self.white
        letter = piece if white else piece.lower()
        taken = board[to]
        if (taken != "." and taken.isupper() == white) or (piece == "P" and (to < 8 or to > 55)) != bool(promoted):
            return False
        sources = [k for k in self._sources(letter, piece, to) if (column < 0 or k & 7 == column) and (rank < 0 or k >> 3 == rank)]
        arriving = letter if promoted is None else promoted.upper() if white else promoted.lower()
        king, found = "K" if white else "k", -1
        for at in sources:
            passed = to + (8 if white else -8) if piece == "P" and taken == "." and (at ^ to) & 7 else -1
            held = board[passed] if passed >= 0 else "."
            board[to], board[at] = arriving, "."
            if passed >= 0:
                board[passed] = "."
            # a king that isn't on its recorded square (several kings) is looked for on the whole board
            home = to if piece == "K" else self.kings[king]
            safe = not (attackers(board, home, not white) if home >= 0 and board[home] == king and board.count(king) == 1 else in_check(board, white))
            board[at], board[to] = letter, taken
            if passed >= 0:
                board[passed] = held
            if safe:
                if found >= 0:
                    return False
                found = at
        if found < 0:
            return False
        at, board = found, board[:]
        self.board = board
        board[to], board[at] = arriving, "."
        self.occupied = (self.occupied | _BIT[to]) & ~_BIT[at]
        if piece == "P":
            if taken == "." and (at ^ to) & 7:
                gone = to + (8 if white else -8)
                board[gone] = "."
                self.occupied &= ~_BIT[gone]
            self.passing = (at + to) >> 1 if abs(at - to) == 16 else -1
        else:
            self.passing = -1
            if piece == "K":
                self.kings = {**self.kings, king: to}
                self.castling -= set("KQ" if white else "kq")
        if self.castling:
            for right, corner in (("K", 63), ("Q", 56), ("k", 7), ("q", 0)):
                if corner == at or corner == to:
                    self.castling.discard(right)
        return True


def main_line(movetext: str) -> str:
    """Movetext without comments and variations; an unbalanced variation cuts the rest off."""
    text = re.sub(r"\{[^}]*\}|;[^\n]*", " ", movetext)
    if "(" not in text and ")" not in text:
        return text
    for _ in range(VARIATION_DEPTH):
        text, found = re.subn(r"\([^()]*\)", " ", text)
        if not found:
            break
    return re.split(r"[()]", text, maxsplit=1)[0]


#: Buckets of the gate that a board's occupancy must pass.
GATE_BITS = 20
#: Rows of a batch of positions.
BATCH_ROWS = 50_000


def gate_of(occupied: int) -> int:
    """The bucket of an occupancy."""
    return (occupied ^ occupied >> 20 ^ occupied >> 40) & ((1 << GATE_BITS) - 1)


#: Plies whose positions a process keeps, as most games share them, and how many it keeps at most.
OPENING_PLIES, OPENINGS = 3, 20_000
_openings: dict[tuple[str, ...], Game] = {}


def _opened(tokens: list[str]) -> Iterator[Game]:
    """The game after each of the first moves from the standard start, until one is illegal; not to be changed."""
    game, line = Game(), ()
    for move in tokens:
        line += (move,)
        known = _openings.get(line)
        if known is None:
            known = game.copy()
            if not known.play(move):
                return
            if len(_openings) < OPENINGS:
                _openings[line] = known
        game = known
        yield game


def positions(movetext: str, setup: str | None = None, gate: bytes | None = None, least: tuple[int, int, int] | None = None) -> Iterator[tuple[int, str, int, bool]]:
    """(ply, placement, move number, white to move) after each move, and of the set-up position (ply 0).

    The standard start isn't given; an illegal move ends the game; a bad set-up gives nothing.
    With a ``gate``, a flag for each bucket, positions whose occupancy it doesn't let through are left out
    before their placement is spelled.  ``least`` has numbers of pieces, of white pawns and of black pawns on their
    home ranks: none of them ever grows, so a game ends with the first position that has fewer.
    """
    try:
        game = Game.of_fen(setup) if setup else Game()
    except ValueError:
        return
    if setup and (gate is None or gate[gate_of(game.occupied)]):
        yield 0, compress(game.board), game.number, game.white
    pieces, white, black = least or (0, 0, 0)
    if "P" in game.board[56:] or "p" in game.board[:8]:  # only a malformed set-up has pawns that may still come to their home rank
        white = black = 0
    moves = [move for token in main_line(movetext).replace(".", ". ").split() if _parsed(move := token.rstrip("!?")) is not None]
    shared = 0 if setup else min(OPENING_PLIES, len(moves))
    opened = _opened(moves[:shared])
    for ply, move in enumerate(moves, 1):
        if ply <= shared:
            game = next(opened, None)
            if game is None:
                return
        else:
            if ply == shared + 1:
                game = game.copy()
            if not game.play(move):
                return
        if game.occupied.bit_count() < pieces or game.board[48:56].count("P") < white or game.board[8:16].count("p") < black:
            return
        if gate is None or gate[gate_of(game.occupied)]:
            yield ply, compress(game.board), game.number, game.white


def least_of(wanted: DataFrame, placement: str = "placement") -> tuple[int, int, int]:
    """The least numbers, over the placements wanted, of pieces and of white and black pawns on their home ranks; runs a job at once."""
    count = lambda text, letters: F.min(F.length(text) - F.length(F.regexp_replace(text, f"[{letters}]", "")))
    rank = lambda n: F.split_part(placement, F.lit("/"), F.lit(n))
    found = wanted.agg(count(F.col(placement), "A-Za-z"), count(rank(7), "P"), count(rank(2), "p")).first()
    return tuple(n or 0 for n in found)


def gate_for(wanted: DataFrame, placement: str = "placement") -> bytes:
    """A flag for each bucket that one of the placements wanted falls into: of one size however many they are.

    Runs a job at once, which brings 2**GATE_BITS rows to the driver at most.  ``wanted`` should be a stored table, as
    the occupancy spells its column many times over.
    """
    mask = occupancy(placement)
    bucket = mask.bitwiseXOR(F.shiftrightunsigned(mask, 20)).bitwiseXOR(F.shiftrightunsigned(mask, 40)).bitwiseAND(F.lit((1 << GATE_BITS) - 1).cast("bigint"))
    flags = bytearray(1 << GATE_BITS)
    for row in wanted.select(bucket.alias("bucket")).distinct().collect():  # a filter on the bucket would be spelled out in every rank
        if row.bucket is not None:
            flags[row.bucket] = 1
    return bytes(flags)


def replay(games: DataFrame, keys: list[str], movetext: str = "movetext", setup: str = "setup_fen", wanted: DataFrame | None = None) -> DataFrame:
    """(keys, ply, placement, move_number, white_to_move) of all positions of all games; null movetext has none.

    ``wanted`` has the placements that are looked for: others are left out, most of them by their
    occupancy, while the game is replayed, and a game ends where none of them can follow.  They are written to the
    shared folder and their gate is made (see ``gate_for``) when this is called, not when the result is read.
    """
    kinds = dict(games.dtypes)
    wanted = None if wanted is None else staged(wanted.select("placement").distinct(), "wanted")
    gate = None if wanted is None else gate_for(wanted)
    least = None if wanted is None else least_of(wanted)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who: list[int] = []
            found: list[tuple[int, str, int, bool]] = []

            def flush(batch: pa.RecordBatch = batch, who: list[int] = who, found: list = found) -> pa.RecordBatch:
                ply, placement, number, white = zip(*found, strict=True) if found else ((),) * 4
                own = [batch.column(k).take(pa.array(who, pa.int64())) for k in range(len(keys))]
                kind = (pa.int32(), pa.string(), pa.int32(), pa.bool_())
                out = pa.RecordBatch.from_arrays([*own, *(pa.array(v, t) for v, t in zip((ply, placement, number, white), kind, strict=True))], [*keys, "ply", "placement", "move_number", "white_to_move"])
                who.clear(), found.clear()
                return out

            for k, (text, fen) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)):
                for position in positions(text or "", fen or None, gate, least):
                    who.append(k)
                    found.append(position)
                if len(found) >= BATCH_ROWS:
                    yield flush()
            yield flush()

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "ply int, placement string, move_number int, white_to_move boolean"])
    found = games.select(*keys, movetext, setup).mapInArrow(kernel, schema)
    return found if wanted is None else found.join(wanted.select("placement"), "placement", "left_semi").select(*keys, "ply", "placement", "move_number", "white_to_move")


# The flags of a position's faults and their texts.
FLAGS = {1: "no white king", 2: "no black king", 4: "too many kings", 8: "too many white pawns", 16: "too many black pawns", 32: "pawns on a back rank", 64: "too many white pieces", 128: "too many black pieces", 256: "empty", 512: "opposite side in check", 1024: "too many checkers", 2048: "impossible check"}
TURN_FLAGS = 512 | 1024 | 2048


def status(board: list[str], white: bool) -> int:
    """The flags of a position with this side to move; castling rights and en passant don't count."""
    text = "".join(board)
    n = text.count
    flags = 1 * (n("K") == 0) | 2 * (n("k") == 0) | 4 * (n("K") > 1 or n("k") > 1) | 8 * (n("P") > 8) | 16 * (n("p") > 8)
    flags |= 32 * any(c in "Pp" for c in text[:8] + text[56:]) | 64 * (sum(c.isupper() for c in text) > 16) | 128 * (sum(c.islower() for c in text) > 16) | 256 * (n(".") == 64)
    if in_check(board, not white):
        flags |= 512
    if n("K" if white else "k") == 1:
        king = text.index("K" if white else "k")
        checkers = attackers(board, king, not white)
        if len(checkers) > 2:
            flags |= 1024
        elif len(checkers) == 2 and _aligned(king, *checkers):
            flags |= 2048
    return flags


def _aligned(king: int, a: int, b: int) -> bool:
    """Two checkers on one line with the king, which no move can bring about."""
    (kr, kc), (ar, ac), (br, bc) = divmod(king, 8), divmod(a, 8), divmod(b, 8)
    return (ar - kr) * (bc - kc) == (ac - kc) * (br - kr)


def check_positions(df: DataFrame, fen: str) -> DataFrame:
    """``df`` with check: struct(status, fatal, legal, legal_turn, flip_needed, problems); null for a malformed FEN.

    ``fatal`` faults hold for either side to move; ``legal_turn`` is the given side if it is legal,
    else the other if that is.
    """

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for value in frame["_fen"]:
                parts = (value or "").split()
                board = expand(parts[0]) if parts else None
                if board is None:
                    out.append((value, None, None, None, None, None, None))
                    continue
                white = len(parts) < 2 or parts[1] != "b"
                given, other = status(board, white), status(board, not white)
                fatal = bool(given & ~TURN_FLAGS)
                turn = ("w" if white else "b") if not given else ("b" if white else "w") if not other else None
                out.append((value, given, fatal, not given, turn, bool(given) and not fatal and turn is not None, [t for f, t in FLAGS.items() if given & f]))
            yield pd.DataFrame(out, columns=["_fen", "status", "fatal", "legal", "legal_turn", "flip_needed", "problems"])

    schema = "_fen string, status long, fatal boolean, legal boolean, legal_turn string, flip_needed boolean, problems array<string>"
    checked = df.select(F.col(fen).alias("_fen")).distinct().mapInPandas(kernel, schema)
    packed = checked.select("_fen", F.when(F.col("status").isNotNull(), F.struct("status", "fatal", "legal", "legal_turn", "flip_needed", "problems")).alias("check"))
    return df.join(packed, df[fen].eqNullSafe(packed["_fen"]), "left").drop("_fen")
