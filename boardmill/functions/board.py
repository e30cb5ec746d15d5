"""Column functions over board placements: 64 squares in reading order (a8 first)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The piece classes in the order of their numbers.
CLASSES = ["empty", "P", "N", "B", "R", "Q", "K", "p", "n", "b", "r", "q", "k"]
LETTERS = [".", *CLASSES[1:]]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def placement(fen: Column | str) -> Column:
    """The first field of a FEN."""
    return F.split_part(F.trim(_col(fen)), F.lit(" "), F.lit(1))


def fen_turn(fen: Column | str) -> Column:
    """'w' or 'b' by the second field of a FEN, else ''."""
    turn = F.split_part(F.trim(_col(fen)), F.lit(" "), F.lit(2))
    return F.when(turn.isin("w", "b"), turn).otherwise("")


def resolved_side(side: Column | str, fen: Column | str) -> Column:
    """The stored side if it is 'w' or 'b', else the FEN's, else ''."""
    stored = _col(side)
    return F.when(stored.isin("w", "b"), stored).otherwise(fen_turn(fen))


def with_turn(fen: Column | str, turn: Column | str) -> Column:
    """A FEN whose second field is ``turn``."""
    parts = F.split(F.trim(_col(fen)), " ")
    rest = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), " ")).otherwise("- - 0 1")
    return F.concat_ws(" ", parts[0], _col(turn), rest)


def square_text(fen: Column | str) -> Column:
    """A placement's 64 squares as one string, '.' for empty; null if it is malformed."""
    c = placement(fen)
    for n in range(8, 0, -1):
        c = F.replace(c, F.lit(str(n)), F.lit("." * n))
    whole = c.rlike(r"^([.PNBRQKpnbrqk]{8}/){7}[.PNBRQKpnbrqk]{8}$")
    return F.when(whole, F.replace(c, F.lit("/"), F.lit("")))


def is_syntactic(fen: Column | str) -> Column:
    """Whether a FEN's placement has eight ranks of eight squares and known pieces."""
    digits = placement(fen).rlike(r"^[1-8PNBRQKpnbrqk/]+$") & ~placement(fen).rlike(r"\d\d")
    return F.coalesce(digits & square_text(fen).isNotNull(), F.lit(False))


def squares(fen: Column | str) -> Column:
    """A placement's 64 squares as an array."""
    return F.filter(F.split(square_text(fen), ""), lambda s: s != "")


def labels_of(fen: Column | str) -> Column:
    """A placement's 64 class numbers."""
    return F.transform(squares(fen), lambda s: (F.array_position(F.array(*map(F.lit, LETTERS)), s) - 1).cast("int"))


def fen_of_squares(text: Column | str) -> Column:
    """The placement of 64 squares in one string."""
    ranks = F.concat_ws("/", *[F.substring(_col(text), 8 * r + 1, 8) for r in range(8)])
    for n in range(8, 0, -1):
        ranks = F.replace(ranks, F.lit("." * n), F.lit(str(n)))
    return F.when(_col(text).isNotNull(), ranks)


def fen_of_labels(labels: Column | str) -> Column:
    """The placement of 64 class numbers."""
    letters = F.array(*map(F.lit, LETTERS))
    return fen_of_squares(F.array_join(F.transform(_col(labels), lambda k: F.get(letters, k)), ""))


def square_name(index: Column | str) -> Column:
    """The name of a reading index: 0 is a8, 63 is h1."""
    c = _col(index).cast("int")
    return F.concat(F.substr(F.lit("abcdefgh"), c % 8 + 1, F.lit(1)), (F.lit(8) - F.floor(c / F.lit(8))).cast("string"))


def board_square(index: Column | str) -> Column:
    """A reading index as a bit number (a1 is 0); its own inverse."""
    c = _col(index).cast("int")
    return ((F.lit(7) - F.floor(c / F.lit(8))) * 8 + c % 8).cast("int")


def occupancy(fen: Column | str) -> Column:
    """The 64-bit mask of occupied squares, bit 0 for a1; equal placements have equal masks."""
    text = square_text(fen)
    ranks = [F.substring(text, 8 * r + 1, 8) for r in range(8)]
    total = None
    for r, rank in enumerate(ranks):
        bits = F.reverse(F.translate(rank, ".PNBRQKpnbrqk", "0111111111111"))
        part = F.shiftleft(F.conv(bits, 2, 10).cast("bigint"), 8 * (7 - r))
        total = part if total is None else total.bitwiseOR(part)
    return total


def count_of(text: Column, letters: str) -> Column:
    """How many squares of a square text hold one of these letters."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


def structure_problems(fen: Column | str) -> Column:
    """The faults of a placement that no side to move can mend, as an array of names.

    A malformed placement has the one fault 'syntax'.
    """
    text = square_text(fen)
    edge = F.concat(F.substring(text, 1, 8), F.substring(text, 57, 8))
    rules = [
        ("empty", count_of(text, ".") == 64),
        ("no_white_king", count_of(text, "K") == 0),
        ("no_black_king", count_of(text, "k") == 0),
        ("too_many_kings", (count_of(text, "K") > 1) | (count_of(text, "k") > 1)),
        ("too_many_white_pawns", count_of(text, "P") > 8),
        ("too_many_black_pawns", count_of(text, "p") > 8),
        ("too_many_white_pieces", count_of(text, "PNBRQK") > 16),
        ("too_many_black_pieces", count_of(text, "pnbrqk") > 16),
        ("pawns_on_back_rank", count_of(edge, "Pp") > 0),
    ]
    return F.when(text.isNull(), F.array(F.lit("syntax"))).otherwise(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules])))


def castling_rights(fen: Column | str) -> Column:
    """KQkq as far as kings and rooks stand on their home squares, '-' if none do."""
    text = square_text(fen)
    at = lambda n: F.substring(text, n + 1, 1)
    rules = [("K", (at(60) == "K") & (at(63) == "R")), ("Q", (at(60) == "K") & (at(56) == "R")), ("k", (at(4) == "k") & (at(7) == "r")), ("q", (at(4) == "k") & (at(0) == "r"))]
    rights = F.concat(*[F.when(rule, name).otherwise("") for name, rule in rules])
    return F.when(rights == "", "-").otherwise(rights)


def full_fen(fen: Column | str, turn: Column | str, move: Column | None = None) -> Column:
    """Placement, side, castling rights by home squares, no en passant, clocks."""
    number = F.greatest(F.coalesce(move, F.lit(1)), F.lit(1)) if move is not None else F.lit(1)
    return F.concat_ws(" ", placement(fen), _col(turn), castling_rights(fen), F.lit("-"), F.lit("0"), number.cast("string"))


def disputed_squares(a: Column | str, b: Column | str) -> Column:
    """The reading indices at which two placements differ."""
    pairs = F.zip_with(squares(a), squares(b), lambda x, y: x != y)
    return F.filter(F.transform(pairs, lambda d, k: F.when(d, k)), lambda k: k.isNotNull())


def pawn_direction(fen: Column | str) -> Column:
    """Mean rank of black pawns less that of white pawns; null without both.

    Positive for a board the right way up.
    """
    text = square_text(fen)

    def mean(letter: str) -> Column:
        rows = [count_of(F.substring(text, 8 * r + 1, 8), letter) for r in range(8)]
        n = sum(rows[1:], rows[0])
        return sum((rows[r] * (8 - r) for r in range(1, 8)), rows[0] * 8) / F.nullif(n, F.lit(0))

    return mean("p") - mean("P")


def analysis_url(fen: Column | str) -> Column:
    """The link that opens a FEN on a public analysis board."""
    return F.concat(F.lit("https://lichess.org/analysis/"), F.replace(_col(fen), F.lit(" "), F.lit("_")))
