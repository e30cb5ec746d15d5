"""Rule cascades, scores and buckets as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCEPT_CONFIDENCE = 0.80
UNCERTAIN_SQUARE = 0.90
# What each reason adds to a review priority.
WEIGHTS = {"illegal": 1000.0, "orientation": 500.0, "sources": 250.0, "side": 120.0, "confidence": 100.0, "repair": 30.0, "entropy": 10.0, "rare": 5.0}
# The names of the legality classes, worst first.
LEGALITY = ["sintaxe", "ilegal", "lado-a-jogar", "legal"]
# The ambiguity buckets and the largest count of each.
BUCKETS = [("1", 1), ("2", 2), ("3-5", 5), ("6-20", 20), ("21-100", 100), (">100", None)]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def yes(c: Column) -> Column:
    """A tri-state flag as a predicate: null doesn't condemn."""
    return F.coalesce(c, F.lit(False))


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def first_rule(rules: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first rule whose condition is true; null conditions are false."""
    out = F.when(yes(rules[0][0]), rules[0][1])
    for condition, value in rules[1:]:
        out = out.when(yes(condition), value)
    return out.otherwise(otherwise) if otherwise is not None else out


def legality(syntactic: Column, fatal: Column, legal_as_given: Column) -> Column:
    """The legality class: malformed, illegal, illegal for the side to move, legal."""
    rules = zip((~syntactic, fatal, ~legal_as_given), map(F.lit, LEGALITY), strict=False)
    return first_rule(list(rules), F.lit(LEGALITY[-1]))


def verdict(is_fatal: Column, orientation_ambiguous: Column, side_conflict: Column, is_legal: Column, min_confidence: Column, accept: float = ACCEPT_CONFIDENCE) -> Column:
    """struct(verdict, reason): rejected, review or accepted by the first rule that applies."""
    answer = lambda v, r: F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("reason"))
    return first_rule(
        [
            (is_fatal, answer("rejected", "fatal")),
            (orientation_ambiguous, answer("review", "orientation")),
            (side_conflict, answer("review", "side_conflict")),
            ((~is_legal) & ~yes(is_fatal), answer("review", "turn_flip")),
            (min_confidence < accept, answer("review", "low_confidence")),
        ],
        answer("accepted", ""),
    )


def side_to_move(declared: Column, declared_source: Column, proven: Column) -> Column:
    """struct(side, source, conflicting): what is declared unless legality proves the other; then proof; then white."""
    answer = lambda s, source, bad: F.struct(s.alias("side"), source.alias("source"), F.lit(bad).alias("conflicting"))
    return first_rule(
        [
            (declared.isNotNull() & (proven.isNull() | (proven == declared)), answer(declared, declared_source, False)),
            (declared.isNotNull(), answer(proven, F.lit("legality"), True)),
            (proven.isNotNull(), answer(proven, F.lit("legality"), False)),
        ],
        answer(F.lit("w"), F.lit("default"), False),
    )


def turn_proven(legal_white: Column, legal_black: Column) -> Column:
    """The side whose turn alone is legal, or null."""
    return F.when(legal_white & ~legal_black, "w").when(legal_black & ~legal_white, "b")


def orientation(coordinates: Column, legal_up: Column, legal_flipped: Column, margin: Column, pawn_gap: Column, decisive: float = 0.20, pawn_margin: float = 1.0) -> Column:
    """struct(rule, flipped, ambiguous): coordinates, the only legal way, confidence margin, pawns, then the margin's sign.

    ``coordinates`` is true for a flipped board, false for one that isn't, null without any;
    margin and gap are positive for the board as it stands.
    """
    return F.get(orientation_rules(coordinates, legal_up, legal_flipped, margin, pawn_gap, decisive, pawn_margin), F.lit(0))


def orientation_rules(coordinates: Column, legal_up: Column, legal_flipped: Column, margin: Column, pawn_gap: Column, decisive: float = 0.20, pawn_margin: float = 1.0) -> Column:
    """The answers of all rules that answer, in order."""
    answer = lambda rule, flipped, bad: F.struct(F.lit(rule).alias("rule"), yes(flipped).alias("flipped"), yes(bad).alias("ambiguous"))
    no = F.lit(False)
    return F.array_compact(
        F.array(
            F.when(coordinates.isNotNull(), answer("coordinates", coordinates, no)),
            F.when(legal_up != legal_flipped, answer("legality", legal_flipped, (margin < 0) != legal_flipped)),
            F.when(F.abs(margin) >= decisive, answer("margin", margin < 0, no)),
            F.when(F.abs(pawn_gap) >= pawn_margin, answer("pawns", pawn_gap < 0, no)),
            answer("fallback", margin < 0, F.lit(True)),
        )
    )


def review_priority(illegal: Column, orientation_ambiguous: Column, sources_disagree: Column, side_conflict: Column, turn_flip: Column, min_confidence: Column, repaired: Column, mean_entropy: Column, rare_classes: Column, confirmed: Column, accept: float = ACCEPT_CONFIDENCE) -> Column:
    """struct(priority, reasons).  What the database confirms is only questioned for its side to move.

    Entropy adds to the priority but is no reason.
    """
    free = ~yes(confirmed)
    low = free & yes(min_confidence < accept)
    rare = F.coalesce(rare_classes, F.lit(0))
    parts = [
        (free & yes(illegal), F.lit(WEIGHTS["illegal"]), "illegal"),
        (free & yes(orientation_ambiguous), F.lit(WEIGHTS["orientation"]), "orientation"),
        (free & yes(sources_disagree), F.lit(WEIGHTS["sources"]), "sources"),
        (yes(side_conflict), F.lit(WEIGHTS["side"]), "side_conflict"),
        (yes(turn_flip), F.lit(WEIGHTS["side"]), "turn_flip"),
        (low, F.lit(WEIGHTS["confidence"]) * (F.lit(accept) - min_confidence), "low_confidence"),
        (free & yes(repaired), F.lit(WEIGHTS["repair"]), "repaired"),
        (free & (rare > 0), F.lit(WEIGHTS["rare"]) * rare, "rare_class"),
    ]
    total = F.when(free, F.lit(WEIGHTS["entropy"]) * F.coalesce(mean_entropy, F.lit(0.0))).otherwise(F.lit(0.0))
    for condition, weight, _ in parts:
        total = total + F.when(condition, weight).otherwise(F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for condition, _, name in parts]))
    return F.struct(total.alias("priority"), reasons.alias("reasons"))


def label_route(from_net: Column, second_opinion: Column, from_queue: Column, from_dataset: Column, changed: Column) -> Column:
    """How a label came about: net, second_opinion, queue, dataset, else corrected or accepted."""
    return first_rule([(from_net, F.lit("net")), (second_opinion, F.lit("second_opinion")), (from_queue, F.lit("queue")), (from_dataset, F.lit("dataset")), (changed, F.lit("corrected"))], F.lit("accepted"))


def ambiguity_bucket(count: Column | str) -> Column:
    """The ambiguity bucket of a number of matches."""
    c, out = _col(count), None
    for name, top in BUCKETS[:-1]:
        out = F.when(c <= top, name) if out is None else out.when(c <= top, name)
    return out.otherwise(BUCKETS[-1][0])


def fill_rule(count: Column, caption_confirmed: Column) -> Column:
    """Why a match may fill an annotation: unique, caption, else date."""
    return first_rule([(count == 1, F.lit("unique")), (caption_confirmed, F.lit("caption"))], F.lit("date"))


def inferred_rule(stored: Column, filled: Column, count: Column) -> Column:
    """The stored rule, else what a filled annotation's count says, else ''."""
    return F.coalesce(F.nullif(stored, F.lit("")), F.when(yes(filled), F.when(count <= 1, "unique").otherwise("date")), F.lit(""))


def split_bucket(key: Column | str, salt: str) -> Column:
    """A number from 0 to 99 by the sha256 of salt and key."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), _col(key)), 256), 1, 8), 16, 10).cast("bigint") % 100).cast("int")


def assign_split(key: Column | str, salt: str, val_percent: int = 10, test_percent: int = 10) -> Column:
    """test, val or train: the first buckets are test's, the next val's."""
    if min(val_percent, test_percent) < 0 or val_percent + test_percent > 100:
        raise ValueError("percentages must be 0 or more and sum to 100 at most")
    bucket = split_bucket(key, salt)
    return F.when(bucket < test_percent, "test").when(bucket < test_percent + val_percent, "val").otherwise("train")


def advantage(centipawns: Column, mate: Column) -> Column:
    """An evaluation as a fraction from 0 to 1: mate decides, unknown is a half."""
    return F.when(mate.isNotNull(), F.when(mate > 0, 1.0).otherwise(0.0)).when(centipawns.isNull(), 0.5).otherwise(1 / (1 + F.pow(F.lit(10.0), -centipawns / 400)))


def evaluation_text(centipawns: Column, mate: Column) -> Column:
    """An evaluation as '+1,35' or 'M3'; '' if unknown."""
    pawns = F.translate(F.format_string("%+.2f", centipawns / F.lit(100.0)), ".", ",")
    return F.when(mate.isNotNull(), F.concat(F.when(mate < 0, "-").otherwise(""), F.lit("M"), F.abs(mate).cast("string"))).when(centipawns.isNull(), "").otherwise(pawns)


def board_confidence(probabilities: Column | str, uncertain: float = UNCERTAIN_SQUARE) -> Column:
    """struct(classes, mean_confidence, min_confidence, mean_entropy, uncertain) of 64 x 13 probabilities.

    ``uncertain`` lists the squares under the limit, the least sure first, ties in order.
    """
    rows = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.slice(_col(probabilities), k * 13 + 1, F.lit(13)))
    best = F.transform(rows, lambda r: F.array_max(r))
    classes = F.transform(rows, lambda r: (F.array_position(r, F.array_max(r)) - 1).cast("int"))
    entropy = F.transform(rows, lambda r: F.aggregate(r, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))))
    low = F.filter(F.transform(best, lambda p, k: F.struct(p.alias("p"), k.alias("k"))), lambda s: s["p"] < uncertain)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return F.struct(classes.alias("classes"), (total(best) / 64).alias("mean_confidence"), F.array_min(best).alias("min_confidence"), (total(entropy) / 64).alias("mean_entropy"), F.transform(F.array_sort(low), lambda s: s["k"]).alias("uncertain"))


def runner_up(row: Column) -> Column:
    """struct(class, p) of the second most probable class, the lower number of equals."""
    ranked = F.array_sort(F.transform(row, lambda p, k: F.struct((-p).alias("n"), k.alias("k"), p.alias("p"))))
    second = F.get(ranked, F.lit(1))
    return F.struct(second["k"].alias("class"), second["p"].alias("p"))


def remote_reading(payload: Column | str) -> Column:
    """struct(fen, error) of a remote answer: no_json, no_results and no_fen are different errors."""
    c = _col(payload)
    parsed = F.from_json(c, "struct<results:array<struct<fen:string>>>", {"mode": "PERMISSIVE"})
    whole = F.try_parse_json(c)
    fen = F.get(parsed["results"], F.lit(0))["fen"]
    error = first_rule([(whole.isNull(), F.lit("no_json")), (parsed["results"].isNull() | (F.size(parsed["results"]) == 0), F.lit("no_results")), (fen.isNull() | (F.trim(fen) == ""), F.lit("no_fen"))])
    return F.struct(F.when(error.isNull(), fen).alias("fen"), error.alias("error"))
