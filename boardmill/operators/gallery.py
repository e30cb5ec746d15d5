"""What a person or a run decides about diagrams: chosen games, confirmations, look-ups, run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replay

# Headers that a game never gives to an annotation.
RESERVED_HEADERS = ["FEN", "SetUp"]
# How a book's run can end.
STATUSES = ["ok", "skipped", "failed", "cancelled"]
_NONE = "map<string,string>"


def clean_headers(headers: Column, reserved: list[str] | None = None) -> Column:
    """Headers with trimmed names and values, without empty and reserved ones; null is empty."""
    kept = RESERVED_HEADERS if reserved is None else reserved
    pairs = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast(_NONE))), lambda e: F.struct(F.trim(e["key"]).alias("key"), F.trim(e["value"]).alias("value")))
    good = F.filter(pairs, lambda e: (e["key"] != "") & (e["value"] != "") & ~e["key"].isin(kept))
    # of names that trimming makes equal the last stays
    last = F.filter(good, lambda e, k: ~F.exists(F.slice(good, k + 2, F.greatest(F.size(good), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def evidence_text(label: Column, games: Column) -> Column:
    """What confirms a diagram: the game's label if it is the only one, else how many there are."""
    return F.when(games == 1, label).otherwise(F.concat(games.cast("string"), F.lit(" games")))


def provenance_after(filled_from: Column, filled_rule: Column, remaining: Column) -> Column:
    """struct(filled_fields, filled_from, filled_rule): source and rule are cleared with the last field they filled."""
    left = F.size(F.coalesce(remaining, F.array().cast("array<string>"))) > 0
    return F.struct(remaining.alias("filled_fields"), F.when(left, filled_from).otherwise("").alias("filled_from"), F.when(left, filled_rule).otherwise("").alias("filled_rule"))


def choose_game(annotations: DataFrame, choices: DataFrame, key: list[str], overwrite: bool = False) -> DataFrame:
    """Annotations after people chose games, with ``changed``: the names of the fields that a choice changed.

    Annotations have move_number, side_to_move, headers, filled_fields, filled_from, filled_rule and
    chosen_game; choices have the key, game_key, label, headers, verified, move_number and
    side_to_move.  What was filled in gives way; what a person typed stays unless ``overwrite``.
    Only a verified choice says something about move and side.  filled_fields becomes what this
    choice set.
    """
    names = ["game_key", "label", "headers", "verified", "move_number", "side_to_move"]
    c = choices.select(*key, *[F.col(n).alias(f"_{n}") for n in names])
    a = annotations.join(c, key, "left")
    filled = F.coalesce("filled_fields", F.array().cast("array<string>"))
    have, new = F.coalesce("headers", F.create_map().cast(_NONE)), clean_headers(F.col("_headers"))
    verified = F.coalesce("_verified", F.lit(False))

    def taken(name: str, empty: Column) -> Column:
        free = F.lit(overwrite) | F.col(name).isNull() | empty | F.array_contains(filled, name)
        return verified & free & ~F.col(name).eqNullSafe(F.col(f"_{name}"))

    typed = lambda k: (F.coalesce(F.try_element_at(have, k), F.lit("")) != "") & ~F.array_contains(filled, F.concat(F.lit("header:"), k))
    fresh = F.map_filter(new, lambda k, v: (F.lit(overwrite) | ~typed(k)) & ~v.eqNullSafe(F.try_element_at(have, k)))
    a = a.withColumn("_fresh", fresh).withColumn("_move", taken("move_number", F.lit(False))).withColumn("_side", taken("side_to_move", F.lit(False)))
    changed = F.concat(
        F.when(F.col("_move"), F.array(F.lit("move_number"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("_side"), F.array(F.lit("side_to_move"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.array_sort(F.map_keys("_fresh")), lambda k: F.concat(F.lit("header:"), k)),
    )
    chosen = F.col("_game_key").isNotNull()
    a = a.withColumn("changed", F.when(chosen, changed).otherwise(F.array().cast("array<string>")))
    still = F.map_filter(have, lambda k, v: ~F.array_contains(F.map_keys(F.col("_fresh")), k))
    results = {
        "headers": F.map_concat(still, "_fresh"),
        "move_number": F.when(F.col("_move"), F.col("_move_number")).otherwise(F.col("move_number")),
        "side_to_move": F.when(F.col("_side"), F.col("_side_to_move")).otherwise(F.col("side_to_move")),
        "filled_fields": F.col("changed"),
        "filled_from": F.col("_label"),
        "filled_rule": F.lit("human"),
        "chosen_game": F.col("_game_key"),
    }
    return a.withColumns({n: F.when(chosen, v).otherwise(F.col(n)) for n, v in results.items()}).select(*annotations.columns, "changed")


def confirmed(annotations: DataFrame, key: list[str]) -> DataFrame:
    """(key, confirmed_from) of diagrams that the database has confirmed."""
    return annotations.where(F.coalesce("confirmed_from", F.lit("")) != "").select(*key, "confirmed_from")


def match_diagrams(diagrams: DataFrame, games: DataFrame, key: list[str], pair: str = "pair", game_key: str = "game_key") -> DataFrame:
    """(key, games_matched, candidates): games of a diagram's pair of players that reach its placement.

    Diagrams have the pair and placement, games the pair, game_key, movetext and setup_fen.  Only
    games of pairs that are asked for are replayed, and only to placements that are; each game
    counts once, with the first ply that has the placement.
    """
    asked = diagrams.where(F.col(pair).isNotNull())
    some = games.join(asked.select(pair).distinct(), pair, "left_semi")
    reached = replay.replay(some.select(pair, game_key, "movetext", "setup_fen"), [pair, game_key], wanted=asked.select("placement").distinct())
    first = reached.groupBy(pair, game_key, "placement").agg(F.min(F.struct("ply", "move_number", "white_to_move")).alias("_f"))
    joined = asked.select(*key, pair, "placement").join(first, [pair, "placement"])
    candidate = F.struct(F.col(game_key), F.col("_f.move_number").alias("move_number"), F.when(F.col("_f.white_to_move"), "w").otherwise("b").alias("side"))
    return joined.groupBy(*key).agg(F.count_distinct(game_key).cast("int").alias("games_matched"), F.array_sort(F.collect_set(candidate)).alias("candidates"))


def patch_index(index: DataFrame, saved: DataFrame, source: str, key: list[str]) -> DataFrame:
    """An index of one book with the saved diagrams of that book, each once; a saved one replaces its key's row."""
    own = saved.where(F.col("source_pdf") == source).select(*index.columns)
    return index.join(own.select(*key).distinct(), key, "left_anti").unionByName(own.dropDuplicates(key))


def to_run(books: DataFrame, done: DataFrame, book: str = "book") -> DataFrame:
    """Books with the status that a run gives them before it starts: skipped if their output is there, else null."""
    return books.join(done.select(book).distinct().withColumn("_done", F.lit(True)), book, "left").withColumn("status", F.when(F.col("_done"), "skipped")).drop("_done")


def batch_totals(books: DataFrame) -> DataFrame:
    """One row: books processed and failed, diagrams by verdict, seconds to two places."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    seconds = F.round(F.coalesce(F.sum("elapsed_s"), F.lit(0.0)), 2).alias("elapsed_s")
    return books.agg(F.count_if(F.col("status") == "ok").alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"), *map(total, ("accepted", "needs_review", "rejected")), seconds)


def mean_confidence(positions: DataFrame, book: list[str]) -> DataFrame:
    """(book, mean): over all positions, rejected ones too; without a value a position counts as 0."""
    return positions.groupBy(*book).agg(F.avg(F.coalesce("min_confidence", F.lit(0.0))).alias("mean"))


def scan_totals(pages: DataFrame) -> DataFrame:
    """One row: pages scanned, pages with diagrams, diagrams, legal ones, the share of legal ones (null without diagrams)."""
    found = F.coalesce(F.sum("diagrams"), F.lit(0)).cast("long")
    legal = F.coalesce(F.sum("legal"), F.lit(0)).cast("long")
    return pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("diagrams") > 0).alias("with_diagrams"), found.alias("diagrams"), legal.alias("legal"), F.when(found > 0, legal / found).alias("legal_share"))


def checker_score(means: Column) -> Column:
    """How far the mean brightness of 64 squares, in reading order, follows a chequered pattern."""
    sign = lambda k: F.when((F.floor(k / F.lit(8)) + k % 8) % 2 == 0, 1.0).otherwise(-1.0)
    return F.abs(F.aggregate(F.transform(means, lambda m, k: m * sign(k)), F.lit(0.0), lambda acc, v: acc + v)) / F.lit(32.0)
