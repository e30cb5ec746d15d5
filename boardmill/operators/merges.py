"""Merging found values into human annotations, which always win."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import fill_rule, first_rule

AUTO_FILL_GAMES = 5
NEVER_FILLED = ["FEN", "SetUp"]
# The headers that are kept of a game.
KEPT_HEADERS = ["White", "Black", "Event", "Site", "Date", "Round", "Result", "ECO"]


def kept_headers(headers: Column) -> Column:
    """The non-empty headers that are kept."""
    return F.map_filter(headers, lambda k, v: k.isin(KEPT_HEADERS) & (v != ""))


def fill_empty(annotations: DataFrame, matches: DataFrame, key: list[str], most_games: int = AUTO_FILL_GAMES) -> DataFrame:
    """Annotations after matches (key, count, caption_confirmed, headers, source) were applied, with column ``outcome``.

    A match always confirms.  A human choice is respected; a match of more than ``most_games``
    games that no caption confirms stays ambiguous; otherwise the match fills headers that are
    empty, never FEN or SetUp, and their names join filled_fields.
    Annotations have headers (map), filled_fields (array), filled_from, filled_rule,
    confirmed_from.
    """
    m = matches.select(*key, F.col("count").alias("_count"), F.coalesce("caption_confirmed", F.lit(False)).alias("_caption"), F.col("headers").alias("_headers"), F.col("source").alias("_source"))
    a = annotations.join(m, key, "left")
    none = F.create_map().cast("map<string,string>")
    have = F.coalesce("headers", none)
    outcome = first_rule(
        [
            (F.col("_count").isNull(), F.lit("unmatched")),
            (F.col("filled_rule") == "human", F.lit("respected")),
            ((F.col("_count") > most_games) & ~F.col("_caption"), F.lit("ambiguous")),
        ],
        F.lit("applied"),
    )
    a = a.withColumn("outcome", outcome)
    fresh = F.map_filter(F.coalesce("_headers", none), lambda k, v: (v != "") & ~k.isin(NEVER_FILLED) & (F.coalesce(F.try_element_at(have, k), F.lit("")) == ""))
    a = a.withColumn("_fresh", F.when(F.col("outcome") == "applied", fresh).otherwise(none))
    filled = F.size(F.map_keys("_fresh")) > 0
    a = a.withColumn("outcome", F.when((F.col("outcome") == "applied") & ~filled, "unchanged").otherwise(F.col("outcome")))
    still = F.map_filter(have, lambda k, v: ~F.array_contains(F.map_keys(F.col("_fresh")), k))
    a = a.withColumn("headers", F.map_concat(still, "_fresh"))
    a = a.withColumn("filled_fields", F.array_sort(F.array_union(F.coalesce("filled_fields", F.array().cast("array<string>")), F.map_keys("_fresh"))))
    a = a.withColumn("filled_from", F.when(filled, F.col("_source")).otherwise(F.col("filled_from")))
    a = a.withColumn("filled_rule", F.when(filled, fill_rule(F.col("_count"), F.col("_caption"))).otherwise(F.col("filled_rule")))
    a = a.withColumn("confirmed_from", F.coalesce("_source", "confirmed_from"))
    return a.drop("_count", "_caption", "_headers", "_source", "_fresh")


def human_headers(headers: Column, filled_fields: Column, filled_rule: Column) -> Column:
    """Headers that a person typed: all under a human rule, else those that weren't filled in."""
    return F.when(filled_rule == "human", headers).otherwise(F.map_filter(headers, lambda k, v: ~F.array_contains(F.coalesce(filled_fields, F.array().cast("array<string>")), k)))


def restore_human(annotations: DataFrame, records: DataFrame, key: list[str]) -> DataFrame:
    """Annotations with the typed headers of ``records`` put over theirs and taken out of filled_fields."""
    r = annotations.join(records.select(*key, F.col("headers").alias("_typed")), key, "left")
    typed = F.coalesce("_typed", F.create_map().cast("map<string,string>"))
    rest = F.map_filter("headers", lambda k, v: ~F.map_contains_key(typed, k))
    return r.withColumn("headers", F.map_concat(rest, typed)).withColumn("filled_fields", F.array_except("filled_fields", F.map_keys(typed))).drop("_typed")


def revert_headers(headers: Column, values: dict[str, str]) -> Column:
    """Headers without those that have exactly these values."""
    return F.map_filter(headers, lambda k, v: ~F.concat(k, F.lit("\0"), v).isin([f"{a}\0{b}" for a, b in values.items()]))


def apply_headers(headers: Column, values: dict[str, str]) -> Column:
    """Headers with these values put over theirs."""
    new = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.map_concat(F.map_filter(headers, lambda k, v: ~k.isin(list(values))), new)


def changed_only(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """The names of the fields that differ, nulls being equal."""
    return F.array_compact(F.array(*[F.when(~before[k].eqNullSafe(after[k]), F.lit(k)) for k in after]))


def conflicts(headers: Column, filled_fields: Column, chosen: Column) -> Column:
    """Typed headers that a chosen game would change."""
    typed = F.map_filter(headers, lambda k, v: (v != "") & ~F.array_contains(filled_fields, k))
    return F.array_sort(F.map_keys(F.map_filter(typed, lambda k, v: F.coalesce(F.try_element_at(chosen, k) != v, F.lit(False)))))


def neighbour_keys(df: DataFrame, book: list[str], order: list[str], keys: str, radius: int = 3) -> DataFrame:
    """Rows with neighbours: the sorted different keys of the rows up to ``radius`` before and after, not its own."""
    w = Window.partitionBy(*book).orderBy(*order)
    around = F.concat(F.flatten(F.collect_list(keys).over(w.rowsBetween(-radius, -1))), F.flatten(F.collect_list(keys).over(w.rowsBetween(1, radius))))
    return df.withColumn("neighbours", F.array_sort(F.array_distinct(around)))


def neighbours_with_key(df: DataFrame, book: list[str], order: list[str], key: str, radius: int = 3) -> DataFrame:
    """Rows with same_key_near: how many rows up to ``radius`` away, itself left out, have the same key."""
    w = Window.partitionBy(*book).orderBy(*order)
    near = sum(((F.coalesce((F.lag(key, d).over(w) == F.col(key)).cast("int"), F.lit(0)) + F.coalesce((F.lead(key, d).over(w) == F.col(key)).cast("int"), F.lit(0))) for d in range(1, radius + 1)), F.lit(0))
    return df.withColumn("same_key_near", near)


def recover_provenance(annotations: DataFrame, matches: DataFrame, key: list[str]) -> DataFrame:
    """Annotations with filled_fields for those that a game filled before that column was kept.

    They have filled_from and no filled_fields.  The fields that equal what their match says come from it;
    one that a person has changed since differs and stays theirs.  Both sides have move_number,
    side_to_move and headers, the matches one row for each key.
    """
    m = matches.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_m_{c}") for c in ("move_number", "side_to_move", "headers")])
    rows = annotations.join(m, key, "left")
    filled = F.coalesce("filled_fields", F.array().cast("array<string>"))
    legacy = F.col("_hit").isNotNull() & (F.coalesce("filled_from", F.lit("")) != "") & (F.size(filled) == 0)
    alike = [F.when(F.col(c).eqNullSafe(F.col(f"_m_{c}")), F.lit(c)) for c in ("move_number", "side_to_move")]
    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    same = F.map_filter(F.coalesce("_m_headers", F.create_map().cast("map<string,string>")), lambda k, v: (v != "") & F.coalesce(F.try_element_at(own, k) == v, F.lit(False)))
    names = F.concat(F.array_compact(F.array(*alike)), F.transform(F.array_sort(F.map_keys(same)), lambda k: F.concat(F.lit("header:"), k)))
    return rows.withColumn("filled_fields", F.when(legacy, names).otherwise(F.col("filled_fields"))).select(*annotations.columns)
