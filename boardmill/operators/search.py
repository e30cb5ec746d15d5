"""Exact search of positions in a table of occurrences: true counts, bounded candidate lists, ask ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import ambiguity_bucket

HITS_KEPT = 32
GAMES_PER_PAIR = 40


def within(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among ``keys``.  A semi-join; Spark broadcasts the keys if their size allows."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def capped(df: DataFrame, key: list[str], order: list[Column | str], most: int = HITS_KEPT) -> DataFrame:
    """The first ``most`` rows of each key in a total order.

    Ranking before collecting: Spark keeps ``most`` rows of a key in each task before the shuffle
    (WindowGroupLimit), so a key with many rows doesn't travel whole.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def inverted_search(positions: DataFrame, targets: DataFrame, key: list[str], order: list[str], most: int = HITS_KEPT) -> DataFrame:
    """For every target that occurs: key, count of all occurrences and the first ``most`` as an ordered array.

    The count never comes from the list.  Every counted key has a list; the outer join lets Spark leave the lists
    away, with their sorts, where only counts are asked for.  Occurrences are counted before they meet the targets:
    a counted key is one row to sort; Spark puts targets that it broadcasts below the count.
    """
    counts = within(positions.groupBy(*key).agg(F.count(F.lit(1)).alias("count")), targets, key)
    kept = capped(within(positions, targets, key), key, order, most).groupBy(*key)
    return counts.join(kept.agg(F.array_sort(F.collect_list(F.struct(*order))).alias("hits")), key, "left")


def merge_partials(parts: DataFrame, key: list[str], most: int = HITS_KEPT) -> DataFrame:
    """One answer of several (count, hits) answers per key: counts add up, lists merge, sort and are cut last."""
    hits = F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, most)
    return parts.groupBy(*key).agg(F.sum("count").alias("count"), hits.alias("hits"))


def rerank(hits: Column, confirmed) -> Column:
    """struct(hits, sure): those that ``confirmed`` accepts first, both parts in their order; sure if exactly one is."""
    first, rest = F.filter(hits, confirmed), F.filter(hits, lambda h: ~confirmed(h))
    return F.struct(F.concat(first, rest).alias("hits"), (F.size(first) == 1).alias("sure"))


def first_position(positions: DataFrame, game: list[str], order: list[str]) -> DataFrame:
    """Each game's first row."""
    rest = [c for c in positions.columns if c not in game]
    return positions.groupBy(*game).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*game, "_r.*")


def pairs_capped(games: DataFrame, wanted: DataFrame, pair: list[str], order: list[str], most: int = GAMES_PER_PAIR) -> DataFrame:
    """Games of the wanted pairs, the first ``most`` of each pair over all files."""
    return capped(within(games, wanted, pair), pair, order, most)


def fair_share(df: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    """``limit`` rows shared fairly: limit // groups of each group, one at least, then leftovers in group order.

    Only the first ``limit`` rows of a group take part, and the ranking of those few is global.
    """
    few = df.withColumn("_in_group", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_in_group") <= limit)
    quota = few.select(*group).distinct().agg(F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.count(F.lit(1)), F.lit(1)))).alias("_quota"))
    tiered = few.crossJoin(F.broadcast(quota)).withColumn("_late", F.col("_in_group") > F.col("_quota"))  # quota is one row
    return tiered.orderBy("_late", *group, "_in_group").limit(limit).drop("_late", "_quota", "_in_group")


def match_positions(diagrams: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """Diagrams with their answer: count, candidates and the first candidate."""
    return diagrams.join(index, key).withColumn("best", F.get("hits", F.lit(0)))


def candidates_by_game(matches: DataFrame, key: list[str], game: list[str], order: list[str], most: int = HITS_KEPT) -> DataFrame:
    """Per key the number of different games and one candidate of each, the first in order."""
    one = matches.withColumn("_n", F.row_number().over(Window.partitionBy(*key, *game).orderBy(*order))).where("_n = 1")
    counts = one.groupBy(*key).agg(F.count(F.lit(1)).alias("games_matched"))
    kept = capped(one, key, order, most).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("hits"))
    return counts.join(kept, key)


def never_asked(targets: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """Targets that the ledger has no row for, found or not."""
    return targets.select(*key).distinct().join(ledger, key, "left_anti")


def record_answers(ledger: DataFrame, asked: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """The ledger after a complete scan: every asked key has a row, with count 0 and no hits if it wasn't found."""
    empty = F.array().cast(found.schema["hits"].dataType)
    fresh = asked.select(*key).distinct().join(found, key, "left").select(*key, F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("hits", empty).alias("hits"))
    return ledger.join(fresh, key, "left_anti").select(*key, "count", "hits").unionByName(fresh)


def answered(targets: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """Ledger rows of the targets that were found."""
    return within(ledger.where(F.col("count") > 0), targets, key)


def valid_ledger(ledger: DataFrame, stored_fingerprint: str, fingerprint: str) -> DataFrame:
    """The ledger if it was filled from the same files, else no row."""
    return ledger if stored_fingerprint == fingerprint else ledger.limit(0)


def ambiguity_census(counts: DataFrame, group: str, count: str = "count") -> DataFrame:
    """Diagrams by group and ambiguity bucket, with a total for all groups (group null)."""
    rows = counts.where(F.col(count) > 0).withColumn("bucket", ambiguity_bucket(count))
    return rows.groupingSets([[group, "bucket"], ["bucket"]], group, "bucket").agg(F.count(F.lit(1)).alias("diagrams"), F.sum(count).alias("games"))
