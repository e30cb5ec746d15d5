"""Review queues, duplicate pointers and gated exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import ACCEPT_CONFIDENCE, safe_ratio


def duplicate_pointers(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows with duplicate_of: the order columns of the key's first row, null on that row itself.

    The first of a key is an aggregate joined back, so a key with very many rows isn't gathered.
    """
    first = df.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    joined = df.join(first.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(key)], "_first"), [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(key)])
    return joined.withColumn("duplicate_of", F.when(F.col("_first") != F.struct(*order), F.col("_first"))).drop("_first", *[f"_k{n}" for n in range(len(key))])


def queue(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Items with a reason, by falling priority, then page and diagram; cut after sorting."""
    ordered = items.where(F.size("reasons") > 0).orderBy(F.desc("priority"), "page", "diagram")
    return ordered if limit is None else ordered.limit(limit)


def merge_queues(existing: DataFrame, fresh: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Fresh items with the status they had; existing items of pages that weren't visited stay."""
    key = ["page", "diagram"]
    kept = fresh.join(existing.select(*key, F.col("status").alias("_status")), key, "left")
    kept = kept.withColumn("status", F.coalesce("_status", "status")).select(*fresh.columns)
    visited = (fresh if pages is None else pages).select("page").distinct()
    return kept.unionByName(existing.select(*fresh.columns).join(visited, "page", "left_anti"))


def error_rate(items: DataFrame, confidence: Column, reasons: Column, accept: float = ACCEPT_CONFIDENCE, prefixes: tuple[str, ...] = ("illegal", "sources", "side")) -> DataFrame:
    """One row: the share of items below the gate or with a reason that starts like one of the prefixes."""
    bad = F.coalesce(confidence < accept, F.lit(False)) | F.exists(reasons, lambda r: r.rlike("^(" + "|".join(prefixes) + ")"))
    return items.agg(safe_ratio(F.count_if(bad), F.count(F.lit(1))).alias("error_rate"))


def acceptance(items: DataFrame, n: int, seed: int, confidence: Column, reasons: Column) -> DataFrame:
    """(sample, error_rate) of the n most urgent, of n drawn by a seeded hash, and of all items."""
    top = items.orderBy(F.desc("priority"), "page", "diagram").limit(n)
    drawn = items.orderBy(F.xxhash64("page", "diagram", F.lit(seed)), "page", "diagram").limit(n)
    parts = [error_rate(df, confidence, reasons).select(F.lit(name).alias("sample"), "error_rate") for name, df in (("top", top), ("drawn", drawn), ("all", items))]
    return parts[0].union(parts[1]).union(parts[2])


def pgn_text(df: DataFrame, headers: list[tuple[str, Column]], typed: Column | None = None, comment: Column | None = None) -> DataFrame:
    """Rows with pgn: header lines in order, typed headers last and winning, a comment, and the result mark."""
    named = F.create_map(*[x for k, v in headers for x in (F.lit(k), v.cast("string"))])
    typed = typed if typed is not None else F.create_map().cast("map<string,string>")
    own = F.map_concat(F.map_filter(named, lambda k, v: v.isNotNull() & ~F.map_contains_key(typed, k)), typed)
    keys = F.array_distinct(F.concat(F.array(*[F.lit(k) for k, _ in headers]), F.array_sort(F.map_keys(typed))))
    quote = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    lines = F.transform(F.filter(keys, lambda k: F.map_contains_key(own, k)), lambda k: F.concat(F.lit("["), k, F.lit(' "'), quote(F.element_at(own, k)), F.lit('"]')))
    note = F.coalesce(F.concat(F.lit("{ "), F.nullif(comment, F.lit("")), F.lit(" } ")), F.lit("")) if comment is not None else F.lit("")
    return df.withColumn("pgn", F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), note, F.lit("*\n")))


def gated(df: DataFrame, verdict: Column, keep_duplicates: bool = True) -> DataFrame:
    """Rows with verdict and reason of the gate; repeats may be left out.  To be written partitioned by verdict."""
    rows = df if keep_duplicates else df.where("duplicate_of is null")
    return rows.withColumn("_v", verdict).withColumn("verdict", F.col("_v.verdict")).withColumn("reason", F.col("_v.reason")).drop("_v")


def newest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
