"""Labelled data sets: filters, audits, near-duplicate groups, deterministic splits, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.score import assign_split, safe_ratio

SPLIT_SALT = "boardmill-splits-1"
DUPLICATE_SHARE = 0.10
IMBALANCE_RATIO = 20.0
RARE_SHARE = 0.005


def filter_rows(df: DataFrame, *, query: str = "", query_columns: list[str] | None = None, equals: dict[str, str | None] | None = None, flags: list[str] | None = None, classes: list[str] | None = None, classes_column: str = "classes") -> DataFrame:
    """Rows that meet every condition given; a condition left out or empty is none.

    ``query`` is a case-insensitive part of the joined columns, ``flags`` must be true,
    ``classes`` must all occur in the row's classes.
    """
    for column, value in (equals or {}).items():
        if value is not None:
            df = df.where(F.col(column) == value)
    for flag in flags or []:
        df = df.where(F.coalesce(F.col(flag), F.lit(False)))
    if classes:
        df = df.where(F.size(F.array_except(F.array(*map(F.lit, classes)), F.col(classes_column))) == 0)
    if query:
        df = df.where(F.contains(F.lower(F.concat_ws(" ", *(query_columns or []))), F.lit(query.lower())))
    return df


def histogram(df: DataFrame, value: Column, name: str = "value", missing: str | None = None) -> DataFrame:
    """How often each value occurs; null and '' count as ``missing`` if that is given."""
    v = value if missing is None else F.coalesce(F.nullif(value, F.lit("")), F.lit(missing))
    return df.groupBy(v.alias(name)).agg(F.count(F.lit(1)).alias("count"))


def class_histogram(df: DataFrame, squares: Column, name: str = "class") -> DataFrame:
    """How often each square class occurs over all boards; malformed boards (null) count nothing."""
    return df.select(F.explode(squares).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("count"))


def imbalance(counts: DataFrame, expected: list[str], name: str = "value", ratio: float = IMBALANCE_RATIO) -> DataFrame:
    """One row: largest and smallest class, their ratio, whether it exceeds the limit, and absent classes."""
    known = counts.where(F.col(name).isin(expected) & (F.col("count") > 0))
    summary = known.agg(
        F.max_by(name, F.struct(F.col("count"), F.col(name))).alias("largest"),
        F.min_by(name, F.struct(F.col("count"), F.col(name))).alias("smallest"),
        (F.max("count") / F.min("count")).alias("ratio"),
        F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, expected)), F.collect_set(name))), ",").alias("absent"),
    )
    return summary.withColumn("alert", F.coalesce((F.col("ratio") > ratio) | (F.col("absent") != ""), F.lit(True)))


def rare(counts: DataFrame, share: float = RARE_SHARE) -> DataFrame:
    """Classes with less than ``share`` of the total; the histogram is small, so one window serves."""
    total = counts.agg(F.sum("count").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", safe_ratio(F.col("count"), F.col("_total"))).where(F.col("share") < share).drop("_total")


def class_weights(counts: DataFrame, classes: list[str], name: str = "value") -> DataFrame:
    """Balanced weights total / (classes * count); an absent class weighs 0."""
    wanted = counts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, classes))).alias(name))
    total = counts.where(F.col(name).isin(classes)).agg(F.sum("count").alias("_total"))
    joined = wanted.join(counts, name, "left").crossJoin(F.broadcast(total))
    return joined.select(name, safe_ratio(F.col("_total"), F.col("count") * len(classes)).alias("weight"))


def compute_splits(df: DataFrame, key: str, group: list[Column | str], salt: str = SPLIT_SALT, val_percent: int = 10, test_percent: int = 10) -> DataFrame:
    """(key, split): the members of a group share the split of its smallest key.  A group is one row of an
    aggregate joined back, so its size doesn't matter."""
    named = df.select(F.col(key).cast("string").alias(key), *[(F.col(g) if isinstance(g, str) else g).alias(f"_g{k}") for k, g in enumerate(group)])
    names = [f"_g{k}" for k in range(len(group))]
    lead = named.groupBy(*names).agg(F.min(key).alias("_lead"))
    joined = named.join(lead, [named[n].eqNullSafe(lead[n]) for n in names])
    return joined.select(named[key], assign_split("_lead", salt, val_percent, test_percent).alias("split"))


def sticky_splits(df: DataFrame, key: str, group: str, recorded: DataFrame, salt: str = SPLIT_SALT, val_percent: int = 10, test_percent: int = 10) -> DataFrame:
    """(key, split) where recorded keys keep theirs, new ones take the recorded split of their group's
    smallest member, else its bucket; recorded keys that are gone go."""
    rows = df.select(F.col(key).cast("string").alias(key), F.col(group).alias("_group"))
    lead = rows.groupBy("_group").agg(F.min(key).alias("_lead"))
    old = recorded.select(F.col(key).cast("string").alias(key), F.col("split").alias("_own"))
    lead_old = old.select(F.col(key).alias("_lead"), F.col("_own").alias("_lead_split"))
    joined = rows.join(lead, rows["_group"].eqNullSafe(lead["_group"])).drop("_group").join(old, key, "left").join(lead_old, "_lead", "left")
    return joined.select(key, F.coalesce("_own", "_lead_split", assign_split("_lead", salt, val_percent, test_percent)).alias("split"))


def split_leaks(rows: DataFrame, origin: list[str]) -> DataFrame:
    """Origins whose rows stand in more than one split."""
    found = rows.groupBy(*origin).agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count_distinct("split").alias("n_splits"))
    return found.where("n_splits > 1").drop("n_splits")


def split_counts(splits: DataFrame) -> DataFrame:
    """One row: the rows of train, val and test, zeros included."""
    return splits.agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")])


def audit(labels: DataFrame, files: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, issue) of every issue of every label: the rules that hold, and missing_file where no file matches."""
    joined = labels.join(files.select(F.col(key).alias("_file")).distinct(), F.col(key) == F.col("_file"), "left")
    checks = [F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    issues = F.array_compact(F.array(*checks, F.when(F.col("_file").isNull(), F.lit("missing_file"))))
    return joined.select(F.col(key), F.explode(issues).alias("issue"))


def orphans(files: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Files that no label names."""
    return files.join(labels.select(key).distinct(), key, "left_anti")


def violations(report: DataFrame, duplicate_share: float = DUPLICATE_SHARE) -> Column:
    """For a one-row report (fatal, syntax, missing, duplicates, valid): the declared limits it breaks."""
    share = safe_ratio(report["duplicates"], report["valid"])
    rules = [("fatal", report["fatal"] > 0), ("syntax", report["syntax"] > 0), ("missing", report["missing"] > 0), ("duplicates", share > duplicate_share)]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def dedupe_summary(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """Per split the rows before, removed by keeping each group's first, and after."""
    firsts = rows.groupBy(*group).agg(F.min(key).alias("_first"))
    marked = rows.join(firsts, [rows[g].eqNullSafe(firsts[g]) for g in group]).select(rows["split"], (rows[key] != F.col("_first")).alias("_removed"))
    return marked.groupBy("split").agg(F.count(F.lit(1)).alias("before"), F.count_if("_removed").alias("removed"), F.count_if(~F.col("_removed")).alias("after"))


def training_pages(labels: DataFrame, splits: DataFrame, key: str, page: list[str]) -> DataFrame:
    """How many training samples each page holds."""
    return labels.join(splits.where("split = 'train'").select(key), key).groupBy(*page).agg(F.count(F.lit(1)).alias("samples"))


def shuffle_in_windows(df: DataFrame, group: str, seed: int, window: int = 64) -> DataFrame:
    """An order: groups by a seeded hash, then rows of each run of ``window`` groups by another.

    Ranges of the hash stand for runs of groups, so no global sort on one task is needed.
    """
    groups = df.select(group).distinct()
    runs = max(1, -(-groups.count() // window))
    position = F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(runs))
    return df.withColumn("run", position).orderBy("run", F.xxhash64(F.struct(*df.columns), F.lit(seed)))
