"""Groups of near duplicates: in key order a row joins the first leader near enough or becomes one.

The leaders are those that a sequential pass would find, but they come from rounds of joins.  Rows
with equal bits act alike, so the first of them stands for all.  Rows near each other share a band
of bits.  While bands are crowded, a round compares each row only with the first undecided row of
each of its bands: a row that is first in all its bands is a leader, and what is near a new leader
isn't one.  When the pairs within bands are no more than a few for each row they are written as
edges, and rounds on them decide the rest: a row without an undecided neighbour before it is a
leader.  No step gathers a block, and no step makes pairs that weren't counted before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import band_hashes, hamming, word_count
from ..sources.staging import forget, stage

DUPLICATE_DISTANCE = 3
#: Pairs for each undecided row that are made at once.
PAIRS_PER_ROW = 32


class _Stages:
    """Staged tables under names; a new table of a name replaces the one before."""

    def __init__(self) -> None:
        self.paths: dict[str, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        old = self.paths.get(name)
        df, self.paths[name] = stage(df, name)
        if old:
            forget(df.sparkSession, old)
        return df


def _pairs(banded: DataFrame) -> int:
    """Pairs of rows within bands, counted, not made."""
    return int(banded.groupBy("_block", "_band").count().agg(F.coalesce(F.sum(F.expr("cast(count as decimal(38,0)) * (count - 1) / 2")), F.lit(0))).first()[0])


def _near(one: DataFrame, two: DataFrame, distance: int) -> DataFrame:
    """(a, b) of rows (a, _a) and (b, _b) in a common band that are near, a before b."""
    joined = one.join(two, ["_block", "_band"]).where("a < b")
    return joined.where(hamming(F.col("_a"), F.col("_b")) <= distance).select("a", "b").distinct()


def near_duplicate_groups(df: DataFrame, key: str, block: str, words: str, distance: int = DUPLICATE_DISTANCE) -> DataFrame:
    """(leader, key) of groups of two or more: in a block (equal placement) each row, in key order, joins the first
    leader within ``distance`` bits or becomes one.

    Keys are unique; rows with a null block, key or words belong to no group.
    """
    held = _Stages()
    rows = df.select(F.col(key).alias("_key"), F.col(block).alias("_block"), F.col(words).alias("_words")).dropna()
    alike = held.put(rows.groupBy("_block", "_words").agg(F.min("_key").alias("a"), F.count(F.lit(1)).alias("_n")), "alike")
    count = word_count(alike, "_words")
    banded = held.put(alike.select("a", "_block", F.col("_words").alias("_a"), F.explode(F.array_distinct(band_hashes(F.col("_words"), count, distance + 1))).alias("_band")), "banded")
    leaders = _leaders(banded, distance, held)
    # a row that isn't a leader joins the first leader near it
    led = banded.join(leaders, "a", "left_semi")
    rest = banded.join(leaders, "a", "left_anti").withColumnsRenamed({"a": "b", "_a": "_b"})
    joins = _near(led, rest, distance).groupBy("b").agg(F.min("a").alias("leader"))
    first = alike.select("a", "_block", "_words", "_n").join(joins.withColumnRenamed("b", "a"), "a", "left").withColumn("leader", F.coalesce("leader", "a"))
    sized = first.groupBy("leader").agg(F.sum("_n").alias("_size")).where("_size > 1").select("leader")
    kept = first.join(sized, "leader").select("leader", "_block", "_words")
    return rows.join(kept, ["_block", "_words"]).select("leader", F.col("_key").alias(key))


def _leaders(banded: DataFrame, distance: int, held: _Stages) -> DataFrame:
    """(a) of the leaders among rows (a, _block, _a, _band), one for each band of a row."""
    leaders = held.put(banded.select("a").limit(0), "leaders")
    open_rows = banded
    while True:
        rows = open_rows.select("a").distinct().count()
        if not rows:
            return leaders
        if _pairs(open_rows) <= PAIRS_PER_ROW * rows:
            break
        first = open_rows.groupBy("_block", "_band").agg(F.min(F.struct("a", "_a")).alias("_f"))
        met = open_rows.join(first, ["_block", "_band"])
        new = held.put(met.groupBy("a").agg(F.min(F.col("a") == F.col("_f.a")).alias("_first")).where("_first").select("a"), "new")
        heads = first.select("_block", "_band", F.col("_f.a").alias("a"), F.col("_f._a").alias("_a")).join(new, "a", "left_semi")
        gone = _near(heads, open_rows.withColumnsRenamed({"a": "b", "_a": "_b"}), distance).select(F.col("b").alias("a")).union(new).distinct()
        leaders = held.put(leaders.union(new), "leaders")
        open_rows = held.put(open_rows.join(gone, "a", "left_anti"), "open")
    edges = held.put(_near(open_rows, open_rows.withColumnsRenamed({"a": "b", "_a": "_b"}), distance), "edges")
    nodes = held.put(open_rows.select("a").distinct(), "nodes")
    while not edges.isEmpty():
        new = held.put(nodes.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti"), "new")
        gone = held.put(edges.join(new, "a", "left_semi").select(F.col("b").alias("a")).union(new).distinct(), "gone")
        leaders = held.put(leaders.union(new), "leaders")
        nodes = held.put(nodes.join(gone, "a", "left_anti"), "nodes")
        edges = held.put(edges.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"), "edges")
    return held.put(leaders.union(nodes), "leaders")


def duplicates_touching(df: DataFrame, wanted: DataFrame, key: str, block: str, words: str, distance: int = DUPLICATE_DISTANCE) -> DataFrame:
    """(leader, key) of near-duplicate groups that hold a wanted key; blocks without a wanted key aren't compared."""
    blocks = df.join(wanted.select(key).distinct(), key, "left_semi").select(block).distinct()
    groups = near_duplicate_groups(df.join(blocks, block, "left_semi"), key, block, words, distance)
    return groups.join(groups.join(wanted.select(key).distinct(), key, "left_semi").select("leader").distinct(), "leader", "left_semi")
