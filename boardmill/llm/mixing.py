"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks.  With weight w, its part of the sum of all weights, its
j-th block may run from slot floor((j - 1) / w) on and must run before slot ceil(j / w).  Of the
blocks released the one with the earliest deadline runs in each slot.  After any number of slots
every source has had its weight's part of them to within less than one block.  Weights are taken
as the exact rationals that their doubles stand for, so the bound holds for any number of
sources and slots.  The schedule is made once, by one task that keeps a state per source.

With a ``quantum`` the weights are rounded to whole shares of it, one at least each, and the
schedule of those shares repeats after ``quantum`` slots: the bound then holds for the shares,
not for the weights.  The SQL of ``op8_source_mixing`` describes that schedule.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

QUANTUM = 1_000
#: Slots of a period whose shares are next to the weights: a source is one block and 1 / FINE_QUANTUM of the slots from its weight at most.
FINE_QUANTUM = 1 << 14
BLOCK_ROWS = 16
#: Rows of a source whose places are counted together, on the average.
RANK_ROWS = 2_000
#: Rows of a batch of the schedule.
BATCH_ROWS = 1 << 16
#: Sources without a weight that an error names at most.
NAMED_MISSING = 20


def whole_shares(weights: dict[str | None, float], quantum: int = QUANTUM) -> dict[str | None, int]:
    """Shares of ``quantum`` slots in proportion to the weights, by largest remainder, one at least each."""
    if len(weights) > quantum:
        raise ValueError(f"{len(weights)} sources don't fit {quantum} slots")
    if not weights:
        return {}
    names = sorted(weights, key=lambda s: (s is None, s or ""))
    total, spare = math.fsum(weights.values()), quantum - len(names)
    exact = {s: spare * weights[s] / total for s in names}
    shares = {s: 1 + math.floor(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: (-round(exact[s] - math.floor(exact[s]), 9), s is None, s or ""))[: quantum - sum(shares.values())]:
        shares[s] += 1
    return shares


def nearest_shares(weights: dict[str | None, float], quantum: int) -> dict[str | None, int]:
    """Shares of ``quantum`` slots nearest to the weights, by largest remainder; a share that would be 0 is 1 at the largest's cost."""
    if len(weights) > quantum:
        raise ValueError(f"{len(weights)} sources don't fit {quantum} slots")
    names, total = sorted(weights, key=lambda s: (s is None, s or "")), math.fsum(weights.values())
    exact = {s: quantum * weights[s] / total for s in names}
    shares = {s: max(1, math.floor(exact[s])) for s in names}
    left = quantum - sum(shares.values())
    for s in sorted(names, key=lambda s: shares[s] - exact[s])[: max(0, left)]:
        shares[s] += 1
    while names and (over := sum(shares.values()) - quantum) > 0:
        top = max(names, key=lambda s: shares[s])
        shares[top] -= min(over, max(1, shares[top] // 2))
    return shares


def pfair_period(shares: dict[str | None, int]) -> list[tuple[str | None, int, int]]:
    """(source, block of the period from 0, slot) of one period; the shares sum to its length."""
    quantum = sum(shares.values())
    names = sorted(shares, key=lambda s: (s is None, s or ""))
    waiting = [(0, k, 0) for k in range(len(names))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(quantum):
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil(Fraction((j + 1) * quantum, shares[names[k]])), k, j))
        _, k, j = heapq.heappop(ready)
        out.append((names[k], j, slot))
        if j + 1 < shares[names[k]]:
            heapq.heappush(waiting, (math.floor(Fraction((j + 1) * quantum, shares[names[k]])), k, j + 1))
    return out


def pfair_slots(weights: list[float], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) of the first blocks[k] blocks of each source k, by slot; other blocks' slots are left out."""
    exact = [Fraction(w) for w in weights]
    whole = math.lcm(*(w.denominator for w in exact)) if exact else 1
    parts = [int(w * whole) for w in exact]
    total, left = sum(parts), sum(blocks)
    waiting = [(0, k, 0) for k in range(len(parts))]
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while left:
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // parts[k]), k, j))
        _, k, j = heapq.heappop(ready)
        if j < blocks[k]:
            left -= 1
            yield k, j, slot
        heapq.heappush(waiting, ((j + 1) * total // parts[k], k, j + 1))
        slot += 1


def _slots(sources: DataFrame, block_rows: int) -> DataFrame:
    """(_source, _source_null, block, slot) from (_source, _source_null, _n, _weight), in one task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["_source_null"], r["_source"], r["_n"], r["_weight"]) for b in batches for r in b.to_pylist())
        out: list[tuple[int, int, int]] = []

        def batch() -> pa.RecordBatch:
            k, j, slot = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([rows[x][1] for x in k]), pa.array([rows[x][0] for x in k]), pa.array(j, pa.int64()), pa.array(slot, pa.int64())], ["_source", "_source_null", "block", "slot"])

        for found in pfair_slots([r[3] for r in rows], [-(-r[2] // block_rows) for r in rows]):
            out.append(found)
            if len(out) == BATCH_ROWS:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return sources.select("_source", "_source_null", "_n", "_weight").repartition(1).mapInArrow(kernel, "_source string, _source_null boolean, block long, slot long")


def temperature_weights(docs: DataFrame, source_col: str, power: float = 0.5, most: int = QUANTUM) -> dict[str | None, float]:
    """The number of rows to a power of each source, or of ``most`` + 1 of them if there are more."""
    counts = docs.groupBy(F.col(source_col).alias("s")).agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    return {r.s: r.n**power for r in counts}


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS, quantum: int | None = None, nearest: bool = False) -> DataFrame:
    """``docs`` with block (from 0, in its source), slot and mix_position; to be read in order of mix_position.

    ``weights`` must name every source that occurs, null included (one that it leaves out is an
    error, one that doesn't occur isn't), each above 0; without it a source's weight is the square root of its rows.
    ``quantum`` rounds the weights to whole shares, see above, unless there are
    more sources than it has slots; ``nearest`` takes the shares next to the weights instead of those
    of ``whole_shares``.  Rows keep the order of the md5 of
    their ids inside a source, rows that share an id in any order.  Slots of a source that has
    run out stay empty, so mix_position has gaps, and the task that makes the schedule passes
    them too.  No row is dropped.  Columns of ``docs`` may have any names; those with the names of
    results are replaced.
    """
    spark = docs.sparkSession
    if weights and not all(0 < w < math.inf for w in weights.values()):
        raise ValueError("weights must be above 0 and finite")
    if weights is not None:
        named = spark.createDataFrame([(s or "", s is None, float(x)) for s, x in weights.items()], "_source string, _source_null boolean, _weight double")
        own = F.col(source_col).cast("string")
        missing = docs.select(F.coalesce(own, F.lit("")).alias("_source"), own.isNull().alias("_source_null")).distinct().join(named, ["_source", "_source_null"], "left_anti")
        if gone := missing.limit(NAMED_MISSING).collect():
            raise ValueError(f"no weight for {', '.join(sorted('null' if r._source_null else repr(r._source) for r in gone))}{' and maybe more' if len(gone) == NAMED_MISSING else ''}")
    total = docs.count()
    digits = max(1, math.ceil(math.log(max(total, 1) / RANK_ROWS + 1, 16)))
    # a row travels as one column, so that none of its columns meets one of these
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(source_col).cast("string").alias("_source"), F.col(id_col).alias("_id"), order.alias("_order"))
    rows = rows.withColumn("_range", F.substring("_order", 1, digits)).withColumn("_source_null", F.col("_source").isNull()).withColumn("_source", F.coalesce("_source", F.lit("")))
    keys = ["_source", "_source_null", "_range"]
    before = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_source", "_source_null").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(*keys, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_order", "_id"))).join(before, keys)
    placed = placed.withColumn("_place", F.col("_before") + F.col("_rank") - 1).withColumn("block", F.expr(f"_place div {block_rows}"))
    rounded = None if quantum is None else temperature_weights(docs, source_col, most=quantum) if weights is None else weights
    if rounded is None or len(rounded) > quantum:
        sources = rows.groupBy("_source", "_source_null").agg(F.count(F.lit(1)).alias("_n"))
        if weights is None:
            sources = sources.withColumn("_weight", F.pow("_n", F.lit(0.5)))
        else:
            sources = named.join(sources, ["_source", "_source_null"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
        placed = placed.join(written(_slots(sources, block_rows), "slots"), ["_source", "_source_null", "block"])
    else:
        shares = nearest_shares(rounded, quantum) if nearest else whole_shares(rounded, quantum)
        # the period by slot, as numbers of sources and of their blocks: short literals, as every text of the plan holds them
        period, names = pfair_period(shares), sorted(shares, key=lambda s: (s is None, s or ""))
        number = {s: k for k, s in enumerate(names)}
        folded = lambda values, kind: F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), kind)
        share = spark.range(1).select(F.inline(folded([{"_source": s or "", "_source_null": s is None, "_share": shares[s], "_k": number[s]} for s in names], "array<struct<_source:string,_source_null:boolean,_share:int,_k:int>>")))
        placed = placed.join(F.broadcast(share), ["_source", "_source_null"])  # ``quantum`` rows at most
        placed = placed.withColumn("_in_period", F.expr("cast(block % _share as int)"))
        turns = F.arrays_zip(folded([number[s] for s, _, _ in period], "array<int>").alias("_k"), folded([j for _, j, _ in period], "array<int>").alias("_in_period"))
        slots = spark.range(1).select(F.posexplode(turns).alias("_slot", "_turn")).select("_slot", "_turn._k", "_turn._in_period")
        placed = placed.join(F.broadcast(slots), ["_k", "_in_period"])
        placed = placed.withColumn("slot", F.expr(f"(block div _share) * {quantum} + _slot"))
    placed = placed.withColumn("mix_position", F.expr(f"slot * {block_rows} + _place % {block_rows}"))
    results = ["block", "slot", "mix_position"]
    return placed.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in results], *results)
