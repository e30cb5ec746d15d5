"""Evaluation: calibration, ranking quality, confusion, roll-ups, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import safe_ratio


def reliability(df: DataFrame, confidence: str, correct: str, bins: int = 10, group: list[str] | None = None) -> DataFrame:
    """(group, bin, low, high, count, mean_confidence, accuracy) of the bins (low, high], the first closed; empty ones are left out.

    Edges are k * (1 / bins) in double arithmetic.
    """
    step = 1.0 / bins
    edges = F.array(*[F.lit(k * step) for k in range(1, bins)])
    place = F.size(F.filter(edges, lambda e: e < F.col(confidence)))
    rows = df.where(F.col(confidence).between(0.0, 1.0)).withColumn("bin", place)
    out = rows.groupBy(*(group or []), "bin").agg(F.count(F.lit(1)).alias("count"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    low = F.get(F.array(*[F.lit(k * step) for k in range(bins)]), F.col("bin"))
    high = F.get(F.array(*[F.lit(k * step) for k in range(1, bins)], F.lit(1.0)), F.col("bin"))
    return out.select(*(group or []), "bin", low.alias("low"), high.alias("high"), "count", "mean_confidence", "accuracy")


def expected_calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10, group: list[str] | None = None) -> DataFrame:
    """(group, ece): the mean gap of confidence and accuracy, bins weighed by their rows."""
    table = reliability(df, confidence, correct, bins, group)
    gap = F.sum(F.col("count") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("count")
    return table.groupBy(*(group or [])).agg(F.coalesce(gap, F.lit(0.0)).alias("ece"))


def confidence_for_accuracy(df: DataFrame, confidence: str, correct: str, target: float, bins: int = 20) -> DataFrame:
    """One row (threshold): the least k / bins from which on rows are right often enough, null if none.

    Rows are counted once per bin; the cumulated counts of ``bins`` rows give every threshold.
    """
    step = 1.0 / bins
    top = F.size(F.filter(F.array(*[F.lit(k * step) for k in range(1, bins + 1)]), lambda e: e <= F.col(confidence)))
    counts = df.groupBy(top.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("double")).alias("right"))
    grid = df.sparkSession.range(bins + 1).select(F.col("id").cast("int").alias("t"))
    sums = grid.join(counts, F.col("k") >= F.col("t")).groupBy("t").agg((F.sum("right") / F.sum("n")).alias("accuracy"))
    return sums.where(F.col("accuracy") >= target).agg((F.min("t") * F.lit(step)).alias("threshold"))


def auc(df: DataFrame, score: str, positive: Column, group: list[str] | None = None) -> DataFrame:
    """(group, auc): the chance that a positive outranks a negative, ties half; NaN without both.

    Works on counts per distinct score: cumulated counts replace a ranking of all rows.
    """
    keys = group or []
    counts = df.groupBy(*keys, score).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = counts.withColumn("_w", F.col("_p") * (below + F.col("_n") / F.lit(2.0)))
    total = F.sum("_p") * F.sum("_n")
    return wins.groupBy(*keys).agg(F.when(total > 0, F.sum("_w") / total.cast("double")).otherwise(F.lit(float("nan"))).alias("auc"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, count) over arrays of equal length or plain columns."""
    if dict(df.dtypes)[truth].startswith("array"):
        df = df.select(F.inline(F.arrays_zip(F.col(truth).alias("truth"), F.col(predicted).alias("predicted"))))
        truth, predicted = "truth", "predicted"
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))


def per_class(matrix: DataFrame) -> DataFrame:
    """(class, support, recall, precision) of a confusion matrix."""
    sides = matrix.select(F.col("truth").alias("class"), F.col("count").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("truth") == F.col("predicted"), F.col("count")).otherwise(0).alias("r"))
    sides = sides.union(matrix.select("predicted", F.lit(0).cast("long"), "count", F.lit(0).cast("long")))
    sums = sides.groupBy("class").agg(F.sum("s").alias("support"), F.sum("p").alias("p"), F.sum("r").alias("r"))
    return sums.select("class", "support", safe_ratio(F.col("r"), F.col("support")).alias("recall"), safe_ratio(F.col("r"), F.col("p")).alias("precision"))


def top_confusions(matrix: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent mistakes, ties by class."""
    return matrix.where(F.col("truth") != F.col("predicted")).orderBy(F.desc("count"), "truth", "predicted").limit(limit)


def board_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: the shares of exact boards, of boards with one error at most, of right squares."""
    errors = F.size(F.filter(F.zip_with(truth, predicted, lambda a, b: a != b), lambda d: d))
    rows = df.select(errors.alias("e"), F.size(truth).alias("n"))
    return rows.agg(safe_ratio(F.count_if(F.col("e") == 0), F.count(F.lit(1))).alias("exact"), safe_ratio(F.count_if(F.col("e") <= 1), F.count(F.lit(1))).alias("within_one"), safe_ratio(F.sum(F.col("n") - F.col("e")), F.sum("n")).alias("square"))


def metric_rollup(df: DataFrame, regime: str, book: str, counters: dict[str, Column], ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Counters for all rows, each regime and each book in one pass, and ratios that are 0 where their whole is.

    Rows without a regime count in the total and in their book only.
    """
    rows = df.select(F.coalesce(F.col(regime), F.lit("")).alias("regime"), F.col(book).alias("book"), *[c.alias(n) for n, c in counters.items()])
    sets = rows.groupingSets([[], ["regime"], ["book"]], "regime", "book").agg(F.grouping_id().alias("_g"), *[F.sum(n).alias(n) for n in counters])
    scope = F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "regime").otherwise("book")
    out = sets.withColumn("scope", scope).where("not (scope = 'regime' and regime = '')")
    return out.select("scope", F.coalesce("regime", "book", F.lit("")).cast("string").alias("name"), *counters, *[safe_ratio(F.col(a), F.col(b)).alias(n) for n, (a, b) in ratios.items()])


def rounded_histogram(df: DataFrame, value: str, width: float, group: list[str] | None = None) -> DataFrame:
    """(group, bin, count) of values rounded half to even to whole widths."""
    return df.groupBy(*(group or []), (F.bround(F.col(value) / F.lit(width), 0) * width).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def distribution(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """(group, min, p05, median, max), percentiles interpolated."""
    return df.groupBy(*(group or [])).agg(F.min(value).alias("min"), F.percentile(value, F.lit(0.05)).alias("p05"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("max"))


def mixed_groups(df: DataFrame, group: list[str], value: str, limit: float) -> DataFrame:
    """Groups of two or more with values on both sides of the limit."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).where((F.col("n") >= 2) & (F.col("low") < limit) & (F.col("high") >= limit))


def shifted_groups(df: DataFrame, group: list[str], order: list[str], suspect: Column) -> DataFrame:
    """Groups in which a suspect row isn't at the tail of the order, so that it shifts the numbers after it."""
    w = Window.partitionBy(*group)
    ranked = df.select(*group, suspect.alias("_s"), F.row_number().over(w.orderBy(*order)).alias("_n"))
    return ranked.groupBy(*group).agg(F.min(F.when(F.col("_s"), F.col("_n"))).alias("first_suspect"), F.max(F.when(~F.col("_s"), F.col("_n"))).alias("last_other")).where("first_suspect < last_other")


def systematic_sample(count: Column, wanted: Column) -> Column:
    """``wanted`` equally spaced inner indices of ``count`` pages, half to even, each once."""
    n = F.least(count, wanted)
    step = count / (n + 1).cast("double")
    picked = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.least(F.greatest(F.bround(step * k, 0), F.lit(0.0)), count - F.lit(1.0)).cast("int"))
    return F.when(count <= 0, F.array().cast("array<int>")).when(wanted >= count, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array_sort(F.array_distinct(picked)))


def recent(df: DataFrame, key: str, touched: str, limit: int) -> DataFrame:
    """The last touched keys, ties by key."""
    return df.groupBy(key).agg(F.max(touched).alias("last")).orderBy(F.desc("last"), key).limit(limit)


def best_epoch(df: DataFrame, run: list[str], epoch: str, metric: str, patience: int) -> DataFrame:
    """Rows with improved (strictly above all before), best_so_far, since_best and stop (patience is used up)."""
    w = Window.partitionBy(*run).orderBy(epoch)
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("improved", before.isNull() | (F.col(metric) > before)).withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("best_so_far", F.max(metric).over(w)).withColumn("_b", F.max(F.when(F.col("improved"), F.col("_n"))).over(w))
    return rows.withColumn("since_best", F.col("_n") - F.col("_b")).withColumn("stop", F.col("since_best") >= patience).drop("_n", "_b")


def temperature(df: DataFrame, logits: str, target: str, low: float = 0.05, high: float = 20.0, rounds: int = 4, grid: int = 16) -> float:
    """The temperature of least mean cross-entropy: a grid evaluated in one pass, refined ``rounds`` times."""
    for _ in range(rounds):
        ratio = (high / low) ** (1 / (grid - 1))
        points = [low * ratio**k for k in range(grid)]
        losses = df.agg(*[F.avg(cross_entropy(F.col(logits), F.col(target), t)).alias(f"t{k}") for k, t in enumerate(points)]).first()
        best = min(range(grid), key=lambda k: losses[k] if losses[k] is not None else 0.0)
        low, high = points[max(0, best - 1)], points[min(grid - 1, best + 1)]
    return (low * high) ** 0.5


def cross_entropy(logits: Column, target: Column, t: float = 1.0) -> Column:
    """-log softmax(logits / t)[target]."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp((x - top) / F.lit(t)))
    return F.log(total) - (F.get(logits, target) - top) / F.lit(t)


def parity(df: DataFrame, a: str, b: str, tolerance: float = 1e-4) -> DataFrame:
    """One row: largest and mean difference of two arrays of numbers, differing argmax rows, and whether all is within tolerance."""
    diffs = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    rows = df.select(F.array_max(diffs).alias("m"), (F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x) / F.size(diffs)).alias("a"), (F.array_position(F.col(a), F.array_max(a)) != F.array_position(F.col(b), F.array_max(b))).alias("d"))
    return rows.agg(F.max("m").alias("largest"), F.avg("a").alias("mean"), F.count_if("d").alias("argmax_differs"), (F.max("m") <= tolerance).alias("within"))
