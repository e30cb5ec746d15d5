"""Calibration, ranking quality, confusion, roll-ups and distributions on the driver's tables."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import score
from ..operators import metrics, scoring, similarity
from ..sources.staging import fresh_folder
from .catalogue import Tables, query

_SCORED_SQL = "SELECT d.doc_id, lang, CAST(n_chars % 101 AS DOUBLE) / 100 AS conf, quality = 1 AS ok, quality, toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id"
_STEP = "CAST(0.1 AS DOUBLE)"


def _scored(t: Tables) -> DataFrame:
    return t("documents").join(t("labels"), "doc_id").select("doc_id", "lang", ((F.col("n_chars") % 101) / F.lit(100.0)).alias("conf"), (F.col("quality") == 1).alias("ok"), "quality", "toxic")


_BINS_SQL = f"SELECT lang, len(list_filter(range(1, 10), lambda k: k * {_STEP} < conf)) AS bin, count(*) AS n, avg(conf) AS mc, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS acc FROM ({_SCORED_SQL}) GROUP BY 1, 2"


@query(
    "lang string, bin bigint, count bigint, mean_confidence double, accuracy double",
    f"""SELECT lang, bin, n AS count, round(mc, 9) AS mean_confidence, round(acc, 9) AS accuracy
        FROM ({_BINS_SQL})""",
)
def reliability(t: Tables) -> DataFrame:
    """Confidence bins with their mean confidence and accuracy."""
    r = metrics.reliability(_scored(t), "conf", "ok", 10, ["lang"])
    return r.select("lang", "bin", "count", F.round("mean_confidence", 9).alias("mean_confidence"), F.round("accuracy", 9).alias("accuracy"))


@query("lang string, ece double", f"SELECT lang, round(sum(n * abs(mc - acc)) / sum(n), 9) AS ece FROM ({_BINS_SQL}) GROUP BY lang")
def ece(t: Tables) -> DataFrame:
    """Expected calibration error."""
    return metrics.expected_calibration_error(_scored(t), "conf", "ok", 10, ["lang"]).select("lang", F.round("ece", 9).alias("ece"))


@query(
    "threshold double",
    f"""SELECT min(k * CAST(0.05 AS DOUBLE)) AS threshold FROM (SELECT k, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS a
        FROM ({_SCORED_SQL}), range(0, 21) AS r(k) WHERE conf >= k * CAST(0.05 AS DOUBLE)
        GROUP BY k) WHERE a >= 0.86""",
)
def threshold(t: Tables) -> DataFrame:
    """The least threshold from which on the wanted share is right."""
    return metrics.confidence_for_accuracy(_scored(t), "conf", "ok", 0.86)


@query(
    "lang string, auc double",
    f"""WITH s AS ({_SCORED_SQL}), r AS (SELECT lang, ok, rank() OVER w + (count(*) OVER (PARTITION BY lang, conf) - 1) / 2.0 AS rk
        FROM s WINDOW w AS (PARTITION BY lang ORDER BY conf)) SELECT lang, round((sum(rk) FILTER (ok) - count(*) FILTER (ok) * (count(*) FILTER (ok) + 1) / 2.0) / (count(*) FILTER (ok) * count(*) FILTER (NOT ok)),
        9) AS auc FROM r GROUP BY lang""",
)
def auc(t: Tables) -> DataFrame:
    """The chance that a right row has the higher confidence, ties half."""
    return metrics.auc(_scored(t), "conf", F.col("ok"), ["lang"]).select("lang", F.round("auc", 9).alias("auc"))


_GUESS = "CASE WHEN doc_id % 5 = 0 THEN 'en' WHEN doc_id % 7 = 0 THEN 'de' ELSE lang END"


def _guessed(t: Tables) -> DataFrame:
    return t("documents").select("lang", F.when(F.col("doc_id") % 5 == 0, "en").when(F.col("doc_id") % 7 == 0, "de").otherwise(F.col("lang")).alias("guess"))


@query("truth string, predicted string, count bigint", f"SELECT lang AS truth, {_GUESS} AS predicted, count(*) AS count FROM documents GROUP BY 1, 2")
def confusion(t: Tables) -> DataFrame:
    """The confusion matrix."""
    return metrics.confusion(_guessed(t), "lang", "guess")


@query(
    "class string, support bigint, recall double, precision double",
    f"WITH g AS (SELECT lang, {_GUESS} AS p FROM documents), c AS (SELECT DISTINCT lang AS class FROM g UNION SELECT DISTINCT p FROM g) SELECT class, count(*) FILTER (lang = class) AS support, count(*) FILTER (lang = class AND p = class) / greatest(1, count(*) FILTER (lang = class)) AS recall, count(*) FILTER (lang = class AND p = class) / greatest(1, count(*) FILTER (p = class)) AS precision FROM c, g GROUP BY class",
)
def per_class(t: Tables) -> DataFrame:
    """Support, recall and precision of each class."""
    return metrics.per_class(metrics.confusion(_guessed(t), "lang", "guess"))


@query(
    "truth string, predicted string, count bigint",
    f"""SELECT lang AS truth, {_GUESS} AS predicted, count(*) AS count
        FROM documents WHERE lang <> {_GUESS} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 3""",
)
def top_confusions(t: Tables) -> DataFrame:
    """The three most frequent mistakes."""
    return metrics.top_confusions(metrics.confusion(_guessed(t), "lang", "guess"), 3)


@query(
    "scope string, name string, lines bigint, returned bigint, late bigint, returned_rate double, late_rate double",
    """WITH r AS (SELECT CASE WHEN l_linestatus = 'O' AND l_quantity < 5 THEN '' ELSE l_linestatus END AS regime, CAST(l_suppkey % 10 AS VARCHAR) AS book, (l_returnflag = 'R')::INT AS ret, (l_discount > 0.05)::INT AS late FROM lineitem),
    s AS (SELECT regime, book, grouping(regime, book) AS g, count(*) AS lines, sum(ret) AS returned, sum(late) AS late FROM r GROUP BY GROUPING SETS ((), (regime), (book)))
    SELECT CASE g WHEN 3 THEN 'total' WHEN 1 THEN 'regime' ELSE 'book' END AS scope, coalesce(regime, book, '') AS name, lines, returned, late, returned / lines AS returned_rate, late / lines AS late_rate FROM s WHERE NOT (g = 1 AND regime = '')""",
)
def metric_rollup(t: Tables) -> DataFrame:
    """Counters and ratios in total, by regime and by book, in one pass."""
    c = F.col
    rows = t("lineitem").withColumn("regime_in", F.when((c("l_linestatus") == "O") & (c("l_quantity") < 5), "").otherwise(c("l_linestatus"))).withColumn("book_in", (c("l_suppkey") % 10).cast("string"))
    counters = {"lines": F.lit(1), "returned": (c("l_returnflag") == "R").cast("int"), "late": (c("l_discount") > 0.05).cast("int")}
    return metrics.metric_rollup(rows, "regime_in", "book_in", counters, {"returned_rate": ("returned", "lines"), "late_rate": ("late", "lines")})


@query("p_brand string, bin double, count bigint", "SELECT p_brand, round_even(p_retailprice / 10, 0) * 10 AS bin, count(*) AS count FROM part GROUP BY 1, 2")
def rounded_histogram(t: Tables) -> DataFrame:
    """Prices by bins rounded half to even."""
    return metrics.rounded_histogram(t("part"), "p_retailprice", 10.0, ["p_brand"])


@query(
    "lang string, min double, p05 double, median double, max double",
    """SELECT lang, min(n_chars) AS min, round(quantile_cont(n_chars, 0.05),
        6) AS p05, median(n_chars) AS median, max(n_chars) AS max FROM documents
        GROUP BY lang""",
)
def dist_summary(t: Tables) -> DataFrame:
    """Least, fifth percentile, median and largest."""
    return metrics.distribution(t("documents"), "n_chars", ["lang"]).withColumn("p05", F.round("p05", 6))


@query(
    "l_orderkey bigint, n bigint, low double, high double",
    """SELECT l_orderkey, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high
        FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2 AND min(l_quantity) < 10 AND max(l_quantity) >= 10""",
)
def mixed_pages(t: Tables) -> DataFrame:
    """Orders with small and large lines."""
    return metrics.mixed_groups(t("lineitem"), ["l_orderkey"], "l_quantity", 10.0)


@query(
    "l_orderkey bigint, first_suspect bigint, last_other bigint",
    """SELECT l_orderkey, min(l_linenumber) FILTER (l_quantity < 10) AS first_suspect, max(l_linenumber) FILTER (l_quantity >= 10) AS last_other
        FROM (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_extendedprice, l_quantity) AS l_linenumber
        FROM lineitem) GROUP BY l_orderkey HAVING min(l_linenumber) FILTER (l_quantity < 10) < max(l_linenumber) FILTER (l_quantity >= 10)""",
)
def shifted_pages(t: Tables) -> DataFrame:
    """Orders whose small lines aren't last."""
    return metrics.shifted_groups(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_extendedprice", "l_quantity"], F.col("l_quantity") < 10)


@query(
    "p_brand string, typical double",
    """WITH a AS (SELECT p_brand, p_retailprice AS v, lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS b FROM part), c AS (SELECT p_brand, v, sum(CASE WHEN v - b > 0.01 * b THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY v ROWS UNBOUNDED PRECEDING) AS k FROM a),
    s AS (SELECT p_brand, k, count(*) AS n, max(v) AS top, median(v) AS m FROM c GROUP BY p_brand, k) SELECT p_brand, arg_max(m, (n, top)) AS typical FROM s GROUP BY p_brand""",
)
def typical_cluster(t: Tables) -> DataFrame:
    """The median of the largest run of close prices."""
    return similarity.typical_cluster(t("part"), ["p_brand"], "p_retailprice", 0.01)


@query(
    "day bigint, metric double, improved boolean, since_best bigint, stop boolean",
    """WITH d AS (SELECT CAST(dayofmonth(ts) AS BIGINT) AS day, round(sum(CAST(value AS DECIMAL(18, 4))), 2)::DOUBLE AS metric FROM events GROUP BY 1), b AS (SELECT *, max(metric) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, row_number() OVER (ORDER BY day) AS n FROM d),
    i AS (SELECT *, p IS NULL OR metric > p AS improved FROM b), j AS (SELECT *, n - max(CASE WHEN improved THEN n END) OVER (ORDER BY day) AS since_best FROM i) SELECT day, metric, improved, since_best, since_best >= 3 AS stop FROM j""",
)
def best_epoch(t: Tables) -> DataFrame:
    """Days that beat all before, and where patience ends; the series is one row a day."""
    days = t("events").groupBy(F.dayofmonth("ts").cast("bigint").alias("day")).agg(F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).cast("double").alias("metric"))
    return metrics.best_epoch(days.withColumn("run", F.lit(1)), ["run"], "day", "metric", 3)


@query(
    "n bigint, k bigint, sample string",
    """WITH p AS (SELECT a.n, b.k FROM (VALUES (0), (1), (3), (10), (37), (100), (1181)) a(n), (VALUES (1), (2), (5), (12), (24)) b(k)),
    s AS (SELECT n, k, CASE WHEN n = 0 THEN [] WHEN k >= n THEN range(0, n) ELSE list_sort(list_distinct(list_transform(range(1, least(n, k) + 1), lambda i: CAST(least(greatest(round_even(n / CAST(least(n, k) + 1 AS DOUBLE) * i, 0), 0), n - 1) AS BIGINT)))) END AS x FROM p)
    SELECT n, k, array_to_string(x, ',') AS sample FROM s""",
)
def systematic_sample(t: Tables) -> DataFrame:
    """Equally spaced inner pages."""
    n = t.spark.range(1).select(F.explode(F.array(*map(F.lit, (0, 1, 3, 10, 37, 100, 1181)))).alias("n"), F.lit(1).alias("one"))
    pairs = n.select("n", F.explode(F.array(*map(F.lit, (1, 2, 5, 12, 24)))).alias("k"))
    return pairs.select("n", "k", F.array_join(metrics.systematic_sample(F.col("n"), F.col("k")), ",").alias("sample"))


@query(
    "exact double, within_one double, square double",
    """WITH r AS (SELECT CASE WHEN doc_id % 2 = 0 AND lang = 'de' THEN 1 ELSE 0 END + CASE WHEN n_chars % 10 = 3 THEN 1 ELSE 0 END AS e
        FROM documents) SELECT avg(CASE WHEN e = 0 THEN 1.0 ELSE 0.0 END) AS exact, avg(CASE WHEN e <= 1 THEN 1.0 ELSE 0.0 END) AS within_one,
        (2 * count(*) - sum(e)) / (2.0 * count(*)) AS square FROM r""",
)
def board_accuracy(t: Tables) -> DataFrame:
    """Exact arrays, arrays with one mistake at most, right elements."""
    c = F.col
    rows = t("documents").select(F.array(F.lit(1), F.lit(2)).alias("truth"), F.array(F.when((c("doc_id") % 2 == 0) & (c("lang") == "de"), 9).otherwise(1), F.when(c("n_chars") % 10 == 3, 9).otherwise(2)).alias("guess"))
    return metrics.board_accuracy(rows, "truth", "guess")


@query(
    "event_id bigint, fraction double, shown string",
    """SELECT event_id, round(CASE WHEN user_id % 10 = 0 THEN CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END WHEN user_id % 10 = 1 THEN 0.5 ELSE 1 / (1 + pow(10.0,
        -CAST(event_id % 801 - 400 AS DOUBLE) / 400)) END, 9) AS fraction, CASE WHEN user_id % 10 = 0 THEN CASE WHEN value > 50 THEN 'M3' ELSE '-M3' END WHEN user_id % 10 = 1 THEN '' ELSE replace(format('{:+.2f}',
        CAST(event_id % 801 - 400 AS DOUBLE) / 100), '.', ',') END AS shown
        FROM events""",
)
def evaluation_scale(t: Tables) -> DataFrame:
    """Engine evaluations as a fraction and as text."""
    c = F.col
    mate = F.when(c("user_id") % 10 == 0, F.when(c("value") > 50, 3).otherwise(-3))
    cp = F.when(c("user_id") % 10 > 1, (c("event_id") % 801 - 400).cast("double"))
    return t("events").select("event_id", F.round(score.advantage(cp, mate), 9).alias("fraction"), score.evaluation_text(cp, mate).alias("shown"))


_WHOLE_SQL = "list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE)))"
_WEIGHT_SQL = "CAST((i * 7 + j * 3) % 11 - 5 AS DOUBLE)"


@query(
    "vec_id bigint, a double, b double, c double, best bigint",
    f"""WITH v AS (SELECT vec_id, {_WHOLE_SQL} AS x FROM embeddings),
        s AS (SELECT vec_id, j, list_sum(list_transform(range(64), lambda i: x[i + 1] * {_WEIGHT_SQL})) AS one, list_sum(list_transform(range(64), lambda i: x[64 - i] * {_WEIGHT_SQL})) AS two
            FROM v, (SELECT unnest(range(3)) AS j)),
        w AS (SELECT vec_id, max(one) AS one, max(two) AS two FROM s GROUP BY vec_id)
        SELECT s.vec_id, max((one_ + two_) / 2) FILTER (j = 0) AS a, max((one_ + two_) / 2) FILTER (j = 1) AS b, max((one_ + two_) / 2) FILTER (j = 2) AS c, max(CASE WHEN w.two > w.one THEN 1 ELSE 0 END) AS best
        FROM (SELECT vec_id, j, one AS one_, two AS two_ FROM s) s JOIN w ON w.vec_id = s.vec_id GROUP BY s.vec_id""",
)
def scored_views(t: Tables) -> DataFrame:
    """A linear model's answers to each vector and to the vector turned round, averaged, and the view it is surer of."""
    i, j = np.indices((64, 3))
    saved, name = io.BytesIO(), fresh_folder(t.spark, "weights") + ".npy"
    np.save(saved, ((i * 7 + j * 3) % 11 - 5).astype(float))
    place = t.spark._jvm.org.apache.hadoop.fs.Path(name)
    out = place.getFileSystem(t.spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(saved.getvalue()))
    out.close()
    t.spark.sparkContext.addFile(name)
    model, whole = name.rsplit("/", 1)[-1], t("embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("double")).alias("x"))
    own, turned, same = list(range(64)), list(range(63, -1, -1)), [0, 1, 2]
    both = scoring.scored(whole, ["vec_id"], "x", model, scoring.linear, 3, [(own, same), (turned, same)])
    views = [scoring.scored(whole, ["vec_id"], "x", model, scoring.linear, 3, [(p, same)]).select("vec_id", F.col("scores").alias(f"_v{k}")) for k, p in enumerate((own, turned))]
    _, best = scoring.best_view(["_v0", "_v1"])
    joined = both.join(views[0], "vec_id").join(views[1], "vec_id")
    return joined.select("vec_id", *[F.get("scores", F.lit(k)).alias(c) for k, c in enumerate("abc")], best.alias("best"))
