"""Page, census, survey and label-scan operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, pages
from .catalogue import Tables, query
from .layout_queries import _BOXES_SQL, _EXPANDED_SQL, _IOU_SQL, _WHOLE_SQL, _boxes, _fens, greedy_sql


@query(
    "source string, total bigint, defaults bigint, resolved_share double",
    """SELECT source, count(*) AS total, count(*) FILTER (lang = 'en') AS defaults, (count(*) - count(*) FILTER (lang = 'en')) / count(*) AS resolved_share
        FROM documents GROUP BY ROLLUP (source)""",
)
def sides_survey(t: Tables) -> DataFrame:
    """How many sides to move are resolved, per book and in total."""
    return pages.sides_survey(t("documents").withColumn("o", F.when(F.col("lang") == "en", "default").otherwise("text")), "source", "o")


_BOOK = "split_part(page, '/', 1)"


@query(
    "book string, candidates bigint, suspects bigint, trimmed bigint, pages bigint, mixed_pages bigint",
    f"WITH b AS (SELECT {_BOOK} AS book, page, x1 - x0 AS s, idx FROM ({_BOXES_SQL})), p AS (SELECT book, page, count(*) AS n, count(*) FILTER (s < 72) AS s, count(*) FILTER (idx % 3 = 0) AS t FROM b GROUP BY book, page) SELECT book, sum(n) AS candidates, sum(s) AS suspects, sum(t) AS trimmed, count(*) AS pages, count(*) FILTER (s > 0 AND s < n) AS mixed_pages FROM p GROUP BY ROLLUP (book)",
)
def detection_census(t: Tables) -> DataFrame:
    """Candidates, suspects and mixed pages, per book and in total."""
    return pages.detection_census(_boxes(t).withColumn("book", F.split_part("page", F.lit("/"), F.lit(1))).withColumn("trimmed", F.col("idx") % 3 == 0), "book")


@query(
    "reason string, count bigint",
    """SELECT reason, count(*) AS count FROM (SELECT CASE WHEN n_chars > 20000 THEN 'syntax' WHEN d.doc_id % 10 = 0 THEN 'split' WHEN lang = 'es' AND d.doc_id % 4 <> 0 THEN 'fatal' WHEN l.doc_id IS NULL THEN 'missing' END AS reason
        FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id)
        GROUP BY reason""",
)
def training_scan(t: Tables) -> DataFrame:
    """Why rows don't train: one reason each, by order."""
    c = F.col
    splits = t("documents").select("doc_id", F.when(c("doc_id") % 10 == 0, "val").otherwise("train").alias("split"))
    rows = pages.training_scan(t("documents"), splits, t("labels"), "train", "doc_id", c("n_chars") <= 20000, c("lang") == "es", c("doc_id") % 4 == 0)
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("count"))


@query(
    "outcome string, side string, count bigint",
    """SELECT CASE WHEN doc_id % 3 = 0 THEN 'kept' WHEN lang IN ('en', 'de') THEN 'fen' WHEN n_chars % 2 = 0 THEN 'legality' ELSE 'unknown' END AS outcome,
        CASE WHEN doc_id % 3 = 0 THEN 'w' WHEN lang = 'en' THEN 'w' WHEN lang = 'de' THEN 'b' WHEN n_chars % 2 = 0 THEN 'b' ELSE '' END AS side,
        count(*) AS count FROM documents GROUP BY 1, 2""",
)
def label_migration(t: Tables) -> DataFrame:
    """Sides from the column, the position text or proof, and how many of each."""
    c = F.col
    m = pages.migrated_sides(F.when(c("doc_id") % 3 == 0, "w").otherwise(""), F.when(c("lang") == "en", "w").when(c("lang") == "de", "b").otherwise(""), F.when(c("n_chars") % 2 == 0, "b"))
    return t("documents").select(m.alias("m")).groupBy("m.outcome", "m.side").agg(F.count(F.lit(1)).alias("count"))


@query(
    "conv_id bigint, side string",
    """WITH l AS (SELECT conv_id, CASE WHEN turn < 2 THEN 0 ELSE 1 END AS tier, CASE WHEN length(text) % 3 = 0 THEN 'w' WHEN length(text) % 3 = 1 THEN 'b' END AS side,
        turn % 2 = 0 AS printed FROM conversations), g AS (SELECT conv_id, tier, list_distinct(list(side)) AS s, list_distinct(list(CASE WHEN printed THEN side END)) AS p
        FROM l WHERE side IS NOT NULL GROUP BY conv_id, tier), o AS (SELECT conv_id, tier, CASE WHEN len(s) = 1 THEN s[1] WHEN len(p) = 1 THEN p[1] END AS side
        FROM g) SELECT conv_id, side FROM o QUALIFY row_number() OVER (PARTITION BY conv_id
        ORDER BY tier) = 1""",
)
def tier_side(t: Tables) -> DataFrame:
    """The side that the first tier which speaks agrees on."""
    size = F.length("text") % 3
    lines = t("conversations").select("conv_id", F.when(F.col("turn") < 2, "primary").otherwise("secondary").alias("tier"), F.when(size == 0, "w").when(size == 1, "b").alias("side"), F.when(F.col("turn") % 2 == 0, "text").otherwise("ocr").alias("origin"))
    return pages.tier_side(lines, ["conv_id"])


@query(
    "o_custkey bigint, o_orderkey bigint, side string, side_origin string",
    """WITH c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'w' END AS side
        FROM orders), d AS (SELECT o_custkey, o_orderkey % 2 AS ocr, list_distinct(list(CASE WHEN o_totalprice > 200000 THEN 'w' ELSE 'b' END)) AS s
        FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2), k AS (SELECT o_custkey, arg_min(s[1], ocr) AS scope
        FROM d WHERE len(s) = 1 GROUP BY 1) SELECT c.o_custkey, o_orderkey, coalesce(side, scope) AS side, CASE WHEN side IS NOT NULL THEN 'caption' WHEN scope IS NOT NULL THEN 'page' END AS side_origin
        FROM c LEFT JOIN k ON k.o_custkey = c.o_custkey""",
)
def page_scope(t: Tables) -> DataFrame:
    """What a page declares as one fills the sides that captions leave open."""
    c = F.col
    contexts = t("orders").select("o_custkey", "o_orderkey", F.when(c("o_orderstatus") == "F", "w").alias("side"))
    said = t("orders").where("o_orderstatus = 'O'").select("o_custkey", F.when(c("o_totalprice") > 200000, "w").otherwise("b").alias("side"), F.when(c("o_orderkey") % 2 == 0, "text").otherwise("ocr").alias("origin"))
    return pages.page_scope(contexts, said, ["o_custkey"])


@query(
    "page bigint, diagrams string",
    """SELECT page, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) AS diagrams
        FROM (SELECT DISTINCT doc_id // 7 - 1 AS page, n_chars % 5 - 1 AS d
        FROM documents WHERE source = 'src3' AND doc_id // 7 >= 1 AND n_chars % 5 >= 1)
        GROUP BY page""",
)
def saved_diagrams(t: Tables) -> DataFrame:
    """One book's saved diagrams by page, from texts that count from 1."""
    labels = t("documents").select(F.col("source").alias("source_pdf"), F.expr("doc_id div 7").cast("string").alias("source_page"), (F.col("n_chars") % 5).cast("string").alias("source_diagram"))
    return pages.saved_by_page(labels, "src3").select("page", F.array_join("diagrams", ",").alias("diagrams"))


@query(
    "page string, annotated bigint, matched bigint, exported bigint, exact bigint, detected bigint, false_positives bigint",
    f"""WITH b AS ({_BOXES_SQL}), a AS (SELECT * FROM b WHERE {_BOOK} <> 'Brand#11'), m AS (SELECT page, idx FROM b WHERE idx % 3 <> 0), r AS (SELECT page, idx, idx % 5 AS got, (idx % 10) / 10.0 AS conf, idx % 17 = 0 AS fatal FROM b),
    s AS (SELECT a.page, count(*) AS annotated, count(r.idx) AS matched, count(*) FILTER (r.conf >= 0.8 AND NOT r.fatal) AS exported, count(*) FILTER (r.conf >= 0.8 AND NOT r.fatal AND r.got = a.idx % 7) AS exact FROM a LEFT JOIN m ON m.page = a.page AND m.idx = a.idx LEFT JOIN r ON r.page = m.page AND r.idx = m.idx GROUP BY a.page), d AS (SELECT page, count(*) AS detected FROM r GROUP BY page)
    SELECT s.page, annotated, matched, exported, exact, detected, detected - matched AS false_positives FROM s JOIN d ON d.page = s.page""",
)
def field_counters(t: Tables) -> DataFrame:
    """Matched, exported and exact readings of each reviewed page."""
    b, k = _boxes(t), F.col("idx")
    annotated = b.select("page", "idx", (k % 7).cast("string").alias("placement"), (F.split_part("page", F.lit("/"), F.lit(1)) != "Brand#11").alias("reviewed"))
    read = b.select("page", "idx", (k % 5).cast("string").alias("placement"), ((k % 10) / F.lit(10.0)).alias("min_confidence"), (k % 17 == 0).alias("is_fatal"))
    matches = b.where(k % 3 != 0).select("page", k.alias("annotation"), k.alias("reading"))
    return pages.field_counters(annotated, read, matches, ["page"])


@query(
    "page string, idx bigint, state string",
    f"""SELECT page, idx, CASE WHEN idx % 4 = 0 THEN 'saved' WHEN idx % 3 = 0 THEN 'confirmed' WHEN idx % 5 = 0 THEN 'fatal' WHEN x0 < 100 THEN 'low' ELSE 'read' END AS state
        FROM ({_BOXES_SQL})""",
)
def box_states(t: Tables) -> DataFrame:
    """The most telling state of each box, with flags from joins."""
    b = _boxes(t).select("page", "idx", "x0")
    b = pages.flagged(pages.flagged(b, b.where("idx % 4 = 0"), ["page", "idx"], "saved"), b.where("idx % 3 = 0"), ["page", "idx"], "confirmed")
    return b.select("page", "idx", pages.box_state(F.col("saved"), F.col("confirmed"), F.col("idx") % 5 == 0, F.col("x0") < 100).alias("state"))


@query(
    "page string, idx bigint",
    f"""WITH b AS ({_BOXES_SQL}), e AS (SELECT * FROM b WHERE idx % 2 = 0), c AS (SELECT page, idx, x0 + 5 AS x0, y0 + 5 AS y0, x1 + 5 AS x1, y1 + 5 AS y1 FROM b WHERE idx % 3 = 0),
    p AS (SELECT c.page, c.idx, greatest(0, least(c.x1, e.x1) - greatest(c.x0, e.x0)) * greatest(0, least(c.y1, e.y1) - greatest(c.y0, e.y0)) AS i, (c.x1 - c.x0) * (c.y1 - c.y0) AS a, (e.x1 - e.x0) * (e.y1 - e.y0) AS b, e.idx % 4 = 0 AS m FROM c JOIN e ON e.page = c.page),
    k AS (SELECT DISTINCT page, idx FROM p WHERE i / (a + b - i) > 0.5 OR (m AND i / least(a, b) >= 0.7)) SELECT page, idx FROM e UNION ALL SELECT page, idx FROM c WHERE (page, idx) NOT IN (SELECT (page, idx) FROM k)""",
)
def union_candidates(t: Tables) -> DataFrame:
    """Two detectors' boxes without those of the second that show the same region."""
    b = _boxes(t).select("page", "idx", "x0", "y0", "x1", "y1")
    moved = b.where("idx % 3 = 0").select("page", "idx", *[(F.col(c) + 5).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return pages.union_candidates(b.where("idx % 2 = 0").withColumn("merged", F.col("idx") % 4 == 0), moved, ["page"])


@query(
    "page string, idx bigint, score double",
    f"""SELECT page, idx, greatest(0, 1 - abs((x1 - x0) / (y1 - y0) - 1) / 0.2) AS score
        FROM (SELECT page, idx, x0, y0, x1, y1 + idx % 31 AS y1 FROM ({_BOXES_SQL}))
        WHERE (x1 - x0) * (y1 - y0) <= 0.7 * 15000 AND 100 + idx % 60 >= 120 AND abs((x1 - x0) / (y1 - y0) - 1) <= 0.2 AND least(x1 - x0,
        y1 - y0) >= 72""",
)
def image_candidates(t: Tables) -> DataFrame:
    """Embedded images that may be boards."""
    b = _boxes(t).withColumn("y1", F.col("y1") + F.col("idx") % 31).withColumn("native_width", F.lit(100) + F.col("idx") % 60).withColumn("native_height", F.lit(500)).drop("score")
    return pages.image_candidates(b, ["page"], F.lit(15000.0))


@query(
    "page string, idx bigint",
    "SELECT page, idx FROM ("
    + greedy_sql(
        f"""CASE WHEN (r.x1 - r.x0) * (r.y1 - r.y0) < 0.02 * r.largest THEN 'tiny'
        WHEN len(list_filter(z.kept, lambda k: {_IOU_SQL.format(a="r.box", b="k")} > 0.9)) > 0 THEN 'overlap' ELSE '' END"""
    )
    + ") WHERE reason = ''",
)
def predupe(t: Tables) -> DataFrame:
    """Boxes without near repeats and tiny ones."""
    return pages.predupe(_boxes(t), ["page"])


@query(
    "lang string, source string, n bigint",
    """SELECT lang, source, count(*) AS n FROM documents WHERE contains(source, 'src1') OR contains(source, 'c3')
        GROUP BY lang, source""",
)
def choose_books(t: Tables) -> DataFrame:
    """Books by parts of their names."""
    return pages.choose_books(t("documents"), "source", ["SRC1", "c3"]).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c_custkey bigint, o_orderkey bigint, move_number bigint, side string, verified boolean",
    """SELECT o_custkey AS c_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 40 ELSE 0 END AS move_number,
        CASE WHEN o_orderstatus = 'F' THEN 'w' ELSE '' END AS side, o_orderstatus = 'F' AS verified
        FROM orders WHERE o_custkey % 9 = 0""",
)
def search_by_name(t: Tables) -> DataFrame:
    """Games of some players, those with the position marked as verified."""
    games = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    hits = t("orders").where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_orderkey") % 40).alias("move_number"), F.lit("w").alias("side"))
    return pages.search_by_name(games, hits, F.col("c_custkey") % 9 == 0, ["o_orderkey"])


@query(
    "doc_id bigint, leader bigint, size bigint",
    """SELECT doc_id, min(doc_id) OVER w AS leader, count(*) OVER w AS size
        FROM documents WINDOW w AS (PARTITION BY text) QUALIFY count(*) OVER w > 1""",
)
def groups_by_origin(t: Tables) -> DataFrame:
    """Groups of two or more of one origin."""
    return pages.groups_of(t("documents").select("doc_id", F.sha2("text", 256).alias("digest")), ["digest"], "doc_id")


@query(
    "conv_id bigint, turn bigint, taken string",
    """WITH e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn) AS n, turn, role, CASE WHEN length(text) % 4 = 0 THEN role END AS chosen
        FROM conversations) SELECT a.conv_id, a.turn, arg_min(b.chosen, (abs(a.n - b.n),
        b.n)) AS taken FROM e a JOIN e b ON b.conv_id = a.conv_id AND abs(a.n - b.n) BETWEEN 1 AND 3 AND b.chosen IN (a.role,
        'assistant') WHERE a.chosen IS NULL GROUP BY a.conv_id, a.turn""",
)
def neighbour_games(t: Tables) -> DataFrame:
    """Rows without a choice take the nearest neighbour's, if it is among their own."""
    rows = t("conversations").select("conv_id", "turn", F.row_number().over(_by_turn()).alias("n"), F.array("role", F.lit("assistant")).alias("games"), F.when(F.length("text") % 4 == 0, F.col("role")).alias("chosen"))
    taken = pages.same_game_nearby(rows, ["conv_id"], "n", "games", "chosen")
    return taken.join(rows.select("conv_id", "n", "turn"), ["conv_id", "n"])


def _by_turn():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("turn")


@query(
    "name string, line string",
    """WITH r AS (SELECT lang AS name, count(*) AS n FROM documents GROUP BY lang)
        SELECT name, printf('| %s | %.4f | %+.4f |', name, CAST(n AS DOUBLE),
        CAST(n - (SELECT n FROM r WHERE name = 'en') AS DOUBLE)) AS line
        FROM r""",
)
def markdown_report(t: Tables) -> DataFrame:
    """A table of results with the difference to one of them."""
    counts = t("documents").groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return pages.markdown(counts, "name", "n", "en")


@query(
    "n bigint, sample string",
    """WITH p AS (SELECT unnest([1, 4, 30, 200]) AS n) SELECT n, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN 5 >= n THEN range(0,
        n) ELSE list_transform(range(1, 6), lambda i: CAST(round_even(n / CAST(6 AS DOUBLE) * i, 0) AS BIGINT)) END, range(0,
        least(n, 8))))), ',') AS sample FROM p""",
)
def census_pages(t: Tables) -> DataFrame:
    """Sampled pages and the first eight."""
    n = t.spark.range(1).select(F.explode(F.array(*map(F.lit, (1, 4, 30, 200)))).alias("n"))
    return n.select("n", F.array_join(pages.census_pages(F.col("n"), 5, 8, metrics.systematic_sample), ",").alias("sample"))


@query(
    "a bigint, b bigint, agreement double, collapsed boolean",
    f"""WITH s AS (SELECT o_orderkey, CASE WHEN {_WHOLE_SQL} THEN replace(x, '/', '') END AS s FROM ({_EXPANDED_SQL})),
    d AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b, CASE WHEN a.s IS NOT NULL AND b.s IS NOT NULL THEN len(list_filter(range(1, 65), lambda k: a.s[k] <> b.s[k])) END AS n
        FROM s a JOIN s b ON b.o_orderkey = a.o_orderkey + 1)
    SELECT a, b, (64 - n) / 64 AS agreement, n > COLLAPSED_AT AS collapsed FROM d""".replace("COLLAPSED_AT", str(pages.COLLAPSED)),
)
def reading_agreement(t: Tables) -> DataFrame:
    """How far the boards of successive orders agree."""
    f = _fens(t)
    one, two = f.select(F.col("o_orderkey").alias("a"), F.col("fen").alias("_a")), f.select(F.col("o_orderkey").alias("b"), F.col("fen").alias("_b"))
    s = pages.agreement(F.col("_a"), F.col("_b"))
    return one.join(two, F.col("b") == F.col("a") + 1).select("a", "b", s["agreement"].alias("agreement"), s["collapsed"].alias("collapsed"))
