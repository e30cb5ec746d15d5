"""Similarity, boxes, run comparison, boards and captions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import board, decode, replay, text
from ..operators import similarity
from .catalogue import Tables, query

_SIGNATURE_SQL = "SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS s FROM embeddings"


def _signatures(t: Tables) -> DataFrame:
    """Vectors as one word of the signs of their numbers."""
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    word = F.shiftleft(F.conv(F.substring(bits, 1, 32), 2, 10).cast("bigint"), 32).bitwiseOR(F.conv(F.substring(bits, 33, 32), 2, 10).cast("bigint"))
    return t("embeddings").select("vec_id", "label", F.array(word).alias("words"))


@query(
    "label bigint, a bigint, b bigint, distance bigint",
    f"""WITH v AS ({_SIGNATURE_SQL}), p AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(list_zip(x.s,
        y.s), lambda z: abs(z[1] - z[2]))) AS distance FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id)
        SELECT * FROM p WHERE distance <= 20""",
)
def near_dup_pairs(t: Tables) -> DataFrame:
    """Pairs of one label whose signatures differ in few bits."""
    return similarity.near_pairs(_signatures(t), "vec_id", "label", "words", 20)


_NEAREST_SQL = f"""WITH v AS ({_SIGNATURE_SQL}), p AS (SELECT x.vec_id, y.vec_id AS row_id, y.label, list_sum(list_transform(list_zip(x.s, y.s), lambda z: abs(z[1] - z[2]))) AS d FROM v x, v y WHERE x.vec_id % 50 = 0 AND y.vec_id <> x.vec_id),
    b AS (SELECT vec_id, min((d, row_id)) AS m FROM p GROUP BY vec_id), c AS (SELECT p.vec_id, p.row_id, p.label, p.d FROM p JOIN b ON b.vec_id = p.vec_id AND (p.d, p.row_id) = b.m)
    SELECT c.vec_id, c.row_id, c.label, c.d AS distance, (SELECT min(q.d) FROM p q WHERE q.vec_id = c.vec_id AND q.label <> c.label) AS runner_up FROM c"""


@query(
    "vec_id bigint, row_id bigint, label bigint, distance bigint, runner_up bigint, ambiguous boolean",
    f"""SELECT *, coalesce(runner_up - distance < 4, false) AS ambiguous
        FROM ({_NEAREST_SQL})""",
)
def hamming_nn(t: Tables) -> DataFrame:
    """Queries (ids divisible by 50) against all other rows: nearest, and the nearest of another label."""
    v = _signatures(t)
    return similarity.nearest(v.where("vec_id % 50 = 0").drop("label"), v.withColumnRenamed("vec_id", "row_id"), "vec_id", "row_id", "label", "words", None, apart=True)


@query("vec_id bigint, row_id bigint, distance bigint", f"SELECT vec_id, row_id, distance FROM ({_NEAREST_SQL}) WHERE distance <= 18")
def hamming_nn_banded(t: Tables) -> DataFrame:
    """The same within 18 bits, through bands that near rows must share."""
    v = _signatures(t)
    return similarity.nearest(v.where("vec_id % 50 = 0").drop("label"), v.withColumnRenamed("vec_id", "row_id"), "vec_id", "row_id", "label", "words", 18, apart=True)


def _boxes(t: Tables) -> DataFrame:
    """Parts as boxes on pages of their brand and size."""
    k = F.col("p_partkey")
    x, y, side = (k * 37 % 400).cast("double"), (k * 91 % 600).cast("double"), (F.lit(40) + k % 80).cast("double")
    return t("part").select(F.concat_ws("/", "p_brand", "p_size").alias("page"), k.cast("int").alias("idx"), x.alias("x0"), y.alias("y0"), (x + side).alias("x1"), (y + side).alias("y1"), side.alias("side_pt"), ((k * 53 % 100) / F.lit(100.0)).alias("score"))


_BOXES_SQL = "SELECT p_brand || '/' || p_size AS page, p_partkey AS idx, CAST(p_partkey * 37 % 400 AS DOUBLE) AS x0, CAST(p_partkey * 91 % 600 AS DOUBLE) AS y0, CAST(p_partkey * 37 % 400 + 40 + p_partkey % 80 AS DOUBLE) AS x1, CAST(p_partkey * 91 % 600 + 40 + p_partkey % 80 AS DOUBLE) AS y1 FROM part"


@query(
    "page string, idx bigint, position bigint",
    f"""SELECT page, idx, row_number() OVER (PARTITION BY page ORDER BY y0, x0, idx) - 1 AS position
        FROM ({_BOXES_SQL})""",
)
def reading_order_rows(t: Tables) -> DataFrame:
    """Boxes in rows."""
    return similarity.reading_order(_boxes(t), ["page"], "row")


@query(
    "page string, idx bigint, position bigint",
    f"""WITH RECURSIVE b AS (SELECT *, (x0 + x1) / 2 AS c, greatest(8, 0.55 * median(x1 - x0) OVER (PARTITION BY page)) AS reach FROM ({_BOXES_SQL})),
    r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY c, y0, idx) AS n FROM b),
    z AS (SELECT page, n, idx, x0, y0, 1 AS col, c AS total, 1 AS held FROM r WHERE n = 1
        UNION ALL SELECT r.page, r.n, r.idx, r.x0, r.y0,
            CASE WHEN abs(r.c - total / held) <= reach THEN col ELSE col + 1 END, CASE WHEN abs(r.c - total / held) <= reach THEN total + r.c ELSE r.c END,
            CASE WHEN abs(r.c - total / held) <= reach THEN held + 1 ELSE 1 END
            FROM z JOIN r ON r.page = z.page AND r.n = z.n + 1)
    SELECT page, idx, row_number() OVER (PARTITION BY page ORDER BY col, y0, x0, idx) - 1 AS position FROM z""",
)
def reading_order_columns(t: Tables) -> DataFrame:
    """Boxes in columns that their centres make."""
    return similarity.reading_order(_boxes(t), ["page"])


@query(
    "page string, idx bigint, band bigint",
    f"""WITH b AS (SELECT *, max(x1) OVER (PARTITION BY page ORDER BY x0, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
        FROM ({_BOXES_SQL})) SELECT page, idx, sum(CASE WHEN x0 >= m THEN 1 ELSE 0 END) OVER (PARTITION BY page
        ORDER BY x0, idx) AS band FROM b""",
)
def page_columns(t: Tables) -> DataFrame:
    """Boxes in columns that don't overlap."""
    return similarity.columns_of(_boxes(t), ["page"]).withColumnRenamed("column", "band")


_SCORED_SQL = f"SELECT *, CAST(idx * 53 % 100 AS DOUBLE) / 100.0 AS score FROM ({_BOXES_SQL})"
_IOU_SQL = """(greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))
    / (({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0) + ({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0)
    - greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))))"""


def greedy_sql(refuse: str) -> str:
    """(page, idx, reason) of scored boxes taken by falling score, each refused for a reason or kept; z.kept has those kept before."""
    return f"""WITH RECURSIVE r AS (SELECT *, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} AS box, row_number() OVER (PARTITION BY page ORDER BY score DESC, idx) AS n, max(score) OVER (PARTITION BY page) AS top,
        max((x1 - x0) * (y1 - y0)) OVER (PARTITION BY page) AS largest FROM ({_SCORED_SQL})),
    z AS (SELECT page, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS idx, '' AS reason, [box][2:] AS kept FROM r WHERE n = 1
        UNION ALL SELECT page, n, idx, reason, CASE WHEN reason = '' THEN list_append(kept, box) ELSE kept END
            FROM (SELECT r.page, r.n, r.idx, r.box, z.kept, {refuse} AS reason FROM z JOIN r ON r.page = z.page AND r.n = z.n + 1))
    SELECT page, idx, reason FROM z WHERE idx IS NOT NULL"""


@query(
    "page string, idx bigint, kept boolean, reason string",
    "SELECT page, idx, reason = '' AS kept, reason FROM ("
    + greedy_sql(
        f"""CASE WHEN r.score < greatest(0.06, 0.25 * r.top) THEN 'low_score'
        WHEN len(list_filter(z.kept, lambda k: {_IOU_SQL.format(a="r.box", b="k")} > 0.25)) > 0 THEN 'overlap' WHEN len(z.kept) >= 12 THEN 'limit' ELSE '' END"""
    )
    + ")",
)
def suppress_boxes(t: Tables) -> DataFrame:
    """Greedy suppression of overlapping boxes."""
    return similarity.suppress(_boxes(t), ["page"])


@query(
    "page string, x0 double, y0 double, x1 double, y1 double, tiles bigint",
    f"""WITH RECURSIVE b AS ({_BOXES_SQL}),
    e AS (SELECT a.page, a.idx AS u, b.idx AS v FROM b a JOIN b ON b.page = a.page AND greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 2 AND greatest(a.y0, b.y0) - least(a.y1, b.y1) <= 2),
    r AS (SELECT page, idx AS u, idx AS root FROM b UNION SELECT e.page, e.v, r.root FROM r JOIN e ON e.page = r.page AND e.u = r.u),
    m AS (SELECT page, u, min(root) AS root FROM r GROUP BY page, u)
    SELECT b.page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS tiles FROM b JOIN m ON m.page = b.page AND m.u = b.idx GROUP BY b.page, m.root""",
)
def tile_merge(t: Tables) -> DataFrame:
    """Touching boxes as one."""
    return similarity.merge_tiles(_boxes(t), ["page"])


@query(
    "page string, annotation bigint, reading bigint, iou double",
    f"""WITH RECURSIVE b AS ({_BOXES_SQL}),
    m AS (SELECT page, idx + 1000000000 AS idx, x0 + idx % 13 AS x0, y0 + idx % 13 AS y0, x1 + idx % 13 AS x1, y1 + idx % 13 AS y1 FROM b),
    p AS (SELECT b.page, b.idx AS a, m.idx AS c, {_IOU_SQL.format(a="b", b="m")} AS iou FROM b JOIN m ON m.page = b.page),
    r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY iou DESC, a DESC, c DESC) AS n FROM p WHERE iou >= 0.5),
    z AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS c, CAST(NULL AS DOUBLE) AS iou, false AS taken, CAST([] AS BIGINT[]) AS used FROM r
        UNION ALL SELECT page, n, a, c, iou, free, CASE WHEN free THEN list_concat(used, [a, c]) ELSE used END
            FROM (SELECT r.page, r.n, r.a, r.c, r.iou, z.used, NOT list_contains(z.used, r.a) AND NOT list_contains(z.used, r.c) AS free FROM z JOIN r ON r.page = z.page AND r.n = z.n + 1))
    SELECT page, a AS annotation, c AS reading, iou FROM z WHERE taken""",
)
def iou_match(t: Tables) -> DataFrame:
    """Boxes against boxes moved a little, one to one."""
    b = _boxes(t)
    moved = b.select("page", (F.col("idx") + 1_000_000_000).alias("idx"), *[(F.col(c) + F.col("idx") % 13).alias(c) for c in similarity.BOX])
    return similarity.match_boxes(b, moved, ["page"])


def _runs(t: Tables) -> DataFrame:
    b, k = _boxes(t), F.col("idx")
    keyed = lambda d: d.withColumn("rx", F.bround("x0", 0)).withColumn("ry", F.bround("y0", 0))
    after = b.where(k % 7 != 0).select("page", "side_pt", *[F.when(k % 5 == 0, F.col(c) + 3).otherwise(F.col(c)).alias(c) for c in similarity.BOX])
    return similarity.diff_runs(keyed(b.where(k % 11 != 0)), keyed(after), ["page", "rx", "ry"], ["page"])


@query(
    "page string, change string, suspect boolean, a_x0 double, a_y0 double, b_x0 double, b_y0 double",
    f"""WITH RECURSIVE b AS ({_BOXES_SQL}), o AS (SELECT * FROM b WHERE idx % 11 <> 0),
    a AS (SELECT page, idx, x0 + d AS x0, y0 + d AS y0, x1 + d AS x1, y1 + d AS y1, x1 - x0 AS side FROM (SELECT *, CASE WHEN idx % 5 = 0 THEN 3 ELSE 0 END AS d FROM b WHERE idx % 7 <> 0)),
    l AS (SELECT o.*, x1 - x0 AS side, row_number() OVER (PARTITION BY page ORDER BY y0, x0) AS n FROM o ANTI JOIN a USING (page, x0, y0)),
    g AS (SELECT a.*, row_number() OVER (PARTITION BY page ORDER BY y0, x0) AS j FROM a ANTI JOIN o USING (page, x0, y0)),
    c AS (SELECT l.page, l.n, list({{'iou': {_IOU_SQL.format(a="l", b="g")}, 'j': g.j}} ORDER BY {_IOU_SQL.format(a="l", b="g")} DESC, g.j DESC) AS found
        FROM l JOIN g ON g.page = l.page AND {_IOU_SQL.format(a="l", b="g")} >= 0.5 GROUP BY l.page, l.n),
    r AS (SELECT l.page, l.n, c.found FROM l LEFT JOIN c ON c.page = l.page AND c.n = l.n),
    z AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS j, CAST([] AS BIGINT[]) AS used FROM r
        UNION ALL SELECT page, n, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END
            FROM (SELECT r.page, r.n, z.used, list_filter(r.found, lambda f: NOT list_contains(z.used, f.j))[1].j AS pick FROM z JOIN r ON r.page = z.page AND r.n = z.n + 1))
    SELECT l.page, CASE WHEN z.j IS NULL THEN 'lost' ELSE 'moved' END AS change, l.side < 72 AS suspect, l.x0 AS a_x0, l.y0 AS a_y0, g.x0 AS b_x0, g.y0 AS b_y0
        FROM l JOIN z ON z.page = l.page AND z.n = l.n LEFT JOIN g ON g.page = z.page AND g.j = z.j
    UNION ALL SELECT g.page, 'gained', g.side < 72, NULL, NULL, g.x0, g.y0 FROM g ANTI JOIN (SELECT page, j FROM z WHERE j IS NOT NULL) USING (page, j)""",
)
def diff_runs(t: Tables) -> DataFrame:
    """Boxes lost, gained and moved between two runs."""
    return _runs(t)


@query(
    "lost bigint, gained bigint",
    f"""WITH b AS ({_BOXES_SQL}), o AS (SELECT page, x0, y0 FROM b WHERE idx % 11 <> 0), n AS (SELECT page, CASE WHEN idx % 5 = 0 THEN x0 + 3 ELSE x0 END AS x0, CASE WHEN idx % 5 = 0 THEN y0 + 3 ELSE y0 END AS y0 FROM b WHERE idx % 7 <> 0)
    SELECT (SELECT count(*) FROM (SELECT o.page FROM o ANTI JOIN n USING (page, x0, y0))) AS lost, (SELECT count(*) FROM (SELECT n.page FROM n ANTI JOIN o USING (page, x0, y0))) AS gained""",
)
def diff_runs_counts(t: Tables) -> DataFrame:
    """Rows of one run only: a moved box counts on both sides."""
    return _runs(t).agg(F.count_if(F.col("change").isin("lost", "moved")).alias("lost"), F.count_if(F.col("change").isin("gained", "moved")).alias("gained"))


@query(
    "page string, point bigint, idx bigint",
    f"""WITH b AS ({_BOXES_SQL}), p AS (SELECT page, idx AS point, x0 + 25 AS x, y0 + 25 AS y
        FROM b) SELECT p.page, p.point, arg_min(b.idx, ((x1 - x0) * (y1 - y0),
        b.idx)) AS idx FROM p JOIN b ON b.page = p.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1
        GROUP BY 1, 2""",
)
def hit_test(t: Tables) -> DataFrame:
    """The smallest box under each point."""
    b = _boxes(t)
    return similarity.hit_test(b, b.select("page", F.col("idx").alias("point"), (F.col("x0") + 25).alias("x"), (F.col("y0") + 25).alias("y")), ["page"])


@query(
    "page string, group_id bigint, idx bigint",
    f"""WITH b AS ({_BOXES_SQL}), l AS (SELECT page, idx AS line, idx % 100000 AS g, x0, y1 + 4 AS y0, x1, y1 + 14 AS y1 FROM b),
        r AS (SELECT b.page, l.line, l.g, b.idx, greatest(0, b.x0 - l.x1, l.x0 - b.x1) AS dx, greatest(0, b.y0 - l.y1, l.y0 - b.y1) AS dy,
            greatest(0, least(l.x1, b.x1) - greatest(l.x0, b.x0)) / least(l.x1 - l.x0, b.x1 - b.x0) >= 0.25 AS across, greatest(0, least(l.y1, b.y1) - greatest(l.y0, b.y0)) / least(l.y1 - l.y0, b.y1 - b.y0) >= 0.25 AS along,
            l.y1 <= b.y0 AS up, l.y0 >= b.y1 AS down, l.x1 <= b.x0 AS before, l.x0 >= b.x1 AS after FROM b JOIN l ON l.page = b.page),
        n AS (SELECT page, line, g, idx, sqrt(dx * dx + dy * dy) AS d, CASE WHEN dx = 0 AND dy = 0 THEN 'overlapping' WHEN across AND up THEN 'above' WHEN across AND down THEN 'below' WHEN along AND before THEN 'left' WHEN along AND after THEN 'right' END AS side FROM r),
        q AS (SELECT page, g, idx, min((d, line, side)) AS m FROM n WHERE side IS NOT NULL AND d <= 60 GROUP BY ALL),
        p AS (SELECT page, g, idx, m[1] AS d, m[3] AS side FROM q),
        v AS (SELECT page, side, count(*) AS n, avg(d) AS d FROM (SELECT page, side, idx, min(d) AS d FROM p WHERE side IN ('above', 'below') GROUP BY ALL) GROUP BY ALL),
        w AS (SELECT page, arg_min(side, (-n, d, side)) AS side FROM v GROUP BY page),
        c AS (SELECT p.page, list({{'d': d, 'idx': idx, 'g': g}} ORDER BY d, idx, g) AS cs FROM p JOIN w ON w.page = p.page AND w.side = p.side GROUP BY p.page),
        t AS (SELECT page, unnest(list_reduce(list_prepend([], list_transform(cs, lambda z: [z])), lambda acc, z: CASE WHEN len(list_filter(acc, lambda y: y.idx = z[1].idx OR y.g = z[1].g)) = 0 THEN list_concat(acc, z) ELSE acc END)) AS z FROM c),
        h AS (SELECT page, z.g AS g, z.idx AS idx FROM t)
        SELECT page, g AS group_id, idx FROM h UNION ALL SELECT p.page, p.g, arg_min(p.idx, (p.d, p.idx)) FROM p ANTI JOIN h ON h.page = p.page AND h.g = p.g GROUP BY p.page, p.g""",
)
def spatial_assign(t: Tables) -> DataFrame:
    """Lines under and over boxes, each group to one box."""
    b, k = _boxes(t), F.col("idx")
    lines = b.select("page", k.alias("line"), (k % 100_000).alias("group_id"), F.col("x0"), (F.col("y1") + 4).alias("y0"), F.col("x1"), (F.col("y1") + 14).alias("y1"))
    return similarity.assign_lines(lines, b, ["page"])


# Ranks that made-up boards are put together from, one for each hex digit of a key's md5; one is malformed.
_RANKS = ["8", "8", "8", "8", "pppppppp", "PPPPPPPP", "rnbqkbnr", "RNBQKBNR", "4k3", "3K4", "R3K2R", "r3k2r", "2q2Q2", "9", "1P1p1P1p", "n6N"]
_RANKS_SQL = "[" + ", ".join(f"'{r}'" for r in _RANKS) + "]"
_FENS_SQL = f"""SELECT o_orderkey, array_to_string(list_transform(range(1, 9), lambda i: {_RANKS_SQL}[position(md5(CAST(o_orderkey AS VARCHAR))[i] IN '0123456789abcdef')]), '/') AS fen FROM orders"""
_SQUARES_SQL = "replace(replace(replace(replace(replace(replace(replace(replace(fen, '8', '........'), '7', '.......'), '6', '......'), '5', '.....'), '4', '....'), '3', '...'), '2', '..'), '1', '.')"
_EXPANDED_SQL = f"SELECT o_orderkey, fen, {_SQUARES_SQL} AS x FROM ({_FENS_SQL})"
_WHOLE_SQL = "regexp_matches(x, '^([.PNBRQKpnbrqk]{8}/){7}[.PNBRQKpnbrqk]{8}$')"


def _fens(t: Tables) -> DataFrame:
    """A made-up board for each order."""
    digit = lambda k: F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), k, 1), 16, 10).cast("int")
    return t("orders").select("o_orderkey", F.concat_ws("/", *[F.get(F.array(*map(F.lit, _RANKS)), digit(k)) for k in range(1, 9)]).alias("fen"))


@query(
    "o_orderkey bigint, fen string, squares string, again string, castling string",
    f"""WITH s AS (SELECT o_orderkey, fen, CASE WHEN {_WHOLE_SQL} THEN replace(x, '/', '') END AS s FROM ({_EXPANDED_SQL}))
    SELECT o_orderkey, fen, s AS squares, CASE WHEN s IS NOT NULL THEN fen END AS again,
        CASE WHEN s IS NULL THEN NULL ELSE coalesce(nullif(
            CASE WHEN s[61] = 'K' AND s[64] = 'R' THEN 'K' ELSE '' END || CASE WHEN s[61] = 'K' AND s[57] = 'R' THEN 'Q' ELSE '' END ||
            CASE WHEN s[5] = 'k' AND s[8] = 'r' THEN 'k' ELSE '' END || CASE WHEN s[5] = 'k' AND s[1] = 'r' THEN 'q' ELSE '' END, ''), '-') END AS castling FROM s""",
)
def fen_roundtrip(t: Tables) -> DataFrame:
    """Placements to 64 squares and back, and what castling their home squares allow."""
    squares = board.square_text("fen")
    castling = F.when(squares.isNotNull(), board.castling_rights("fen"))
    return _fens(t).select("o_orderkey", "fen", squares.alias("squares"), board.fen_of_squares(squares).alias("again"), castling.alias("castling"))


@query(
    "a bigint, b bigint, n bigint",
    f"""WITH s AS (SELECT o_orderkey, replace(x, '/', '') AS s FROM ({_EXPANDED_SQL}) WHERE {_WHOLE_SQL})
    SELECT a.o_orderkey AS a, b.o_orderkey AS b, len(list_filter(range(1, 65), lambda k: a.s[k] <> b.s[k])) AS n FROM s a JOIN s b ON b.o_orderkey = a.o_orderkey + 1""",
)
def disputed_squares(t: Tables) -> DataFrame:
    """How many squares the boards of successive orders dispute."""
    f = _fens(t).where(board.is_syntactic("fen"))
    one, two = f.select(F.col("o_orderkey").alias("a"), F.col("fen").alias("_a")), f.select(F.col("o_orderkey").alias("b"), F.col("fen").alias("_b"))
    return one.join(two, F.col("b") == F.col("a") + 1).select("a", "b", F.size(board.disputed_squares("_a", "_b")).alias("n"))


@query("o_orderkey bigint, status bigint, legal boolean, fatal boolean, legal_turn string")
def position_legality(t: Tables) -> DataFrame:
    """Faults of positions and the side whose turn is legal."""
    c = replay.check_positions(_fens(t), "fen")
    return c.select("o_orderkey", "check.status", "check.legal", "check.fatal", "check.legal_turn")


_GAMES_SQL = f"""
    WITH f AS (SELECT o_orderkey, f, md5(o_orderkey || 'w' || f) AS hw, md5(o_orderkey || 'b' || f) AS hb FROM orders, (SELECT unnest(range(8)) AS f)),
    m AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY hw) AS wn, row_number() OVER (PARTITION BY o_orderkey ORDER BY hb) AS bn FROM f),
    p AS (SELECT o_orderkey, ply, f, wn <= (ply + 1) // 2 AS w, bn <= ply // 2 AS b, hw[1] >= '8' AS w2, hb[1] >= '8' AS b2 FROM m, (SELECT unnest(range(1, 17)) AS ply)),
    r AS (SELECT o_orderkey, ply,
        string_agg(CASE WHEN b THEN '.' ELSE 'p' END, '' ORDER BY f) || '/' || string_agg(CASE WHEN b AND NOT b2 THEN 'p' ELSE '.' END, '' ORDER BY f) || '/' ||
        string_agg(CASE WHEN b AND b2 THEN 'p' ELSE '.' END, '' ORDER BY f) || '/' || string_agg(CASE WHEN w AND w2 THEN 'P' ELSE '.' END, '' ORDER BY f) || '/' ||
        string_agg(CASE WHEN w AND NOT w2 THEN 'P' ELSE '.' END, '' ORDER BY f) || '/' || string_agg(CASE WHEN w THEN '.' ELSE 'P' END, '' ORDER BY f) AS x
        FROM p GROUP BY o_orderkey, ply),
    c AS MATERIALIZED (SELECT o_orderkey, ply, 'rnbqkbnr/' || replace(replace(replace(replace(replace(replace(replace(replace(x,
        '........', '8'), '.......', '7'), '......', '6'), '.....', '5'), '....', '4'), '...', '3'), '..', '2'), '.', '1') || '/RNBQKBNR' AS placement FROM r)"""


def _pawn_moves(side: str) -> Column:
    """The files in the order in which a side's pawns move: struct(hash, file)."""
    return F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda f: F.struct(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(side), f.cast("string")).cast("binary")).alias("h"), f.alias("f"))))


def _pawn_game(t: Tables, *more: Column) -> DataFrame:
    """A game for each order, no two alike: both sides move their pawns, one or two steps, in an order of their own."""
    file = lambda m: F.substr(F.lit("abcdefgh"), m.f + 1, F.lit(1))
    white = lambda m: F.concat(file(m), F.when(m.h >= "8", "4").otherwise("3"))
    black = lambda m: F.concat(file(m), F.when(m.h >= "8", "5").otherwise("6"))
    note = F.when(F.col("o_orderkey") % 3 == 0, " {held} (1. Nf3 d5 (1... c5) 2. g3)").otherwise("")
    pairs = F.zip_with("w", "b", lambda w, b: F.concat(white(w), F.lit(" "), black(b)))
    numbered = F.transform(pairs, lambda m, k: F.concat((k + 1).cast("string"), F.lit(". "), m, F.when(k == 2, note).otherwise("")))
    games = t("orders").select("o_orderkey", *more, _pawn_moves("w").alias("w"), _pawn_moves("b").alias("b"))
    return games.withColumn("movetext", F.concat_ws(" ", numbered))


def _after_three_moves() -> Column:
    """A game's placement after three moves of each side, spelled without replaying it."""
    files = F.sequence(F.lit(0), F.lit(7))

    def rank(moves: str, letter: str, stays: bool, far: bool) -> Column:
        done = F.slice(moves, 1, 3)
        there = lambda f: F.exists(done, lambda m: (m.f == f) & ((m.h >= "8") == F.lit(far)))
        moved = lambda f: F.exists(done, lambda m: m.f == f)
        return F.array_join(F.transform(files, lambda f: F.when(~moved(f) if stays else there(f), letter).otherwise(".")), "")

    ranks = [rank("b", "p", True, False), rank("b", "p", False, False), rank("b", "p", False, True), rank("w", "P", False, True), rank("w", "P", False, False), rank("w", "P", True, False)]
    return board.fen_of_squares(F.concat(F.lit("rnbqkbnr"), *ranks, F.lit("RNBQKBNR")))


@query(
    "o_orderkey bigint, ply bigint, placement string, move_number bigint, white_to_move boolean",
    f"""{_GAMES_SQL} SELECT o_orderkey, ply, placement, 1 + ply // 2 AS move_number, ply % 2 = 0 AS white_to_move
    FROM c WHERE placement IN (SELECT placement FROM c WHERE ply = 6 AND o_orderkey % 50 = 0)""",
)
def replay_search(t: Tables) -> DataFrame:
    """All games replayed to the positions that those of every fiftieth order had after three moves of each side."""
    games = _pawn_game(t)
    wanted = games.where("o_orderkey % 50 = 0").select(_after_three_moves().alias("placement")).distinct()
    # replaying is all the work, so games of a few files are dealt to every core first
    dealt = games.select("o_orderkey", "movetext", F.lit(None).cast("string").alias("setup_fen")).repartition(t.spark.sparkContext.defaultParallelism)
    return replay.replay(dealt, ["o_orderkey"], wanted=wanted)


@query(
    "vec_id bigint, squares string, changed bigint, solved boolean",
    """SELECT vec_id, repeat('.', i) || 'K' || repeat('.', j - i - 1) || 'k' || repeat('.', 63 - j) AS squares, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END AS changed, true AS solved
    FROM (SELECT vec_id, CAST(vec_id % 24 + 8 AS INTEGER) AS i, CAST(vec_id % 23 + 33 AS INTEGER) AS j FROM embeddings)""",
)
def decode_board(t: Tables) -> DataFrame:
    """Boards of two kings from class probabilities; every other white king was read as a queen, and comes back."""
    i, j, misread = F.col("vec_id") % 24 + 8, F.col("vec_id") % 23 + 33, F.col("vec_id") % 2 == 0
    true = lambda k: F.when(k == i, "K").when(k == j, "k").otherwise(".")

    def chance(k: Column, c: Column) -> Column:
        seen = F.when((true(k) == "K") & misread, "Q").otherwise(true(k))
        return F.when(c == seen, F.when(seen == "Q", 0.5).otherwise(0.8)).when(c == true(k), 0.4).otherwise(0.01)

    p = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.transform(F.array(*map(F.lit, board.LETTERS)), lambda c: chance(k, c))))
    return decode.decode_boards(t("embeddings").select("vec_id", p.alias("p")), ["vec_id"], "p")


@query("doc_id bigint, folded string", "SELECT doc_id, sha256(lower(strip_accents(trim(regexp_replace(replace(text, 'ß', 'ss'), '\\s+', ' ', 'g'))))) AS folded FROM documents")
def text_fold(t: Tables) -> DataFrame:
    """Texts without marks, in lower case."""
    return t("documents").select("doc_id", F.sha2(text.fold("text"), 256).alias("folded"))


_NAMES_SQL = """SELECT c_custkey, CASE c_custkey % 5
    WHEN 0 THEN c_mktsegment || 'é, ' || c_name WHEN 1 THEN 'J. R. ' || c_mktsegment WHEN 2 THEN 'Groß–' || c_mktsegment || ' ,K'
    WHEN 3 THEN 'A van  ' || c_mktsegment ELSE upper(substr(c_mktsegment, 1, 1)) || '.' END AS name FROM customer"""


@query(
    "c_custkey bigint, name string, surname string",
    f"""WITH f AS (SELECT *, trim(split_part(replace(strip_accents(lower(replace(regexp_replace(name, '\\s+', ' ', 'g'), 'ß', 'ss'))), '–', '-'), ',', 1)) AS s FROM ({_NAMES_SQL}))
    SELECT c_custkey, name, CASE WHEN regexp_full_match(s, '\\S+\\.') THEN s ELSE regexp_replace(s, '^((\\S+\\.|\\S) )+', '') END AS surname FROM f""",
)
def surname(t: Tables) -> DataFrame:
    """Names, made of customers' segments, to the folded surnames that are compared."""
    k, s = F.col("c_custkey") % 5, F.col("c_mktsegment")
    name = F.when(k == 0, F.concat(s, F.lit("é, "), F.col("c_name"))).when(k == 1, F.concat(F.lit("J. R. "), s)).when(k == 2, F.concat(F.lit("Groß–"), s, F.lit(" ,K")))
    name = name.when(k == 3, F.concat(F.lit("A van  "), s)).otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.lit(".")))
    return t("customer").select("c_custkey", name.alias("name")).withColumn("surname", text.surname("name"))


# What the captions of parts say, and the side that each says is to move.
_SAID = [("Brancas jogam", "w"), ("Jogada de pretas", "b"), ("If white to move, draw", None), ("Black to move and White to play", None), ("■", "b"), ("Weiß am Zug", "w"), ("White wins", None), ("◽ see below", "w")]
_CAPTIONS_SQL = f"""SELECT p_partkey, p_partkey % 8 AS k, CASE WHEN p_partkey % 3 = 0 THEN p_size || '. ' || said ELSE said END || chr(10) ||
    'Alekhine - ' || p_type || ', ' || p_brand || ' ' || (1900 + p_size) AS caption, said, side, p_type, p_brand, p_size
    FROM part JOIN (VALUES {', '.join(f"({k}, '{s}', {'NULL' if c is None else repr(c)})" for k, (s, c) in enumerate(_SAID))}) v(k, said, side) ON v.k = p_partkey % 8"""


@query(
    "p_partkey bigint, caption string, side string, exercise bigint, white string, black string, event string, year bigint",
    f"""SELECT p_partkey, caption, side, CASE WHEN p_partkey % 3 = 0 AND said <> '■' OR p_partkey % 3 = 0 THEN p_size END AS exercise, 'Alekhine' AS white, p_type AS black,
    'Alekhine - ' || p_type || ', ' || p_brand AS event, 1900 + p_size AS year FROM ({_CAPTIONS_SQL})""",
)
def caption_parse(t: Tables) -> DataFrame:
    """Captions of two lines to side, exercise number, players, event and year."""
    said = F.get(F.array(*[F.lit(s) for s, _ in _SAID]), (F.col("p_partkey") % 8).cast("int"))
    first = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(". "), said)).otherwise(said)
    second = F.concat(F.lit("Alekhine - "), F.col("p_type"), F.lit(", "), F.col("p_brand"), F.lit(" "), (F.col("p_size") + 1900).cast("string"))
    captions = t("part").select("p_partkey", F.concat(first, F.lit("\n"), second).alias("caption"))
    return captions.withColumn("c", text.caption_context("caption")).select("p_partkey", "caption", "c.side", "c.exercise", "c.white", "c.black", "c.event", "c.year")


@query(
    "event_id bigint, spelled string, share string",
    """SELECT event_id, replace(format('{:,}', event_id * 1000 + 7),
        ',', '.') AS spelled, replace(format('{:.1f}', CAST(event_id % 1000 AS DOUBLE) / 10),
        '.', ',') || '%' AS share FROM events""",
)
def number_formats(t: Tables) -> DataFrame:
    """Numbers with points between thousands and percentages with a comma."""
    return t("events").select("event_id", text.thousands(F.col("event_id") * 1000 + 7).alias("spelled"), text.percent((F.col("event_id") % 1000) / F.lit(1000.0)).alias("share"))
