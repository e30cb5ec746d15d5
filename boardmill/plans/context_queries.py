"""Contexts of diagrams on pages that are laid out from the line items: a page for each order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contexts
from .catalogue import Tables, query

# a line's text by its number's remainder, and what it says
_TEXTS = ["White to move", "Black to play and win", "No. 12", "Tal - Botvinnik, Moscow 1960", "Study by a friend", "■"]
_LAID = """x AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS line, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
        l AS (SELECT page, line, line // 2 AS g, (p + line) % 6 AS kind, 80.0 + p % 60 AS x0, 180.0 + p % 60 AS x1, 60.0 + (s * 37 + line * 91) % 620 AS y0, 70.0 + (s * 37 + line * 91) % 620 AS y1, q <= 25 AS short FROM x),
        b AS (SELECT o_orderkey AS page, i AS idx, 100.0 AS x0, 220.0 AS x1, 100.0 + 200 * i AS y0, 220.0 + 200 * i AS y1, o_orderkey % 7 AS m FROM orders, (SELECT unnest(range(3)) AS i))"""


def _laid_out(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines, boxes and margin lines of a page for each order."""
    line = F.expr("row_number() over (partition by page order by l_linenumber, l_partkey, l_suppkey, l_quantity)").cast("long")
    x = t("lineitem").withColumnRenamed("l_orderkey", "page").withColumn("line", line)  # dealt by page once, as the boxes are
    x = x.select("page", "line", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("block_words"))
    y = 60.0 + (F.col("s") * 37 + F.col("line") * 91) % 620
    text = F.get(F.array(*map(F.lit, _TEXTS)), ((F.col("p") + F.col("line")) % 6).cast("int"))
    lines = x.select("page", "line", F.expr("line div 2").alias("group_id"), text.alias("text"), (80.0 + F.col("p") % 60).alias("x0"), y.alias("y0"), (180.0 + F.col("p") % 60).alias("x1"), (y + 10).alias("y1"), "block_words", F.lit("text").alias("origin"), F.lit(1.0).alias("confidence"))
    key = F.col("o_orderkey").alias("page")
    boxes = t("orders").select(key, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("idx")).select("page", "idx", F.lit(100.0).alias("x0"), (100.0 + 200 * F.col("idx")).alias("y0"), F.lit(220.0).alias("x1"), (220.0 + 200 * F.col("idx")).alias("y1"))
    head = F.when(F.col("o_orderkey") % 7 < 2, F.array(F.lit("White to move"))).when(F.col("o_orderkey") % 7 == 2, F.array(F.lit("White to move"), F.lit("Black to move"))).otherwise(F.array(F.lit("Chapter 3")))
    margins = t("orders").select(key, F.posexplode(head).alias("line", "text"), F.lit("text").alias("origin"), F.lit(1.0).alias("confidence"))
    return lines, boxes, margins


@query(
    "page bigint, idx bigint, caption string, side string, side_origin string, exercise bigint, white string, black string, event string, year bigint",
    rf"""WITH {_LAID},
        r AS (SELECT b.page, b.idx, l.line, l.g, l.kind, l.short, l.y0, greatest(0.0, b.x0 - l.x1, l.x0 - b.x1) AS dx, greatest(0.0, b.y0 - l.y1, l.y0 - b.y1) AS dy,
              greatest(0.0, least(l.x1, b.x1) - greatest(l.x0, b.x0)) / 100.0 >= 0.25 AS across, l.y1 <= b.y0 AS up FROM b JOIN l ON l.page = b.page),
        n AS (SELECT page, idx, line, g, kind, short, y0, sqrt(dx * dx + dy * dy) AS d, CASE WHEN dx = 0 AND dy = 0 THEN 'overlapping' WHEN up THEN 'above' ELSE 'below' END AS side FROM r
              WHERE (across OR (dx = 0 AND dy = 0)) AND sqrt(dx * dx + dy * dy) <= 60),
        p AS (SELECT page, g, idx, min((d, line, side)) AS m FROM n GROUP BY ALL),
        q AS (SELECT page, g, idx, m[1] AS d, m[3] AS side FROM p),
        v AS (SELECT page, side, count(*) AS n, avg(d) AS d FROM (SELECT page, side, idx, min(d) AS d FROM q WHERE side IN ('above', 'below') GROUP BY ALL) GROUP BY ALL),
        w AS (SELECT page, arg_min(side, (-n, d, side)) AS side FROM v GROUP BY page),
        c AS (SELECT q.page, list({{'d': d, 'idx': idx, 'g': g}} ORDER BY d, idx, g) AS cs FROM q JOIN w ON w.page = q.page AND w.side = q.side GROUP BY q.page),
        t AS (SELECT page, unnest(list_reduce(list_prepend([], list_transform(cs, lambda z: [z])), lambda acc, z: CASE WHEN len(list_filter(acc, lambda y: y.idx = z[1].idx OR y.g = z[1].g)) = 0 THEN list_concat(acc, z) ELSE acc END)) AS z FROM c),
        h AS (SELECT page, z.idx AS idx, z.g AS g FROM t),
        a AS (SELECT page, g, idx, true AS own FROM h UNION ALL SELECT q.page, q.g, arg_min(q.idx, (q.d, q.idx)), false FROM q ANTI JOIN h ON h.page = q.page AND h.g = q.g GROUP BY q.page, q.g),
        e AS (SELECT n.*, own FROM n JOIN a ON a.page = n.page AND a.g = n.g AND a.idx = n.idx),
        f AS (SELECT *, bool_or(own) OVER (PARTITION BY page, idx) AS led, CASE WHEN kind = 0 THEN 'w' WHEN kind = 1 THEN 'b' WHEN kind = 5 AND short THEN 'b' END AS s FROM e),
        k AS (SELECT page, idx, string_agg(['White to move', 'Black to play and win', 'No. 12', 'Tal - Botvinnik, Moscow 1960', 'Study by a friend', '■'][kind + 1], chr(10) ORDER BY NOT own, d, y0, line) AS caption,
              CASE WHEN count(DISTINCT s) FILTER (own OR NOT led) = 1 THEN min(s) FILTER (own OR NOT led) WHEN count(DISTINCT s) FILTER (led AND NOT own) = 1 THEN min(s) FILTER (led AND NOT own) END AS side,
              bool_or(kind = 2 AND short) AS ex, bool_or(kind = 3 AND short) AS game FROM f GROUP BY page, idx)
        SELECT b.page, b.idx, coalesce(caption, '') AS caption, coalesce(side, CASE WHEN m < 2 THEN 'w' END) AS side,
            CASE WHEN side IS NOT NULL THEN 'text' WHEN m < 2 THEN 'text-page-scope' END AS side_origin, CASE WHEN ex THEN 12 END AS exercise,
            CASE WHEN game THEN 'Tal' END AS white, CASE WHEN game THEN 'Botvinnik' END AS black, CASE WHEN game THEN 'Tal - Botvinnik, Moscow' END AS event, CASE WHEN game THEN 1960 END AS year
        FROM b LEFT JOIN k ON k.page = b.page AND k.idx = b.idx""",
)
def diagram_contexts(t: Tables) -> DataFrame:
    """Captions, sides, exercises, players and events of three diagrams on each page."""
    lines, boxes, margins = _laid_out(t)
    return contexts.page_contexts(lines, boxes, ["page"], margins)
