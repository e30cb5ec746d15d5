"""Chosen games, confirmations, run totals and look-ups on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import board
from ..operators import gallery, merges
from .catalogue import Tables, query
from .layout_queries import _GAMES_SQL, _after_three_moves, _pawn_game

_BATCH_SQL = """SELECT o_orderkey, o_custkey % 97 AS book, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'failed' ELSE 'skipped' END AS status,
    o_orderkey % 7 AS accepted, o_orderkey % 3 AS needs_review, o_orderkey % 2 AS rejected, CAST(o_custkey AS DOUBLE) / 4 AS elapsed_s FROM orders"""


def _batch(t: Tables) -> DataFrame:
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    named = F.when(status == "F", "ok").when(status == "O", "failed").otherwise("skipped")
    return t("orders").select((F.col("o_custkey") % 97).alias("book"), named.alias("status"), (k % 7).alias("accepted"), (k % 3).alias("needs_review"), (k % 2).alias("rejected"), (F.col("o_custkey") / 4.0).alias("elapsed_s"))


@query(
    "processed bigint, failed bigint, accepted bigint, needs_review bigint, rejected bigint, elapsed_s double",
    f"""SELECT count(*) FILTER (status = 'ok') AS processed, count(*) FILTER (status = 'failed') AS failed, sum(accepted) AS accepted,
    sum(needs_review) AS needs_review, sum(rejected) AS rejected, round(sum(elapsed_s), 2) AS elapsed_s FROM ({_BATCH_SQL})""",
)
def batch_totals(t: Tables) -> DataFrame:
    """What a batch of books came to."""
    return gallery.batch_totals(_batch(t))


@query(
    "label bigint, mean double",
    """SELECT label, round(avg(CASE WHEN vec_id % 4 = 0 THEN 0 ELSE vec_id % 100 / 100.0 END),
        9) AS mean FROM embeddings GROUP BY label""",
)
def mean_confidence(t: Tables) -> DataFrame:
    """The mean confidence of all positions of a book; a quarter of them have none."""
    value = F.when(F.col("vec_id") % 4 != 0, (F.col("vec_id") % 100) / F.lit(100.0))
    return gallery.mean_confidence(t("embeddings").select("label", value.alias("min_confidence")), ["label"]).select("label", F.round("mean", 9).alias("mean"))


@query(
    "pages bigint, with_diagrams bigint, diagrams bigint, legal bigint, legal_share double",
    "WITH p AS (SELECT page_id % 5 AS d, page_id % 5 - CASE WHEN page_id % 5 > 0 THEN page_id % 2 ELSE 0 END AS l FROM pages) SELECT count(*) AS pages, count(*) FILTER (d > 0) AS with_diagrams, sum(d) AS diagrams, sum(l) AS legal, sum(l) / sum(d) AS legal_share FROM p",
)
def scan_totals(t: Tables) -> DataFrame:
    """What a scan found."""
    d = F.col("page_id") % 5
    return gallery.scan_totals(t("pages").select(d.alias("diagrams"), (d - F.when(d > 0, F.col("page_id") % 2).otherwise(0)).alias("legal")))


@query(
    "c_custkey bigint, names string, evidence string, filled_from string",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Event,White' ELSE 'White' END AS names,
    CASE WHEN c_custkey % 4 = 1 THEN c_name ELSE (c_custkey % 4) || ' games' END AS evidence, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS filled_from FROM customer""",
)
def header_cleaning(t: Tables) -> DataFrame:
    """Headers without empty and reserved ones, what confirms a diagram, and provenance after its last field went."""
    k = F.col("c_custkey")
    raw = F.create_map(F.lit(" White "), F.col("c_name"), F.lit("FEN"), F.lit("x"), F.lit("Site"), F.lit(" "), F.lit("Event"), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(""))
    left = F.when(k % 3 != 0, F.array(F.lit("White"))).otherwise(F.array().cast("array<string>"))
    after = gallery.provenance_after(F.col("c_name"), F.lit("unique"), left)
    names = F.array_join(F.array_sort(F.map_keys(gallery.clean_headers(raw))), ",")
    return t("customer").select("c_custkey", names.alias("names"), gallery.evidence_text(F.col("c_name"), k % 4).alias("evidence"), after["filled_from"].alias("filled_from"))


@query(
    "c_custkey bigint, white string, side_to_move string, changed string, filled_rule string",
    """WITH a AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS typed, c_custkey % 3 = 0 AS chosen, c_custkey % 5 = 0 AS verified, c_name FROM customer)
    SELECT k AS c_custkey, CASE WHEN chosen AND NOT typed THEN 'chosen' ELSE c_name END AS white, CASE WHEN chosen AND verified AND NOT typed THEN 'b' ELSE 'w' END AS side_to_move,
    CASE WHEN NOT chosen OR typed THEN '' WHEN verified THEN 'side_to_move,header:White' ELSE 'header:White' END AS changed, CASE WHEN chosen THEN 'human' ELSE 'date' END AS filled_rule FROM a""",
)
def choose_game(t: Tables) -> DataFrame:
    """Games that people chose, over what was filled in and beside what was typed."""
    k = F.col("c_custkey")
    filled = F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("header:White"), F.lit("side_to_move")))
    none = F.lit(None).cast("string")
    notes = t("customer").select("c_custkey", F.lit(None).cast("int").alias("move_number"), F.lit("w").alias("side_to_move"), F.create_map(F.lit("White"), F.col("c_name")).alias("headers"), filled.alias("filled_fields"), none.alias("filled_from"), F.lit("date").alias("filled_rule"), none.alias("chosen_game"))
    choice = t("customer").where("c_custkey % 3 = 0").select("c_custkey", F.lit("g").alias("game_key"), F.lit("label").alias("label"), F.create_map(F.lit("White"), F.lit("chosen"), F.lit("FEN"), F.lit("x")).alias("headers"), (k % 5 == 0).alias("verified"), F.lit(None).cast("int").alias("move_number"), F.lit("b").alias("side_to_move"))
    found = gallery.choose_game(notes, choice, ["c_custkey"])
    return found.select("c_custkey", F.col("headers")["White"].alias("white"), "side_to_move", F.array_join("changed", ",").alias("changed"), "filled_rule")


@query("o_orderkey bigint, confirmed_from string", "SELECT o_orderkey, o_orderpriority AS confirmed_from FROM orders WHERE o_orderkey % 3 = 1")
def confirmed_diagrams(t: Tables) -> DataFrame:
    """Diagrams that the database confirmed."""
    k = F.col("o_orderkey") % 3
    return gallery.confirmed(t("orders").withColumn("confirmed_from", F.when(k == 1, F.col("o_orderpriority")).when(k == 2, "")), ["o_orderkey"])


@query(
    "o_orderkey bigint, games_matched bigint",
    f"""{_GAMES_SQL}, x AS (SELECT o.o_orderkey, o.o_custkey % 500 AS pair, c.placement FROM orders o JOIN c ON c.o_orderkey = o.o_orderkey AND c.ply = 6 WHERE o.o_orderkey % 50 = 0)
    SELECT x.o_orderkey, count(DISTINCT c.o_orderkey) AS games_matched FROM x JOIN orders g ON g.o_custkey % 500 = x.pair JOIN c ON c.o_orderkey = g.o_orderkey AND c.placement = x.placement GROUP BY 1""",
)
def match_diagrams(t: Tables) -> DataFrame:
    """Games of a diagram's players that reach its placement."""
    pair = (F.col("o_custkey") % 500).cast("string").alias("pair")
    games = _pawn_game(t, pair)
    asked = games.where("o_orderkey % 50 = 0")
    placed = asked.select("o_orderkey", "pair", _after_three_moves().alias("placement"))
    # replaying is all the work, so games of a few files are dealt to every core first
    games = games.repartition(t.spark.sparkContext.defaultParallelism)
    found = gallery.match_diagrams(placed, games.select("pair", F.col("o_orderkey").alias("game_key"), "movetext", F.lit(None).cast("string").alias("setup_fen")), ["o_orderkey"])
    return found.select("o_orderkey", "games_matched")


@query(
    "vec_id bigint, score double",
    """SELECT vec_id, round(abs(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * CASE WHEN ((i - 1) // 8 + (i - 1) % 8) % 2 = 0 THEN 1 ELSE -1 END))) / 32,
        6) AS score FROM embeddings""",
)
def checker_score(t: Tables) -> DataFrame:
    """How chequered 64 means are."""
    return t("embeddings").select("vec_id", F.round(gallery.checker_score(F.col("embedding").cast("array<double>")), 6).alias("score"))


@query(
    "c_custkey bigint, status string",
    """SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'skipped' END AS status
        FROM customer""",
)
def books_to_run(t: Tables) -> DataFrame:
    """Books whose output is there already are skipped."""
    return gallery.to_run(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(
    "p_partkey bigint, name string",
    """WITH i AS (SELECT p_partkey, 'old' AS name FROM part WHERE p_partkey % 2 = 0), s AS (SELECT p_partkey, 'new' AS name FROM part WHERE p_partkey % 3 = 0)
    SELECT * FROM s UNION ALL SELECT * FROM i WHERE p_partkey NOT IN (SELECT p_partkey FROM s)""",
)
def patch_index(t: Tables) -> DataFrame:
    """Saved diagrams of a book put into its index."""
    index = t("part").where("p_partkey % 2 = 0").select("p_partkey", F.lit("old").alias("name"))
    saved = t("part").select("p_partkey", F.lit("new").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "book").otherwise("other").alias("source_pdf"))
    return gallery.patch_index(index, saved, "book", ["p_partkey"])


@query(
    "o_orderkey bigint, filled string, side string",
    """WITH a AS (SELECT o_orderkey AS k, o_custkey % 5 AS move, CASE o_orderkey % 3 WHEN 0 THEN 'w' WHEN 1 THEN 'b' END AS side, o_orderkey % 4 = 0 AS known, o_orderkey % 7 <> 0 AS filled, o_orderstatus AS event, o_orderpriority AS site FROM orders),
        m AS (SELECT o_orderkey AS k, 2 AS move, CASE o_orderkey % 2 WHEN 0 THEN 'w' END AS side, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS event, '1-URGENT' AS site FROM orders WHERE o_orderkey % 11 <> 0)
        SELECT a.k AS o_orderkey, CASE WHEN known THEN 'known' WHEN filled AND m.k IS NOT NULL THEN concat_ws(',', CASE WHEN a.move = m.move THEN 'move_number' END,
            CASE WHEN a.side IS NOT DISTINCT FROM m.side THEN 'side_to_move' END, CASE WHEN m.event <> '' AND a.event = m.event THEN 'header:Event' END, CASE WHEN a.site = m.site THEN 'header:Site' END) ELSE '' END AS filled,
            coalesce(a.side, CASE WHEN a.k % 2 = 0 THEN 'b' ELSE '' END) AS side
        FROM a LEFT JOIN m ON m.k = a.k""",
)
def recovered_fields(t: Tables) -> DataFrame:
    """Fields of old annotations that their match gave, and the side that a label resolves to."""
    o, k = t("orders"), F.col("o_orderkey")
    side = F.when(k % 3 == 0, "w").when(k % 3 == 1, "b")
    headers = lambda event, site: F.create_map(F.lit("Event"), event, F.lit("Site"), site)
    known = F.when(k % 4 == 0, F.array(F.lit("known"))).otherwise(F.array().cast("array<string>"))
    annotations = o.select("o_orderkey", (F.col("o_custkey") % 5).alias("move_number"), side.alias("side_to_move"), headers(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("headers"), F.when(k % 7 != 0, "game").otherwise("").alias("filled_from"), known.alias("filled_fields"))
    event = F.when(k % 5 == 0, "").otherwise(F.col("o_orderstatus"))
    matches = o.where(k % 11 != 0).select("o_orderkey", F.lit(2).cast("long").alias("move_number"), F.when(k % 2 == 0, "w").alias("side_to_move"), headers(event, F.lit("1-URGENT")).alias("headers"))
    found = merges.recover_provenance(annotations, matches, ["o_orderkey"])
    fen = F.when(k % 2 == 0, "8/8/8/8/8/8/8/8 b - - 0 1").otherwise("8/8/8/8/8/8/8/8 x")
    return found.select("o_orderkey", F.array_join("filled_fields", ",").alias("filled"), board.resolved_side(F.coalesce("side_to_move", F.lit("")), fen).alias("side"))
