"""Exact search, ledgers, merges and neighbours on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import merges, metrics, search, similarity
from .catalogue import Tables, query

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber"]
_TARGETS = "SELECT p_partkey FROM part WHERE p_size <= 25"


def _positions(t: Tables) -> DataFrame:
    return t("lineitem").select(F.col("l_partkey").alias("key"), *ORDER, "l_returnflag")


def _hits(name: str = "hits") -> F.Column:
    return F.array_join(F.transform(name, lambda h: F.concat_ws(":", h["l_orderkey"], h["l_linenumber"])), ",")


_SEARCH_SQL = f"""WITH f AS (SELECT l_partkey AS key, l_shipdate, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS r FROM lineitem WHERE l_partkey IN ({_TARGETS}))
    SELECT key, any_value(n) AS count, string_agg(l_orderkey || ':' || l_linenumber, ',' ORDER BY r) FILTER (r <= 32) AS hits FROM f GROUP BY key"""


@query("key bigint, count bigint, hits string", _SEARCH_SQL)
def exact_position_search(t: Tables) -> DataFrame:
    """For every wanted key its true count and the first 32 occurrences in order."""
    targets = t("part").where("p_size <= 25").select(F.col("p_partkey").alias("key"))
    return search.inverted_search(_positions(t), targets, ["key"], ORDER).withColumn("hits", _hits())


@query("key bigint, count bigint, hits string", _SEARCH_SQL)
def merge_partials(t: Tables) -> DataFrame:
    """The same answer from two halves searched apart."""
    targets = t("part").where("p_size <= 25").select(F.col("p_partkey").alias("key"))
    halves = [search.inverted_search(_positions(t).where(f"l_orderkey % 2 = {k}"), targets, ["key"], ORDER) for k in (0, 1)]
    return search.merge_partials(halves[0].unionByName(halves[1]), ["key"]).withColumn("hits", _hits())


@query(
    "l_suppkey bigint, l_returnflag string, l_orderkey bigint, l_linenumber bigint",
    """SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey,
        l_returnflag ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem
        WHERE l_suppkey % 7 = 0 AND l_returnflag <> 'N') WHERE r <= 40""",
)
def pair_search_capped(t: Tables) -> DataFrame:
    """Rows of the wanted pairs, 40 of each at most."""
    wanted = t("supplier").where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("l_suppkey"), F.explode(F.array(F.lit("A"), F.lit("R"))).alias("l_returnflag"))
    return search.pairs_capped(t("lineitem"), wanted, ["l_suppkey", "l_returnflag"], ["l_orderkey", "l_linenumber"])


@query(
    "one string, two string, lines bigint",
    """SELECT least(a.n_name, b.n_name) AS one, greatest(a.n_name, b.n_name) AS two, count(*) AS lines
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN supplier ON s_suppkey = l_suppkey JOIN nation a ON a.n_nationkey = c_nationkey
        JOIN nation b ON b.n_nationkey = s_nationkey GROUP BY 1, 2""",
)
def unordered_pair(t: Tables) -> DataFrame:
    """Lines between two nations whichever of them buys."""
    nation = t("nation")
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    per = rows.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n"))  # before the names: 625 rows at most
    a, b = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("a")), nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("b"))
    pair = text.unordered_pair("a", "b")
    return per.join(a, "c_nationkey").join(b, "s_nationkey").groupBy(pair[0].alias("one"), pair[1].alias("two")).agg(F.sum("n").alias("lines"))


@query(
    "key bigint, hits string, sure boolean",
    """WITH f AS (SELECT l_partkey AS key, l_orderkey, l_linenumber, l_returnflag = 'R' AS c, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS r FROM lineitem)
    SELECT key, string_agg(l_orderkey || ':' || l_linenumber, ',' ORDER BY c DESC, r) AS hits, count(*) FILTER (c) = 1 AS sure FROM f WHERE r <= 32 GROUP BY key""",
)
def rerank_candidates(t: Tables) -> DataFrame:
    """Candidates that something else confirms come first, each part in its order."""
    kept = search.capped(_positions(t), ["key"], ORDER).groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "l_returnflag"))).alias("hits"))
    r = search.rerank(F.col("hits"), lambda h: h["l_returnflag"] == "R")
    return kept.select("key", r["hits"].alias("hits"), r["sure"].alias("sure")).withColumn("hits", _hits())


@query(
    "p_brand string, bucket string, diagrams bigint, games bigint",
    """WITH n AS (SELECT p_brand, count(*) AS c FROM lineitem JOIN part ON p_partkey = l_partkey
        GROUP BY p_brand, p_partkey), b AS (SELECT p_brand, c, CASE WHEN c <= 1 THEN '1' WHEN c <= 2 THEN '2' WHEN c <= 5 THEN '3-5' WHEN c <= 20 THEN '6-20' WHEN c <= 100 THEN '21-100' ELSE '>100' END AS bucket
        FROM n) SELECT p_brand, bucket, count(*) AS diagrams, sum(c) AS games
        FROM b GROUP BY GROUPING SETS ((p_brand, bucket), (bucket))""",
)
def ambiguity_census(t: Tables) -> DataFrame:
    """Keys by how many occurrences they have, per brand and in total."""
    counts = t("lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("count")).join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    return search.ambiguity_census(counts, "p_brand")


_ASKED_SQL = "SELECT p_partkey AS key FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey + 1000000000 FROM part WHERE p_size <= 25 AND p_partkey % 3 = 0"


def _asked(t: Tables) -> DataFrame:
    """Keys of small parts, and keys that no part has."""
    own = t("part").where("p_size <= 25").select(F.col("p_partkey").alias("key"))
    return own.union(own.where("key % 3 = 0").select(F.col("key") + 1_000_000_000))


@query(
    "key bigint, count bigint, was_new boolean",
    f"SELECT key, coalesce(n, 0) AS count, key % 2 = 1 AS was_new FROM ({_ASKED_SQL}) LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = key",
)
def ask_ledger(t: Tables) -> DataFrame:
    """Only keys never asked are searched; every asked key is recorded, misses with count 0."""
    rows, asked = _positions(t), _asked(t)
    before = asked.where("key % 2 = 0")
    found = search.inverted_search(rows, before, ["key"], ORDER)
    ledger = search.record_answers(found.limit(0), before, found, ["key"])
    new = search.never_asked(asked, ledger, ["key"])
    ledger = search.record_answers(ledger, new, search.inverted_search(rows, new, ["key"], ORDER), ["key"])
    return ledger.join(new.withColumn("_new", F.lit(True)), "key", "left").select("key", "count", F.coalesce("_new", F.lit(False)).alias("was_new"))


@query(
    "answered bigint, asked bigint",
    f"SELECT (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey IN (SELECT key FROM ({_ASKED_SQL}))) AS answered, (SELECT count(*) FROM ({_ASKED_SQL})) AS asked",
)
def ledger_answered(t: Tables) -> DataFrame:
    """How many asked keys were found."""
    asked = _asked(t)
    found = search.inverted_search(_positions(t), asked, ["key"], ORDER)
    ledger = search.record_answers(found.limit(0), asked, found, ["key"])
    answers = search.answered(asked, ledger, ["key"]).agg(F.count(F.lit(1)).alias("answered"))
    return answers.crossJoin(asked.agg(F.count(F.lit(1)).alias("asked")))


@query(
    "o_orderstatus string, o_orderkey bigint",
    """WITH r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus
        ORDER BY o_orderkey) AS n FROM orders), q AS (SELECT greatest(1, 100 // count(DISTINCT o_orderstatus)) AS quota
        FROM orders) SELECT o_orderstatus, o_orderkey FROM r, q ORDER BY n > quota, o_orderstatus, n LIMIT 100""",
)
def fair_share(t: Tables) -> DataFrame:
    """A hundred rows, as evenly from the groups as they allow."""
    return search.fair_share(t("orders").select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], ["o_orderkey"], 100)


@query(
    "l_orderkey bigint, l_linenumber bigint, l_partkey bigint",
    """SELECT l_orderkey, min(l_linenumber) AS l_linenumber, arg_min(l_partkey, (l_linenumber, l_partkey)) AS l_partkey
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey""",
)
def first_position(t: Tables) -> DataFrame:
    """Each order's first returned line."""
    return search.first_position(t("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], ["l_linenumber", "l_partkey"])


@query(
    "key bigint, games_matched bigint, hits string",
    """WITH o AS (SELECT l_partkey AS key, l_suppkey, l_shipdate, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n FROM lineitem),
    f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY l_shipdate, l_orderkey, l_linenumber) AS r FROM o WHERE n = 1)
    SELECT key, count(*) AS games_matched, string_agg(l_orderkey || ':' || l_linenumber, ',' ORDER BY r) FILTER (r <= 32) AS hits FROM f GROUP BY key""",
)
def candidates_by_game(t: Tables) -> DataFrame:
    """One candidate of each supplier, and how many suppliers there are."""
    rows = t("lineitem").select(F.col("l_partkey").alias("key"), "l_suppkey", *ORDER)
    return search.candidates_by_game(rows, ["key"], ["l_suppkey"], ORDER).withColumn("hits", _hits())


def _annotations(t: Tables) -> DataFrame:
    c = F.col
    name = F.when(c("c_custkey") % 3 == 0, c("c_name")).otherwise("")
    headers = F.create_map(F.lit("White"), name, F.lit("Site"), F.when(c("c_custkey") % 5 == 0, "typed").otherwise(""))
    return t("customer").select("c_custkey", headers.alias("headers"), F.array(F.lit("ECO")).alias("filled_fields"), F.lit("").alias("filled_from"), F.when(c("c_custkey") % 7 == 0, "human").otherwise("").alias("filled_rule"), F.lit("").alias("confirmed_from"))


def _matches(t: Tables) -> DataFrame:
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("count"), F.min("o_orderkey").alias("first"))
    headers = F.create_map(F.lit("White"), F.concat(F.lit("O"), "first"), F.lit("Site"), F.lit("base"), F.lit("FEN"), F.lit("x"))
    return o.select("c_custkey", "count", (F.col("c_custkey") % 4 == 0).alias("caption_confirmed"), headers.alias("headers"), F.lit("base1").alias("source"))


@query(
    "c_custkey bigint, outcome string, white string, site string, filled_fields string, filled_rule string, confirmed_from string",
    """WITH m AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY o_custkey),
    r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS w, CASE WHEN c_custkey % 5 = 0 THEN 'typed' ELSE '' END AS s, CASE WHEN c_custkey % 7 = 0 THEN 'human' ELSE '' END AS rule, n, f FROM customer LEFT JOIN m ON o_custkey = c_custkey),
    a AS (SELECT *, CASE WHEN n IS NULL THEN 'unmatched' WHEN rule = 'human' THEN 'respected' WHEN n > 5 AND k % 4 <> 0 THEN 'ambiguous' WHEN w <> '' AND s <> '' THEN 'unchanged' ELSE 'applied' END AS outcome FROM r)
    SELECT k AS c_custkey, outcome, CASE WHEN outcome = 'applied' AND w = '' THEN 'O' || f ELSE w END AS white, CASE WHEN outcome = 'applied' AND s = '' THEN 'base' ELSE s END AS site,
    'ECO' || CASE WHEN outcome = 'applied' AND s = '' THEN ',Site' ELSE '' END || CASE WHEN outcome = 'applied' AND w = '' THEN ',White' ELSE '' END AS filled_fields,
    CASE WHEN outcome = 'applied' THEN CASE WHEN n = 1 THEN 'unique' WHEN k % 4 = 0 THEN 'caption' ELSE 'date' END ELSE rule END AS filled_rule, CASE WHEN n IS NULL THEN '' ELSE 'base1' END AS confirmed_from FROM a""",
)
def merge_fill_nulls(t: Tables) -> DataFrame:
    """MERGE that fills only what is empty and records what it filled."""
    a = merges.fill_empty(_annotations(t), _matches(t), ["c_custkey"])
    return a.select("c_custkey", "outcome", F.col("headers")["White"].alias("white"), F.col("headers")["Site"].alias("site"), F.array_join("filled_fields", ",").alias("filled_fields"), "filled_rule", "confirmed_from")


@query("event_id bigint, kept string", "SELECT event_id, CASE WHEN event_type = 'view' OR user_id % 2 = 0 THEN 'k,type' ELSE 'type' END AS kept FROM events")
def human_only(t: Tables) -> DataFrame:
    """Fields that were typed: all under the human rule, else those not filled in."""
    c = F.col
    headers = F.create_map(F.lit("type"), c("event_type"), F.lit("k"), c("props"))
    filled = F.when(c("user_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("k")))
    kept = merges.human_headers(headers, filled, F.when(c("event_type") == "view", "human").otherwise("date"))
    return t("events").select("event_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"))


@query(
    "event_id bigint, value string, filled string",
    """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'typed' ELSE event_type END AS value, CASE WHEN user_id % 3 = 0 THEN 'k' ELSE 'type,k' END AS filled
        FROM events""",
)
def restore_human(t: Tables) -> DataFrame:
    """Typed values go over filled ones and are no longer filled."""
    rows = t("events").select("event_id", F.create_map(F.lit("type"), "event_type").alias("headers"), F.array(F.lit("type"), F.lit("k")).alias("filled_fields"))
    typed = t("events").where("user_id % 3 = 0").select("event_id", F.create_map(F.lit("type"), F.lit("typed")).alias("headers"))
    r = merges.restore_human(rows, typed, ["event_id"])
    return r.select("event_id", F.col("headers")["type"].alias("value"), F.array_join("filled_fields", ",").alias("filled"))


@query(
    "conv_id bigint, turn bigint, neighbours string",
    """SELECT a.conv_id, a.turn, coalesce(string_agg(DISTINCT b.role, ','
        ORDER BY b.role), '') AS neighbours FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn) AS n FROM conversations) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn) AS n FROM conversations) b ON b.conv_id = a.conv_id AND abs(a.n - b.n) BETWEEN 1 AND 3
        GROUP BY a.conv_id, a.turn""",
)
def neighbour_keys(t: Tables) -> DataFrame:
    """The different keys of the rows up to three away."""
    rows = merges.neighbour_keys(t("conversations").withColumn("keys", F.array("role")), ["conv_id"], ["turn"], "keys")
    return rows.select("conv_id", "turn", F.array_join("neighbours", ",").alias("neighbours"))


@query(
    "conv_id bigint, turn bigint, same_key_near bigint",
    """SELECT a.conv_id, a.turn, count(b.turn) AS same_key_near FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn) AS n FROM conversations) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn) AS n FROM conversations) b ON b.conv_id = a.conv_id AND abs(a.n - b.n) BETWEEN 1 AND 3 AND a.role = b.role
        GROUP BY a.conv_id, a.turn""",
)
def neighbours_with_key(t: Tables) -> DataFrame:
    """How many rows up to three away share the key."""
    return merges.neighbours_with_key(t("conversations"), ["conv_id"], ["turn"], "role")


@query(
    "conv_id bigint, turn bigint, number bigint",
    """WITH n AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN length(text) % 10 ELSE turn + 100 END AS v, length(text) AS e FROM conversations)
    SELECT a.conv_id, a.turn, arg_min(a.v, (a.e, a.v)) AS number FROM n a WHERE EXISTS (SELECT 1 FROM n b WHERE b.conv_id = a.conv_id AND abs(b.turn - a.turn) BETWEEN 1 AND 2 AND b.v - a.v = b.turn - a.turn) GROUP BY a.conv_id, a.turn""",
)
def running_number(t: Tables) -> DataFrame:
    """Numbers that a page one or two away continues."""
    size = F.length("text")
    rows = t("conversations").select("conv_id", "turn", F.when(size % 3 == 0, size % 10).otherwise(F.col("turn") + 100).alias("v"), size.alias("e"))
    return similarity.running_numbers(rows, ["conv_id"], "turn", "v", "e")


@query("user_id bigint, last string", "SELECT user_id, CAST(max(ts) AS VARCHAR) AS last FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 20")
def lru_recent(t: Tables) -> DataFrame:
    """The twenty users seen last."""
    return metrics.recent(t("events"), "user_id", "ts", 20)
