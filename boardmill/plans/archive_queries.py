"""Game archives that Spark writes from the orders, scanned, indexed by name and read at offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import library
from ..sources import archive
from ..sources.staging import fresh_folder
from .catalogue import Tables, query

_GAMES_SQL = "SELECT o_orderkey, 'p' || (o_custkey % 30) AS one, 'q' || (o_orderkey % 20) AS two, o_orderkey % 3 = 0 AS swapped, o_custkey FROM orders"
LIMIT = 6


def _archive(t: Tables) -> str:
    """A folder of archives with a game for each order, in order of their keys; every third has the colours swapped."""
    folder = fresh_folder(t.spark, "archive")
    one, two = F.concat(F.lit("P"), F.col("o_custkey") % 30, F.lit(", Ann")), F.concat(F.lit("J. Q"), F.col("o_orderkey") % 20)
    swapped = F.col("o_orderkey") % 3 == 0
    head = lambda key, value: F.concat(F.lit(f'[{key} "'), value, F.lit('"]\n'))
    record = F.concat(
        head("Event", F.concat(F.lit("order "), F.col("o_orderkey"))),
        head("White", F.when(swapped, two).otherwise(one)),
        head("Black", F.when(swapped, one).otherwise(two)),
        F.lit("\n1. e4 e5 2. Nf3 {"), F.col("o_orderpriority"), F.lit("} *\n"),
    )
    t("orders").select("o_orderkey", record.alias("value")).repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(folder)
    return folder


def _order_key(df: DataFrame) -> DataFrame:
    return df.withColumn("o_orderkey", F.regexp_extract(F.col("headers")["Event"], r"(\d+)", 1).cast("long"))


@query(
    "o_orderkey bigint, white string, black string, movetext string, same boolean, between bigint",
    f"""SELECT g.o_orderkey, CASE WHEN swapped THEN two ELSE one END AS white, CASE WHEN swapped THEN one ELSE two END AS black,
        '1. e4 e5 2. Nf3 {{' || o_orderpriority || '}} *' AS movetext, true AS same, 0 AS between
        FROM ({_GAMES_SQL}) AS g JOIN orders o ON o.o_orderkey = g.o_orderkey""",
)
def archive_offsets(t: Tables) -> DataFrame:
    """Every record of an archive read again by its offset; one byte further on no record begins."""
    found = archive.read_archive(t.spark, _archive(t), split_bytes=1 << 17)
    again = archive.games_at(found.select("path", "offset", F.col("movetext").alias("scanned"), F.col("white").alias("w")))
    same = (F.col("scanned") == F.col("movetext")) & (F.col("w") == F.col("white"))
    # a record travels with its second look-up, so that nothing is joined
    game = F.struct("o_orderkey", "white", "black", "movetext", same.alias("same")).alias("game")
    beside = archive.games_at(_order_key(again).select("path", (F.col("offset") + 1).alias("beside"), game), offset="beside")
    return beside.select("game.*", F.col("movetext").isNotNull().cast("long").alias("between"))


@query(
    "one string, two string, swapped boolean, o_orderkey bigint",
    f"""WITH g AS ({_GAMES_SQL}), a AS (SELECT DISTINCT one, two FROM g WHERE o_custkey % 7 = 0),
        f AS (SELECT g.*, row_number() OVER (PARTITION BY one, two, swapped ORDER BY o_orderkey) AS n FROM g SEMI JOIN a USING (one, two) QUALIFY n <= {LIMIT}),
        c AS (SELECT one, two, count(DISTINCT swapped) AS colours FROM f GROUP BY one, two),
        r AS (SELECT f.*, row_number() OVER (PARTITION BY f.one, f.two ORDER BY n > greatest(1, {LIMIT} // colours), swapped, n) AS k FROM f JOIN c ON c.one = f.one AND c.two = f.two)
        SELECT one, two, swapped, o_orderkey FROM r WHERE k <= {LIMIT}""",
)
def name_index_lookup(t: Tables) -> DataFrame:
    """Games of pairs of players by the name index of an archive, in either colouring, a fair share of the limit for each."""
    folder, index = _archive(t), fresh_folder(t.spark, "name-index")
    archive.write_name_index(t.spark, folder, index)
    asked = t("orders").where("o_custkey % 7 = 0").select(F.concat(F.lit("P"), F.col("o_custkey") % 30).alias("a"), F.concat(F.lit("Q"), F.col("o_orderkey") % 20).alias("b"))
    return _order_key(archive.lookup_games(archive.open_name_index(t.spark, folder, index), asked, "a", "b", limit=LIMIT))


@query(
    "book string, status string, games bigint, broken boolean",
    """SELECT CAST(b AS VARCHAR) AS book, CASE WHEN b = 3 THEN 'failed' WHEN b = 5 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN b IN (3, 5) THEN 0 ELSE n END AS games, b = 3 AS broken
        FROM (SELECT o_orderkey % 8 AS b, count(*) AS n FROM orders GROUP BY 1)""",
)
def library_report(t: Tables) -> DataFrame:
    """A library of eight books, of which one has a file that can't be read and one was run before."""
    folder = fresh_folder(t.spark, "library")
    record = F.concat(F.lit('[Event "order '), F.col("o_orderkey"), F.lit('"]\n[White "A"]\n[Black "B"]\n\n1. e4 *\n'))
    t("orders").select((F.col("o_orderkey") % 8).alias("book"), record.alias("value")).repartition("book").write.partitionBy("book").text(folder)
    files = archive.archive_files(t.spark, folder).select("path", "length")
    gone = files.where("path like '%book=3/%'").limit(1).select(F.concat("path", F.lit(".gone")).alias("path"), "length")
    done = t("orders").where("o_orderkey % 8 = 5").select(F.lit("5").alias("book")).distinct()
    games, report = library.library_batch(files.union(gone), done, F.regexp_extract("path", r"/book=([^/]*)/", 1))
    read = games.groupBy("book").agg(F.count(F.lit(1)).alias("_n"))
    return report.join(read, "book", "left").select("book", "status", F.coalesce("_n", F.lit(0)).alias("games"), F.col("error").isNotNull().alias("broken"))
