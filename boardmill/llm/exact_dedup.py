"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Only DataFrame functions.  Each step counts its groups with map-side partial aggregation and lets
only rows of groups of two or more go on.  Exchanges carry ids, lengths and hashes, never a text:
the full content of the rows that length and prefix could not tell apart is read and hashed where
the text is scanned.  No step gathers the rows of a group: a group is one row (smallest id, number
of rows), joined back on its digest.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

PREFIX_CHARS = 128
#: Flags by which a scan knows the groups that may be shared: of one size however many groups there are.
FLAG_BITS = 18


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _raw, _norm, _len, _prefix) of every row; _raw is a hash of the text as it is."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_raw"), normalised(F.col(text_col)).alias("_norm"))
    return rows.select("_id", "_raw", "_norm", F.octet_length("_norm").alias("_len"), F.xxhash64(F.substring("_norm", 1, PREFIX_CHARS)).alias("_prefix"))


def _surviving(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of groups of two or more; the further key makes both sides of the join shuffle anew, so that Spark can
    split a group that many rows share."""
    alike = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, F.xxhash64(*keys).alias("_key"))
    return rows.withColumn("_key", F.xxhash64(*keys)).join(alike, [*keys, "_key"], "left_semi").drop("_key")


def _sized(full: DataFrame) -> DataFrame:
    return full.groupBy("digest").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")


def _flags(groups: DataFrame, keys: list[str]) -> Column:
    """A row's flag: whether its keys may be among these groups.  2**FLAG_BITS places are collected at most."""
    spot = F.pmod(F.xxhash64(*keys), F.lit(1 << FLAG_BITS)).cast("int")
    words = [0] * (1 << FLAG_BITS - 5)
    for row in groups.select(spot.alias("p")).distinct().collect():
        words[row.p >> 5] |= 1 << (row.p & 31)
    table = F.from_json(F.lit(json.dumps(words, separators=(",", ":"))), "array<bigint>")
    bit = F.call_function("shiftright", F.get(table, F.shiftright(spot, 5)), F.pmod(spot, F.lit(32)))
    return bit.bitwiseAND(F.lit(1).cast("bigint")) == 1


def _survivors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _raw, digest) of the rows that length and prefix couldn't tell from another row; only these texts are hashed
    in full, and the few that a flag can't tell from them.  _raw is a hash of the text as it is."""
    measured = _measured(docs, id_col, text_col)
    sizes = written(measured.select("_len", "_prefix", "_raw"), "sizes")
    alive = written(_surviving(_surviving(sizes, ["_len"]), ["_len", "_prefix"]).distinct(), "alive")
    # the flag asks for the hash of the text as it is alone, so that other texts aren't even normalised again
    full = measured.where(_flags(alive, ["_raw"])).select("_id", "_raw", "_len", "_prefix", F.sha2("_norm", 256).alias("digest"))
    shared = alive.select("_len", "_prefix", F.xxhash64("_len", "_prefix").alias("_key")).distinct()
    return full.withColumn("_key", F.xxhash64("_len", "_prefix")).join(shared, ["_len", "_prefix", "_key"], "left_semi").select("_id", "_raw", "digest")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text that two or more rows share: digest, keep_id, group_size.

    Only rows whose length and prefix another row has are hashed in full (and the few that a flag
    can't tell from them).  Null ids count as rows but are never the smallest; a group of null ids
    only has keep_id null.  Empty and null texts are one group.  An empty table gives an empty
    result.
    """
    return _sized(_survivors(docs, id_col, text_col))


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, unchanged, without a digest of every text.

    Rows that repeat both id and text are all kept or all dropped.  Rows that no flag of a copy
    speaks for pass the scan; the others, copies and what shares a flag with one, are joined with
    the copies by id and text hash.
    """
    survivors = written(_survivors(docs, id_col, text_col), "survivors")
    groups = _sized(survivors).select("digest", F.col("keep_id").alias("_keep"), F.substring("digest", 1, 8).alias("_head"))
    found = survivors.withColumn("_head", F.substring("digest", 1, 8)).join(groups, ["digest", "_head"])
    gone = written(found.where(~F.col("_id").eqNullSafe(F.col("_keep"))).select("_id", "_raw").distinct(), "copies")
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_raw"))
    flag = _flags(gone, ["_id", "_raw"])
    mine = own.where(flag).join(gone.alias("g"), own["_raw"].eqNullSafe(F.col("g._raw")) & own["_id"].eqNullSafe(F.col("g._id")), "left_anti")
    return own.where(~flag).select("_row").unionByName(mine.select("_row")).select("_row.*")


def _digested(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(_id, digest) of every row, and the groups of equal ones.

    Where every row's digest is asked for, digests are computed once, with the lengths and prefix
    hashes, and written; the refinement then works on that table alone.
    """
    rows = written(_measured(docs, id_col, text_col).select("_id", "_len", "_prefix", F.sha2("_norm", 256).alias("digest")), "digests")
    return rows.select("_id", "digest"), _sized(_surviving(_surviving(rows, ["_len"]), ["_len", "_prefix"]))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row, see ``exact_dedup``."""
    found = _with_groups(*_digested(docs, id_col, text_col))
    return found.select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (_id, digest and others) with keep_id, group_size and kept."""
    head = F.substring("digest", 1, 8).alias("_head")
    joined = rows.select("*", head).join(groups.select("digest", head, F.col("keep_id").alias("_keep_id"), F.col("group_size").alias("_group_size")), ["digest", "_head"], "left")
    joined = joined.withColumn("keep_id", F.when(F.col("_group_size").isNull(), F.col("_id")).otherwise(F.col("_keep_id")))
    joined = joined.withColumn("group_size", F.coalesce("_group_size", F.lit(1)).cast("long")).withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")))
    return joined.drop("_head", "_keep_id", "_group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with text_sha256, keep_id, group_size and kept for every row, dropped ones too.

    Rows are equal when their normalised texts are (see ``normalised``); of equal rows the one
    with the smallest id is kept.  Rows that repeat both id and text are one row for ``kept``:
    they are all kept or all dropped.  A row with a null id is kept only if its text has no row
    with an id.  Columns of ``docs`` keep their values, whatever their names; the four results
    take the place of columns of the same names.
    """
    results = ["text_sha256", "keep_id", "group_size", "kept"]
    rows = docs.select(F.col(id_col).alias("_id"), F.sha2(normalised(F.col(text_col)), 256).alias("digest"), F.struct(*docs.columns).alias("_row"))
    found = _with_groups(rows, _digested(docs, id_col, text_col)[1]).withColumnRenamed("digest", "text_sha256")
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in results]
    return found.select(*own, *results)
