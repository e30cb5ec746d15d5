"""Exports with a commit log, counters of scans, library batches, deep pages, scorers."""

import glob
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardmill.operators import library, paging, scoring
from boardmill.sources import archive
from boardmill.streaming import export, incremental, progress

ROWS = "book string, page long, diagrams long"


@pytest.fixture
def source(spark, tmp_path):
    """Three files: books a and b, and a page without diagrams at b's end."""
    for k, rows in enumerate(([("a", 0, 2), ("a", 1, 1)], [("a", 2, 3), ("b", 0, 1)], [("b", 1, 0)])):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
        os.utime(glob.glob(str(tmp_path / f"in/part{k}/*.parquet"))[0], (1_000 + k, 1_000 + k))
    return str(tmp_path / "in/part*")


def run(spark, source, folder, wrap=lambda sink: sink, parameters=None, files=1):
    log = export.ExportLog(spark, f"{folder}/out", parameters or {"dpi": 200, "name": "x"}, "m1")
    went_on = log.open()
    pages = incremental.scan(spark, source, spark.createDataFrame([], ROWS).schema, files)
    sink = wrap(log.sink("book", "page", lambda df: df.where("diagrams > 0")))
    incremental.run_available(pages, [sink], f"{folder}/state-{incremental.parameters_key(log.parameters)}")
    return log, went_on


def exported(log):
    return sorted(map(tuple, log.rows(ROWS).collect())), {r.book: r.resume_from for r in log.resume_from().collect()}


WHOLE = ([("a", 0, 2), ("a", 1, 1), ("a", 2, 3), ("b", 0, 1)], {"a": 3, "b": 2})


@pytest.mark.parametrize("kill", ["before", "between", "after"])
def test_an_export_killed_anywhere_loses_and_repeats_nothing(spark, source, tmp_path, monkeypatch, kill):
    real = export.ExportLog._write

    def wrap(sink):
        def broken(batch, number):
            if number == 1 and kill == "before":
                raise RuntimeError("killed")
            sink(batch, number)
            if number == 1 and kill == "after":
                raise RuntimeError("killed")

        return broken

    def no_commit(self, name, content):
        if name == "commits/1.json" and kill == "between":
            raise RuntimeError("killed")
        real(self, name, content)

    monkeypatch.setattr(export.ExportLog, "_write", no_commit)
    with pytest.raises(Exception, match="killed"):
        run(spark, source, tmp_path, wrap)
    monkeypatch.setattr(export.ExportLog, "_write", real)
    done = exported(export.ExportLog(spark, f"{tmp_path}/out", {}))
    assert done == ((WHOLE[0], {"a": 3, "b": 1}) if kill == "after" else (WHOLE[0][:2], {"a": 2}))
    log, went_on = run(spark, source, tmp_path)
    assert went_on and exported(log) == WHOLE and log.commits().count() == 3
    assert sorted(r.rows for r in log.commits().collect()) == [0, 2, 2]


def test_rows_without_a_commit_don_t_exist(spark, source, tmp_path):
    log, went_on = run(spark, source, tmp_path, files=5)
    assert not went_on and exported(log) == WHOLE
    spark.createDataFrame([("z", 9, 9)], ROWS).write.parquet(f"{tmp_path}/out/rows/batch=7")  # flushed, not committed
    (tmp_path / "out/commits/8.json.draft").write_text('{"batch": 8, "ro')  # torn
    assert exported(log) == WHOLE


def test_other_parameters_begin_anew(spark, source, tmp_path):
    log, _ = run(spark, source, tmp_path)
    same = export.ExportLog(spark, log.path, {"name": "x", "dpi": 200})
    assert same.open() and exported(same) == WHOLE  # a side that names no model agrees with any
    other = export.ExportLog(spark, log.path, {"dpi": 300, "name": "x"}, "m1")
    assert not other.open() and exported(other) == ([], {})
    (tmp_path / "out/.header.json.crc").unlink()
    (tmp_path / "out/header.json").write_text('{"version": 1, "par')
    assert not other.open()
    other.discard()
    assert not os.path.exists(other.path)


def test_counters_equal_what_was_written(spark, source, tmp_path):
    counted = progress.Progress("pages", F.count(F.lit(1)).alias("pages"), F.sum("diagrams").alias("diagrams"))
    spark.streams.addListener(counted)
    try:
        pages = counted.watch(incremental.scan(spark, source, spark.createDataFrame([], ROWS).schema, 1))
        incremental.run_available(pages, [incremental.batch_sink(f"{tmp_path}/rows")], f"{tmp_path}/state")
        batches = counted.batches()
    finally:
        spark.streams.removeListener(counted)
    written = {r.batch: (r.n, r.d) for r in spark.read.parquet(f"{tmp_path}/rows").groupBy("batch").agg(F.count("*").alias("n"), F.sum("diagrams").alias("d")).collect()}
    assert {k: (b["pages"], b["diagrams"]) for k, b in batches.items()} == written and len(written) == 3


def test_a_library_goes_on_past_a_broken_file(spark, tmp_path):
    for book, n in (("a", 2), ("b", 1), ("c", 3)):
        (tmp_path / f"{book}.pgn").write_text('[Event "e"]\n[White "W"]\n[Black "B"]\n\n1. e4 *\n\n' * n)
    odd = [(f"file:{tmp_path}/b.more.pgn", 10), (f"file:{tmp_path}/empty.pgn", 0)]
    files = archive.archive_files(spark, str(tmp_path)).union(spark.createDataFrame(odd, "path string, length long"))
    done = spark.createDataFrame([("c",)], "book string")
    games, report = library.library_batch(files, done, F.regexp_extract("path", r"/([a-z]+)[^/]*$", 1))
    got = {r.book: (r.status, r.files, r.games, bool(r.error)) for r in report.collect()}
    assert got == {"a": ("ok", 1, 2, False), "b": ("failed", 2, 0, True), "c": ("skipped", 1, 0, False), "empty": ("ok", 1, 0, False)}
    assert {(r.book, r.movetext) for r in games.collect()} == {("a", "1. e4 *")} and games.count() == 2
    assert library.census_totals(report).first().asDict() == {"books": 4, "ok": 2, "skipped": 1, "failed": 1, "games": 2}


def test_deep_pages_read_one_range(spark, tmp_path):
    rows = spark.range(10_000).select((F.col("id") * 7919 % 10_000).alias("k"), (F.col("id") % 13).alias("v")).repartition(4)
    table = paging.OrderedTable(rows, [F.desc("v"), "k"], ranges=8)
    want = [(r.k, r.v) for r in rows.orderBy(F.desc("v"), "k").collect()]
    for number in (0, 3, 55, 99, 100, 10**6, -4):
        page = table.page(number, 100)
        at = min(max(number, 0), 99) * 100
        assert [(r.k, r.v) for r in page.collect()] == want[at : at + 100]
    assert [(r.k, r.v) for r in table.rows(4_990, 5_000).collect()] == want[4_990:9_990] and table.rows(10_000, 5).count() == 0
    held = [p for p, before, n in table.ranges if before < 5_500 + 100 and 5_500 < before + n]
    plan = table.page(55, 100)._jdf.queryExecution().executedPlan().toString()
    assert len(held) <= 2 < len(table.ranges) and "(part#" in plan.split("PartitionFilters: ")[1].split("]")[0] and f"= {held[0]})" in plan
    empty = paging.OrderedTable(rows.limit(0), ["k"])
    assert empty.page(3, 10).count() == 0 and empty.total == 0


def test_scorers_get_batches_and_views_are_averaged(spark, tmp_path):
    weights = np.array([[1.0, 0.0], [2.0, 1.0], [4.0, -3.0]])
    np.save(tmp_path / "linear-model.npy", weights)
    spark.sparkContext.addFile(str(tmp_path / "linear-model.npy"))
    rows = [(1, [1.0, 2.0, 3.0]), (2, None), (3, [1.0, None, 2.0]), (4, [1.0]), (5, [math.nan, 0.0, 0.0]), (None, [0.0, 1.0, 0.0]), (7, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "k long, x array<double>").selectExpr("*", "'a' as scores")
    own = {r.k: r.scores for r in scoring.scored(df, ["k"], "x", "linear-model.npy", scoring.linear, 2).collect()}
    assert own == {1: [17.0, -7.0], 2: None, 3: None, 4: None, 5: None, None: [2.0, 1.0], 7: [35.0, -10.0]}
    views = [([0, 1, 2], [0, 1]), ([2, 1, 0], [1, 0])]
    got = {r.k: r.scores for r in scoring.scored(df, ["k"], "x", "linear-model.npy", scoring.linear, 2, views).collect()}
    turned = np.array([3.0, 2.0, 1.0]) @ weights
    assert got[1] == [(17.0 + turned[1]) / 2, (-7.0 + turned[0]) / 2] and got[2] is None
    assert scoring.scored(df.limit(0), ["k"], "x", "linear-model.npy", scoring.linear, 2).count() == 0
    pair = spark.createDataFrame([([1.0, 5.0], [6.0, 0.0]), ([5.0, 1.0], [5.0, 2.0])], "a array<double>, b array<double>")
    best, view = scoring.best_view(["a", "b"])
    assert [(r.s, r.v) for r in pair.select(best.alias("s"), view.alias("v")).collect()] == [([6.0, 0.0], 1), ([5.0, 1.0], 0)]
