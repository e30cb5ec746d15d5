"""Files that the writers leave, migrations, and the kernels against plain versions."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from boardmill.functions import replay
from boardmill.operators import leaders, similarity
from boardmill.sources import sinks


def lines(folder):
    return [line for f in sorted(glob.glob(f"{folder}/part-*")) for line in open(f, encoding="utf-8").read().splitlines()]


def test_csv_writers(spark, tmp_path):
    rows = spark.createDataFrame([("b", "val"), ("a", "train"), ("c", "test")], "filename string, split string").repartition(3)
    sinks.write_splits(rows, str(tmp_path / "splits"))
    assert [r for r in lines(tmp_path / "splits") if r != "filename,split"] == ["a,train", "b,val", "c,test"]
    census = spark.range(3).select(*[F.col("id").cast("string").alias(c) for c in sinks.CENSUS_COLUMNS])
    sinks.write_census(census, str(tmp_path / "census"))
    assert lines(tmp_path / "census")[0] == ",".join(sinks.CENSUS_COLUMNS)
    sinks.write_rejections(census.withColumn("reason", F.lit("small")).withColumns({"score": F.lit(1), "checker": F.lit(0)}), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).where("reason = 'small'").count() == 3


def test_annotations_and_matches(spark, tmp_path):
    notes = lambda book, n: spark.range(n).select(F.lit(book).alias("book"), F.col("id").alias("page"))
    sinks.write_annotations(notes("x", 3).union(notes("y", 2)), str(tmp_path / "notes"))
    sinks.write_annotations(notes("x", 1), str(tmp_path / "notes"))
    assert {(r.book, r["count"]) for r in spark.read.json(str(tmp_path / "notes")).groupBy("book").count().collect()} == {("x", 1), ("y", 2)}
    sinks.write_matches(notes("x", 3), str(tmp_path / "matches"))
    got = spark.read.json(str(tmp_path / "matches")).collect()
    assert [(r.version, r.book, [d.page for d in r.diagrams]) for r in got] == [(2, "x", [0, 1, 2])]


def test_backup(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(5).write.parquet(path)
    copy = sinks.backup(spark, path, "20240101")
    spark.range(1).write.mode("overwrite").parquet(path)
    assert spark.read.parquet(copy).count() == 5 and spark.read.parquet(path).count() == 1
    with pytest.raises(FileExistsError):
        sinks.backup(spark, path, "20240101")


def test_ledger_migration(spark, tmp_path):
    old, new = str(tmp_path / "ledger.json"), str(tmp_path / "ledger")
    spark.createDataFrame([("f", "8/8", 2), ("f", "8/p7", 0)], "fingerprint string, placement string, count int").write.json(old)
    assert sinks.migrate_ledger(spark, old, new, "another database") == 0 and os.path.exists(old)
    assert sinks.migrate_ledger(spark, old, new, "f") == 2
    assert not os.path.exists(old) and os.path.exists(f"{old}.migrated") and sinks.migrate_ledger(spark, old, new, "f") == 0


def test_hash_index_grows_by_book(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = lambda book, n: spark.range(n).select(F.lit(book).alias("source_pdf"), F.col("id").alias("page"))
    sinks.write_hash_index(rows("a", 3).union(rows("b", 2)), path, 150, 16)
    sinks.write_hash_index(rows("a", 1), path, 150, 16)
    assert {(r.source_pdf, r["count"]) for r in spark.read.parquet(path).groupBy("source_pdf").count().collect()} == {("a", 1), ("b", 2)}
    with pytest.raises(ValueError):
        sinks.write_hash_index(rows("c", 1), path, 200, 16)


def test_look_ups(spark):
    rows = spark.createDataFrame([("a", "p", [0]), ("b", "p", [1]), ("c", "q", [0]), ("d", "q", [0]), ("e", "p", [-1])], "name string, block string, words array<long>")
    got = leaders.duplicates_touching(rows, spark.createDataFrame([("b",)], "name string"), "name", "block", "words", 2)
    assert {(r.leader, r.name) for r in got.collect()} == {("a", "a"), ("a", "b")}


def boxes(seed, pages=12):
    rng = random.Random(seed)
    return [(p, k, x := rng.uniform(0, 60), y := rng.uniform(0, 60), x + rng.uniform(5, 40), y + rng.uniform(5, 40), round(rng.random(), 2), 80.0) for p in range(pages) for k in range(rng.randint(0, 9))]


SCHEMA = "page int, idx int, x0 double, y0 double, x1 double, y1 double, score double, side_pt double"


def overlap(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    if w <= 0 or h <= 0:
        return 0.0
    size = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    return w * h / (size(a) + size(b) - w * h)


def test_matching_equals_a_plain_version(spark):
    one, two = boxes(1), boxes(1)
    two = [(*r[:2], r[2] + r[1] % 3, *r[3:]) for r in two]
    got = {(r.page, r.annotation, r.reading, round(r.iou, 9)) for r in similarity.match_boxes(spark.createDataFrame(one, SCHEMA), spark.createDataFrame(two, SCHEMA), ["page"]).collect()}
    want = set()
    for page in {r[0] for r in one}:
        pairs = sorted(((overlap(a, b), a[1], b[1]) for a in one for b in two if a[0] == b[0] == page and overlap(a, b) >= 0.5), reverse=True)
        while pairs:
            v, a, b = pairs[0]
            want.add((page, a, b, round(v, 9)))
            pairs = [p for p in pairs if p[1] != a and p[2] != b]
    assert got == want and len(want) > 20


def test_suppression_equals_a_plain_version(spark):
    rows = boxes(2)
    got = {(r.page, r.idx): r.reason for r in similarity.suppress(spark.createDataFrame(rows, SCHEMA), ["page"], most=3).collect()}
    for page in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == page), key=lambda r: (-r[6], r[1]))
        kept = []
        for r in own:
            reason = "low_score" if r[6] < max(0.06, 0.25 * own[0][6]) else "overlap" if any(overlap(r, k) > 0.25 for k in kept) else "limit" if len(kept) == 3 else ""
            kept += [r] if not reason else []
            assert got.pop((page, r[1])) == reason
    assert not got


def test_tiles_equal_a_plain_version(spark):
    rows = boxes(3)
    got = {(r.page, r.tiles, round(r.x0, 6), round(r.y1, 6)) for r in similarity.merge_tiles(spark.createDataFrame(rows, SCHEMA), ["page"]).collect()}
    want = set()
    for page in {r[0] for r in rows}:
        left = [r for r in rows if r[0] == page]
        while left:
            group, edge = [], [left.pop()]
            while edge:
                r = edge.pop()
                group.append(r)
                near = [o for o in left if max(r[2], o[2]) - min(r[4], o[4]) <= 2 and max(r[3], o[3]) - min(r[5], o[5]) <= 2]
                left = [o for o in left if o not in near]
                edge += near
            want.add((page, len(group), round(min(r[2] for r in group), 6), round(max(r[5] for r in group), 6)))
    assert got == want


def test_gate_lets_wanted_positions_through(spark):
    games = [(1, "1. e4 e5 2. Nf3 Nc6 3. Bb5 a6 4. Bxc6 dxc6 5. O-O", None), (2, "1. d4 d5 2. c4 e6 {x} 3. Nc3 (3. Nf3) Nf6", None), (3, "1. Kd2", "8/8/8/8/8/8/8/4K2k w - - 0 1"), (4, None, None)]
    frame = spark.createDataFrame(games, "g int, movetext string, setup_fen string")
    every = {tuple(r) for r in replay.replay(frame, ["g"]).collect()}
    for some in (sorted(every)[::3], []):
        wanted = spark.createDataFrame([(r[2],) for r in some] + [(None,)], "placement string")
        got = {tuple(r) for r in replay.replay(frame, ["g"], wanted=wanted).select("g", "ply", "placement", "move_number", "white_to_move").collect()}
        assert got == {r for r in every if r[2] in {s[2] for s in some}}


@pytest.mark.parametrize("text, side", [
    ("11: Brancas jogam *", "w"), ("31: Jogada das pretas **", "b"), ("22: Jogada de pretas *", "b"), ("40: Jogar de pretas **", "b"), ("77: Jogam as pretas", "b"), ("As negras jogam e ganham", "b"),
    ("É a vez das brancas", "w"), ("White to play and win", "w"), ("Black plays", "b"), ("Weiß am Zug", "w"), ("Weiss zieht und gewinnt", "w"), ("am Zug: Schwarz", "b"), ("Juegan las negras", "b"), ("turno de las blancas", "w"),
    ("les noirs jouent", "b"), ("White won the game after a long endgame", None), ("White wins", None), ("Se as brancas jogam 32.f2xg2", None), ("after white plays", None), ("White to move, black to move", None),
])
def test_side_phrases(spark, text, side):
    from boardmill.functions.text import side_phrase

    got = spark.createDataFrame([(text,)], "t string").select(side_phrase("t")["side"].alias("s")).first().s
    assert got == side
