"""Archives by place: scans with offsets, reads at offsets, the name index."""

import pytest
from pyspark.sql import functions as F

from boardmill.sources import archive

GAMES = [("Rome 1", "Ponziani, D.", "Lolli, G.", "1. e4 e5 2. Nf3 *"), ("Rome 2", "Lolli, G.", "Ponziani, D.", "1. d4 d5\n2. c4 {a [b] c} *"), ("Paris", "Philidor, A.", "Legall", "1. f4 *"), ("Rome 3", "Ponziani, D.", "Lolli, G.", "1. c4 *")]


def text(games):
    return "\n".join(f'[Event "{e}"]\n[White "{w}"]\n[Black "{b}"]\n\n{m}\n' for e, w, b, m in games)


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "games"
    place.mkdir()
    (place / "a.pgn").write_bytes(b"\xef\xbb\xbf" + text(GAMES).encode())
    (place / "b.pgn").write_bytes(text(GAMES[2:3]).replace("\n", "\r\n").encode())
    (place / "empty.pgn").write_bytes(b"")
    (place / "no game.pgn").write_bytes(b"nothing here\n[Site \"x\"]\n")
    return place


def events(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.offset, r.headers["Event"], r.white, r.black, r.movetext) for r in df.collect())


def test_offsets_don_t_depend_on_the_ranges(spark, folder):
    whole = events(archive.read_archive(spark, str(folder)))
    raw = {p.name: p.read_bytes() for p in folder.iterdir()}
    assert [(f, e) for f, _, e, *_ in whole] == [("a.pgn", e) for e, *_ in GAMES] + [("b.pgn", "Paris")]
    assert all(raw[f][o:].startswith(f'[Event "{e}"'.encode()) for f, o, e, *_ in whole)
    assert whole[0][1] == 3 and whole[1][3:] == ("lolli", "ponziani", "1. d4 d5\n2. c4 {a [b] c} *") and whole[4][5] == "1. f4 *"
    for size in (50, 83, 84, 85):
        assert events(archive.read_archive(spark, str(folder), split_bytes=size)) == whole


def test_ranges_cut_records_nowhere():
    import pyarrow as pa

    raw = text(GAMES * 5).encode()
    want = [(k, raw[k:]) for k in range(len(raw)) if raw[k:].startswith(b"[Event ") and (k == 0 or raw[k - 1 : k] == b"\n")]
    want = [(o, r[: (want[i + 1][0] - o - 1) if i + 1 < len(want) else None]) for i, (o, r) in enumerate(want)]
    for chunk in (16, 17, 40, 64):
        archive.CHUNK_BYTES, before = chunk, archive.CHUNK_BYTES
        try:
            for size in (1, 3, 40, 1000):
                got = [x for s in range(0, len(raw), size) for x in archive._records(pa.BufferReader(raw), s, s + size)]
                assert got == want
        finally:
            archive.CHUNK_BYTES = before


def test_reads_at_right_wrong_and_foreign_offsets(spark, folder):
    found = archive.read_archive(spark, str(folder)).select("path", "offset", F.col("headers")["Event"].alias("want"))
    again = archive.games_at(found.select("*", F.lit(1).alias("headers2"))).collect()
    assert len(again) == 5 and all(r.headers["Event"] == r.want and r.headers2 == 1 for r in again)
    paths = {p.rsplit("/", 1)[-1]: p for p in (r.path for r in found.collect())}
    odd = [(paths["a.pgn"], 0), (paths["a.pgn"], 4), (paths["a.pgn"], 10**9), (paths["a.pgn"], -1), (paths["a.pgn"], None), (paths["b.pgn"], again[1].offset + 1), (paths["a.pgn"] + ".gone", 3), (None, 3)]
    rows = archive.games_at(spark.createDataFrame(odd, "path string, offset long")).collect()
    assert len(rows) == len(odd) and all(r.movetext is None and r.white is None and r.headers is None for r in rows)


def test_a_broken_file_is_a_row_and_the_others_go_on(spark, folder, monkeypatch):
    files = archive.archive_files(spark, str(folder)).union(spark.createDataFrame([(f"file:{folder}/gone.pgn", 9)], "path string, length long"))
    rows = archive.scan_files(files, 1 << 20, True).collect()
    bad = [r for r in rows if r.error]
    assert len(rows) == 6 and len(bad) == 1 and bad[0].path.endswith("gone.pgn") and "FileNotFound" in bad[0].error and bad[0].white is None
    with pytest.raises(Exception, match="gone.pgn"):
        archive.scan_files(files, 1 << 20, False).collect()


def test_index_looks_up_both_colours_and_checks_names(spark, folder, tmp_path):
    index = str(tmp_path / "index")
    assert archive.write_name_index(spark, str(folder), index) == 5
    opened = archive.open_name_index(spark, str(folder), index)
    asked = spark.createDataFrame([("Ponziani, Domenico", "LOLLI"), ("Nobody", "Legall"), (None, "x"), ("", ""), ("Ponziani", "Lolli")], "one string, two string")
    got = archive.lookup_games(opened, asked).collect()
    assert sorted((r.one, r.two, r.swapped, r.headers["Event"]) for r in got) == [("ponziani", "lolli", False, "Rome 1"), ("ponziani", "lolli", False, "Rome 3"), ("ponziani", "lolli", True, "Rome 2")]
    assert {r.headers["Event"] for r in archive.lookup_games(opened, asked, both_colours=False).collect()} == {"Rome 1", "Rome 3"}
    assert sorted(r.headers["Event"] for r in archive.lookup_games(opened, asked, limit=2).collect()) == ["Rome 1", "Rome 2"]
    # a row as a collision of hashes would make it: the record read has other names
    first = opened.where("offset > 3").limit(1).select("path", "offset").first()
    wrong = spark.createDataFrame([("nobody", "legall", first.path, 3)], "w string, b string, path string, offset long").select(archive.pair_hash(F.col("w"), F.col("b")).alias("pair"), "path", "offset")
    assert archive.lookup_games(opened.unionByName(wrong.withColumn("bucket", archive._bucket(F.col("pair")))), asked.where("one = 'Nobody'")).count() == 0


def test_limits_of_each_colour(spark, tmp_path):
    games = [(f"w{k}", "Polerio", "Greco", "1. e4 *") for k in range(9)] + [(f"b{k}", "Greco", "Polerio", "1. e4 *") for k in range(2)] + [(f"s{k}", "Salvio", "Boi", "1. e4 *") for k in range(9)]
    (tmp_path / "g.pgn").write_text(text(games))
    index = str(tmp_path / "index")
    archive.write_name_index(spark, str(tmp_path / "g.pgn"), index)
    opened = archive.open_name_index(spark, str(tmp_path / "g.pgn"), index)
    asked = spark.createDataFrame([("Polerio", "Greco"), ("Boi", "Salvio")], "one string, two string")
    for limit, want in ((4, [2, 2, 4]), (6, [4, 2, 6]), (1, [1, 0, 1]), (40, [9, 2, 9])):
        names = [r.headers["Event"][0] for r in archive.lookup_games(opened, asked, limit=limit).collect()]
        assert [names.count("w"), names.count("b"), names.count("s")] == want


def test_stale_and_unfinished_indexes_answer_nothing(spark, folder, tmp_path, monkeypatch):
    index = str(tmp_path / "index")
    assert archive.open_name_index(spark, str(folder), index).count() == 0  # none yet
    archive.write_name_index(spark, str(folder), index)
    assert archive.open_name_index(spark, str(folder), index).count() == 5
    monkeypatch.setattr(archive, "INDEX_VERSION", 99)
    assert archive.open_name_index(spark, str(folder), index).count() == 0
    monkeypatch.undo()
    (folder / "c.pgn").write_text(text(GAMES[:1]))
    assert archive.open_name_index(spark, str(folder), index).count() == 0
    assert archive.write_name_index(spark, str(folder), index) == 6
    assert archive.open_name_index(spark, str(folder), index).count() == 6


def test_plans_read_buckets_and_no_whole_files(spark, folder, tmp_path):
    index = str(tmp_path / "index")
    archive.write_name_index(spark, str(folder), index)
    rows = archive.index_rows(archive.open_name_index(spark, str(folder), index), "ponziani", "lolli")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 3 and rows.where("colouring = 1").count() == 1
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") and "PushedFilters: [In(pair" in plan
    listed = archive.read_archive(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in listed


def test_small_ranges_don_t_make_a_task_each_and_lookups_read_little(spark, tmp_path):
    import pyarrow as pa

    text = "".join(f'[Event "{k}"]\n[White "A \\"B\\" C"]\n[White "late"]\n[Black "Q"]\n\n1. e4 *\n\n' for k in range(300))
    (tmp_path / "a.pgn").write_text(text)
    found = archive.read_archive(spark, str(tmp_path), split_bytes=64)
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(int(r.headers["Event"]) for r in found.collect()) == list(range(300)) and {r.headers["White"] for r in found.collect()} == {'A "B" C'}

    class Counted:
        def __init__(self):
            self.inner, self.bytes = pa.BufferReader(text.encode()), 0  # counted below

        def size(self):
            return self.inner.size()

        def seek(self, at):
            return self.inner.seek(at)

        def read(self, n):
            got = self.inner.read(n)
            self.bytes += len(got)
            return got

    handle = Counted()
    assert archive._record_at(handle, 0).startswith(b'[Event "0"]') and handle.bytes <= 2 * archive.LOOKUP_BYTES


def test_offsets_are_read_again_without_a_join(spark):
    import __spark_entry__

    read = __spark_entry__.queries()["archive_offsets"](spark, "/root/testdata/sf0.001")
    assert read.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    # the scan looks as small to Spark as its list of ranges, so a join would send it whole to the driver and every task
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_small_ranges_read_little():
    import pyarrow as pa

    raw = text(GAMES * 10_000).encode()

    class Counted:
        def __init__(self):
            self.inner, self.bytes = pa.BufferReader(raw), 0

        def seek(self, at):
            return self.inner.seek(at)

        def read(self, n):
            got = self.inner.read(n)
            self.bytes += len(got)
            return got

    handle = Counted()
    assert len(list(archive._records(handle, 10_000, 20_000))) > 100 and handle.bytes <= 10_000 + 2 * archive.LOOKUP_BYTES
