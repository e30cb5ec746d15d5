"""Game archives by place: scans that give each record's file and byte offset, reads that seek to an offset, a name index.

Files are cut into byte ranges, one row each, that Spark deals to tasks; a record belongs to the
range that holds its first byte, and only records, never whole files, are held in memory.  Files
are opened through Arrow's file systems, so a path may be in any store that Arrow opens.

The name index has a row (pair, path, offset) for each record with both players, in folders by
bucket of the pair's hash, each sorted by the hash, with Bloom filters.  A look-up reads the
buckets of its pairs and seeks to the records found; names are compared with the record that was
read, so pairs with equal hashes are told apart.  A manifest is written last: version and
fingerprint of the files.  An index without one, of another version or of other files answers
nothing, as its offsets would point into other games.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import surname
from .records import fingerprint, parsed_records

SPLIT_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20
#: Bytes first read of a record that is looked up; each further read takes four times as many, up to CHUNK_BYTES.
LOOKUP_BYTES = 1 << 12
#: Records, and bytes of them, of an Arrow batch at most.
BATCH_RECORDS, BATCH_BYTES = 10_000, 8 << 20
INDEX_VERSION = 1
INDEX_BUCKETS = 256
GAMES_PER_LOOKUP = 40
_MARK = b"[Event "
_BOM = b"\xef\xbb\xbf"


def archive_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length) of the files that aren't empty; only listed, their content isn't read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length")


def _opened(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, place = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
    return system.open_input_file(place)


def _records(handle: pa.NativeFile, start: int, end: int, first: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records that begin in [start, end); the last may go on behind the end.

    ``first`` is the number of bytes to begin with where few are wanted.
    """
    base = max(0, start - 1)  # the line break before a record may be the last byte of the range before
    size = min(first or end - base + LOOKUP_BYTES, CHUNK_BYTES)  # a small range and its last record's end
    handle.seek(base)
    held, own, searched = b"", None, 0
    while True:
        chunk = handle.read(size)
        size = min(4 * size, CHUNK_BYTES)
        if start == 0 and not base and not held:  # the file's first record has no line break before it
            lead = len(_BOM) if chunk.startswith(_BOM) else 0
            own = lead if chunk[lead : lead + len(_MARK)] == _MARK else None
        held += chunk
        while (at := held.find(b"\n" + _MARK, searched)) >= 0:
            if own is not None:
                yield own, held[own - base : at]
                own = None
            if base + at + 1 >= end:
                return
            own, searched = base + at + 1, at + 1
        if not chunk:
            if own is not None:
                yield own, held[own - base :]
            return
        searched = max(0, len(held) - len(_MARK))
        if own is None and base + searched >= end:
            return
        # what lies before is left away once for a chunk, not for each record
        done = searched if own is None else own - base
        held, base, searched = held[done:], base + done, searched - done


def _texts(raw: list[bytes | None]) -> pa.Array:
    return pa.array([None if r is None else r.decode("utf-8", "replace").replace("\r", "") for r in raw], pa.string())


def read_archive(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES, keep_errors: bool = False) -> DataFrame:
    """(path, offset, headers, setup_fen, movetext, white, black) of every record; ``offset`` is the byte where it begins.

    With ``keep_errors`` there is one more column, error: a range that can't be read gives one row
    with the error's text and nulls instead of ending the job, and the other ranges are read.
    Empty files, and bytes before a file's first record, give no row.

    To Spark these rows, and those of ``games_at`` on them, look as small as the list of ranges, so that a
    join may send them whole to every task: stage them first, or carry what belongs to a record along.
    """
    return scan_files(archive_files(spark, paths), split_bytes, keep_errors)


def scan_files(files: DataFrame, split_bytes: int = SPLIT_BYTES, keep_errors: bool = False) -> DataFrame:
    """``read_archive`` of files that are listed already, as (path, length)."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = files.where("length > 0").select("path", F.explode(starts).alias("start"))
    # a task for each range while they are few, then one for SPLIT_BYTES of them: small ranges don't make a task each
    count = ranges.count()
    tasks = max(1, min(count, max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-count * split_bytes // SPLIT_BYTES))))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: list[tuple[int, bytes]] = []
                size = 0

                def packed(path: str = path, rows: list = found, error: str | None = None) -> pa.RecordBatch:
                    n = len(rows)
                    columns = [pa.array([path] * n, pa.string()), pa.array([o for o, _ in rows], pa.int64()), _texts([r for _, r in rows]), pa.array([error] * n, pa.string())]
                    return pa.RecordBatch.from_arrays(columns, ["path", "offset", "_r", "error"])

                try:
                    with _opened(path) as handle:
                        for record in _records(handle, start, start + split_bytes):
                            found.append(record)
                            size += len(record[1])
                            if len(found) >= BATCH_RECORDS or size >= BATCH_BYTES:
                                yield packed()
                                found.clear()
                                size = 0
                except OSError as broken:
                    if not keep_errors:
                        raise
                    yield packed()
                    yield packed(path, [(start, None)], f"{type(broken).__name__}: {broken}")
                    continue
                yield packed()

    raw = ranges.repartition(tasks).mapInArrow(kernel, "path string, offset long, _r string, error string")
    return parsed_records(raw, ["path", "offset"] + ["error"] * keep_errors)


def games_at(lookups: DataFrame, path: str = "path", offset: str = "offset") -> DataFrame:
    """The look-ups with headers, setup_fen, movetext, white and black of the record that begins at their offset of their file.

    All five are null where no record begins there, or the file can't be read or is null.  Only the
    records asked for are read.
    """
    row = lookups.select(F.struct(*lookups.columns).alias("_row"), F.col(path).alias("_path"), F.col(offset).cast("long").alias("_offset"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle, opened = None, None
        for batch in batches:
            found: list[bytes | None] = []
            for place, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if place != opened:
                    opened = place
                    try:
                        handle = None if place is None else _opened(place)
                    except OSError:
                        handle = None
                found.append(None if handle is None or at is None else _record_at(handle, at))
            yield pa.RecordBatch.from_arrays([batch.column(0), _texts(found)], ["_row", "_r"])

    schema = T.StructType([row.schema["_row"], T.StructField("_r", T.StringType())])
    return parsed_records(row.sortWithinPartitions("_path", "_offset").mapInArrow(kernel, schema), [f"_row.`{c}`" for c in lookups.columns])


def _record_at(handle: pa.NativeFile, at: int) -> bytes | None:
    """The record that begins at this byte, or None."""
    if not 0 <= at < handle.size():
        return None
    handle.seek(max(0, at - 1))
    lead = handle.read(1) if at else b"\n"
    if handle.read(len(_MARK)) != _MARK or lead not in (b"\n", _BOM[-1:]):
        return None
    return next(_records(handle, at, at + 1, LOOKUP_BYTES), (at, None))[1] if lead == b"\n" else next(_records(handle, 0, at + 1, LOOKUP_BYTES), (at, None))[1]


def pair_hash(white: Column, black: Column) -> Column:
    """A number for two surnames in this order, the same in every session."""
    return F.xxhash64(white, F.lit("|"), black)


def _bucket(pair: Column) -> Column:
    return F.pmod(pair, F.lit(INDEX_BUCKETS)).cast("int")


def write_name_index(spark: SparkSession, paths: str | list[str], index: str, split_bytes: int = SPLIT_BYTES) -> int:
    """Writes the name index of an archive to the folder ``index`` and returns its number of rows.

    A new build goes to a folder of its own; the manifest that names it is written last, so one
    that was broken off leaves the index before it in place.
    """
    files = archive_files(spark, paths)
    games = scan_files(files, split_bytes, False).where("white != '' and black != ''")
    rows = games.select(pair_hash(F.col("white"), F.col("black")).alias("pair"), "path", "offset")
    build = f"rows-{uuid.uuid4().hex}"
    order = ["bucket", "pair", "path", "offset"]
    dealt = rows.withColumn("bucket", _bucket(F.col("pair"))).repartitionByRange(*order).sortWithinPartitions(*order)  # ranges also cut a pair with many games
    dealt.write.option("parquet.bloom.filter.enabled#pair", "true").partitionBy("bucket").parquet(f"{index}/{build}")
    manifest = fingerprint(files).select(F.lit(INDEX_VERSION).alias("version"), "fingerprint", F.lit(build).alias("build"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{index}/manifest")
    return spark.read.schema("pair long, path string, offset long, bucket int").parquet(f"{index}/{build}").count()


def open_name_index(spark: SparkSession, paths: str | list[str], index: str) -> DataFrame:
    """(pair, path, offset, bucket) of an index that was made from just these files by this version, else no row."""
    schema = "pair long, path string, offset long, bucket int"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{index}/manifest")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    made = spark.read.schema("version int, fingerprint string, build string").json(f"{index}/manifest").first()
    if made is None or made.version != INDEX_VERSION or made.fingerprint != fingerprint(archive_files(spark, paths)).first().fingerprint:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{index}/{made.build}")


def index_rows(index: DataFrame, one: str, two: str, both_colours: bool = True) -> DataFrame:
    """Rows of an opened index for two surnames; the plan reads their buckets only."""
    spark = index.sparkSession
    asked = [(one, two), (two, one)] if both_colours and one != two else [(one, two)]
    hashes = spark.createDataFrame(asked, "white string, black string").select("white", "black", pair_hash(F.col("white"), F.col("black")).alias("pair"), _bucket(pair_hash(F.col("white"), F.col("black"))).alias("bucket")).collect()
    wanted = [F.when((F.col("bucket") == h.bucket) & (F.col("pair") == h.pair), F.lit(k)) for k, h in enumerate(hashes)]
    rows = index.where(F.col("bucket").isin([h.bucket for h in hashes]) & F.col("pair").isin([h.pair for h in hashes]))
    return rows.withColumn("colouring", F.coalesce(*wanted))


def lookup_games(index: DataFrame, pairs: DataFrame, one: str = "one", two: str = "two", both_colours: bool = True, limit: int = GAMES_PER_LOOKUP) -> DataFrame:
    """(one, two, swapped, path, offset, headers, setup_fen, movetext, white, black): the games of many pairs of players.

    At most ``limit`` records are read for a pair, in the order of path and offset: with both
    colourings each has half of them for itself, and what one leaves over the other may take.  The
    names that were asked for are folded to surnames and compared with those of the record read.
    Pairs are asked once each; nulls and empty names have no games.
    """
    name = lambda c: surname(F.coalesce(F.col(c).cast("string"), F.lit("")))
    asked = pairs.select(name(one).alias("one"), name(two).alias("two")).where("one != '' and two != ''").distinct()
    own = asked.select("*", F.lit(False).alias("swapped"), pair_hash(F.col("one"), F.col("two")).alias("pair"))
    if both_colours:
        own = own.union(asked.where("one != two").select("*", F.lit(True), pair_hash(F.col("two"), F.col("one"))))
    found = own.withColumn("bucket", _bucket(F.col("pair"))).join(index, ["bucket", "pair"])  # Spark prunes buckets at run time
    key, place = ["one", "two"], ["path", "offset"]
    few = found.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "swapped").orderBy(*place))).where(F.col("_n") <= limit)
    # colourings of a pair; few rows are left for each pair
    colours = F.size(F.collect_set("swapped").over(Window.partitionBy(*key)))
    late = F.col("_n") > F.greatest(F.lit(1), F.floor(F.lit(limit) / colours))
    ranked = few.withColumn("_late", late).withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("_late", "swapped", "_n"))).where(F.col("_k") <= limit)
    read = games_at(ranked.select("one", "two", "swapped", "path", "offset"))
    right = F.when(F.col("swapped"), (F.col("white") == F.col("two")) & (F.col("black") == F.col("one"))).otherwise((F.col("white") == F.col("one")) & (F.col("black") == F.col("two")))
    return read.where(right)
