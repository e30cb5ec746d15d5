"""Near-duplicate groups and nearest neighbours against sequential versions."""

import random

import pytest
from pyspark.sql import functions as F

from boardmill.operators import leaders, pages, similarity

MASK = 2**64 - 1


def ham(a, b):
    return sum(((x ^ y) & MASK).bit_count() for x, y in zip(a, b, strict=True))


def sequential(rows, distance):
    out = set()
    for block in {r[1] for r in rows}:
        heads, groups = [], {}
        for name, _, w in sorted(r for r in rows if r[1] == block):
            head = next((n for n, v in heads if ham(v, w) <= distance), None)
            if head is None:
                heads.append((name, w))
            groups.setdefault(head or name, []).append(name)
        out |= {(g, n) for g, ns in groups.items() if len(ns) > 1 for n in ns}
    return out


def noisy(rng, base, most):
    words = list(base)
    for _ in range(rng.randint(0, most)):
        words[rng.randrange(len(words))] ^= 1 << rng.randrange(62)
    return words


def random_rows(seed, n, blocks, centres, words=4, most=4):
    rng = random.Random(seed)
    base = [[rng.getrandbits(64) - 2**63 for _ in range(words)] for _ in range(centres)]
    names = [f"f{k:05d}" for k in range(n)]
    rng.shuffle(names)
    return [(name, f"p{rng.randrange(blocks)}", noisy(rng, rng.choice(base), most)) for name in names]


def frame(spark, rows):
    return spark.createDataFrame(rows, "name string, placement string, words array<long>").repartition(3)


@pytest.mark.parametrize(("seed", "n", "blocks", "centres", "words", "most", "distance", "pairs"), [(1, 300, 3, 8, 4, 4, 3, 32), (2, 60, 1, 1, 1, 4, 3, 0), (3, 120, 2, 2, 1, 6, 2, 2)])
def test_groups_equal_a_sequential_pass(spark, monkeypatch, seed, n, blocks, centres, words, most, distance, pairs):
    monkeypatch.setattr(leaders, "PAIRS_PER_ROW", pairs)  # 0: rounds by bands decide all
    rows = random_rows(seed, n, blocks, centres, words, most)
    got = [tuple(r) for r in leaders.near_duplicate_groups(frame(spark, rows), "name", "placement", "words", distance).collect()]
    assert len(got) == len(set(got)) and set(got) == sequential(rows, distance)


def test_chains_nulls_and_empty_tables(spark):
    chain = [(f"c{k:02d}", "p", [(1 << k) - 1]) for k in range(24)]  # each a bit from the next: leaders depend on each other
    assert {tuple(r) for r in leaders.near_duplicate_groups(frame(spark, chain), "name", "placement", "words", 1).collect()} == sequential(chain, 1)
    odd = frame(spark, [(None, "p", [1]), ("a", None, [1]), ("b", "p", None), ("x", "p", [1]), ("y", "p", [1])])
    assert {tuple(r) for r in leaders.near_duplicate_groups(odd, "name", "placement", "words").collect()} == {("x", "x"), ("x", "y")}
    assert leaders.near_duplicate_groups(odd.limit(0), "name", "placement", "words").count() == 0


def test_a_block_of_equal_rows_takes_many_tasks_and_no_pairs(spark):
    rows = spark.range(100_000).select(F.format_string("f%06d", "id").alias("name"), F.lit("start").alias("placement"), F.array(F.when(F.col("id") % 7 == 0, 1).otherwise(0).cast("long")).alias("words"))
    found = leaders.near_duplicate_groups(rows, "name", "placement", "words")
    assert found.groupBy("leader").count().collect()[0].asDict() == {"leader": "f000000", "count": 100_000}
    dense = spark.range(400).select(F.format_string("f%06d", "id").alias("name"), F.lit("start").alias("placement"), F.array(F.col("id")).alias("words"))
    assert {tuple(r) for r in leaders.near_duplicate_groups(dense, "name", "placement", "words").collect()} == sequential([(f"f{k:06d}", "start", [k]) for k in range(400)], 3)


@pytest.mark.parametrize(("words", "spread", "apart", "few"), [(1, 40, True, 0), (4, 30, False, 0), (1, 40, True, 1 << 30)])
def test_nearest_of_all_equals_brute_force(spark, monkeypatch, words, spread, apart, few):
    monkeypatch.setattr(similarity, "FEW_PAIRS", few)
    rng = random.Random(words + spread)
    base = [[rng.getrandbits(64) - 2**63 for _ in range(words)] for _ in range(4)]
    rows = [(k, f"g{k % 3}", noisy(rng, rng.choice(base), spread)) for k in range(160)] + [(k, "g1", list(base[0])) for k in range(160, 190)]
    index = spark.createDataFrame(rows, "row long, book string, words array<long>")
    samples = index.where("row % 5 = 0").select(F.col("row").alias("sample"), "words")
    got = {r.sample: (r.row, r.book, r.distance, r.runner_up, r.ambiguous) for r in similarity.nearest(samples, index, "sample", "row", "book", "words", None, apart=apart).collect()}
    want = {}
    for k, _, w in rows:
        if k % 5 == 0:
            best = sorted((ham(w, v), r, g) for r, g, v in rows if not (apart and r == k))
            other = min(d for d, _, g in best if g != best[0][2])
            want[k] = (best[0][1], best[0][2], best[0][0], other, other - best[0][0] < similarity.AMBIGUITY)
    assert got == want


def test_nearest_with_one_group_or_no_row(spark, monkeypatch):
    monkeypatch.setattr(similarity, "FEW_PAIRS", 0)
    index = spark.createDataFrame([(1, "g", [0]), (2, "g", [2**63 - 1])], "row long, book string, words array<long>")
    samples = spark.createDataFrame([(7, [1]), (8, [2**62 - 1]), (9, [-1])], "sample long, words array<long>")
    find = lambda i: {r.sample: (r.row, r.distance, r.runner_up, r.ambiguous) for r in similarity.nearest(samples, i, "sample", "row", "book", "words", None).collect()}
    assert find(index) == {7: (1, 1, None, False), 8: (2, 1, None, False), 9: (2, 1, None, False)}
    assert find(index.where("row = 1")) == {7: (1, 1, None, False), 8: (1, 62, None, False), 9: (1, 64, None, False)}
    assert find(index.limit(0)) == {}


def test_search_has_no_nested_loop(spark, monkeypatch):
    monkeypatch.setattr(similarity, "FEW_PAIRS", 0)
    rng = random.Random(9)
    index = spark.createDataFrame([(k, f"g{k % 3}", [rng.getrandbits(63)]) for k in range(50)], "row long, book string, words array<long>")
    found = similarity.nearest(index.select(F.col("row").alias("sample"), "words"), index, "sample", "row", "book", "words", None, apart=True)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 50


def test_nearest_by_blocks_and_by_narrow_bands(spark, monkeypatch):
    """Several blocks on both sides; neither search multiplies samples by flipped bits or by bands of a few bits."""
    monkeypatch.setattr(similarity, "SAMPLE_BLOCK", 7)
    monkeypatch.setattr(similarity, "ROW_BLOCK", 20)
    rng = random.Random(5)
    base = [[rng.getrandbits(64) - 2**63] for _ in range(3)]
    rows = [(k, None if k % 4 == 3 else k % 4, noisy(rng, rng.choice(base), 30)) for k in range(120)]
    index = spark.createDataFrame([*rows, (500, 1, None), (501, 1, [None])], "row long, book int, words array<long>")
    samples = index.where("row % 5 = 0").select(F.col("row").alias("sample"), "words")
    want = {k: min((ham(w, v), r) for r, _, v in rows if r != k) for k, _, w in rows if k % 5 == 0}
    for most in (None, 18):
        found = similarity.nearest(samples, index, "sample", "row", "book", "words", most, apart=True)
        assert {r.sample: (r.distance, r.row) for r in found.collect()} == {k: m for k, m in want.items() if most is None or m[0] <= most}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "_mask" not in plan and "_band" not in plan


def test_equal_boxes_meet_once(spark):
    """Many copies of few boxes: as many pairs as different boxes have, and the results of the sequential rules."""
    rng = random.Random(3)
    shapes = [(float(x), float(y), x + 60.0, y + 60.0) for x, y in ((rng.randrange(80), rng.randrange(80)) for _ in range(6))]
    rows = [(0, k, *shapes[k % 6], (k * 53 % 100) / 100) for k in range(90)]
    boxes = spark.createDataFrame(rows, "page int, idx int, x0 double, y0 double, x1 double, y1 double, score double")
    over = lambda a, b: similarity._overlap(dict(zip(similarity.BOX, a, strict=True)), dict(zip(similarity.BOX, b, strict=True)))
    used, want = set(), []
    for value, a, b in sorted(((over(r[2:6], s[2:6]), r[1], s[1] + 1000) for r in rows for s in rows if s[1] % 3), reverse=True):
        if value >= similarity.MATCH_IOU and not {a, b} & used:
            used |= {a, b}
            want.append((a, b, value))
    read = boxes.where("idx % 3 != 0").withColumn("idx", F.col("idx") + 1000)
    assert sorted(map(tuple, similarity.match_boxes(boxes, read, ["page"]).drop("page").collect())) == sorted(want)
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if not any(over(r[2:6], k[2:6]) > 0.9 for k in kept):
            kept.append(r)
    assert sorted(r.idx for r in pages.predupe(boxes, ["page"]).collect()) == sorted(k[1] for k in kept)
    assert similarity.equal_boxes(boxes, ["page"]).count() == len(set(shapes))
