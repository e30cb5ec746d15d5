"""Links that only exact counts find, among documents that share most of what they have."""

import random

import brute

from boardmill.llm.ngram_join import _levels, ngram_components

DOC = "doc_id long, text string"


def boilerplate(n, seed=1, extra=()):
    rng = random.Random(seed)
    blocks = [" ".join(f"b{k}w{j}" for j in range(60)) for k in range(40)]
    return [(k, " ".join(rng.sample(blocks, 10))) for k in range(n)] + list(extra)


def test_levels_hold_linked_sizes():
    for percent in (50, 80, 95, 100):
        top, differ, parts = _levels(3_000, percent)
        level = lambda n: next(k for k, t in enumerate(top) if n <= t)
        for a in range(1, 400):
            largest = a * 100 // percent
            assert level(largest) - level(a) <= 1
            assert 100 * min(a, largest) >= percent * max(a, largest)
            assert differ[level(largest)] >= (a + largest) * (100 - percent) // (100 + percent)
        assert (parts > differ).all()


def test_links_among_boilerplate(spark, seed=1):
    rng = random.Random(seed)
    rows = boilerplate(150, seed)
    texts = dict(rows)
    for k in range(40):  # the same blocks with one exchanged or some words changed, in the same or another order
        words = texts[rng.randrange(150)].split()
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = f"n{k}"
        rows.append((1_000 + k, " ".join(words[rng.randint(0, 90) :])))
    got = ngram_components(spark.createDataFrame(rows, DOC).repartition(4)).collect()
    want = brute.link_components(rows)
    assert sorted(map(tuple, got)) == want and len({r[2] for r in want}) < len(rows) - 15
