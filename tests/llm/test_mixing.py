import random
from fractions import Fraction

import pytest

from boardmill.llm.mixing import BLOCK_ROWS, FINE_QUANTUM, QUANTUM, mix_sources, nearest_shares, pfair_slots


@pytest.mark.parametrize("sources,slots", [(1, 50), (20, 6_000), (500, 6_000), (1_500, 4_000)])
def test_slots_stay_within_a_block_of_the_weights(sources, slots):
    rng = random.Random(sources)
    weights = [sources - 1.0] + [rng.uniform(0.5, 1.5) for _ in range(sources - 1)] if sources > 1 else [1.0]
    total = sum(map(Fraction, weights))
    part = [float(Fraction(w) / total) for w in weights]
    done = [0] * sources
    for t, (k, j, slot) in enumerate(pfair_slots(weights, [slots] * sources), 1):
        assert (slot, j) == (t - 1, done[k])
        done[k] += 1
        if t % 97 == 0 or t < 100:
            assert all(abs(d - p * t) < 1 + 1e-9 for d, p in zip(done, part, strict=True))
        if t == slots:
            return


def test_rows_follow_the_weights_over_many_periods(spark):
    """A half beside 19 others: whole shares of 1,000 fall behind by a block every 110 slots."""
    weights = {"big": 19.0} | {f"s{k:02}": 1.0 for k in range(19)}
    rows = [(k, "big") for k in range(40_000)] + [(100_000 + k, f"s{k % 19:02}") for k in range(40_000)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), weights).select("source", "slot").distinct().collect()
    slots = sorted(r.slot for r in got if r.source == "big")
    assert len(slots) == 40_000 // BLOCK_ROWS and slots[-1] > 4 * 1_000
    assert max(abs(k + 1 - (t + 1) / 2) for k, t in enumerate(slots)) < 1


@pytest.mark.parametrize("quantum", [None, QUANTUM])
def test_many_sources(spark, quantum):
    rows = [(k, f"domain{k % 1_200}") for k in range(2_500)] + [(None, None)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), quantum=quantum).collect()
    assert len(got) == len(rows) == len({r.mix_position for r in got})


@pytest.mark.parametrize("quantum", [None, QUANTUM])
def test_sources_without_a_weight_are_an_error(spark, quantum):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "")], "doc_id long, source string")
    with pytest.raises(ValueError, match="'', 'b', null"):
        mix_sources(docs, {"a": 1.0}, quantum=quantum)
    assert mix_sources(docs, {"a": 1.0, "b": 2.0, "": 1.0, None: 1.0, "unseen": 3.0}, quantum=quantum).count() == 4


@pytest.mark.parametrize("sources", [1, 20, 900])
def test_nearest_shares(sources):
    weights = {f"s{k}": float(k % 17 + 1) for k in range(sources)} | {None: 1e-9}
    shares, total = nearest_shares(weights, FINE_QUANTUM), sum(weights.values())
    assert sum(shares.values()) == FINE_QUANTUM and min(shares.values()) == 1
    assert all(abs(shares[s] - FINE_QUANTUM * w / total) <= 2 for s, w in weights.items())


def test_fine_quantum_follows_the_weights(spark):
    rows = [(k, "big") for k in range(20_000)] + [(100_000 + k, f"s{k % 19:02}") for k in range(20_000)]
    weights = {"big": 19.0} | {f"s{k:02}": 1.0 for k in range(19)}
    df = mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), weights, quantum=FINE_QUANTUM, nearest=True)
    assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
    slots = sorted(r.slot for r in df.select("source", "slot").distinct().collect() if r.source == "big")
    assert max(abs(k + 1 - (t + 1) / 2) for k, t in enumerate(slots)) < 1 + len(slots) * 2 / FINE_QUANTUM
