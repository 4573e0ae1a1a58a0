from __future__ import annotations

import random
import time

import pytest

from auditweave.operators import bursts

SCHEMA = "key string, ts_ms long, record_id long"


def brute_first(rows, n, window):
    out = set()
    for key in {r[0] for r in rows}:
        mine = sorted((t, i) for k, t, i in rows if k == key)
        for at in range(n - 1, len(mine)):
            if mine[at][0] - mine[at - n + 1][0] <= window:
                out |= {(key, i) for _, i in mine[at - n + 1 : at + 1]}
                break
    return out


def brute_all(rows, n, window):
    mine = sorted((t, i) for _, t, i in rows)
    hits = [mine[at][0] for at in range(n - 1, len(mine)) if mine[at][0] - mine[at - n + 1][0] <= window]
    return {i for t, i in mine if any(0 <= h - t <= window for h in hits)}


@pytest.mark.parametrize("seed", range(8))
def test_random_bursts_match_brute_force(spark, seed):
    rng = random.Random(seed)
    n, window = rng.randrange(1, 6), rng.choice([3, 10, 40])
    rows = [(rng.choice("ab"), rng.randrange(-50, 250), k) for k in range(rng.randrange(0, 120))]
    events = spark.createDataFrame(rows, SCHEMA)
    assert {(r.key, r.record_id) for r in bursts.first_bursts(events, n, window, ["key"]).collect()} == brute_first(rows, n, window)
    assert {r.record_id for r in bursts.all_bursts(events, n, window).collect()} == brute_all(rows, n, window)
    some = brute_all(rows, n, window)
    assert bursts.if_any_burst(events, n, window).count() == (len(rows) if some else 0)


def test_exact_boundary(spark):
    rows = [("a", 0, 1), ("a", 10, 2), ("a", 20, 3)]
    events = spark.createDataFrame(rows, SCHEMA)
    assert bursts.first_bursts(events, 3, 20, ["key"]).count() == 3
    assert bursts.first_bursts(events, 3, 19, ["key"]).count() == 0


def test_only_the_first_of_two_bursts_and_ties(spark):
    rows = [("a", 0, k) for k in range(4)] + [("a", 1000, 10 + k) for k in range(4)]
    found = {r.record_id for r in bursts.first_bursts(spark.createDataFrame(rows, SCHEMA), 3, 5, ["key"]).collect()}
    assert found == {0, 1, 2}
    assert {r.record_id for r in bursts.all_bursts(spark.createDataFrame(rows, SCHEMA), 3, 5).collect()} == {0, 1, 2, 3, 10, 11, 12, 13}


def test_a_busy_window_comes_to_no_single_task(spark):
    """As many events in a window as would take minutes if each were compared with the later ones of its window."""
    events = spark.range(200_000).selectExpr("'a' AS key", "id % 1000 AS ts_ms", "id AS record_id")
    began = time.time()
    assert bursts.all_bursts(events, 6, 10_000_000).count() == 200_000
    assert {r.record_id for r in bursts.first_bursts(events, 6, 10_000_000, ["key"]).collect()} == {1000 * k for k in range(6)}
    assert time.time() - began < 60
    assert bursts.edges(events, 6, 10_000_000, ["key"]).count() == 11
    assert "WindowGroupLimit" in bursts.edges(events, 6, 10_000_000, ["key"])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(4))
def test_bursts_at_the_seams_of_buckets(spark, seed):
    rng = random.Random(100 + seed)
    n, window = rng.randrange(2, 6), 10
    rows = [("a", 10 * rng.randrange(-3, 12) + rng.choice([-2, -1, 0, 1, 2]), k) for k in range(60)]
    events = spark.createDataFrame(rows, SCHEMA)
    assert {(r.key, r.record_id) for r in bursts.first_bursts(events, n, window, ["key"]).collect()} == brute_first(rows, n, window)
    found = [r.record_id for r in bursts.all_bursts(events, n, window).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_all(rows, n, window)
