from __future__ import annotations

import numpy as np
import pytest

from auditweave.llm import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double, block int"


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, 1, 2, 3.0, 4) for k, v in vectors], SCHEMA)


def brute(vectors, k=20, every=20):
    whole = [(i, np.floor(np.array(v, np.float32).astype(float) * 64)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in whole:
        if q % every == 0:
            found = sorted((-int(x @ y), i) for i, y in whole if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def vectors_of(seed: int, n: int, dims: int = 8, values=None):
    rng = np.random.default_rng(seed)
    return [(k, (rng.choice(values, dims) if values else rng.normal(size=dims)).astype(float).tolist()) for k in range(n)]


@pytest.mark.parametrize("block", [16, 100, 8192])
def test_matches_brute_force(spark, block):
    vectors = vectors_of(1, 300)
    found = top_k.top_k(frame(spark, vectors), block=block, asked=4)
    assert sorted(map(tuple, found.collect())) == brute(vectors)


def test_ties_go_to_the_smaller_id(spark):
    vectors = vectors_of(2, 200, 3, values=[0.0, 1.0, -1.0])
    assert sorted(map(tuple, top_k.top_k(frame(spark, vectors), block=64).collect())) == brute(vectors)


def test_odd_vectors(spark):
    vectors = [*vectors_of(3, 12), (20, None), (40, [1.0, None] + [0.0] * 6), (60, [float("nan")] * 8), (80, [float("inf")] * 8), (100, [-0.001] * 8), (None, [1.0] * 8)]
    assert sorted(map(tuple, top_k.top_k(frame(spark, vectors)).collect())) == brute(vectors)
    assert top_k.top_k(frame(spark, [])).count() == 0
    assert top_k.top_k(frame(spark, [(20, [1.0])])).count() == 0


def test_bounds_stop_early_and_stay_exact():
    rng = np.random.default_rng(5)
    # A few long vectors along the query stand out, so that the lists need not be read to the end.
    x = np.floor(rng.normal(size=(4000, 6)) * 4)
    x[:40] += 400
    q = np.abs(np.floor(rng.normal(size=(7, 6)) * 64)) + 50
    stopped = top_k.search_block(q, x, np.full(7, -1), 10)
    for i, (place, score) in enumerate(stopped):
        exact = x @ q[i]
        assert set(place) == set(np.flatnonzero(exact >= np.sort(exact)[-10]))
        assert (score == exact[place]).all()


def test_repeated_ids(spark):
    vectors = vectors_of(7, 50)
    least, other = sorted([[0.5] * 8, [-0.5, *[2.0] * 7]])
    twice = [*vectors, (60, least), (60, other), (60, least)]
    found = [tuple(r) for r in top_k.top_k(frame(spark, twice), k=60).collect() if r.query_id == 60]
    x = {i: [np.floor(np.array(v, np.float32).astype(float) * 64) for j, v in twice if j == i] for i in {j for j, _ in twice}}
    q = min(x[60], key=list)
    left = [(i, v) for i, each in x.items() for v in each]
    left.pop(next(n for n, (i, v) in enumerate(left) if i == 60 and (v == q).all()))
    want = sorted((-int(v @ q), i) for i, v in left)
    assert [(r[3], r[2]) for r in sorted(found, key=lambda r: r[1])] == [(-s, i) for s, i in want]


def test_every_number_of_strides_and_size_of_number_is_exact():
    rng = np.random.default_rng(8)
    for scale in (4, 1 << 20, 1 << 28):
        x, q = np.floor(rng.normal(size=(500, 5)) * scale), np.floor(rng.normal(size=(9, 5)) * scale)
        exact = np.array([[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q], dtype=object)
        for strides in (1, 3, 8, 600):
            for i, (place, score) in enumerate(top_k.search_block(q, x, np.full(9, -1), 10, strides)):
                bar = sorted(exact[i])[-10]
                assert set(place.tolist()) == {n for n, s in enumerate(exact[i]) if s >= bar}
                assert [int(s) for s in score] == [exact[i][n] for n in place]


def exact_best(q, x, ids, k):
    score = x @ q
    order = np.lexsort((ids, -score))[:k]
    return ids[order].tolist(), score[order].astype(int).tolist()


def test_a_team_carries_bounds_and_reads_less():
    rng = np.random.default_rng(9)
    x, q = np.floor(rng.normal(size=(4000, 32)) * 8), np.floor(rng.normal(size=(40, 32)) * 8)
    ids, q_ids = np.arange(1, 4001), -np.arange(1, 41)
    team = [(ids[k::4], top_k.Lists(x[k::4])) for k in range(4)]
    found, read = top_k.search_team(q_ids, q, team, 10)
    for i, (at, scores) in enumerate(found):
        assert (at.tolist(), scores.tolist()) == exact_best(q[i], x, ids, 10)
    alone = sum(int(lists.search(q, np.full(40, -1), 10)[1].sum()) for _, lists in team)
    assert read < 0.8 * alone <= 0.8 * 40 * 4000


def test_entries_read_where_few_stand_out():
    rng = np.random.default_rng(10)
    x = np.floor(rng.normal(size=(4000, 6)) * 4)
    x[:40] += 400
    q = np.abs(np.floor(rng.normal(size=(7, 6)) * 64)) + 50
    assert (top_k.Lists(x).search(q, np.full(7, -1), 10)[1] <= 250).all()


@pytest.mark.parametrize("block", [16, 40])
def test_teams_of_blocks_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(top_k, "LEAST", 1)
    vectors = [*vectors_of(11, 900), (20, [9.0, 1.0]), (40, [1.0] * 12)]
    vectors = [(k, v) for k, v in vectors if len(v) != 8 or k not in (20, 40)]
    padded = [(k, v + [0.0] * (12 - len(v))) for k, v in vectors]
    found = top_k.top_k(frame(spark, vectors), block=block, asked=7)
    assert sorted(map(tuple, found.collect())) == brute(padded)
