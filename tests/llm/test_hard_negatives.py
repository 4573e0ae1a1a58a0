from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditweave.llm import hard_negatives as hn
from auditweave.llm.common import staged

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, tag long, block string, ask int"


def table(spark, rows):
    return spark.createDataFrame([(*row, 0.5, 1, 2, "b", 3) for row in rows], SCHEMA)


def brute(rows, every=100, positives=5, negatives=10):
    """Row by row, for unique ids."""
    good = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int), (y + 1) % 10 if i % 7 == 0 else y) for i, x, y in rows if i is not None and x is not None and y is not None and all(v is not None and np.isfinite(v) for v in x)]

    def dot(a, b):
        n = min(len(a), len(b))
        return int(a[:n] @ b[:n])

    out = []
    for i, x, y in good:
        if i % every == 0:
            scored = sorted((-dot(x, v), j, z) for j, v, z in good if j != i)
            for p, j, _ in [s for s in scored if s[2] == y][:positives]:
                fits = [s for s in scored if s[2] != y and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
                out += [(i, j, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fits)]
    return sorted(out)


def clustered(n, dims=12, centres=8, spread=0.03, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    return [(k, (middle[k % centres] + spread * rng.normal(size=dims)).astype(np.float32).tolist(), int(rng.integers(3))) for k in range(n)]


@pytest.mark.parametrize(("n", "block"), [(700, 32), (700, 5000), (37, 8)])
def test_same_as_brute_force(spark, n, block):
    rng = np.random.default_rng(n)
    rows = [(k, rng.normal(size=6).astype(np.float32).tolist(), int(rng.integers(10))) for k in range(n)]
    found = hn.mine(table(spark, rows), every=20, block=block)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, 20)


def test_ties_nulls_and_odd_rows(spark):
    rows = [(k, [float(k % 3), 1.0, -0.5], k % 2) for k in range(60)]  # few distinct scores
    rows += [(100, None, 1), (101, [1.0, None, 0.0], 1), (102, [1.0, float("nan"), 0.0], 0), (103, [float("inf"), 1.0, 0.0], 0), (104, [1.0, 2.0, 0.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(200, [1.0], 1), (201, [0.5, 0.5, 0.5, 9.0], 0), (202, [0.0, 0.0, 0.0], 1), (-210, [1.0, 1.0, 1.0], 9)]
    assert sorted(map(tuple, hn.mine(table(spark, rows), every=10, block=8).collect())) == brute(rows, 10)


def test_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (0, [2.0, 0.0], 1), (5, [0.5, 0.0], 2), (6, [0.5, 0.1], 2)]
    # The label of id 0 becomes 2: the anchor leaves out one of its two equal rows and finds the other rows of the id.
    found = hn.mine(table(spark, rows), every=10, block=2).collect()
    assert found == []  # no other label
    rows += [(8, [0.45, 0.0], 3)]
    near = {(r.positive_id, r.positive_score) for r in hn.mine(table(spark, rows), every=10, block=2).collect()}
    # The negative's score is 115 * 256; 30 hundredths of the other row of id 0, at 512 * 256, are more.
    assert near == {(0, 65536), (5, 32768), (6, 32768)}


def test_empty_and_lonely(spark):
    assert hn.mine(table(spark, [])).count() == 0
    assert hn.mine(table(spark, [(100, [1.0], 1)])).count() == 0


def test_scores_beyond_62_bits_are_refused(spark):
    with pytest.raises(Exception, match="62 bits"):
        hn.mine(table(spark, [(0, [1e9, 1e9], 1), (1, [1e9, 1e9], 2), (2, [1e9, 1e9], 2)])).collect()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    q, x = rng.integers(-99, 99, (20, 7)).astype(float), rng.integers(-99, 99, (50, 7)).astype(float)
    least, greatest = hn.bounds(q, x.min(axis=0)[None], x.max(axis=0)[None])
    scores = hn.product(q, x)
    assert (scores >= least).all() and (scores <= greatest).all()
    assert (scores == (q @ x.T)).all()


def test_curve_visits_each_cell_once_and_moves_by_one():
    for axes, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), axis=-1).reshape(-1, axes)
        place = hn.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_bounds_spare_most_blocks_of_clustered_vectors(spark, monkeypatch):
    rows = clustered(4000)
    read = []
    kept = hn.read_chosen

    def counted(asks, blocks, chosen, *rest):
        read.append(chosen.select("ask", "block").distinct().count() / (asks.count() * blocks.count()))
        return kept(asks, blocks, chosen, *rest)

    monkeypatch.setattr(hn, "read_chosen", counted)
    monkeypatch.setattr(hn, "ASKED", 4)
    assert sorted(map(tuple, hn.mine(table(spark, rows), block=32).collect())) == brute(rows)
    assert len(read) == 4 and read[1] < 0.5  # of the positives' blocks


def test_zones_are_those_of_the_blocks(spark):
    rows = clustered(300)
    whole = hn.labelled_vectors(table(spark, rows))
    blocks = staged(hn.packed(hn.placed(whole, hn.spreads(whole)), 32, 4), "test-blocks")
    seen = []
    for r in blocks.collect():
        v = hn.Vectors(r.asDict())
        assert (np.frombuffer(r.low) == v.xs.min(axis=0)).all() and (np.frombuffer(r.high) == v.xs.max(axis=0)).all()
        seen += v.ids.tolist()
    assert sorted(seen) == sorted(r.vec_id for r in whole.select(F.col("vec_id")).collect())
