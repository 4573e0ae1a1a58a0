from __future__ import annotations

import random
from collections import Counter

import pytest

from auditweave.llm import mixing
from tests.llm.helpers import ODD, frame, prose, words


def brute_targets(sizes: dict, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / whole for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            open_.discard(s)
        left = float(sum(sizes.values())) - sum(out.values())
    return out


@pytest.mark.parametrize("seed", range(12))
def test_targets_match_brute_force(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k:02}": rng.choice([0, 1, 10, 1000, 10_000]) for k in range(rng.randrange(1, 9))}
    if seed % 2:
        sizes[None] = rng.randrange(500)
    found = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert found == pytest.approx(brute_targets(sizes))
    assert sum(found.values()) == pytest.approx(sum(sizes.values()))


def test_mixture_is_near_its_targets_and_stable(spark):
    rows = [(k, prose(k, 5 + k % 40), None, f"s{k % 5}" if k % 3 else "hot") for k in range(3000)]
    found = mixing.mix(frame(spark, rows)).collect()
    taken, target = Counter(), {}
    source = {k: s for k, _, _, s in rows}
    for r in found:
        assert r["size"] == len(words(rows[r.doc_id][1])) and r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) < 0.12 * target[s] for s in target)
    again = mixing.mix(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))


def test_rates_in_the_long_run(spark):
    rate = 1.3
    n = spark.range(20_000).select(mixing.copies(mixing.F.lit(rate), mixing.F.col("id"), 1).alias("c")).groupBy().sum("c").first()[0]
    assert abs(n / 20_000 - rate) < 0.02


def test_odd_rows(spark):
    docs = frame(spark, [(*row, None, "s" if k % 2 else None) for k, row in enumerate(ODD)])
    found = mixing.mix(docs).collect()
    assert len(found) == len(ODD) and all(r["size"] == 0 for r in found if r.doc_id in (1, 2, 3, 5))
    assert mixing.mix(frame(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix(frame(spark, [(1, None, None, "a"), (2, "", None, "b")])).collect()} == {0}


def test_emitted_rows(spark):
    rows = [(k, prose(k, 30), "en", "ab"[k % 2]) for k in range(200)]
    docs = frame(spark, rows)
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    often = Counter(r.doc_id for r in out.collect())
    assert often == {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    twins = mixing.emit(frame(spark, [(1, "a b", None, "s"), (1, "a b", None, "s"), (None, "c d", None, "s")])).collect()
    assert Counter(r.doc_id for r in twins) == {1: 2, None: 1}


def test_null_and_repeated_ids_are_emitted_each_once(spark):
    rows = [(-1, "a b c", None, "s"), (None, "a b c", None, "s"), (None, "a b c", None, None), (2, None, None, "s"), (2, "", None, "t")]
    docs = frame(spark, rows)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixing.emit(docs).collect()) == +want
    assert mixing.emit(frame(spark, [])).count() == 0
