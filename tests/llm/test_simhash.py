from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from auditweave.llm import simhash
from tests.llm.helpers import ODD, frame, prose, words


def brute_fingerprint(text):
    found = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [b" ".join(found[k : k + 4]) for k in range(len(found) - 3)] if len(found) >= 4 else [b" ".join(found)] if found else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, near):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints_match_brute_force():
    for text in ["", None, " \n", "A", "a B c", "x y z w v", prose(1, 300), "É É A É " * 20]:
        assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 63, (2, 2000), dtype=np.uint64)

    def place(fp):
        even, one = np.uint64(simhash.EVEN), np.uint64(1)
        high = fp >> one
        return ((fp | high) & even) | (((fp & high) & even) << one)

    def counts(fp):
        return np.stack([np.bitwise_count((fp >> np.uint64(2 * k)) & np.uint64(3)) for k in range(32)]).astype(int)

    by_count = np.abs(counts(a) - counts(b)).sum(axis=0)
    bound = np.bitwise_count(place(a) ^ place(b)).astype(int)
    assert (bound == by_count).all()
    assert (bound <= np.bitwise_count(a ^ b)).all()


def test_every_close_pair_shares_a_grid_cell():
    rng = random.Random(6)
    masks = simhash.grids(simhash.BANDS, simhash.RADIUS)
    assert len(masks) == 15

    def place(fp):
        high = fp >> 1
        return ((fp | high) & simhash.EVEN) | ((fp & high & simhash.EVEN) << 1)

    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(5)):
            b ^= 1 << bit
        assert any(place(a) & m == place(b) & m for m in masks)


def near_copies(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    base = prose(seed, 250).split()
    out = []
    for _ in range(n):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"new{rng.randrange(99)}"
        out.append(" ".join(copy))
    return out


def check(spark, rows, **options):
    found = simhash.near_duplicates(frame(spark, rows), **options).collect()
    assert len(found) == len(rows)
    fps = {text: brute_fingerprint(text) for _, text in rows}
    nodes = [(k, fps[t]) for k, t in rows if k is not None]
    want = roots(sorted(set(nodes)), lambda a, b: (a[1] ^ b[1]).bit_count() <= 4)
    for r in found:
        if r.doc_id is not None:
            key = next(n for n in nodes if n[0] == r.doc_id and f"{n[1]:016x}" == r.fingerprint)
            assert r.component_id == want[key][0]
    return found


def test_components_match_brute_force(spark):
    rows = [(10 * k + j, t) for k in range(6) for j, t in enumerate(near_copies(k, 5))] + [(100 + k, prose(50 + k, 80)) for k in range(20)]
    found = check(spark, rows)
    assert len({r.component_id for r in found}) < len(rows)


def test_crowded_cells_are_cut_without_loss(spark):
    rows = [(k, t) for k, t in enumerate(near_copies(9, 40))] + [(100 + k, prose(k, 5)) for k in range(10)]
    assert sorted(map(str, check(spark, rows))) == sorted(map(str, check(spark, rows, hot=1)))


def test_odd_rows(spark):
    found = check(spark, [*ODD, (8, "one"), (9, "   ")])
    by_id = {r.doc_id: r for r in found}
    assert {by_id[k].component_id for k in (1, 2, 3, 5, 9)} == {1}
    assert by_id[1].fingerprint == "0" * 16
    assert by_id[8].component_id == 4
    assert by_id[None].component_id is None
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_rows_without_id_link_others(spark):
    base = "alpha beta gamma delta epsilon zeta"
    found = simhash.near_duplicates(frame(spark, [(None, base), (5, base), (None, base)])).collect()
    assert {r.component_id for r in found} == {5}


def test_keep_one(spark):
    docs = frame(spark, [*ODD, (8, "one"), (11, prose(1, 40)), (12, prose(1, 40))])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 6, 7, 11, None]))
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_texts_that_share_an_id_stay_apart(spark):
    one, two, big = prose(21, 60), prose(22, 60), (1 << 62) + 5
    rows = [(1, one), (1, two), (2, one), (3, two), (big, prose(23, 60)), (None, prose(24, 60)), (None, prose(24, 60))]
    check(spark, rows)
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(k), t) for k, t in [rows[0], rows[1], rows[4], rows[5]])


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(8)
    chain = [(k, k + 1) for k in range(60)]
    hub = [(1000, k) for k in range(1001, 1200)]
    other = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    edges = [*chain, *hub, *other]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    pairs = set(edges) | {(b, a) for a, b in edges}
    assert found == roots(sorted(nodes), lambda a, b: (a, b) in pairs)
