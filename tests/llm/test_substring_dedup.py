from __future__ import annotations

import hashlib
import random

import numpy as np

from auditweave.llm import substring_dedup
from tests.llm.helpers import ODD, frame, prose, words


def brute(rows, width=13):
    first = {}
    for k, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        found = words(text)
        for at in range(len(found) - width + 1):
            first.setdefault(tuple(found[at : at + width]), k)
    out = []
    for k, text in rows:
        found = words(text)
        gone = set()
        for at in range(len(found) - width + 1):
            if k is not None and first[tuple(found[at : at + width])] < k:
                gone |= set(range(at, at + width))
        kept = b" ".join(w for n, w in enumerate(found) if n not in gone)
        out.append((k, len(found), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def run(spark, rows, **options):
    return sorted(str(tuple(r)) for r in substring_dedup.digests(substring_dedup.dedup_windows(frame(spark, rows), **options)).collect())


def passages(seed: int, n: int):
    rng = random.Random(seed)
    shared = [prose(900 + k, rng.randrange(8, 60)) for k in range(6)]
    return [(k, " ".join([prose(k, rng.randrange(0, 80), 4000), rng.choice(shared), prose(k + 500, rng.randrange(0, 50), 4000), rng.choice(shared)])) for k in range(n)]


def test_matches_brute_force(spark):
    rows = passages(1, 60) + [(200, prose(3, 40)), (201, prose(3, 40)), (202, prose(3, 12)), (203, prose(3, 13))]
    assert run(spark, rows) == brute(rows)


def test_small_steps_and_a_full_filter_change_nothing(spark):
    rows = passages(2, 50)
    assert run(spark, rows, settled=1) == brute(rows)
    assert run(spark, rows, max_filter_bits=substring_dedup.SEGMENTS * 64) == brute(rows)


def test_odd_rows(spark):
    rows = [*ODD, (8, prose(7, 20_000)), (8, prose(7, 50)), (None, prose(7, 30)), (9, "same " * 40), (10, "same " * 40)]
    assert run(spark, rows) == brute(rows)
    docs = frame(spark, rows)
    assert substring_dedup.dedup_windows(docs).columns == [*docs.columns, "__n_words", "__n_removed"]
    assert substring_dedup.dedup_windows(frame(spark, [])).count() == 0


def test_the_filter_loses_no_repeated_window(spark):
    rows = passages(5, 40)
    docs = frame(spark, rows)
    sizes = substring_dedup.Sizes(4000)
    texts = docs.selectExpr("doc_id", "cast(text as binary) AS text")
    filters = substring_dedup.filters(texts, sizes, 13)
    hashes = substring_dedup.WordHashes()
    found = substring_dedup.windows([t.encode() for _, t in rows], hashes, 13)[3]
    values, counts = np.unique(found, return_counts=True)
    repeated = values[counts > 1]
    assert len(repeated) and len(sizes.repeated(filters, repeated)) == len(repeated)
    assert len(sizes.repeated(filters, values[counts == 1])) < 0.2 * (counts == 1).sum()


def test_settling_keeps_the_smallest_document_of_each_window():
    rows = [(5, 1, 11, 3, 0), (5, 1, 10, 3, 7), (5, 1, 10, 3, 9), (5, 2, 99, 4, 1), (5, 1, 12, 3, 2), (9, 3, 12, 3, 4), (9, 3, 11, 3, 5)]
    sent, gone = (part.to_pylist() for part in substring_dedup.settle([np.array(x) for x in zip(*rows, strict=True)]))
    assert [(r["hi"], r["lo"], r["doc_id"], r["at"], r["more"]) for r in sorted(sent, key=lambda r: (r["hi"], r["lo"]))] == [(5, 1, 10, (3 << 32) + 7, [9]), (5, 2, 99, (4 << 32) + 1, None), (9, 3, 11, (3 << 32) + 5, None)]
    assert [(r["doc_id"], r["lo"], r["at"], r["more"]) for r in gone] == [(11, 3, None, [0]), (12, 3, None, [2, 4])]


def test_a_frequent_window_costs_one_entry_a_sketch(spark):
    rows = [(k, "same " * 30_000 + prose(k, 50)) for k in range(8)]
    sizes = substring_dedup.Sizes(240_000)
    texts = frame(spark, rows).selectExpr("doc_id", "cast(text as binary) AS text").repartition(4)
    found = substring_dedup.sketches(texts, sizes, 13).toPandas()
    entries = sum(len(substring_dedup.unpack_cells(data)[0]) for data in found["cells"])
    assert entries < 8 * 70 * substring_dedup.ROWS  # 240,000 windows, some 8 * 60 of them distinct
    assert run(spark, rows) == brute(rows)


def test_cells_round_trip():
    rng = np.random.default_rng(6)
    for spread in (3, 1 << 20, 1 << 30):
        sent = [np.sort(np.repeat(rng.integers(0, spread, 300), rng.integers(1, 400, 300))).astype(np.uint64) for _ in range(3)]
        held: dict[int, list] = {}
        for cells in sent:
            for part, data in zip(*substring_dedup.pack_cells(cells), strict=True):
                held.setdefault(int(part), []).append(substring_dedup.unpack_cells(data))
        merged = {(part << substring_dedup.SLICE_BITS) + int(c): int(n) for part, parts in held.items() for c, n in zip(*substring_dedup.add_counts(parts), strict=True)}
        values, counts = np.unique(np.concatenate(sent), return_counts=True)
        assert merged == dict(zip(values.tolist(), counts.tolist(), strict=True))
