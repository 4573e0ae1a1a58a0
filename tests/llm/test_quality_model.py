from __future__ import annotations

import math

import numpy as np

from auditweave.llm import quality_model
from auditweave.llm.common import crc_mod
from auditweave.llm.features import count_texts
from tests.llm.helpers import ODD, frame, mixed_texts, plain_counts, prose


def test_additive_model_learns_shapes_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((6000, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(int)  # a pure interaction
    model = quality_model.fit(x[:4000], y[:4000], rounds=40, pair_rounds=40)
    assert ((model.score(x[4000:]) >= 0.5) == y[4000:]).mean() > 0.93
    assert (0, 1) in {(i, j) for i, j, _ in model.pairs}
    z = (np.abs(x[:, 2] - 0.5) < 0.2).astype(int)
    shape = quality_model.fit(x[:4000], z[:4000], rounds=60, pair_rounds=1)
    assert ((shape.score(x[4000:]) >= 0.5) == z[4000:]).mean() > 0.95


def test_no_labels_and_one_class():
    x = np.random.default_rng(2).random((10, 3))
    assert np.allclose(quality_model.fit(x[:0], np.zeros(0, int)).score(x), 0.5)
    assert (quality_model.fit(x, np.ones(10, int)).score(x) > 0.5).all()


def test_held_out_accuracy_and_odd_rows(spark):
    good = [(k, prose(k, 90) + ".") for k in range(300)]
    bad = [(1000 + k, " ".join(f"w{k % 9}!!" for _ in range(90))) for k in range(300)]
    docs = frame(spark, good + bad + [(9000 + i if i is not None else None, t) for i, t in ODD])
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in good] + [(k, 0, 0) for k, _ in bad] + [(1, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_model.score_texts(docs, labels).collect()
    assert len(rows) == 600 + len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert len(held) > 100
    assert sum(r.predicted == int(r.doc_id < 1000) for r in held) / len(held) > 0.97
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_model.score_texts(frame(spark, []), labels).count() == 0
    assert {r.score for r in quality_model.score_texts(frame(spark, ODD), labels).collect()} == {0.5}


def test_sample_bound(spark):
    docs = frame(spark, [(k, prose(k, 30)) for k in range(50)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    assert quality_model.score_texts(docs, labels, max_rows=10).count() == 50


def plain_score(model, text):
    """The score of one text: its bin in each table by counting edges, and the sum of the entries there."""
    c = plain_counts(text)
    words, lines, chars = (max(c[name], 1) for name in ("n_words", "n_lines", "word_chars"))
    letters = max(c["n_upper"] + c["n_lower"] + c["n_wide"], 1)
    x = [
        math.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, c["n_words"] / lines, c["n_ended_lines"] / lines, c["n_upper"] / letters,
        c["n_wide"] / letters, c["n_digits"] / chars, c["n_bangs"] / words, c["n_stops"] / words,
        c["n_pipes"] / words, c["n_other"] / chars, c["n_distinct"] / words, c["n_top"] / words,
    ]
    bins = [sum(edge <= value for edge in edges) for value, edges in zip(x, model.edges, strict=True)]
    total = model.base + sum(table[b] for table, b in zip(model.tables, bins, strict=True))
    for i, j, table in model.pairs:
        total += table[bins[i] * 8 // max(len(model.tables[i]), 8)][bins[j] * 8 // max(len(model.tables[j]), 8)]
    return 1 / (1 + math.exp(-total))


def test_scores_match_naive_table_sums(spark):
    rows = mixed_texts()
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 9 < 4), 0) for k in range(160)], "doc_id long, quality int, toxic int")
    model = quality_model.train(count_texts(docs).where(crc_mod("doc_id", 3) != 1), labels)
    assert model.pairs and any(table.any() for *_, table in model.pairs)
    found = sorted((r.doc_id, r.score) for r in quality_model.score_texts(docs, labels).collect())
    want = sorted((k, plain_score(model, text)) for k, text in rows)
    assert [k for k, _ in found] == [k for k, _ in want]
    assert np.allclose([s for _, s in found], [s for _, s in want], atol=1e-9)
    assert len({round(s, 6) for _, s in want}) > 50
