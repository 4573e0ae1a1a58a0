"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn and fits a shallow tree to each, whose leaves add up to one
lookup table a feature; then the strongest pairs get two-dimensional tables the same way. A score is the
sum of table entries at a text's bins, passed through the logistic function."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import crc_mod, staged
from auditweave.llm.features import COUNTS, count_texts

#: At most so many labelled texts are fitted (those of smallest id hash); further ones change little.
TRAIN_ROWS = 20_000
BINS, COARSE = 32, 8


def shape(counts: np.ndarray) -> np.ndarray:
    """Model inputs (n, features) from COUNTS (n, len(COUNTS)): rates that do not depend on the length, and the length."""
    c = dict(zip(COUNTS, counts.T.astype(float), strict=True))
    words, lines, chars = (np.maximum(c[k], 1) for k in ("n_words", "n_lines", "word_chars"))
    letters = np.maximum(c["n_upper"] + c["n_lower"] + c["n_wide"], 1)
    return np.stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, c["n_words"] / lines, c["n_ended_lines"] / lines, c["n_upper"] / letters,
        c["n_wide"] / letters, c["n_digits"] / chars, c["n_bangs"] / words, c["n_stops"] / words,
        c["n_pipes"] / words, c["n_other"] / chars, c["n_distinct"] / words, c["n_top"] / words,
    ], axis=1)


@dataclass
class AdditiveModel:
    """edges: per feature, sorted cut points; a value's bin is the number of edges at or below it.
    tables: per feature, an addend per bin. pairs: (i, j, addends by coarse bin of i and j)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.base)
        for table, b in zip(self.tables, at, strict=True):
            total += table[b]
        for i, j, table in self.pairs:
            total += table[coarse(at[i], len(self.tables[i])), coarse(at[j], len(self.tables[j]))]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def coarse(bins: np.ndarray, n: int) -> np.ndarray:
    return bins * COARSE // max(n, COARSE)


def leaves(g: np.ndarray, h: np.ndarray, depth: int, calm: float) -> np.ndarray:
    """A tree of ``depth`` over ordered bins with gradients g and curvatures h: the step for each bin."""
    value = np.full(len(g), g.sum() / (h.sum() + calm))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + calm) + gr**2 / (hr + calm) - g.sum() ** 2 / (h.sum() + calm)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > 1e-9:
            value = np.concatenate([leaves(g[:cut], h[:cut], depth - 1, calm), leaves(g[cut:], h[cut:], depth - 1, calm)])
    return value


def quadrants(g: np.ndarray, h: np.ndarray, calm: float) -> tuple[float, np.ndarray]:
    """The best cut of a two-dimensional table into four: its gain and the step for each cell."""
    best, steps = 0.0, np.zeros_like(g)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            cells = [(slice(*a), slice(*b)) for a in ((0, i), (i, None)) for b in ((0, j), (j, None))]
            sums = [(g[c].sum(), h[c].sum()) for c in cells]
            gain = sum(a * a / (b + calm) for a, b in sums)
            if gain > best + 1e-9:
                best, steps = gain, np.zeros_like(g)
                for c, (a, b) in zip(cells, sums, strict=True):
                    steps[c] = a / (b + calm)
    return best, steps


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, pair_rounds: int = 10, n_pairs: int = 4, rate: float = 0.1, calm: float = 5.0) -> AdditiveModel:
    """Fit to inputs x (n, f) and labels y in {0, 1}. No rows, or one class only: a constant score."""
    p = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    model = AdditiveModel(float(np.log(p / (1 - p))), edges, [np.zeros(len(e) + 1) for e in edges], [])
    if len(y) == 0 or y.min() == y.max():
        return model
    at, logit = model.bins(x), np.full(len(y), model.base)

    def pull() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-logit))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            if len(table) > 1:
                g, h = (np.bincount(at[k], w, len(table)) for w in pull())
                step = rate * leaves(g, h, 2, calm)
                table += step
                logit += step[at[k]]
    grid = [coarse(b, len(t)) for b, t in zip(at, model.tables, strict=True)]
    size = COARSE * COARSE

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = grid[i] * COARSE + grid[j]
        g, h = (np.bincount(flat, w, size).reshape(COARSE, COARSE) for w in pull())
        return flat, g, h

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ij: -quadrants(*cells(*ij)[1:], calm)[0])[:n_pairs]
    model.pairs = [(i, j, np.zeros((COARSE, COARSE))) for i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            flat, g, h = cells(i, j)
            step = rate * quadrants(g, h, calm)[1]
            table += step
            logit += step.ravel()[flat]
    return model


def train(counts: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on the labelled rows of count_texts() whose id hash is smallest, ``max_rows`` at most.

    A share of the hashes that holds a little more than those is cut out first, so that what reaches the driver
    depends neither on the number of rows nor on that of partitions."""
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    rows = staged(counts.join(known, "doc_id").select(*COUNTS, "label", draw.alias("at")), "quality-labelled")
    few = rows.where(F.col("at") <= 1.2 * max_rows / max(1, rows.count()))
    sample = few.orderBy("at", "label", *COUNTS).limit(max_rows).toPandas()
    return fit(shape(sample[COUNTS].to_numpy()), sample["label"].to_numpy())


def score_texts(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Fitted on labels of rows whose crc32(doc_id) mod 3 is not 1; score is the probability of label 1,
    predicted is 1 from 0.5 on. Null texts score as empty ones; null ids are scored and never fitted;
    repeated rows score alike; without labels each score is 0.5; an empty table gives none. Other columns
    of ``docs`` and ``labels`` are not read."""
    counts = staged(count_texts(docs), "quality-features").withColumn("held_out", crc_mod("doc_id", 3) == 1)
    model = train(counts.where(~F.col("held_out")), labels, max_rows)

    def add_up(batches):
        for batch in batches:
            x = np.stack([np.asarray(batch.column(name)) for name in COUNTS], axis=1)
            score = model.score(shape(x))
            out = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "score", "predicted"])

    return counts.mapInArrow(add_up, "doc_id long, held_out boolean, score double, predicted int")
