"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how far
to trust each, and the posterior probability of good quality decides in place of all-must-pass.

Votes enter the estimate as counts of vote patterns, at most 3 ** len(RULES) rows however large the
corpus is, so the driver's share of the work does not grow with the input."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import staged, text_key
from auditweave.llm.features import count_texts


@dataclass(frozen=True)
class Rule:
    """Votes for a text where ``good`` holds, against it where ``bad`` holds, else abstains."""

    name: str
    bad: Column
    good: Column


def share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> list[Rule]:
    """The rules over the columns of count_texts()."""
    words = F.col("n_words")
    length, symbols = share("word_chars", "n_words"), share("n_symbols", "n_words")
    letters = F.greatest(F.col("n_upper") + F.col("n_lower") + F.col("n_wide"), F.lit(1))
    stops = share("n_stops", "n_words")
    marks = letters + F.col("n_symbols") + F.col("n_bangs") + F.col("n_other")
    return [
        Rule("enough_words", words < 10, words >= 40),
        Rule("word_length", (length < 2) | (length > 15), length.between(3, 11)),
        Rule("few_symbols", symbols > 0.1, symbols <= 0.02),
        Rule("letters", letters / marks < 0.93, letters / marks >= 0.96),
        Rule("no_tables", share("n_pipes", "n_words") > 0.05, F.col("n_pipes") == 0),
        Rule("bare_words", (words >= 5) & (share("n_symbols", "n_words") > 0.3), F.col("n_symbols") == 0),
        Rule("fresh_lines", share("n_dup_lines", "n_lines") > 0.3, F.col("n_dup_lines") == 0),
        Rule("fresh_words", share("n_repeat_words", "n_words") > 0.2, share("n_repeat_words", "n_words") <= 0.05),
        Rule("spread_words", (words >= 20) & (share("n_top", "n_words") > 0.25), share("n_top", "n_words") <= 0.15),
        Rule("few_bangs", (words >= 5) & (share("n_bangs", "n_words") > 0.3), share("n_bangs", "n_words") <= 0.05),
        Rule("mixed_case", (words >= 5) & (F.col("n_upper") / letters > 0.5), F.col("n_upper") / letters <= 0.2),
        Rule("sentences", (words >= 20) & (stops < 0.01), stops.between(0.02, 0.6)),
    ]


def estimate(votes: np.ndarray, weights: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Expectation-maximisation for two hidden classes and votes in {-1, 0, 1} independent within a class.

    votes: distinct patterns (p, r); weights: how many texts show each. Returns the log odds of the
    prior and log likelihood ratios (r, 3) of a vote -1, 0, 1, good over bad. Starts from the share of votes
    for a text among those cast, with about a fifth against it as the border, which also fixes which class
    is the good one. No patterns: every ratio is 0."""
    r = votes.shape[1]
    if not len(votes):
        return 0.0, np.zeros((r, 3))
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    net = votes.sum(axis=1) / np.maximum(np.abs(votes).sum(axis=1), 1)
    good = 1 / (1 + np.exp(-20 * (net - 0.6)))
    last = -np.inf
    for _ in range(rounds):
        mass = [weights * (1 - good), weights * good]
        prior = np.array([m.sum() + 1 for m in mass])
        rates = [(np.einsum("p,prv->rv", m, hot) + 1) / (m.sum() + 3) for m in mass]
        logs = [np.log(prior[k] / prior.sum()) + np.einsum("prv,rv->p", hot, np.log(rates[k])) for k in (0, 1)]
        total = np.logaddexp(*logs)
        good = np.exp(logs[1] - total)
        fit = float((weights * total).sum())
        if fit - last < 1e-9 * abs(fit):
            break
        last = fit
    ratios = np.log(rates[1]) - np.log(rates[0])
    odds = float(np.log(prior[1]) - np.log(prior[0]))
    if ratios[:, 2].sum() < ratios[:, 0].sum():  # the classes have changed places
        return -odds, -ratios
    return odds, ratios


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id, the base counts, base_failed, quality, kept) of each row, and with ``keyed`` its text_key.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows. quality: the
    posterior probability that the text is good. kept: not base_failed and quality >= 0.5. Null and empty
    texts have no words and fail the base; repeated rows are judged each; an empty table gives none."""
    counts = staged(count_texts(docs, id_col, text_col, keyed), "quality-counts")
    made = rules()
    names = [f"vote_{rule.name}" for rule in made]
    voted = counts.withColumns({f"vote_{rule.name}": F.when(rule.bad, -1).when(rule.good, 1).otherwise(0) for rule in made})
    patterns = voted.groupBy(*names).count().collect()  # at most 3 ** len(made) rows
    patterns.sort()
    odds, ratios = estimate(np.array([row[:-1] for row in patterns], int).reshape(-1, len(made)), np.array([row[-1] for row in patterns], float))
    total = F.lit(odds)
    for name, (bad, none, good) in zip(names, ratios.tolist(), strict=True):
        total = total + F.when(F.col(name) == -1, bad).when(F.col(name) == 1, good).otherwise(none)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (1 / (1 + F.exp(-total))).alias("quality"), *names, *["text_key"] * keyed,
    ).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that judge() keeps, all columns unchanged. A row is known by its id, which may be
    null or repeat, and its text, on which alone the verdict depends."""
    good = judge(docs, id_col, text_col, keyed=True).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(good, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (text_key(text_col) == F.col("__key")), "left_semi")
