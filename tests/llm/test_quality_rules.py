from __future__ import annotations

import math
from collections import Counter

import numpy as np

from auditweave.llm import quality_rules
from auditweave.llm.features import COUNTS, count_texts, repeated_words
from tests.llm.helpers import ODD, frame, mixed_texts, plain_counts, prose, words


def brute_repeats(found):
    counts = Counter(tuple(found[k : k + 5]) for k in range(len(found) - 4))
    covered = {k + j for k in range(len(found) - 4) if counts[tuple(found[k : k + 5])] > 1 for j in range(5)}
    return len(covered)


def test_repeated_words_match_brute_force():
    for seed in range(40):
        found = words(prose(seed, 60, words=3))
        assert repeated_words(found) == brute_repeats(found)


def test_base_counts(spark):
    text = "# A|b, <c>\n\ndup line\ndup line\n \nÜber & $ 50%"
    row = count_texts(frame(spark, [(1, text)])).first()
    assert row.n_words == 11
    assert row.word_chars == sum(len(w.decode()) for w in words(text))
    assert row.n_symbols == sum(c in "#*$%&|<>" for c in text)
    assert row.n_dup_lines == 1


def plain_votes(c):
    """Votes of the twelve rules on one text: bad -1, good 1, neither 0."""
    n = max(c["n_words"], 1)
    letters = max(c["n_upper"] + c["n_lower"] + c["n_wide"], 1)
    pure = letters / (letters + c["n_symbols"] + c["n_bangs"] + c["n_other"])
    length, symbols, upper, stops = c["word_chars"] / n, c["n_symbols"] / n, c["n_upper"] / letters, c["n_stops"] / n
    repeated, top, bangs = c["n_repeat_words"] / n, c["n_top"] / n, c["n_bangs"] / n
    tests = [
        (c["n_words"] < 10, c["n_words"] >= 40), (not 2 <= length <= 15, 3 <= length <= 11), (symbols > 0.1, symbols <= 0.02),
        (pure < 0.93, pure >= 0.96), (c["n_pipes"] / n > 0.05, c["n_pipes"] == 0), (c["n_words"] >= 5 and symbols > 0.3, c["n_symbols"] == 0),
        (c["n_dup_lines"] / max(c["n_lines"], 1) > 0.3, c["n_dup_lines"] == 0), (repeated > 0.2, repeated <= 0.05),
        (c["n_words"] >= 20 and top > 0.25, top <= 0.15), (c["n_words"] >= 5 and bangs > 0.3, bangs <= 0.05),
        (c["n_words"] >= 5 and upper > 0.5, upper <= 0.2), (c["n_words"] >= 20 and stops < 0.01, 0.02 <= stops <= 0.6),
    ]
    return tuple(-1 if bad else 1 if good else 0 for bad, good in tests)


def plain_posteriors(votes):
    """Expectation-maximisation text by text, with the start, the added ones and the end of the operator."""
    good = []
    for vote in votes:
        cast = sum(map(abs, vote))
        good.append(1 / (1 + math.exp(-20 * (sum(vote) / max(cast, 1) - 0.6))))
    last = -math.inf
    for _ in range(200):
        shares = []
        for weight in ([1 - g for g in good], good):
            mass = sum(weight)
            rates = [{v: (sum(w for w, vote in zip(weight, votes, strict=True) if vote[r] == v) + 1) / (mass + 3) for v in (-1, 0, 1)} for r in range(12)]
            shares.append(((mass + 1) / (len(votes) + 2), rates))
        fit, after = 0.0, []
        for vote in votes:
            bad, fine = (prior * math.prod(rates[r][v] for r, v in enumerate(vote)) for prior, rates in shares)
            fit += math.log(bad + fine)
            after.append(fine / (bad + fine))
        good = after
        if fit - last < 1e-9 * abs(fit):
            break
        last = fit
    return good


def test_verdicts_match_brute_force(spark):
    rows = mixed_texts()
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.quality, 6), r.kept) for r in quality_rules.judge(frame(spark, rows)).collect())
    counts = [plain_counts(text) for _, text in rows]
    want = Counter()
    for (k, _), c, quality in zip(rows, counts, plain_posteriors([plain_votes(c) for c in counts]), strict=True):
        failed = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        base = [c[name] for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        want[(k, *base, failed, round(quality, 6), not failed and quality >= 0.5)] += 1
    assert found == want
    assert 20 < sum(row[-1] for row in want) < len(rows) - 20


def test_odd_rows(spark):
    rows = quality_rules.judge(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_words == by_id[2].n_words == by_id[3].n_words == 0
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 10)
    assert by_id[6].n_words == 3
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_junk_goes_and_prose_stays(spark):
    good = [(k, ". ".join(prose(100 + k * 9 + j, 9).capitalize() for j in range(9)) + ".") for k in range(60)]
    junk = [(1000 + k, " ".join(w + "***|" for w in prose(k, 80).split())) for k in range(15)]
    kept = {r.doc_id for r in quality_rules.judge(frame(spark, good + junk)).where("kept").collect()}
    assert kept == {k for k, _ in good}
    docs = frame(spark, good + junk)
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept


def test_rows_without_an_id_and_rows_that_share_one_are_kept_by_their_text(spark):
    good = [(k, ". ".join(prose(100 + k * 9 + j, 9).capitalize() for j in range(9)) + ".") for k in range(60)]
    junk = [(1000 + k, " ".join(w + "***|" for w in prose(k, 80).split())) for k in range(15)]
    odd = [(None, good[0][1]), (None, good[0][1]), (None, junk[0][1]), (None, None), (3, junk[1][1]), (1003, good[4][1])]
    out = quality_rules.keep_good(frame(spark, good + junk + odd)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter([*good, odd[0], odd[1], odd[5]])


def test_estimate_finds_the_accurate_rules():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, 0, np.where(rng.random(len(truth)) < p, 1, -1) * np.where(truth, 1, -1)) for p in (0.95, 0.9, 0.85, 0.55)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    odds, ratios = quality_rules.estimate(patterns, counts.astype(float))
    trust = ratios[:, 2] - ratios[:, 0]
    assert trust[0] > trust[1] > trust[2] > trust[3] > 0
    assert abs(1 / (1 + np.exp(-odds)) - 0.8) < 0.05
    assert len(COUNTS) == len(set(COUNTS))
