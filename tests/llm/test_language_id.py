from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

from auditweave.llm import language_id
from tests.llm.helpers import ODD, frame

SYLLABLES = {"aa": ["kra", "tor", "bel", "nim"], "bb": ["öle", "vim", "que", "sht"], "cc": ["ção", "ini", "mau", "dez"]}


def text_of(lang: str, seed: int, n: int = 40) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang], 3)) for _ in range(n))


def test_held_out_accuracy(spark):
    rows = [(k, text_of(lang, k), lang) for k, lang in enumerate(sorted(SYLLABLES) * 60)]
    found = language_id.predict_languages(frame(spark, rows)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert held and all(r.lang_pred == rows[r.doc_id][2] and 0 <= r.score <= 1 for r in held)


def test_odd_rows(spark):
    rows = [(k + 100, text_of(lang, k), lang) for k, lang in enumerate(sorted(SYLLABLES) * 10)] + [(300, text_of("aa", 3), None)]
    extra = [(*row, None) for row in ODD] + [(400, "123 !?", "aa"), (401, "q", "bb")]
    found = {(r.doc_id, r.lang_pred) for r in language_id.predict_languages(frame(spark, rows + extra)).collect()}
    for k in (1, 2, 3, 5, 400):
        assert (k, "und") in found
    known = {*SYLLABLES, "und"}
    assert {lang for _, lang in found} <= known
    assert (300, "aa") in found


def test_nothing_to_learn_from(spark):
    assert language_id.predict_languages(frame(spark, [])).count() == 0
    assert {r.lang_pred for r in language_id.predict_languages(frame(spark, [(1, "abc", None)])).collect()} == {"und"}


def test_filter_returns_every_language_of_a_trigram(spark):
    rows = [(k, "shared shared " + text_of(lang, k), lang) for k, lang in enumerate(sorted(SYLLABLES) * 5)]
    model = language_id.train(frame(spark, rows))
    gram = np.concatenate(list(language_id.trigrams(b"sha")))[1:2]
    found = np.bitwise_and.reduce([model.masks[0][row] for row in language_id.slots(gram, int(np.log2(model.masks.shape[1])))])
    assert int(found[0]) == (1 << len(SYLLABLES)) - 1
    assert (model.false < 0.01).all()


def brute_shares(rows, text):
    """Share of the text's trigrams that are typical of each language, from plain sets and counts."""
    counts: dict[str, Counter] = {}
    for _, each, lang in rows:
        counts.setdefault(lang, Counter()).update(np.concatenate(list(language_id.trigrams(each.encode()))).tolist())
    rates = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
    top = {g: max(r.get(g, 0) for r in rates.values()) for r in rates.values() for g in r}
    grams = np.concatenate(list(language_id.trigrams(text.encode()))).tolist()
    return {lang: sum(g in r and r[g] >= language_id.TYPICAL * top[g] for g in grams) / len(grams) for lang, r in rates.items()}


def test_shares_match_brute_force(spark):
    rows = [(k, text_of(lang, k), lang) for k, lang in enumerate(sorted(SYLLABLES) * 10)]
    model = language_id.train(frame(spark, rows))
    for text in (text_of("aa", 900), text_of("bb", 901) + text_of("cc", 902), "kra zzz qqq öle"):
        want = brute_shares(rows, text)
        found = dict(zip(model.languages, model.shares(text.encode()), strict=True))
        assert all(abs(found[lang] - want[lang]) < 0.1 for lang in want)


def test_more_languages_than_a_word_has_bits(spark):
    rng = np.random.default_rng(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 4000)]
    alphabets = {f"l{k:03}": rng.choice(letters, 8, replace=False) for k in range(150)}
    rows = [(150 * j + k, "".join(rng.choice(each, 200)), lang) for j in range(6) for k, (lang, each) in enumerate(alphabets.items())]
    found = language_id.predict_languages(frame(spark, rows)).collect()
    right = {k: lang for k, _, lang in rows}
    held = [r.lang_pred == right[r.doc_id] for r in found if r.held_out]
    assert len(held) > 100 and np.mean(held) > 0.95


def test_pieces_of_long_texts_and_full_filters(spark, monkeypatch):
    text = text_of("bb", 7, 500)
    whole = np.concatenate(list(language_id.trigrams(text.encode())))
    monkeypatch.setattr(language_id, "PIECE", 100)
    assert np.array_equal(whole, np.concatenate(list(language_id.trigrams(text.encode()))))
    rows = [(k, text_of(lang, k), lang) for k, lang in enumerate(sorted(SYLLABLES) * 20)] + [(900, text_of("aa", 900, 200_000), None)]
    monkeypatch.setattr(language_id, "MAX_BYTES", 8 << language_id.SEGMENT_BITS)
    found = {r.doc_id: r.lang_pred for r in language_id.predict_languages(frame(spark, rows)).collect()}
    assert all(found[k] == lang for k, _, lang in rows[:60]) and found[900] == "aa"
