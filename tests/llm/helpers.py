"""Fixtures that the tests of the text operators share."""

from __future__ import annotations

import random
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Extra columns whose names an operator might use itself.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, score double, rank int, starts string, fp long, copies int"


def frame(spark, rows):
    """Documents of (doc_id, text, lang, source), or fewer of these."""
    full = [(*row, *[None] * (4 - len(row)), None, "k", 7, 0.5, 1, "s", 3, 2) for row in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def words(text):
    return WORD.findall((text or "").encode())


#: Nulls, empty and blank texts, a repeated row, a null id, a long text.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "no id here"), (5, None), (6, "Ünïcode 漢字 text\x1c\x85here"), (7, prose(7, 20_000))]


def plain_counts(text):
    """The counts of the quality features, from the signs of the text one by one."""
    text = text or ""
    found, lines = words(text), [line for line in text.split("\n") if words(line)]
    windows = [tuple(found[k : k + 5]) for k in range(len(found) - 4)]
    often = Counter(windows)
    signs = Counter(text)

    def count(test):
        return sum(n for sign, n in signs.items() if test(sign))

    blank = count(lambda c: c in " \t\n\v\f\r")
    out = {
        "n_words": len(found), "word_chars": len(text) - blank, "n_chars": len(text), "n_lines": len(lines),
        "n_symbols": count(lambda c: c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({k + j for k, window in enumerate(windows) if often[window] > 1 for j in range(5)}),
        "n_ended_lines": sum(line.rstrip(" \t\v\f\r")[-1] in ".!?\":;" for line in lines),
        "n_upper": count(lambda c: "A" <= c <= "Z"), "n_lower": count(lambda c: "a" <= c <= "z"), "n_digits": count(lambda c: "0" <= c <= "9"),
        "n_bangs": count(lambda c: c == "!"), "n_stops": count(lambda c: c in ".,;:?"), "n_pipes": count(lambda c: c == "|"),
        "n_wide": count(lambda c: ord(c) > 127), "n_distinct": len(set(found)), "n_top": max(Counter(found).values(), default=0),
    }
    named = ("n_upper", "n_lower", "n_digits", "n_symbols", "n_stops", "n_bangs", "n_wide")
    return out | {"n_other": len(text) - blank - sum(out[name] for name in named)}


def mixed_texts():
    """Prose, prose with marks, shouting, tables, repeated lines and short texts, of many degrees."""
    out = []
    for k in range(160):
        body = [prose(k * 11 + j, 4 + k % 13, 40 + k).capitalize() + ".,:!"[j % (1 + k % 4)] for j in range(1 + k % 12)]
        if k % 2:
            body += [body[0]] * (k % 5) + ["| a | b |"] * (k % 7 == 0) + ["WOW!! NOW!!"] * (k % 9) + ["#*é% " * (k % 6)]
        out.append((k, "\n".join(body)))
    return [*out, *((1000 + k, text) for k, (_, text) in enumerate(ODD))]
