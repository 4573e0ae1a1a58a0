"""Whole-text statistics that the quality rules and the quality classifier read."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import map_texts, text_bytes, text_key

#: Counts per document, all long.
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_ended_lines",
    "n_upper", "n_lower", "n_digits", "n_bangs", "n_stops", "n_pipes", "n_other", "n_wide", "n_distinct", "n_top",
]
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
SPACES = np.array([9, 10, 11, 12, 13, 32])
STOPS = np.frombuffer(b".,;:?", np.uint8)
ENDS = (b".", b"!", b"?", b'"', b":", b";")


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words covered by windows of ``width`` words that the text holds twice or more."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + width - max(at, end)
            end = at + width
    return covered


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text in UTF-8."""
    chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    points = len(text) - int(chars[128:192].sum())
    spaces = int(chars[SPACES].sum())
    lines = [line for line in text.split(b"\n") if line.split()]
    seen = Counter(words)
    upper, lower, digits = int(chars[65:91].sum()), int(chars[97:123].sum()), int(chars[48:58].sum())
    symbols, stops, bangs = int(chars[SYMBOLS].sum()), int(chars[STOPS].sum()), int(chars[33])
    wide = int(chars[192:].sum())
    other = points - spaces - upper - lower - digits - symbols - stops - bangs - wide
    return (
        len(words), points - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words), points, len(lines),
        sum(line.rstrip().endswith(ENDS) for line in lines), upper, lower, digits, bangs, stops, int(chars[124]),
        other, wide, len(seen), max(seen.values(), default=0),
    )


def count_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id, COUNTS) of each row, and with ``keyed`` its text_key; one scan, no shuffle. Null texts count as
    empty, null ids stay."""

    def make():
        def step(part: pa.RecordBatch) -> dict:
            rows = [text_counts(text) for text in part.column(1).to_pylist()]
            key = {"text_key": part.column(2)} if keyed else {}
            return {"doc_id": part.column(0), **dict(zip(COUNTS, map(list, zip(*rows, strict=True)), strict=True)), **key}

        return step

    schema = "doc_id long," + ",".join(f"{name} long" for name in COUNTS) + (",text_key long" if keyed else "")
    key = [text_key(text_col).alias("text_key")] if keyed else []
    return map_texts(docs, [F.col(id_col).cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("text"), *key], schema, make)
