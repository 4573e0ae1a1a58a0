from __future__ import annotations

import hashlib
import random
from pathlib import Path

import duckdb

from auditweave.llm import line_dedup
from tests.llm.helpers import ODD, frame


def brute(rows):
    seen, out = set(), []
    for k, text in rows:
        lines = (text or "").split("\n")
        gone = set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if window in seen:
                gone |= {at, at + 1, at + 2}
            seen.add(window)
        kept = "\n".join(line for n, line in enumerate(lines) if n not in gone)
        out.append((k, len(lines), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(str, out))


def rows_of(seed: int, n: int):
    rng = random.Random(seed)
    return [(k, "\n".join(f"line {rng.randrange(6)}" for _ in range(rng.randrange(0, 14)))) for k in range(n)]


def run(spark, rows):
    return sorted(str(tuple(r)) for r in line_dedup.digests(line_dedup.dedup_lines(frame(spark, rows))).collect())


def test_matches_brute_force(spark):
    rows = rows_of(1, 60) + [(100, "a\nb\nc\na\nb\nc\na\nb\nc"), (101, "\n\n\n\n"), (102, "\n\n\n\n"), (103, "x\n" * 3000)]
    assert run(spark, rows) == brute(rows)


def test_matches_its_sql(spark, tmp_path: Path):
    rows = rows_of(2, 50)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(str(r) for r in con.execute(line_dedup.SQL).fetchall()) == run(spark, rows)


def test_odd_rows(spark):
    lines = "a\nb\nc\nd"
    docs = frame(spark, [*ODD, (20, lines), (20, lines), (None, lines), (21, lines), (22, None)])
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "__n_lines", "__n_removed"]
    found = [(r.doc_id, r.text, r["__n_removed"]) for r in out.collect()]
    assert found.count((20, lines, 0)) == 2  # a repeated row is one document
    assert (None, lines, 0) in found and (21, "", 4) in found and (22, None, 0) in found
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_shared_id_with_other_text(spark):
    found = {r.text for r in line_dedup.dedup_lines(frame(spark, [(1, "a\nb\nc\nx"), (1, "a\nb\nc\ny")])).collect()}
    assert found in ({"a\nb\nc\nx", "y"}, {"x", "a\nb\nc\ny"})
