from __future__ import annotations

import duckdb

from auditweave.llm import substring_dedup, top_k
from auditweave.llm.oracles import SUBSTRING_DEDUP, TOP_K
from tests.llm.helpers import frame
from tests.llm.test_substring_dedup import passages
from tests.llm.test_top_k import frame as vectors_frame
from tests.llm.test_top_k import vectors_of


def test_substring_dedup(spark):
    rows = passages(7, 40)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = substring_dedup.digests(substring_dedup.dedup_windows(frame(spark, rows))).collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(SUBSTRING_DEDUP).fetchall())


def test_top_k(spark):
    vectors = [*vectors_of(11, 90), (100, None), (120, [1.0, None] + [0.5] * 6), (140, [float("nan")] * 8)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", vectors)
    assert sorted(map(tuple, top_k.top_k(vectors_frame(spark, vectors)).collect())) == sorted(con.execute(TOP_K).fetchall())
