from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from auditweave.llm import mixing, quality_rules
from auditweave.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.helpers import frame, prose
from tests.llm.test_simhash import brute_fingerprint, roots

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents():
    shared = "\n".join(prose(700 + k, 12) + "." for k in range(4))
    rows = [(k, "\n".join(prose(k * 9 + j, 14) + "." for j in range(8)), "en", f"s{k % 3}") for k in range(60)]
    rows += [(100 + k, f"{shared}\n" + "\n".join(prose(800 + 9 * k + j, 14) + "." for j in range(9)), "en", "s1") for k in range(5)]
    copy = ". ".join(prose(5000 + j, 12) for j in range(30)) + "."
    rows += [(200 + k, copy + " End" * (k > 1), "en", "s2") for k in range(4)]
    rows += [(300 + k, "junk " * 60, "en", "s0") for k in range(5)] + [(400, None, None, None), (401, "", "en", "s0")]
    return rows


def dedup_lines(rows):
    seen, out = set(), []
    for k, text, lang, source in sorted(rows):
        lines, gone = text.split("\n"), set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            gone |= {at, at + 1, at + 2} if window in seen else set()
            seen.add(window)
        out.append((k, "\n".join(x for n, x in enumerate(lines) if n not in gone), lang, source))
    return out


def test_run_matches_brute_force(spark, tmp_path):
    docs = frame(spark, documents()).select(*COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))

    good = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert good == {k for k, *_ in documents() if k < 300}
    rows = dedup_lines([r for r in documents() if r[0] in good])
    nodes = [(k, brute_fingerprint(text)) for k, text, *_ in rows]
    root = roots(nodes, lambda a, b: (a[1] ^ b[1]).bit_count() <= 4)
    rows = [r for r, n in zip(rows, nodes, strict=True) if root[n] == n]
    assert sum(200 <= r[0] < 300 for r in rows) == 1
    often = {r.doc_id: r.copies for r in mixing.mix(frame(spark, rows)).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for k, text, *_ in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        if often[k]:
            want[(k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] = often[k]
    assert found == want


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = frame(spark, documents()).select(*COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == COLUMNS, name


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, frame(spark, []).select(*COLUMNS), str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
