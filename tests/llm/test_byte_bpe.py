from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from auditweave.llm import byte_bpe
from tests.llm.helpers import ODD, frame, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCAB = byte_bpe.vocabulary(PATH)
CODEC = byte_bpe.Codec(PATH)


def ids_of(text: str) -> list[int]:
    return np.frombuffer(CODEC.encode([text.encode()])[0], "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FF)) | st.text(alphabet="ab'st re\n\t<|endoftext|>0 1é² 漢"))
def test_same_ids_as_the_library(text):
    assert ids_of(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_what_is_remembered_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "WORD_MEMORY", 900)
    monkeypatch.setattr(byte_bpe, "MERGED", 50)
    codec = byte_bpe.Codec(PATH)
    for k in range(30):
        texts = [prose(k, 40, 90) for k in (k, k + 1)]
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode([t.encode() for t in texts])] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_very_long_texts(spark):
    texts = ["ab" * 100_000, prose(1, 300_000, 5000), "  \n" * 500_000, "\u6f22\u5b57" * 300_000]
    docs = frame(spark, list(enumerate(texts)))
    want = {k: len(LIBRARY.encode(text, add_special_tokens=False).ids) for k, text in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in byte_bpe.digests(byte_bpe.round_trip(docs, PATH)).collect()} == want
    assert {r.doc_id: r.n_tokens for r in byte_bpe.count_tokens(docs, PATH).collect()} == want


def test_counts_do_not_depend_on_what_is_spread(spark):
    docs = frame(spark, [*ODD, (8, "a<|endoftext|>b <|endoftext|>" + "x" * 90), (9, prose(9, 900)), (9, prose(9, 900))])
    want = sorted(map(str, byte_bpe.count_tokens(docs, PATH).collect()))
    for frequent in (0, 3, 300):
        assert sorted(map(str, byte_bpe.count_tokens(docs, PATH, frequent=frequent).collect())) == want


def test_words_merge_alike_alone_and_together():
    rng = random.Random(3)
    words = ["".join(rng.choices("aehinorst", k=rng.randrange(1, 14))) for _ in range(3000)] + ["a" * 999, "ab" * 500]
    together = byte_bpe.merge_words([w.encode() for w in words], VOCAB)
    assert together == [LIBRARY.encode(w, add_special_tokens=False).ids for w in words]
    assert byte_bpe.merge_words([], VOCAB) == []


def test_latin_split_is_the_general_split():
    every = "".join(chr(k) for k in range(0x2C2))
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices(every, k=40)) + "  " + every[rng.randrange(100) :]
        assert byte_bpe.SPLIT.findall(text) == byte_bpe.SPLIT_LATIN.findall(text)


def test_round_trip_of_odd_rows(spark):
    rows = [*ODD, (20, "a<|endoftext|>b  <|endoftext|>"), (21, " 　 x")]
    docs = frame(spark, rows)
    found = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, PATH), PATH)).collect()
    assert sorted(map(str, found)) == sorted(map(str, byte_bpe.digests(byte_bpe.round_trip(docs, PATH)).collect()))
    want = []
    for k, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        assert back == (text or "")
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    counted = byte_bpe.count_tokens(docs, PATH, limit=10).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in counted) == sorted((str(k), n) for k, n, _, _ in want)
    assert all(r.over_limit == (r.n_tokens > 10) for r in counted)
    sizes = {str(k): len((t or "").encode()) for k, t in rows}
    assert all(r.n_bytes == sizes[str(r.doc_id)] for r in counted)


def test_empty_tables(spark):
    assert byte_bpe.count_tokens(frame(spark, []), PATH).count() == 0
    assert byte_bpe.encode(frame(spark, []), PATH).count() == 0
    assert byte_bpe.round_trip(frame(spark, []), PATH).count() == 0


def test_malformed_ids_are_replaced(spark):
    encoded = spark.createDataFrame([(1, bytes(np.array([int(VOCAB.byte_ids[0xC3])], "<u4").tobytes()))], "doc_id long, ids binary")
    assert byte_bpe.decode(encoded, PATH).first().text == "�"
