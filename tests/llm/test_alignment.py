from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from auditweave.llm import alignment
from tests.llm.helpers import ODD, frame, prose

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
SIGN = {c: b for b, c in alignment.vocabulary(PATHS[0]).sign.items()}
HELD = alignment.Aligner(*PATHS)
STRANGE = ["", " ", "a  b ", "   ", "\n x", "\x00a", "<s> hi <|endoftext|> <0x41> x", "a▁b c", "a\xa0b c", "①ﬁ x", "日本語 テキスト🎉🎉 mix", "---- ======   ==", " " * 100 + "x", "x" * 3000, "é" * 50]


def grouped(text: str | None) -> list[tuple[list[int], list[int]]]:
    """The groups of a text, from the libraries' tokens one by one."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    bytes_a = [bytes(SIGN[c] for c in A.id_to_token(k)) for k in a]
    bytes_b = [bytes([int(B.id_to_piece(k)[3:-1], 16)]) if B.is_byte(k) else B.id_to_piece(k).replace("▁", " ").encode() for k in b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return []
    ends = [[sum(map(len, side[: k + 1])) for k in range(len(side))] for side in (bytes_a, bytes_b)]
    shared = sorted(set(ends[0]) & set(ends[1]))
    out = [([], []) for _ in shared]
    for side, ids in enumerate((a, b)):
        for k, end in zip(ids, ends[side], strict=True):
            out[bisect_left(shared, end)][side].append(k)
    return out


def brute(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    texts = [grouped(text) for _, text in rows]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in texts]
    docs = Counter(pair for each in links for pair in each)
    top: dict = defaultdict(int)
    for (a, _), n in docs.items():
        top[a] = max(top[a], n)
    out = []
    for (doc_id, _), groups, each in zip(rows, texts, links, strict=True):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sha = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        n_best, total = sum(n for p, n in each.items() if docs[p] == top[p[0]]), sum(n * docs[p] for p, n in each.items())
        out.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(each.values()), n_best, total, sha))
    return sorted(out, key=str)


def test_same_as_brute_force(spark):
    rows = [*ODD[:-1], *((100 + k, text) for k, text in enumerate(STRANGE)), *((200 + k, prose(k, 30 + k, 60) + " Les élèves\n\nça va?") for k in range(12))]
    found = alignment.align(frame(spark, rows), *PATHS)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("frequent", [0, 40])
def test_counts_do_not_depend_on_what_is_spread(spark, frequent):
    rows = [(k, prose(k, 40, 50)) for k in range(20)]
    assert sorted(map(tuple, alignment.align(frame(spark, rows), *PATHS, frequent=frequent).collect()), key=str) == brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FF)) | st.text(alphabet="ab'st re\n\t<|endoftext|>0 1é² 漢▁"))
def test_one_text(text):
    groups = grouped(text)
    n_a, n_b, n_groups, n_links, _, pairs, links = HELD.align([text.encode()])[0]
    assert (n_a, n_b, n_groups) == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups))
    each = Counter(x * 32000 + y for a, b in groups for x in a for y in b)
    assert dict(zip(pairs.tolist(), links.tolist(), strict=True)) == each and n_links == sum(each.values())


def test_segments_and_memory_change_nothing(monkeypatch):
    texts = [prose(k, 300, 5000) + "  \n" + "漢字🎉" * 30 + " end " + prose(k, 50) for k in range(4)]
    want = HELD.align([t.encode() for t in texts])
    monkeypatch.setattr(alignment, "SMALL_GROUP", 1)
    small = alignment.Aligner(*PATHS)
    for memory in (small.parts, small.windows):
        memory.limit = 2000
    monkeypatch.setattr(alignment, "segments", lambda text, cut=alignment.segments: cut(text, 100))
    for _ in range(2):
        found = [small.align([t.encode()])[0] for t in texts]
        assert [x[:5] for x in found] == [x[:5] for x in want]
        assert all((x[5] == y[5]).all() and (x[6] == y[6]).all() for x, y in zip(found, want, strict=True))


def test_very_long_text(spark):
    rows = [(1, prose(1, 600_000, 5000)), (2, "-" * 200_000), (3, "漢" * 100_000)]
    found = {r.doc_id: r for r in alignment.align(frame(spark, rows), *PATHS).collect()}
    assert [found[k].n_a for k, _ in rows] == [len(A.encode(" " + text, add_special_tokens=False).ids) for _, text in rows]
    assert [found[k].n_b for k, _ in rows] == [len(B.encode(text)) for _, text in rows]


def test_empty_table(spark):
    assert alignment.align(frame(spark, []), *PATHS).count() == 0
