"""Cross-tokenizer alignment: which tokens of two tokenisers cover the same bytes of a text, corpus-wide.

A text is tokenised in full by both. Byte offsets at which tokens of both end are its shared ends; those before
tokens that both mark with a space are anchors, which cut the text into windows of token ids. The ids of a window
determine its bytes, hence its alignment, which is found once for each pair of id tuples that a worker remembers.
Documents keep their distinct id pairs; the number of documents of a pair is counted by partial aggregation
and joined back."""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.byte_bpe import OVERHEAD, SPLIT, vocabulary
from auditweave.llm.common import arrow_schema, map_texts, staged

#: A space between two characters that are neither spaces nor the mark of a space: every token of either tokeniser
#: that meets it begins with it, so a text may be cut there before it is tokenised.
LONE_SPACE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")
#: Characters of a long text that are tokenised at a time.
SEGMENT = 1 << 18
#: The fields of a part's tokens.
TOKENS_A, TOKENS_B, WINDOWS = (itemgetter(k) for k in range(3))
#: Bytes (estimated) that a worker remembers, twice over, of the parts between lone spaces and of windows.
MEMORY, WINDOW_MEMORY = 48 << 20, 64 << 20
#: The id pairs whose counts every task gets, at most: 16 bytes each.
FREQUENT = 1 << 19
#: Between the ids of the two sides of a window; no id is so large.
UNLIKE = b"\xff\xff\xff\xff"
#: Links up to which a group's id pairs are listed one by one.
SMALL_GROUP = 1024
#: Distinct pairs that a task holds while it counts.
HELD = 1 << 20
CODEC = pa.Codec("zstd", compression_level=1)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text cut at lone spaces, which are left out, into parts of about ``size`` characters."""
    start = 0
    while len(text) - start > size:
        found = LONE_SPACE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:] if start else text


def halved(key: bytes) -> list[bytes]:
    """Both sides of a window whose ids hold the separator's bytes across two of them."""
    at = 4 * int(np.flatnonzero(np.frombuffer(key, "<u4") == 0xFFFFFFFF)[0])
    return [key[:at], key[at + 4 :]]


class Memory:
    """What ``make`` gives for keys, in two generations of ``limit`` bytes each (estimated by ``times`` the keys'
    lengths): what is not asked for again is dropped."""

    def __init__(self, make: Callable[[list], list], limit: int = MEMORY, times: int = 1) -> None:
        self.make, self.limit, self.times, self.size = make, limit, times, 0
        self.now: dict = {}
        self.old: dict = {}

    def of(self, keys: set) -> dict:
        """A dictionary that has all of ``keys`` until the next call."""
        if self.size > self.limit:
            self.old, self.now, self.size = self.now, {}, 0
        now, old = self.now, self.old
        missing = [key for key in keys if key not in now]
        fresh = [key for key in missing if key not in old]
        now.update((key, old[key]) for key in missing if key in old)
        now.update(zip(fresh, self.make(fresh) if fresh else [], strict=True))
        self.size += OVERHEAD * len(missing) + self.times * sum(map(len, missing))
        return now


class Aligner:
    """Both tokenisers, and the words and windows that were met lately."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import sentencepiece
        import tiktoken

        self.vocab = vocabulary(byte_path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = [self.pieces.id_to_piece(k) for k in range(self.pieces.get_piece_size())]
        # Where no piece goes on past a space, words can be encoded one by one.
        self.by_words = not any("▁" in name.lstrip("▁") for name in names)
        self.bytes_a = self.vocab.texts
        self.bytes_b = [bytes([int(name[3:-1], 16)]) if self.pieces.is_byte(k) else name.replace("▁", " ").encode() for k, name in enumerate(names)]
        self.size_a, self.size_b = (np.array(list(map(len, side))) for side in (self.bytes_a, self.bytes_b))
        self.space_a, self.space_b = (np.array([x[:1] == b" " for x in side]) for side in (self.bytes_a, self.bytes_b))
        # The file numbers its tokens in the order of their merges, which is what the other library's format asks for.
        self.whole = tiktoken.Encoding("bytes", pat_str=SPLIT.pattern, mergeable_ranks={x: k for k, x in enumerate(self.bytes_a) if k not in self.vocab.special.values()}, special_tokens={})
        self.parts, self.windows = Memory(self.tokenise, times=3), Memory(self.align_windows, WINDOW_MEMORY, times=3)

    def split(self, body: str) -> list[str]:
        """The text cut at lone spaces, where each part is tokenised as in the whole."""
        if not self.by_words:
            return [body]
        plain = not ("  " in body or "▁" in body or body.startswith(" ") or body.endswith(" "))
        return body.split(" ") if plain else LONE_SPACE.split(body)

    def tokenise(self, parts: list[str]) -> list[tuple[int, int, tuple[bytes, ...]]]:
        """(tokens of A, tokens of B, windows) of space+part for each; special strings are plain text. -1 tokens stand
        for a part whose bytes either side does not reproduce.

        A side's tokens are those of the text, B's those of the part, to which it adds the space. The windows end at
        the verified shared ends before tokens that both sides mark with a space."""
        coded_b = self.pieces.encode(parts, num_threads=1)
        coded_a = [self.whole.encode_ordinary(" " + part) for part in parts]
        texts_a, texts_b = self.bytes_a, self.bytes_b
        like = [b"".join([texts_a[k] for k in a]) == b"".join([texts_b[k] for k in b]) == b" " + part.encode() for a, b, part in zip(coded_a, coded_b, parts, strict=True)]
        sides = [[ids for ids, good in zip(side, like, strict=True) if good] for side in (coded_a, coded_b)]
        out: list = [(-1, -1, ())] * len(parts)
        if sides[0]:
            cut = iter(self.cut(*(np.array(list(chain.from_iterable(side)), "<u4") for side in sides), *(np.cumsum(list(map(len, side))) for side in sides)))
            for k in [k for k, good in enumerate(like) if good]:
                out[k] = len(coded_a[k]), len(coded_b[k]), next(cut)
        return out

    def align_windows(self, keys: list[bytes]) -> list[tuple[str, bytes, bytes]]:
        """Of windows, each given by its ids of both sides: the groups as text, the id pairs as often as they are
        linked, and of large groups (pair, links) each. A group links all its tokens of one side to all of the other."""
        halves = [key.split(UNLIKE) for key in keys]
        if any(len(half) != 2 for half in halves):
            halves = [halved(key) for key in keys]
        ids_a, ids_b = (np.frombuffer(b"".join([half[side] for half in halves]), "<u4") for side in (0, 1))
        last_a, last_b = self.shared(ids_a, ids_b)
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        wide = len(self.bytes_b)
        list_a, list_b = ids_a.tolist(), ids_b.tolist()
        links = n_a * n_b
        groups = [f"{list_a[i]}|{list_b[j]}" for i, j in zip(last_a.tolist(), last_b.tolist(), strict=True)]
        begin_a, begin_b = last_a + 1 - n_a, last_b + 1 - n_b
        for g in np.flatnonzero(links > 1).tolist():
            some_a, some_b = list_a[begin_a[g] : last_a[g] + 1], list_b[begin_b[g] : last_b[g] + 1]
            groups[g] = f"{','.join(map(str, some_a))}|{','.join(map(str, some_b))}"
        listed = np.where(links <= SMALL_GROUP, links, 0)
        nth = np.arange(int(listed.sum())) - np.repeat(np.cumsum(listed) - listed, listed)
        over = np.repeat(n_b, listed)
        pairs = (ids_a[np.repeat(begin_a, listed) + nth // over].astype(np.int64) * wide + ids_b[np.repeat(begin_b, listed) + nth % over]).tobytes()
        large: dict[int, bytes] = {}
        for g in np.flatnonzero(links > SMALL_GROUP).tolist():
            (a, often_a), (b, often_b) = (np.unique(ids[begin[g] : last[g] + 1].astype(np.int64), return_counts=True) for ids, begin, last in ((ids_a, begin_a, last_a), (ids_b, begin_b, last_b)))
            large[g] = np.stack([np.add.outer(a * wide, b).ravel(), np.outer(often_a, often_b).ravel()], axis=1).astype(np.int64).tobytes()
        stops = (np.searchsorted(last_a, np.cumsum([len(half[0]) // 4 for half in halves]) - 1) + 1).tolist()
        ends = (8 * np.concatenate([[0], np.cumsum(listed)])).tolist()
        out, begun = [], 0
        for stop in stops:
            more = b"".join([large[g] for g in range(begun, stop) if g in large]) if large else b""
            out.append((";".join(groups[begun:stop]), pairs[ends[begun] : ends[stop]], more))
            begun = stop
        return out

    def shared(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places, on both sides, of the tokens that end where one of the other side does."""
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        at = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero(ends_b[at] == ends_a)
        return last_a, at[last_a]

    def cut(self, ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> list[tuple[bytes, ...]]:
        """The windows of each part of a row of parts, which end after ``ends`` tokens on either side."""
        last_a, last_b = self.shared(ids_a, ids_b)
        marked = np.append(self.space_a[ids_a[last_a[:-1] + 1]] & self.space_b[ids_b[last_b[:-1] + 1]], True)
        stops_a, stops_b = (last[marked] + 1 for last in (last_a, last_b))
        coded_a, coded_b = ids_a.tobytes(), ids_b.tobytes()
        windows, a, c = [], 0, 0
        for b, d in zip((4 * stops_a).tolist(), (4 * stops_b).tolist(), strict=True):
            windows.append(coded_a[a:b] + UNLIKE + coded_b[c:d])
            a, c = b, d
        at = [0, *np.searchsorted(stops_a, ends_a, side="right").tolist()]
        return [tuple(windows[i:j]) for i, j in pairwise(at)]

    def align(self, texts: list[bytes]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, id pairs ascending, links of each) of each text."""
        found = [Alignment() for _ in texts]
        waiting: list[tuple[Alignment, str]] = []
        size = 0
        for out, text in zip(found, texts, strict=True):
            for body in segments(text.decode()) if text else ():
                waiting.append((out, body))
                size += len(body)
                if size > 4 * SEGMENT:
                    self.settle(waiting)
                    waiting, size = [], 0
        self.settle(waiting)
        return [out.row() for out in found]

    def settle(self, waiting: list[tuple[Alignment, str]]) -> None:
        # What is remembered holds no cycles; looking it through for some at every turn takes a tenth of the time.
        held = gc.isenabled()
        gc.disable()
        try:
            self.settle_all(waiting)
        finally:
            if held:
                gc.enable()

    def settle_all(self, waiting: list[tuple[Alignment, str]]) -> None:
        cut = [self.split(body) for _, body in waiting]
        met = set().union(*cut)
        parts = self.parts.of(met)
        known = self.windows.of(set(chain.from_iterable([parts[part][2] for part in met])))
        for (out, _), each in zip(waiting, cut, strict=True):
            found = [parts[part] for part in each]
            out.add(found, [known[key] for key in chain.from_iterable(map(WINDOWS, found))])


class Alignment:
    """A text's alignment as its segments come in."""

    def __init__(self) -> None:
        self.sums, self.digest, self.begun, self.whole = [0, 0, 0, 0], hashlib.sha256(), False, True
        self.pairs = self.links = np.zeros(0, np.int64)

    def add(self, parts: list[tuple[int, int, tuple[bytes, ...]]], values: list[tuple[str, bytes, bytes]]) -> None:
        """A segment: the tokens of its parts, and what align_windows() gave for their windows."""
        n_a, n_b = sum(map(TOKENS_A, parts)), sum(map(TOKENS_B, parts))
        if len(values) < len(parts) and any(part[0] < 0 for part in parts):
            self.whole = False
            return
        shown = ";".join([v[0] for v in values])
        self.digest.update(((";" if self.begun else "") + shown).encode())
        self.sums = [a + b for a, b in zip(self.sums, (n_a, n_b, shown.count("|"), 0), strict=True)]
        met = np.sort(np.frombuffer(b"".join([v[1] for v in values]), np.int64))
        first = np.flatnonzero(np.diff(met, prepend=-1))
        pairs, links = met[first], np.diff(first, append=len(met))
        large = np.frombuffer(b"".join([v[2] for v in values]), np.int64).reshape(-1, 2)
        if self.begun or len(large):
            met, links = np.concatenate([self.pairs, pairs, large[:, 0]]), np.concatenate([self.links, links, large[:, 1]])
            order = np.argsort(met)
            first = np.flatnonzero(np.diff(met[order], prepend=-1))
            pairs, links = met[order][first], np.add.reduceat(links[order], first)
        self.pairs, self.links, self.begun = pairs, links, True
        self.sums[3] = int(links.sum())

    def row(self) -> tuple:
        if not (self.begun and self.whole):
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        return *self.sums, self.digest.hexdigest(), self.pairs, self.links


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """The worker's aligner, which lives as long as its vocabularies."""
    return Aligner(byte_path, piece_path)


def packed(values: np.ndarray) -> bytes:
    return CODEC.compress(values.tobytes(), asbytes=True) if len(values) else b""


def unpacked(data: bytes | None, n: int) -> np.ndarray:
    return np.frombuffer(CODEC.decompress(data, 8 * n, asbytes=True), np.int64) if n else np.zeros(0, np.int64)


ALIGNED = "row long,doc_id long,n_a long,n_b long,n_groups long,n_links long,groups_sha256 string,n_pairs long,pairs binary,links binary"


def aligned_texts(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ALIGNED of each row: counts, digest of the groups, and its distinct id pairs (a * pieces + b, ascending, as
    differences) with the links of each, packed. One scan, no shuffle."""

    def make():
        held = aligner(byte_path, piece_path)

        def step(part: pa.RecordBatch) -> dict:
            rows = held.align(part.column(1).to_pylist())
            n_a, n_b, n_groups, n_links, sha, pairs, links = map(list, zip(*rows, strict=True))
            return {
                "row": part.column(2), "doc_id": part.column(0), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": sha,
                "n_pairs": list(map(len, pairs)), "pairs": [packed(np.diff(x, prepend=0)) for x in pairs], "links": list(map(packed, links)),
            }

        return step

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    return map_texts(docs, [F.col(id_col).cast("long").alias("doc_id"), text, F.monotonically_increasing_id().alias("row")], ALIGNED, make)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs): in how many rows each id pair is linked. A task adds up what it meets, HELD distinct pairs at a
    time, before anything is shuffled."""

    def gather(batches):
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []

        def settle() -> None:
            nonlocal pairs, counts
            both = np.concatenate([pairs, *fresh])
            weight = np.concatenate([counts, np.ones(len(both) - len(counts), np.int64)])
            pairs, place = np.unique(both, return_inverse=True)
            counts = np.bincount(place, weight, len(pairs)).astype(np.int64)
            fresh.clear()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "docs"])

        waiting = 0
        for batch in batches:
            for data, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fresh.append(np.cumsum(unpacked(data, n)))
                waiting += n
                if waiting > HELD:
                    settle()
                    waiting = 0
                    if len(pairs) > HELD:
                        yield told()
                        pairs, counts = pairs[:0], counts[:0]
        settle()
        yield told()

    found = aligned.select("pairs", "n_pairs").mapInArrow(gather, "pair long, docs long")
    return found.groupBy("pair").agg(F.sum("docs").alias("docs"))


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    A is the byte-level tokeniser over space+text, B the piece tokeniser over the text. A link is a pair of token
    occurrences in one group; a pair of ids counts in as many rows as hold it linked; n_best are the links whose
    pair counts most for its A id, ties included, and count_sum adds up the counts of all links. Null and empty
    texts, and texts that either side does not reproduce byte by byte, have zeros and an empty digest. Null ids and
    repeated rows are aligned and counted each; an empty table gives no rows; other columns are not read.

    The most frequent pairs, ``frequent`` at most, go to every task with their counts, as do the highest counts of
    A's ids (as many as A has); the links of the rest, none of which is hot, are shuffled by pair. A very long text
    is tokenised by segments; one group's distinct id pairs are held at once."""
    spark = docs.sparkSession
    aligned = staged(aligned_texts(docs, byte_path, piece_path, id_col, text_col), "align-texts")
    wide = len(aligner(byte_path, piece_path).size_b)
    counted = staged(pair_counts(aligned).withColumn("level", F.floor(4 * F.log2("docs")).cast("int")), "align-pairs")
    # A row for each id of A.
    tops = counted.groupBy(F.expr(f"pair div {wide}").alias("a")).agg(F.max("docs").alias("top")).toPandas()
    top = np.zeros(len(aligner(byte_path, piece_path).size_a), np.int64)
    top[tops["a"].to_numpy(np.int64)] = tops["top"].to_numpy(np.int64)
    least, room = 1 << 30, frequent
    for level, n in sorted(((r["level"], r["n"]) for r in counted.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True):  # 4 rows a doubling
        if n > room:
            break
        least, room = level, room - n
    common = counted.where(F.col("level") >= least).select("pair", "docs").toPandas().sort_values("pair")
    spread = spark.sparkContext.broadcast((common["pair"].to_numpy(np.int64), common["docs"].to_numpy(np.int64), top))
    told_as = "row long,n_best long,count_sum long,pair long,links long"

    def tell(batches):
        known, docs_of, best = spread.value
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            for row, n, pairs, links in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                pair, link = np.cumsum(unpacked(pairs, n)), unpacked(links, n)
                at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
                here = known[at] == pair if len(known) else np.zeros(n, bool)
                docs_here = docs_of[at[here]]
                n_best = link[here][docs_here == best[pair[here] // wide]].sum()
                rest = np.flatnonzero(~here)
                parts = (np.full(len(rest) + 1, row), np.r_[n_best, np.zeros(len(rest), np.int64)], np.r_[(link[here] * docs_here).sum(), np.zeros(len(rest), np.int64)], np.r_[-1, pair[rest]], np.r_[0, link[rest]])
                for column, part in zip(columns, parts, strict=True):
                    column.append(part)
                if sum(map(len, columns[0][-64:])) > HELD or len(columns[0]) >= 4096:
                    yield flat(columns)
                    columns = [[] for _ in range(5)]
            if columns[0]:
                yield flat(columns)

    def flat(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], schema=arrow_schema(told_as))

    told = staged(aligned.select("row", "n_pairs", "pairs", "links").mapInArrow(tell, told_as), "align-links")
    rest = told.where("pair >= 0").select("row", "pair", "links", F.expr(f"pair div {wide}").alias("a")).join(counted.select("pair", "docs"), "pair")
    highest = spark.createDataFrame(tops.astype("int64"), "a long, top long") if len(tops) else spark.createDataFrame([], "a long, top long")
    rest = rest.join(highest, "a")
    settled = rest.select("row", F.when(F.col("docs") == F.col("top"), F.col("links")).otherwise(0).alias("n_best"), (F.col("links") * F.col("docs")).alias("count_sum"))
    sums = told.where("pair < 0").select("row", "n_best", "count_sum").unionByName(settled).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
