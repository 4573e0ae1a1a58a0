"""Byte-level BPE: pre-tokens, merges by a pair occurrence index, token counts, encoding and decoding.

The vocabulary is a public file whose path is a parameter; each Python worker loads it once. Texts are cut
into pre-tokens, each distinct pre-token is merged once while a worker remembers it, and the documents look
theirs up."""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import arrow_schema, map_texts, slices, staged, text_bytes

#: The published split pattern of this family of vocabularies, and the same pattern with the
#: classes written out for texts without characters above U+02C1, where re is twice as fast as regex.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ˁ", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0"
SPLIT_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BEYOND_LATIN = re.compile("[^\x00-ˁ]")

#: Bytes (estimated) of pre-tokens that a worker remembers twice over, and bytes of them merged at a time.
WORD_MEMORY, MERGED = 64 << 20, 256 << 10
#: What a remembered string takes besides its bytes.
OVERHEAD = 160
#: The pre-tokens whose piece counts every task gets: the most frequent ones of at most LONGEST bytes.
FREQUENT, LONGEST = 1 << 18, 64


def pre_tokens(text: str) -> list[str]:
    return (SPLIT if BEYOND_LATIN.search(text) else SPLIT_LATIN).findall(text)


class Vocabulary:
    """What a byte-level BPE file says: ids of single bytes, merges by pair of ids, bytes of each id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        ids, merges = read["model"]["vocab"], read["model"]["merges"]
        if read["normalizer"] or read["pre_tokenizer"]["type"] != "ByteLevel" or read["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a byte-level BPE vocabulary without normalizer and prefix space")
        # Printable Latin-1 bytes stand for themselves in the file; the others are numbered from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.sign = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        byte = {sign: b for b, sign in self.sign.items()}
        self.byte_ids = np.array([ids[self.sign[b]] for b in range(256)], np.int64)
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in merges]
        self.pairs = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(self.pairs)}
        self.special = {x["content"]: x["id"] for x in read["added_tokens"] if x["special"]}
        self.texts = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for word, k in ids.items():
            self.texts[k] = word.encode() if word in self.special else bytes(byte[c] for c in word)
        for word, k in self.special.items():
            self.texts[k] = word.encode()
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        first = np.full(int(self.byte_ids.max()) + 1, -1)
        first[self.byte_ids] = np.arange(256)
        self.first_rank = np.full((256, 256), -1, np.int64)
        for (a, b), r in self.rank.items():
            if a < len(first) and b < len(first) and first[a] >= 0 and first[b] >= 0:
                self.first_rank[first[a], first[b]] = r

    def pieces(self, text: str) -> list[str | int]:
        """Pre-tokens of the text, and ids where a special string stands."""
        if not self.split_special or not self.split_special.search(text):
            return pre_tokens(text)
        out: list[str | int] = []
        end = 0
        for found in self.split_special.finditer(text):
            out += [*pre_tokens(text[end : found.start()]), self.special[found[0]]]
            end = found.end()
        return out + pre_tokens(text[end:])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_words(words: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """Token ids of each word, merged all at once.

    The symbols of all words stand in one row, with a gap after each word. An index maps every mergeable
    pair, by rank, to all its positions; the active ranks are applied in ascending order, each to its
    positions from left to right, and the pairs that a merge makes go into the lists of their ranks."""
    if not words:
        return []
    flat = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths + 1) - lengths - 1
    n = int(lengths.sum()) + len(words)
    at = np.arange(len(flat)) + np.repeat(np.arange(len(words)), lengths)
    row = np.full(n, -1, np.int32)
    row[at] = vocab.byte_ids[flat]
    ranks = np.full(n, -1, np.int32)
    if len(flat) > 1:
        ranks[at[:-1]] = np.where(np.diff(at) == 1, vocab.first_rank[flat[:-1], flat[1:]], -1)
    del at
    paired = np.flatnonzero(ranks >= 0)
    paired = paired[np.argsort(ranks[paired], kind="stable")]
    kinds, first = np.unique(ranks[paired], return_index=True)
    ends = [*first[1:].tolist(), len(paired)][: len(kinds)]
    begun = {r: span for r, *span in zip(kinds.tolist(), first.tolist(), ends, strict=True)}
    index: dict[int, list[int]] = {}
    links = (row, np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32))
    # Lists are faster, arrays smaller.
    symbol, right, left = (x.tolist() if n <= 2 * MERGED else array("i", x.tobytes()) for x in links)
    active, rank, pairs = list(begun), vocab.rank.get, vocab.pairs
    heapq.heapify(active)
    while active:
        r = heapq.heappop(active)
        a, b, made = pairs[r]
        low, high = begun.pop(r, (0, 0))
        for i in sorted(paired[low:high].tolist() + index.pop(r, [])):
            j = right[i]
            if symbol[i] != a or symbol[j] != b:
                continue  # one of the two has merged with another neighbour
            k = right[j]
            symbol[i], symbol[j], right[i], left[k] = made, -2, k, i
            for pair, where in (((symbol[left[i]] if i else -1, made), left[i]), ((made, symbol[k]), i)):
                if (new := rank(pair)) is not None:
                    if new in index:
                        index[new].append(where)
                    else:
                        index[new] = [where]
                        if new not in begun:
                            heapq.heappush(active, new)
    out = []
    for i in starts.tolist():
        ids = []
        while symbol[i] >= 0:
            ids.append(symbol[i])
            i = right[i]
        out.append(ids)
    return out


def merge_parts(words: list[str], vocab: Vocabulary, keep: Callable) -> dict:
    """What ``keep`` makes of the ids of each word, merged some MERGED bytes at a time."""
    out, part, held = {}, [], 0
    for at, word in enumerate(words):
        part.append(word)
        held += len(word)
        if held > MERGED or at == len(words) - 1:
            out |= {w: keep(ids) for w, ids in zip(part, merge_words([w.encode() for w in part], vocab), strict=True)}
            part, held = [], 0
    return out


class Remembered:
    """Values of strings, in two generations of ``limit`` bytes each: what is not asked for again is dropped."""

    def __init__(self, limit: int) -> None:
        self.limit, self.held = limit, 0
        self.now: dict = {}
        self.old: dict = {}

    def lacking(self, keys: set) -> list:
        """Those of ``keys`` that are unknown; ``now`` has the others from here on."""
        if self.held > self.limit:
            self.old, self.now, self.held = self.now, {}, 0
        missing = keys - self.now.keys()
        again = missing & self.old.keys()
        self.add(again, [self.old[k] for k in again])
        return list(missing - again)

    def add(self, keys, values: list) -> None:
        self.now.update(zip(keys, values, strict=True))
        self.held += sum(map(len, keys)) + OVERHEAD * len(values)


def counted_words(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, freq, pieces): each distinct pre-token of the texts in UTF-8, how often it occurs, and the number
    of its tokens, which is found once for the whole corpus. Special strings are no pre-tokens."""

    def gather(batches):
        vocab = vocabulary(path)
        words: Counter = Counter()

        def told() -> pa.RecordBatch:
            kept = [(w.encode(), n) for w, n in words.items() if isinstance(w, str)]
            words.clear()
            return pa.RecordBatch.from_pydict({"word": [w for w, _ in kept], "freq": [n for _, n in kept]}, schema=arrow_schema("word binary,freq long"))

        for part in slices(batches, 0):
            for text in part.column(0).to_pylist():
                words.update(vocab.pieces(text.decode()))
            if OVERHEAD * len(words) > WORD_MEMORY:
                yield told()
        yield told()

    def count(batches):
        for batch in batches:
            words = [w.decode() for w in batch.column(0).to_pylist()]
            pieces = merge_parts(words, vocabulary(path), len)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pieces[w] for w in words], pa.int64())], names=["word", "freq", "pieces"])

    words = docs.select(text_bytes(docs, text_col).alias("text")).mapInArrow(gather, "word binary, freq long")
    return words.groupBy("word").agg(F.sum("freq").alias("freq")).mapInArrow(count, "word binary, freq long, pieces long")


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row.

    The pieces of a pre-token are counted once for the whole corpus and joined to the pre-token frequencies
    of each document; ids are never laid out. The join is cut in two: the most frequent pre-tokens,
    ``frequent`` at most and of LONGEST bytes at most, go to every task, which adds up their part at once;
    only the rest is shuffled by pre-token, where none is hot. Null texts count as empty, with 0 tokens; null
    ids and repeated rows are counted each; an empty table gives no rows."""
    counted = staged(counted_words(docs, path, text_col).withColumn("level", F.floor(8 * F.log2("freq")).cast("int")), "bpe-words")
    short = counted.where(F.octet_length("word") <= LONGEST)
    least, room = 1 << 30, frequent
    for level, n in sorted(((r["level"], r["n"]) for r in short.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True):  # 8 rows a doubling
        if n > room:
            break
        least, room = level, room - n
    common = short.where(F.col("level") >= least).select("word", "pieces")
    # At most ``frequent`` rows of LONGEST bytes.
    spread = docs.sparkSession.sparkContext.broadcast({bytes(row.word).decode(): row.pieces for row in common.collect()})

    def tell(batches):
        vocab, pieces = vocabulary(path), dict(spread.value)

        pieces |= dict.fromkeys(vocab.special.values(), 1)
        for part in slices(batches, 2):
            out: list[tuple] = []
            for row, doc_id, text in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                often = Counter(vocab.pieces(text.decode()))
                rest = [word for word in often if word not in pieces]
                out += [(row, None, None, often.pop(word), word.encode()) for word in rest]
                out.append((row, doc_id, len(text), sum([n * pieces[word] for word, n in often.items()]), None))
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=arrow_schema(schema))

    names, schema = ["row", "doc_id", "n_bytes", "n", "word"], "row long,doc_id long,n_bytes long,n long,word binary"
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("text"))
    told = staged(texts.mapInArrow(tell, schema), "bpe-frequencies")
    rest = told.where("word IS NOT NULL").select("row", "word", "n").join(counted.select("word", "pieces"), "word").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    n_tokens = F.col("n") + F.coalesce("more", F.lit(0))
    return told.where("word IS NULL").join(rest, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


class Codec:
    """Encodes and decodes texts, with the pre-tokens that it has met lately at hand."""

    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.words = Remembered(WORD_MEMORY)
        self.special = {k: np.uint32(k).tobytes() for k in self.vocab.special.values()}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        cut = [self.vocab.pieces(text.decode()) for text in texts]
        met: set = set().union(*cut)
        found = merge_parts(self.words.lacking(met - self.special.keys()), self.vocab, lambda ids: array("I", ids).tobytes())
        self.words.add(found.keys(), list(found.values()))
        known = self.words.now | self.special if met & self.special.keys() else self.words.now
        return [b"".join([known[w] for w in each]) for each in cut]

    def decode(self, encoded: list[bytes]) -> list[str]:
        texts = self.vocab.texts
        return [b"".join([texts[k] for k in np.frombuffer(ids, "<u4").tolist()]).decode(errors="replace") for ids in encoded]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The worker's codec, which lives as long as its vocabulary."""
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each row: the token ids as little-endian unsigned 32-bit integers. Null texts count
    as empty and give no ids; null ids and repeated rows are encoded each; an empty table gives no rows."""

    def make():
        held = codec(path)
        return lambda part: {"doc_id": part.column(0), "ids": held.encode(part.column(1).to_pylist())}

    return map_texts(docs, [F.col(id_col).cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("text")], "doc_id long,ids binary", make)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of each row of encode(): the text of its ids, special tokens included, malformed
    UTF-8 replaced. Null ids count as none; repeated rows are decoded each; an empty table gives no rows."""

    def make():
        held = codec(path)
        return lambda part: {"doc_id": part.column(0), "ids": part.column(1), "text": held.decode(part.column(1).to_pylist())}

    return map_texts(encoded, [F.col("doc_id"), F.coalesce("ids", F.lit(b"")).alias("ids")], "doc_id long,ids binary,text string", make)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one pass, so that a task has one Python worker and one vocabulary."""

    def make():
        held = codec(path)

        def step(part: pa.RecordBatch) -> dict:
            ids = held.encode(part.column(1).to_pylist())
            return {"doc_id": part.column(0), "ids": ids, "text": held.decode(ids)}

        return step

    return map_texts(docs, [F.col(id_col).cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("text")], "doc_id long,ids binary,text string", make)


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of decode() or round_trip()."""
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )
