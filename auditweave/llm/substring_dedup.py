"""Substring dedup: words covered by a word window that starts in an earlier document too are removed.

A count-min prefilter comes first. Every partition sketches its windows: each adds one to a cell in each of
ROWS rows of counters, kept as distinct cells with their counts, since a partition meets few of all cells.
The sketches merge by addition, a slice of cells at a time, and cells counted twice or more go into a filter
of bounded size, one a row. The least of a window's counters never falls short of its count, so a second pass
that takes the windows with every counter at two or more loses none that repeats. These are grouped exactly,
by 96 bits of hash; before that, each task settles the occurrences for which it holds an earlier one itself,
so that a frequent window costs a row a task. Beyond MAX_FILTER_BITS the filters fill up and more windows reach
the exact grouping; results stay the same."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditweave.llm.common import slices, text_bytes

WINDOW = 13
#: Rows of counters, and cells of a row for each window.
ROWS, SPARSE = 2, 4
#: A row's filter has half a bit for each window up to this many bits (128 MB), in SEGMENTS parts.
MAX_FILTER_BITS, SEGMENTS, PROBES = 1 << 30, 1024, 2
#: Cells of a slice of the merge, windows that a task sketches at a time, and windows that it settles at a time.
SLICE_BITS, SKETCHED, HELD = 23, 1 << 21, 1 << 20
MIX = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
U = np.uint64


class WordHashes(dict):
    """64-bit hashes of the words met so far; forgets them when it holds 250,000."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word)
        return made


def powers(odd: np.uint64, n: int) -> list[np.uint64]:
    return [U(pow(int(odd), k, 1 << 64)) for k in range(n)]


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * MIX[0]
    h = (h ^ (h >> U(33))) * MIX[1]
    return h ^ (h >> U(33))


def windows(texts: list[bytes], hashes: WordHashes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in one row, the first word of each text in it, the places where a window of
    ``width`` words fits, and the hashes of those windows."""
    cut = [text.split() for text in texts]
    lengths = np.array([len(words) for words in cut])
    row = np.fromiter(map(hashes.__getitem__, chain.from_iterable(cut)), np.uint64, int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    fit = np.maximum(lengths - width + 1, 0)
    places = np.repeat(starts - (np.cumsum(fit) - fit), fit) + np.arange(int(fit.sum()))
    n = len(row) - width + 1
    if n <= 0:
        return row, starts, places, np.zeros(0, np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k, factor in enumerate(powers(MIX[2], width)):
        rolled += row[k : k + n] * factor
    return row, starts, places, finish(rolled[places])


def second_hash(row: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Further 32 bits for the windows at ``places``."""
    other = finish(row ^ MIX[3])
    rolled = np.zeros(len(places), np.uint64)
    for k, factor in enumerate(powers(MIX[3], width)):
        rolled += other[places + k] * factor
    return (finish(rolled) >> U(32)).astype(np.int64) - (1 << 31)


def pack_cells(cells: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The slices that ascending ``cells`` lie in, and for each the bytes of its distinct cells with their counts,
    so that a cell costs one entry however often it occurs.

    Those are: bytes of low bits, how many cells, and how many of them occur again (12 bytes); the low bits of all
    cells; a bitmap that has, for each further bit of the others, a one for each cell at that value and then a
    zero (a cell's place there is its high bits plus its rank); and the ranks and further counts of cells that
    occur again."""
    at = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    distinct, further = cells[at], np.diff(at, append=len(cells)) - 1
    part = (distinct >> U(SLICE_BITS)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
    out = []
    for low, high in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
        inside = (distinct[low:high] & U((1 << SLICE_BITS) - 1)).astype(np.uint32)
        n, again = high - low, np.flatnonzero(further[low:high])
        size = 1 if n >> (SLICE_BITS - 11) else 2
        marks = np.zeros((1 << (SLICE_BITS - 8 * size)) + n, np.uint8)
        marks[(inside >> np.uint32(8 * size)).astype(np.int64) + np.arange(n)] = 1
        parts = (np.array([size, n, len(again)], "<u4"), inside.astype("<u2" if size == 2 else "u1"), np.packbits(marks), again.astype("<u4"), further[low:high][again].astype("<u4"))
        out.append(b"".join([x.tobytes() for x in parts]))
    return part[first], out


def unpack_cells(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of one slice, from its begin, and their counts."""
    size, n, n_again = np.frombuffer(data, "<u4", 3).tolist()
    n_marks = (1 << (SLICE_BITS - 8 * size)) + n
    lows = np.frombuffer(data, "<u2" if size == 2 else "u1", n, 12)
    marks = np.frombuffer(data, np.uint8, -(-n_marks // 8), 12 + n * size)
    again = np.frombuffer(data, "<u4", 2 * n_again, 12 + n * size + len(marks))
    highs = np.flatnonzero(np.unpackbits(marks)) - np.arange(n)
    counts = np.ones(n, np.int64)
    counts[again[:n_again]] += again[n_again:]
    return (highs.astype(np.uint64) << U(8 * size)) | lows.astype(np.uint64), counts


def add_counts(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of a slice's parts, one after the other, and the sums of their counts, which stop at 2 ** 32 - 1.

    A slice has one array of counters, 32 MB, however many parts and cells come."""
    held = np.zeros(1 << SLICE_BITS, np.uint32)
    most = np.iinfo(np.uint32).max
    for cells, counts in parts:
        at = cells.astype(np.int64)  # distinct within a part
        held[at] = np.minimum(held[at].astype(np.int64) + counts, most)
    found = np.flatnonzero(held)
    return found.astype(np.uint64), held[found].astype(np.int64)


class Sizes:
    """The widths that follow from the number of windows."""

    def __init__(self, n: int, max_filter_bits: int = MAX_FILTER_BITS) -> None:
        self.cell_bits = min(40, max(SLICE_BITS, math.ceil(math.log2(SPARSE * max(n, 1)))))
        self.filter_bits = min(max_filter_bits, max(SEGMENTS * 64, 1 << math.ceil(math.log2(max(n, 2) / 2))))
        self.segment_bits = self.filter_bits // SEGMENTS

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        """The cell of each window in a row of counters."""
        return (finish(hashes ^ (MIX[2] * U(row))) if row else hashes) >> U(64 - self.cell_bits)

    def bits(self, cells: np.ndarray) -> Iterator[np.ndarray]:
        """For each probe, the bit of each cell within its segment."""
        for k in range(PROBES):
            yield (finish(cells + MIX[k]) % U(self.segment_bits)).astype(np.int64)

    def segments(self, cells: np.ndarray) -> np.ndarray:
        return (cells >> U(self.cell_bits - 10)).astype(np.int64)

    def repeated(self, filters: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The windows whose counters may all be two or more; filters: the bytes of each row's filter."""
        left = np.arange(len(hashes))
        for row in range(ROWS):
            cells = self.cells(hashes[left], row)
            base, found = self.segments(cells) * self.segment_bits, np.ones(len(left), bool)
            for bit in self.bits(cells):
                at = base + bit
                found &= (filters[row][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            left = left[found]
        return left


def sketches(texts: DataFrame, sizes: Sizes, width: int) -> DataFrame:
    """(row, slice, cells): each partition's sketches; a slice's distinct cells and counts as of pack_cells()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = WordHashes(), [], 0
        for part in slices(batches):
            found = windows(part.column(1).to_pylist(), hashes, width)[3]
            held.append(found)
            n += len(found)
            if n > SKETCHED:
                yield from sketch(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from sketch(np.concatenate(held))

    def sketch(found: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row in range(ROWS):
            part, data = pack_cells(np.sort(sizes.cells(found, row)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), row, np.int32)), pa.array(part), pa.array(data, pa.binary())], names=["row", "slice", "cells"])

    return texts.mapInArrow(run, "row int, slice long, cells binary")


def filters(texts: DataFrame, sizes: Sizes, width: int) -> np.ndarray:
    """For each row of counters the filter of the cells that the merged sketches count twice or more. The driver
    gets ROWS * SEGMENTS rows, of ROWS * MAX_FILTER_BITS in all."""

    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        cells, counts = add_counts(unpack_cells(data.as_py()) for data in group.column("cells"))
        cells = cells[counts >= 2] + (U(key[1].as_py()) << U(SLICE_BITS))
        segment = sizes.segments(cells)
        out: list[tuple[int, int, bytes]] = []
        for s in np.unique(segment).tolist():
            marks = np.zeros(sizes.segment_bits, np.uint8)
            for bit in sizes.bits(cells[segment == s]):
                marks[bit] = 1
            out.append((key[0].as_py(), s, np.packbits(marks, bitorder="little").tobytes()))
        return table(out)

    def join(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group.column("twice").to_pylist()])
        return table([(key[0].as_py(), key[1].as_py(), both.tobytes())])

    def table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
        return pa.Table.from_pylist([dict(zip(kinds.names, x, strict=True)) for x in rows], schema=kinds)

    kinds = pa.schema([("row", pa.int32()), ("segment", pa.int64()), ("twice", pa.binary())])
    schema = "row int, segment long, twice binary"
    merged = sketches(texts, sizes, width).groupBy("row", "slice").applyInArrow(merge, schema).groupBy("row", "segment").applyInArrow(join, schema)
    out = np.zeros((ROWS, SEGMENTS, sizes.segment_bits // 8), np.uint8)
    for row in merged.collect():  # ROWS * SEGMENTS rows of fixed size
        out[row.row, row.segment] = np.frombuffer(row.twice, np.uint8)
    return out.reshape(ROWS, -1)


def settle(rows: list[np.ndarray]) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """For occurrences (hi, lo, doc_id, tag, start) of windows: those of each window's smallest document here, one
    row a window and text (hi, lo, doc_id, at: tag and first start, more: its further starts, if any); and those
    that a smaller document here settles, one row a text (more: the starts, lo: its tag, no at)."""
    hi, lo, doc_id, tag, start = rows
    order = np.lexsort((doc_id, lo, hi))
    hi, lo, doc_id, tag, start = (x[order] for x in (hi, lo, doc_id, tag, start))
    new = changes(hi, lo)
    first = doc_id[np.flatnonzero(new)][np.cumsum(new) - 1]
    kept, gone = np.flatnonzero(first == doc_id), np.flatnonzero(first != doc_id)
    gone = gone[np.lexsort((tag[gone], doc_id[gone]))]
    new = changes(hi[kept], lo[kept], tag[kept])
    at, more = kept[new], start[kept[~new]]
    n_more = np.diff(np.flatnonzero(new), append=len(kept)) - 1
    sent = batch_of(hi[at], lo[at], doc_id[at], pa.array((tag[at] << 32) | start[at]), more, n_more, mask=n_more == 0)
    sent = sent.take(pa.array(np.argsort(order[at])))  # in the order of the texts, as that is shuffled in fewer bytes
    new = changes(doc_id[gone], tag[gone])
    at = gone[new]
    # What is settled needs no group: its key is spread by document.
    spread = finish(doc_id[at].astype(np.uint64)).view(np.int64)
    return sent, batch_of(spread, tag[at], doc_id[at], pa.nulls(len(at), pa.int64()), start[gone], np.diff(np.flatnonzero(new), append=len(gone)), mask=np.zeros(len(at), bool))


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return new


def batch_of(hi: np.ndarray, lo: np.ndarray, doc_id: np.ndarray, at: pa.Array, starts: np.ndarray, lengths: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    more = pa.ListArray.from_arrays(pa.array(offsets), pa.array(starts.astype(np.int32)), mask=pa.array(mask))
    return pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo.astype(np.int32)), pa.array(doc_id), at, more], names=["hi", "lo", "doc_id", "at", "more"])


def repeated_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, max_filter_bits: int = MAX_FILTER_BITS, settled: int = HELD) -> DataFrame:
    """(doc_id, tag, starts): the word positions of each document at which windows start whose words also
    start in a document of smaller id. tag: 24 bits of text hash, for rows that share an id.

    A task sends a window's smallest document that it has met, every ``settled`` windows, and what that settles goes
    straight to its documents; so no window is grouped from more than a few rows a task."""
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    sizes = Sizes(n_bytes // 6, max_filter_bits)
    twice = spark.sparkContext.broadcast(filters(texts, sizes, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = WordHashes(), [], 0
        for part in slices(batches):
            column = part.column(1).to_pylist()
            row, starts, places, found = windows(column, hashes, width)
            kept = sizes.repeated(twice.value, found)
            places, hi = places[kept], found[kept].view(np.int64)
            doc = np.searchsorted(starts, places, side="right") - 1
            tags = np.array([tag_of(text) for text in column], np.int64)
            held.append((hi, second_hash(row, places, width), np.asarray(part.column(0))[doc], tags[doc], places - starts[doc]))
            n += len(kept)
            if n > settled:
                yield from settle([np.concatenate(x) for x in zip(*held, strict=True)])
                held, n = [], 0
        if n:
            yield from settle([np.concatenate(x) for x in zip(*held, strict=True)])

    sent = texts.mapInArrow(run, "hi long, lo int, doc_id long, at long, more array<int>")
    gone = F.col("at").isNull()
    first = F.min(F.when(~gone, F.col("doc_id"))).over(Window.partitionBy("hi", "lo"))
    later = sent.withColumn("first", first).where(gone | (F.col("first") < F.col("doc_id")))
    tag = F.when(gone, F.col("lo")).otherwise(F.shiftright("at", 32).cast("int"))
    start = F.when(~gone, F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    each = later.select("doc_id", tag.alias("tag"), start.alias("start"), "more").groupBy("doc_id", "tag").agg(F.collect_list("start").alias("starts"), F.flatten(F.collect_list("more")).alias("more"))
    return each.select("doc_id", "tag", F.concat("starts", "more").alias("starts"))


def tag_of(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 42) & 0xFFFFFF


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, max_filter_bits: int = MAX_FILTER_BITS, settled: int = HELD) -> DataFrame:
    """``docs`` with the text replaced by the words that stay, joined by one space, and the columns
    ``__n_words`` and ``__n_removed``.

    A word goes if a window of ``width`` words of its document covers it whose word sequence also starts in
    a document of smaller id; windows are those of the input. Texts of fewer words keep all; null texts
    have none and give an empty text; rows with a null id keep all their words and are nobody's earlier
    document; rows that share an id are not earlier than one another. An empty table gives an empty one.
    All other columns pass through."""
    found = repeated_starts(docs, id_col, text_col, width, max_filter_bits, settled).withColumnRenamed("doc_id", id_col).withColumnRenamed("tag", "__tag").withColumnRenamed("starts", "__starts")
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(0xFFFFFF)).cast("int")
    joined = docs.withColumn("__tag", tag).join(found, [id_col, "__tag"], "left").select(*docs.columns, "__starts")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, place):
            texts, words, removed = [], [], []
            for text, starts in zip(part.column(place).to_pylist(), part.column(part.num_columns - 1), strict=True):
                each = (text or "").encode().split()
                words.append(len(each))
                if starts.is_valid:
                    step = np.zeros(len(each) + 1, np.int64)
                    at = np.asarray(starts.values)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + width, -1)
                    each = [each[k] for k in np.flatnonzero(np.cumsum(step)[:-1] == 0)]
                removed.append(words[-1] - len(each))
                texts.append(b" ".join(each).decode())
            columns = [pa.array(texts) if k == place else part.column(k) for k in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), pa.array(removed, pa.int64())], names=names)

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in docs.schema], T.StructField("__n_words", T.LongType()), T.StructField("__n_removed", T.LongType())])
    names = schema.names
    return joined.mapInArrow(run, schema)


def digests(deduped: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of dedup_windows()."""
    return deduped.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
