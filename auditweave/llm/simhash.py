"""Near-duplicate texts by SimHash: fingerprints, a segment-popcount embedding, and components of links.

Fingerprints link when they differ in at most ``radius`` of 64 bits. Each fingerprint is embedded by the bit
counts of its 32 two-bit segments, written so that the Manhattan distance of two embeddings is the popcount
of their XOR; a flipped bit moves one count by one, so that distance never exceeds the Hamming distance. The
embedding's axes are cut into ``bands`` sub-grids. Two embeddings within ``radius`` agree on all but
``radius`` sub-grids at most, so they share a cell of the grid over at least one choice of
``bands - radius`` sub-grids. The join therefore meets every link in some cell, keeps pairs within the
Manhattan bound, and verifies those exactly."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import map_texts, staged, text_bytes, text_key

RADIUS, BANDS, WIDTH = 4, 6, 4
#: Cells of more members are cut further, by bits of the fingerprints themselves.
HOT = 4096
#: Every second bit.
EVEN = 0x5555555555555555
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """SimHash over XXH64 (seed 42) of the word shingles; no words: zero."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = np.array([xxhash.xxh64_intdigest(shingle, 42) for shingle in shingles], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, text_key, fp) of each row, fp as a signed long; null texts count as empty."""

    def make():
        def step(part: pa.RecordBatch) -> dict:
            found = np.array([fingerprint(text, width) for text in part.column(1).to_pylist()], np.uint64)
            return {"doc_id": part.column(0), "text_key": part.column(2), "fp": pa.array(found.view(np.int64))}

        return step

    columns = [F.col(id_col).cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("text"), text_key(text_col).alias("text_key")]
    return map_texts(docs, columns, "doc_id long,text_key long,fp long", make)


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def grids(bands: int, radius: int) -> list[int]:
    """Bit masks of the grids: every choice of bands - radius sub-grids of the 32 segments."""
    edge = [2 * (32 * k // bands) for k in range(bands + 1)]
    sub = [(1 << edge[k + 1]) - (1 << edge[k]) for k in range(bands)]
    return [sum(chosen) for chosen in combinations(sub, bands - radius)]


def embedded(fp: Column) -> Column:
    """Bit counts 0, 1, 2 of the two-bit segments, written 00, 01, 11."""
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(F.lit(EVEN)).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(F.lit(EVEN)), 1))


def cell_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside cells, for rows (grid, cell, node, fp) in order of (grid, cell): a spanning forest of
    the links of each cell, so a cell of m members gives m - 1 rows at most, however many pairs are near."""
    left: list[np.ndarray] = []
    for batch in batches:
        rows = [np.asarray(batch.column(k)).astype(np.int64) for k in range(4)]
        if left:
            rows = [np.concatenate([a, b]) for a, b in zip(left, rows, strict=True)]
        new = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
        last = int(new[-1]) if len(new) else 0
        left = [column[last:] for column in rows]  # the last cell may go on in the next batch
        yield linked([column[:last] for column in rows], new[:-1], radius)
    if left:
        yield linked(left, np.zeros(0, int), radius)


def linked(rows: list[np.ndarray], new: np.ndarray, radius: int) -> pa.RecordBatch:
    node, fp = rows[2], rows[3].view(np.uint64)
    even, one = np.uint64(EVEN), np.uint64(1)
    high = fp >> one
    place = ((fp | high) & even) | (((fp & high) & even) << one)
    starts, ends = np.concatenate([[0], new]).astype(int), np.concatenate([new, [len(node)]]).astype(int)
    many = np.flatnonzero(ends - starts > 1)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for k in many:
        waiting, queue = np.arange(starts[k], ends[k]), []
        while len(waiting):
            if not queue:
                queue, waiting = [waiting[0]], waiting[1:]
            at = queue.pop()
            bound = waiting[np.bitwise_count(place[waiting] ^ place[at]) <= radius]
            near = bound[np.bitwise_count(fp[bound] ^ fp[at]) <= radius]
            if len(near):
                a.append(np.full(len(near), node[at]))
                b.append(node[near])
                waiting = waiting[np.isin(waiting, near, assume_unique=True, invert=True)]
                queue += near.tolist()
    both = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in both], names=["a", "b"])


def links(nodes: DataFrame, radius: int = RADIUS, bands: int = BANDS, hot: int = HOT) -> DataFrame:
    """(a, b) links between distinct rows of ``nodes`` (node, fp) that connect all fingerprints within
    ``radius``, directly or through others. Cells of more than ``hot`` members are cut again by bits of the
    fingerprint: linked members agree on one of radius + 1 stretches of it."""
    place = embedded(F.col("fp"))
    each = F.array(*[F.struct(F.lit(k).alias("grid"), F.xxhash64(place.bitwiseAND(F.lit(signed(mask)))).alias("cell")) for k, mask in enumerate(grids(bands, radius))])
    placed = nodes.select("node", "fp", F.explode(each).alias("at")).select("at.grid", "at.cell", "node", "fp")
    crowded = staged(placed.groupBy("grid", "cell").count().where(F.col("count") > hot).select("grid", "cell"), "simhash-crowded")
    edge = [64 * k // (radius + 1) for k in range(radius + 2)]
    stretches = [signed((1 << edge[k + 1]) - (1 << edge[k])) for k in range(radius + 1)]
    finer = F.array(*[F.struct((F.col("grid") + 1000 * (k + 1)).alias("grid"), F.xxhash64("cell", F.col("fp").bitwiseAND(F.lit(mask))).alias("cell")) for k, mask in enumerate(stretches)])
    cut = placed.join(crowded, ["grid", "cell"], "left_semi").select("node", "fp", F.explode(finer).alias("at")).select("at.grid", "at.cell", "node", "fp")
    cells = placed.join(crowded, ["grid", "cell"], "left_anti").unionByName(cut)
    ordered = cells.repartition("grid", "cell").sortWithinPartitions("grid", "cell", "node")
    return ordered.mapInArrow(lambda batches: cell_links(batches, radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that links reach.

    Alternates large-star and small-star steps, which only ever hang nodes under smaller ones, until the
    edges stay the same. Hubs cost no gathered lists: each step is a minimum by node and a join."""

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("low"))

    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-edges")
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = smallest(both).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        below = smallest(large)  # every edge hangs a node under a smaller one
        hung = large.join(below, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = staged(hung.union(below.select("a", F.col("low").alias("b"))).distinct(), "component-edges")
        told = F.struct(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).alias("told")
        same = now.agg(told).first() == after.agg(told).first()
        now = after
        if same:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bands: int = BANDS, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) of each row of ``docs``: root, a fingerprint, names the component
    that links of at most ``radius`` bits make, and component_id is its smallest id, null where no row has one.

    Fingerprints are the nodes, so copies are never paired, and texts that only share an id stay apart."""
    marked = staged(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    roots = components(links(nodes.withColumn("node", F.col("fp")), radius, bands, hot))
    named = staged(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return marked.join(named.join(lowest, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bands: int = BANDS, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id) of each row of ``docs``.

    component_id is the smallest id that links of at most ``radius`` bits reach, the own id included.
    Texts without words (null, empty, blank) have fingerprint 0 and link like others. Rows with a null id
    get a fingerprint and the component of those they equal or link to, or null where none of them has an
    id. Rows that share an id link by their texts alone. Repeated rows appear each; an empty table gives
    none."""
    found = classes(docs, id_col, text_col, radius, bands, width, hot)
    return found.select("doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Of each group of near-duplicates one row, all columns unchanged: that of the smallest id, null ids
    last, and of the smallest text hash among rows that share it; of repeated rows one."""
    found = classes(docs, id_col, text_col, radius)
    # Ids with their absence as a column of its own: join keys, by which the rows then lie when repeats go.
    nameless, number = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0))
    keys = ["__none", "__id", "__key"]
    best = F.min(F.struct(nameless.alias("__none"), number.alias("__id"), F.col("text_key").alias("__key")))
    kept = found.groupBy("root").agg(best.alias("__best")).select("__best.*")
    keyed = docs.withColumns({"__none": F.col(id_col).isNull(), "__id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__key": text_key(text_col)})
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
