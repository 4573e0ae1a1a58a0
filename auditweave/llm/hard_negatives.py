"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Vectors are ordered along a Hilbert curve through the components that spread most, and written as Parquet in blocks,
each with the least and greatest value of every component. By interval arithmetic a block's zone bounds the scores
that its rows can have with an anchor. An anchor has windows of scores: one without bounds for its positives, then one
a positive for the negatives. A window first reads the block of highest upper bound, which raises its lower end to the
k-th score found there; after that it reads only the blocks whose bounds meet what is left of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.common import staged

#: Which rows are anchors, how many positives and negatives they get, and the share of the positive's
#: score, in hundredths, that a negative's lies between.
EVERY, POSITIVES, NEGATIVES, LEAST, MOST = 100, 5, 10, 30, 90
#: Rows of a block, blocks that a task holds, anchors that are shipped together, zones that are looked at together.
BLOCK, GROUP, ASKED, PAGE = 1024, 16, 128, 512
#: The curve runs through so many components, each cut into 2 ** BITS parts.
AXES, BITS = 12, 5
BEYOND = 1 << 62


def labelled_vectors(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, label, x): floor(scale * component), as double, of rows with id, label and finite components; every
    seventh id has the next of ten labels."""
    x = F.transform(F.col(vector_col), lambda v: F.floor(v.cast("double") * scale).cast("double"))
    finite = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    label = F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows, shorter ones filled up with zeros."""
    ends = np.asarray(column.offsets)
    sizes, flat = np.diff(ends), np.asarray(column.values)[ends[0] : ends[-1]]
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n, axes), whole numbers below 2 ** bits: by turning the
    axes back bit by bit, and then undoing the Gray code, for all rows at once."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for k in range(axes):
            on = (x[k] >> bit) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(on, low, swap)
            x[k] ^= swap
    for k in range(1, axes):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(axes):
            place = place << 1 | (x[k] >> bit) & 1
    return place


def spreads(rows: DataFrame) -> list[tuple[int, float, float]]:
    """(component, mean, deviation) of the AXES components that spread most, from sums that tasks form."""

    def sums(batches):
        total = np.zeros((3, 0))
        for batch in batches:
            x = matrix(batch.column(0))
            more = np.stack([np.full(x.shape[1], float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)])
            wide = max(total.shape[1], more.shape[1])
            total = np.pad(total, ((0, 0), (0, wide - total.shape[1]))) + np.pad(more, ((0, 0), (0, wide - more.shape[1])))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1])), *map(pa.array, total)], names=["axis", "n", "sum", "square"])

    found = rows.select("x").mapInArrow(sums, "axis long, n double, sum double, square double").groupBy("axis").agg(*[F.sum(c).alias(c) for c in ("n", "sum", "square")])
    mean = F.col("sum") / F.col("n")
    out = found.where("n > 0").select("axis", mean.alias("mean"), F.sqrt(F.greatest(F.col("square") / F.col("n") - mean * mean, F.lit(0.0))).alias("spread"))
    return [(r.axis, r.mean, r.spread) for r in out.orderBy(F.desc("spread"), "axis").limit(AXES).collect()]


def placed(rows: DataFrame, axes: list[tuple[int, float, float]]) -> DataFrame:
    """``rows`` with their place on the curve; components are cut between two deviations below and above their mean."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"))
            x = np.pad(x, ((0, 0), (0, max([0, *(a + 1 for a, _, _ in axes)]) - x.shape[1]))) if axes and x.shape[1] <= max(a for a, _, _ in axes) else x
            cells = [np.clip(np.floor((x[:, a] - m) / (4 * s or 1.0) * (1 << BITS)) + (1 << BITS - 1), 0, (1 << BITS) - 1) for a, m, s in axes]
            place = hilbert(np.stack(cells, axis=1), BITS) if axes else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

    return rows.mapInArrow(run, "vec_id long, label long, x array<double>, place long")


PACKED = "block long,team long,n int,ids binary,labels binary,xs binary,low binary,high binary"


def packed(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """PACKED: placed() rows in the order of the curve, ``size`` a block, with the zone of each block. A team is up to
    GROUP blocks in a row."""

    def run(batches):
        held, n, k = [], 0, 0
        part = TaskContext.get().partitionId() << 32

        def told(rows: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
            x = matrix(rows.column("x").combine_chunks() if isinstance(rows, pa.Table) else rows.column("x"))
            ids, labels = (np.asarray(rows.column(name)).astype("<i8") for name in ("vec_id", "label"))
            order = np.lexsort((labels, ids))
            values = [part | k, part | k // GROUP, len(ids), ids[order].tobytes(), labels[order].tobytes(), x[order].astype("<f8").tobytes(), x.min(axis=0).tobytes(), x.max(axis=0).tobytes()]
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names=[c.split()[0] for c in PACKED.split(",")])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                table = pa.Table.from_batches(held)
                yield told(table.slice(0, size))
                held, n, k = table.slice(size).to_batches(), n - size, k + 1
        if n:
            yield told(pa.Table.from_batches(held))

    ordered = rows.repartitionByRange(parts, "place", "vec_id").sortWithinPartitions("place", "vec_id")
    return ordered.mapInArrow(run, PACKED)


class Vectors:
    """A PACKED row: ids, labels and vectors, with its zone."""

    def __init__(self, row: dict) -> None:
        self.ids, self.labels = (np.frombuffer(row[name], "<i8") for name in ("ids", "labels"))
        self.xs = np.frombuffer(row["xs"], "<f8").reshape(len(self.ids), -1)


def framed(x: np.ndarray, wide: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, wide - x.shape[1]))) if x.shape[1] < wide else x


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as 64-bit integers. Scores that they can't hold are refused."""
    wide = max(q.shape[1], x.shape[1])
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, wide)
    if most >= BEYOND:
        raise OverflowError("scores beyond 62 bits")
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (framed(q, wide).astype(kind) @ framed(x, wide).astype(kind).T).astype(np.int64)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product (anchors, zones) that interval arithmetic allows."""
    wide = max(q.shape[1], low.shape[1])
    q, low, high = framed(q, wide), framed(low, wide), framed(high, wide)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


class Asked(Vectors):
    """Anchors that are shipped together, and their windows: (place of the anchor, tag, lower end, upper end)."""

    def __init__(self, row: dict) -> None:
        super().__init__(row)
        self.of, self.tags, self.low, self.high = np.frombuffer(row["windows"], "<i8").reshape(4, -1)

    def meets(self, least: np.ndarray, greatest: np.ndarray, low: np.ndarray) -> np.ndarray:
        """(windows, zones): whether scores between the bounds can lie in the window above ``low``."""
        return (greatest[self.of] >= low[:, None]) & (least[self.of] <= self.high[:, None])

    def eligible(self, kinds: list[np.ndarray], same: bool) -> np.ndarray:
        """(windows, zones): whether the zone has rows of the anchor's label, or of another one."""
        labels = self.labels[self.of]
        return np.stack([np.isin(labels, k) if same else np.full(len(labels), len(k) > 1) | ~np.isin(labels, k) for k in kinds], axis=1)


def best(window: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each window: by score, then by id."""
    order = np.lexsort((ids, -score, window))
    starts = np.flatnonzero(np.diff(window[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
    return order[nth < k]


def read_block(asked: Asked, block: Vectors, chosen: np.ndarray, low: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, score, id) of the first k rows of the block in each of the ``chosen`` windows."""
    anchors, at = np.unique(asked.of[chosen], return_inverse=True)
    scores = product(asked.xs[anchors], block.xs)
    fits = (asked.labels[anchors][:, None] == block.labels) == same
    if same:
        wide = max(asked.xs.shape[1], block.xs.shape[1])
        first, last = (np.searchsorted(block.ids, asked.ids[anchors], side=side) for side in ("left", "right"))
        for a in np.flatnonzero(last > first).tolist():  # the anchor itself, once
            rows = slice(first[a], last[a])
            own = (framed(block.xs[rows], wide) == framed(asked.xs[anchors[a] : anchors[a] + 1], wide)).all(axis=1) & fits[a, rows]
            if own.any():
                fits[a, first[a] + int(np.argmax(own))] = False
    held = np.where(fits, scores, -BEYOND)[at]
    held = np.where((held >= low[chosen][:, None]) & (held <= asked.high[chosen][:, None]), held, -BEYOND)
    n = held.shape[1]
    bar = np.partition(held, n - k, axis=1)[:, n - k] if n > k else np.full(len(held), -BEYOND)
    window, place = np.nonzero((held >= bar[:, None]) & (held > -BEYOND))
    first = best(window, held[window, place], block.ids[place], k)
    return chosen[window[first]], held[window[first], place[first]], block.ids[place[first]]


ASKS = "ask long, n int, ids binary, labels binary, xs binary, windows binary"


def chosen_blocks(asks: DataFrame, pages: DataFrame, n_pages: int, same: bool, seeds: bool) -> DataFrame:
    """(ask, team, block): the blocks that the windows of each ask must read; with ``seeds`` only the one of highest
    upper bound for each anchor. Asks meet the zones page by page."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                asked = Asked(row)
                if not len(asked.of):
                    continue
                dims = max(len(z) // 8 for z in row["lows"])
                low, high = (np.stack([np.pad(np.frombuffer(z), (0, dims - len(z) // 8)) for z in row[name]]) for name in ("lows", "highs"))
                least, greatest = bounds(asked.xs, low, high)
                need = asked.meets(least, greatest, asked.low) & asked.eligible([np.frombuffer(x, "<i8") for x in row["kinds"]], same)
                out: dict[str, list] = {"ask": [], "team": [], "block": [], "anchor": [], "bound": []}
                if seeds:
                    height = np.where(need, greatest[asked.of], -BEYOND)
                    at = height.argmax(axis=1)
                    rows = np.flatnonzero(height.max(axis=1) > -BEYOND)
                    rows = rows[np.unique(asked.of[rows], return_index=True)[1]]
                    for w in rows.tolist():
                        out["anchor"].append(int(asked.ids[asked.of[w]]))
                        out["bound"].append(int(height[w, at[w]]))
                    zones = at[rows].tolist()
                else:
                    zones = np.flatnonzero(need.any(axis=0)).tolist()
                    out["anchor"], out["bound"] = [0] * len(zones), [0] * len(zones)
                out["ask"], out["team"], out["block"] = [row["ask"]] * len(zones), [row["teams"][z] for z in zones], [row["blocks"][z] for z in zones]
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(name, pa.int64()) for name in out]))

    met = asks.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1)))).join(pages, "page")
    found = met.select("ask", "n", "ids", "labels", "xs", "windows", "blocks", "teams", "lows", "highs", "kinds").mapInArrow(run, "ask long, team long, block long, anchor long, bound long")
    if seeds:
        found = found.groupBy("ask", "anchor").agg(F.max(F.struct("bound", "team", "block")).alias("top")).select("ask", "top.team", "top.block").distinct()
    return found.select("ask", "team", "block")


def read_chosen(asks: DataFrame, blocks: DataFrame, chosen: DataFrame, k: int, same: bool, parts: int) -> DataFrame:
    """(anchor_id, tag, vec_id, score): of each window the first k rows that each team's chosen blocks have.

    A team's blocks come to a task first, then the asks that read any of them, one after the other; while an ask goes
    from block to block, the k-th score so far raises the lower end of its windows."""
    wanted = chosen.groupBy("ask", "team").agg(F.array_sort(F.collect_set("block")).alias("chosen")).join(asks, "ask")
    empty = F.lit(None).cast("binary")
    sent = wanted.select("team", F.lit(1).alias("kind"), F.col("ask").alias("id"), "ids", "labels", "xs", "windows", empty.alias("low"), empty.alias("high"), "chosen")
    stored = blocks.select("team", F.lit(0).alias("kind"), F.col("block").alias("id"), "ids", "labels", "xs", empty.alias("windows"), "low", "high", F.lit(None).cast("array<long>").alias("chosen"))
    stored = stored.join(chosen.select(F.col("block").alias("id")).distinct(), "id", "left_semi").select(*sent.columns)

    def answer(asked: Asked, held: dict[int, tuple]) -> pa.RecordBatch:
        low, span = asked.low.copy(), np.array(asked.high)
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        edges = [bounds(asked.xs, zone[0][None], zone[1][None]) for _, zone in held.values()]
        for (block, _), (least, greatest) in sorted(zip(held.values(), edges, strict=True), key=lambda x: -int(x[1][1].max())):
            need = np.flatnonzero(asked.meets(least, greatest, low)[:, 0] & (low <= span))
            if not len(need):
                continue
            more = read_block(asked, block, need, low, k, same)
            window, score, ids = (np.concatenate(x) for x in zip(found, more, strict=True))
            first = best(window, score, ids, k)
            found = window[first], score[first], ids[first]
            full = np.bincount(found[0], minlength=len(low)) == k
            worst = np.full(len(low), BEYOND)
            np.minimum.at(worst, found[0], found[1])
            low[full] = np.maximum(low[full], worst[full])
        window, score, ids = found
        columns = [asked.ids[asked.of[window]], asked.tags[window], ids, score]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["anchor_id", "tag", "vec_id", "score"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        team, held = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["team"] != team:
                    team, held = row["team"], {}
                if row["kind"] == 0:
                    held[row["id"]] = Vectors(row), (np.frombuffer(row["low"]), np.frombuffer(row["high"]))
                else:
                    yield answer(Asked(row), {b: held[b] for b in row["chosen"]})

    dealt = stored.unionByName(sent).repartition(parts, "team").sortWithinPartitions("team", "kind", "id")
    return dealt.mapInArrow(run, "anchor_id long, tag long, vec_id long, score long")


def first_k(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def with_windows(asks: DataFrame, windows: DataFrame) -> DataFrame:
    """ASKS whose windows are those of ``windows`` (ask, anchor_id, tag, low, high); asks without any stay out."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                ids = np.frombuffer(row["ids"], "<i8")
                each = np.array([[w["anchor_id"], w["tag"], w["low"], w["high"]] for w in row["windows"]], np.int64).reshape(-1, 4)
                each = each[np.lexsort((each[:, 1], each[:, 0]))]
                each[:, 0] = np.searchsorted(ids, each[:, 0])
                row["windows"] = each.T.astype("<i8").tobytes()
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("ask", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("ids", "labels", "xs", "windows")]]))

    listed = windows.groupBy("ask").agg(F.collect_list(F.struct("anchor_id", "tag", "low", "high")).alias("windows"))  # ASKED anchors of a few windows
    return asks.select("ask", "n", "ids", "labels", "xs").join(listed, "ask").mapInArrow(run, ASKS)


def search(asks: DataFrame, windows: DataFrame, blocks: DataFrame, pages: DataFrame, n_pages: int, k: int, same: bool, parts: int) -> DataFrame:
    """(anchor_id, tag, rank, vec_id, score): the first k rows of each window, of the anchor's label or of others."""
    full = staged(with_windows(asks, windows), "negatives-asks")
    seeds = read_chosen(full, blocks, chosen_blocks(full, pages, n_pages, same, True), k, same, parts)
    raised = first_k(seeds, k).groupBy("anchor_id", "tag").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k)
    low = F.coalesce(F.greatest("low", "score"), F.col("low"))
    narrowed = windows.join(raised.select("anchor_id", "tag", "score"), ["anchor_id", "tag"], "left").select("ask", "anchor_id", "tag", low.alias("low"), "high")
    asked = staged(with_windows(asks, narrowed), "negatives-narrowed")
    return first_k(read_chosen(asked, blocks, staged(chosen_blocks(asked, pages, n_pages, same, False), "negatives-chosen"), k, same, parts), k)


def zone_pages(blocks: DataFrame, n_pages: int) -> DataFrame:
    """(page, blocks, teams, lows, highs, kinds): the zones of about PAGE blocks in a row."""

    def kinds(batches):
        for batch in batches:
            distinct = [np.unique(np.frombuffer(x, "<i8")).tobytes() for x in batch.column("labels").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("block", "team", "low", "high")], pa.array(distinct, pa.binary())], names=["block", "team", "low", "high", "kinds"])

    zones = blocks.select("block", "team", "labels", "low", "high").mapInArrow(kinds, "block long, team long, low binary, high binary, kinds binary")
    page = F.pmod(F.xxhash64("block"), F.lit(n_pages)).cast("int").alias("page")
    zone = F.sort_array(F.collect_list(F.struct("block", "team", "low", "high", "kinds")))

    def of(name: str) -> Column:
        return F.col("zones").getField(name)

    listed = zones.groupBy(page).agg(zone.alias("zones"))
    return listed.select("page", of("block").alias("blocks"), of("team").alias("teams"), of("low").alias("lows"), of("high").alias("highs"), of("kinds").alias("kinds"))


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id ``every`` divides; positives the ``positives`` other rows of the same label with the
    highest scores; negatives, for each, the first ``negatives`` rows of other labels whose score is LEAST to MOST
    hundredths of the positive's. Ties go to the smaller id. Rows with a null id, label or vector, or with null or
    non-finite components take no part. Rows that repeat an id are candidates each; as an anchor such an id counts
    once, with the least of its labels and vectors, and leaves out one row that equals it; a positive whose id
    comes twice gives its negatives twice. Shorter vectors count as filled up with zeros. Scores beyond 62 bits are
    refused. Other columns are not read; an empty table gives no rows."""
    whole = labelled_vectors(vectors, 256, id_col, label_col, vector_col)
    rows = staged(placed(whole, spreads(whole)), "negatives-rows")
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    teams = max(1, min(-(-n // block), max(4 * cores, -(-n // (block * GROUP)))))
    blocks = staged(packed(rows, block, teams), "negatives-blocks")
    n_pages = max(1, -(-blocks.count() // PAGE))
    pages = staged(zone_pages(blocks, n_pages), "negatives-zones")
    own = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "x", "place")).alias("least")).select("vec_id", "least.*")
    asks = staged(packed(own, ASKED, max(1, -(-n // (every * ASKED)))).withColumnRenamed("block", "ask"), "negatives-anchors")

    def each(batches):
        for batch in batches:
            for ask, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), ask)), pa.array(found)], names=["ask", "anchor_id"])

    anchors = asks.select("ask", "ids").mapInArrow(each, "ask long, anchor_id long")
    all_scores = anchors.select("ask", "anchor_id", F.lit(0).cast("long").alias("tag"), F.lit(-BEYOND + 1).cast("long").alias("low"), F.lit(BEYOND - 1).cast("long").alias("high"))
    near = staged(search(asks, all_scores, blocks, pages, n_pages, positives, True, teams), "negatives-positives")
    near = near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").cast("long").alias("tag"))
    spans = near.select("anchor_id", "tag", F.expr(f"-((-{LEAST} * positive_score - 99 * int(-{LEAST} * positive_score < 0)) div 100)").alias("low"), F.expr(f"({MOST} * positive_score - 99 * int({MOST} * positive_score < 0)) div 100").alias("high")).where("low <= high")
    far = search(asks, spans.join(anchors, "anchor_id").select("ask", "anchor_id", "tag", "low", "high"), blocks, pages, n_pages, negatives, False, teams)
    found = far.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").join(near, ["anchor_id", "tag"])
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
