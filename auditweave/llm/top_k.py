"""Exact top-k inner-product search by no-random-access aggregation over sorted lists.

Candidates lie in blocks; each block has a sorted list a dimension. A query reads each list from the end that
its sign favours, a stride of entries after the other, and adds each entry to the score of the candidate that it
names; nothing is looked up by candidate. A score lies between its read part with the rest at its lists' worst
values and its read part with the rest at its lists' current values. A query stops when at most ``slack``
candidates have an upper bound at its k-th lower bound, as no outsider can qualify, and resolves the scores of
those that remain; one that never stops has read its lists to the end, where both bounds meet the score. A task
holds a team of blocks and carries a query's k-th score from block to block, so that later blocks stop earlier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, EVERY = 20, 20
#: Vectors in a candidate block (at least, at most) and in a query block: bounds on what one task holds.
LEAST, BLOCK, ASKED = 1024, 8192, 1024
#: Blocks in a team at most, and the memory that a team's blocks may take.
TEAM, TEAM_BYTES = 8, 256 << 20
#: In how many strides a list is read.
STRIDES = 16
#: No score yet.
NONE = np.iinfo(np.int64).min


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, x): floor(scale * component), as double, of vectors without null or non-finite components."""
    x = F.transform(F.col(vector_col), lambda v: F.floor(v.cast("double") * scale).cast("double"))
    finite = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def blocks(vectors: DataFrame, rows: int, n: int) -> DataFrame:
    """(block, ids, xs): the vectors dealt by id hash into ``n`` blocks of about ``rows``, as binaries.

    A vector of fewer components than others counts as filled up with zeros; ``dims`` tells how many a block has."""

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        ids = np.asarray(group.column("vec_id").combine_chunks())
        lists = group.column("x").to_pylist()
        dims = max(map(len, lists))
        xs = np.array([x + [0.0] * (dims - len(x)) for x in lists], "<f8")
        order = np.argsort(ids, kind="stable")
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "ids": [ids[order].astype("<i8").tobytes()], "xs": [xs[order].tobytes()], "dims": pa.array([dims], pa.int32())})

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    return dealt.groupBy("block").applyInArrow(pack, "block int, ids binary, xs binary, dims int")


class Lists:
    """A block of candidates and its sorted list a dimension: the values, and the places of their candidates."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.n = x, len(x)
        self.place = np.argsort(x.T, axis=1, kind="stable").astype(np.int32)
        self.value = np.take_along_axis(x.T, self.place, axis=1)

    def search(self, q: np.ndarray, skip: np.ndarray, k: int, floor: np.ndarray | None = None, strides: int = STRIDES) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each row of q the places and scores of its k best (all ties of the k-th included), and how many
        entries of each list it read.

        skip: per query, the place that is the query itself, or -1. floor: per query, a score below which nothing is
        wanted, so that fewer than k may come, or NONE. Scores that a long can't hold are refused."""
        n, dims = self.n, self.x.shape[1]
        q = np.pad(q[:, :dims], ((0, 0), (0, max(0, dims - q.shape[1]))))  # components that candidates lack add nothing
        out: list = [(np.zeros(0, int), np.zeros(0))] * len(q)
        depth = np.full(len(q), n)
        if not n:
            return out, depth
        most = float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * max(1, dims)
        if most >= 1 << 62:
            raise OverflowError("scores beyond 64 bits")
        # Sums of whole numbers stay exact below 2 ** 24, 2 ** 53 and 2 ** 63; bounds reach twice the largest score.
        kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64
        least = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        q, x, value = q.astype(kind), self.x.astype(kind), self.value.astype(kind)
        bar = np.full(len(q), least, kind) if floor is None else np.where(floor == NONE, least, floor).astype(kind)
        # Positive components read a list from its top, negative ones from its bottom.
        sides = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
        worst = np.concatenate([value[:, 0], value[:, -1]])
        low = np.repeat((sides @ worst)[:, None], n, axis=1)
        stride, unread = np.zeros((n, 2 * dims), kind), np.ones((n, 2 * dims), kind)
        top = np.arange(dims)[:, None]
        going, slack, read = np.arange(len(q)), min(n, max(2 * k, n // 16)), 0
        for until in np.unique(np.linspace(0, n, strides + 1).astype(int))[1:].tolist():
            # The next entries of each list go to the candidates that they name; one product adds them for all queries.
            for side, part in ((top, slice(n - until, n - read)), (top + dims, slice(read, until))):
                stride[self.place[:, part], side] = value[:, part] - worst[side]
                unread[self.place[:, part], side] = 0
            low += sides[going] @ stride.T
            for side, part in ((top, slice(n - until, n - read)), (top + dims, slice(read, until))):
                stride[self.place[:, part], side] = 0
            read = until
            if until == n:
                break
            own = np.flatnonzero(skip[going] >= 0)
            low[own, skip[going][own]] = least
            current = np.concatenate([value[:, n - until], value[:, until - 1]])
            # A candidate that no list has named yet may reach ``best``; while that is open there is nothing to stop.
            best = sides[going] @ current
            near = np.flatnonzero(best < np.maximum(bar[going], low.max(axis=1)))
            if not len(near):
                continue
            mine = going[near]
            under = low[near]
            if n > k:
                bar[mine] = np.maximum(bar[mine], np.partition(under, n - k, axis=1)[:, n - k])
            under += (sides[mine] * (current - worst)) @ unread.T
            under[skip[mine] >= 0, skip[mine][skip[mine] >= 0]] = least
            open_ = under >= bar[mine][:, None]
            done = np.count_nonzero(open_, axis=1) <= slack
            for at in np.flatnonzero(done).tolist():
                place = np.flatnonzero(open_[at])
                out[mine[at]] = place, x[place] @ q[mine[at]]
            depth[mine[done]] = until
            if done.any():
                left = np.delete(np.arange(len(going)), near[done])
                going, low = going[left], low[left]
            if not len(going):
                break
        for at, i in enumerate(going.tolist()):
            score = low[at]  # the lists are read to the end
            place = np.flatnonzero(score >= bar[i])
            out[i] = place, score[place]
        for i, (place, score) in enumerate(out):
            others = place != skip[i]
            place, score = place[others], score[others]
            if len(place) > k:
                best_ = score >= np.partition(score, len(score) - k)[len(score) - k]
                place, score = place[best_], score[best_]
            out[i] = place, score
        return out, depth


def search_block(q: np.ndarray, x: np.ndarray, skip: np.ndarray, k: int, strides: int = STRIDES) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of q the places in x and the scores of its k best, as of Lists.search()."""
    return Lists(x).search(q, skip, k, strides=strides)[0]


def search_team(q_ids: np.ndarray, q: np.ndarray, team: list[tuple[np.ndarray, Lists]], k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each query the ids and scores of its k best in the blocks (ids in order, lists) of a team, ties to
    smaller ids, and how many entries of a list were read in all."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    floor, read = np.full(len(q), NONE), 0
    for ids, lists in team:
        skip = np.full(len(q), -1)
        low, high = np.searchsorted(ids, q_ids), np.searchsorted(ids, q_ids, side="right")
        for i in np.flatnonzero(high > low):
            x = lists.x[low[i] : high[i]]
            dims = max(x.shape[1], q.shape[1])
            same = np.flatnonzero((np.pad(x, ((0, 0), (0, dims - x.shape[1]))) == np.pad(q[i], (0, dims - q.shape[1]))).all(axis=1))
            skip[i] = low[i] + same[0] if len(same) else -1
        found, depth = lists.search(q, skip, k, floor)
        read += int(depth.sum())
        for i, (place, score) in enumerate(found):
            if len(place):
                at, scores = np.concatenate([best[i][0], ids[place]]), np.concatenate([best[i][1], score.astype(np.int64)])
                top = np.lexsort((at, -scores))[:k]
                best[i] = at[top], scores[top]
                if len(top) == k:
                    floor[i] = scores[top[-1]]
    return best, read


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK, asked: int = ASKED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id ``every`` divides, the ``k`` other vectors of
    largest integer inner product (all, if fewer), ties to the smaller id.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids. Rows that
    repeat an id are candidates each; as a query such an id answers once, with the least of its vectors, and
    leaves out one row that equals it. Vectors of fewer components than others count as filled up with zeros.
    A task gets the blocks of a team and then the query blocks, one after the other; it keeps k rows a query,
    and the k best of those are the result. An empty table gives no rows. Scores of 2 ** 62 and more raise
    OverflowError."""
    whole = whole_vectors(vectors, id_col, vector_col)
    n, dims = whole.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    size = min(block, max(LEAST, n // (4 * cores)))
    parts, asks = max(1, -(-n // size)), max(1, -(-n // (every * asked)))
    # Each value is held as it is, in its list, and as a place: 20 bytes.
    team = max(1, min(TEAM, parts // (2 * cores), TEAM_BYTES // (20 * size * max(1, dims))))
    teams = -(-parts // team)
    queries = whole.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    candidates = blocks(whole, size, parts).select(F.pmod("block", F.lit(teams)).cast("int").alias("team"), F.lit(-1).alias("ask"), "block", "ids", "xs", "dims")
    sent = blocks(queries, asked, asks).select(F.explode(F.sequence(F.lit(0), F.lit(teams - 1))).alias("team"), F.col("block").alias("ask"), "block", "ids", "xs", "dims")

    def answer(batches):
        at, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                ids, xs = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["xs"], "<f8").reshape(-1, row["dims"])
                if row["ask"] >= 0:
                    if at == row["team"]:
                        yield told(ids, search_team(ids, xs, held, k)[0])
                    continue
                if at != row["team"]:
                    at, held = row["team"], []
                held.append((ids, Lists(xs)))

    def told(q_ids: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        columns = np.repeat(q_ids, [len(ids) for ids, _ in found]), np.concatenate([ids for ids, _ in found]), np.concatenate([s for _, s in found])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    dealt = candidates.unionByName(sent).repartition(teams, "team").sortWithinPartitions("team", "ask", "block")
    found = dealt.mapInArrow(answer, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
