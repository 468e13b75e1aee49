"""Exact top-k inner products by aggregation without random access.

A vector's score for a query is the sum of its components' contributions.  Each
dimension of a block is a list of the block's vectors, put in order once; a
query reads it from the end that contributes most, entry after entry.  What has
been read bounds every score: an unread contribution is at most the last one
read from its list, and all unread ones together are at least minus the product
of the lengths of the unread parts of query and vector.  Reading stops when only
few vectors can still be among the best, seen or not; the scores of those few
are then summed in full.  No score is looked up before that.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE, BEST = 256, 5
#: Vectors of a block and queries of a group, on average.
BLOCK_ROWS, GROUP_QUERIES = 8192, 8192
#: Shares of a list after which the bounds are compared; at the end all is read and known.
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 9 / 16, 5 / 8, 11 / 16, 3 / 4, 7 / 8, 1)
#: A query stops reading when at most this share of the block's vectors is left.
LEFT_SHARE = 1 / 16

FOUND = "query_id bigint, vec_id bigint, score bigint"


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


class Lists:
    """The vectors of a block in order of each dimension."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.size, self.width = vectors.shape
        self.vectors = vectors.astype(np.float64)
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(self.vectors.T, self.order, axis=1)
        self.place = np.empty((self.size, self.width), np.int32)
        np.put_along_axis(self.place, self.order.T, np.arange(self.size, dtype=np.int32)[:, None], axis=0)
        self.lengths = (self.vectors**2).sum(axis=1)

    def best(self, query: np.ndarray, keep: int) -> tuple[np.ndarray, int]:
        """The vectors that may be among the ``keep`` best for a query, and how many entries were read to tell.

        Sums are in doubles; the bounds are wider by more than their rounding
        can amount to, so they hold for integers of any size.
        """
        size, q = self.size, query.astype(np.float64)
        if size <= keep:
            return np.arange(size), 0
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        rounding = self.width * 1e-14
        slack = np.abs(q).sum() * np.abs(self.sorted).max(initial=0.0) * rounding
        known, last, depth = np.zeros(size), np.zeros(self.width), 0
        for share in DEPTHS:
            to = max(depth, min(size, math.ceil(share * size)))
            for lists, part, end in ((up, slice(size - to, size - depth), size - to), (down, slice(depth, to), to - 1)):
                value = self.sorted[lists, part] * q[lists, None]
                known += np.bincount(self.order[lists, part].reshape(-1), value.reshape(-1), minlength=size)
                last[lists] = self.sorted[lists, end] * q[lists]
            depth = to
            # Any vectors give a bound on the best; those with the largest sums so far give a good one.
            lead = np.argpartition(known, size - min(size, 4 * keep))[size - min(size, 4 * keep) :]
            unread = self._unread(lead, q, depth)
            ahead = (unread * q**2).sum(axis=1) + rounding * (q**2).sum()
            behind = np.maximum(self.lengths[lead] - (~unread * self.vectors[lead] ** 2).sum(axis=1), 0) + rounding * self.lengths[lead]
            bound = np.sort(known[lead] - np.sqrt(ahead * behind))[-keep] - slack
            left = np.flatnonzero(known + np.maximum(last, 0).sum() + slack >= bound)
            if 2 * len(left) <= size or depth == size:
                left = left[known[left] + self._unread(left, q, depth) @ last + slack >= bound]
            if len(left) <= max(keep, LEFT_SHARE * size) or depth == size:
                break
        return left, depth * (len(up) + len(down))

    def _unread(self, rows: np.ndarray, q: np.ndarray, depth: int) -> np.ndarray:
        """Whether the entry of each row in each list that counts lies beyond ``depth``."""
        place = self.place[rows]
        return ((q > 0) & (place < self.size - depth)) | ((q < 0) & (place >= depth))


def _search(best: int):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if data.num_rows == 0 or queries.num_rows == 0:
            return kinds.empty_table()
        width = data.column("width")[0].as_py()
        ids = data.column("vec_id").to_numpy()
        whole = _matrix(data.column("vector"), width)
        order = np.argsort(ids, kind="stable")
        ids, whole = ids[order], whole[order]
        # Equal vectors are one entry of the lists; only their smallest ids can be among the best.
        vectors, group = np.unique(whole, axis=0, return_inverse=True)
        by_group = np.argsort(group.reshape(-1), kind="stable")
        begin = np.searchsorted(group.reshape(-1)[by_group], np.arange(len(vectors) + 1))
        query_ids, asked = queries.column("vec_id").to_numpy(), _matrix(queries.column("vector"), width)
        narrow = float(np.abs(vectors).max(initial=0)) * float(np.abs(asked).max(initial=0)) * max(1, width) < 2**63
        lists = Lists(vectors)
        if not narrow:
            vectors, asked = vectors.astype(object), asked.astype(object)
        a, b, c = [], [], []
        for own, query in zip(query_ids.tolist(), asked, strict=True):
            # One more than wanted, as the query itself may be among them.
            left, _ = lists.best(query, best + 1)
            score = vectors[left] @ query
            if len(left) > best + 1:  # of equal scores all stay, as the smaller ids win
                edge = sorted(score.tolist())[-best - 1]
                left, score = left[score >= edge], score[score >= edge]
            rows = [(-int(s), int(v)) for f, s in zip(left.tolist(), score.tolist(), strict=True) for v in ids[by_group[begin[f] : min(begin[f + 1], begin[f] + best + 1)]] if v != own]
            for s, v in sorted(rows)[:best]:
                a.append(own)
                b.append(v)
                c.append(-s)
        return pa.table([a, b, c], schema=kinds)

    return run


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector, width): floor(scale * x) of every component, for vectors without null or non-finite ones."""
    x = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("vector"))
    return rows.withColumn("width", F.size("vector")).distinct()


def top_inner_products(vectors: DataFrame, chosen: str = "vec_id % 50 = 0", best: int = BEST, scale: int = SCALE, block_rows: int = BLOCK_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """The ``best`` vectors of highest inner product for each chosen query: query_id, rank, vec_id, score.

    Ties go to the smaller vec_id; a query isn't its own answer; queries with
    fewer candidates return all.  Vectors that are null, or hold a null or
    non-finite component, and rows without an id take no part; vectors of
    another width than the query aren't its candidates; a repeated row counts
    once, and rows that share the query's id count as its own.

    Vectors are dealt into blocks by id and queries into groups; a task
    compares one block with one group and returns at most ``best`` rows for
    each query.  The queries, 1 in 50, are what is copied to the blocks.
    """
    whole = whole_vectors(vectors, scale)
    asked = whole.where(chosen)
    count, queries = whole.agg(F.count("*"), F.count_if(F.expr(chosen))).first()
    blocks, groups = max(1, -(-count // block_rows)), max(1, -(-queries // group_queries))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    data = whole.withColumn("block", deal(blocks)).withColumn("group", each(groups))
    asked = asked.withColumn("group", deal(groups)).withColumn("block", each(blocks))
    keys = ["width", "block", "group"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(best), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("query_id", "rank", "vec_id", "score")
