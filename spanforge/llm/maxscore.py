"""Exact top-k inner products by MaxScore over shards of impact-ordered postings.

Terms are the dimensions. A shard holds, per dimension, the column of its rows' integer values with the column's least
and greatest value. A query's contribution in a dimension is measured from the worst that the shard can give, so it is
never negative and each dimension has an upper bound. Dimensions are ordered by that bound. The non-essential ones are
the longest tail whose bounds together stay below what the current k-th score still needs: a row that scores nothing
elsewhere cannot get in by them. The essential dimensions are traversed for all rows; then the others are probed one
after another, only for rows that can still reach the k-th score. Rows that tie with it are kept, so ties go to the
smaller id exactly. Every (block of queries, shard) cell is a task of bounded size; the cells' k best are merged.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of different lengths
are filled with zeros; a query is never its own candidate, but other rows with its id are (each row is a row); with
fewer than k candidates all are returned; an empty table gives an empty result; other columns are ignored; integers
too large for exact doubles are multiplied as Python integers and scores beyond 64 bits stop at its ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard and queries of a block, on average. Of n rows and q queries, q / BLOCK_QUERIES copies of each row and
#: n / SHARD_ROWS of each query are sent, so both are as large as a cell's memory (some 8 MB a side at 64 dimensions) allows.
SHARD_ROWS, BLOCK_QUERIES = 16_384, 16_384
#: Rows whose full scores seed the k-th score.
SEED_ROWS = 256
SAFE = float(1 << 52)


class Shard:
    """Rows of one shard, dimension by dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, self.rows = ids[order], rows[order]
        self.columns = np.ascontiguousarray(values[order].T)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)
        self.largest = float(np.abs(self.columns).max()) if self.columns.size else 0.0
        # A fixed spread of rows, scored in full for each query before it starts.
        self.seeds = np.linspace(0, len(ids) - 1, min(SEED_ROWS, len(ids))).astype(np.intp)
        self.seed_values = self.columns[:, self.seeds]

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the k best rows, the row `own` left out; ties to the smaller id."""
        live = np.ones(len(self.rows), bool)
        live[np.flatnonzero(self.rows == own)[:1]] = False  # of equal rows only one is the query itself
        if self.largest * float(np.abs(query).max(initial=0)) * max(1, len(query)) >= SAFE:
            whole = sum(self.columns[d].astype(np.int64).astype(object) * int(query[d]) for d in range(len(query)))
            scores = np.clip(np.asarray(whole, object), -(1 << 63), (1 << 63) - 1).astype(np.int64)
            return self.pick(np.flatnonzero(live), scores[live], k)
        worst = np.minimum(query * self.low, query * self.high)
        bounds = np.maximum(query * self.low, query * self.high) - worst
        floor = worst.sum()
        order = np.argsort(-bounds, kind="stable")
        remaining = np.append(np.cumsum(bounds[order][::-1])[::-1], 0.0)
        seeds = (query @ self.seed_values)[live[self.seeds]]
        need = np.partition(seeds, len(seeds) - k)[len(seeds) - k] if len(seeds) >= k else -np.inf
        # Essential: the fewest leading dimensions without which no row reaches the k-th score.
        essential = int(np.searchsorted(-(floor + remaining), -need, side="left"))
        essential = min(max(essential, 1), len(order))
        first = order[:essential]
        partial = query[first] @ self.columns[first] + worst[order[essential:]].sum()
        alive = np.flatnonzero(live & (partial + remaining[essential] >= need))
        partial = partial[alive]
        at = essential
        while at < len(order) and len(alive):
            some = order[at : at + 4]
            partial = partial + query[some] @ self.columns[some[:, None], alive] - worst[some].sum()
            at += len(some)
            if len(partial) > k:
                need = max(need, np.partition(partial, len(partial) - k)[len(partial) - k])
            keep = partial + remaining[at] >= need
            if not keep.all():
                alive, partial = alive[keep], partial[keep]
        return self.pick(alive, np.rint(partial).astype(np.int64), k)

    def pick(self, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(at) > k:
            need = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= need
            at, scores = at[keep], scores[keep]
        top = np.lexsort((self.ids[at], -scores))[:k]
        return at[top], scores[top]


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, row, values): floor(256 * x) of usable vectors; row tells rows with one id apart."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.coalesce(fine, F.lit(False)))
    values = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor(v * 256.0).cast("double"))
    return rows.select("vec_id", F.xxhash64("vec_id", "embedding").alias("row"), values.alias("values"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates in `vectors` for each row of `queries`.

    Both are results of `integers`; queries are rows of the same table. Vectors come to shards and queries to blocks by
    hash. A cell gets one shard and one block, both of bounded size at any input.
    """
    shards = 1 + vectors.count() // SHARD_ROWS
    blocks = 1 + queries.count() // BLOCK_QUERIES
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shard = F.pmod(F.xxhash64("row", F.lit("shard")), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)).cast("int")
    left = vectors.withColumn("shard", shard).withColumn("block", numbers(blocks))
    right = queries.withColumn("block", block).withColumn("shard", numbers(shards))
    names = ["query_row", "query_copy", "query_id", "vec_id", "score"]

    def cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            values, others = matrix(rows["values"]), matrix(asked["values"])
            width = max(values.shape[1], others.shape[1], 1)
            values, others = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (values, others))
            held = Shard(rows["vec_id"].to_numpy(), rows["row"].to_numpy(), values)
            copies: dict[int, int] = {}  # equal rows come to one block, where they are told apart
            for row, name, query in zip(asked["row"].to_pylist(), asked["vec_id"].to_pylist(), others, strict=True):
                at, scores = held.best(query, row, k)
                copies[row] = copies.get(row, 0) + 1
                out += [(row, copies[row], name, i, s) for i, s in zip(held.ids[at].tolist(), scores.tolist(), strict=True)]
        return pa.table({n: pa.array([o[i] for o in out], pa.int64()) for i, n in enumerate(names)})

    cells = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(cell, "query_row long, query_copy long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row", "query_copy").orderBy(F.desc("score"), "vec_id")
    merged = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, filled with zeros to the longest."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.n, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.n <> v.n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
