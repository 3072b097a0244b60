"""Exact top-k inner products over an impact-ordered index, score at a time.

Components are whole numbers. Within a block of candidates the size of every component is quantised to the
middle of one of a few impact levels; a posting segment holds the candidates of one dimension and level with
their signed impacts. Segments are processed by descending impact, for a group of queries at once: each adds
query component times impact to the accumulators of its candidates. What a vector still hides after a level
is known by its norm, which the index stores; by Cauchy and Schwarz a score differs from its accumulator by at
most that norm times the query's. The k best accumulators are scored exactly, so the k-th of those scores is a
proven floor. A query stops, and leaves its group, as soon as only few candidates can reach its floor; these
are scored again from whole vectors. Without such a proof all segments are processed and whatever is still
possible is scored again, so the result is exact either way.

Candidates are written once, dealt evenly; a task indexes a block of them at a time, once for all queries of
a round, and passes the floors on from block to block. The queries of a round are broadcast: ``QUERIES`` of
them at most, by the writer's limit of rows a file. Vectors are never shuffled again and nothing is paired
but by the index, so neither a block nor a set of equal vectors grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from webloom.workspace import dropped, partitions, written

#: Vectors of a block at most, and at least; queries of a round; impact levels; queries of a group.
BLOCK, LEAST_BLOCK, QUERIES, LEVELS, GROUP = 8192, 1024, 16384, 32, 64
#: A query stops when at most so many candidates, or this share of the block, are possible.
FEW, FEW_SHARE = 64, 1 / 32


class Index:
    """Impact-ordered postings of one block: whole-number vectors (rows) with their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        self.ids, self.vectors = ids, vectors
        size = np.abs(vectors)
        step = max(1, int(-(-(size.max(initial=0) + 1) // levels)))
        level = size // step
        dim, row = np.nonzero(level.T)
        own = level[row, dim]
        order = np.lexsort((row, dim, -own))
        dim, row, own = dim[order], row[order], own[order]
        value = vectors[row, dim]
        impact = np.sign(value) * (own * step + step // 2)
        self.postings = len(row)
        new = np.ones(len(row), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (dim[1:] != dim[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(row))
        # of each level: its segments (dimension, rows, signed impacts), postings up to it, norms of what is left after it
        self.levels: list[tuple[list, int, np.ndarray]] = []
        left = (vectors.astype(np.float64) ** 2).sum(1)
        for at in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(own[starts])) + 1):
            if not len(at):
                continue
            a, b = starts[at[0]], ends[at[-1]]
            v = value[a:b].astype(np.float64)
            left = left + np.bincount(row[a:b], (v - impact[a:b]) ** 2 - v * v, len(ids))
            segments = [(int(dim[i]), row[i:j], impact[i:j]) for i, j in zip(starts[at], ends[at])]
            self.levels.append((segments, int(b), np.sqrt(np.maximum(left, 0))))
        if not self.levels:  # all zeros
            self.levels.append(([], 0, np.sqrt(left)))
        #: Norm of the longest vector of impacts.
        self.longest = float(np.sqrt(np.bincount(row, impact.astype(np.float64) ** 2, len(ids)).max(initial=0)))

    def search(self, queries: np.ndarray, k: int, own: np.ndarray, floors: np.ndarray | None = None, report: list | None = None) -> list[list[tuple[int, int]]]:
        """For each query [(score, id)] of the best k, by descending score, then ascending id; ``own`` ids are left out.

        ``floors`` are scores that k candidates elsewhere are known to reach: what lies below may be missing.
        ``report`` receives for each query the share of all postings processed.
        """
        n, few = len(self.ids), max(FEW, int(len(self.ids) * FEW_SHARE))
        out: list[list[tuple[int, int]]] = [[] for _ in queries]
        active = np.arange(len(queries))
        norm = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        floor = np.full(len(queries), -np.inf) if floors is None else floors.astype(np.float64)
        # accumulators of four bytes where none can outgrow them
        kind = np.int32 if norm.max(initial=0) * self.longest < 2**31 - 1 else np.int64
        least = np.iinfo(kind).min
        seen, q = np.zeros((n, len(queries)), kind), queries.astype(kind)
        ahead = 0.25
        for j, (segments, done, left) in enumerate(self.levels):
            for d, rows, impact in segments:
                seen[rows] += impact.astype(kind)[:, None] * q[:, d]
            last = j + 1 == len(self.levels)
            if not last and done < ahead * self.postings:
                continue
            ahead = done / max(1, self.postings) + 0.08
            guess = seen.T.copy()  # a row a query
            mine = [np.flatnonzero(self.ids == i) for i in own[active].tolist()]
            for c, rows in enumerate(mine):
                guess[c, rows] = least
            if n > k + 1:
                # the best so far, scored exactly; rows of the query's own don't count
                top = np.argpartition(guess, n - k, axis=1)[:, n - k :]
                exact = np.einsum("qkd,qd->qk", self.vectors[top], queries[active])
                exact = np.where(self.ids[top] == own[active, None], -np.inf, exact)
                floor[active] = np.maximum(floor[active], exact.min(1))
                # a margin for the rounding of norms
                slack = left * norm[active, None] * (1 + 1e-9) + 1
                possible = guess + slack >= floor[active, None]
            else:
                possible = np.ones(guess.shape, dtype=bool)
            for c, rows in enumerate(mine):
                possible[c, rows] = False
            ready = last | (possible.sum(1) <= few)
            for c in np.flatnonzero(ready).tolist():
                rows = np.flatnonzero(possible[c])
                score = self.vectors[rows] @ queries[active[c]]
                best = np.lexsort((self.ids[rows], -score))[:k]
                out[active[c]] = list(zip(score[best].tolist(), self.ids[rows[best]].tolist()))
            if report is not None:
                report += [done / max(1, self.postings)] * int(ready.sum())
            if ready.any():
                active, seen, q = active[~ready], seen[:, ~ready], q[~ready]
            if not len(active):
                break
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists as a matrix; shorter vectors are filled up with zeros."""
    size = np.asarray(column.value_lengths(), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.int64)
    out = np.zeros((len(size), int(size.max()) if len(size) else 0), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of ``block`` rows at a time."""
    held, n = [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held)
        return np.asarray(table["vec_id"]), _matrix(pa.concat_arrays(table["v"].chunks))

    for b in batches:
        while b.num_rows:
            part, b = b.slice(0, block - n), b.slice(block - n)
            held.append(part)
            n += part.num_rows
            if n == block:
                yield joined()
                held, n = [], 0
    if n:
        yield joined()


def _search(sent, k: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, queries = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in q_ids]
        floors = np.full(len(q_ids), -np.inf)
        for ids, vectors in _blocks(batches, block):
            dims = max(vectors.shape[1], queries.shape[1])
            index = Index(ids, np.pad(vectors, ((0, 0), (0, dims - vectors.shape[1]))))
            wide = np.pad(queries, ((0, 0), (0, dims - queries.shape[1])))
            for i in range(0, len(q_ids), GROUP):
                part = slice(i, i + GROUP)
                for c, found in enumerate(index.search(wide[part], k, q_ids[part], floors[part])):
                    if found:
                        best[i + c] = sorted(best[i + c] + found, key=lambda x: (-x[0], x[1]))[:k]
                        if len(best[i + c]) == k:
                            floors[i + c] = best[i + c][-1][0]
        rows = np.array([(c, q_ids[c], *x) for c, found in enumerate(best) for x in found], dtype=np.int64).reshape(-1, 4)
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(rows[i : i + 10_000, c]) for c in range(4)], names=["query", "query_id", "score", "vec_id"])

    return run


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component; null if the vector is null or holds a null, NaN or infinity."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, vector: str = "embedding", block: int = BLOCK, per_query_block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row for which ``queries`` holds, its k best other rows.

    Equal scores go to the smaller vec_id; a query has fewer rows if there are fewer candidates. Rows whose
    id is null, and vectors that are null or hold a null or non-finite component, take no part. Rows that
    repeat a query's id count as the query's own; other repeated ids stay separate candidates. An id with
    unlike vectors is a query for each of them. Vectors of different lengths are compared as if filled up with
    zeros. Other columns do no harm. No rows give no rows.
    """
    spark = vectors.sparkSession
    kept = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("_query"), whole_numbers(F.col(vector), scale).alias("v")).where("v is not null")
    n = vectors.count()
    parts = max(-(-n // block), min(partitions(spark), -(-n // LEAST_BLOCK)), 1)
    dealt = written(kept.repartition(parts), "topk-vectors")
    asked = dealt.where("_query").select("vec_id", "v").distinct()
    rounds = max(1, -(-dealt.where("_query").count() // per_query_block))
    asked = written(asked.repartition(rounds), "topk-queries", maxRecordsPerFile=per_query_block)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    for file in asked.inputFiles():
        rows = spark.read.schema(asked.schema).parquet(file).toArrow()  # per_query_block at most
        if not rows.num_rows:
            continue
        sent = spark.sparkContext.broadcast((np.asarray(rows["vec_id"]), _matrix(rows["v"].combine_chunks())))
        found = dealt.select("vec_id", "v").mapInArrow(_search(sent, k, block), "query long, query_id long, score long, vec_id long")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = out.unionByName(written(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk-found"))
        sent.destroy()
    dropped(dealt)
    dropped(asked)
    return out
