"""Exact top-k search by columnar branch and bound.

Candidates lie in vertical layout, one row per dimension.  A query's scores grow
dimension block by dimension block.  After each block a candidate's score is
known up to the product of the lengths that remain of both vectors
(Cauchy-Schwarz), so candidates whose best case lies under the k-th best worst
case are dropped, and the survivors are compacted before the next block.

Queries and candidates are dealt into blocks of bounded size, and each pair of
blocks is one task's work; a query's best over all blocks are chosen last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.llm.embedding import finite

#: Dimensions taken at a time.
STEP = 8
#: Rows of a block of candidates (between these bounds, a 24th of the table) and of queries.
CANDIDATES, QUERIES = (4096, 65536), 4096


class Block:
    """Candidates in vertical layout, dimensions by falling mass, with the lengths that remain after each block."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, v = ids[order], values[order].T
        self.by = np.argsort(-(v.astype(np.float64) ** 2).sum(1), kind="stable")
        self.top = float(np.abs(v).max()) if v.size else 0.0
        # doubles hold integers up to 2^53
        self.v = np.ascontiguousarray(v[self.by], np.float64 if self.top < 2**53 else np.int64)
        self.cuts = list(range(0, len(v), STEP)) + [len(v)]
        mass = np.zeros((len(self.cuts), len(ids)))
        for i in range(len(self.cuts) - 2, -1, -1):
            mass[i] = mass[i + 1] + (self.v[self.cuts[i] : self.cuts[i + 1]].astype(np.float64) ** 2).sum(0)
        self.rest = np.sqrt(mass)

    def best(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates other than the query's own row; ties to the lesser id."""
        q = q[self.by]
        alive = np.flatnonzero(self.ids != own)
        # doubles add integers exactly up to 2^53; beyond it 64-bit integers do
        kind = np.float64 if self.top * float(np.abs(q).max(initial=0)) * max(1, len(q)) < 2**52 else np.int64
        score, left = np.zeros(len(alive), kind), np.sqrt(np.append((q.astype(np.float64)[::-1] ** 2).cumsum()[::-1], 0.0))
        for b in range(len(self.cuts) - 1):
            s, e = self.cuts[b], self.cuts[b + 1]
            part = self.v[s:e] if len(alive) == len(self.ids) else self.v[s:e, alive]
            score = score + q[s:e].astype(kind) @ part.astype(kind, copy=False)
            if len(alive) <= k or e == len(q):
                continue
            slack = left[e] * self.rest[b + 1, alive] * (1 + 1e-9) + 1e-6 * (1 + np.abs(score))
            least = np.partition(score - slack, len(alive) - k)[len(alive) - k]
            keep = score + slack >= least
            if keep.sum() < 0.8 * len(alive):
                alive, score = alive[keep], score[keep]
        # ids rise with alive, so a stable sort breaks ties towards the lesser id
        order = np.argsort(-score, kind="stable")[:k]
        return self.ids[alive[order]], score[order].astype(np.int64)


def scaled(v: Column) -> Column:
    """Components as floor(256 x), x as double."""
    return F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every``, its k best other rows.

    The score is the integer inner product of the scaled vectors.  Rows with a
    null id, a null vector, or null or non-finite components take no part;
    vectors meet only vectors of their own length.  Ties go to the lesser id.
    A row that repeats an id is a candidate of its own, but never for its id's
    query; an id that stands for several vectors asks with the least of them.  With fewer than k candidates all are returned; an empty table gives
    no rows.
    """
    rows = df.where(finite(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vec_col)).alias("v"))
    rows = rows.select("id", "v", F.size("v").alias("d"))
    query = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.size("v").alias("d"))
    n, m = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    size = min(CANDIDATES[1], max(CANDIDATES[0], n // 24))
    blocks, groups = max(1, -(-n // size)), max(1, -(-m // QUERIES))
    c = rows.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    q = query.withColumn("qb", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(groups)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            dense = lambda t: np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1)
            block = Block(left.column("id").to_numpy(), dense(left))
            for own, v in zip(right.column("id").to_numpy().tolist(), dense(right)):
                ids, scores = block.best(own, v, k)
                out[0].append(np.full(len(ids), own))
                out[1].append(ids)
                out[2].append(scores)
        return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    keys = ["d", "cb", "qb"]
    found = c.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
