"""Exact inner-product search with a ball tree per shard.

Rows are dealt to shards by a hash; each shard's task builds a ball tree over its vectors
and answers a block of queries by branch and bound: the bound of a node is
q . centre + |q| * radius, nodes are visited by falling bound, and a node is skipped once
its bound is below the query's k-th score so far. The k-th score of a query over a small
seed shard goes along with it, so every shard starts with a shared bound.

Vectors and queries meet in (shard, block) groups of bounded size. The work is queries
times shards, as the exact answer over all rows needs; no other pairs are made, and each
group returns at most k rows a query.

Edge cases: vectors that are null or hold a null or non-finite component take no part, as
candidate or query; nor do rows with a null id. Vectors of other lengths than a query's are
no candidates of it. Ties go to the smaller id. Rows that repeat an id count as separate
candidates, but none of them is a candidate of a query with that id; queries that repeat an
id have a list each. An empty table gives no rows. Extra columns are ignored, whatever their
names. Products are exact as long as a score fits a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

LEAF = 64
OUT = "query long, query_id long, vec_id long, score long"


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as long; null if the vector can't take part."""
    wide = vector.cast("array<double>")
    fine = F.forall(wide, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return F.when(fine, F.transform(wide, lambda x: F.floor(F.lit(float(scale)) * x)))


class BallTree:
    """Vectors (integers, as float64 and int64) split by the wider of two far points."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order, self.nodes = np.arange(len(ids)), []
        self._split(order, rows.astype(np.float64), 0, len(ids))
        self.ids, self.rows = ids[order], rows[order]

    def _split(self, order, rows, a, b) -> int:
        mine = rows[order[a:b]]
        centre = mine.mean(0)
        far = np.sqrt(((mine - centre) ** 2).sum(1))
        me = len(self.nodes)
        self.nodes.append([centre, far.max() * (1 + 1e-9) + 1e-6, a, b, -1, -1])
        if b - a > LEAF:
            p = mine[far.argmax()]
            q = mine[((mine - p) ** 2).sum(1).argmax()]
            side = np.argsort(mine @ (q - p), kind="stable")
            order[a:b] = order[a:b][side]
            mid = (a + b) // 2
            self.nodes[me][4] = self._split(order, rows, a, mid)
            self.nodes[me][5] = self._split(order, rows, mid, b)
        return me

    def search(self, query: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, id), at least those with a score of floor or more."""
        import heapq

        q = query.astype(np.float64)
        norm = float(np.sqrt(q @ q))
        best: list[tuple[int, int]] = []  # (score, -id), the worst first

        def bound(i):
            return float(self.nodes[i][0] @ q) + norm * self.nodes[i][1] + 1e-3

        heap = [(-bound(0), 0)]
        while heap:
            top, i = heapq.heappop(heap)
            if -top < (max(floor, best[0][0]) if len(best) == k else floor):
                break
            _, _, a, b, left, right = self.nodes[i]
            if left < 0:
                scores = self.rows[a:b] @ query
                bar = best[0][0] if len(best) == k else floor
                for j in np.flatnonzero((scores >= bar) & (self.ids[a:b] != own)):
                    item = (int(scores[j]), -int(self.ids[a + j]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            else:
                heapq.heappush(heap, (-bound(left), left))
                heapq.heappush(heap, (-bound(right), right))
        return [(s, -i) for s, i in best]


def _searcher(k: int):
    def search(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, same in part.groupby(part["v"].str.len()):
            rows, queries = same[same["kind"] == 0], same[same["kind"] == 1]
            if len(rows) and len(queries):
                tree = BallTree(rows["id"].to_numpy(), np.array(rows["v"].tolist(), np.int64).reshape(len(rows), -1))
                for number, own, v, floor in zip(queries["query"], queries["id"], queries["v"], queries["floor"]):
                    out += [(number, own, i, s) for s, i in tree.search(np.asarray(v, np.int64), own, k, floor)]
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score"])

    return search


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 4096, block_queries: int = 512, row_id: str = "vec_id", vector: str = "v") -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k highest integer inner products
    over rows (all, if fewer). vector: array<long> without nulls, see quantized()."""
    known = F.col(vector).isNotNull() & F.col(row_id).isNotNull()
    base = rows.where(known).select(F.lit(None).cast("long").alias("query"), F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = stored(queries.where(known).select(F.monotonically_increasing_id().alias("query"), F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v")))
    n_rows, n_asked = base.count(), asked.count()
    shards, blocks = max(1, -(-n_rows // shard_rows)), max(1, -(-n_asked // block_queries))
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = base.withColumn("shard", deal(shards, "id", "v", F.lit(1))).withColumn("block", every(blocks)).withColumn("kind", F.lit(0)).withColumn("floor", F.lit(0.0))
    asked = asked.withColumn("block", deal(blocks, "query"))

    def searched(cells: DataFrame, asked: DataFrame) -> DataFrame:
        cols = ["shard", "block", "kind", "query", "id", "v", "floor"]
        return cells.select(cols).unionByName(asked.withColumn("kind", F.lit(1)).select(cols)).groupBy("shard", "block").applyInPandas(_searcher(k), OUT)

    none = F.lit(float("-inf"))
    if shards > 1:  # a shard that all queries see first gives the bound that they share
        first = searched(cells.where("shard = 0"), asked.withColumn("shard", F.lit(0)).withColumn("floor", none))
        ranked = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor"))
        floors = ranked.where(F.col("n") >= k).select("query", "floor")
        asked = asked.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", none))
    else:
        asked = asked.withColumn("floor", none)
    found = searched(cells, asked.withColumn("shard", every(shards)))
    # a filter on the row number lets Spark keep k rows a query in each task before it shuffles
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
