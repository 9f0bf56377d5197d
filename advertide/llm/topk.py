"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors are dealt into blocks; a block turns its components into postings, for
each term (component number) the members that hold it and their weights. A
slice of queries accumulates into a dense array of scores, one row a query:
term by term, the query's weight times the posting is scattered onto it. The k
best of a block come from partition selection, the k best of all from a ranked
merge of k rows a block. Every query meets every block, each once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from advertide.llm.exchange import pieces_for

BLOCK_VECTORS, SLICE_QUERIES = 8192, 256


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, terms``: floor(scale * x) of every component; rows without an id, null or not finite are left out."""
    whole = vectors.where("vec_id is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    terms = F.transform("embedding", lambda x: F.floor(x * scale).cast("long"))
    return whole.where(~F.coalesce(broken, F.lit(True))).select("vec_id", terms.alias("terms"))


def _postings(terms: list[np.ndarray]):
    """By term: the members that have a weight there, and the weights."""
    longest = max((len(t) for t in terms), default=0)
    member = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    term = np.concatenate([np.arange(len(t)) for t in terms])
    weight = np.concatenate(terms)
    order = np.argsort(term, kind="stable")
    member, term, weight = member[order], term[order], weight[order]
    edges = np.searchsorted(term, np.arange(longest + 1))
    for t in range(longest):
        own = slice(edges[t], edges[t + 1])
        held = weight[own] != 0
        yield t, member[own][held], weight[own][held]


def _search(k: int):
    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(vectors) or not len(queries):
            return pd.DataFrame({c: [] for c in names}, dtype="int64")
        vectors = vectors.sort_values("vec_id", kind="stable")
        ids, asked = vectors["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        rows = [np.asarray(t, dtype=np.int64) for t in queries["terms"]]
        width = max(len(r) for r in rows)
        wanted = np.zeros((len(rows), width), dtype=np.int64)
        for i, row in enumerate(rows):
            wanted[i, : len(row)] = row
        scores = np.zeros((len(rows), len(ids)), dtype=np.int64)
        for term, members, weights in _postings([np.asarray(t, dtype=np.int64) for t in vectors["terms"]]):
            if term >= width:
                break
            some = np.flatnonzero(wanted[:, term])
            if len(members) == len(ids):
                for q in some:
                    scores[q] += wanted[q, term] * weights
            else:
                for q in some:
                    scores[q, members] += wanted[q, term] * weights
        out = []
        for query, row in zip(asked, scores):
            others = np.flatnonzero(ids != query)
            row = row[others]
            if len(row) > k:
                edge = np.partition(row, len(row) - k)[len(row) - k]
                # Members above the edge, and of those on it the ones with the smallest ids: ids ascend here.
                above, level = np.flatnonzero(row > edge), np.flatnonzero(row == edge)
                best = np.concatenate([above, level[: k - len(above)]])
            else:
                best = np.arange(len(row))
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[others[best]], "score": row[best]}))
        return pd.concat(out, ignore_index=True)

    return search


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every id divisible by ``every`` the k best other rows.

    Ties go to the smaller id; a query has fewer rows where fewer others exist. Scores
    are 64-bit integers. A component that a shorter vector lacks counts as 0. Rows that
    share the query's id are the query itself.
    """
    own = quantised(vectors)
    asked = own.where(F.col("vec_id") % every == 0)
    blocks, slices = pieces_for(own.count(), BLOCK_VECTORS), pieces_for(asked.count(), SLICE_QUERIES)
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("vec_id", F.lit("slice")), F.lit(slices)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = own.select("vec_id", "terms", block.alias("block"), each(slices).alias("slice"))
    wanted = asked.dropDuplicates(["vec_id"]).select("vec_id", "terms", each(blocks).alias("block"), part.alias("slice"))
    found = held.groupBy("block", "slice").cogroup(wanted.groupBy("block", "slice"))
    best = found.applyInPandas(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
