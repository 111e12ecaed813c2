"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into 1, 4 and 16 segments. For each segment, length * mean * mean + deviation * deviation (deviations as
root sums of squares) bounds the segment's share of the inner product from above, and with it the squared distance
|q|^2 + |v|^2 - 2 <q, v> from below. For all segments this is again an inner product of short statistics vectors. Bounds go
from coarse to fine: the k candidates with the best bound give a first threshold, candidates below it are dropped at each
level, and only survivors are scored exactly, in integers. A score that a long cannot hold raises an error.

Queries and candidates meet in a grid of blocks of at most about ``BLOCK`` queries and ``ROWS`` candidates, whatever the
table's size; every block pair gives at most k rows a query, and a window takes the k best of those.

Vectors that are null, empty or hold null or non-finite components take no part, as do rows without id. Vectors of different
lengths do not meet. Equal scores go to the smaller id. Rows that repeat a query's id are the query itself; a repeated
candidate id counts once. Components are used as floor(scale * x), from x as double. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import load, parts

LEVELS = (1, 4, 16)
#: About the most queries and candidates in one cell of the grid.
BLOCK, ROWS = 8192, 65_536
OUT = "query_id long, vec_id long, score long"


def _matrix(frame: pd.DataFrame, dim: int) -> np.ndarray:
    return np.concatenate(frame["v"].to_numpy()).astype(np.float64, copy=False).reshape(-1, dim)


def exact_scores(q: np.ndarray, v: np.ndarray, top: float) -> np.ndarray:
    """Integer inner products of whole-numbered vectors; no component of v is larger than ``top``."""
    if not len(v):
        return np.zeros(0, np.int64)
    bound = np.abs(q).sum() * top  # of every partial sum
    if bound < 2.0**53:  # doubles hold them all
        return (v @ q).astype(np.int64)
    if bound < 2.0**62:
        return v.astype(np.int64) @ q.astype(np.int64)
    own = [int(x) for x in q]
    out = [sum(a * int(b) for a, b in zip(own, row, strict=True)) for row in v]
    if any(not -(2**63) <= x < 2**63 for x in out):
        raise OverflowError("an inner product does not fit into a long")
    return np.array(out, np.int64)


def statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """For each vector the weighted means and the deviations of its segments; inner products bound those of the vectors."""
    out = []
    for part in np.array_split(m, min(segments, m.shape[1]), axis=1):
        mean = part.mean(axis=1)
        out += [mean * np.sqrt(part.shape[1]), np.sqrt(np.square(part - mean[:, None]).sum(axis=1))]
    return np.stack(out, axis=1)


def search(q_ids, q: np.ndarray, v_ids, v: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each query in one block, ties to the smaller id."""
    order = np.argsort(v_ids, kind="stable")
    v_ids, v = v_ids[order], v[order]
    v_ids, first = np.unique(v_ids, return_index=True)
    v = v[first]
    qs, vs = [statistics(q, s) for s in LEVELS], [statistics(v, s) for s in LEVELS]
    found = []
    most = float(np.abs(v).max()) if len(v) else 0.0
    for i in range(len(q)):
        slack = 1e-9 * (1 + np.abs(q[i]).sum() * most)
        alive = np.flatnonzero(v_ids != q_ids[i])
        if len(alive) > k:
            for mine, theirs in zip(qs, vs, strict=True):
                bound = theirs[alive] @ mine[i] + slack
                if len(alive) > 4 * k:
                    best = alive[np.argpartition(-bound, k - 1)[:k]]
                    threshold = np.sort(v[best] @ q[i])[0]
                    alive = alive[bound >= threshold]
        score = exact_scores(q[i], v[alive], most)
        top = np.lexsort((v_ids[alive], -score))[:k]
        found.append((np.full(len(top), q_ids[i]), v_ids[alive][top], score[top]))
    cols = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))


def _cell(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
        dim = int(rows["dim"].iloc[0])
        queries = queries.drop_duplicates("id")
        return search(queries["id"].to_numpy(np.int64), _matrix(queries, dim), rows["id"].to_numpy(np.int64), _matrix(rows, dim), k)

    return run


def topk_search(vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    doubles = F.col(vec_col).cast("array<double>")
    good = F.coalesce(F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(doubles, lambda x: F.floor(x * scale).cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), doubles.alias("d"), good.alias("good"), whole.alias("v")).filter("good and id is not null and size(d) > 0").select("id", "v", F.size("v").alias("dim"))
    queries = rows.filter(F.col("id") % every == 0)
    sizes = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("id") % every == 0).alias("queries")).first()
    blocks = max(1, -(-sizes["queries"] // BLOCK))
    groups = max(4, parts(spark), -(-sizes["rows"] // ROWS))
    q = queries.withColumn("qb", F.pmod(F.hash("id"), F.lit(blocks))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    v = rows.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["g", "qb", "dim"]
    found = q.groupBy(*key).cogroup(v.groupBy(*key)).applyInPandas(_cell(k), OUT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark, sf_dir: str) -> DataFrame:
    return topk_search(load(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
