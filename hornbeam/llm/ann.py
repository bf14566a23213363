"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Each vector is rotated by one random orthogonal matrix and kept as the signs of
its components, packed, with two correction scalars: its norm and the inner
product of its direction with its code. A query's inner product with a vector
is estimated from the code and the scalars, with a bound on the error. Only
vectors whose upper bound reaches the k-th largest lower bound are reranked
with the original vectors, in double precision.

Queries and vectors meet block by block: a block is a bounded number of rows
packed into one, so that a task holds one block of each at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "block long, ids binary, vectors binary, codes binary, norms binary, aligned binary"
_FOUND = "query_id long, vec_id long, score double"


def rotation(dim: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(embedding: Column) -> Column:
    """Not null, not zero, and every component finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, norms, and the inner product of each direction with its code."""
    norms = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norms[:, None]) @ turn.T
    return np.packbits(turned > 0, axis=1), norms, np.abs(turned).sum(axis=1) / math.sqrt(vectors.shape[1])


def dot_in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def search_block(queries: np.ndarray, query_ids: np.ndarray, block: dict, turn: np.ndarray, k: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best vectors of the block: (query ids, vector ids, scores)."""
    ids, vectors, norms, aligned = block["ids"], block["vectors"], block["norms"], block["aligned"]
    dim = vectors.shape[1]
    signs = np.unpackbits(block["codes"], axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (queries @ turn.T).astype(np.float32)
    estimate = (turned @ signs.T) * (norms / (aligned * math.sqrt(dim))).astype(np.float32)
    slack = np.linalg.norm(queries, axis=1)[:, None].astype(np.float32) * (norms * np.sqrt(np.maximum(0, 1 - aligned**2)) / aligned * width / math.sqrt(max(1, dim - 1))).astype(np.float32)
    slack += 1e-5 * np.abs(estimate)
    out_q, out_v, out_s = [], [], []
    own = query_ids[:, None] == ids[None, :]
    lower = np.where(own, -np.inf, estimate - slack)
    at_least = np.partition(lower, len(ids) - min(k, len(ids)), axis=1)[:, len(ids) - min(k, len(ids))]
    chosen = (estimate + slack >= at_least[:, None]) & ~own
    for q in range(len(queries)):
        rows = np.flatnonzero(chosen[q])
        if len(rows) > k:  # a first sum finds who can be among the k best; the last digits come after
            rough = vectors[rows] @ queries[q]
            last = np.partition(rough, len(rows) - k)[len(rows) - k]
            rows = rows[rough >= last - 1e-9 * (1 + abs(last))]
        score = dot_in_order(vectors[rows], np.broadcast_to(queries[q], (len(rows), dim)))
        best = np.lexsort((ids[rows], -score))[:k]
        out_q.append(np.full(len(best), query_ids[q]))
        out_v.append(ids[rows[best]])
        out_s.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", width: float = 3.0, block_rows: int = 4096, query_rows: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every query among all other rows.

    ``is_query`` is a condition on ``vec_id``. ``width`` scales the error bound, in standard deviations.
    Vectors that are null, zero or hold null or non-finite components take no part, nor those of another
    length than the commonest. A repeated row is a candidate as often as it stands there; a repeated query
    is asked once. Ties go to the smaller id. An empty table gives no rows.
    """
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n = sizes[0] if sizes else (1, 0)
    rows = rows.where(F.size("v") == dim)
    turn = rotation(dim)
    blocks, asked = max(1, -(-n // block_rows)), rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    query_blocks = max(1, -(-asked.count() // query_rows))
    spread = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), dim)
        codes, norms, aligned = encode(v, turn)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()], "codes": [codes.tobytes()], "norms": [norms.tobytes()], "aligned": [aligned.tobytes()]})

    def pack_queries(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf["v"].tolist(), np.float64)
        return pd.DataFrame({"q_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "q_vectors": [v.tobytes()]})

    def search(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                block = {"ids": np.frombuffer(r.ids, np.int64), "norms": np.frombuffer(r.norms), "aligned": np.frombuffer(r.aligned)}
                block["vectors"] = np.frombuffer(r.vectors).reshape(-1, dim)
                block["codes"] = np.frombuffer(r.codes, np.uint8).reshape(len(block["ids"]), -1)
                found = search_block(np.frombuffer(r.q_vectors).reshape(-1, dim), np.frombuffer(r.q_ids, np.int64), block, turn, k, width)
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    index = rows.withColumn("block", spread(blocks)).groupBy("block").applyInPandas(pack, _BLOCK)
    packed = asked.withColumn("block", spread(query_blocks)).groupBy("block").applyInPandas(pack_queries, "q_ids binary, q_vectors binary")
    everywhere = packed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = everywhere.join(index, "block").mapInPandas(search, _FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
