"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the order of its ``PREFIX`` nearest pivots and
posted, with the place of the pivot in that order, in the inverted file of each.  A
query walks the files of its own ``PROBE`` nearest pivots and gathers
``PREFIX - max(place, place)`` for each vector met, which is what lowers the
footrule distance of two truncated orders; the nearest by footrule distance are
then scored exactly.

For n vectors there are about ``4 sqrt(n)`` pivots (at most ``PIVOTS``) and
``RERANK sqrt(n)`` vectors are scored for a query, so that both the postings it
meets and its exact scores grow with the root of n.  The same formulas hold at
every size; under ``RERANK ** 2`` vectors they score all.  ``rerank`` (a number of
vectors) buys recall with time: n makes the answer exact.

Largest inner product becomes nearest point by one more coordinate, the root of
the largest squared norm less the vector's own (nought for a query).

The index is kept in shards of about ``SHARD`` vectors and the queries, every
row whose id is divisible by ``every``, go to all shards in blocks of ``BLOCK``;
each pair of a block and a shard is one task of bounded size.  Equal vectors are
one entry with as many of the smallest ids as an answer can need, so a vector
that very many rows share neither fills a shard nor crowds out others.

Pivots are the only thing fitted on a sample: the vectors with the smallest
hashes of their ids.  Vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, as do null ids.  Repeated rows
of one id and vector count once; ties in score go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, PREFIX, PROBE, RERANK = 4096, 48, 32, 32
SHARD, BLOCK = 32768, 1024


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    src = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return src.filter(fine)


def _orders(points: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each point, nearest first, ties to the smaller pivot."""
    pivots, out = pivots.astype(np.float32), []
    for some in np.array_split(points.astype(np.float32), max(1, len(points) // 512)):
        d = (pivots**2).sum(1) - 2 * some @ pivots.T
        if prefix < d.shape[1]:
            near = np.sort(np.argpartition(d, prefix, axis=1)[:, :prefix], axis=1)
        else:
            near = np.broadcast_to(np.arange(d.shape[1]), d.shape)
        out.append(np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out).astype(np.int16)


def _lift(x: np.ndarray, largest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(largest - (x * x).sum(1), 0))[:, None]], axis=1)


class Shard:
    """Inverted files of pivots over the vectors of one shard."""

    def __init__(self, orders: np.ndarray, pivots: int):
        self.n, self.prefix = orders.shape
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.begins = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=pivots))])
        self.vector = (by_pivot // self.prefix).astype(np.int32)
        self.place = (by_pivot % self.prefix).astype(np.int16)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of one query's order to every vector; pivots beyond the prefix stand at its end."""
        lists = [slice(self.begins[p], self.begins[p + 1]) for p in order.tolist()]
        vector = np.concatenate([self.vector[x] for x in lists])
        place = np.repeat(np.arange(len(lists), dtype=np.int16), [x.stop - x.start for x in lists])
        gained = self.prefix - np.maximum(np.concatenate([self.place[x] for x in lists]), place)
        return self.prefix * (self.prefix + 1) - 2 * np.bincount(vector, gained, self.n).astype(np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = raw.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for each query."""
    spark = vectors.sparkSession
    src = _usable(vectors, id_col, vector_col)
    sizes = src.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("m"), F.sum((F.col("id") % every == 0).cast("long")).alias("q"))
    found = sizes.orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not found:
        return spark.createDataFrame([], schema)
    dim, n, largest, asked = found[0]["d"], found[0]["n"], found[0]["m"], found[0]["q"]
    src = src.filter(F.size("v") == dim).select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    sample = src.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, math.ceil(4 * math.sqrt(n))))).collect()
    share = min(1.0, (rerank or RERANK * math.sqrt(n)) / n)
    pivots = spark.sparkContext.broadcast(_lift(np.array([r["v"] for r in sample]), largest))  # PIVOTS vectors at most
    count, prefix = len(sample), min(PREFIX, len(sample))
    shards, blocks = -(-n // SHARD), max(1, -(-asked // BLOCK))

    # Equal vectors: the k + 1 smallest ids, first within slices of a group, then over them.
    part = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(16))).orderBy("id")
    whole = Window.partitionBy("v").orderBy("id")
    few = src.distinct().withColumn("r", F.row_number().over(part)).filter(F.col("r") <= k + 1).withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= k + 1)
    entries = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = entries.select("ids", "v", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("int").alias("block"))
    queries = src.filter(F.col("id") % every == 0).distinct().select(F.array("id").alias("ids"), "v", F.lit(None).cast("int").alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))

    def represent(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            is_query = np.array(batch.column(3).is_valid())
            lifted = _lift(x, largest)
            lifted[is_query, -1] = 0
            orders = _orders(lifted, pivots.value, prefix)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in orders], pa.binary()), batch.column(2), batch.column(3)], ["ids", "x", "o", "shard", "block"])

    rows = entries.unionByName(queries).mapInArrow(represent, "ids array<long>, x binary, o binary, shard int, block int")
    pairs = rows.withColumn("to", F.explode(F.when(F.col("block").isNull(), F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(F.sequence(F.lit(0), F.lit(shards - 1)))))
    pairs = pairs.select("ids", "x", "o", F.coalesce("shard", "to").alias("shard"), F.coalesce("block", "to").alias("blk"), F.col("block").isNotNull().alias("query"))

    def search(t: pa.Table) -> pa.Table:
        asks, held = t.filter(t["query"]), t.filter(pa.compute.invert(t["query"]))
        out: list[tuple[int, int, float]] = []
        if asks.num_rows and held.num_rows:
            x, ids = _matrix(held["x"], "<f8"), held["ids"].to_pylist()
            order = np.argsort(np.array([i[0] for i in ids]), kind="stable")  # ties in footrule go to small ids
            x, ids = x[order], [ids[i] for i in order]
            shard = Shard(_matrix(held["o"], "<i2")[order], count)
            take = min(len(ids), max(k + 1, math.ceil(share * len(ids))))
            tie = np.arange(len(ids))
            for own, q, o in zip(asks["ids"].to_pylist(), _matrix(asks["x"], "<f8"), _matrix(asks["o"], "<i2"), strict=True):
                near = np.argpartition(shard.footrule(o[:PROBE]) * len(ids) + tie, take - 1)[:take]
                score = (x[near] * q).sum(1)
                keep = min(len(near), k + 1)
                least = np.partition(score, len(score) - keep)[len(score) - keep]
                best = np.flatnonzero(score >= least)
                flat = sorted((-s, i) for s, e in zip(score[best].tolist(), near[best].tolist(), strict=True) for i in ids[e] if i != own[0])
                out += [(own[0], i, -s) for s, i in flat[:k]]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    got = pairs.groupBy("shard", "blk").applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
