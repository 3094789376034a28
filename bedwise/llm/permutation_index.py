"""Approximate nearest neighbours by a permutation index: pivots, inverted files of positions, footrule, rerank.

Pivots are chosen from a bounded sample, each far from those before it. A vector is represented by the order of all
pivots by inner product. Its position in the inverted file of a pivot is the pivot's place in that order, so a block of
vectors holds one posting list of positions per pivot. A query reads the lists of its nearest pivots only and adds up
|its place - the vector's place| (Spearman's footrule over those pivots). The nearest sixteenth of every block by that
distance is reranked by the true inner product.

Equal vectors are one class that carries its smallest ids, as many as an answer can use, so a vector that a third of all
rows repeat costs one entry. Classes are dealt into blocks of equal size by hash. Queries meet blocks of vectors in blocks
of queries: a task holds BLOCK of both, and each pair of blocks sends the best of its vectors only.

Defined results. Vectors that are null, empty, zero or hold null or non-finite numbers, and rows without an id, take no part.
An id names one vector: of several different ones under one id the one with the smaller hash counts, equal rows count once.
Vectors of different length never meet. Ties in score go to the smaller id; footrule ties at the cut are all reranked.
Scores add up products in the order of the components, in doubles. No query or no vector: an empty result. Other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedwise.llm.common import cut

PIVOTS = 256
SAMPLE = 4096
LISTS = 64
BLOCK = 1 << 14
RERANK, LEAST = 16, 256


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, e, h1, h2): the rows that take part, with a hash of 128 bits of the vector."""
    e = F.col("embedding")
    fine = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(e, lambda x: x != 0)
    return rows.where(fine & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"), F.xxhash64(e).alias("h1"), F.xxhash64(F.lit(1), e).alias("h2"))


def names(rows: DataFrame) -> DataFrame:
    """(vec_id, h1, h2): one class for every id."""
    return rows.groupBy("vec_id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("vec_id", "h.h1", "h.h2")


def classes(rows: DataFrame, ids: DataFrame, top: int, every: int) -> DataFrame:
    """(h1, h2, e, ids, asked): distinct vectors with their top + 1 smallest ids; asked if an id is a multiple of ``every``.

    The limit by rank is applied before the shuffle as well, so a hot class sends no more ids than that from each task.
    """
    first = ids.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("r") <= top + 1)
    listed = first.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = ids.groupBy("h1", "h2").agg(F.bool_or(F.pmod("vec_id", F.lit(every)) == 0).alias("asked"))
    vectors = rows.groupBy("h1", "h2").agg(F.first("e").alias("e"))
    return vectors.join(listed, ["h1", "h2"]).join(asked, ["h1", "h2"]).withColumn("dim", F.size("e"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def choose_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Pivots in turn, each the vector least similar to those chosen before it."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(count, len(vectors)):
        far = int(np.argmin(nearest))
        chosen.append(far)
        nearest = np.maximum(nearest, unit @ unit[far])
    return vectors[chosen]


def fit_pivots(vectors: DataFrame, count: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots for every vector length, from a sample of about SAMPLE vectors that their hash picks."""
    sizes = {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}
    out = {}
    for dim, n in sorted(sizes.items()):
        some = vectors.where(F.col("dim") == dim)
        if n > SAMPLE:
            some = some.where(F.pmod("h2", F.lit(1 << 40)) < int((1 << 40) * SAMPLE / n))
        table = some.select("h1", "h2", "e").toArrow().sort_by([("h1", "ascending"), ("h2", "ascending")])
        if table.num_rows:
            out[dim] = choose_pivots(matrix(table["e"]), count)
    return out


def places(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One row per vector: the place of every pivot in the vector's order; equal products go to the earlier pivot."""
    order = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")
    out = np.empty(order.shape, np.uint8)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.uint8)[None], 1)
    return out


def build_index(vectors: DataFrame, pivots: dict[int, np.ndarray], block: int = BLOCK) -> DataFrame:
    """(dim, block, ids, vectors, postings): one row for a block of vectors.

    ``postings`` holds, pivot after pivot, one byte per vector: the place of the pivot in the vector's order.
    """
    if len(next(iter(pivots.values()), ())) > 256:
        raise ValueError("a place is one byte: at most 256 pivots")
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors of each length

    def run(key, table):
        v = matrix(table["e"])
        lists = np.ascontiguousarray(places(v, shared.value[key[0].as_py()]).T)
        ids = table["ids"].combine_chunks()
        return pa.table({
            "dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            "vectors": pa.array([v.tobytes()], pa.binary()), "postings": pa.array([lists.tobytes()], pa.binary()),
        })

    return dealt(vectors, block).groupBy("dim", "block").applyInArrow(run, "dim int, block int, ids array<array<long>>, vectors binary, postings binary")


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` with a block number: as many blocks for each vector length as blocks of that size are needed."""
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / block).alias("blocks"))
    return rows.join(sizes, "dim").withColumn("block", F.pmod("h1", "blocks").cast("int")).drop("blocks")


def best(scores: np.ndarray, first: np.ndarray, ids: list, count: int) -> list[tuple[float, int]]:
    """The ``count`` largest (score, id) of classes with these scores and lists of ids, ties to the smaller id."""
    if len(scores) > count:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[len(scores) - count])
    else:
        keep = np.arange(len(scores))
    pairs = [(-scores[k], i) for k in keep.tolist() for i in ids[first[k]]]
    return [(-s, i) for s, i in sorted(pairs)[:count]]


def search(index: DataFrame, queries: DataFrame, pivots: dict[int, np.ndarray], top: int = 20, lists: int = LISTS, block: int = BLOCK) -> DataFrame:
    """(h1, h2, found array<struct<score, vec_id>>) for every query (h1, h2, e, dim): its top + 1 best, best first."""
    shared = queries.sparkSession.sparkContext.broadcast(pivots)

    def run(key, stored, asked):
        out = []
        if stored.num_rows and asked.num_rows:
            ids = stored["ids"][0].as_py()
            n = len(ids)
            v = np.ascontiguousarray(np.frombuffer(stored["vectors"][0].as_py(), np.float64).reshape(n, -1).T)
            postings = np.frombuffer(stored["postings"][0].as_py(), np.uint8).reshape(-1, n)
            q = matrix(asked["e"])
            order = np.argsort(-(q @ shared.value[key[0].as_py()].T), axis=1, kind="stable")[:, :lists]
            keep = min(n, max(LEAST, n // RERANK))
            for x, near in zip(q, order):
                distance = np.zeros(n, np.uint16)
                for place, pivot in enumerate(near.tolist()):
                    there = postings[pivot]
                    distance += np.maximum(there, np.uint8(place)) - np.minimum(there, np.uint8(place))
                some = np.flatnonzero(distance <= np.partition(distance, keep - 1)[keep - 1])
                score = np.zeros(len(some))
                for d in range(len(x)):
                    score += v[d, some] * x[d]
                out.append([{"score": s, "vec_id": i} for s, i in best(score, some, ids, top + 1)])
        return pa.table({
            "h1": asked["h1"] if out else pa.array([], pa.int64()), "h2": asked["h2"] if out else pa.array([], pa.int64()),
            "found": pa.array(out, pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))),
        })

    # Every block of vectors meets every block of queries once.
    sizes = index.groupBy("dim").agg(F.count("*").cast("int").alias("blocks"))
    chunks = queries.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    asked = queries.join(sizes, "dim").join(chunks, "dim").withColumn("chunk", F.pmod("h1", "chunks").cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("dim", "block", "chunk", "h1", "h2", "e")
    stored = index.join(chunks, "dim").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    keys = ["dim", "block", "chunk"]
    parts = stored.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "h1 long, h2 long, found array<struct<score:double,vec_id:long>>")
    # At most top + 1 entries from each block.
    each = parts.select("h1", "h2", F.inline("found"))
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id"))
    kept = each.withColumn("r", rank).where(F.col("r") <= top + 1)
    return kept.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("r", "score", "vec_id"))).alias("found"))


def nearest(rows: DataFrame, top: int = 20, every: int = 20, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of every id divisible by ``every``, itself excepted."""
    some = usable(rows)
    ids = cut(names(some), "names")
    vectors = cut(classes(some, ids, top, every), "classes")
    chosen = fit_pivots(vectors, pivots)
    index = cut(build_index(vectors, chosen), "index")
    found = search(index, vectors.where("asked").select("h1", "h2", "e", "dim"), chosen, top)
    asking = ids.where(F.pmod("vec_id", F.lit(every)) == 0).withColumnRenamed("vec_id", "query_id")
    mine = asking.join(found, ["h1", "h2"]).select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, top).alias("f"))
    return mine.select("query_id", F.posexplode("f").alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def recall(found: DataFrame, rows: DataFrame, share: int = 1) -> float:
    """Share of the true nearest neighbours among those found, over the queries whose hash is a multiple of ``share``.

    Brute force: the chosen queries are scored against all rows; for measuring, on tables where that can be afforded.
    """
    some = usable(rows).dropDuplicates(["vec_id"])
    wanted = found.where(F.pmod(F.xxhash64("query_id"), F.lit(share)) == 0)
    top = int(wanted.agg(F.max("rank")).first()[0])
    asked = some.join(wanted.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id").toArrow()
    q, q_ids = matrix(asked["e"]), asked["vec_id"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast((q, q_ids))

    def run(batches):
        for batch in batches:
            v, ids = matrix(pa.chunked_array([batch.column(1)])), batch.column(0).to_numpy()
            s = shared.value[0] @ v.T
            s[shared.value[1][:, None] == ids[None]] = -np.inf
            at = np.argsort(-s, axis=1, kind="stable")[:, :top]
            n = at.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(shared.value[1], n)), pa.array(ids[at].ravel()), pa.array(np.take_along_axis(s, at, 1).ravel())], ["query_id", "vec_id", "s"])

    near = some.select("vec_id", "e").mapInArrow(run, "query_id long, vec_id long, s double").where("s > double('-Infinity')")
    true = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id"))).where(F.col("r") <= top)
    got = true.join(wanted.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()
    return float(got[0])
