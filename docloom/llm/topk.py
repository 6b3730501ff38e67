"""Exact top-k search by integer inner product: columnar branch and bound.

Vectors become integers and are laid out in blocks of at most ``BLOCK`` vectors,
one row of a block for each dimension, the dimensions in one order for all
blocks: that of falling energy, so that sums settle early.

Query blocks and candidate blocks are dealt to a grid of cells, in which each
query block stands once per column and each candidate block once per row; the
number of rows and columns is that which moves least.  The first column's cells
are worked off first: they give every query a floor, its k-th best score so far,
with which it goes into all other cells.  A task keeps the best k of a query
block over all blocks of a cell and emits only what reaches the floor, so that
what is shuffled for a query hardly grows with the number of cells.

For a pair of blocks the sums grow dimension group by dimension group.  After
each group a candidate can gain at most |rest of query| * |rest of candidate|
(Cauchy-Schwarz); where that leaves a query or a candidate without any pair that
can reach its floor, both matrices are compacted, and once few pairs are left
they are finished one by one.  Sums are exact: in doubles while all stay under
2 ** 53, in Python integers beyond.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

BLOCK = 1024
QUERY_BLOCK = 512
GROUP = 16  # dimensions between two looks at the bounds
#: Shares of live pairs under which they are finished one by one, and of live rows or columns under which matrices are compacted.
SPARSE, DENSE = 0.02, 0.75


def integers(rows: list, scale: float = 256.0) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector in doubles; None for one that is null or holds null or non-finite components."""
    out: list[np.ndarray | None] = []
    for v in rows:
        x = None if v is None or any(c is None for c in v) else np.floor(np.asarray(v, np.float64) * scale)
        out.append(x if x is not None and np.isfinite(x).all() else None)
    return out


def _blocks(size: int):
    def run(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            by_dim: dict[int, list[int]] = {}
            got = integers(batch.column("embedding").to_pylist())
            for i, x in enumerate(got):
                if x is not None and ids[i] is not None:
                    by_dim.setdefault(len(x), []).append(i)
            for dim, places in by_dim.items():
                for at in range(0, len(places), size):
                    part = places[at : at + size]
                    matrix = np.stack([got[i] for i in part], axis=1) if dim else np.zeros((0, len(part)))
                    yield pa.RecordBatch.from_pydict({
                        "block": [(task << 32) + n], "dim": [dim], "ids": [np.array([ids[i] for i in part], "<i8").tobytes()],
                        "kind": [(kind := _kind(matrix))], "matrix": [matrix.astype(kind).tobytes()], "energy": [(matrix * matrix).sum(axis=1).tolist()],
                    }, schema=_BLOCK_SCHEMA)
                    n += 1

    return run


def _kind(matrix: np.ndarray) -> str:
    """The smallest type that holds a matrix of whole numbers."""
    top = np.abs(matrix).max(initial=0.0)
    return "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"


_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("kind", pa.string()), ("matrix", pa.binary()), ("energy", pa.list_(pa.float64()))])
_BLOCK_DDL = "block long, dim int, ids binary, kind string, matrix binary, energy array<double>"


def pair_scores(query: np.ndarray, data: np.ndarray, floor: np.ndarray, order: np.ndarray, work: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) for all pairs that can reach the floors; matrices hold a row for each dimension.

    ``work`` gets the number of products made and of those that there are.
    """
    dims, rows, cols = len(order), np.arange(query.shape[1]), np.arange(data.shape[1])
    query, data = query[order], data[order]
    rest = lambda m: np.sqrt(np.vstack((np.cumsum((m * m)[::-1], axis=0)[::-1], np.zeros(m.shape[1]))))
    rest_q, rest_d = rest(query), rest(data)
    sums, at, made = np.zeros((len(rows), len(cols))), 0, 0
    while at < dims:
        end = min(dims, at + GROUP)
        sums += query[at:end].T @ data[at:end]
        made += sums.size * (end - at)
        at = end
        if at == dims:
            break
        alive = sums + np.outer(rest_q[at], rest_d[at]) * (1 + 1e-9) >= floor[:, None]
        if alive.mean() <= SPARSE:
            break
        r, c = alive.any(axis=1), alive.any(axis=0)
        if min(r.mean(), c.mean()) < DENSE:
            rows, cols, floor, sums = rows[r], cols[c], floor[r], sums[np.ix_(r, c)]
            query, rest_q, data, rest_d = query[:, r], rest_q[:, r], data[:, c], rest_d[:, c]
    who, cand = np.nonzero(alive if at < dims else sums >= floor[:, None])
    sums = sums[who, cand]
    while at < dims:
        end = min(dims, at + GROUP)
        sums = sums + (query[at:end, who] * data[at:end, cand]).sum(axis=0)
        made += len(who) * (end - at)
        at = end
        keep = sums + rest_q[at, who] * rest_d[at, cand] * (1 + 1e-9) >= floor[who]
        who, cand, sums = who[keep], cand[keep], sums[keep]
    if work is not None:
        work += [made, len(rest_q) and dims * query.shape[1] * data.shape[1]]
    return rows[who], cols[cand], sums


def _exact_scores(query: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs in Python integers, for components too large for doubles."""
    q, d = (np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (query, data))
    scores = q.T.dot(d) if len(q) else np.zeros((query.shape[1], data.shape[1]), dtype=object)
    who, cand = np.indices(scores.shape).reshape(2, -1)
    return who, cand, np.clip(scores[who, cand], -(2**63), 2**63 - 1)


def _best(k: int, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places of each query's k best, in order."""
    order = np.lexsort((ids, ~scores, who))  # ~ falls where the score rises, and never overflows
    who = who[order]
    return order[np.arange(len(who)) - np.searchsorted(who, who, "left") < k]


def _search(k: int, order_of: dict[int, list[int]]):
    """The best of each query block in each cell; a cell's rows of one query block follow each other."""
    none = np.empty(0, np.int64)

    def run(batches):
        now, ids, best = None, none, (none, none, none)

        def found():
            who, cand, scores = best
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(who), -1 if now is None else now[0])), pa.array(who.astype(np.int32)), pa.array(ids[who]), pa.array(cand), pa.array(scores)],
                names=["q_block", "place", "query_id", "vec_id", "score"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                if (row["q_block"], row["r"], row["c"]) != now:
                    yield found()
                    now, best = (row["q_block"], row["r"], row["c"]), (none, none, none)
                    ids = np.frombuffer(row["q_ids"], "<i8")
                    query = np.frombuffer(row["q_matrix"], row["q_kind"]).reshape(dim, len(ids)).astype(np.float64)
                    start = np.full(len(ids), -np.inf)
                    for f in row["floors"] or ():
                        start[f["place"]] = f["floor"]
                data_ids = np.frombuffer(row["ids"], "<i8")
                data = np.frombuffer(row["matrix"], row["kind"]).reshape(dim, len(data_ids)).astype(np.float64)
                top = (np.abs(query).max(initial=0.0) * np.abs(data).max(initial=0.0)) * max(dim, 1)
                if top < 2.0**52:
                    floor = start.copy()
                    many = np.bincount(best[0], minlength=len(ids))
                    last = np.cumsum(many) - 1
                    full = many == k
                    floor[full] = np.maximum(floor[full], best[2][last[full]])
                    who, cand, scores = pair_scores(query, data, floor, np.array(order_of[dim], np.int64))
                else:
                    who, cand, scores = _exact_scores(query, data)
                other = data_ids[cand] != ids[who]
                who, cand, scores = (np.concatenate((b, x[other].astype(np.int64))) for b, x in zip(best, (who, data_ids[cand], scores)))
                keep = _best(k, who, cand, scores)
                best = who[keep], cand[keep], scores[keep]
        yield found()

    return run


def search(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores, ties to the smaller vec_id.

    ``vectors`` is (vec_id, embedding); ``is_query`` is the condition on vec_id
    that makes a row a query.  Candidates are all rows of the query's length but
    those of its own vec_id; rows that repeat a vec_id each count.  Null vectors
    and ids, and vectors with null or non-finite components, take no part.  Scores
    beyond a long are the nearest long, also for the order.  An empty table gives an empty one;
    other columns play no part.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    data = scratch.save(base.mapInArrow(_blocks(BLOCK), _BLOCK_DDL))
    queries = scratch.save(base.where(is_query).mapInArrow(_blocks(QUERY_BLOCK), _BLOCK_DDL))
    # energy by dimension, a row for each length of vector and dimension
    energy = data.select("dim", F.posexplode("energy").alias("d", "e")).groupBy("dim", "d").agg(F.sum("e").alias("e")).collect()
    order_of: dict[int, list[int]] = {0: []}
    for r in sorted(energy, key=lambda r: (r["dim"], -r["e"], r["d"])):
        order_of.setdefault(r["dim"], []).append(r["d"])
    rows, columns = grid(queries.count(), data.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    all_ = lambda low, n: F.explode(F.sequence(F.lit(low), F.lit(n - 1)))
    right = data.select("dim", "ids", "kind", "matrix", dealt(columns).alias("c"), all_(0, rows).alias("r"))
    left = queries.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("matrix").alias("q_matrix"), dealt(rows).alias("r"))

    def cells(left: DataFrame) -> DataFrame:
        # never by broadcast: queries grow with the data; a merge join buffers the candidates of one cell and streams the queries
        met = left.hint("merge").join(right, ["dim", "r", "c"])
        return met.mapInArrow(_search(k, order_of), "q_block long, place int, query_id long, vec_id long, score long")

    none = F.array().cast("array<struct<place:int,floor:bigint>>").alias("floors")
    found = scratch.save(cells(left.select("*", F.lit(0).alias("c"), none)))
    if columns > 1:
        floors = found.groupBy("q_block", "place").agg(F.min("score").alias("floor"), F.count("*").alias("m")).where(F.col("m") == k)
        floors = floors.groupBy("q_block").agg(F.collect_list(F.struct("place", "floor")).alias("floors"))  # a block's places
        found = found.union(cells(left.join(floors, "q_block", "left").select(*left.columns, all_(1, columns).alias("c"), "floors")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def grid(queries: int, candidates: int, cells: int) -> tuple[int, int]:
    """Rows and columns of about ``cells`` cells; queries * columns + candidates * rows blocks move, which is least where both are alike."""
    rows = max(1, min(queries, cells, round(math.sqrt(cells * queries / max(1, candidates)))))
    return rows, max(1, min(candidates, cells // rows))
