"""Exact top-k inner-product search by columnar branch and bound.

Vectors lie in vertical layout: a matrix row for each dimension, candidates in the order of their length (norm), the longest
first. Each query is answered for itself. The first block of candidates, a small one, gives it a k-th best score.
From then on scores of a block are accumulated dimension block by dimension block; before each, a candidate stays only if its
score so far plus the most that the remaining dimensions can add (the product of the remaining masses, by Cauchy and Schwarz)
reaches that k-th best score. Survivors close up into smaller matrices. Where not even whole lengths can reach it, all
later, shorter candidates are left out at once.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantalog.llm.shared import written

#: Bytes (8 for a component) of one side that a task holds: cells are cut so that this is the expected size.
CANDIDATE_BYTES, QUERY_BYTES = 32 << 20, 4 << 20
#: Dimensions of a block, candidates of the first block and of the largest one (blocks double as bounds tighten), queries answered at a
#: time: a candidate goes only when none of these can use it, so one at a time saves most.
STEP, FIRST_BLOCK, BLOCK, TOGETHER = 8, 64, 4096, 1


def best(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, work: Counter | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of each query's k best among the vectors of other rows; ties to smaller ids. Whole numbers, exactly.

    queries and vectors: a column for each vector, dimensions in rows. query_rows and rows: numbers of the table's rows. work
    gets how many products of components there were (done) and how many the bounds saved (saved).
    """
    size = float(max(np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0)))
    if size * size * max(1, len(queries)) < 1 << 53:
        kind = np.float32 if size * size * max(1, len(queries)) < 1 << 24 else np.float64
    else:
        kind = object  # Python's integers
    work = Counter() if work is None else work
    mass = lambda m: np.sqrt(np.cumsum(m[::-1].astype(np.float64) ** 2, 0)[::-1])
    turn = np.argsort(-(queries.astype(np.float64) ** 2).sum(1), kind="stable")  # heavy dimensions first
    long = np.argsort(-(vectors.astype(np.float64) ** 2).sum(0), kind="stable")
    q, v, rows, ids = queries[turn], vectors[turn][:, long], rows[long], ids[long]
    q_mass, v_mass = mass(q), mass(v)
    q, v = q.astype(kind), v.astype(kind)
    dims, number = v.shape
    found = []
    for first in range(0, q.shape[1], TOGETHER):
        mine = slice(first, first + TOGETHER)
        few, own, left = q[:, mine], query_rows[mine], q_mass[:, mine]
        n = few.shape[1]
        top_score, top_id = np.full((n, 0), 0, object if kind is object else np.int64), np.full((n, 0), 0, np.int64)
        low, high = 0, min(number, FIRST_BLOCK)
        while low < number:
            here, score = np.arange(low, high), np.zeros((n, high - low), kind)
            full = top_score.shape[1] >= k
            least = top_score[:, k - 1].astype(np.float64) if full else np.full(n, -np.inf)
            edge = least - 1e-6 * np.abs(least) - 1 if full else least
            if dims and full and (left[0] * v_mass[0, low] < edge).all():
                work["saved"] += n * dims * (number - low)
                break
            for d in range(0, dims, STEP):
                if full and d:
                    stay = (score.astype(np.float64) + left[d][:, None] * v_mass[d, here] >= edge[:, None]).any(0)
                    work["saved"] += n * (dims - d) * int((~stay).sum())
                    here, score = here[stay], score[:, stay]
                    if not len(here):
                        break
                score = score + few[d : d + STEP].T @ v[d : d + STEP, here]
                work["done"] += n * len(here) * len(few[d : d + STEP])
            if len(here):
                whole = score if kind is object else np.rint(score).astype(np.int64)
                scores, names = np.concatenate([top_score, whole], 1), np.concatenate([top_id, np.broadcast_to(ids[here], whole.shape)], 1)
                gone = np.concatenate([np.zeros(top_score.shape, bool), own[:, None] == rows[here]], 1)
                top_score, top_id = _first(scores, names, gone, k)
            low, high = high, min(number, high + min(BLOCK, 2 * (high - low)))
        real = top_id != GONE
        found.append((first + np.repeat(np.arange(n), real.sum(1)), top_id[real], top_score[real]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


GONE = np.iinfo(np.int64).max
LOW = -(1 << 62)  # no score; a query with fewer than k candidates has such places


def _first(scores: np.ndarray, names: np.ndarray, gone: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.where(gone, GONE, names)
    scores = np.where(gone | (names == GONE), LOW, scores)
    if scores.dtype != object and scores.shape[1] > 4 * k:  # the k-th best score bounds what can matter, ties included
        edge = -np.partition(-scores, k - 1, 1)[:, k - 1 : k]
        keep = scores >= edge
        width = int(keep.sum(1).max())
        if width < scores.shape[1]:
            order = np.argsort(~keep, 1, kind="stable")[:, :width]
            kept = np.take_along_axis(keep, order, 1)
            scores = np.where(kept, np.take_along_axis(scores, order, 1), LOW)
            names = np.where(kept, np.take_along_axis(names, order, 1), GONE)
    by_name = np.argsort(names, 1, kind="stable")
    scores, names = np.take_along_axis(scores, by_name, 1), np.take_along_axis(names, by_name, 1)
    by_score = np.argsort(-scores, 1, kind="stable")[:, :k]
    return np.take_along_axis(scores, by_score, 1), np.take_along_axis(names, by_score, 1)


def _matrix(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids and vectors of a cell, a column each."""
    flat = table.column("v").combine_chunks()
    flat = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False)
    return table.column("row").to_numpy(), table.column("id").to_numpy(), np.ascontiguousarray(flat.reshape(table.num_rows, dims).T)


def top_k(df: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id long, rank int, vec_id long, score long: for each row that `is_query` (a column) selects, the k other rows of greatest score.

    Components become floor(scale * x); the score is their inner product; ties go to the smaller id. Vectors that are null
    or hold a null or non-finite component, and rows with a null id, take no part; vectors of different length are not
    compared. Rows that repeat an id are rows of their own, as queries and as candidates. Other columns are ignored; an empty
    table gives an empty result.

    Queries and candidates meet in a grid of cells: candidates in slices of about CANDIDATE_BYTES, queries of about QUERY_BYTES,
    dealt by hash of the row, so equal vectors spread evenly. Each cell keeps k rows a query, and so the last ranking sees
    k rows for each slice of candidates.
    """
    x = F.col(vector_col)
    sound = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.where(sound).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"), F.size(x).alias("dims")
    )
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    counts = rows.agg(F.count("*").alias("n"), F.count_if("query").alias("q"), F.coalesce(F.max("dims"), F.lit(0)).alias("dims")).first()
    at_least = min(df.sparkSession.sparkContext.defaultParallelism, -(-counts.n // 1024))
    of = lambda n, most: -(-n * max(1, counts.dims) * 8 // most)
    across, down = max(1, at_least, of(counts.n, CANDIDATE_BYTES)), max(1, of(counts.q, QUERY_BYTES))
    slice_of = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = ["dims", "across", "down"]
    candidates = rows.select("row", "id", "v", "dims", slice_of(across, 1).alias("across"), every(down).alias("down"))
    queries = rows.where("query").select("row", "id", "v", "dims", every(across).alias("across"), slice_of(down, 2).alias("down"))
    fields = {"query_row": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dims = key[0].as_py()
        if not left.num_rows or not right.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in fields.items()})
        query_rows, query_ids, q = _matrix(left, dims)
        rows, ids, v = _matrix(right, dims)
        found, ids, score = best(q, query_rows, v, rows, ids, k)
        return pa.table({"query_row": pa.array(query_rows[found]), "query_id": pa.array(query_ids[found]), "vec_id": pa.array(ids), "score": pa.array(score.tolist(), pa.int64())})

    found = queries.groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInArrow(run, "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
