"""Exact top-k search by vector-approximation files.

Vectors are taken as integers floor(scale * x). Their approximation file is written once: for each vector a byte a component, the
number of its cell of `step` integers (CELL, or more where a vector's components need it), and behind it the exact vector. A scan
of the cells bounds each score from above and below (the middle of the cells, give or take half a cell times the query's L1
norm). Vectors whose upper bound is below the kth score known so far, or the kth lower bound, are out; of the rest the exact
vectors are read in the order of their bounds until the kth score is above all bounds that follow. Each partition gives its best
k of each query, and a grouped step keeps the best k of all.

Queries are a stated set of the rows, read from the file in blocks of bounded size that are taken one by one against all rows, so
neither side goes to one task or the driver whole. Equal vectors of a batch are written up to the k + 1 least of theirs, as no other
can be in a result, and those that are queries.

Null vectors, and vectors that hold null or non-finite components, take no part; all others do, those without components among them.
Vectors of another length than the query's don't meet it. Scores are exact whatever the components: rows and queries with components
of LARGEST and more are left out of the approximation and computed as integers, in 64 bits where a bound of the sum allows it. A
score in a result that doesn't fit a long is an error. Rows are told apart by their numbers in the file and not by their ids: of rows
that repeat an id each is a query, and meets the others; query_row tells their results apart. Ties go to the smaller id, null ids
last. Empty tables give no rows. Other columns have no part in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.session import scratch

#: Queries that a task holds at once.
QUERY_BLOCK = 4096
#: Vectors whose approximation is scanned at once, and queries that meet them at once.
SCAN, QUERIES = 8192, 512
#: Integers in a cell, at least.
CELL = 4
#: Integer components from here on have no part in the approximation: products of 2^17 smaller ones are exact in 64 bits.
LARGEST = 1 << 23
#: What stands for a score beyond a long.
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def taking_part(df: DataFrame, asked: Column, key: str, vector: str) -> DataFrame:
    """(id, vec, asked): the vectors that take part, as doubles, and whether they are queries."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.col(vector).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(fine).select(F.col(key).cast("bigint").alias("id"), v.alias("vec"), F.coalesce(asked, F.lit(False)).alias("asked"))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: in 64 bits, or as integers of any size."""
    scaled = x * scale if np.abs(x).max(initial=0) < 1e300 else None
    if scaled is not None and np.abs(scaled).max(initial=0) < 2.0**62:
        return np.floor(scaled).astype(np.int64)
    whole = [math.floor(v * scale) if abs(v) < 1e300 else int(v) * scale for v in x.ravel().tolist()]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(x.shape)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of queries (rows) and vectors (columns), those beyond a long as _LOW or _HIGH."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    most = int(np.abs(queries).max()) * int(np.abs(vectors).max()) * queries.shape[1]
    if most < 1 << 62:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.array([[min(max(v, _LOW), _HIGH) for v in row] for row in exact.tolist()], np.int64)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), width)


def quantised(vectors: np.ndarray, cell: int = CELL) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each component as a byte, integers in a cell of each vector)."""
    step = np.maximum(cell, (np.abs(vectors).max(axis=1, initial=0) + 1 + 126) // 127)
    return (vectors // step[:, None]).astype(np.int8), step.astype(np.int32)


def least_of_equals(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Which rows to keep: of equal vectors the k + 1 of the least ids."""
    raw = np.ascontiguousarray(vectors).view(np.uint8).reshape(len(vectors), -1)
    codes = np.unique(raw.view(f"V{raw.shape[1]}").ravel(), return_inverse=True)[1] if raw.size else np.zeros(len(ids), np.int64)
    order = np.lexsort((ids, codes))
    starts = np.flatnonzero(np.concatenate([[True], codes[order][1:] != codes[order][:-1]]))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    keep = np.zeros(len(ids), bool)
    keep[order[place <= k]] = True
    return keep


def approximation_file(base: DataFrame, k: int, scale: int, cell: int = CELL) -> DataFrame:
    """(row, id, width, step, cells, exact, asked, meets) of the vectors, written in the shared folder. Where step is 0 there are no
    cells, and exact holds the doubles; else it holds the integers. A negative row is one of a null id. Rows that don't meet queries are
    queries alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pa.compute.list_value_length(batch.column("vec")))
            null = np.asarray(batch.column("id").is_null())
            ids = np.asarray(batch.column("id").fill_null(_HIGH), np.int64)
            rows, asked = np.asarray(batch.column("row"), np.int64), np.asarray(batch.column("asked").to_numpy(zero_copy_only=False), bool)
            rows = np.where(null, -rows - 1, rows)
            for width in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == width)
                doubles = matrix(batch.column("vec").take(pa.array(at)), width)
                meets = least_of_equals(ids[at], doubles, k)
                keep = meets | asked[at]
                at, doubles, meets = at[keep], doubles[keep], meets[keep]
                small = (np.abs(doubles) * scale < LARGEST).all(axis=1) if width else np.ones(len(at), bool)
                for part in (np.flatnonzero(small), np.flatnonzero(~small)):
                    if not len(part):
                        continue
                    if small[part[0]]:
                        whole = integers(doubles[part], scale)
                        cells, step = quantised(whole, cell)
                        cells, exact = [c.tobytes() for c in cells], [v.tobytes() for v in whole.astype("<i4")]
                    else:
                        cells, step, exact = [b""] * len(part), np.zeros(len(part), np.int32), [v.tobytes() for v in doubles[part]]
                    own = at[part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[own]), pa.array(ids[own]), pa.array([width] * len(own), pa.int32()), pa.array(step), pa.array(cells, pa.binary()), pa.array(exact, pa.binary()), pa.array(asked[own]), pa.array(meets[part])],
                        names=["row", "id", "width", "step", "cells", "exact", "asked", "meets"],
                    )

    path = scratch(base.sparkSession, "vectors")
    schema = "row bigint, id bigint, width int, step int, cells binary, exact binary, asked boolean, meets boolean"
    base.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema).write.parquet(path)
    return base.sparkSession.read.schema(schema).parquet(path)


def unpacked(exact: list[bytes], large: bool, width: int, scale: int) -> np.ndarray:
    """The integers of rows of the file, all with cells or all without."""
    if large:
        return integers(np.frombuffer(b"".join(exact), np.float64).reshape(len(exact), width), scale)
    return np.frombuffer(b"".join(exact), "<i4").reshape(len(exact), width).astype(np.int64)


class Best:
    """The best k scores of each query so far, of queries of one length that all are small, or all large."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, k: int, large: bool, scale: int):
        self.queries, self.rows, self.k, self.large, self.scale = queries, rows, k, large, scale
        if not large:
            self.norm, self.total = np.abs(queries).sum(axis=1), queries.sum(axis=1)
            self.largest = int(np.abs(queries).max(initial=0))
        self.found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 3] * len(queries)  # scores, ids, rows
        self.kth = np.full(len(queries), -np.inf)

    def _keep(self, q: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        whole = [np.concatenate(x) for x in zip(self.found[q], (scores, ids, rows), strict=True)]
        order = np.lexsort((whole[2], whole[1], ~whole[0]))[: self.k]  # ~x falls as x rises, and can't overflow
        self.found[q] = tuple(x[order] for x in whole)
        if len(order) == self.k:
            self.kth[q] = float(self.found[q][0][-1])

    def add_all(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        """Exact scores of all vectors: where they, or the queries, are too large for the approximation."""
        for a in range(0, len(self.queries), QUERIES):
            scores = products(self.queries[a : a + QUERIES], vectors)
            for q in range(len(scores)):
                others = np.flatnonzero(rows != self.rows[a + q])
                if len(others) > 4 * self.k:
                    kth = np.partition(scores[q, others], len(others) - self.k)[len(others) - self.k]
                    others = others[scores[q, others] >= kth]
                self._keep(a + q, scores[q, others], ids[others], rows[others])

    def add(self, ids: np.ndarray, rows: np.ndarray, step: np.ndarray, cells: np.ndarray, exact: pa.Array) -> None:
        """A slice of the file: `exact` is read for the vectors that the bounds leave alone."""
        width = cells.shape[1]
        limit = float(self.largest) * 128 * float(step.max(initial=1)) * width
        kind = np.float32 if limit < 2**22 else np.float64
        half = (step - 1) / 2
        if len(step) and (step == step[0]).all():  # most often: then a query's slack is one number
            step, half = step[:1], half[:1]
        step, half, cells = step.astype(kind), half.astype(kind), cells.astype(kind)
        for a in range(0, len(self.queries), QUERIES):
            own = slice(a, a + QUERIES)
            near = self.queries[own].astype(kind) @ cells.T
            near *= step[None, :]
            near += (self.total[own, None] * half[None, :]).astype(kind)
            slack = (self.norm[own, None] * half[None, :] + limit * 1e-6).astype(kind)
            near[self.rows[own, None] == rows[None, :]] = -np.inf
            bound, n = self.kth[own], min(self.k, len(ids))
            if n == self.k and np.isinf(bound).any():  # nothing is read yet: the kth lower bound
                bound = np.maximum(bound, -np.partition(slack - near, n - 1, axis=1)[:, n - 1] - limit * 1e-6)
            left = near >= (bound[:, None] - slack - limit * 1e-6).astype(kind)
            for q in np.flatnonzero(left.any(axis=1)).tolist():
                at = np.flatnonzero(left[q])
                at = at[near[q, at] > -np.inf]
                if len(at):
                    self._read(a + q, at, near[q, at] + np.broadcast_to(slack[q], len(ids))[at] + limit * 1e-6, ids, rows, exact)

    def _read(self, q: int, left: np.ndarray, upper: np.ndarray, ids: np.ndarray, rows: np.ndarray, exact: pa.Array) -> None:
        """Exact scores of the vectors `left` in the order of their upper bounds, as long as they can count."""
        order = np.argsort(-upper, kind="stable")
        left, upper = left[order], upper[order]
        for at in range(0, len(left), 4 * self.k):
            if len(self.found[q][0]) >= self.k and self.kth[q] > upper[at]:
                break
            new = left[at : at + 4 * self.k]
            vectors = unpacked([exact[i].as_py() for i in new.tolist()], False, self.queries.shape[1], self.scale)
            self._keep(q, vectors @ self.queries[q], ids[new], rows[new])


def exact_top_k(vectors: DataFrame, asked: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score, query_row): the k largest integer inner products of each query with the other rows.

    vectors has the columns key and vector; its rows for which `asked` holds are the queries. They are taken block by block; each
    block is one scan of the file.
    """
    spark = vectors.sparkSession
    file = approximation_file(taking_part(vectors, asked, key, vector), k, scale)
    queries = file.where("asked").select("row", "id", "width", "step", "exact")
    count = -(-queries.count() // block)
    found = spark.createDataFrame([], "query_row bigint, query_id bigint, vec_id bigint, vec_row bigint, score bigint")
    if count:
        path = scratch(spark, "queries")
        queries.repartition(count).withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(path)
        written = spark.read.schema("row bigint, id bigint, width int, step int, exact binary, block int").parquet(path)
        for b in range(count):
            part = _scan(file.where("meets"), written.where(F.col("block") == b).drop("block").toArrow(), k, scale)
            found = found.unionByName(part if count == 1 else cut(part))  # a block's rows are written, and its queries let go
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"), F.col("vec_row"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    fits = F.when(F.col("score").isin(_LOW, _HIGH), F.raise_error(F.lit("a score doesn't fit a long")).cast("bigint")).otherwise(F.col("score"))
    named = F.when(F.col("vec_row") >= 0, F.col("vec_id"))
    return ranked.select(F.when(F.col("query_row") >= 0, F.col("query_id")).alias("query_id"), F.col("rank").cast("int").alias("rank"), named.alias("vec_id"), fits.alias("score"), "query_row")


def _scan(file: DataFrame, block: pa.Table, k: int, scale: int) -> DataFrame:
    rows, ids, widths, steps = (np.asarray(block.column(c)) for c in ("row", "id", "width", "step"))
    exact = block.column("exact").to_pylist()
    groups = {(w, large): np.flatnonzero((widths == w) & ((steps == 0) == large)) for w in np.unique(widths).tolist() for large in (False, True)}
    asked = {(w, large): (rows[at], ids[at], unpacked([exact[i] for i in at.tolist()], large, w, scale)) for (w, large), at in groups.items() if len(at)}
    shared = file.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {kind: Best(vectors, own, k, kind[1], scale) for kind, (own, _, vectors) in shared.value.items()}
        for batch in batches:
            widths, steps = np.asarray(batch.column("width")), np.asarray(batch.column("step"))
            for w in np.unique(widths).tolist():
                for large in (False, True):
                    mine = [held for (width, _), held in best.items() if width == w]
                    at = np.flatnonzero((widths == w) & ((steps == 0) == large)) if mine else []
                    for begin in range(0, len(at), SCAN):
                        part = batch.take(pa.array(at[begin : begin + SCAN]))
                        own, numbers = np.asarray(part.column("id"), np.int64), np.asarray(part.column("row"), np.int64)
                        whole = None
                        for held in mine:
                            if held.large or large or not w:
                                if whole is None:
                                    whole = unpacked(part.column("exact").to_pylist(), large, w, scale)
                                held.add_all(own, numbers, whole)
                            else:
                                cells = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.int8).reshape(-1, w)
                                held.add(own, numbers, np.asarray(part.column("step"), np.int64), cells, part.column("exact"))
        for kind, held in best.items():
            sizes = [len(s) for s, _, _ in held.found]
            numbers, own, _ = shared.value[kind]
            scores, owners, at = (np.concatenate([f[i] for f in held.found]) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, sizes)), pa.array(np.repeat(own, sizes)), pa.array(owners), pa.array(at), pa.array(scores)], names=["query_row", "query_id", "vec_id", "vec_row", "score"])

    return file.mapInArrow(run, "query_row bigint, query_id bigint, vec_id bigint, vec_row bigint, score bigint")


def sql(k: int = 20, every: int = 20, scale: int = 64) -> str:
    """The same rows over `embeddings` in DuckDB's SQL, where scores are below 2^53."""
    return f"""
WITH v AS (SELECT row_number() OVER () AS row_id, vec_id, [floor({scale} * CAST(x AS DOUBLE)) FOR x IN embedding] AS vec FROM embeddings
           WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.row_id, q.vec_id AS query_id, c.vec_id, c.row_id AS other, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
      FROM v q JOIN v c ON q.row_id <> c.row_id AND len(q.vec) = len(c.vec) WHERE q.vec_id % {every} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id NULLS LAST, other) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}
"""
