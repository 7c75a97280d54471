"""Exact top-k search by inner product over a vector-approximation file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.texts import arrow, saved
from tidemark.session import scratch_dir

SCANNED = 128
EXACT_32, EXACT_64 = 1 << 24, 1 << 53
RESULT = "query_id long, rank int, vec_id long, score long"
# Queries of a pass by length: their row numbers in order, their ids, their vectors.
Queries = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def whole_numbers(vectors: DataFrame, is_query: Column, id_column: str, vector: str, scale: int) -> DataFrame:
    """Distinct rows (row, id, v, q) of vectors that take part, written once so that ``row`` stays the same."""
    x = F.col(f"`{vector}`")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.withColumn("is a query", F.coalesce(is_query, F.lit(False)))
    rows = rows.where(F.col(f"`{id_column}`").isNotNull() & x.isNotNull() & whole)
    rows = rows.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("v"),
        F.col("`is a query`").alias("q"),
    )
    rows = rows.groupBy("id", "v").agg(F.max("q").alias("q"))
    return saved(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def approximations(rows: DataFrame, k: int, bits: int) -> DataFrame:
    """The file: each row's vector and its cells of ``bits`` bits (component = low + width * cell + less than width).

    Of equal vectors, those of the k + 1 smallest ids are enough: they score the same, ties go to
    the smaller id, and a query leaves out one of them at most. So copies of one vector are no hot group.
    """
    same = W.partitionBy("v").orderBy("id")
    held = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1)
    low, high = (F.coalesce(f("v"), F.lit(0)) for f in (F.array_min, F.array_max))
    held = held.withColumn("low", low).withColumn("width", F.shiftright(high - low, bits) + 1)
    cells = F.expr("transform(v, x -> cast((x - low) div width as short))")
    return saved(held.select("row", "id", "v", F.size("v").alias("length"), "low", "width", cells.alias("cells")), "cells")


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def by_length(batch: pa.RecordBatch, lengths: np.ndarray, known: Queries) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each length that some query has."""
    for length in np.unique(lengths).tolist():
        if length in known:
            yield length, batch.take(pa.array(np.flatnonzero(lengths == length)))


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds from below and above of every query's score with every vector, from cells alone."""
    size = np.abs(queries).sum(axis=1, dtype=np.float64)
    kind = np.float32 if size.max(initial=0) * max(1, cells.max(initial=0)) < EXACT_32 else np.float64
    inner = (queries.astype(kind) @ cells.T.astype(kind)).astype(np.float64)
    base = queries.sum(axis=1, dtype=np.float64)[:, None] * low + inner * width
    reach = size[:, None] * (np.abs(low) + width * (1.0 + cells.max(initial=0)))
    slack = np.where(reach < EXACT_64, 0, 1e-9 * reach)
    over = np.maximum(queries, 0).sum(axis=1, dtype=np.float64)[:, None] * (width - 1)
    under = np.minimum(queries, 0).sum(axis=1, dtype=np.float64)[:, None] * (width - 1)
    return base + under - slack, base + over + slack


def scan(sent: Broadcast, k: int, block: int) -> Callable:
    """Pairs (query, row, lower, upper) that may be among the k best, by the k best lower bounds seen so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Queries = sent.value
        best = {length: np.full((len(q[0]), k), -np.inf) for length, q in known.items()}
        for whole in batches:
            for start in range(0, len(whole), block):
                batch = whole.slice(start, block)
                for length, part in by_length(batch, batch.column("length").to_numpy(), known):
                    numbers, _, queries = known[length]
                    row, low, width = (part.column(c).to_numpy() for c in ("row", "low", "width"))
                    cells = matrix(part.column("cells"), length)
                    own = np.minimum(np.searchsorted(numbers, row), len(numbers) - 1)
                    own_at = np.flatnonzero(numbers[own] == row)
                    for a in range(0, len(queries), SCANNED):
                        lower, upper = bounds(queries[a : a + SCANNED], cells, low, width)
                        mine = own_at[(own[own_at] >= a) & (own[own_at] < a + SCANNED)]
                        lower[own[mine] - a, mine] = upper[own[mine] - a, mine] = -np.inf
                        seen = best[length][a : a + SCANNED]
                        better = np.flatnonzero((lower > seen.min(axis=1)[:, None]).any(axis=1))
                        if len(better):
                            both = np.concatenate([seen[better], lower[better]], axis=1)
                            seen[better] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                        i, j = np.nonzero((upper >= seen.min(axis=1)[:, None]) & (upper > -np.inf))
                        found = [numbers[a + i], row[j], lower[i, j], upper[i, j]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query", "row", "lower", "upper"])

    return run


def exact_scores(sent: Broadcast) -> Callable:
    """Exact scores of pairs (query, id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Queries = sent.value
        for batch in batches:
            for length, part in by_length(batch, batch.column("length").to_numpy(), known):
                numbers, ids, queries = known[length]
                at = np.searchsorted(numbers, part.column("query").to_numpy())
                score = np.einsum("ij,ij->i", queries[at], matrix(part.column("v"), length))
                made = [part.column("query"), pa.array(ids[at]), part.column("id"), pa.array(score, pa.int64())]
                yield pa.RecordBatch.from_arrays(made, names=["query", "query_id", "vec_id", "score"])

    return run


def candidates(file: DataFrame, sent: Broadcast, k: int, block: int) -> DataFrame:
    """Pairs (query, row, upper, place) whose upper bound reaches the query's kth best lower bound, in the order of the bounds."""
    cells = file.select("row", "length", "low", "width", "cells")
    pairs = arrow(cells, scan(sent, k, block), "query long, row long, lower double, upper double")
    of = W.partitionBy("query")
    pairs = pairs.withColumn("place", F.row_number().over(of.orderBy(F.desc("lower"), "row")))
    pairs = pairs.withColumn("certain", F.max(F.when(F.col("place") == k, F.col("lower"))).over(of))
    pairs = pairs.where(F.col("certain").isNull() | (F.col("upper") >= F.col("certain")))
    place = F.row_number().over(of.orderBy(F.desc("upper"), "row"))
    return pairs.select("query", "row", "upper", place.alias("place"))


def passes(rows: DataFrame, query_block: int) -> Iterator[Queries]:
    """The queries in blocks of about ``query_block`` vectors of 64 components; a longer vector counts as several."""
    asked = rows.where("q").select("row", "id", "v", F.size("v").alias("length"))
    n, values = asked.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    many = max(-(-n // query_block), -(-values // (64 * query_block)))
    for i in range(many):
        block = asked.where(F.pmod(F.xxhash64("row"), F.lit(many)) == i).toArrow().combine_chunks().sort_by("row")
        lengths = block.column("length").to_numpy()
        known: Queries = {}
        for length in np.unique(lengths).tolist():
            part = block.take(pa.array(np.flatnonzero(lengths == length))).combine_chunks()
            row, ids = (part.column(c).to_numpy() for c in ("row", "id"))
            known[length] = row, ids, matrix(pa.concat_arrays(part.column("v").chunks), length)
        if known:
            yield known


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_column: str = "vec_id",
    vector: str = "embedding",
    scale: int = 64,
    bits: int = 6,
    query_block: int = 32_768,
    candidate_block: int = 8192,
) -> DataFrame:
    """The k rows with the highest integer inner products for each query row (query_id, rank, vec_id, score).

    Components become floor(scale * x). The cells of all vectors are written once, next to the exact
    vectors. A block of queries of bounded size is sent to the tasks that scan the cells alone, without a shuffle of
    vectors; a pair stays if its upper bound reaches the query's kth best lower bound. Then exact
    vectors are read in the order of the upper bounds: the first 2k of each query, and of the others those whose
    bound reaches the kth exact score, so that the result is certain. Scans are as many as blocks of queries.

    Ties go to the smaller id. Null ids, and vectors that are null or hold a null or non-finite
    component, take no part. Rows of equal id and equal components count once; different vectors of one id
    are each a candidate, and each a query if the id is one (its ranks then start again). A query leaves out its
    own row only. Vectors are compared with those of their own length; scores must fit a long. An empty table
    gives no rows, a single row no partner. The search runs when this is called; the result is a written table.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, is_query, id_column, vector, scale)
    file = approximations(rows, k, bits)
    out, written = scratch_dir(spark, "top"), False
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    for i, known in enumerate(passes(rows, query_block)):
        sent = spark.sparkContext.broadcast(known)
        pairs = saved(candidates(file, sent, k, candidate_block), "candidates")

        def scores(pairs: DataFrame, sent: Broadcast = sent) -> DataFrame:
            read = pairs.join(file.select("row", "id", "v", "length"), "row").select("query", "id", "v", "length")
            return arrow(read, exact_scores(sent), "query long, query_id long, vec_id long, score long")

        found = scores(pairs.where(F.col("place") <= 2 * k))
        others = pairs.where(F.col("place") > 2 * k)
        if not others.isEmpty():
            found = saved(found, "scores")
            kth = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query", "score")
            found = found.union(scores(others.join(kth, "query").where(F.col("upper") >= F.col("score")).drop("score")))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.parquet(f"{out}/block={i}")
        written = True
        sent.destroy()
    if not written:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(f"{RESULT}, block int").parquet(out).drop("block")
