"""Exact top-k by inner product over whole numbers, by distributed histogram selection.

Components become ``floor(256 * x)`` (x as double), scores are integers.  For a
block of queries (a fixed number at a time, so what is sent to executors has a
fixed size) every round scores all candidates and sums histograms over all
partitions:

1. The range of a query's scores splits into bins.  The bin in which the count
   from the top reaches k holds the kth score.  It becomes the next range.
2. When bins are single scores, the kth score is known exactly, and how many
   score more.
3. A last pass keeps the candidates above the kth score, and of those that tie
   with it the smallest ids.

A partition sends only bins at or above its own kth score (no other can hold
the global one) and only its k smallest ids of a tie, so a value shared by very
many vectors costs no more than any other.

Edge cases: vectors that are null, or hold null or non-finite components, take
no part, neither do null ids; a vector of another length than the query's
first ones scores over the common components with zeros for the rest; repeated
ids are separate candidates, except that a query never meets rows of its own
id; fewer than k candidates give all; an empty table gives an empty result.
Sums are exact: in doubles where no sum can pass 2**53 (by the norms), in whole
numbers of 64 bits elsewhere; components count up to 2**63, and scores beyond
2**62 either way as 2**62.  Very long vectors are read whole; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import append_table, read_again, write_table

BINS = 256
#: Rows that are scored at once against a block of queries.
ROWS_AT_ONCE = 2048
NEVER = -(2**62)
#: Doubles hold all whole numbers below; scores count up to the second.
EXACT, MOST = 2.0**53, 2**62 - 1


def quantized(vector: Column) -> Column:
    """Whole-number components; null if the vector takes no part."""
    d = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(d, lambda x: F.floor(x * 256.0).cast("long")))


def _matrix(lists: pa.Array, width: int, kind: type) -> np.ndarray:
    """Rows of ``width`` numbers; short rows end in zeros."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), kind)
    lengths = np.diff(offsets)
    if len(lists) and (lengths == width).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, width).astype(kind)
    for i in range(len(lists)):
        row = values[offsets[i] : offsets[i + 1]][:width]
        out[i, : len(row)] = row
    return out


def _scores(batches: Iterator[pa.RecordBatch], queries: np.ndarray, query_ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores by query and row); a query's own rows score NEVER."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(first, ROWS_AT_ONCE)
            ids = part.column(0).to_numpy()
            rows = _matrix(part.column(1), queries.shape[1], queries.dtype.type)
            if queries.dtype == np.float64:  # all sums are below 2**53
                scores = np.rint(queries @ rows.T).astype(np.int64)
            else:  # 64-bit sums are right wherever the true ones are in reach, which doubles tell
                about = queries.astype(np.float64) @ rows.astype(np.float64).T
                with np.errstate(over="ignore"):
                    scores = queries @ rows.T
                scores = np.where(np.abs(about) >= MOST, np.where(about > 0, MOST, -MOST), scores)
            scores[query_ids[:, None] == ids[None, :]] = NEVER
            yield ids, scores


def _histogram(vectors: DataFrame, shared, k: int) -> DataFrame:
    """(q, bin, n) over all partitions for the ranges (low, width of a bin, width) in ``shared``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, query_ids, low, step, width = shared.value
        counts = np.zeros((len(query_ids), BINS), np.int64)
        for _, scores in _scores(batches, queries, query_ids):
            place = (scores - low[:, None]) // step[:, None]
            inside = (scores >= low[:, None]) & (scores < (low + width)[:, None])
            flat = (np.arange(len(query_ids))[:, None] * BINS + place)[inside]
            counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < k))
        yield pa.record_batch([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[q, b], pa.int64())], ["q", "bin", "n"])

    return vectors.mapInArrow(run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _select(vectors: DataFrame, query_ids: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the candidates that may be among the k best of a block of queries."""
    context = vectors.sparkSession.sparkContext
    need = np.full(len(query_ids), k)
    width = high - low + 1  # at most 2**63 - 1
    step = np.maximum(1, -(-width // BINS))
    while True:
        shared = context.broadcast((queries, query_ids, low, step, width))
        counts = np.zeros((len(query_ids), BINS), np.int64)
        for r in _histogram(vectors, shared, k).collect():  # at most queries x bins of one block
            counts[r.q, r.bin] = r.n
        from_top = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        reached = from_top >= need[:, None]
        found = np.where(reached.any(axis=1), BINS - 1 - np.argmax(reached[:, ::-1], axis=1), 0)
        above = from_top[np.arange(len(need)), found] - counts[np.arange(len(need)), found]
        need = need - above  # how many of the k lie in the bin itself
        low = low + found * step
        shared.destroy()
        if (step == 1).all():
            kth = low
            break
        width, step = step, np.maximum(1, -(-step // BINS))
    shared = context.broadcast((queries, query_ids, kth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, query_ids, kth = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
        for ids, scores in _scores(batches, queries, query_ids):
            q, c = np.nonzero((scores >= kth[:, None]) & (scores != NEVER))
            if not len(q):
                continue
            got = scores[q, c]
            order = np.lexsort((ids[c], -got, q))
            q, c, got = q[order], c[order], got[order]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            for i in np.flatnonzero(nth < k):
                best[q[i]].append((-int(got[i]), int(ids[c[i]])))
            for i in np.unique(q):
                best[i] = sorted(best[i])[:k]
        rows = [(int(query_ids[i]), vec, -score) for i, row in enumerate(best) for score, vec in row]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def exact_top_k(
    vectors: DataFrame, is_query: Column, *, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", block: int = 1024,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query``, the k best other rows; ties go to smaller ids."""
    rows = vectors.where(F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), quantized(F.col(vector)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = write_table(rows.where("v is not null"))
    # No score passes the product of norms (Cauchy-Schwarz).
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    longest = rows.agg(F.max(norm)).first()[0]
    candidates = rows.select("vec_id", "v")
    found = write_table(vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long"))

    def one(held: list) -> DataFrame:
        ids = np.array([r.vec_id for r in held], np.int64)
        width = max(1, max(len(r.v) for r in held))
        queries = np.zeros((len(held), width), np.int64)
        for i, r in enumerate(held):
            queries[i, : len(r.v)] = r.v
        norms = np.linalg.norm(queries.astype(np.float64), axis=1) * longest
        if norms.max() < EXACT / 2:
            queries = queries.astype(np.float64)
        reach = np.minimum(np.ceil(norms), float(MOST // 2)).astype(np.int64) + 1
        reach = np.where(norms >= MOST // 2, MOST, reach)
        return _select(candidates, ids, queries, -reach, reach, k)

    # One table for the results of all blocks, so that the plan does not grow with them.
    held: list = []
    for r in rows.where("query").select("vec_id", "v").orderBy("vec_id").toLocalIterator():
        held.append(r)
        if len(held) == block:
            append_table(found, one(held))
            held = []
    if held:
        append_table(found, one(held))
    found = read_again(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
