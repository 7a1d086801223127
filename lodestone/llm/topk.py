"""Operator 10: exact top-k search by distributed histogram selection.

Vectors are quantised and packed into blocks. Queries go in waves of at most WAVE vectors and WAVE_BYTES bytes, sent to
all executors; candidates stay where they are, so no candidate is shuffled and no key can be hot. Every round scores
everything: each task counts, for each query of the wave, its candidates in BINS bins of the query's score range; the
summed histograms show the bin that holds the kth best score, and it becomes the next range, until ranges are one score
wide. Then the kth score is known exactly: scores above it pass the filter, and of those equal to it as many as the
query still lacks, smallest ids first. A last ranking of what passed gives the result, ties to the smaller id. Waves
are written one by one, so a lost executor costs a part of one round.

Vectors that are null, empty or hold a null or non-finite component take no part, as query or candidate. A query meets
the vectors of its own length. A query is never its own candidate; other rows with its id are left out with it. Repeated
rows count one by one, as candidates and as queries; query rows that repeat an id share its k places. Fewer candidates than k: all are returned. An empty table gives no
rows; other columns are not read, whatever their names. Scores are exact integers: sums beyond the 53 bits of floats are
taken in 64-bit integers, those that may go beyond these in Python's; a score beyond 64 bits is held at their end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._common import Workspace, table

BLOCK, BINS, STRIPE, WAVE, WAVE_BYTES = 2048, 128, 256, 4096, 16 << 20
_TOP = (1 << 63) - 1
_SIGN = np.uint64(1 << 63)


def blocks(rows: DataFrame, dim: int, scale: float, size: int = BLOCK) -> DataFrame:
    """Rows (ids, cells, peak) of up to `size` vectors: ids as 64-bit, floor(scale * x) as 64-bit floats, largest magnitude."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_i, held_x, n = [], [], 0

        def out() -> pa.RecordBatch:
            ids, x = np.concatenate(held_i), np.concatenate(held_x)
            parts = [(ids[i : i + size].tobytes(), x[i : i + size].tobytes(), float(np.abs(x[i : i + size]).max(initial=0))) for i in range(0, len(ids), size)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.binary(), pa.binary(), pa.float64()), strict=True)], ["ids", "cells", "peak"])

        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            held_i.append(b.column(0).to_numpy())
            held_x.append(np.floor(scale * flat).reshape(-1, dim))
            n += b.num_rows
            if n >= 4 * size:
                yield out()
                held_i, held_x, n = [], [], 0
        if n:
            yield out()

    return rows.mapInArrow(run, "ids binary, cells binary, peak double")


def products(x: np.ndarray, y: np.ndarray, peak: float) -> np.ndarray:
    """Exact inner products of rows of whole floats as 64-bit integers; no sum exceeds the peak."""
    if peak < 1 << 53:
        return (x @ y.T).astype(np.int64)
    if peak < 1 << 62:
        return x.astype(np.int64) @ y.astype(np.int64).T
    whole = lambda m: np.array([[int(c) for c in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(x) @ whole(y).T, -_TOP, _TOP).astype(np.int64)


def _scores(wave: dict, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, slice, np.ndarray, np.ndarray]]:
    """Candidate ids, a stripe of queries, their scores, and which of these count (a query's own id doesn't)."""
    dim = wave["x"].shape[1]
    for b in batches:
        for ids, cells, peak in zip(*(c.to_pylist() for c in b.columns), strict=True):
            c, y = np.frombuffer(ids, np.int64), np.frombuffer(cells, np.float64).reshape(-1, dim)
            for i in range(0, len(wave["ids"]), STRIPE):
                at = slice(i, min(i + STRIPE, len(wave["ids"])))
                yield c, at, products(wave["x"][at], y, wave["peak"] * peak * dim), wave["ids"][at, None] != c


def _ordered(s: np.ndarray) -> np.ndarray:
    """Signed scores as unsigned numbers of the same order."""
    return s.view(np.uint64) ^ _SIGN


def _histogram(batches: Iterable[pa.RecordBatch], wave: dict, shift: int, used: int, bins: int) -> Iterator[pa.RecordBatch]:
    """Counts of (query, bin) in the query's range, which has `used` bins, summed over the candidate blocks of the task."""
    total = np.zeros(len(wave["ids"]) * bins, np.int64)
    for _, at, s, counts in _scores(wave, batches):
        u, base = _ordered(s), wave["base"][at, None]
        bin_ = ((u - base) >> np.uint64(shift)).astype(np.int64)
        inside = counts & (u >= base) & (bin_ < used) & (bin_ >= 0)
        rows = np.arange(s.shape[0])[:, None] * bins
        total[at.start * bins : at.stop * bins] += np.bincount((rows + bin_)[inside], minlength=s.shape[0] * bins)
    at = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])


def _filter(batches: Iterable[pa.RecordBatch], wave: dict, k: int) -> Iterator[pa.RecordBatch]:
    """What lies above the kth score, and the smallest ids that equal it, as many as are lacking; of a task's rows the k best of each query."""
    held: list[tuple] = []

    def best() -> tuple:
        q, s, c = (np.concatenate(x) for x in zip(*held, strict=True))
        o = np.lexsort((c, -s, q))
        q, s, c = q[o], s[o], c[o]
        first = np.concatenate([[0], np.nonzero(q[1:] != q[:-1])[0] + 1]) if len(q) else np.zeros(0, int)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        return q[place < k], s[place < k], c[place < k]

    n = 0
    for c, at, s, counts in _scores(wave, batches):
        order = np.argsort(c, kind="stable")
        s, counts, u = s[:, order], counts[:, order], _ordered(s[:, order])
        base = wave["base"][at, None]
        edge = (u == base) & counts
        r, col = np.nonzero(counts & (u > base) | edge & (edge.cumsum(1) <= wave["lack"][at, None]))
        held.append((r + at.start, s[r, col], c[order[col]]))
        n += len(r)
        if n > 4 * k * len(wave["ids"]) + 100_000:
            held = [best()]
            n = len(held[0][0])
    if held:
        q, s, c = best()
        for i in range(0, len(q), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(q[i : i + 50_000].astype(np.int64)), pa.array(wave["ids"][q[i : i + 50_000]]), pa.array(c[i : i + 50_000]), pa.array(s[i : i + 50_000])], ["row", "query_id", "vec_id", "score"])


def refine(wave: dict, at: np.ndarray, n: np.ndarray, shift: int, bins: int) -> None:
    """The bin of the kth best score becomes the range: base moves to it, lack is what it must still give."""
    total = np.zeros(len(wave["ids"]) * bins, np.int64)
    total[at] = n
    total = total.reshape(-1, bins)
    above = total[:, ::-1].cumsum(1)[:, ::-1]  # in the bin and all higher ones
    enough = above >= wave["lack"][:, None]
    pick = np.where(enough.any(1), bins - 1 - enough[:, ::-1].argmax(1), 0)
    more = np.append(above, np.zeros((len(above), 1), np.int64), 1)[np.arange(len(pick)), pick + 1]
    wave["base"] = wave["base"] + (pick.astype(np.uint64) << np.uint64(shift))
    wave["lack"] = wave["lack"] - more


def _of_length(ws: Workspace, rows: DataFrame, dim: int, k: int, scale: float, block: int, bins: int, wave_size: int) -> None:
    """Writes the results of all queries of this length, wave by wave."""
    spark = ws.spark
    rows = rows.filter(F.size("x") == dim)
    wide = 2 * spark.sparkContext.defaultParallelism
    spread = rows.select("id", "x") if rows.rdd.getNumPartitions() >= wide else rows.select("id", "x").repartition(wide)
    cand = ws.keep(f"candidates-{dim}", blocks(spread, dim, scale, block))
    wave_size = max(1, min(wave_size, WAVE_BYTES // (8 * dim)))
    asks = blocks(rows.filter("asks").select("id", "x").repartition(max(1, spark.sparkContext.defaultParallelism // 2)), dim, scale, min(block, wave_size))
    asks = ws.keep(f"queries-{dim}", asks.withColumn("tag", F.monotonically_increasing_id()))
    top = cand.agg(F.max("peak")).first()[0] or 0.0
    sizes = asks.select("tag", (F.octet_length("ids") / 8).cast("int").alias("n")).orderBy("tag").collect()  # a number per block of queries
    waves: list[list] = []
    room = 0
    for r in sizes:
        if r.n > room:
            waves.append([])
            room = wave_size
        waves[-1].append(r.tag)
        room -= r.n
    bits = bins.bit_length() - 1
    for number, tags in enumerate(waves):
        got = asks.filter(F.col("tag").isin(tags)).orderBy("tag").collect()  # at most wave_size vectors and WAVE_BYTES
        wave = {"ids": np.concatenate([np.frombuffer(r.ids, np.int64) for r in got]), "x": np.concatenate([np.frombuffer(r.cells, np.float64).reshape(-1, dim) for r in got]), "peak": max(r.peak for r in got)}
        bound = int(min(float(1 << 62), wave["peak"] * top * dim)) + 1
        bound = bound if bound < 1 << 62 else _TOP
        wave["base"] = _ordered(np.full(len(wave["ids"]), -bound, np.int64))
        wave["lack"] = np.full(len(wave["ids"]), k, np.int64)
        shift, used = max(0, (2 * bound).bit_length() - bits), bins
        while True:
            sent = spark.sparkContext.broadcast(wave)
            counts = cand.mapInArrow(lambda bs, w=sent, sh=shift, n=used: _histogram(bs, w.value, sh, n, bins), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most wave x bins numbers
            refine(wave, counts["at"].to_numpy(np.int64), counts["n"].to_numpy(np.int64), shift, bins)
            sent.unpersist()
            if not shift:
                break
            shift, used = max(0, shift - bits), 1 << min(shift, bits)
        sent = spark.sparkContext.broadcast(wave)
        passed = cand.mapInArrow(lambda bs, w=sent: _filter(bs, w.value, k), "row long, query_id long, vec_id long, score long")
        place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
        passed.withColumn("place", place).filter(F.col("place") <= k).select("query_id", "vec_id", "score").write.parquet(f"{ws.root}/found/{dim}-{number}")
        sent.unpersist()


def search(vectors: DataFrame, queries: Column, k: int, *, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, bins: int = BINS, wave: int = WAVE) -> DataFrame:
    """The k best candidates of each row that `queries` holds for: query_id, rank, vec_id, score. bins: a power of two."""
    spark, schema = vectors.sparkSession, "query_id long, vec_id long, score long"
    ws = Workspace(spark, "topk")
    x = F.col(vector_col).cast("array<double>")
    fit = F.size(x) > 0, F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fit[0] & fit[1]).select(F.col(id_col).cast("long").alias("id"), x.alias("x"), queries.alias("asks"))
    lengths = [r.dim for r in rows.filter("asks").select(F.size("x").alias("dim")).distinct().orderBy("dim").collect()]  # the lengths that queries have
    for dim in lengths:
        _of_length(ws, rows, dim, k, scale, block, bins, wave)
    found = spark.read.schema(schema).parquet(f"{ws.root}/found/*") if lengths else spark.createDataFrame([], schema)
    # rows that repeat a query's id share its ranking
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


ORACLE_SQL = {
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
}
