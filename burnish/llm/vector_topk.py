"""Operator 2, exact top-k search: vector-approximation files over integer vectors.

The exact file has a row for each usable vector.  the approximation file, made from it, has blocks of about BLOCK rows:
for each component the byte of its cell on a grid of equal cells, one grid a dimension and block.

1. Scan.  Every task reads cells only.  One product of the queries with the bytes gives an upper and a lower bound of
   every score.  The k-th highest lower bound that a task has met so far goes with each query from block to block, and
   rows whose upper bound is below it are passed over; then the k-th highest lower bound of all tasks prunes again.
2. Read.  Candidates are read from the exact file in the order of their bounds: the k highest of each query first; what
   their k-th score has not ruled out is read next, and with that the result is certain.

Queries are a stated set and meet all rows in blocks.  They are sent to every executor once, QUERY_BYTES of vectors at a
time; beyond that the steps are repeated for the next part of them.  Of more than k + 1 equal vectors in a block those with
the smallest ids stand for all: no other can be among the best.

Defined cases: null vectors and those with a null, NaN or infinite component (also times 256) take no part; an empty vector
takes none either, nor do rows with a null id; very long vectors are compared like any other; vectors of another dimension
are not compared; equal scores go to the smaller id, and repeated ids are separate candidates; a query never meets rows of
its own id; of usable rows that repeat a query id, one asks, that with the smallest vector by its bytes; an empty table
gives an empty result; other columns are ignored.  Where scores could pass 2^52, no bound is taken and rows are read whole;
scores beyond a long are cut to its ends, in exact order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, quoted, sized, tidied

BLOCK, CELLS = 4096, 256
QUERY_BLOCK, QUERY_BYTES = 512, 32 << 20
#: Candidates that a task holds before it drops those that it has since ruled out.
HELD = 1 << 20
#: A block: its dimension, the start and width of each dimension's cells (f8), ids and rows (i8) and cells (u1).
BLOCKS = "dim int, low binary, width binary, ids binary, rids binary, cells binary"


def usable(batch: pa.RecordBatch) -> pa.RecordBatch:
    """id, dim, vec (floor(256 x) as f8 bytes) and asks of the rows whose vectors have finite components only."""
    vec = batch.column("vec")
    size = pc.fill_null(pc.list_value_length(vec), 0).to_numpy()
    flat = pc.list_flatten(vec)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * 256.0) + 0.0
    row = np.repeat(np.arange(len(size)), size)
    fine = (size > 0) & (np.bincount(row, weights=~np.isfinite(values), minlength=len(size)) == 0)
    bytes_, ends = values[fine[row]].astype("<f8").tobytes(), np.cumsum(size[fine] * 8)
    offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes())
    packed = pa.Array.from_buffers(pa.large_binary(), int(fine.sum()), [None, offsets, pa.py_buffer(bytes_)])
    keep = pa.array(fine)
    return pa.RecordBatch.from_arrays([batch.column("id").filter(keep), pa.array(size[fine], pa.int32()), packed.cast(pa.binary()), batch.column("asks").filter(keep)], ["id", "dim", "vec", "asks"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _few_of_equal(exact: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Which rows are among the `most` smallest ids of those with their vector."""
    rows = np.ascontiguousarray(exact).view(np.dtype((np.void, exact.shape[1] * 8))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    order = np.lexsort((ids, group))
    group = group[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return np.sort(order[rank < most])


def pack(exact: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The approximation file of the exact one (rid, id, dim, vec), packed in the scan without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            rids, ids, x = (np.concatenate(v) for v in zip(*held.pop(dim), strict=True))
            stays = _few_of_equal(x, ids, k + 1)
            rids, ids, x = rids[stays], ids[stays], x[stays]
            low = x.min(axis=0)
            width = np.maximum(1.0, np.ceil((x.max(axis=0) - low + 1) / CELLS))
            cells = np.minimum((x - low) // width, CELLS - 1).astype(np.uint8)
            row = [dim, *(v.tobytes() for v in (low.astype("<f8"), width.astype("<f8"), ids.astype("<i8"), rids.astype("<i8"), cells))]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if i == 0 else pa.binary()) for i, v in enumerate(row)], ["dim", "low", "width", "ids", "rids", "cells"])

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                of = batch.filter(pa.array(dims == dim))
                for start in range(0, of.num_rows, block):
                    part = of.slice(start, block)
                    held.setdefault(dim, []).append((part.column("rid").to_numpy(), part.column("id").to_numpy(), _matrix(part.column("vec"), dim)))
                    if sum(len(v[0]) for v in held[dim]) >= block:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return exact.select("rid", "id", "dim", "vec").mapInArrow(tidied(run), BLOCKS)


class Queries:
    """Queries of one dimension: their ids and vectors, and the k highest lower bounds that each has met."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.lower = np.full((len(ids), k), -np.inf)

    def least(self) -> np.ndarray:
        """What an upper bound must reach."""
        return self.lower.min(axis=1)

    def scan(self, low: np.ndarray, width: np.ndarray, ids: np.ndarray, cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query's place, row's place, upper and lower bound) of the rows of a block that the bounds don't rule out."""
        dim, points = len(low), cells.astype(np.float32).T
        largest = np.abs(low) + width * CELLS
        for start in range(0, len(self.ids), QUERY_BLOCK):
            q = self.vectors[start : start + QUERY_BLOCK]
            with np.errstate(over="ignore", invalid="ignore"):
                most = (np.abs(q) * largest).sum(axis=1)
                # Four times what single precision can lose in these products and sums.
                margin = (np.abs(q) * width).sum(axis=1) * CELLS * (dim + 4) * 2.0**-22 + 1
                base = (q * width).astype(np.float32) @ points + (q @ low)[:, None].astype(np.float64)
            above = (np.maximum(q, 0) * (width - 1)).sum(axis=1) + margin
            below = (np.minimum(q, 0) * (width - 1)).sum(axis=1) - margin
            unsure = ~(most < 2.0**52)
            base[unsure], above[unsure], below[unsure] = 0.0, np.inf, -np.inf
            own = self.ids[start : start + QUERY_BLOCK, None] == ids[None, :]
            base[own] = -np.inf
            least = self.lower[start : start + QUERY_BLOCK].min(axis=1)
            if len(ids) > 4 * self.k and (least == -np.inf).any():
                # The first block: its own k-th highest lower bounds are the ones to reach.
                kth = np.partition(base, len(ids) - self.k, axis=1)[:, len(ids) - self.k] + below
                least = np.maximum(least, kth)
            hit, row = np.nonzero((base >= (least - above)[:, None]) & ~own)
            worth = base[hit, row]
            lower = worth + below[hit]
            ends = np.cumsum(np.bincount(hit, minlength=len(q)))
            for i in np.unique(hit).tolist():
                new = lower[(ends[i - 1] if i else 0) : ends[i]]
                both = np.concatenate([self.lower[start + i], new])
                self.lower[start + i] = np.partition(both, len(both) - self.k)[-self.k :]
            yield hit + start, row, worth + above[hit], lower


def _candidates(cells: DataFrame, sent, k: int) -> DataFrame:
    """(query, rid, id, upper, lower) of rows that no task's bounds rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {dim: Queries(ids, vectors, k) for dim, (ids, vectors) in sent.value.items()}
        held: dict[int, list[tuple[np.ndarray, ...]]] = {dim: [] for dim in queries}

        def ruled(dim: int) -> list[tuple[np.ndarray, ...]]:
            if not held[dim]:
                return []
            all_ = tuple(np.concatenate(x) for x in zip(*held[dim], strict=True))
            stays = all_[3] >= queries[dim].least()[all_[0]]
            return [tuple(x[stays] for x in all_)]

        for batch in batches:
            for i in range(batch.num_rows):
                dim, low, width, ids, rids, cells_ = (batch.column(c)[i].as_py() for c in range(6))
                if dim not in queries:
                    continue
                ids, rids = np.frombuffer(ids, "<i8"), np.frombuffer(rids, "<i8")
                for q, row, upper, lower in queries[dim].scan(np.frombuffer(low, "<f8"), np.frombuffer(width, "<f8"), ids, np.frombuffer(cells_, np.uint8).reshape(len(ids), dim)):
                    held[dim].append((q, rids[row], ids[row], upper, lower))
                if sum(len(x[0]) for x in held[dim]) > HELD:
                    held[dim] = ruled(dim)
        for dim in held:
            for q, rid, id_, upper, lower in ruled(dim):
                for start in range(0, len(q), 10_000):
                    cut = slice(start, start + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array(queries[dim].ids[q[cut]]), pa.array(rid[cut]), pa.array(id_[cut]), pa.array(upper[cut]), pa.array(lower[cut])], ["query", "rid", "id", "upper", "lower"])

    return cells.mapInArrow(tidied(run), "query long, rid long, id long, upper double, lower double")


def _read(wanted: DataFrame, exact: DataFrame, sent) -> DataFrame:
    """(query, id, score, beyond) of the wanted rows, from the exact file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {dim: (np.argsort(ids, kind="stable"), np.sort(ids), vectors) for dim, (ids, vectors) in sent.value.items()}
        for batch in batches:
            query, id_, dims = (batch.column(c).to_numpy() for c in ("query", "id", "dim"))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                order, sorted_, vectors = places[dim]
                q = vectors[order[np.searchsorted(sorted_, query[at])]]
                x = _matrix(batch.column("vec").take(pa.array(at)), dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = np.einsum("ij,ij->i", q, x)
                    sure = np.abs(q * x).sum(axis=1) < 2.0**52
                told = [_long(int(s)) if fine else _long(sum(int(a) * int(b) for a, b in zip(q[i], x[i], strict=True))) for i, (s, fine) in enumerate(zip(scores.tolist(), sure.tolist(), strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(query[at]), pa.array(id_[at]), pa.array([t[0] for t in told], pa.int64()), pa.array([t[1] for t in told], pa.string())], ["query", "id", "score", "beyond"])

    met = exact.select("rid", "dim", "vec").join(sized(wanted.select("query", "rid", "id")), "rid")
    return met.select("query", "id", "dim", "vec").mapInArrow(tidied(run), "query long, id long, score long, beyond string")


def _kth(rows: DataFrame, k: int, *order: Column, value: str) -> DataFrame:
    """(query, least): the k-th value of each query that has so many."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("place") <= k)
    return ranked.groupBy("query").agg(F.count("*").alias("n"), F.min(value).alias("least")).filter(F.col("n") == k).drop("n")


def top_k(vectors: DataFrame, asks: Column, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, id and score of the k best rows for every row where asks holds."""
    spark = vectors.sparkSession
    source = vectors.filter(F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vec_col)).cast("array<double>").alias("vec"), F.coalesce(asks, F.lit(False)).alias("asks"))
    told = source.mapInArrow(tidied(lambda batches: map(usable, batches)), "id long, dim int, vec binary, asks boolean")
    exact = materialise(told.withColumn("rid", F.monotonically_increasing_id()), "va-exact")
    cells = materialise(pack(exact, k), "va-cells")
    asked = materialise(exact.filter("asks").groupBy("id").agg(F.min(F.struct("vec", "dim")).alias("v")).select("id", "v.*"), "va-queries")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("vec") + 16), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / QUERY_BYTES))
    results = []
    for part in range(parts):
        by: dict[int, tuple[list[int], list[bytes]]] = {}
        for r in asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect():  # about QUERY_BYTES
            ids, vecs = by.setdefault(r.dim, ([], []))
            ids.append(r.id)
            vecs.append(bytes(r.vec))
        sent = spark.sparkContext.broadcast({dim: (np.array(ids), np.frombuffer(b"".join(vecs), "<f8").reshape(-1, dim)) for dim, (ids, vecs) in by.items()})
        found = materialise(_candidates(cells, sent, k), "va-found")
        least = _kth(found, k, F.col("lower").desc(), value="lower")
        open_ = found.join(sized(materialise(least, "va-least")), "query", "left").filter("least IS NULL OR upper >= least").drop("least", "lower")
        open_ = materialise(open_.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("upper").desc(), "id", "rid"))), "va-open")
        first = materialise(_read(open_.filter(F.col("place") <= k), exact, sent), "va-first")
        kth = sized(materialise(_kth(first, k, F.col("score").desc(), value="score"), "va-kth"))
        rest = open_.filter(F.col("place") > k).join(kth, "query", "left").filter("least IS NULL OR upper >= least")
        results += [first, materialise(_read(materialise(rest, "va-rest"), exact, sent), "va-second")]
    scored = results[0]
    for more in results[1:]:
        scored = scored.union(more)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("beyond").desc(), F.col("id"))
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")


def _long(score: int) -> tuple[int, str]:
    """The score within a long, and text that orders scores which are cut to one end."""
    digits = str(abs(score))
    if score >= 2**63:
        return 2**63 - 1, f"{len(digits):05d}{digits}"
    if score < -(2**63):
        return -(2**63), f"{99_999 - len(digits):05d}" + "".join(str(9 - int(d)) for d in digits)
    return score, ""
