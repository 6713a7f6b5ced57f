"""Ranks of all pairs' scores among each other, in little disk.

The scores are not shuffled.  A first pass counts them by ranges, which are divided until each holds what a task
can put in order; a second one sends every range the places of its cells, about a byte a cell, and there the
scores are made again.  Both make a pair's score by the same additions in the same order, so a score never
changes between passes and equal vectors have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators.scoring import Pairs

SENT = 16_000_000  #: components of all vectors that go to every task at most
CELLS = 4_000_000  #: scores that a task holds at a time
BINS = 8192


def _vectors(rows: DataFrame, id_col: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and matrix, if the vectors are of one length, finite and together no larger than what is sent."""
    size = F.size("e")
    n, full, least, most = rows.agg(F.count(F.lit(1)), F.count("e"), F.min(size), F.max(size)).first()
    if not n or full < n or least != most or not 0 < n * most <= SENT or rows.where(F.col(id_col).isNull()).limit(1).count():
        return None
    got = rows.select(F.col(id_col).cast("long").alias("id"), F.col("e").cast("array<double>").alias("e")).toArrow().combine_chunks()
    flat = got.column("e").combine_chunks().flatten()
    if flat.null_count:
        return None
    x = flat.to_numpy().reshape(n, -1)
    return (got.column("id").to_numpy(), x) if np.isfinite(x).all() else None


def block_scores(q: np.ndarray, xt: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``q`` and columns of ``xt``, added up component by component."""
    out = np.empty((len(q), xt.shape[1]))
    step = max(1, 50_000 // max(1, xt.shape[1]))
    for lo in range(0, len(q), step):
        some, s = q[lo : lo + step], out[lo : lo + step]
        np.multiply(some[:, :1], xt[0], out=s)
        more = np.empty_like(s)
        for k in range(1, len(xt)):
            s += np.multiply(some[:, k : k + 1], xt[k], out=more)
    return out


def cell_scores(qt: np.ndarray, xt: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The same of listed cells."""
    out = np.empty(len(rows))
    for lo in range(0, len(rows), 32_768):
        i, j = rows[lo : lo + 32_768], cols[lo : lo + 32_768]
        s = qt[0].take(i) * xt[0].take(j)
        for k in range(1, len(qt)):
            s += qt[k].take(i) * xt[k].take(j)
        out[lo : lo + 32_768] = s
    return out


def gaps(cells: np.ndarray) -> bytes:
    """Rising numbers as bytes of their differences; 255 stands for as much and that more follows."""
    more, rest = np.divmod(np.diff(cells, prepend=-1), 255)
    out = np.full(len(cells) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def from_gaps(told: bytes) -> np.ndarray:
    b = np.frombuffer(told, np.uint8)
    return np.cumsum(b, dtype=np.int64)[b < 255] - 1


def normal_quantile(share: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 26.2.23, to 4.5e-4."""
    t = np.sqrt(-2 * np.log(np.minimum(share, 1 - share)))
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return np.where(share < 0.5, -z, z)


def normal_scores(pairs: Pairs, cells: int = CELLS, bins: int = BINS) -> DataFrame | None:
    """(score, query_id, item_id) of all pairs, the score being the normal quantile of the mean rank of equal scores.

    None if the vectors are uneven, not finite or too large to be sent.
    """
    spark = pairs.items.sparkSession
    left, right = _vectors(pairs.queries, "query_id"), _vectors(pairs.items, "item_id")
    if left is None or right is None or left[1].shape[1] != right[1].shape[1]:
        return None
    (q_ids, q), (x_ids, x) = left, right
    with np.errstate(over="ignore"):
        bound = float(np.sqrt((q * q).sum(1).max()) * np.sqrt((x * x).sum(1).max())) * (1 + 1e-6) + 1e-300
    if not np.isfinite(4 * bound):
        return None
    wide = max(1, min(len(x), cells // len(q)))  # items of a chunk
    chunks = -(-len(x) // wide)
    sent = spark.sparkContext.broadcast((q_ids, q, x_ids, x))

    def scored(c: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of a chunk's cells, and which of them are a query with itself."""
        q_ids, q, x_ids, x = sent.value
        some = x_ids[c * wide : (c + 1) * wide]
        s = block_scores(q, np.ascontiguousarray(x[c * wide : (c + 1) * wide].T)).ravel()
        own = [np.flatnonzero(q_ids == some[j]) * len(some) + j for j in np.flatnonzero(np.isin(some, q_ids))]
        return s, np.concatenate(own) if own else np.zeros(0, np.int64)

    def numbers() -> DataFrame:
        return spark.range(0, chunks, 1, min(chunks, max(64, spark.sparkContext.defaultParallelism)))

    def counted(spans: list[tuple[float, float]]) -> list:
        """(at, n, lo, hi) of each part of each span that has scores, by value."""
        edges = np.unique(np.concatenate([np.append(np.minimum(a + (b - a) * (np.arange(bins) / bins), b), b) for a, b in spans]))
        lows, highs = np.array([a for a, _ in spans]), np.array([b for _, b in spans])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c in (c for b in batches for c in b.column(0).to_pylist()):
                s, own = scored(c)
                s = np.delete(s, own)
                if len(lows) > 1 or lows[0] > -bound:
                    at = np.searchsorted(lows, s, side="right") - 1
                    s = s[(at >= 0) & (s <= highs[at])]
                s.sort()
                ends = np.append(np.searchsorted(s, edges), len(s))
                has = np.flatnonzero(np.diff(ends))
                yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(np.diff(ends)[has]), pa.array(s[ends[has]]), pa.array(s[ends[has + 1] - 1])], names=["at", "n", "lo", "hi"])

        made = numbers().mapInArrow(run, "at long, n long, lo double, hi double")
        return sorted(made.groupBy("at").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())

    units, spans = [], [(-bound, bound)]  # units: (lo, hi, n)
    while spans:
        told = [(r["lo"], r["hi"], r["n"]) for r in counted(spans)]
        units += [u for u in told if u[2] <= cells or u[0] == u[1]]
        spans = [u[:2] for u in told if u[2] > cells and u[0] != u[1]]
    if not units:
        return spark.createDataFrame([], "score double, query_id long, item_id long")
    ranges: list[list] = []  # [lo, hi, n]
    for lo, hi, n in sorted(units):
        if ranges and ranges[-1][2] + n <= cells:
            ranges[-1][1:] = [hi, ranges[-1][2] + n]
        else:
            ranges.append([lo, hi, n])
    starts, sizes, same = np.array([r[0] for r in ranges]), np.array([r[2] for r in ranges]), np.array([r[0] == r[1] for r in ranges])
    before = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    shares = np.where(same, -(-sizes // cells), 1)  # a range of one score needs no order and is dealt to several tasks

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in (c for b in batches for c in b.column(0).to_pylist()):
            s, own = scored(c)
            at = (np.searchsorted(starts, s, side="right") - 1).astype(np.uint16 if len(starts) < 65_535 else np.int64)
            at[own] = len(starts)
            order = np.argsort(at, kind="stable")
            ends = np.cumsum(np.bincount(at, minlength=len(starts) + 1))
            for r in np.flatnonzero(np.diff(ends[:-1], prepend=0)).tolist():
                own_cells = order[ends[r - 1] if r else 0 : ends[r]]
                yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([c % int(shares[r])]), pa.array([c]), pa.array([gaps(own_cells)], pa.binary())], names=["range", "share", "chunk", "cells"])

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, x_ids, x = sent.value
        qt = np.ascontiguousarray(q.T)

        def rows(c: int, told: bytes) -> tuple[np.ndarray, np.ndarray]:
            i, j = np.divmod(from_gaps(told), min(wide, len(x) - c * wide))
            return i, j

        def out(c: int, i: np.ndarray, j: np.ndarray, z: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(i), 65_536):
                part = slice(lo, lo + 65_536)
                yield pa.RecordBatch.from_arrays([pa.array(z[part]), pa.array(q_ids[i[part]]), pa.array(x_ids[c * wide + j[part]])], names=["score", "query_id", "item_id"])

        def ended(r: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            if same[r]:
                z = normal_quantile(np.array([(before[r] + sizes[r] / 2) / total]))
                for c, told in held:
                    i, j = rows(c, told)
                    yield from out(c, i, j, np.repeat(z, len(i)))
                return
            s = np.concatenate([cell_scores(qt, np.ascontiguousarray(x[c * wide : (c + 1) * wide].T), *rows(c, told)) for c, told in held])
            order = np.argsort(s)
            v = s[order]
            first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            n = np.diff(np.append(first, len(v)))
            s[order] = np.repeat(normal_quantile((before[r] + first + n / 2) / total), n)
            lo = 0
            for c, told in held:
                i, j = rows(c, told)
                yield from out(c, i, j, s[lo : lo + len(i)])
                lo += len(i)

        at, held = -1, []
        for b in batches:
            for r, c, told in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if r != at and held:
                    yield from ended(at, held)
                    held = []
                at = r
                held.append((c, told))
        if held:
            yield from ended(at, held)

    dealt = numbers().mapInArrow(places, "range long, share long, chunk long, cells binary").repartition(int(shares.sum()), "range", "share")
    return dealt.sortWithinPartitions("range", "chunk").mapInArrow(replaced, "score double, query_id long, item_id long")
