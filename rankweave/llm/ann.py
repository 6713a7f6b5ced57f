"""Approximate nearest neighbours by cosine over few stable projections.

Unit vectors are projected on ``M`` Gaussian directions; the squared projected distance of two of them
is their squared distance times a chi-square variable with ``M`` degrees of freedom.  A kd-tree over
the projections, its splits taken from a bounded sample, cuts all vectors into leaves.  A query visits
leaves by rising distance, and within a leaf takes projected neighbours one after the other; each is
verified by its exact cosine.  It stops once a vector nearer than its current last answer would have
shown up so far with probability ``CONFIDENCE``, by the chi-square test.

Leaves are visited in three waves (the own one, some more, all that the test leaves open), each a
grouped step over the leaves; queries and vectors of a leaf meet in blocks of bounded size.  Equal
vectors are one class, searched once, with the ids that can be answers.

Every vector is indexed.  Defined results: null, zero, and vectors holding null or non-finite
components take no part; those of each length are searched among themselves.  Fewer candidates than
wanted: all of them.  Ties of score go to the smaller id.  Null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.textbatch import column
from rankweave.session import cut

M = 8
CONFIDENCE = 0.96
SAMPLE = 20_000
LEAF, MOST_LEAVES = 1024, 4096
QUERY_BLOCK, VECTOR_BLOCK = 50_000, 16_384
WAVES = (0, 1, 9, MOST_LEAVES)


def chi_square(x: float, m: int = M) -> float:
    """The distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - float(np.exp(-x / 2)) * total


def quantile(p: float, m: int = M) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, m) < p else (lo, mid)
    return hi


class Tree:
    """A kd-tree of splits: leaves of about equal share in the sample, with their boxes."""

    def __init__(self, points: np.ndarray, leaves: int) -> None:
        self.dims: list[int] = []
        self.cuts: list[float] = []
        self.children: list[tuple[int, int]] = []  #: a negative child is leaf -1-child
        low, high = [], []

        def build(part: np.ndarray, n: int, lo: np.ndarray, hi: np.ndarray) -> int:
            spread = part.max(0) - part.min(0) if len(part) else np.zeros(M)
            if n <= 1 or len(part) < 2 or spread.max() <= 0:
                low.append(lo)
                high.append(hi)
                return -len(low)
            d = int(spread.argmax())
            values = np.sort(part[:, d])
            at = min(max(1, len(values) * (n // 2) // n), len(values) - 1)
            cut_ = float((values[at - 1] + values[at]) / 2)
            if not (part[:, d] <= cut_).any() or (part[:, d] <= cut_).all():
                cut_ = float(values[0])
            me = len(self.dims)
            self.dims.append(d)
            self.cuts.append(cut_)
            self.children.append((0, 0))
            left_hi, right_lo = hi.copy(), lo.copy()
            left_hi[d] = right_lo[d] = cut_
            inside = part[:, d] <= cut_
            self.children[me] = (build(part[inside], n // 2, lo, left_hi), build(part[~inside], n - n // 2, right_lo, hi))
            return me

        self.root = build(points, leaves, np.full(M, -np.inf), np.full(M, np.inf))
        self.low, self.high = np.array(low), np.array(high)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            left = points[rows, self.dims[node]] <= self.cuts[node]
            todo += [(self.children[node][0], rows[left]), (self.children[node][1], rows[~left])]
        return out

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point to each leaf's box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(1)


def usable(vector: Column) -> Column:
    """Whether a vector has finite components alone, of which one isn't 0."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(wide, lambda x: x != 0), F.lit(False))


def _doubles(rows: list) -> np.ndarray:
    return np.array(rows, np.float64)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, which is exact, so that no square overflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = _scaled(v)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def search(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 7, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` nearest of all other rows, as found.

    Vectors of different lengths have no cosine; those of each length are searched among themselves.
    """
    spark = df.sparkSession
    base = df.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    lengths = sorted(r["d"] for r in base.select(F.size("v").alias("d")).distinct().collect())  # mostly one
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for i, dims in enumerate(lengths):
        found = _search(base.where(F.size("v") == dims), dims, k, seed, confidence)
        out = out.unionByName(found) if i else found
    return out


def _search(base: DataFrame, dims: int, k: int, seed: int, confidence: float) -> DataFrame:
    """The same for usable vectors of one length; columns id, v and asks."""
    spark = base.sparkSession
    found_schema = "q long, rep long, ids array<long>, score double"
    wanted = k + 1
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = base.withColumn("nth", nth).where(F.col("nth") <= wanted).groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"))
    classes = cut(classes)
    total = classes.count()
    share = F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, total)) * (1 << 30))
    sample = _doubles([r["v"] for r in classes.where(share).select("v").limit(2 * SAMPLE).collect()]).reshape(-1, dims)
    directions = np.random.default_rng(seed).normal(size=(dims, M))
    leaves = int(min(max(1, -(-total // LEAF)), MOST_LEAVES, max(1, len(sample) // 4)))
    tree = Tree(_unit(sample) @ directions if len(sample) else np.zeros((0, M)), leaves)
    n_leaves = len(tree.low)
    vector_blocks = max(1, -(-total // (n_leaves * VECTOR_BLOCK)))
    bound = quantile(confidence)
    plan = spark.sparkContext.broadcast((tree, directions))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, directions = plan.value
        for b in batches:
            v = _doubles(column(b, "v")).reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf_of(_unit(v) @ directions)), b.column(b.schema.get_field_index("rep")), b.column(b.schema.get_field_index("ids")), pa.array([x.tobytes() for x in v], pa.binary())], names=["leaf", "rep", "ids", "bytes"])

    placed = cut(classes.select("rep", "ids", "v").mapInArrow(place, "leaf int, rep long, ids array<long>, bytes binary").withColumn("vb", F.pmod(F.xxhash64(F.lit(1), "rep"), F.lit(vector_blocks)).cast("int")))
    asking = base.where("asks")
    queries = cut(asking.groupBy("v").agg(F.min("id").alias("q")).select("q", "v"))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def visits(lo: int, hi: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, directions = plan.value
            for b in batches:
                v = _doubles(column(b, "v")).reshape(-1, dims)
                p = _unit(v) @ directions
                out: list[tuple[int, int, bytes, float]] = []
                for q, raw, near, x in zip(column(b, "q"), v, column(b, "bound"), p, strict=True):
                    d = tree.distances(x)
                    order = np.lexsort((np.arange(len(d)), d))[lo:hi]
                    out += [(int(leaf), q, raw.tobytes(), near) for leaf in order if d[leaf] <= near * bound]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.float64()))], names=["leaf", "q", "bytes", "bound"])

        return run

    def meet(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        if not vectors.num_rows or not asked.num_rows:
            return empty
        directions = plan.value[1]
        rep = np.array(vectors.column("rep").to_pylist(), np.int64)
        order = np.argsort(rep)  # by id, so that a stable order by score leaves ties to the smaller
        v = _scaled(np.frombuffer(b"".join(vectors.column("bytes").to_pylist()), np.float64).reshape(-1, dims)[order])
        rep = rep[order]
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))
        projected = _unit(v) @ directions
        size = (projected * projected).sum(1)
        got: list[tuple[int, int, float]] = []
        for q, raw, near in zip(*(asked.column(c).to_pylist() for c in ("q", "bytes", "bound")), strict=True):
            x = _scaled(np.frombuffer(raw, np.float64)[None, :])[0]
            p = (_unit(x[None, :]) @ directions)[0]
            far = np.maximum(size + (p * p).sum() - 2 * (projected @ p), 0)
            by_distance = np.argsort(far, kind="stable")
            length = np.sqrt(np.einsum("i,i->", x, x))
            best, scores = np.zeros(0, np.int64), np.zeros(0)
            for at in range(0, len(by_distance), 64):
                some = by_distance[at : at + 64]
                if far[some[0]] > near * bound:  # the chi-square test: enough has been seen
                    break
                best = np.concatenate([best, some])
                scores = np.concatenate([scores, np.einsum("ij,j->i", v[some], x) / (norm[some] * length)])
                keep = np.lexsort((best, -scores))[:wanted]
                best, scores = best[keep], scores[keep]
                if len(best) == wanted:
                    near = min(near, max(2 - 2 * scores[-1], 1e-12))
            got += [(q, int(i), float(s)) for i, s in zip(best, scores, strict=True)]
        ids = vectors.column("ids").to_pylist()
        return pa.table({"q": pa.array([g[0] for g in got], pa.int64()), "rep": pa.array([int(rep[g[1]]) for g in got], pa.int64()), "ids": pa.array([ids[order[g[1]]] for g in got], pa.list_(pa.int64())), "score": pa.array([g[2] for g in got], pa.float64())})

    best = None
    top = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
    for lo, hi in zip(WAVES, WAVES[1:], strict=False):
        if lo >= n_leaves:
            break
        if best is None:
            state = queries.withColumn("bound", F.lit(1e300))
        else:
            last = best.groupBy("q").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
            state = queries.join(last, "q", "left").select("q", "v", F.when(F.col("n") >= wanted, F.greatest(2 - 2 * F.col("least"), F.lit(1e-12))).otherwise(1e300).alias("bound"))
        asked = state.mapInArrow(visits(lo, hi), "leaf int, q long, bytes binary, bound double")
        asked = asked.withColumn("vb", F.explode(F.array(*map(F.lit, range(vector_blocks))))) if vector_blocks > 1 else asked.withColumn("vb", F.lit(0))
        asked = asked.withColumn("qb", F.pmod(F.xxhash64(F.lit(2), "q"), F.lit(query_blocks)).cast("int"))
        offered = placed.withColumn("qb", F.explode(F.array(*map(F.lit, range(query_blocks))))) if query_blocks > 1 else placed.withColumn("qb", F.lit(0))
        new = offered.groupBy("leaf", "vb", "qb").cogroup(asked.groupBy("leaf", "vb", "qb")).applyInArrow(meet, found_schema)
        merged = new if best is None else best.unionByName(new)
        best = cut(merged.withColumn("nth", top).where(F.col("nth") <= wanted).drop("nth"))
    rows = asking.select(F.col("id").alias("query_id"), "v").join(queries, "v").select("query_id", "q")
    answers = rows.join(best.select("q", F.explode("ids").alias("vec_id"), "score"), "q").where("vec_id <> query_id")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
