"""Summaries of scores, errors and results."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators.scoring import Pairs


def summary(value: Column, percents: Sequence[int] = (1, 10, 50, 90, 99)) -> list[Column]:
    """Count, least, most, mean, population deviation and exact percentiles of a column."""
    return [
        F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        *[F.percentile(value, F.lit(p / 100)).alias(f"p{p}") for p in percents],
    ]


def quantiles(df: DataFrame, value: str, shares: Sequence[float], bins: int = 4096, few: int = 100_000) -> list[float | None]:
    """Exact quantiles of a column, as Spark's ``percentile`` gives them, in memory that is bounded.

    The wanted ranks lie in ranges of values, at first in the whole one; each pass counts the rows of ``bins``
    parts of them and goes on with those that hold a rank, until ``few`` distinct values can be looked at.
    Nulls do not count, NaN is the largest.
    """
    x = F.col(value).cast("double")
    inf = float("inf")
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)
    n, below, inner, above, low, high = df.agg(F.count(x), F.count_if(x == -inf), F.count_if(fine), F.count_if(x == inf), F.min(F.when(fine, x)), F.max(F.when(fine, x))).first()
    if not n:
        return [None for _ in shares]
    places = [(n - 1) * p for p in shares]
    wanted = sorted({r for at in places for r in (math.floor(at), math.ceil(at))})
    found = {r: -inf if r < below else inf if r < below + inner + above else math.nan for r in wanted if not below <= r < below + inner}
    spans = [(low, high, below, inner)] if len(found) < len(wanted) else []  # (from, to, ranks before, rows)
    while spans:
        open_ = [r for r in wanted if r not in found]
        small = [s for s in spans if s[3] <= few // len(spans) or s[0] == s[1] or (s[1] - s[0]) / bins <= math.ulp(max(abs(s[0]), abs(s[1])))]
        for lo, hi, before, _ in small:
            rows = df.where(fine & (x >= lo) & (x <= hi)).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("c")).collect()
            for v, c in sorted((float(v), c) for v, c in rows):
                found |= {r: v for r in open_ if before <= r < before + c}
                before += c
        spans = [s for s in spans if s not in small]
        if not spans:
            break
        at = None
        for i, (lo, hi, _, _) in enumerate(spans):
            part = F.lit(i * bins) + F.least(F.floor((x - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
            at = F.when((x >= lo) & (x <= hi), part) if at is None else at.when((x >= lo) & (x <= hi), part)
        seen = df.where(fine).select(at.alias("at"), x.alias("v")).where("at is not null").groupBy("at").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        told: dict[int, list] = {}
        for r in sorted(seen, key=lambda r: r["at"]):
            told.setdefault(r["at"] // bins, []).append(r)
        new = []
        for i, (_, _, before, _) in enumerate(spans):
            for r in told.get(i, []):
                if any(before <= w < before + r["c"] for w in open_):
                    new.append((r["lo"], r["hi"], before, r["c"]))
                before += r["c"]
        spans = new
    return [_between(at, found) for at in places]


def _between(at: float, found: dict[int, float]) -> float:
    lo, hi = math.floor(at), math.ceil(at)
    a, b = found[lo], found[hi]
    return a if lo == hi or a == b else (hi - at) * a + (at - lo) * b


def pairs_summary(pairs: Pairs, percents: Sequence[int] = (1, 10, 50, 90, 99), bins: int = 65_536, few: int = 2_000_000) -> DataFrame:
    """``summary`` of the scores of all pairs, of which only those near a percentile leave their tasks.

    Each pass scores them anew: for range and moments, then for the rows of ``bins`` parts of each span of values
    that holds a percentile's ranks, until these spans have ``few`` scores together, whose values are sent, or one
    value each.  Only if scores are not finite, ``quantiles`` of the formed pairs is asked instead.
    """
    spark = pairs.items.sparkSession
    names = ["n", "low", "high", "mean", "std", *(f"p{p}" for p in percents)]
    schema = ", ".join(f"{c} {'long' if c == 'n' else 'double'}" for c in names)
    blocks = pairs.reduced(lambda s: [np.array([x]) for x in (len(s), s.min(), s.max(), s.mean(), ((s - s.mean()) ** 2).sum())], "n long, low double, high double, mean double, m2 double").collect()
    if not blocks:
        return spark.createDataFrame([(0, *[None] * (len(names) - 1))], schema)
    count, lows, highs, means, m2 = (np.array(c) for c in zip(*blocks, strict=True))
    n, low, high = int(count.sum()), float(lows.min()), float(highs.max())
    if not math.isfinite(high - low):
        rows = pairs.rows()
        return rows.agg(*summary(F.col("score"), ())).select("*", *[F.lit(q).cast("double").alias(c) for c, q in zip(names[5:], quantiles(rows, "score", [p / 100 for p in percents]), strict=True)])
    mean = float((means * count).sum() / n)
    std = math.sqrt(float((m2 + count * (means - mean) ** 2).sum()) / n)

    places = [(n - 1) * p / 100 for p in percents]
    open_ = sorted({r for at in places for r in (math.floor(at), math.ceil(at))})
    found: dict[int, float] = {}
    spans = [(low, high, 0, n)]  # (from, to, ranks before, rows)
    while open_:
        for lo, hi, before, c in spans:
            found |= {r: lo for r in open_ if lo == hi and before <= r < before + c}
        open_ = [r for r in open_ if r not in found]
        spans = [s for s in spans if s[0] < s[1] and any(s[2] <= r < s[2] + s[3] for r in open_)]
        if open_ and sum(s[3] for s in spans) <= few:
            got = np.sort(pairs.reduced(lambda s, spans=spans: [np.concatenate([s[(s >= lo) & (s <= hi)] for lo, hi, _, _ in spans])], "v double").toArrow().column(0).to_numpy())
            for lo, _, before, c in spans:
                start = int(np.searchsorted(got, lo)) - before
                found |= {r: float(got[start + r]) for r in open_ if before <= r < before + c}
            break
        if open_:
            spans = _divided(pairs, spans, bins)
    values = [_between(at, found) for at in places]
    return spark.createDataFrame([(n, low, high, mean, std, *values)], schema)


def _divided(pairs: Pairs, spans: list[tuple[float, float, int, int]], bins: int) -> list[tuple[float, float, int, int]]:
    """The parts that have scores of each span, from their least to their largest one."""

    def counted(s: np.ndarray) -> list[np.ndarray]:
        s = np.sort(s)
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        for i, (lo, hi, _, _) in enumerate(spans):
            v = s[np.searchsorted(s, lo) : np.searchsorted(s, hi, side="right")]
            if len(v):
                at = np.minimum((v - lo) / (hi - lo) * bins, bins - 1).astype(np.int64) + i * bins
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                last = np.append(first[1:], len(v))
                got.append((at[first], last - first, v[first], v[last - 1]))
        return [np.concatenate(c) for c in zip(*got, strict=True)]

    told = pairs.reduced(counted, "at long, c long, lo double, hi double").groupBy("at").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    out, i, before = [], -1, 0
    for r in sorted(told, key=lambda r: r["at"]):
        if r["at"] // bins != i:
            i = r["at"] // bins
            before = spans[i][2]
        out.append((r["lo"], r["hi"], before, r["c"]))
        before += r["c"]
    return out


def mean_std_median(value: str, name: str | None = None) -> list[Column]:
    name = name or value
    return [F.avg(value).alias(f"{name}_mean"), F.stddev_pop(value).alias(f"{name}_std"), F.percentile(value, F.lit(0.5)).alias(f"{name}_p50")]


def macro_micro(results: DataFrame, domain: str, value: str) -> DataFrame:
    """(macro, micro, n): the mean over domains of the domains' means, and the mean over rows."""
    by = results.groupBy(domain).agg(F.avg(value).alias("v"), F.count(value).alias("n"))
    return by.agg(F.avg("v").alias("macro"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("micro"), F.sum("n").alias("n"))


def by_domain_and_all(results: DataFrame, domain: str, value: str) -> DataFrame:
    """(domain, mean, n) of each domain and, with ``all``, of all rows, in one pass."""
    out = results.groupingSets([[domain], []], domain).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping(domain).alias("g"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col(domain)).alias("domain"), "mean", "n")


def mean_over(results: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The mean over what the keys leave out, such as seeds."""
    return results.groupBy(*keys).agg(F.avg(value).alias(value))


def errors(pairs: DataFrame, *by: str) -> DataFrame:
    """Of exact and approximate scores: L1, mean absolute, mean relative and mean absolute relative error, Frobenius norm."""
    d = F.col("approx") - F.col("exact")
    relative = F.try_divide(d, F.col("exact"))
    return pairs.groupBy(*by).agg(F.sum(F.abs(d)).alias("l1"), F.avg(F.abs(d)).alias("mean_abs"), F.avg(relative).alias("mean_pct"), F.avg(F.abs(relative)).alias("mean_abs_pct"), F.sqrt(F.sum(d * d)).alias("frobenius"))


def infinity_norm(pairs: DataFrame) -> DataFrame:
    """The largest row sum of absolute errors."""
    rows = pairs.groupBy("query_id").agg(F.sum(F.abs(F.col("approx") - F.col("exact"))).alias("s"))
    return rows.agg(F.max("s").alias("infinity"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) over equal bins; the last one holds its upper end too."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cost_buckets(results: DataFrame, edges: Sequence[float], cost: str = "cost", value: str = "value", *keys: str) -> DataFrame:
    """The best value within each cost range ``(lo, hi]``, and the cheapest cost that gives it."""
    ranges = results.sparkSession.createDataFrame([(float(a), float(b)) for a, b in zip(edges, edges[1:], strict=False)], "lo double, hi double")
    joined = results.join(F.broadcast(ranges), (F.col(cost) > F.col("lo")) & (F.col(cost) <= F.col("hi")))
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(cost)).alias("c")))
    return joined.groupBy(*keys, "lo", "hi").agg(best.alias("b")).select(*keys, "lo", "hi", F.col("b.v").alias("best"), (-F.col("b.c")).alias("at_cost"))


def best_by(results: DataFrame, keys: list[str], value: str, argument: str) -> DataFrame:
    """The largest value of each key with its argument, the smaller one on ties."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(argument)).alias("a")))
    return results.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.v").alias(value), (-F.col("b.a")).alias(argument))


def embedding_variation(vectors: DataFrame, group: str, vector: str = "e") -> DataFrame:
    """(group, n, mean_dot, std_dot): how each group's vectors project on their mean vector."""
    cells = vectors.select("id", group, F.posexplode(vector).alias("pos", "x"))
    mean = cells.groupBy(group, "pos").agg(F.avg("x").alias("m"))
    dots = cells.join(mean, [group, "pos"]).groupBy("id", group).agg(F.sum(F.col("x") * F.col("m")).alias("d"))
    return dots.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_dot"), F.stddev_pop("d").alias("std_dot"))


def compare_systems(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Summary of the per-query difference of two systems."""
    d = a.select("query_id", F.col(value).alias("a")).join(b.select("query_id", F.col(value).alias("b")), "query_id").select((F.col("a") - F.col("b")).alias("d"))
    return d.agg(*[c for c in summary(F.col("d"), (10, 50, 90))])
