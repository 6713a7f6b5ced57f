"""Paired significance tests; statistics as aggregates, probabilities from the few numbers they give.

Input: (pair, a, b), one row per paired observation.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.sampling import key, uniform
from rankweave.operators.ordering import ordinals, running_total
from rankweave.session import cut


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Counts of right/right, right/wrong, wrong/right, wrong/wrong outcomes and the chi-square with 1 degree of freedom."""
    n = [F.count_if((F.col("a") == x) & (F.col("b") == y)).alias(name) for name, x, y in (("rr", 1, 1), ("rw", 1, 0), ("wr", 0, 1), ("ww", 0, 0))]
    gap, both = F.col("rw") - F.col("wr"), F.col("rw") + F.col("wr")
    return pairs.agg(*n).withColumn("chi2", F.coalesce(F.try_divide(gap * gap, both), F.lit(0.0)))


def chi2_1_p(chi2: float) -> float:
    return math.erfc(math.sqrt(chi2 / 2))


def paired_t(pairs: DataFrame) -> DataFrame:
    """(n, mean, t) of the differences; t is null without variance."""
    d = F.col("a") - F.col("b")
    out = pairs.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("s"))
    return out.select("n", "mean", F.try_divide(F.col("mean"), F.col("s") / F.sqrt("n")).alias("t"))


def student_p(t: float, n: int) -> float:
    """Two-sided probability of a t value with n-1 degrees of freedom, by the incomplete beta function."""
    df = n - 1
    return _beta(df / 2, 0.5, df / (df + t * t))


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * out / a


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """(n, w_plus, w_minus, w): signed-rank sums of the differences that aren't 0, ties sharing their mean rank.

    Ranks come from the distinct absolute differences with their counts, so that only those are ordered.
    """
    d = pairs.select((F.col("a") - F.col("b")).alias("d")).where("d <> 0")
    sizes = d.groupBy(F.abs("d").alias("m")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    rank = running_total(sizes, "m", "c").withColumn("r", F.col("total") + (F.col("c") + 1) / 2)
    out = rank.agg(F.sum("c").alias("n"), F.sum(F.col("r") * F.col("up")).alias("w_plus"), F.sum(F.col("r") * (F.col("c") - F.col("up"))).alias("w_minus"))
    return out.withColumn("w", F.least("w_plus", "w_minus"))


def wilcoxon_p(w: float, n: int) -> float:
    """Two-sided probability by the normal approximation."""
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24
    return math.erfc(abs(w - mean) / math.sqrt(2 * var)) if var else 1.0


def permutation(pairs: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(observed, hits, p): how often swapping each pair by a fair coin gives as large a difference of means; coins are hashed."""
    d = pairs.select("pair", (F.col("a") - F.col("b")).alias("d"))
    coin = F.when(F.substring(key(seed, F.col("r"), F.col("pair")), 1, 1) < "8", F.col("d")).otherwise(-F.col("d"))
    swapped = d.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).groupBy("r").agg(F.abs(F.avg(coin)).alias("m"))
    observed = d.agg(F.abs(F.avg("d")).alias("observed"))
    out = swapped.crossJoin(F.broadcast(observed)).agg(F.first("observed").alias("observed"), F.count_if(F.round("m", 12) >= F.round("observed", 12)).alias("hits"))
    return out.withColumn("p", (F.col("hits") + 1) / F.lit(rounds + 1))


def bootstrap(pairs: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(observed, hits, p): how often a resample's mean difference is more than twice the observed one; draws are hashed."""
    d = cut(ordinals(pairs.select("pair", (F.col("a") - F.col("b")).alias("d")), "pair", "i").select("i", "d"))
    n = d.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("observed"))
    draws = d.select(F.col("i").alias("slot")).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).crossJoin(F.broadcast(n))
    drawn = draws.withColumn("i", F.floor(uniform(seed, F.col("r"), F.col("slot")) * F.col("n")).cast("int"))
    means = drawn.join(d, "i").groupBy("r").agg(F.avg("d").alias("m"), F.first("observed").alias("observed"))
    out = means.agg(F.first("observed").alias("observed"), F.count_if(F.round("m", 12) > F.round(2 * F.col("observed"), 12)).alias("hits"))
    return out.withColumn("p", F.col("hits") / F.lit(rounds))


def kolmogorov(values: DataFrame, value: str) -> DataFrame:
    """(n, ks): the largest gap between the values' distribution and the normal one of their mean and deviation."""
    stats = values.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    sizes = values.groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(stats))
    z = F.coalesce(F.try_divide(F.col("x") - F.col("mean"), F.col("s")), F.lit(0.0))
    # Abramowitz and Stegun 26.2.17, to 7.5e-8
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    cdf = F.when(z >= 0, 1 - tail).otherwise(tail)
    gaps = running_total(sizes, "x", "c").withColumn("upto", F.col("total") + F.col("c")).select("n", F.greatest(F.abs(F.col("upto") / F.col("n") - cdf), F.abs((F.col("upto") - F.col("c")) / F.col("n") - cdf)).alias("gap"))
    return gaps.agg(F.max("n").alias("n"), F.max("gap").alias("ks"))


def significance(pairs: DataFrame, test: str, rounds: int = 1000, seed: int = 1) -> tuple[float, float]:
    """(p of the test, KS distance of the differences from normality)."""
    normal = kolmogorov(pairs.select((F.col("a") - F.col("b")).alias("d")), "d").first()["ks"]
    if test == "mcnemar":
        p = chi2_1_p(mcnemar(pairs).first()["chi2"])
    elif test == "t":
        r = paired_t(pairs).first()
        p = student_p(r["t"], r["n"]) if r["t"] is not None else 1.0
    elif test == "wilcoxon":
        r = wilcoxon(pairs).first()
        p = wilcoxon_p(r["w"], r["n"]) if r["n"] else 1.0
    elif test in ("permutation", "bootstrap"):
        p = {"permutation": permutation, "bootstrap": bootstrap}[test](pairs, rounds, seed).first()["p"]
    else:
        raise ValueError(f"no test named {test}")
    return float(p), float(normal) if normal is not None else 0.0
