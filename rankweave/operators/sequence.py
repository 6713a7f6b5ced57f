"""Decoding of token probabilities (pos, token, p), and labels scored by them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy(probs: DataFrame, *by: str) -> DataFrame:
    """(by, tokens, log_p): the likeliest token of each place, the smaller one on ties."""
    best = probs.groupBy(*by, "pos").agg(F.max(F.struct(F.col("p"), (-F.col("token")).alias("t"))).alias("b"))
    return best.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (-F.col("b.t")).alias("t")))), lambda x: x["t"]).alias("tokens"), F.sum(F.log("b.p")).alias("log_p"))


def label_scores(probs: DataFrame, labels: DataFrame, *by: str) -> DataFrame:
    """(by, item_id, score): the sum over places of the log probability of each label's tokens."""
    tokens = labels.select("item_id", F.posexplode("ids").alias("pos", "token"))
    return probs.join(tokens, ["pos", "token"]).groupBy(*by, "item_id").agg(F.sum(F.log("p")).alias("score"))


def allowed_tokens(labels: DataFrame) -> DataFrame:
    """(pos, tokens): the distinct tokens that any label has at a place."""
    return labels.select(F.posexplode("ids").alias("pos", "token")).groupBy("pos").agg(F.sort_array(F.collect_set("token")).alias("tokens"))


def token_pairs(labels: DataFrame) -> DataFrame:
    """(pos, token, before): the tokens that precede a token at a place, one for each label."""
    flat = F.filter(F.transform(F.sequence(F.lit(2), F.greatest(F.size("ids"), F.lit(2))), lambda i: F.struct(i.alias("pos"), F.try_element_at("ids", i).alias("token"), F.try_element_at("ids", i - 1).alias("before"))), lambda x: x["token"].isNotNull())
    return labels.select(F.explode(flat).alias("x")).select((F.col("x.pos") - 1).alias("pos"), "x.token", "x.before").groupBy("pos", "token").agg(F.sort_array(F.collect_list("before")).alias("before"))


def viterbi(probs: DataFrame, pairs: DataFrame, by: str) -> DataFrame:
    """(by, tokens, log_p): the likeliest sequence in which every token follows one that it may follow."""
    allowed = {(r["pos"], r["token"]): sorted(set(r["before"])) for r in pairs.collect()}
    sent = probs.sparkSession.sparkContext.broadcast(allowed)
    kind = probs.schema[by].dataType.simpleString()

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        import math

        allowed = sent.value
        best: dict[int, tuple[float, list[int]]] = {}
        for step, (pos, rows) in enumerate(sorted(pdf.groupby("pos"))):
            new: dict[int, tuple[float, list[int]]] = {}
            for token, p in sorted(zip(rows["token"], rows["p"], strict=True)):
                if p <= 0:
                    continue
                if step == 0:
                    new[token] = (math.log(p), [int(token)])
                    continue
                come = [(best[b][0], -b) for b in allowed.get((pos, token), ()) if b in best]
                if come:
                    s, b = max(come)
                    new[token] = (s + math.log(p), [*best[-b][1], int(token)])
            best = new
        score, tokens = max(((s, t) for s, t in best.values()), key=lambda x: (x[0], [-y for y in x[1]]), default=(None, []))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "tokens": [tokens], "log_p": [score]})

    return probs.select(by, "pos", "token", "p").groupBy(by).applyInPandas(decode, f"`{by}` {kind}, tokens array<long>, log_p double")
