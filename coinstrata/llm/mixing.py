"""Mixing sources to target weights, with DataFrame functions only.

Iterative proportional fitting rakes the token weights of (source, language, topic) cells until their marginals are
the targets; documents are then drawn by a probability per cell, calibrated so that the expected number of tokens is
the budget: a cell never gives more than all its documents, and what it cannot give the others give in proportion.

Documents carry no topic, so ``topic`` is a column expression of the caller; the default is a form, read from the
whole text. Tokens are estimated as a fourth of the UTF-8 bytes, at least 1, unless the caller has a better column.

Defined results: null and empty sources, languages and texts count as the empty string; targets for values that no
document has are ignored and the rest rescaled; values without a target get weight 0 and are never drawn; repeated
rows share their fate, as the draw is a hash of doc_id (a null id hashes as the empty text); an empty table gives an
empty result; ``mix`` returns exactly the columns of its input, which may have any names; long texts count as one
document each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, saved

DIMENSIONS = ("source", "lang", "topic")
#: Exponents that temper each marginal: 1 keeps it, 0 makes it uniform.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Rounds at most, the deviation of a factor from 1 at which they end, and rounds in one job.
ROUNDS, TOLERANCE, SWEEPS = 40, 1e-9, 4
BUDGET_SHARE, SEED = 0.5, "mix-1"
#: How far from the caller's target shares a fit may end.
ACCEPT = 0.01


def form_topic() -> Column:
    size = F.length(F.coalesce("text", F.lit("")))
    return F.when(size < 400, "note").when(size < 2000, "short").when(size < 10000, "article").otherwise("long")


def estimated_tokens() -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4)).cast("long")


def keys_of(topic: Column | None = None, tokens: Column | None = None) -> dict[str, Column]:
    """What a document is mixed by: source, lang, topic and tokens. A missing number of tokens counts as one."""
    blank = F.lit("")
    return {
        "source": F.coalesce(F.col("source").cast("string"), blank),
        "lang": F.coalesce(F.col("lang").cast("string"), blank),
        "topic": F.coalesce((form_topic() if topic is None else topic).cast("string"), blank),
        "tokens": estimated_tokens() if tokens is None else F.greatest(F.lit(1), F.coalesce(tokens, F.lit(1))).cast("long"),
    }


def cells_of(docs: DataFrame, topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """source, lang, topic, tokens, docs: one row for each cell that has documents. Sums are taken before the shuffle."""
    named = docs.select(*(c.alias(k) for k, c in keys_of(topic, tokens).items()))
    return named.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))


def tempered_target(cells: DataFrame, dimension: str, exponent: float) -> DataFrame:
    """value, target: shares of tokens to the power ``exponent``; an unnormalised target is rescaled by ``rake``."""
    return cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(exponent)).alias("target"))


def deviation(raked: DataFrame, targets: dict[str, DataFrame]) -> dict[str, float]:
    """By dimension, the largest distance between a value's share of the weights and its target share."""
    total = raked.agg(F.sum("weight")).first()[0] or 1.0
    out = {}
    for d, t in targets.items():
        have = raked.groupBy(F.col(d).alias("value")).agg((F.sum("weight") / total).alias("has"))
        met = have.join(t.select("value", "target"), "value", "left")
        all_targets = met.agg(F.sum("target").alias("_all"))
        gap = F.abs(F.col("has") - F.coalesce(F.col("target"), F.lit(0.0)) / F.col("_all"))
        out[d] = met.join(F.broadcast(all_targets)).agg(F.max(gap)).first()[0] or 0.0
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with weight: token shares whose marginals are the targets, as near as the cells allow."""
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d, t in targets.items():
        present = t.join(cells.select(F.col(d).alias("value")).distinct(), "value")
        total = present.agg(F.sum("target").alias("_all"))
        share = present.join(F.broadcast(total)).select(F.col("value").alias(d), (F.col("target") / F.col("_all")).alias(f"_target_{d}"))
        now = saved(now.join(share, d, "left"), "raked")
    for _ in range(0, rounds, SWEEPS):
        for _ in range(SWEEPS):
            off = F.lit(0.0)
            for d in targets:
                # cells, not documents, meet here: one for each source, language and topic that occur together
                total = F.sum("weight").over(Window.partitionBy(d))
                ratio = F.when(F.col("_sum") > 0, F.coalesce(f"_target_{d}", F.lit(0.0)) / F.col("_sum")).otherwise(0.0)
                now = now.withColumn("_sum", total).withColumn(f"_off_{d}", F.abs(ratio - 1)).withColumn("weight", F.col("weight") * ratio).drop("_sum")
                off = F.greatest(off, f"_off_{d}")
            now = now.withColumn("_off", F.when(F.col("weight") > 0, off).otherwise(0.0)).drop(*(f"_off_{d}" for d in targets))
        now = saved(now, "raked")
        worst = now.agg(F.max("_off")).first()[0]
        now = now.drop("_off")
        if worst is None or worst < tolerance:
            break
    return now.drop(*(f"_target_{d}" for d in targets))


def calibrated(raked: DataFrame, budget_share: float = BUDGET_SHARE) -> DataFrame:
    """``raked`` with prob: min(1, f * weight / tokens), f such that the expected tokens are the budget where possible."""
    most = raked.agg(F.sum("tokens"), F.sum(F.when(F.col("weight") > 0, F.col("tokens")))).first()
    budget = min((most[0] or 0) * budget_share, most[1] or 0)
    factor, full = 0.0, -1
    while most[0]:
        capped = F.lit(factor) * F.col("weight") >= F.col("tokens")
        state = raked.agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0)), F.sum(F.when(~capped, F.col("weight")).otherwise(0.0)), F.count_if(capped)).first()
        if state[2] == full or not state[1]:
            break
        full = state[2]
        factor = (budget - state[0]) / state[1]
    prob = F.least(F.lit(1.0), F.lit(factor) * F.col("weight") / F.col("tokens"))
    return saved(raked.withColumn("prob", F.greatest(F.lit(0.0), prob)), "calibrated")


def uniform(seed: str = SEED) -> Column:
    """A number in [0, 1) that is a hash of doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def probabilities(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget_share: float = BUDGET_SHARE, topic: Column | None = None, tokens: Column | None = None, accept: float | None = None
) -> DataFrame:
    """source, lang, topic, tokens, docs, weight, prob of each cell.

    Targets (value, target for a dimension) that the cells cannot meet together raise ValueError if a share is off by
    more than ``accept`` (default ACCEPT for the caller's targets). The tempered targets that are made without any are
    met as near as the cells allow, unless ``accept`` says how near.
    """
    cells = saved(cells_of(docs, topic, tokens), "cells")
    goals = targets or {d: tempered_target(cells, d, TEMPER[d]) for d in DIMENSIONS}
    raked = rake(cells, goals)
    most = ACCEPT if accept is None and targets else accept
    if most is not None:
        off = {d: x for d, x in deviation(raked, goals).items() if x > most}
        if off:
            raise ValueError("targets cannot be met together; shares are off by " + ", ".join(f"{x:.3f} in {d}" for d, x in off.items()))
    return calibrated(raked, budget_share)


def weighed(docs: DataFrame, cells: DataFrame, seed: str = SEED, topic: Column | None = None, tokens: Column | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns for source, lang, topic, tokens, weight, prob and kept, and the names that these have, which
    no column of ``docs`` has. Spark broadcasts the cells while they are small."""
    names = {k: free_name(f"_mix_{k}", docs) for k in (*DIMENSIONS, "tokens", "weight", "prob", "kept")}
    own = docs.withColumns({names[k]: c for k, c in keys_of(topic, tokens).items()})
    joined = own.join(cells.select(*(F.col(k).alias(names[k]) for k in (*DIMENSIONS, "weight", "prob"))), [names[d] for d in DIMENSIONS], "left")
    return joined.withColumn(names["kept"], uniform(seed) < F.col(names["prob"])), names


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget_share: float = BUDGET_SHARE, seed: str = SEED, topic: Column | None = None, tokens: Column | None = None, accept: float | None = None
) -> DataFrame:
    """The documents drawn, with the columns of ``docs``. See ``probabilities`` for the targets."""
    found, names = weighed(docs, probabilities(docs, targets, budget_share, topic, tokens, accept), seed, topic, tokens)
    return found.filter(names["kept"]).select(*docs.columns)
