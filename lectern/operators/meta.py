"""Meta-analysis: effect sizes, random effects, heterogeneity, bias, sensitivity.

Each estimate is a pair of grouped aggregations: sums of weights first, then
what depends on them.  Nothing is collected, whatever the number of studies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.folders import cut

Z = 1.96


def d_from_r(r: Column) -> Column:
    return 2 * r / F.sqrt(1 - r * r)


def r_from_d(d: Column) -> Column:
    return d / F.sqrt(d * d + 4)


def d_from_odds_ratio(odds: Column) -> Column:
    return F.ln(odds) * F.lit(math.sqrt(3) / math.pi)


def random_effects(studies: DataFrame, by: str) -> DataFrame:
    """DerSimonian-Laird estimate of each group from (effect, se) rows.

    k, q, tau2, i2, pooled, se, its interval, z, the fixed-effect estimate and
    the prediction interval (null below 3 studies; its quantile is the
    normal one).
    """
    s = studies.withColumn("w", 1 / (F.col("se") * F.col("se")))
    fixed = s.groupBy(by).agg(F.count("*").alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("effect")).alias("swd"), F.sum(F.col("w") * F.col("effect") * F.col("effect")).alias("swdd"), F.sum(F.col("w") * F.col("w")).alias("sww"))
    fixed = fixed.withColumn("q", F.greatest(F.col("swdd") - F.col("swd") * F.col("swd") / F.col("sw"), F.lit(0.0)))
    c = F.col("sw") - F.col("sww") / F.col("sw")
    excess = F.col("q") - (F.col("k") - 1)
    fixed = fixed.withColumn("tau2", F.when((F.col("k") > 1) & (c > 0), F.greatest(F.lit(0.0), excess / c)).otherwise(0.0))
    fixed = fixed.withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), excess / F.col("q"))).otherwise(0.0))
    fixed = fixed.withColumn("fixed", F.col("swd") / F.col("sw"))
    one = s.select(by, "effect", "se").join(fixed.select(by, "tau2"), by).withColumn("w", 1 / (F.col("se") * F.col("se") + F.col("tau2")))
    pooled = one.groupBy(by).agg((F.sum(F.col("w") * F.col("effect")) / F.sum("w")).alias("pooled"), F.sqrt(1 / F.sum("w")).alias("pooled_se"))
    x = fixed.select(by, "k", "q", "tau2", "i2", "fixed").join(pooled, by)
    spread = Z * F.sqrt(F.col("tau2") + F.col("pooled_se") * F.col("pooled_se"))
    level = F.when(F.col("i2") < 0.25, "low").when(F.col("i2") < 0.5, "moderate").when(F.col("i2") < 0.75, "substantial").otherwise("considerable")
    return x.select(
        "*",
        (F.col("pooled") - Z * F.col("pooled_se")).alias("low"),
        (F.col("pooled") + Z * F.col("pooled_se")).alias("high"),
        (F.col("pooled") / F.col("pooled_se")).alias("z"),
        F.when(F.col("k") >= 3, F.col("pooled") - spread).alias("predict_low"),
        F.when(F.col("k") >= 3, F.col("pooled") + spread).alias("predict_high"),
        level.alias("heterogeneity"),
    )


def between_groups(studies: DataFrame, by: str) -> DataFrame:
    """Q between subgroups: how far the groups' fixed estimates lie apart, and its degrees of freedom."""
    s = studies.withColumn("w", 1 / (F.col("se") * F.col("se")))
    g = s.groupBy(by).agg(F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("effect")) / F.sum("w")).alias("m"))
    return g.agg(
        (F.count("*") - 1).alias("df"),
        F.greatest(F.sum(F.col("w") * F.col("m") * F.col("m")) - F.sum(F.col("w") * F.col("m")) * F.sum(F.col("w") * F.col("m")) / F.sum("w"), F.lit(0.0)).alias("q_between"),
    )


def leave_one_out(studies: DataFrame, by: str) -> DataFrame:
    """Each study with the fixed estimate of its group without it (null for a group of one)."""
    s = studies.withColumn("w", 1 / (F.col("se") * F.col("se")))
    own = W.partitionBy(by)
    rest_w = F.sum("w").over(own) - F.col("w")
    rest_wd = F.sum(F.col("w") * F.col("effect")).over(own) - F.col("w") * F.col("effect")
    return s.withColumn("without", F.when(F.count("*").over(own) > 1, rest_wd / rest_w)).drop("w")


def egger(studies: DataFrame, by: str) -> DataFrame:
    """Egger's regression of effect / se on 1 / se: intercept, slope, the intercept's t value."""
    s = studies.select(by, (F.col("effect") / F.col("se")).alias("y"), (1 / F.col("se")).alias("x"))
    g = s.groupBy(by).agg(F.count("*").alias("k"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.avg("x").alias("mx"))
    residual = (F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")) / (F.col("k") - 2)
    error = F.sqrt(residual * (1 / F.col("k") + F.col("mx") * F.col("mx") / F.col("sxx")))
    return g.select(by, "k", "slope", "intercept", F.when((F.col("k") > 2) & (F.col("sxx") > 0), F.try_divide(F.col("intercept"), error)).alias("t"))


def meta_regression(studies: DataFrame, by: str, moderator: str) -> DataFrame:
    """Weighted least squares of the effect on a moderator, by group."""
    w = 1 / (F.col("se") * F.col("se"))
    m, y = F.col(moderator), F.col("effect")
    g = studies.groupBy(by).agg(F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * m).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * m * m).alias("sxx"), F.sum(w * m * y).alias("sxy"))
    slope = F.try_divide(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return g.select(by, "k", slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("sw")).alias("intercept"))


def trim_and_fill(studies: DataFrame, by: str, rounds: int = 5) -> DataFrame:
    """Duval and Tweedie's estimate (L0) of the studies missing on the left, by group.

    Each round ranks the distances from the current centre, estimates the
    number of missing studies, and takes the centre anew without as many of
    the largest effects.  Distances equal to 9 places tie.  Rounds go on until no group's number changes, or
    repeats an earlier one (the centre follows from the number alone, so a
    group that doesn't settle is in a cycle; it stays there, and ``converged`` is
    false for it).
    The state is checkpointed after each round, which keeps the plan bounded,
    and tested after each ``rounds`` rounds.
    """
    s = studies.select(by, "effect", (1 / (F.col("se") * F.col("se"))).alias("w"))
    s = s.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.col("effect").desc(), "w")))
    n = s.groupBy(by).agg(F.count("*").alias("k"))
    centre = s.groupBy(by).agg((F.sum(F.col("w") * F.col("effect")) / F.sum("w")).alias("centre"), F.lit(0).cast("bigint").alias("missing")).join(n, by)
    centre = centre.withColumn("seen", F.array("missing")).withColumn("stable", F.lit(False)).withColumn("cycle", F.lit(False))
    while True:
        for _ in range(max(rounds, 1)):
            x = s.join(centre, by).withColumn("gap", F.round(F.col("effect") - F.col("centre"), 9))
            x = x.withColumn("place", F.rank().over(W.partitionBy(by).orderBy(F.abs("gap"))))
            t = x.groupBy(by, "k").agg(F.sum(F.when(F.col("gap") > 0, F.col("place")).otherwise(0)).alias("t"))
            l0 = F.greatest(F.lit(0), F.round((4 * F.col("t") - F.col("k") * (F.col("k") + 1)) / (2 * F.col("k") - 1))).cast("bigint")
            missing = t.select(by, F.least(l0, F.col("k") - 1).alias("missing"))
            kept = s.join(missing, by).where(F.col("_r") > F.col("missing"))
            now = kept.groupBy(by).agg((F.sum(F.col("w") * F.col("effect")) / F.sum("w")).alias("_c"), F.first("missing").alias("_m"))
            stable = F.col("_m") == F.col("missing")
            cycle = F.col("cycle") | (~stable & F.array_contains("seen", F.col("_m")))
            centre = centre.join(now, by).select(by, F.when(F.col("cycle"), F.col("centre")).otherwise(F.col("_c")).alias("centre"), F.when(F.col("cycle"), F.col("missing")).otherwise(F.col("_m")).alias("missing"), "k", F.array_union("seen", F.array("_m")).alias("seen"), stable.alias("stable"), cycle.alias("cycle"))
            centre = cut(centre)
        if centre.where("NOT stable AND NOT cycle").isEmpty():
            return centre.select(by, "k", "missing", F.col("centre").alias("adjusted"), F.col("stable").alias("converged"))
