"""Distribution summaries, fits and tests.

Scores are small whole numbers, so everything starts from a table of score
counts (by season, by day, ...) that is built with one partial aggregation and
stays tiny at any scale.  Sums are exact integers; the closed forms run on it.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clubspark.functions import columns as C
from clubspark.functions.tdist import t_critical_95, t_two_sided_p
from clubspark.operators.ranking import first_rounds
from clubspark.operators.reports import score_counts
from clubspark.operators.reshape import convert_units

# Box-plot whisker length, course par (shift of the moment sums),
# 0.975 quantile of the normal distribution.
WHISKER = 1.5
PAR = 72
Z_975 = 1.959963984540054

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- box plots -------------------------------------------------------------


def _fenced(counts: DataFrame, *keys: str) -> DataFrame:
    """Score counts with the quartiles and whisker limits of their group.

    The windows run over distinct scores, a few hundred rows.
    """
    group = Window.partitionBy(*keys)
    q = F.percentile(F.col("score"), [0.25, 0.5, 0.75], F.col("n")).over(group)
    step = (F.col("_q")[2] - F.col("_q")[0]) * WHISKER
    return counts.withColumn("_q", q).select(
        *counts.columns,
        F.col("_q")[0].alias("q25"),
        F.col("_q")[1].alias("q50"),
        F.col("_q")[2].alias("q75"),
        (F.col("_q")[0] - step).alias("_lo"),
        (F.col("_q")[2] + step).alias("_hi"),
    )


def _box(counts: DataFrame, *keys: str) -> DataFrame:
    inside = F.col("score").between(F.col("_lo"), F.col("_hi"))
    return _fenced(counts, *keys).groupBy(*keys, "q25", "q50", "q75").agg(
        F.min(F.when(inside, F.col("score"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("score"))).alias("upper_whisker"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).cast("bigint").alias("outliers"),
    )


def box_by_season(rounds: DataFrame) -> DataFrame:
    """Quartiles, whiskers and outlier count per season."""
    counts = rounds.groupBy(C.season(F.col("round_date")).alias("season"), "score").agg(F.count(F.lit(1)).alias("n"))
    return _box(counts, "season")


def box_overall(rounds: DataFrame) -> DataFrame:
    return _box(score_counts(rounds))


def score_outliers(rounds: DataFrame) -> DataFrame:
    """The rounds whose score lies outside the whiskers of all scores."""
    limits = _fenced(score_counts(rounds)).agg(F.struct(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"))).scalar()
    return rounds.where((F.col("score") < limits["lo"]) | (F.col("score") > limits["hi"]))


# --- distribution ----------------------------------------------------------


def score_ecdf(rounds: DataFrame) -> DataFrame:
    """Share and cumulated share of each score; the window runs over distinct scores."""
    counts = score_counts(rounds)
    upto = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    return counts.select(
        "score",
        "n",
        (F.col("n") / F.sum("n").over(everything)).alias("share"),
        (F.sum("n").over(upto) / F.sum("n").over(everything)).alias("cumulated"),
    )


def _power_sum(power: int, weight: Column) -> Column:
    """Sum of weight * (score - par)**power, as double for the fourth powers of huge tables."""
    d = (F.col("score") - PAR).cast("double")
    return F.sum(weight * F.pow(d, F.lit(power)))


def _moments(weight: Column) -> list[Column]:
    return [F.sum(weight).cast("double").alias("n"), *[_power_sum(k, weight).alias(f"s{k}") for k in (1, 2, 3, 4)]]


def _central(n: Column) -> tuple[Column, Column, Column, Column]:
    """(mean shift, m2, m3, m4) from shifted power sums."""
    a, b, c, d = (F.col(f"s{k}") / n for k in (1, 2, 3, 4))
    m2 = b - a * a
    m3 = c - a * b * 3 + a * a * a * 2
    m4 = d - a * c * 4 + a * a * b * 6 - a * a * a * a * 3
    return a, m2, m3, m4


def _shape(n: Column, m2: Column, m3: Column, m4: Column) -> tuple[Column, Column]:
    """Skewness and kurtosis corrected for the sample size (normal: 0 and 3)."""
    skew = m3 / F.pow(m2, F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / (m2 * m2) - (n - 1) * 3) + 3
    return skew, kurt


def describe_distribution(rounds: DataFrame) -> DataFrame:
    """Min, max, median, mean, sd, skewness and kurtosis of the scores."""
    weight = F.col("n")
    row = score_counts(rounds).agg(
        *_moments(weight),
        F.min("score").alias("lo"),
        F.max("score").alias("hi"),
        F.percentile(F.col("score"), 0.5, F.col("n")).alias("median"),
    )
    n = F.col("n")
    shift, m2, m3, m4 = _central(n)
    skew, kurt = _shape(n, m2, m3, m4)
    return row.select(
        F.col("lo").alias("min"),
        F.col("hi").alias("max"),
        "median",
        (shift + PAR).alias("mean"),
        F.sqrt(m2 * n / (n - 1)).alias("sd"),
        skew.alias("skewness"),
        kurt.alias("kurtosis"),
    )


def _poisson_inverse(mean: float, u: np.ndarray) -> np.ndarray:
    """The least k whose cumulated Poisson probability reaches u; terms beyond 12 sd are nothing.

    The list of terms grows with the root of the mean.
    """
    width = 12 * math.sqrt(mean) + 20
    low = max(0, math.floor(mean - width))
    k = np.arange(low, math.ceil(mean + width) + 1, dtype=float)
    logs = np.concatenate([[0.0], np.cumsum(np.log(mean / k[1:]))])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return low + np.minimum(np.searchsorted(upto / upto[-1], u), len(k) - 1)


def bootstrap_moments(rounds: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(replicate, skewness, kurtosis) of resampled scores; rounds without a score are left out.

    Resampling n rounds with replacement is drawn on the score counts: each
    count is replaced by Poisson draws of that mean.  The work is replicates
    times distinct scores, whatever the number of rounds.  A draw inverts the distribution at
    60 bits of an MD5 of seed, score and replicate, so that another engine draws the same.
    """

    @F.pandas_udf("array<bigint>")
    def draws(score: pd.Series, n: pd.Series) -> pd.Series:
        def one(s: int, mean: int) -> np.ndarray:
            bits = (hashlib.md5(f"{seed}:{s}:{r}".encode()).hexdigest()[:15] for r in range(1, replicates + 1))
            return _poisson_inverse(mean, np.array([int(b, 16) / 2.0**60 for b in bits]))

        return pd.Series([one(s, m) for s, m in zip(score, n)])

    weighted = score_counts(rounds.where(F.col("score").isNotNull())).select("score", F.posexplode(draws("score", "n")).alias("replicate", "w"))
    moments = weighted.groupBy("replicate").agg(*_moments(F.col("w")))
    n = F.col("n")
    _, m2, m3, m4 = _central(n)
    skew, kurt = _shape(n, m2, m3, m4)
    return moments.select((F.col("replicate") + 1).alias("replicate"), skew.alias("skewness"), kurt.alias("kurtosis"))


def fit_normal(rounds: DataFrame) -> DataFrame:
    """Maximum-likelihood normal fit with standard errors and information criteria."""
    row = score_counts(rounds).agg(*_moments(F.col("n")))
    n = F.col("n")
    shift, m2, _, _ = _central(n)
    loglik = -n / 2 * (F.log(m2 * (2 * math.pi)) + 1)
    return row.select(
        n.cast("bigint").alias("n"),
        (shift + PAR).alias("mean"),
        F.sqrt(m2).alias("sd"),
        F.sqrt(m2 / n).alias("mean_se"),
        F.sqrt(m2 / (n * 2)).alias("sd_se"),
        loglik.alias("loglik"),
        (F.lit(4.0) - loglik * 2).alias("aic"),
        (F.log(n) * 2 - loglik * 2).alias("bic"),
    )


def fit_poisson(rounds: DataFrame) -> DataFrame:
    """Maximum-likelihood Poisson fit; ln(x!) is summed once per distinct score."""
    log_factorial = F.aggregate(
        F.when(F.col("score") >= 1, F.sequence(F.lit(1), F.col("score"))).otherwise(F.array().cast("array<int>")),
        F.lit(0.0),
        lambda total, x: total + F.log(x.cast("double")),
    )
    row = (
        score_counts(rounds)
        .withColumn("lf", log_factorial)
        .agg(
            F.sum("n").cast("double").alias("n"),
            F.sum(F.col("n") * F.col("score")).cast("double").alias("s"),
            F.sum(F.col("n") * F.col("lf")).alias("lf"),
        )
    )
    n, lam = F.col("n"), F.col("s") / F.col("n")
    loglik = F.col("s") * F.log(lam) - F.col("s") - F.col("lf")
    return row.select(
        n.cast("bigint").alias("n"),
        lam.alias("lambda"),
        F.sqrt(lam / n).alias("lambda_se"),
        loglik.alias("loglik"),
        (F.lit(2.0) - loglik * 2).alias("aic"),
        (F.log(n) - loglik * 2).alias("bic"),
    )


def fit_compare(rounds: DataFrame) -> DataFrame:
    """Both families, best log-likelihood first."""
    cols = ["loglik", "aic", "bic"]
    both = (
        fit_normal(rounds)
        .select(F.lit("normal").alias("family"), *cols)
        .union(fit_poisson(rounds).select(F.lit("poisson").alias("family"), *cols))
    )
    return both.orderBy(F.col("loglik").desc())


# --- tests -----------------------------------------------------------------


def _day_tests() -> list[tuple[str, Column, Column]]:
    """(name, first group, second group) of the tests that depend on the day only."""
    rain, wind, temp, day = (F.col(c) for c in ("precipitation", "wind_speed", "avg_temp", "dow"))
    return [
        ("rain", rain == 0, rain > 0),
        ("wind_15", wind <= 15, wind > 15),
        ("wind_10", wind <= 10, wind > 10),
        ("wind_5", wind <= 5, wind > 5),
        ("combined", (wind <= 5) & (rain == 0) & (temp > 60), (wind > 5) & (rain > 0) & (temp <= 60)),
        ("temperature", temp >= 60, temp < 60),
        ("weekend", day >= 5, day < 5),
    ]


EXPERIENCED = 10


def _sums(weight: Column) -> list[Column]:
    s = F.col("score").cast("bigint")
    return [
        F.coalesce(F.sum(weight), F.lit(0)).cast("bigint").alias("n"),
        F.coalesce(F.sum(weight * s), F.lit(0)).cast("bigint").alias("s"),
        F.coalesce(F.sum(weight * s * s), F.lit(0)).cast("bigint").alias("ss"),
    ]


def welch_samples(rounds: DataFrame, weather: DataFrame, temp_unit: str = "C", wind_unit: str = "mph") -> DataFrame:
    """(test, grp, n, s, ss): count, sum and sum of squares of each test's two samples.

    Rounds are counted by day and score first; the weather predicates then run
    on days.  For the round-number test only each player's first nine rounds
    are ranked; the other sample is the rest.
    """
    w = convert_units(weather, temp_unit, wind_unit)
    scored = F.col("score").isNotNull()  # a round without a score is in no sample
    counts = rounds.where(scored).groupBy("round_date", "score").agg(F.count(F.lit(1)).alias("n"))
    days = counts.join(F.broadcast(w), F.col("round_date") == F.col("date"), "left").withColumn(
        "dow", C.weekday_int(F.col("round_date"))
    )
    one = days.agg(
        *[
            F.struct(*_sums(F.when(condition, F.col("n")))).alias(f"{name}__{grp}")
            for name, first, second in _day_tests()
            for grp, condition in (("a", first), ("b", second))
        ],
        F.struct(*_sums(F.col("n"))).alias("rounds_played__a"),
    )
    labelled = [
        F.struct(F.lit(c.split("__")[0]).alias("test"), F.lit(c.split("__")[1]).alias("grp"), F.col(c).alias("v"))
        for c in one.columns
    ]
    stacked = one.select(F.explode(F.array(*labelled)).alias("r")).select("r.test", "r.grp", "r.v.*")

    early = first_rounds(rounds.select("player_id", "round_date", "round_id", "score"), EXPERIENCED - 1)
    early = early.where(scored).agg(*_sums(F.lit(1).cast("bigint")))
    test = F.lit("rounds_played").alias("test")
    less = early.select(test, F.lit("a").alias("grp"), *[(-F.col(c)).alias(c) for c in ("n", "s", "ss")])
    second = early.select(test, F.lit("b").alias("grp"), "n", "s", "ss")
    return (
        stacked.union(less)
        .union(second)
        .groupBy("test", "grp")
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n", "s", "ss")])
    )


def welch(samples: DataFrame) -> DataFrame:
    """Welch's statistic per test from sample sums."""

    def pick(grp: str, name: str) -> Column:
        return F.max(F.when(F.col("grp") == grp, F.col(name)).cast("double")).alias(f"{name}_{grp}")

    wide = samples.groupBy("test").agg(*[pick(g, c) for g in "ab" for c in ("n", "s", "ss")])

    def mean(g: str) -> Column:
        return F.col(f"s_{g}") / F.nullif(F.col(f"n_{g}"), F.lit(0.0))

    def squared_error(g: str) -> Column:
        n = F.col(f"n_{g}")
        variance = (F.col(f"ss_{g}") - F.col(f"s_{g}") * mean(g)) / F.nullif(n - 1, F.lit(0.0))
        return variance / n

    e, f = squared_error("a"), squared_error("b")
    df = (e + f) * (e + f) / F.nullif(e * e / (F.col("n_a") - 1) + f * f / (F.col("n_b") - 1), F.lit(0.0))
    return wide.select(
        "test",
        F.col("n_a").cast("bigint").alias("n_a"),
        F.col("n_b").cast("bigint").alias("n_b"),
        mean("a").alias("mean_a"),
        mean("b").alias("mean_b"),
        F.sqrt(e + f).alias("std_err"),
        ((mean("a") - mean("b")) / F.nullif(F.sqrt(e + f), F.lit(0.0))).alias("t"),
        df.alias("df"),
    )


def welch_tests(rounds: DataFrame, weather: DataFrame, temp_unit: str = "C", wind_unit: str = "mph") -> DataFrame:
    """The eight two-sided tests with p value and 95 % interval of the difference."""
    stats = welch(welch_samples(rounds, weather, temp_unit, wind_unit))
    diff, half = F.col("mean_a") - F.col("mean_b"), F.col("_crit") * F.col("std_err")
    return (
        stats.withColumn("p_value", t_two_sided_p("t", "df"))
        .withColumn("_crit", t_critical_95("df"))
        .withColumn("ci_low", diff - half)
        .withColumn("ci_high", diff + half)
        .drop("_crit")
    )


def correlation_sums(rounds: DataFrame, handicaps: DataFrame) -> DataFrame:
    """Sums for the handicap-score correlation; rounds meet the handicaps as one row per player."""
    s = F.col("score").cast("bigint")
    per_player = rounds.where(F.col("score").isNotNull()).groupBy("player_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(s).alias("s"), F.sum(s * s).alias("ss")
    )
    h = F.round(F.col("handicap") * 10).cast("bigint")
    joined = per_player.join(handicaps.where(F.col("handicap").isNotNull()), "player_id").withColumn("h", h)
    return joined.agg(
        F.sum("n").cast("double").alias("n"),
        F.sum("s").cast("double").alias("y"),
        F.sum("ss").cast("double").alias("yy"),
        F.sum(F.col("n") * F.col("h")).cast("double").alias("x"),
        F.sum(F.col("n") * F.col("h") * F.col("h")).cast("double").alias("xx"),
        F.sum(F.col("s") * F.col("h")).cast("double").alias("xy"),
    )


def corr_handicap_score(rounds: DataFrame, handicaps: DataFrame, with_p: bool = True) -> DataFrame:
    """Pearson correlation with t, df and, unless switched off, p value and 95 % interval."""
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    cov = F.col("xy") - x * y / n
    r = cov / F.sqrt((F.col("xx") - x * x / n) * (F.col("yy") - y * y / n))
    out = correlation_sums(rounds, handicaps).select(n.cast("bigint").alias("n"), r.alias("r"))
    out = out.select(
        "n", "r", (F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))).alias("t"), (F.col("n") - 2).alias("df")
    )
    if not with_p:
        return out
    half = F.lit(Z_975) / F.sqrt(F.col("n") - 3)
    return (
        out.withColumn("p_value", t_two_sided_p(F.col("t"), F.col("df").cast("double")))
        .withColumn("ci_low", F.tanh(F.atanh("r") - half))
        .withColumn("ci_high", F.tanh(F.atanh("r") + half))
    )
