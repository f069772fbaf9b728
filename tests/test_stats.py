import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clubspark.functions import tdist
from clubspark.operators import reports, stats


@pytest.fixture(scope="module")
def scores():
    rng = random.Random(5)
    return [int(rng.gauss(85, 9)) for _ in range(400)] + [20, 150, 151]


@pytest.fixture(scope="module")
def rounds(spark, scores):
    rows = [(i, i % 17, i % 200, s) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "round_id long, player_id long, d int, score int").withColumn(
        "round_date", F.date_add(F.lit("2020-04-01").cast("date"), F.col("d"))
    )


# t, degrees of freedom, two-sided p: published tables.
@pytest.mark.parametrize("t, df, p", [(12.706, 1, 0.05), (2.228, 10, 0.05), (2.750, 30, 0.01), (1.980, 120, 0.05), (0.0, 7, 1.0)])
def test_t_distribution(t, df, p):
    assert tdist.two_sided_p(t, df) == pytest.approx(p, rel=2e-3)
    if p < 1:
        assert tdist.upper_quantile(p, df) == pytest.approx(t, rel=1e-3)


def test_t_distribution_nears_the_normal():
    """Very many degrees of freedom lose no digits."""
    for t in (0.1, 1.0, 3.0, 8.0):
        assert tdist.two_sided_p(t, 1e12) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-6, abs=1e-14)
        assert tdist.two_sided_p(t, 0.999e7) == pytest.approx(tdist.two_sided_p(t, 1.001e7), rel=1e-5, abs=1e-14)
    assert tdist.two_sided_p(1.5, 1999.9) == pytest.approx(tdist.two_sided_p(1.5, 2000.1), rel=1e-6)


def test_box(rounds, scores):
    q1, q2, q3 = np.percentile(scores, [25, 50, 75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    row = stats.box_overall(rounds).first()
    inside = [s for s in scores if lo <= s <= hi]
    assert (row["q25"], row["q50"], row["q75"]) == (q1, q2, q3)
    assert (row["lower_whisker"], row["upper_whisker"]) == (min(inside), max(inside))
    assert row["outliers"] == len(scores) - len(inside) > 0
    assert sorted(r["score"] for r in stats.score_outliers(rounds).collect()) == sorted(s for s in scores if s < lo or s > hi)


def test_histogram(rounds, scores):
    got = [r["rounds"] for r in reports.score_histogram(rounds).orderBy("bin").collect()]
    assert got == np.histogram(scores, bins=30)[0].tolist()


def test_describe(rounds, scores):
    row = reports.describe(rounds, ["score"]).first()
    assert row["count"] == len(scores)
    assert row["std"] == pytest.approx(np.std(scores, ddof=1))
    assert [row["q25"], row["q50"], row["q75"]] == np.percentile(scores, [25, 50, 75]).tolist()


def test_ecdf_ends_at_one(rounds):
    last = stats.score_ecdf(rounds).orderBy(F.desc("score")).first()
    assert last["cumulated"] == 1.0


def test_fits(rounds, scores):
    x = np.array(scores, dtype=float)
    sd, n = x.std(), len(x)
    row = stats.fit_normal(rounds).first()
    loglik = float((-0.5 * np.log(2 * np.pi * sd**2) - (x - x.mean()) ** 2 / (2 * sd**2)).sum())
    assert row["loglik"] == pytest.approx(loglik)
    assert row["sd_se"] == pytest.approx(sd / math.sqrt(2 * n))
    lam = x.mean()
    poisson = sum(s * math.log(lam) - lam - math.lgamma(s + 1) for s in scores)
    assert stats.fit_poisson(rounds).first()["loglik"] == pytest.approx(poisson)
    assert stats.fit_compare(rounds).first()["family"] == ("normal" if loglik > poisson else "poisson")


def test_bootstrap(rounds, scores):
    out = stats.bootstrap_moments(rounds, replicates=300)
    rows = out.collect()
    assert sorted(r["replicate"] for r in rows) == list(range(1, 301))
    whole = stats.describe_distribution(rounds).first()
    skew = np.array([r["skewness"] for r in rows])
    assert abs(skew.mean() - whole["skewness"]) < 3 * skew.std()
    assert sorted(r["skewness"] for r in stats.bootstrap_moments(rounds, replicates=300).collect()) == sorted(skew.tolist())


@pytest.mark.parametrize("mean", [1, 3, 40, 2_000])
def test_poisson_draws_invert_the_distribution(mean):
    """Each draw is the least k whose summed probability reaches the number."""
    u = np.concatenate([np.random.default_rng(mean).random(300), [0.0, 1e-12, 1 - 1e-12]])
    got = stats._poisson_inverse(mean, u)
    for number, k in zip(u, got):
        low = max(0, int(mean - 15 * math.sqrt(mean) - 30))
        terms = [math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(low, int(k) + 1)]
        upto = math.fsum(terms)
        assert upto >= number - 1e-9 and upto - terms[-1] <= number + 1e-9


def test_poisson_draws_of_a_huge_mean():
    u = (np.arange(20_000) + 0.5) / 20_000
    got = stats._poisson_inverse(1e10, u)
    assert got.mean() == pytest.approx(1e10, abs=2e3) and got.std() == pytest.approx(1e5, rel=1e-2)


def test_bootstrap_leaves_out_unknown_scores(spark, rounds):
    unknown = rounds.withColumn("score", F.when(F.col("round_id") >= 0, F.col("score"))).union(
        rounds.limit(3).withColumn("score", F.lit(None).cast("int"))
    )
    assert sorted(stats.bootstrap_moments(unknown, 20).collect()) == sorted(stats.bootstrap_moments(rounds, 20).collect())


def test_welch(spark, rounds):
    weather = rounds.select("round_date").distinct().select(
        F.col("round_date").alias("date"),
        F.when(F.dayofmonth("round_date") % 7 != 0, (F.dayofyear("round_date") % 30 + 45).cast("double")).alias("avg_temp"),
        (F.dayofyear("round_date") % 3).cast("double").alias("precipitation"),
        (F.dayofyear("round_date") % 20).cast("double").alias("wind_speed"),
    )
    got = {r["test"]: r for r in stats.welch_tests(rounds, weather, temp_unit="F").collect()}
    pdf = rounds.join(weather, rounds["round_date"] == weather["date"]).toPandas()
    pdf = pdf.sort_values(["player_id", "round_date", "round_id"])
    pdf["number"] = pdf.groupby("player_id").cumcount() + 1
    weekday = pdf["round_date"].map(lambda d: d.weekday())
    samples = {
        "rain": (pdf.precipitation == 0, pdf.precipitation > 0),
        "wind_15": (pdf.wind_speed <= 15, pdf.wind_speed > 15),
        "wind_10": (pdf.wind_speed <= 10, pdf.wind_speed > 10),
        "wind_5": (pdf.wind_speed <= 5, pdf.wind_speed > 5),
        "combined": (
            (pdf.wind_speed <= 5) & (pdf.precipitation == 0) & (pdf.avg_temp > 60),
            (pdf.wind_speed > 5) & (pdf.precipitation > 0) & (pdf.avg_temp <= 60),
        ),
        "temperature": (pdf.avg_temp >= 60, pdf.avg_temp < 60),
        "weekend": (weekday >= 5, weekday < 5),
        "rounds_played": (pdf.number >= 10, pdf.number < 10),
    }
    assert set(got) == set(samples)
    for name, (first, second) in samples.items():
        a, b = pdf.score[first], pdf.score[second]
        e, f = a.var() / len(a), b.var() / len(b)
        row = got[name]
        assert (row["n_a"], row["n_b"]) == (len(a), len(b))
        assert row["t"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(e + f))
        df = (e + f) ** 2 / (e**2 / (len(a) - 1) + f**2 / (len(b) - 1))
        assert row["df"] == pytest.approx(df)
        assert row["p_value"] == pytest.approx(tdist.two_sided_p(row["t"], df))
        assert row["ci_low"] < row["mean_a"] - row["mean_b"] < row["ci_high"]


def test_correlation(spark, rounds):
    handicaps = spark.createDataFrame([(i, i / 2.0) for i in range(17)], "player_id long, handicap double")
    row = stats.corr_handicap_score(rounds, handicaps).first()
    pdf = rounds.join(handicaps, "player_id").toPandas()
    r = np.corrcoef(pdf.handicap, pdf.score)[0, 1]
    assert row["r"] == pytest.approx(r)
    assert row["t"] == pytest.approx(r * math.sqrt((len(pdf) - 2) / (1 - r * r)))
    assert row["ci_low"] < r < row["ci_high"] and 0 <= row["p_value"] <= 1


def test_rounds_without_a_score_are_in_no_sample(spark):
    day = datetime.date(2020, 5, 2)
    rows = [(1, 1, day, 80), (2, 1, day, None), (3, 2, day, 90)]
    rounds = spark.createDataFrame(rows, "round_id long, player_id long, round_date date, score int")
    weather = spark.createDataFrame([(day, 20.0, 0.0, 5.0)], "date date, avg_temp double, precipitation double, wind_speed double")
    got = {(r["test"], r["grp"]): (r["n"], r["s"], r["ss"]) for r in stats.welch_samples(rounds, weather).collect()}
    assert got["rain", "a"] == got["rounds_played", "b"] == (2, 170, 14500)
    assert got["rounds_played", "a"] == got["rain", "b"] == (0, 0, 0)


def test_quartiles_of_odd_columns(spark):
    inf, nan = math.inf, math.nan
    columns = {
        "a": [1.5, None, 1.5, 1.5, None, 1.5, 1.5, 1.5, 1.5],
        "b": [-1e308, 1e308, 0.0, 5e-324, -5e-324, 1.0, 1.0 + 2**-52, 3.0, -2.0],
        "c": [inf, -inf, nan, 2.0, 1.0, inf, -inf, nan, 0.5],
        "d": [None] * 9,
        "e": [7.0] + [None] * 8,
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{n} double" for n in columns))
    got = {r["column_name"]: r for r in reports.describe(df, list(columns)).collect()}
    for name in columns:
        want = df.agg(F.percentile(name, [0.25, 0.5, 0.75]).alias("q")).first()["q"] or [None] * 3
        found = [got[name][f"q{p}"] for p in (25, 50, 75)]
        assert repr(found) == repr(want), name
        assert got[name]["count"] == sum(v is not None for v in columns[name])
    empty = reports.describe(df.limit(0), ["a"]).first()
    assert empty["count"] == 0 and empty["q50"] is None


def test_quartiles_of_ten_million_different_values(spark):
    """Half of them crowd in a billionth of the range; no percentile buffer is in any plan."""
    n = 10_000_000
    x = F.when(F.col("id") % 2 == 0, F.col("id") * 1e-9).otherwise(F.col("id").cast("double"))
    df = spark.range(n, numPartitions=4).select(x.alias("x"))
    row = reports.describe(df, ["x"]).first()
    low = np.arange(0, n, 2) * 1e-9
    values = np.sort(np.concatenate([low, np.arange(1, n, 2).astype(float)]))
    assert [row["q25"], row["q50"], row["q75"]] == pytest.approx(list(np.percentile(values, [25, 50, 75])), rel=1e-12)
