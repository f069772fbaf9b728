"""Distribution summaries, fits and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clubspark.operators import player_stats, stats
from clubspark.plans import domain as D
from clubspark.plans.registry import critical_95_sql, query, two_sided_p_sql, with_views


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


_BOX = """
, boxed AS (
  SELECT {key} AS grp, score FROM {source}
), q AS (
  SELECT grp, quantile_cont(score, 0.25) AS q25, quantile_cont(score, 0.5) AS q50, quantile_cont(score, 0.75) AS q75 FROM boxed GROUP BY 1
), fenced AS (
  SELECT *, q25 - 1.5 * (q75 - q25) AS lo, q75 + 1.5 * (q75 - q25) AS hi FROM q
)
"""
_BOX_SELECT = """
  CAST(q25 AS DOUBLE) AS q25, CAST(q50 AS DOUBLE) AS q50, CAST(q75 AS DOUBLE) AS q75,
  min(CASE WHEN score BETWEEN lo AND hi THEN score END) AS lower_whisker,
  max(CASE WHEN score BETWEEN lo AND hi THEN score END) AS upper_whisker,
  count(CASE WHEN NOT score BETWEEN lo AND hi THEN 1 END) AS outliers
FROM boxed JOIN fenced USING (grp) GROUP BY grp, q25, q50, q75"""
_SEASON = """CASE WHEN month(round_date) IN (12, 1, 2) THEN 'Winter' WHEN month(round_date) IN (3, 4, 5) THEN 'Spring'
  WHEN month(round_date) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END"""


@query("box_by_season", with_views("", "rounds") + _BOX.format(key=_SEASON, source="rounds") + "SELECT grp AS season," + _BOX_SELECT)
def box_by_season(spark: SparkSession, sf: str) -> DataFrame:
    return stats.box_by_season(D.rounds(spark, sf))


# All rounds of the raw scorecards: the zeros of missed cuts are the outliers.
_RAW_BOX = with_views("", "rounds_raw") + _BOX.format(key="'all'", source="rounds_raw")


@query("box_overall", _RAW_BOX + "SELECT" + _BOX_SELECT)
def box_overall(spark: SparkSession, sf: str) -> DataFrame:
    return stats.box_overall(D.rounds_raw(spark, sf))


@query("score_outliers", _RAW_BOX + """
SELECT round_id, player_name, score FROM rounds_raw
WHERE score < (SELECT lo FROM fenced) OR score > (SELECT hi FROM fenced)""")
def score_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return stats.score_outliers(D.rounds_raw(spark, sf)).select("round_id", "player_name", "score")


@query("score_ecdf", """
SELECT score, n, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY score) / sum(n) OVER (), 6) AS cumulated
FROM (SELECT score, count(*) AS n FROM rounds GROUP BY score)""", ("rounds",))
def score_ecdf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.score_ecdf(D.rounds(spark, sf)), "share", "cumulated")


@query("describe_distribution", """
SELECT min(score) AS "min", max(score) AS "max", CAST(median(score) AS DOUBLE) AS median, round(avg(score), 6) AS mean,
  round(stddev_samp(score), 6) AS sd, round(skewness(score), 6) AS skewness, round(kurtosis(score) + 3, 6) AS kurtosis FROM adjusted""",
       ("adjusted",))
def describe_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.describe_distribution(D.adjusted_rounds(spark, sf)), "mean", "sd", "skewness", "kurtosis")


_DRAW = "CAST('0x' || substr(md5('42:' || score || ':' || replicate), 1, 15) AS BIGINT) / pow(2, 60)"


# Poisson terms and their running shares per score; a draw is the first share that reaches its number.
@query("bootstrap_moments", with_views("", "adjusted") + f"""
, counts AS (
  SELECT score, count(*) AS n, floor(12 * sqrt(count(*)) + 20) + 1 AS width FROM adjusted GROUP BY score
), terms AS (
  SELECT score, n, unnest(range(CAST(greatest(0, n - width) AS BIGINT), CAST(n + width + 1 AS BIGINT))) AS k FROM counts
), weighed AS (
  SELECT score, k, exp(k * ln(n) - n - lgamma(k + 1)) AS p FROM terms
), shares AS (
  SELECT score, k, sum(p) OVER (PARTITION BY score ORDER BY k) / sum(p) OVER (PARTITION BY score) AS share FROM weighed
), asked AS (
  SELECT score, replicate, {_DRAW} AS u FROM counts CROSS JOIN range(1, 1001) AS numbers(replicate)
), drawn AS (
  SELECT replicate, asked.score - 72 AS d, CAST(k AS DOUBLE) AS w FROM asked ASOF JOIN shares ON asked.score = shares.score AND u <= share
), sums AS (
  SELECT replicate, sum(w) AS n, sum(w * d) / sum(w) AS a, sum(w * d * d) / sum(w) AS b,
    sum(w * d * d * d) / sum(w) AS c, sum(w * d * d * d * d) / sum(w) AS e FROM drawn GROUP BY replicate
), central AS (
  SELECT replicate, n, b - a * a AS m2, c - 3 * a * b + 2 * a * a * a AS m3, e - 4 * a * c + 6 * a * a * b - 3 * a * a * a * a AS m4 FROM sums
)
SELECT CAST(replicate AS INTEGER) AS replicate, round(m3 / pow(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2), 6) + 0.0 AS skewness,
  round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / (m2 * m2) - (n - 1) * 3) + 3, 6) AS kurtosis
FROM central""")
def bootstrap_moments(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(stats.bootstrap_moments(D.adjusted_rounds(spark, sf)), "skewness", "kurtosis")
    return out.withColumn("skewness", F.col("skewness") + F.lit(0.0))


_NORMAL = """
, moments AS (SELECT count(*) AS n, avg(score) AS mean, stddev_pop(score) AS sd FROM rounds)
, normal AS (SELECT *, -n / 2.0::DOUBLE * (ln(2 * pi() * sd * sd) + 1) AS loglik FROM moments)
"""
_POISSON = """
, pm AS (SELECT count(*) AS n, avg(score) AS lam FROM rounds)
, poisson AS (SELECT n, lam, (SELECT sum(score * ln(lam) - lam - lgamma(score + 1)) FROM rounds) AS loglik FROM pm)
"""


@query("fit_normal", with_views("", "rounds") + _NORMAL + """
SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS mean_se, round(sd / sqrt(2 * n), 6) AS sd_se,
  round(loglik, 4) AS loglik, round(4 - 2 * loglik, 4) AS aic, round(2 * ln(n) - 2 * loglik, 4) AS bic FROM normal""")
def fit_normal(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(stats.fit_normal(D.rounds(spark, sf)), "mean", "sd", "mean_se", "sd_se")
    return out.withColumns({c: F.round(c, 4) for c in ("loglik", "aic", "bic")})


@query("fit_poisson", with_views("", "rounds") + _POISSON + """
SELECT n, round(lam, 6) AS "lambda", round(sqrt(lam / n), 6) AS lambda_se, round(loglik, 4) AS loglik,
  round(2 - 2 * loglik, 4) AS aic, round(ln(n) - 2 * loglik, 4) AS bic FROM poisson""")
def fit_poisson(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(stats.fit_poisson(D.rounds(spark, sf)), "lambda", "lambda_se")
    return out.withColumns({c: F.round(c, 4) for c in ("loglik", "aic", "bic")})


@query("fit_compare", with_views("", "rounds") + _NORMAL + _POISSON + """
SELECT 'normal' AS family, round(loglik, 4) AS loglik, round(4 - 2 * loglik, 4) AS aic, round(2 * ln(n) - 2 * loglik, 4) AS bic FROM normal
UNION ALL SELECT 'poisson', round(loglik, 4), round(2 - 2 * loglik, 4), round(ln(n) - 2 * loglik, 4) FROM poisson""")
def fit_compare(spark: SparkSession, sf: str) -> DataFrame:
    return stats.fit_compare(D.rounds(spark, sf)).withColumns({c: F.round(c, 4) for c in ("loglik", "aic", "bic")})


# name, first sample, second sample; over the adjusted scores with round numbers.
_TESTS = [
    ("rain", "precipitation = 0", "precipitation > 0"),
    ("wind_15", "wind_speed <= 15", "wind_speed > 15"),
    ("wind_10", "wind_speed <= 10", "wind_speed > 10"),
    ("wind_5", "wind_speed <= 5", "wind_speed > 5"),
    (
        "combined",
        "wind_speed <= 5 AND precipitation = 0 AND avg_temp > 60",
        "wind_speed > 5 AND precipitation > 0 AND avg_temp <= 60",
    ),
    ("temperature", "avg_temp >= 60", "avg_temp < 60"),
    ("weekend", "isodow(round_date) >= 6", "isodow(round_date) < 6"),
    ("rounds_played", "round_number >= 10", "round_number < 10"),
]
_SAMPLES = """
, analysis AS (
  SELECT score, round_date, avg_temp, precipitation, wind_speed,
    row_number() OVER (PARTITION BY player_id ORDER BY round_date, round_id) AS round_number
  FROM adjusted LEFT JOIN weather_f ON round_date = date
), samples AS (
""" + "\nUNION ALL ".join(
    f"SELECT '{name}' AS test, count(CASE WHEN {a} THEN 1 END) AS n_a, count(CASE WHEN {b} THEN 1 END) AS n_b, "
    f"avg(CASE WHEN {a} THEN score END) AS mean_a, avg(CASE WHEN {b} THEN score END) AS mean_b, "
    f"var_samp(CASE WHEN {a} THEN score END) / n_a AS e, var_samp(CASE WHEN {b} THEN score END) / n_b AS f FROM analysis"
    for name, a, b in _TESTS
) + "\n)\n"


@query("welch_tests", with_views("", "adjusted", "weather_f") + _SAMPLES + """
SELECT test, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(sqrt(e + f), 6) AS std_err,
  round((mean_a - mean_b) / sqrt(e + f), 6) AS t,
  round((e + f) * (e + f) / (e * e / (n_a - 1) + f * f / (n_b - 1)), 4) AS df FROM samples""")
def welch_statistics(spark: SparkSession, sf: str) -> DataFrame:
    weather = D.weather_once(spark, sf)
    out = stats.welch(stats.welch_samples(D.adjusted_rounds(spark, sf, weather), weather))
    return rounded(out, "mean_a", "mean_b", "std_err", "t").withColumn("df", F.round("df", 4))


@query("welch_p_values", with_views("", "adjusted", "weather_f") + _SAMPLES + f"""
, tested AS (
  SELECT *, mean_a - mean_b AS diff, sqrt(e + f) AS se, diff / se AS t,
    (e + f) * (e + f) / (e * e / (n_a - 1) + f * f / (n_b - 1)) AS df FROM samples
)
SELECT test, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(se, 6) AS std_err, round(t, 6) AS t,
  round(df, 4) AS df, round({two_sided_p_sql('t', 'df')}, 6) AS p_value,
  round(diff - {critical_95_sql('df')} * se, 6) AS ci_low, round(diff + {critical_95_sql('df')} * se, 6) AS ci_high FROM tested""")
def welch_p_values(spark: SparkSession, sf: str) -> DataFrame:
    """The eight tests with p value and confidence interval."""
    weather = D.weather_once(spark, sf)
    out = stats.welch_tests(D.adjusted_rounds(spark, sf, weather), weather)
    out = rounded(out, "mean_a", "mean_b", "std_err", "t", "p_value", "ci_low", "ci_high")
    return out.withColumn("df", F.round("df", 4))


@query("corr_handicap_score", """
SELECT n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t, CAST(n - 2 AS BIGINT) AS df
FROM (SELECT count(*) AS n, corr(handicap, score) AS r FROM rounds JOIN handicaps USING (player_id))""", ("rounds", "handicaps"))
def corr_handicap_score(spark: SparkSession, sf: str) -> DataFrame:
    rounds = D.rounds(spark, sf)
    return rounded(stats.corr_handicap_score(rounds, player_stats.handicaps(rounds), with_p=False), "r", "t")


@query("corr_p_value", with_views("", "rounds", "handicaps") + f"""
, correlated AS (
  SELECT *, n - 2.0::DOUBLE AS f, r * sqrt((n - 2) / (1 - r * r)) AS t
  FROM (SELECT count(*) AS n, corr(handicap, score) AS r FROM rounds JOIN handicaps USING (player_id))
)
SELECT n, round(r, 6) AS r, round(t, 6) AS t, CAST(n - 2 AS BIGINT) AS df, round({two_sided_p_sql('t', 'f')}, 6) AS p_value,
  round(tanh(atanh(r) - {stats.Z_975} / sqrt(n - 3)), 6) AS ci_low,
  round(tanh(atanh(r) + {stats.Z_975} / sqrt(n - 3)), 6) AS ci_high FROM correlated""")
def corr_p_value(spark: SparkSession, sf: str) -> DataFrame:
    rounds = D.rounds(spark, sf)
    out = stats.corr_handicap_score(rounds, player_stats.handicaps(rounds))
    return rounded(out, "r", "t", "p_value", "ci_low", "ci_high")
