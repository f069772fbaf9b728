"""Query registry and the SQL views its reference statements build on."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SCORES = """
  CAST(62 + (CAST(floor(o_totalprice) AS BIGINT) + 37 + o_orderkey) % 48 AS INTEGER) AS r1,
  CAST(62 + (CAST(floor(o_totalprice) AS BIGINT) + 74 + o_orderkey) % 48 AS INTEGER) AS r2,
  CASE WHEN o_orderstatus = 'F' THEN 0 ELSE CAST(62 + (CAST(floor(o_totalprice) AS BIGINT) + 111 + o_orderkey) % 48 AS INTEGER) END AS r3,
  CASE WHEN o_orderstatus = 'F' THEN 0 ELSE CAST(62 + (CAST(floor(o_totalprice) AS BIGINT) + 148 + o_orderkey) % 48 AS INTEGER) END AS r4"""

_UNPIVOT = "CASE k WHEN 1 THEN r1 WHEN 2 THEN r2 WHEN 3 THEN r3 ELSE r4 END"


def hash_sql(x: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5(concat('{seed}:', CAST(CAST({x} AS BIGINT) AS VARCHAR))), 1, 15) AS BIGINT)"


def date_sql(x: str) -> str:
    h = hash_sql(x, 0)
    return (
        f"make_date(CAST(2017 + {h} % 6 AS INTEGER), CAST(4 + ({h} // 6) % 7 AS INTEGER), "
        f"CAST(1 + ({h} // 42) % 28 AS INTEGER))"
    )


def differential_sql(score: str) -> str:
    """A round's differential, one decimal; its sum over rounds is exact."""
    return f"CAST(round(({score} - 67.3::DOUBLE) * 113 / 119, 1) AS DECIMAL(18, 1))"


def handicap_sql(total: str, n: str) -> str:
    """96 % of the mean differential, one decimal."""
    return f"round(CAST({total} * 0.96 AS DOUBLE) / {n}, 1)"


_DELTA = """
  CASE WHEN avg_temp < 50 THEN 4 WHEN avg_temp > 95 THEN 4 WHEN avg_temp > 80 THEN -1 ELSE 0 END
  + CASE WHEN wind_speed > 15 THEN 4 WHEN wind_speed > 10 THEN 3 WHEN wind_speed < 3 THEN -1 ELSE 0 END
  + CASE WHEN precipitation > 10 THEN 5 WHEN precipitation > 0 THEN 3 WHEN precipitation = 0 THEN -1 ELSE 0 END
  + CASE WHEN day_of_week_int IN (5, 6) THEN -1 WHEN day_of_week_int IN (0, 1) THEN 2 ELSE 0 END"""

# name -> (views it needs, select)
VIEWS: dict[str, tuple[list[str], str]] = {
    "scorecards": (
        [],
        f"""SELECT o_orderkey AS scorecard_id, o_orderdate, year(o_orderdate) AS card_year,
  CASE WHEN o_orderkey % 97 = 96 OR o_custkey % 25 = 24 THEN NULL ELSE c_name END AS player_name,
  {_SCORES}
FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
    "rounds_raw": (
        ["scorecards"],
        f"""SELECT scorecard_id, o_orderdate, player_name, CAST(k AS INTEGER) AS round_number, {_UNPIVOT} AS score,
  scorecard_id * 4 + k AS round_id, {date_sql('(scorecard_id * 4 + k)')} AS round_date
FROM scorecards CROSS JOIN (VALUES (1), (2), (3), (4)) AS numbers(k)
WHERE player_name IS NOT NULL""",
    ),
    "weather_raw": (
        [],
        """SELECT *, CAST(l_shipdate AS DATE) + INTERVAL 22 YEAR AS shifted,
  CAST(CAST(l_shipdate AS DATE) + INTERVAL 22 YEAR AS DATE) AS "time",
  CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE CAST((l_partkey * 7 + l_suppkey) % 45 - 8 AS DOUBLE) END AS tavg,
  CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE ((l_partkey + 3 * l_suppkey) % 80) / 4.0::DOUBLE END AS prcp,
  CASE WHEN l_suppkey % 41 = 0 THEN NULL ELSE l_quantity / 2.0::DOUBLE END AS wspd
FROM lineitem WHERE day(CAST(l_shipdate AS DATE) + INTERVAL 22 YEAR) <> 13""",
    ),
    "weather": (
        ["weather_raw"],
        """SELECT "time" AS date, tavg AS avg_temp, prcp AS precipitation, wspd AS wind_speed,
  dayname("time") AS day_of_week, CAST(isodow("time") - 1 AS INTEGER) AS day_of_week_int
FROM weather_raw WHERE "time" >= DATE '2017-04-01'
QUALIFY row_number() OVER (PARTITION BY "time" ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) = 1""",
    ),
    "weather_f": (
        ["weather"],
        """SELECT date, round(avg_temp * 9 / 5 + 32, 2) AS avg_temp, precipitation, wind_speed, day_of_week, day_of_week_int
FROM weather""",
    ),
    "players": (
        [],
        """SELECT c_custkey AS player_id, c_name AS player_name, 'guest' AS member_status,
  CAST(NULL AS DOUBLE) AS handicap, 0 AS rounds_played, c_mktsegment <> 'HOUSEHOLD' AS registered FROM customer""",
    ),
    "rounds": (
        ["weather"],
        f"""SELECT scorecard_id * 4 + k AS round_id, player_id, {date_sql('(scorecard_id * 4 + k)')} AS round_date,
  {_UNPIVOT} AS score
FROM (SELECT o_orderkey AS scorecard_id, o_custkey AS player_id, {_SCORES} FROM orders
  WHERE NOT (o_orderkey % 97 = 96 OR o_custkey % 25 = 24)) AS cards
CROSS JOIN (VALUES (1), (2), (3), (4)) AS numbers(k)
WHERE {_UNPIVOT} > 0 AND {date_sql('(scorecard_id * 4 + k)')} IN (SELECT date FROM weather)""",
    ),
    "deltas": (["weather_f"], f"SELECT date, {_DELTA} AS delta FROM weather_f"),
    "adjusted": (
        ["rounds", "deltas"],
        """SELECT round_id, player_id, round_date, CAST(score + coalesce(delta, 0) AS INTEGER) AS score
FROM rounds LEFT JOIN deltas ON round_date = date""",
    ),
    "numbered": (
        ["rounds"],
        """SELECT *, CAST(row_number() OVER (PARTITION BY player_id ORDER BY round_date, round_id) AS INTEGER) AS round_number
FROM rounds""",
    ),
    "handicaps": (
        ["rounds"],
        f"""SELECT player_id, {handicap_sql('total', 'n')} AS handicap FROM (
  SELECT player_id, sum({differential_sql('score')}) AS total, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY round_date DESC, round_id DESC) AS age FROM rounds)
  WHERE age <= 20 GROUP BY player_id)""",
    ),
    "requests": (
        [],
        """SELECT event_id AS booking_id, user_id, c_name AS player_name, ts AS booking_time,
  CAST(6 + event_id % 15 AS INTEGER) AS hour, event_id % 2 = 0 AS cart,
  DATE '2017-04-01' + CAST(event_id * 37 % 2000 AS INTEGER) AS booking_date, (event_id % 361) / 10.0::DOUBLE AS handicap,
  event_type
FROM events LEFT JOIN customer ON user_id = c_custkey""",
    ),
    "training": (
        ["numbered", "handicaps", "weather"],
        """SELECT round_id, score, round_number, handicap, avg_temp, precipitation, wind_speed, day_of_week_int
FROM numbered LEFT JOIN handicaps USING (player_id) LEFT JOIN weather ON round_date = date""",
    ),
    "features": (
        ["training"],
        """SELECT *, precipitation * wind_speed AS wind_precip,
  wind_speed * CASE WHEN avg_temp < 15 THEN 1 ELSE 0 END AS wind_cold,
  CASE WHEN wind_speed > 15 AND precipitation > 0.5 AND avg_temp < 15 THEN 1 ELSE 0 END AS bad_weather_combo,
  coalesce(day_of_week_int >= 5, FALSE) AS weekend
FROM training""",
    ),
    "complete": (
        ["features"],
        """SELECT * FROM features WHERE score IS NOT NULL AND round_number IS NOT NULL AND handicap IS NOT NULL
  AND avg_temp IS NOT NULL AND precipitation IS NOT NULL AND wind_speed IS NOT NULL AND day_of_week_int IS NOT NULL""",
    ),
}


# The same views over adjusted scores.
for _name in ("numbered", "handicaps", "training", "features", "complete"):
    _needs, _text = VIEWS[_name]
    for _old, _new in (("rounds", "adjusted"), *((v, f"adjusted_{v}") for v in ("numbered", "handicaps", "training", "features"))):
        _text = re.sub(rf"(FROM|JOIN) {_old}\b", rf"\1 {_new}", _text)
    _over = {"rounds": "adjusted", "weather": "weather"}
    VIEWS[f"adjusted_{_name}"] = ([_over.get(v, f"adjusted_{v}") for v in _needs], _text)


def two_sided_p_sql(t: str, df: str) -> str:
    """P(|T| >= |t|): Simpson's rule over the density; the part beyond 40 is nothing."""
    x = f"(i * least(abs({t}), 40) / 2000)"
    density = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - ln({df} * pi()) / 2 - ({df} + 1) / 2 * ln(1 + {x} * {x} / {df}))"
    weight = "(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    area = f"list_sum(list_transform(range(2001), lambda i: {weight} * {density}))"
    return f"greatest(0, 1 - 2 * {area} * least(abs({t}), 40) / 6000)"


def critical_95_sql(df: str) -> str:
    """Half width of a 95 % interval in standard errors: the normal quantile with terms in 1/df."""
    z = 1.959963984540054
    terms = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return f"({z}::DOUBLE + " + " + ".join(f"{c!r}::DOUBLE / pow({df}, {k})" for k, c in enumerate(terms, 1)) + ")"


def with_views(select: str, *names: str) -> str:
    """A statement with the named views, and those they need, in front."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for needed in VIEWS[name][0]:
                add(needed)
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return select.strip()
    views = ",\n".join(f"{name} AS (\n{VIEWS[name][1]}\n)" for name in ordered)
    return f"WITH {views}\n{select.strip()}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query, with its reference statement where SQL can state it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return register
