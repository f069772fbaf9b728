"""Properties of the physical plans that decide whether the queries scale."""

import re

import pytest

from clubspark.plans.catalog import QUERIES

HEAVY = {"model_linear", "model_ridge", "model_forest", "model_gbt", "model_metrics", "actual_vs_predicted", "score_bookings"} | {"model_metrics_linear", "score_bookings_linear"}
WRITES = {"scan_csv", "book_newcomers", "append_rounds", "incremental_loads", "file_deliveries"} | {q for q in QUERIES if q.startswith("stream_")}


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - HEAVY - WRITES))
def test_no_cross_joins(name, spark, sf):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_date_filter_reaches_the_scan(spark, sf):
    text = plan(QUERIES["clean_weather"](spark, sf))
    assert re.search(r"PushedFilters: \[[^\]]*l_shipdate", text) or "GreaterThanOrEqual(l_shipdate" in text


def test_scans_read_only_needed_columns(spark, sf):
    text = plan(QUERIES["value_counts_day"](spark, sf))
    assert "l_extendedprice" not in text.split("== Physical Plan ==")[1]
    assert "ReadSchema: struct<l_shipdate:timestamp_ntz>" in text


@pytest.mark.parametrize("name", ["clean_weather", "handicaps", "handicaps_eda"])
def test_top_rows_are_cut_before_the_shuffle(name, spark, sf):
    text = plan(QUERIES[name](spark, sf)).split("== Physical Plan ==")[1]
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", ["round_numbers", "adjust_scores_compound", "adjust_scores_eda"])
def test_no_player_is_numbered_in_one_task(name, spark, sf):
    text = plan(QUERIES[name](spark, sf)).split("== Physical Plan ==")[1]
    assert "row_number()" not in text and "sum(_n" in text


@pytest.mark.parametrize("name", [
    "adjust_scores", "load_weather", "book_requests", "training_set", "performers_by_conditions", "player_history", "best_per_player", "top_scores_poor"
])
def test_large_tables_are_not_read_again(name, spark, sf):
    text = plan(QUERIES[name](spark, sf)).split("== Physical Plan ==")[1]
    assert text.count("lineitem.parquet") <= 1 and text.count("orders.parquet") <= 1


def test_rows_are_numbered_with_one_shuffle(spark, tmp_path):
    """Behind the sorted, written rows only the offsets, one row per partition, are dealt out."""
    from pyspark.sql import functions as F

    from clubspark.operators.ranking import position_in_key

    rows = spark.range(2000).select("id", (F.col("id") % 3).alias("k"))
    numbered = position_in_key(rows, "k", ["id"], "id", "n")
    text = plan(numbered).split("== Physical Plan ==")[1]
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    assert numbered.where(F.col("n") != F.floor(F.col("id") / 3) + 1).count() == 0


def test_audit_reads_the_delivery_once(spark, sf):
    """One scan of orders is the delivery, the other the table that an earlier load stored."""
    text = plan(QUERIES["load_audit"](spark, sf)).split("== Physical Plan ==")[1]
    assert text.count("orders.parquet") <= 2 and "lineitem.parquet" not in text


def test_declared_rules_share_one_shuffle(spark, sf):
    """Keys of all rules meet once; the second exchange holds a row per rule and task, the third is the player look-up."""
    text = plan(QUERIES["check_declared"](spark, sf)).split("== Physical Plan ==")[1]
    assert len(re.findall(r"hashpartitioning\(rule#\d+, key#\d+", text)) == 1


@pytest.mark.parametrize("name", ["describe_scores"])
def test_quartiles_need_no_buffer_of_values(name, spark, sf):
    assert "percentile" not in plan(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["top_scores", "sample_rows", "top_rounds"])
def test_top_lists_do_not_sort_everything(name, spark, sf):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf))


def test_hot_name_is_split_in_the_player_lookup(spark):
    """A name on a third of the scorecards: adaptive execution cuts its partition, rows stay whole."""
    from pyspark.sql import functions as F

    from clubspark.operators import loading, reshape

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        name = F.concat(F.lit("P"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 4000))
        cards = spark.range(0, 120000, numPartitions=8).select(
            F.col("id").alias("scorecard_id"),
            name.alias("player_name"),
            *[F.lit(70 + k).alias(c) for k, c in enumerate(reshape.ROUND_COLUMNS)],
        )
        players = spark.range(0, 4000).select(
            F.col("id").alias("player_id"), F.concat(F.lit("P"), F.col("id")).alias("player_name")
        )
        known = loading.with_player_id(cards, players)
        assert known.count() == 120000
        run = known.where(F.length("player_name") > 0)
        run.write.format("noop").mode("overwrite").save()
        rows = run.collect()
        final = run._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == 120000 and "isFinalPlan=true" in final and "skew=true" in final
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
