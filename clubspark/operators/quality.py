"""Checks of the declared keys, null rules, lengths and references."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubspark import schemas


class Rule(NamedTuple):
    """A declared rule: "not_null", "length" (with its limit), "unique" or "reference" (with its parent column)."""

    table: str
    column: str
    kind: str
    limit: int | None = None
    parent: tuple[str, str] | None = None


def declared_rules(table: str) -> list[Rule]:
    """The rules that the schema declares for a stored table; a primary key is unique and not null."""
    required = [f.name for f in schemas.TABLES[table].fields if not f.nullable]
    rules = [Rule(table, c, "not_null") for c in required]
    rules += [Rule(table, c, "length", limit=n) for c, n in schemas.LENGTHS.get(table, {}).items()]
    rules += [Rule(table, c, "unique") for c in (schemas.PRIMARY[table], *schemas.UNIQUE.get(table, ()))]
    rules += [Rule(table, c, "reference", parent=p) for c, p in schemas.REFERENCES.get(table, {}).items()]
    return rules


def _entry(rule: int, when: Column, key: Column | None = None, held: int = 0, parents: int = 0, broken: int = 0) -> Column:
    key = F.lit(None) if key is None else key
    counts = [F.lit(n).cast("bigint").alias(c) for c, n in (("held", held), ("parents", parents), ("broken", broken))]
    return F.when(when, F.struct(F.lit(rule).alias("rule"), key.cast("string").alias("key"), *counts))


def _entries(name: str, df: DataFrame, rules: list[Rule]) -> DataFrame:
    """What one table says to the rules: its keys, the keys it is referred to by, and the rows that break a rule."""
    found = []
    for i, rule in enumerate(rules):
        x = F.col(rule.column)
        if rule.table == name and rule.kind == "not_null":
            found.append(_entry(i, x.isNull(), broken=1))
        elif rule.table == name and rule.kind == "length":
            found.append(_entry(i, F.length(x) > rule.limit, broken=1))
        elif rule.table == name:
            found.append(_entry(i, x.isNotNull(), x, held=1))
        if rule.parent is not None and rule.parent[0] == name:
            x = F.col(rule.parent[1])
            found.append(_entry(i, x.isNotNull(), x, parents=1))
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("e")).select("e.*")


def check_declared(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, rule, violations) of every declared rule of the given stored tables.

    All rules are compiled from the schemas.  Each table is read once, and all keys of all tables meet in one shuffle by
    (rule, key), counted in the tasks first, so a key on a third of the rows arrives as one row a task.
    Violations are rows: those that break NOT NULL or the length, surplus rows of a key, rows whose key has no
    parent (a reference to a table that is not given is left out).  Null keys break NOT NULL only.  An empty
    table breaks nothing.  A frame without a declared column of a rule is an error.
    """
    rules = [r for name in tables for r in declared_rules(name) if r.parent is None or r.parent[0] in tables]
    names = [F.struct(F.lit(i).alias("rule"), F.lit(r.table), F.lit(r.column), F.lit(r.kind)) for i, r in enumerate(rules)]
    listed = next(iter(tables.values())).sparkSession.range(1).select(F.inline(F.array(*names)))
    listed = listed.toDF("rule", "table_name", "column_name", "kind")
    said = reduce(DataFrame.union, [_entries(name, df, rules) for name, df in tables.items()])
    by_key = said.groupBy("rule", "key").agg(*[F.sum(c).alias(c) for c in ("held", "parents", "broken")])
    of_kind = [F.lit(r.kind) for r in rules]
    wrong = (
        F.when(F.array(*of_kind)[F.col("rule")] == "unique", F.greatest(F.col("held") - 1, F.lit(0)))
        .when(F.array(*of_kind)[F.col("rule")] == "reference", F.when(F.col("parents") == 0, F.col("held")).otherwise(0))
        .otherwise(F.col("broken"))
    )
    counted = by_key.groupBy("rule").agg(F.sum(wrong).alias("violations"))
    return listed.join(F.broadcast(counted), "rule", "left").select(  # one row per rule
        "table_name", "column_name", F.col("kind").alias("rule"), F.coalesce("violations", F.lit(0).cast("bigint")).alias("violations")
    )


def check_unique(frames: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Per (table, column): keys held more than once and the rows too many."""

    def one(table: str, df: DataFrame, column: str) -> DataFrame:
        counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        return counts.where(F.col("n") > 1).agg(
            F.lit(table).alias("table_name"),
            F.lit(column).alias("column_name"),
            F.count(F.lit(1)).alias("duplicate_keys"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("surplus_rows"),
        )

    return reduce(DataFrame.union, [one(*frame) for frame in frames])


def check_columns(frames: list[tuple[str, DataFrame, list[str], dict[str, int]]]) -> DataFrame:
    """Per (table, column, rule): rows breaking NOT NULL or the text length; one pass per table."""

    def one(table: str, df: DataFrame, required: list[str], lengths: dict[str, int]) -> DataFrame:
        rules = [(c, "not_null", F.col(c).isNull()) for c in required]
        rules += [(c, "length", F.length(c) > n) for c, n in lengths.items()]
        counted = df.agg(*[F.count(F.when(broken, 1)).alias(f"v{i}") for i, (_, _, broken) in enumerate(rules)])
        rows = [
            F.struct(F.lit(c).alias("column_name"), F.lit(rule).alias("rule"), F.col(f"v{i}").alias("violations"))
            for i, (c, rule, _) in enumerate(rules)
        ]
        return counted.select(F.lit(table).alias("table_name"), F.explode(F.array(*rows)).alias("r")).select(
            "table_name", "r.*"
        )

    return reduce(DataFrame.union, [one(*frame) for frame in frames])


def check_foreign_keys(frames: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Per reference: keys without a parent row and the child rows holding them.

    Child keys are counted first, so a key with many rows reaches the join as one row.
    """

    def one(name: str, child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
        keys = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
        orphans = keys.join(parent.select(F.col(pk).alias("_key")), "_key", "left_anti")
        return orphans.agg(
            F.lit(name).alias("reference"),
            F.count(F.lit(1)).alias("orphan_keys"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orphan_rows"),
        )

    return reduce(DataFrame.union, [one(*frame) for frame in frames])
