"""Stored tables: parquet folders, or a database over JDBC."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession

from clubspark import schemas


def literal(value: object) -> str:
    """A value as an SQL literal; quotes in texts are doubled."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        kind = "TIMESTAMP" if isinstance(value, datetime.datetime) else "DATE"
        return f"{kind} '{value}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    raise TypeError(f"no literal for {type(value).__name__}")


def with_literals(sql: str, args: dict) -> str:
    """``sql`` with its ``:name`` parameters filled in, outside quoted texts and casts."""
    parts = re.split(r"('(?:[^']|'')*')", sql)
    parts[::2] = [re.sub(r"(?<!:):(\w+)", lambda m: literal(args[m[1]]), part) for part in parts[::2]]
    return "".join(parts)


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, on any store that Spark can read."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def files_below(spark: SparkSession, path: str) -> bool:
    found, system = hadoop_path(spark, path)
    return system.exists(found)


class ParquetTables:
    """Tables as parquet folders below one root."""

    def __init__(self, spark: SparkSession, root: str, suffix: str = ""):
        self.spark, self.root, self.suffix = spark, root.rstrip("/"), suffix

    def path(self, name: str) -> str:
        return f"{self.root}/{name}{self.suffix}"

    def exists(self, name: str) -> bool:
        return files_below(self.spark, self.path(name))

    def read(self, name: str) -> DataFrame:
        """The whole table; a declared table never written reads as empty."""
        if not self.exists(name) and name in schemas.TABLES:
            return self.spark.createDataFrame([], schemas.TABLES[name])
        return self.spark.read.parquet(self.path(name))

    def query(self, sql: str, args: dict | None = None) -> DataFrame:
        """SQL over tables named in braces, with named parameters."""
        names = sorted(set(re.findall(r"{(\w+)}", sql)))
        return self.spark.sql(sql, args=args, **{name: self.read(name) for name in names})

    def append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(self.path(name))

    def replace(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(self.path(name))


class JdbcTables:
    """The same interface over a database; reads are split by a numeric column."""

    def __init__(self, spark: SparkSession, url: str, driver: str = "org.postgresql.Driver", **options: str):
        self.spark = spark
        self.options = {"url": url, "driver": driver, **options}

    def read_options(
        self, name: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1
    ) -> dict[str, str]:
        options = {**self.options, "dbtable": name}
        if partition_column is not None and bounds is not None:
            options |= {
                "partitionColumn": partition_column,
                "lowerBound": str(bounds[0]),
                "upperBound": str(bounds[1]),
                "numPartitions": str(partitions),
            }
        return options

    def query_options(self, sql: str, args: dict | None = None) -> dict[str, str]:
        """Options of a query; ``:name`` parameters go in as quoted literals, tables in braces by their names."""
        return {**self.options, "query": with_literals(re.sub(r"{(\w+)}", r"\1", sql), args or {})}

    def exists_options(self, name: str) -> dict[str, str]:
        """Options of a query with one row if the table is there, in the schema before the dot or in any."""
        schema, _, table = name.rpartition(".")
        sql = "SELECT 1 AS found FROM information_schema.tables WHERE table_name = :table"
        if schema:
            sql += " AND table_schema = :schema"
        return self.query_options(sql + " LIMIT 1", {"table": table, "schema": schema})

    def exists(self, name: str) -> bool:
        """Asked of the database's catalog, so a lost connection is an error and not a missing table."""
        return not self.spark.read.format("jdbc").options(**self.exists_options(name)).load().isEmpty()

    def write_options(self, name: str, batch_size: int = 10000) -> dict[str, str]:
        return {**self.options, "dbtable": name, "batchsize": str(batch_size)}

    def read(self, name: str, **split) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.read_options(name, **split)).load()

    def query(self, sql: str, args: dict | None = None) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.query_options(sql, args)).load()

    def append(self, df: DataFrame, name: str) -> None:
        df.write.format("jdbc").options(**self.write_options(name)).mode("append").save()

    def replace(self, df: DataFrame, name: str) -> None:
        """Replace the rows and keep the table, its keys and rights."""
        options = {**self.write_options(name), "truncate": "true"}
        df.write.format("jdbc").options(**options).mode("overwrite").save()
