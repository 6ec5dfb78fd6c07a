"""Scans of the interchange formats, with fixed schemas; types that a row doesn't fit become null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_records(spark: SparkSession, path: str, schema: str | T.StructType, by_line: bool = False) -> DataFrame:
    """JSON records: one array or object a file, or with ``by_line`` one record a line, which large inputs should use."""
    return spark.read.schema(schema).option("multiLine", not by_line).json(path)


def csv_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header line; fields that hold line ends are quoted."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def parquet_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns are read."""
    return spark.read.parquet(path).select(*columns)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a text file without blank lines, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def feed_categories(spark: SparkSession, path: str) -> DataFrame:
    """(id, primary, categories) of the entries of Atom feeds: the last part of the entry's address without its version."""
    schema = "id string, primary_category struct<_term: string>, category array<struct<_term: string>>"
    entries = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema(schema).load(path)
    name = F.regexp_replace(F.element_at(F.split("id", "/abs/"), -1), "v[0-9]+$", "")
    return entries.select(name.alias("id"), F.col("primary_category._term").alias("primary"), F.transform("category", lambda c: c["_term"]).alias("categories"))


def metrics_long(df: DataFrame, key: str, column: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(key, metric, metric_year, value) from JSON text metric -> year -> count; reserved metrics, bad years and nulls are left out."""
    parsed = F.from_json(F.col(column), "map<string,map<string,bigint>>")
    metrics = df.select(key, F.explode(parsed).alias("metric", "by_year")).where(~F.col("metric").isin(list(skip)) if skip else F.lit(True))
    rows = metrics.select(key, "metric", F.explode("by_year").alias("year", "value"))
    return rows.select(key, "metric", F.col("year").try_cast("int").alias("metric_year"), "value").where("metric_year is not null and value is not null")


def fill_missing(records: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """Blank values are filled from another table; a value that is there is never overwritten."""
    other = found.select(F.col(key), F.col(column).alias("_found")).dropDuplicates([key])
    own = F.when(F.trim(F.col(column)) != "", F.col(column))
    return records.join(other, key, "left").withColumn(column, F.coalesce(own, F.col("_found"), F.col(column))).drop("_found")


def phrase_query(phrases: list[str], field: str = "abs") -> str:
    """A search expression for any of several phrases."""
    return " OR ".join(f'{field}:"{p}"' for p in phrases)


def year_query(query: str, first: int, last: int) -> str:
    """A search expression limited to a range of years."""
    return f"({query}) AND year:{first}-{last}"


def url_encoded(text: Column) -> Column:
    return F.url_encode(text)
