"""Readers and writers of delimited entity tables, ground truth, reports and labelled pairs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions import text
from kindred.scratch import materialize

ENTITY_FIELDS = ["entity_id", "business_name", "business_address", "country"]
TRUTH_FIELDS = ["source1_entity_id", "matched_entity_ids"]
_BAD, _RANGE = "_bad", "_range"


def _tsv(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(f, T.StringType()) for f in [*fields, _BAD]])
    reader = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).option("enforceSchema", True)
    return reader.csv(path)


def read_entities(spark: SparkSession, path: str, source: str | None = None, na_mode: str = "literal") -> DataFrame:
    """A source table, all strings, nulls as empty strings.

    Rows with too few fields are padded, those with too many are left out. ``na_mode`` is ``literal``, or ``default`` to
    take strings such as ``NA`` for missing. ``source`` adds a column of that value."""
    raw = _tsv(spark, path, ENTITY_FIELDS)
    too_long = F.col(_BAD).isNotNull() & (F.size(F.split(F.col(_BAD), "\t")) > len(ENTITY_FIELDS))
    # Always true; Spark reads no file for the sake of what is bad in it alone, as a plain count would ask.
    too_long = too_long & (F.coalesce(F.length(ENTITY_FIELDS[0]), F.lit(0)) >= 0)
    fill = text.drop_missing if na_mode == "default" else text.safe_text
    kept = raw.filter(~too_long).select(*(fill(F.col(c)).alias(c) for c in ENTITY_FIELDS))
    return kept.select(F.lit(source).alias("source"), *ENTITY_FIELDS) if source else kept


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth: a query id and a list of target ids, nulls as empty strings."""
    return _tsv(spark, path, TRUTH_FIELDS).select(*(text.safe_text(F.col(c)).alias(c) for c in TRUTH_FIELDS))


def head(df: DataFrame, n: int, order: list[str | Column], few: int = 10_000) -> DataFrame:
    """The first ``n`` rows by an order that callers name, as files have none; all rows for 0.

    Up to ``few`` rows are taken from each partition and merged. More would gather in one task, so the rows are dealt into
    ranges and written; ranges before the last that is needed stay whole, and only of that one are the first taken."""
    if not n or n <= few:
        return df.orderBy(*order).limit(n) if n else df
    ranged = materialize(df.repartitionByRange(max(1, -(-df.count() // 1_000_000)), *order).withColumn(_RANGE, F.spark_partition_id()), "ranges")
    left, whole = n, []
    for r in sorted(ranged.groupBy(_RANGE).count().collect(), key=lambda r: r[_RANGE]):
        if left <= r["count"]:
            last = ranged.filter(F.col(_RANGE) == r[_RANGE]).orderBy(*order).limit(left)
            return ranged.filter(F.col(_RANGE).isin(whole)).unionByName(last).drop(_RANGE)
        left -= r["count"]
        whole.append(r[_RANGE])
    return df


def write_report(df: DataFrame, path: str, sep: str = "\t", single: bool = False) -> None:
    """A report as delimited files with a header, in as many parts as its plan has; ``single`` puts a small one in one file."""
    out = (df.repartition(1) if single else df).write.mode("overwrite").option("sep", sep).option("header", True).option("quote", '"').option("escape", '"')
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_report(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """A report as ``write_report`` wrote it."""
    return spark.read.schema(schema).option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_pairs(df: DataFrame, path: str) -> None:
    """Labelled pairs as Parquet, compressed with zstd."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as a file, wherever Spark can write, in place of one that is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def write_json_report(spark: SparkSession, report: dict, path: str) -> None:
    """A nested report; its rows are few and already on the driver."""
    write_text(spark, json.dumps(report, ensure_ascii=False, indent=2), path)


def write_reports(spark: SparkSession, report: dict, path: str) -> None:
    """A profile (``sources``: a report by name; ``ground_truth``) below ``path``: ``profile.json``, ``profile.txt``, and the
    countries, missing values and numbers of matches as delimited tables."""
    write_json_report(spark, report, f"{path}/profile.json")
    write_text_report(spark, report, f"{path}/profile.txt")
    tables = {
        "country_distribution": ([(name, r["country"], r["count"], r["percentage"]) for name, s in report["sources"].items() for r in s.get("country_distribution", [])], "source string, country string, count long, percentage double"),
        "missingness": ([(name, r["column"], r["missing_or_empty"], r["missing_pct"]) for name, s in report["sources"].items() for r in s["missingness"]], "source string, column string, missing_or_empty long, missing_pct double"),
        "ground_truth_match_distribution": ([(r["scope"], r["match_count"], r["count"]) for r in report.get("ground_truth", {}).get("histograms", [])], "scope string, match_count int, count long"),
    }
    for name, (rows, schema) in tables.items():
        write_report(spark.createDataFrame(rows, schema), f"{path}/{name}.csv", ",", single=True)


def write_text_report(spark: SparkSession, report: dict, path: str) -> None:
    """The same as indented text."""

    def lines(value: object, depth: int) -> list[str]:
        pad = "  " * depth
        if isinstance(value, dict):
            return [x for k, v in value.items() for x in ([f"{pad}{k}:", *lines(v, depth + 1)] if isinstance(v, dict | list) else [f"{pad}{k}: {v}"])]
        if isinstance(value, list):
            return [x for v in value for x in lines(v, depth)]
        return [f"{pad}{value}"]

    write_text(spark, "\n".join(["=" * 70, "DATASET PROFILE", "=" * 70, *lines(report, 0)]) + "\n", path)
