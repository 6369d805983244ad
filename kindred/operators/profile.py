"""Profiles of source tables and ground truth, exact at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import text


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column``, ``missing_or_empty``, ``missing_pct``, ``rows``: one pass for all columns."""
    sums = df.agg(F.count("*").alias("rows"), *(F.count_if(text.clean_text(F.col(c)) == "").alias(f"m{i}") for i, c in enumerate(columns)))
    entries = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_or_empty")) for i, c in enumerate(columns)))
    pct = F.when(F.col("rows") == 0, 0.0).otherwise(F.round(100.0 * F.col("missing_or_empty") / F.col("rows"), 4))
    return sums.select("rows", F.inline(entries)).select("column", "missing_or_empty", pct.alias("missing_pct"), "rows")


def value_distribution(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """Non-empty values and their counts; percentages are of all rows, empty ones included."""
    cleaned = df.select(text.clean_text(F.col(column)).alias(name))
    counts = cleaned.groupBy(name).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.filter(F.col(name) != "").join(F.broadcast(total)).select(name, "count", F.round(100.0 * F.col("count") / F.col("total"), 4).alias("percentage"))


def length_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lengths of non-empty values in characters: ``column``, ``count``, ``mean``, ``std`` (of the population), ``min``,
    ``max``; three decimals."""
    aggs = []
    for i, c in enumerate(columns):
        size = F.length(text.clean_text(F.col(c)))
        size = F.when(size > 0, size)
        aggs += [F.count(size).alias(f"n{i}"), F.avg(size).alias(f"a{i}"), F.stddev_pop(size).alias(f"s{i}"), F.min(size).alias(f"lo{i}"), F.max(size).alias(f"hi{i}")]
    entries = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.round(f"a{i}", 3).alias("mean"), F.round(f"s{i}", 3).alias("std"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max")) for i, c in enumerate(columns)))
    return df.agg(*aggs).select(F.inline(entries))


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent non-empty values, exact; ties by value."""
    counts = df.select(text.clean_text(F.col(column)).alias("value")).filter("value <> ''").groupBy("value").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "value").limit(n)


def _lists(truth: DataFrame) -> DataFrame:
    """The different lists of a ground truth, and ``n``, how many queries have each."""
    return truth.groupBy("matched_entity_ids").agg(F.count("*").alias("n"))


def match_histogram(truth: DataFrame, prefixes: tuple[str, ...] = ("S2-", "S3-")) -> DataFrame:
    """How many queries have how many matches: ``scope`` (all, or a source), ``match_count``, ``count``. Equal lists are taken
    apart once."""
    lists, ids = _lists(truth), text.parse_match_ids(F.col("matched_entity_ids"))
    scopes = [F.struct(F.lit("all").alias("scope"), F.size(ids).alias("match_count"))]
    for prefix in prefixes:
        mine = F.filter(ids, lambda x: F.startswith(x, F.lit(prefix)))  # noqa: B023 - called at once
        scopes.append(F.struct(F.lit(prefix.rstrip("-")).alias("scope"), F.size(mine).alias("match_count")))
    return lists.select("n", F.inline(F.array(*scopes))).groupBy("scope", "match_count").agg(F.sum("n").alias("count"))


def truth_summary(truth: DataFrame) -> DataFrame:
    """Queries, those without a match, their share in percent, and pairs."""
    ids = F.size(text.parse_match_ids(F.col("matched_entity_ids"))).cast("long")
    sums = _lists(truth).select("n", ids.alias("ids")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("queries"), F.coalesce(F.sum(F.when(F.col("ids") == 0, F.col("n"))), F.lit(0)).alias("singletons"), F.sum(F.col("n") * F.col("ids")).alias("pairs"))
    return sums.select("queries", "singletons", F.round(100 * text.safe_ratio(F.col("singletons"), F.col("queries")), 4).alias("singleton_pct"), "pairs")


def profile_source(df: DataFrame, columns: list[str], n_top: int = 20) -> dict:
    """Everything about a source table as a nested report; its parts are few rows each."""
    rows = lambda d: [r.asDict() for r in d.collect()]
    there = [c for c in columns if c in df.columns]
    report = {"columns": df.columns, "missingness": rows(missingness(df, there)), "lengths": rows(length_stats(df, there))}
    report["rows"] = report["missingness"][0]["rows"] if there else df.count()
    report |= {f"top_{c}": rows(top_values(df, c, n_top)) for c in there if c.startswith("business_")}
    if "country" in df.columns:
        report["country_distribution"] = rows(value_distribution(df, "country", "country").orderBy(F.desc("count"), "country"))
    return report


def profile_truth(truth: DataFrame) -> dict:
    """Everything about a ground truth as a nested report."""
    return truth_summary(truth).first().asDict() | {"histograms": [r.asDict() for r in match_histogram(truth).orderBy("scope", "match_count").collect()]}
