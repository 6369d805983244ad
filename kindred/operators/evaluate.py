"""How much of the ground truth the candidates recover, and at what volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import text
from kindred.operators import blocking

_PAIR = ["source1_entity_id", "candidate_entity_id"]
#: What a per-query report holds.
REPORT = "source1_entity_id string, true_count long, candidate_count long, recovered_count long"


def true_pairs(truth: DataFrame) -> DataFrame:
    """Different pairs of a query and a target that belong together."""
    ids = F.array_distinct(text.parse_match_ids(F.col("matched_entity_ids")))
    return truth.select("source1_entity_id", F.explode(ids).alias("true_entity_id")).distinct()


def truth_lists(queries: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """``source1_entity_id`` and ``matched_entity_ids``: for each query the sorted ids of the targets with the same ``key``.

    The list of a key is made once and joined to its queries, so pairs are neither joined nor sorted one by one. Queries that
    share an id, usually none, get one list of all their targets."""
    lists = targets.groupBy(key).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    keys = queries.groupBy("source1_entity_id").agg(F.collect_list(key).alias("_keys"))
    one = keys.filter(F.size("_keys") <= 1).select("source1_entity_id", F.get("_keys", F.lit(0)).alias(key)).join(lists.select(key, F.array_join("ids", ",").alias("matched_entity_ids")), key, "left")
    several = keys.filter(F.size("_keys") > 1).select("source1_entity_id", F.explode("_keys").alias(key)).join(lists, key, "left")
    several = several.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("ids"))), ",").alias("matched_entity_ids"))
    return one.select("source1_entity_id", F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids")).unionByName(several)


def flagged(found: DataFrame, truth_pairs: DataFrame) -> DataFrame:
    """``found`` with ``is_true``, whether the pair belongs together, and ``n``, 1. Tallies have both already."""
    if "n" in found.columns:
        return found
    right = truth_pairs.select("source1_entity_id", F.col("true_entity_id").alias("candidate_entity_id"), F.lit(True).alias("_t"))
    return found.join(right, _PAIR, "left").withColumns({"is_true": F.coalesce("_t", F.lit(False)), "n": F.lit(1).cast("long")}).drop("_t")


def _true_counts(truth: DataFrame) -> DataFrame:
    """``source1_entity_id`` and ``true_count`` of true pairs, or of such counts."""
    return truth if "true_count" in truth.columns else truth.groupBy("source1_entity_id").agg(F.count("*").alias("true_count"))


def _total(truth: DataFrame) -> DataFrame:
    return truth.agg(F.coalesce(F.sum("true_count"), F.lit(0)).alias("total")) if "true_count" in truth.columns else truth.agg(F.count("*").alias("total"))


def _pairs_if(condition: Column) -> Column:
    """How many pairs of tallies or evidence it holds for."""
    return F.sum(F.when(condition, F.col("n")).otherwise(0))


def per_s1_report(s1_ids: DataFrame, pairs: DataFrame, truth_pairs: DataFrame) -> DataFrame:
    """``source1_entity_id``, ``true_count``, ``candidate_count``, ``recovered_count``; a row for each query. ``pairs`` may be
    tallies, and ``truth_pairs`` counts."""
    seen = flagged(pairs, truth_pairs).groupBy("source1_entity_id").agg(F.sum("n").alias("candidate_count"), _pairs_if(F.col("is_true")).alias("recovered_count"))
    true = _true_counts(truth_pairs)
    joined = s1_ids.select("source1_entity_id").join(true, "source1_entity_id", "left").join(seen, "source1_entity_id", "left")
    return joined.select("source1_entity_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("true_count", "candidate_count", "recovered_count")))


def summary(report: DataFrame) -> DataFrame:
    """One row of totals and rates over a per-query report."""
    multi, single = F.col("true_count") >= 2, F.col("true_count") == 0
    rate = text.safe_ratio
    sums = report.agg(
        F.count("*").alias("queries"),
        F.sum("true_count").alias("true_pairs"),
        F.sum("candidate_count").alias("candidate_pairs"),
        F.sum("recovered_count").alias("recovered_pairs"),
        F.avg("candidate_count").alias("avg_candidates"),
        F.percentile("candidate_count", F.lit(0.5)).alias("median_candidates"),
        F.percentile("candidate_count", F.lit(0.95)).alias("p95_candidates"),
        F.max("candidate_count").alias("max_candidates"),
        F.count_if(single).alias("singletons"),
        F.count_if(single & (F.col("candidate_count") == 0)).alias("clean_singletons"),
        F.sum(F.when(multi, F.col("true_count")).otherwise(0)).alias("multi_true"),
        F.sum(F.when(multi, F.col("recovered_count")).otherwise(0)).alias("multi_recovered"),
        F.count_if(F.col("true_count") > 0).alias("matched_queries"),
        F.count_if((F.col("true_count") > 0) & (F.col("recovered_count") == F.col("true_count"))).alias("fully_recovered"),
    )
    return sums.select(
        "*",
        rate(F.col("recovered_pairs"), F.col("true_pairs")).alias("pair_recall"),
        rate(F.col("clean_singletons"), F.col("singletons")).alias("clean_singleton_rate"),
        rate(F.col("multi_recovered"), F.col("multi_true")).alias("multi_match_recall"),
        rate(F.col("fully_recovered"), F.col("matched_queries")).alias("all_matches_rate"),
    )


def block_diagnostics(found: DataFrame, truth_pairs: DataFrame, n_true: int | None = None) -> DataFrame:
    """For each block of V1, in order: pairs, queries with candidates, recovered pairs and recall, alone and of the union
    with the blocks before it.

    All come from the evidence table, or its tallies, in one pass, counted by query first: a pair counts for the blocks in its mask, and for
    the unions from its first block on."""
    names = blocking.BLOCKS[:7]
    own = flagged(found, truth_pairs)
    true, first, zero = F.col("is_true"), F.col("first_block"), F.lit(0).cast("long")
    counts = [c for i, b in enumerate(names) for c in (_pairs_if(blocking.has(b)).alias(f"n{i}"), _pairs_if(blocking.has(b) & true).alias(f"r{i}"), _pairs_if(first == i).alias(f"fn{i}"), _pairs_if((first == i) & true).alias(f"fr{i}"))]
    each = own.groupBy("source1_entity_id").agg(*counts, F.min("first_block").alias("first"))
    sums = each.agg(*(c for i in range(len(names)) for c in (F.sum(f"n{i}").alias(f"n{i}"), F.count_if(F.col(f"n{i}") > 0).alias(f"s{i}"), F.sum(f"r{i}").alias(f"r{i}"), F.sum(f"fn{i}").alias(f"fn{i}"), F.count_if(F.col("first") == i).alias(f"fs{i}"), F.sum(f"fr{i}").alias(f"fr{i}"))))
    total = _total(truth_pairs) if n_true is None else found.sparkSession.range(1).select(F.lit(n_true).alias("total"))

    def so_far(name: str, i: int) -> Column:
        return sum((F.coalesce(f"{name}{j}", zero) for j in range(i + 1)), zero)

    rows = [
        F.struct(
            F.lit(i + 1).alias("block_order"), F.lit(b).alias("block"),
            F.coalesce(f"n{i}", zero).alias("candidate_pairs"), F.coalesce(f"s{i}", zero).alias("s1_with_candidates"), F.coalesce(f"r{i}", zero).alias("individual_recovered_true_pairs"),
            text.safe_ratio(F.coalesce(f"r{i}", zero), F.col("total")).alias("individual_recall"),
            so_far("fn", i).alias("cumulative_candidate_pairs"), so_far("fs", i).alias("cumulative_s1_with_candidates"), so_far("fr", i).alias("cumulative_recovered_true_pairs"),
            text.safe_ratio(so_far("fr", i), F.col("total")).alias("cumulative_recall"),
        )
        for i, b in enumerate(names)
    ]
    return sums.join(F.broadcast(total)).select(F.inline(F.array(*rows)))


def strategy_stats(found: DataFrame, truth_pairs: DataFrame, s1_ids: DataFrame) -> DataFrame:
    """Volume and recall of the three strategies, and of their parts: the strong blocks and the name-and-address rule."""
    rules = {"v1": blocking.v1(), "strong": blocking.is_strong(), "name_and_address": (F.col("name_overlap") >= 1) & (F.col("address_overlap") >= 1), "v2": blocking.v2(), "v3": blocking.v3()}
    own = flagged(found, truth_pairs)
    each = own.groupBy("source1_entity_id").agg(*(c for name, rule in rules.items() for c in (_pairs_if(rule).alias(f"{name}_n"), _pairs_if(rule & F.col("is_true")).alias(f"{name}_r"))))
    true = _true_counts(truth_pairs).withColumnRenamed("true_count", "t")
    sums = each.join(true, "source1_entity_id", "left").agg(*(c for name in rules for c in (F.sum(f"{name}_n").alias(f"{name}_n"), F.count_if(F.col(f"{name}_n") > 0).alias(f"{name}_s"), F.sum(f"{name}_r").alias(f"{name}_r"), F.count_if(F.col(f"{name}_r") == F.col("t")).alias(f"{name}_f"))))
    total = _total(truth_pairs)
    size = s1_ids.agg(F.count("*").alias("queries"))
    rows = [
        F.struct(
            F.lit(name).alias("strategy"), F.col(f"{name}_n").alias("candidate_pairs"), F.col(f"{name}_s").alias("s1_with_candidates"), F.col(f"{name}_r").alias("recovered_true_pairs"), F.col(f"{name}_f").alias("fully_recovered_s1"),
            text.safe_ratio(F.col(f"{name}_r"), F.col("total")).alias("recall"), text.safe_ratio(F.col(f"{name}_n"), F.col("queries")).alias("candidates_per_s1"),
        )
        for name in rules
    ]
    return sums.join(F.broadcast(total)).join(F.broadcast(size)).select(F.inline(F.array(*rows))).filter("candidate_pairs > 0")
