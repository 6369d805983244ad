"""Labelled pairs for a classifier: positives from the ground truth and hard negatives from exact blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import text, udfs
from kindred.functions.lexicon import SEPARATOR
from kindred.operators import blocking, index
from kindred.sources.tsv import head

PAIR_COLUMNS = ["s1_entity_id", "candidate_source", "candidate_entity_id", "label", "s1_name", "s1_address", "s1_country", "candidate_name", "candidate_address", "candidate_country"]


def split(s1: DataFrame, order: list[str | Column], max_train: int = 200_000, max_valid: int = 30_000, hashing: str = "md5") -> DataFrame:
    """Query records with ``split``: a tenth of them, by a hash of the id, are ``valid``, the others ``train``; of each the
    first by ``order``, up to its maximum (0: all). ``hashing`` is ``md5``, ``xxhash64``, or ``pandas`` for pandas' hash.

    The maximum is a limit of each split on its own, so no window has a split as its only partition."""
    bucket = {"md5": lambda c: text.md5_bucket(c, 10), "xxhash64": lambda c: F.pmod(F.xxhash64(c), F.lit(10)), "pandas": udfs.pandas_hash_bucket}[hashing]
    marked = s1.withColumn("split", F.when(bucket(F.col("source1_entity_id")) == 0, "valid").otherwise("train"))
    out = None
    for name, most in (("train", max_train), ("valid", max_valid)):
        part = marked.filter(F.col("split") == name)
        part = head(part, most, order)
        out = part if out is None else out.unionByName(part)
    return out


def _hydrated(pairs: DataFrame, s1: DataFrame, entities: DataFrame, label: int) -> DataFrame:
    q = s1.select(F.col("source1_entity_id").alias("s1_entity_id"), F.col("business_name").alias("s1_name"), F.col("business_address").alias("s1_address"), F.col("country").alias("s1_country"))
    t = entities.select(F.col("source").alias("candidate_source"), F.col("entity_id").alias("candidate_entity_id"), F.col("business_name").alias("candidate_name"), F.col("business_address").alias("candidate_address"), F.col("country").alias("candidate_country"))
    return pairs.join(q, "s1_entity_id").join(t, "candidate_entity_id").withColumn("label", F.lit(label)).select(*PAIR_COLUMNS)


def positives(s1: DataFrame, truth: DataFrame, entities: DataFrame, k: int = 2) -> DataFrame:
    """The first ``k`` listed targets of each query that exist; label 1."""
    ids = F.slice(text.parse_match_ids(F.col("matched_entity_ids")), 1, k)
    pairs = truth.select(F.col("source1_entity_id").alias("s1_entity_id"), F.explode(ids).alias("candidate_entity_id"))
    return _hydrated(pairs, s1, entities, 1)


def light_keys(s1: DataFrame) -> DataFrame:
    """The four lookup keys of the lighter profile, as columns ``value`` by block, over ``name_nfkc`` and ``address_nfkc``."""
    name = F.col("name_nfkc")
    return s1.withColumns({"name_compact": text.light_compact(name), "name_core_compact": text.light_core(name)})


def hard_negatives(s1: DataFrame, truth: DataFrame, entities: DataFrame, k: int = 4, key_profile: str = "shared", order: Column | None = None) -> DataFrame:
    """Up to ``k`` targets of each query that share a name, compact name, core name or address but do not belong to it; label
    0. Which ones is decided by a hash of the target, the same in every run, ties by its id.

    The rank within a query is limited before its shuffle (``rn <= k``), so a query with many candidates sends few."""
    own = light_keys(s1) if key_profile == "light" else s1
    found = None
    for block in index.EXACT:
        part = blocking.block_rows(own, index.exact_postings(entities, index.EXACT[block]), block).select(F.col("source1_entity_id").alias("s1_entity_id"), "candidate_entity_id")
        found = part if found is None else found.unionByName(part)
    true = truth.select(F.col("source1_entity_id").alias("s1_entity_id"), F.explode(text.parse_match_ids(F.col("matched_entity_ids"))).alias("candidate_entity_id"))
    left = found.distinct().join(true, ["s1_entity_id", "candidate_entity_id"], "left_anti")
    source = F.split("candidate_entity_id", "-")[0]
    by = F.xxhash64(source, F.lit(SEPARATOR), "candidate_entity_id") if order is None else order
    rank = F.row_number().over(Window.partitionBy("s1_entity_id").orderBy(by, "candidate_entity_id"))
    return _hydrated(left.withColumn("_rn", rank).filter(F.col("_rn") <= k).drop("_rn"), s1, entities, 0)


def training_pairs(s1_split: DataFrame, truth: DataFrame, entities: DataFrame, k_positive: int = 2, k_negative: int = 4, **options) -> DataFrame:
    """Positives and hard negatives of both splits, with ``split``."""
    mine = truth.join(s1_split.select("source1_entity_id"), "source1_entity_id", "left_semi")
    both = positives(s1_split, mine, entities, k_positive).unionByName(hard_negatives(s1_split, mine, entities, k_negative, **options))
    return both.join(s1_split.select(F.col("source1_entity_id").alias("s1_entity_id"), "split"), "s1_entity_id")
