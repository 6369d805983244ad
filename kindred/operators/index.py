"""Inverted indexes over the target records: postings, frequencies, and their store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text
from kindred.scratch import materialize

NORMALIZATION_VERSION, INDEX_VERSION = "evidence-preserving-v1", "1"
#: Exact indexes by name, and the column each is over.
EXACT = {"exact_name": "name_nfkc", "compact_name": "name_compact", "core_name": "name_core_compact", "exact_address": "address_nfkc"}
TOKENS = {"rare_name_token": "name_tokens", "rare_address_token": "address_informative_tokens"}
_KEY = ["country_key", "value"]
#: Frequent keys that are sent to every executor at most.
FEW_KEYS = 200_000
#: Records for each text, on average, from which on words and n-grams are made by text; tasks that a key of a store is dealt over.
SHARED, SLOTS = 4, 16


def exact_postings(entities: DataFrame, column: str) -> DataFrame:
    """``country_key``, ``value``, ``entity_id``: a row for each record with both; repeats stay."""
    return entities.filter((F.col("country_key") != "") & (F.col(column) != "")).select("country_key", F.col(column).alias("value"), "entity_id")


def exploded_postings(entities: DataFrame, column: str, pattern: str, once: bool = False) -> DataFrame:
    """Different postings of the parts of a joined list. Parts of one record are made distinct before they are exploded, so
    that the shuffle for the rest carries each once; where no id comes up again (``once``) there is none."""
    parts = F.array_distinct(text.split_nonempty(F.col(column), pattern))
    made = entities.filter(F.col("country_key") != "").select("country_key", F.explode(parts).alias("value"), "entity_id")
    return made if once else made.distinct()


def gram_postings(entities: DataFrame, once: bool = False) -> DataFrame:
    """Different postings of 3- and 4-grams of compact names."""
    grams = text.char_ngrams(F.col("name_compact"))
    made = entities.filter((F.col("country_key") != "") & (F.col("name_compact") != "")).select("country_key", F.explode(grams).alias("value"), "entity_id")
    return made if once else made.distinct()


def postal_postings(entities: DataFrame, once: bool = False) -> DataFrame:
    return exploded_postings(entities, "postal_candidates", r"\|", once)


def frequency(postings: DataFrame) -> DataFrame:
    """Rows per key, as ``doc_freq``; combined before the shuffle."""
    return postings.groupBy(*_KEY).agg(F.count("*").alias("doc_freq"))


def capped(postings: DataFrame, max_df: int) -> DataFrame:
    """Postings of keys with at most ``max_df`` rows. Counting is combined before its shuffle and the join back can be split
    where a key is hot, which a window over the key could not."""
    rare = frequency(postings).filter(F.col("doc_freq") <= max_df)
    return postings.join(rare.select(*_KEY), _KEY, "left_semi")


def without_frequent(postings: DataFrame, max_df: int) -> DataFrame:
    """What ``capped`` returns, for postings that may be read twice: keys over the cap, one for ``max_df`` rows at most, are
    found at once and sent to where the postings are, so that no row of theirs is shuffled."""
    frequent = materialize(frequency(postings).filter(F.col("doc_freq") > max_df).select(*_KEY), "frequent")
    return postings.join(F.broadcast(frequent) if frequent.count() <= FEW_KEYS else frequent, _KEY, "left_anti")


def postings_by_text(entities: DataFrame, column: str, parts: Column, max_df: int, once: bool) -> DataFrame | None:
    """Different postings of rare parts of a column where many records share a text, else none: parts are made and counted once
    for the texts of an id (one, where no id comes up again), and only ids that have rare ones are joined to them."""
    there = entities.filter((F.col("country_key") != "") & (F.col(column) != ""))
    if once:
        own = there.select("country_key", F.array(column).alias("texts"), "entity_id")
    else:
        own = materialize(there.groupBy("country_key", "entity_id").agg(F.array_sort(F.collect_set(column)).alias("texts")), "ids")
    texts = materialize(own.groupBy("country_key", "texts").agg(F.count("*").alias("records")), "texts")
    if SHARED * texts.count() > own.count():
        return None
    each = texts.select("country_key", "texts", "records", F.explode("texts").alias(column))
    made = each.select("country_key", "texts", "records", F.explode(parts).alias("value")).distinct()
    rare = made.groupBy(*_KEY).agg(F.sum("records").alias("doc_freq")).filter(F.col("doc_freq") <= max_df)
    lists = made.join(rare.select(*_KEY), _KEY, "left_semi").groupBy("country_key", "texts").agg(F.collect_list("value").alias("values"))
    found = own.join(materialize(lists, "lists"), ["country_key", "texts"])
    return found.select("country_key", F.explode("values").alias("value"), "entity_id")


def token_postings(entities: DataFrame, column: str, max_df: int = 2000) -> DataFrame:
    """Different postings of rare words; a word counts within its country, over all sources."""
    return capped(exploded_postings(entities, column, " "), max_df)


def ngram_postings(entities: DataFrame, max_df: int = 1000) -> DataFrame:
    """Different postings of rare 3- and 4-grams of compact names."""
    return capped(gram_postings(entities), max_df)


def keyed(df: DataFrame) -> DataFrame:
    """With ``lookup_key`` in place of its two parts."""
    return df.select(text.lookup_key(F.col("country_key"), F.col("value")).alias("lookup_key"), *(c for c in df.columns if c not in _KEY))


def all_postings(entities: DataFrame, max_name_df: int = 2000, max_address_df: int = 2000, ngrams: bool = False, max_ngram_df: int = 1000) -> dict[str, DataFrame]:
    """Every index by name."""
    out = {name: exact_postings(entities, column) for name, column in EXACT.items()}
    out["postal"] = postal_postings(entities)
    out["rare_name_token"] = token_postings(entities, TOKENS["rare_name_token"], max_name_df)
    out["rare_address_token"] = token_postings(entities, TOKENS["rare_address_token"], max_address_df)
    if ngrams:
        out["name_ngram"] = ngram_postings(entities, max_ngram_df)
    return out


def written_postings(entities: DataFrame, max_name_df: int = 2000, max_address_df: int = 2000, ngrams: bool = False, max_ngram_df: int = 1000) -> dict[str, DataFrame]:
    """The same of entities that are written already. Whether ids come up again and which keys are frequent is found first, so
    that no postings are shuffled to make them distinct, and none that are left out."""
    once = entities.groupBy(F.xxhash64("entity_id")).count().filter("count > 1").isEmpty()
    out = {name: exact_postings(entities, column) for name, column in EXACT.items()}
    out["postal"] = postal_postings(entities, once)
    for name, cap in (("rare_name_token", max_name_df), ("rare_address_token", max_address_df)):
        shared = postings_by_text(entities, TOKENS[name], F.array_distinct(text.split_nonempty(F.col(TOKENS[name]), " ")), cap, once)
        out[name] = without_frequent(exploded_postings(entities, TOKENS[name], " ", once), cap) if shared is None else shared
    if ngrams:
        shared = postings_by_text(entities, "name_compact", text.char_ngrams(F.col("name_compact")), max_ngram_df, once)
        out["name_ngram"] = without_frequent(gram_postings(entities, once), max_ngram_df) if shared is None else shared
    return out


def metadata(spark: SparkSession, counts: dict[str, int], **settings: object) -> DataFrame:
    """Key and value of what an index was built from and with."""
    values = {"source2_rows": counts.get("S2", 0), "source3_rows": counts.get("S3", 0), "total_entities": sum(counts.values()), **settings, "normalization_version": NORMALIZATION_VERSION, "index_version": INDEX_VERSION}
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string")


def build_indexes(entities: DataFrame, path: str, *, max_name_token_df: int = 2000, max_address_token_df: int = 2000, enable_ngrams: bool = False, max_ngram_df: int = 1000) -> None:
    """Writes entities, indexes, frequencies and metadata as Parquet below ``path``, in place of what was there.

    Index tables are sorted by key within files, so that statistics of row groups serve point lookups."""
    spark = entities.sparkSession

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    whole = save(entities, "entities")
    for name, postings in written_postings(whole, max_name_token_df, max_address_token_df, enable_ngrams, max_ngram_df).items():
        slot = F.pmod(F.xxhash64("entity_id"), F.lit(SLOTS))  # so that no task gets all records under a key that many have
        saved = save(postings.repartition(*_KEY, slot).sortWithinPartitions(*_KEY), f"{name}_index")
        if name in EXACT or name == "postal":
            save(frequency(saved), f"{name}_frequency")
    counts = {r["source"]: r["count"] for r in whole.groupBy("source").count().collect()}
    save(metadata(spark, counts, chunk_size=0, threads=spark.sparkContext.defaultParallelism, enable_ngrams=enable_ngrams, max_name_token_df=max_name_token_df, max_address_token_df=max_address_token_df), "metadata")


def save_bucketed(postings: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Saves postings as a table bucketed and sorted by key, with statistics, in the warehouse or below ``path``, in place of
    what was there. Query records bucketed alike join it without a shuffle of the index."""
    writer = postings.write.mode("overwrite").bucketBy(buckets, *_KEY).sortBy(*_KEY)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    postings.sparkSession.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
    return postings.sparkSession.table(table)


def known_rows(spark: SparkSession, table: str) -> int:
    """How many rows a table's statistics say it has."""
    said = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Statistics'").first()["data_type"]
    return int(said.split(",")[1].split()[0])
