"""Entity records, indexes and ground truth, projected from tables that hold none, the same in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.lexicon import GENERIC_ADDRESS_TOKENS, US_STATES
from kindred.functions.text import core_pattern
from kindred.operators import blocking, evaluate, index, meet, normalize
from kindred.scratch import materialize

#: The caps on words and n-grams that indexes have by default.
MAX_DF, MAX_NGRAM_DF = 2000, 1000
#: A tight cap, for queries about what caps leave out.
TIGHT_DF = 20
#: Where records come from.
KINDS = ("documents", "customers", "lineitems")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Dealt out by ``key``: many short rows may lie in a file or two, which as many tasks would read and normalise."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each document: its first four words are the name, all others the address, its language the country.
    ``full`` stands for all its words."""
    folded = F.replace(F.lower("text"), F.lit("ß"), F.lit("ss"))
    words = F.split(F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " ")), " ")
    source = F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"))
    base = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("country"), source.alias("source"), words.alias("w"))
    rest = F.slice("w", F.lit(5), F.greatest(F.size("w"), F.lit(1)))
    return base.select("source", F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("entity_id"), F.array_join(F.slice("w", 1, 4), " ").alias("business_name"), F.array_join(rest, " ").alias("business_address"), "country", F.xxhash64(F.array_join("w", " ")).alias("full"))


def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each customer, with an address that has a postal code in the manner of its country."""
    key = F.col("c_custkey")
    number, nation = (100 + key % 900).cast("string"), F.lower("n_name")
    address = (
        F.when(key % 3 == 0, F.concat_ws(" ", number, F.lit("main street"), nation, (100000 + key % 50).cast("string")))
        .when(key % 3 == 1, F.concat_ws(" ", number, F.lit("main street"), nation, F.lit("tx"), (10000 + key % 50).cast("string")))
        .otherwise(F.concat_ws(" ", number, F.lit("rue"), nation, (10000 + key % 50).cast("string"), F.lit("ville")))
    )
    country = F.when(key % 3 == 0, "India").when(key % 3 == 1, "US").otherwise("France")
    source = F.concat(F.lit("S"), (F.floor(key / 3) % 3 + 1).cast("string"))
    joined = _spread(table(spark, sf_dir, "customer"), "c_custkey").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    made = joined.select(source.alias("source"), F.concat_ws("-", source, key.cast("string")).alias("entity_id"), F.concat_ws(" ", F.lower("c_mktsegment"), nation, F.lit("pvt ltd")).alias("business_name"), address.alias("business_address"), country.alias("country"))
    return made.withColumn("full", F.xxhash64("business_name", "country"))


def lineitem_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target for each line item, with names, addresses and postal codes that many share, some more than the caps of
    retrieval let through; a query for each different name."""
    flags, number = F.lower(F.concat("l_returnflag", "l_linestatus")), F.col("l_quantity").cast("int")
    name = F.when(F.col("l_linenumber") <= 3, F.concat(F.lit("freight "), F.lower("l_returnflag"))).otherwise(F.concat_ws(" ", F.lit("parcel"), flags, (number % 7).cast("string")))
    code = F.when(number == 50, "99999").otherwise(F.concat(F.lit("7870"), (number % 5).cast("string")))
    address = F.concat_ws(" ", F.concat(F.lit("gate"), F.col("l_linenumber").cast("string")), F.lit("main street tx"), code)
    base = _spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select("l_orderkey", "l_linenumber", name.alias("business_name"), address.alias("business_address"), F.lit("US").alias("country"))
    source = F.when(F.col("l_linenumber") % 2 == 0, "S2").otherwise("S3")
    targets = base.select(source.alias("source"), F.concat_ws("-", source, "l_orderkey", "l_linenumber").alias("entity_id"), "business_name", "business_address", "country")
    queries = base.groupBy("business_name", "country").agg(F.min("business_address").alias("business_address"))
    queries = queries.select(F.lit("S1").alias("source"), F.concat(F.lit("S1-"), F.replace("business_name", F.lit(" "), F.lit("_"))).alias("entity_id"), "business_name", "business_address", "country")
    return targets.unionByName(queries).withColumn("full", F.xxhash64("business_name"))


_RECORDS = {"documents": document_records, "customers": customer_records, "lineitems": lineitem_records}


class Linkage:
    """Queries, targets, indexes and truth over the records of a kind. ``max_df`` caps words."""

    def __init__(self, spark: SparkSession, sf_dir: str, kind: str = "documents", max_df: int = MAX_DF):
        self.spark, self.max_df = spark, max_df
        self.records, self.kind = _RECORDS[kind](spark, sf_dir), kind

    @cached_property
    def views(self) -> DataFrame:
        """Line items have few texts, which are normalised once each."""
        if self.kind != "lineitems":
            return normalize.normalize_folded(self.records)
        columns = ["business_name", "business_address", "country"]
        made = normalize.normalize_folded(self.records.select(*columns).distinct())
        made = materialize(made.withColumnsRenamed({c: f"_{c}" for c in columns}), "texts")
        same = [self.records[c].eqNullSafe(made[f"_{c}"]) for c in columns]
        return self.records.join(made, same).drop(*(f"_{c}" for c in columns))

    def views_of(self, ids: DataFrame) -> DataFrame:
        """The views of the records with some few ids (``entity_id``): no others are normalised."""
        return normalize.normalize_folded(materialize(self.records.join(F.broadcast(ids), "entity_id", "left_semi"), "some"))

    @cached_property
    def saved(self) -> DataFrame:
        """The views, written once: every index and every block reads them, and none normalises again."""
        return materialize(self.views, "views")

    @cached_property
    def s1_views(self) -> DataFrame:
        return self.saved.filter("source = 'S1'").withColumnRenamed("entity_id", "source1_entity_id")

    @cached_property
    def s1(self) -> DataFrame:
        return normalize.query_records(self.saved.filter("source = 'S1'"))

    @cached_property
    def targets(self) -> DataFrame:
        return self.saved.filter("source <> 'S1'").select(*normalize.ENTITY_COLUMNS)

    @cached_property
    def postings(self) -> dict[str, DataFrame]:
        return index.all_postings(self.targets, self.max_df, self.max_df)

    @cached_property
    def truth(self) -> DataFrame:
        """Each query's list of targets with the same words (customers and line items: the same name)."""
        own = self.saved if "saved" in self.__dict__ else materialize(self.records.select("source", "entity_id", "full"), "truth")
        q = own.filter("source = 'S1'").select(F.col("entity_id").alias("source1_entity_id"), "full")
        t = own.filter("source <> 'S1'").select(F.col("entity_id").alias("id"), "full")
        return evaluate.truth_lists(q, t, "full")

    @property
    def caps(self) -> dict[str, int]:
        return {b: self.max_df for b in index.TOKENS}

    def keys(self, blocks: list[str]) -> DataFrame:
        return meet.record_keys(self.views, blocks, F.col("source") == "S1", F.col("full"))

    @cached_property
    def v1_keys(self) -> DataFrame:
        return self.keys(blocking.BLOCKS[:7])

    @cached_property
    def evidence(self) -> DataFrame:
        return meet.pairs(self.keys(blocking.BLOCKS[:7]), blocking.BLOCKS[:7], self.caps, whole=True)

    def candidates(self, rule: str, blocks: list[str] | None = None) -> DataFrame:
        """The pairs that a strategy keeps, of the blocks given or those of V1."""
        blocks = blocks or blocking.BLOCKS[:7]
        return meet.pairs(self.keys(blocks), blocks, self.caps, rule)

    @cached_property
    def tallies(self) -> DataFrame:
        """Evidence with what is true, counted by query and kind of pair."""
        return meet.tallies(self.v1_keys, blocking.BLOCKS[:7], self.caps)

    @cached_property
    def s1_ids(self) -> DataFrame:
        return self.records.filter("source = 'S1'").select(F.col("entity_id").alias("source1_entity_id"))

    @cached_property
    def true_counts(self) -> DataFrame:
        """``source1_entity_id`` and ``true_count``, the targets that belong to it; queries without any are left out."""
        own = self.v1_keys.select("asks", "id", F.explode("truth").alias("full")).filter("full IS NOT NULL")
        found = own.filter("NOT asks").groupBy("full").agg(F.count("*").alias("true_count"))
        asked = own.filter("asks").select(F.col("id").alias("source1_entity_id"), "full")
        return asked.join(found, "full").groupBy("source1_entity_id").agg(F.sum("true_count").alias("true_count"))


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_CORE = core_pattern()
_RAW = {
    "documents": r"""
d AS (SELECT doc_id, lang, string_split(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
raw AS (
  SELECT 'S' || (1 + doc_id % 3) AS source, 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, array_to_string(w[1:4], ' ') AS business_name,
         array_to_string(w[5:], ' ') AS business_address, lang AS country, array_to_string(w, ' ') AS full_text FROM d),""",
    "customers": r"""
raw AS (
  SELECT 'S' || (1 + (c_custkey // 3) % 3) AS source, 'S' || (1 + (c_custkey // 3) % 3) || '-' || c_custkey AS entity_id,
         lower(c_mktsegment) || ' ' || lower(n_name) || ' pvt ltd' AS business_name,
         CASE c_custkey % 3 WHEN 0 THEN (100 + c_custkey % 900) || ' main street ' || lower(n_name) || ' ' || (100000 + c_custkey % 50)
                            WHEN 1 THEN (100 + c_custkey % 900) || ' main street ' || lower(n_name) || ' tx ' || (10000 + c_custkey % 50)
                            ELSE (100 + c_custkey % 900) || ' rue ' || lower(n_name) || ' ' || (10000 + c_custkey % 50) || ' ville' END AS business_address,
         CASE c_custkey % 3 WHEN 0 THEN 'India' WHEN 1 THEN 'US' ELSE 'France' END AS country, business_name || ' ' || country AS full_text
  FROM customer JOIN nation ON c_nationkey = n_nationkey),""",
    "lineitems": r"""
base AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 3 THEN 'freight ' || lower(l_returnflag) ELSE 'parcel ' || lower(l_returnflag || l_linestatus) || ' ' || (l_quantity::INT % 7) END AS business_name,
         'gate' || l_linenumber || ' main street tx ' || CASE WHEN l_quantity = 50 THEN '99999' ELSE '7870' || (l_quantity::INT % 5) END AS business_address, 'US' AS country FROM lineitem),
raw AS (
  SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'S2' ELSE 'S3' END AS source, source || '-' || l_orderkey || '-' || l_linenumber AS entity_id, business_name, business_address, country, business_name AS full_text FROM base
  UNION ALL SELECT 'S1', 'S1-' || replace(business_name, ' ', '_'), business_name, min(business_address), country, business_name FROM base GROUP BY ALL),""",
}


def records_sql(kind: str = "documents", max_df: int = MAX_DF) -> str:
    """Records of a kind, normalised; then queries, targets, postings, evidence and truth, as common table expressions."""
    return rf"""
WITH {_RAW[kind]}
tokens AS (
  SELECT *, list_filter(string_split(regexp_replace(business_address, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS aw,
         list_filter(string_split(regexp_replace(business_name, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS name_words, lower(country) AS country_key FROM raw),
numbers AS (
  SELECT *, array_to_string(name_words, ' ') AS name_text,
         CASE country_key
           WHEN 'us' THEN list_filter(regexp_extract_all(business_address, '\b\d{{5}}(?:-\d{{4}})?\b'), lambda c: list_position(aw, c) > 0 AND (coalesce(list_contains([{_quoted(US_STATES)}], aw[list_position(aw, c) - 1]), false) OR list_position(aw, c) - 1 >= len(aw) - 2))
           WHEN 'india' THEN list_filter(regexp_extract_all(business_address, '\b[1-9]\d{{5}}\b'), lambda c: list_position(aw, c) > 0 AND list_position(aw, c) - 1 >= len(aw) - 3)
           WHEN 'france' THEN list_filter(regexp_extract_all(business_address, '\b\d{{5}}\b'), lambda c: list_position(aw, c) > 1 AND list_position(aw, c) - 1 >= len(aw) - 3)
           ELSE list_filter(regexp_extract_all(business_address, '\b\d{{5,10}}\b'), lambda c: list_position(aw, c) > 0 AND list_position(aw, c) - 1 >= len(aw) - 2) END AS postals FROM tokens),
views AS (
  SELECT *, business_name AS name_nfkc, replace(name_text, ' ', '') AS name_compact, regexp_replace(name_text, '{_CORE}', '') AS name_core,
         replace(regexp_replace(name_text, '{_CORE}', ''), ' ', '') AS name_core_compact, business_address AS address_nfkc,
         list_filter(aw, lambda x: x NOT IN ({_quoted(GENERIC_ADDRESS_TOKENS)})) AS address_words FROM numbers),
s1 AS (SELECT * FROM views WHERE source = 'S1'),
t AS (SELECT * FROM views WHERE source <> 'S1'),
exact AS (
  SELECT 0 AS rank, country_key, name_nfkc AS value, entity_id FROM t UNION ALL SELECT 1, country_key, name_compact, entity_id FROM t
  UNION ALL SELECT 2, country_key, name_core_compact, entity_id FROM t UNION ALL SELECT 3, country_key, address_nfkc, entity_id FROM t
  UNION ALL SELECT DISTINCT 4, country_key, unnest(postals), entity_id FROM t),
words AS (
  SELECT DISTINCT 5 AS rank, country_key, unnest(name_words) AS value, entity_id FROM t
  UNION ALL SELECT DISTINCT 6, country_key, unnest(address_words), entity_id FROM t),
rare AS (SELECT * FROM words QUALIFY count(*) OVER (PARTITION BY rank, country_key, value) <= {max_df}),
ngrams AS (
  SELECT DISTINCT source, country_key, substr('^' || name_compact || '$', i, n) AS value, entity_id
  FROM views, (VALUES (3), (4)) g(n), LATERAL (SELECT unnest(range(1, length(name_compact) + 2 - n + 2)) AS i) WHERE name_compact <> ''),
rare_ngrams AS (SELECT 7 AS rank, country_key, value, entity_id FROM ngrams WHERE source <> 'S1' QUALIFY count(*) OVER (PARTITION BY country_key, value) <= {MAX_NGRAM_DF}),
postings AS (SELECT * FROM exact WHERE value <> '' UNION ALL SELECT * FROM rare),
asked AS (
  SELECT 0 AS rank, country_key, name_nfkc AS value, entity_id AS s1 FROM s1 UNION ALL SELECT 1, country_key, name_compact, entity_id FROM s1
  UNION ALL SELECT 2, country_key, name_core_compact, entity_id FROM s1 UNION ALL SELECT 3, country_key, address_nfkc, entity_id FROM s1
  UNION ALL SELECT DISTINCT 4, country_key, unnest(postals), entity_id FROM s1
  UNION ALL SELECT DISTINCT 5, country_key, unnest(name_words), entity_id FROM s1 UNION ALL SELECT DISTINCT 6, country_key, unnest(address_words), entity_id FROM s1),
found AS (SELECT a.s1 AS source1_entity_id, p.entity_id AS candidate_entity_id, rank, value FROM asked a JOIN postings p USING (rank, country_key, value)),
evidence AS (
  SELECT source1_entity_id, candidate_entity_id, bit_or((1 << rank)::INT) AS mask, min(rank) AS first_block,
         count(*) FILTER (rank = 5) AS name_overlap, count(*) FILTER (rank = 6) AS address_overlap FROM found GROUP BY ALL),
rated AS (
  SELECT *, mask & 31 <> 0 AS strong, name_overlap >= 1 AND address_overlap >= 1 AS both_words,
         mask & 31 <> 0 OR (name_overlap >= 1 AND address_overlap >= 1) AS v2,
         mask & 31 <> 0 OR name_overlap >= 2 OR address_overlap >= 2 OR (name_overlap >= 1 AND address_overlap >= 1) AS v3 FROM evidence),
truth_pairs AS (SELECT a.entity_id AS source1_entity_id, b.entity_id AS true_entity_id FROM s1 a JOIN t b ON a.full_text = b.full_text),
truth AS (SELECT a.entity_id AS source1_entity_id, coalesce(string_agg(b.entity_id, ',' ORDER BY b.entity_id), '') AS matched_entity_ids FROM s1 a LEFT JOIN t b ON a.full_text = b.full_text GROUP BY 1),
judged AS (SELECT r.*, tp.true_entity_id IS NOT NULL AS is_true FROM rated r LEFT JOIN truth_pairs tp ON tp.source1_entity_id = r.source1_entity_id AND tp.true_entity_id = r.candidate_entity_id),
report AS (
  SELECT s.entity_id AS source1_entity_id, (SELECT count(*) FROM truth_pairs x WHERE x.source1_entity_id = s.entity_id) AS true_count,
         (SELECT count(*) FROM judged j WHERE j.source1_entity_id = s.entity_id) AS candidate_count,
         (SELECT count(*) FROM judged j WHERE j.source1_entity_id = s.entity_id AND is_true) AS recovered_count FROM s1 s)
"""
