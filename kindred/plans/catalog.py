"""Named queries of the record-linkage engine and the SQL each must equal."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text, udfs
from kindred.operators import blocking, evaluate, index, meet, misses, near, normalize, pairs, profile
from kindred.operators.store import IndexStore
from kindred.plans.fixture import MAX_DF, TIGHT_DF, Linkage, customer_records, document_records, records_sql, table
from kindred.scratch import fresh, materialize
from kindred.sources import tsv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "candidates_v3"


def _add(name: str, query: Query, sql: str | None = None, kind: str = "documents", max_df: int = MAX_DF) -> None:
    """``sql`` goes on after the records of ``kind``."""
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = records_sql(kind, max_df) + sql


def _linked(name: str, query: Callable[[Linkage], DataFrame], sql: str | None = None, kind: str = "documents", max_df: int = MAX_DF) -> None:
    _add(name, lambda s, d: query(Linkage(s, d, kind, max_df)), sql, kind, max_df)


# Normalised views.
_VIEWS = ["entity_id", "country_key", "name_nfkc", "name_compact", "name_tokens", "name_tokens_sorted", "name_core", "name_core_compact", "address_nfkc", "address_informative_tokens"]
_MORE = ["name_raw", "address_raw", "country_raw", "name_accent_free", "address_tokens", "address_tokens_sorted", "address_compact"]
_VIEWS_SQL = """SELECT entity_id, country_key, name_nfkc, name_compact, name_text AS name_tokens, array_to_string(list_sort(list_distinct(name_words)), ' ') AS name_tokens_sorted,
name_core, name_core_compact, address_nfkc, array_to_string(address_words, ' ') AS address_informative_tokens"""
_MORE_SQL = """, business_name AS name_raw, business_address AS address_raw, country AS country_raw, strip_accents(name_nfkc) AS name_accent_free, array_to_string(aw, ' ') AS address_tokens,
array_to_string(list_sort(list_distinct(aw)), ' ') AS address_tokens_sorted, array_to_string(aw, '') AS address_compact"""
_linked("normalize_views", lambda link: link.views.select(*_VIEWS), f"{_VIEWS_SQL} FROM views")
_linked("normalize_views_unicode", lambda link: normalize.normalize(link.records).select(*_VIEWS, *_MORE), f"{_VIEWS_SQL} {_MORE_SQL} FROM views")
_linked("accent_free", lambda link: link.views.select("entity_id", udfs.accent_free(udfs.nfkc_casefold("address_raw")).alias("plain")), "SELECT entity_id, strip_accents(business_address) AS plain FROM raw")
_linked("transliterate_ascii", lambda link: link.views.select("entity_id", udfs.transliterate("name_nfkc").alias("latin")), "SELECT entity_id, name_nfkc AS latin FROM views", "customers")
_linked(
    "normalize_addresses",
    lambda link: link.views.select("entity_id", "postal_candidates", "address_numbers", "name_core", "name_legal_suffixes"),
    r"""SELECT entity_id, array_to_string(list_sort(list_distinct(postals)), '|') AS postal_candidates,
    array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(business_address, '\b\d+[a-z]?(?:[-/]\d+[a-z]?)?\b'), lambda x: NOT list_contains(postals, x)))), '|') AS address_numbers,
    name_core, 'pvt ltd' AS name_legal_suffixes FROM views""",
    "customers",
)


def _one_by_one(s: SparkSession, d: str) -> DataFrame:
    """The five regions through the interface for single records."""
    columns = ["name_nfkc", "name_alnum", "name_core", "name_legal_suffixes", "country_key", "postal_candidates", "address_numbers"]
    rows = [normalize.normalize_record(s, f" {r['r_name']}  Trading Co. Ltd", "7B Main Street Austin TX 78701", "us") for r in table(s, d, "region").collect()]
    return s.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns))


_add(
    "normalize_record",
    _one_by_one,
    """SELECT lower(r_name) || ' trading co. ltd' AS name_nfkc, regexp_replace(lower(r_name), '[^a-z]', '', 'g') || 'tradingcoltd' AS name_alnum, lower(r_name) || ' trading' AS name_core,
    'co|ltd' AS name_legal_suffixes, 'us' AS country_key, '78701' AS postal_candidates, '7b' AS address_numbers FROM region""",
    "customers",
)
_linked("char_ngrams", lambda link: link.targets.select("entity_id", F.explode(text.char_ngrams(F.col("name_compact"))).alias("gram")), "SELECT entity_id, value AS gram FROM ngrams WHERE source <> 'S1'")
_linked(
    "light_keys",
    lambda link: pairs.light_keys(link.s1).select(
        "source1_entity_id", text.lookup_key(F.col("country_key"), F.col("name_compact")).alias("compact_key"), text.lookup_key(F.col("country_key"), F.col("name_core_compact")).alias("core_key"),
        text.lookup_key(F.col("country_key"), F.col("name_nfkc")).alias("name_key"), text.lookup_key(F.col("country_key"), F.col("address_nfkc")).alias("address_key"),
    ),
    """SELECT entity_id AS source1_entity_id, country_key || chr(31) || replace(business_name, ' ', '') AS compact_key, country_key || chr(31) || replace(regexp_replace(business_name, ' pvt ltd$', ''), ' ', '') AS core_key,
    country_key || chr(31) || business_name AS name_key, country_key || chr(31) || business_address AS address_key FROM s1""",
    "customers",
)

# Indexes.
_RANK = {b: i for i, b in enumerate(blocking.BLOCKS)}
_KEY = "country_key || chr(31) || value AS lookup_key"
for _name in [*index.EXACT, "postal"]:
    _kind = "customers" if _name == "postal" else "documents"
    _linked(f"index_{_name}", lambda link, n=_name: index.keyed(link.postings[n]), f"SELECT {_KEY}, entity_id FROM exact WHERE rank = {_RANK[_name]} AND value <> ''", _kind)
    _linked(f"doc_freq_{_name}", lambda link, n=_name: index.keyed(index.frequency(link.postings[n])), f"SELECT {_KEY}, count(*) AS doc_freq FROM exact WHERE rank = {_RANK[_name]} AND value <> '' GROUP BY 1", _kind)
for _name in index.TOKENS:
    for _cap, _tag in ((MAX_DF, ""), (TIGHT_DF, "_tight")):
        _linked(f"index_{_name}{_tag}", lambda link, n=_name: index.keyed(link.postings[n]), f"SELECT {_KEY}, entity_id FROM rare WHERE rank = {_RANK[_name]}", max_df=_cap)
for _kind, _tag in (("documents", ""), ("lineitems", "_capped")):
    _linked(f"index_name_ngram{_tag}", lambda link: index.keyed(index.ngram_postings(link.targets)), f"SELECT {_KEY}, entity_id FROM rare_ngrams", _kind)
_linked(
    "entities",
    lambda link: normalize.entities(link.records.filter("source <> 'S1'")),
    r"""SELECT source, entity_id, business_name, business_address, country, country_key, name_nfkc, name_compact, name_core_compact, name_text AS name_tokens, name_nfkc AS name_latin_aux, address_nfkc,
    array_to_string(aw, '') AS address_compact, array_to_string(address_words, ' ') AS address_informative_tokens, address_nfkc AS address_latin_aux,
    array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(business_address, '\b\d+[a-z]?(?:[-/]\d+[a-z]?)?\b'), lambda x: NOT list_contains(postals, x)))), '|') AS address_numbers,
    array_to_string(list_sort(list_distinct(postals)), '|') AS postal_candidates FROM t""",
    "customers",
)

# Blocks, strategies and provenance. Documents have long texts, customers postal codes, line items more rows than caps allow.
for _name in blocking.BLOCKS[:7]:
    _linked(f"block_{_name}", lambda link, n=_name: link.candidates("v1", [n]), f"SELECT DISTINCT source1_entity_id, candidate_entity_id FROM found WHERE rank = {_RANK[_name]}", "customers" if _name == "postal" else "documents")
_NGRAM_FOUND = "SELECT DISTINCT a.entity_id AS source1_entity_id, p.entity_id AS candidate_entity_id, 7 AS rank FROM ngrams a JOIN rare_ngrams p USING (country_key, value) WHERE a.source = 'S1'"
_linked("block_name_ngram", lambda link: blocking.block_pairs(link.s1, index.ngram_postings(link.targets), "name_ngram"), f"SELECT source1_entity_id, candidate_entity_id FROM ({_NGRAM_FOUND})")
for _kind, _tag in (("documents", ""), ("customers", "_postal")):
    _linked(f"evidence{_tag}", lambda link: link.evidence, "SELECT * FROM evidence", _kind)
    for _name, _rule in (("v1", "true"), ("v2", "v2"), ("v3", "v3")):
        _linked(f"candidates_{_name}{_tag}", lambda link, n=_name: link.candidates(n), f"SELECT source1_entity_id, candidate_entity_id FROM rated WHERE {_rule}", _kind)


def _retrieved(link: Linkage, ngrams: bool = False, caps: dict[str, int] | None = None) -> DataFrame:
    postings = link.postings | ({"name_ngram": index.ngram_postings(link.targets)} if ngrams else {})
    return blocking.retrieve(link.s1, postings, caps).select("source1_entity_id", "candidate_entity_id", F.array_join("methods", ",").alias("methods"))


_NAMES = "CASE rank " + " ".join(f"WHEN {i} THEN '{b}'" for b, i in _RANK.items()) + " END"
_METHODS = f"SELECT source1_entity_id, candidate_entity_id, string_agg(DISTINCT {_NAMES}, ',' ORDER BY {_NAMES}) AS methods FROM"
_CAP = "CASE rank " + " ".join(f"WHEN {_RANK[b]} THEN {n}" for b, n in blocking.CAPS.items()) + " ELSE 1000000000 END"
_CAPPED = f"""(SELECT a.s1 AS source1_entity_id, p.entity_id AS candidate_entity_id, rank FROM asked a JOIN (SELECT * FROM postings QUALIFY count(*) OVER (PARTITION BY rank, country_key, value) <= {_CAP}) p USING (rank, country_key, value)
UNION ALL {_NGRAM_FOUND})"""
_linked("retrieve_with_methods", lambda link: link.evidence.select("source1_entity_id", "candidate_entity_id", F.array_join(blocking.methods(), ",").alias("methods")), f"{_METHODS} found GROUP BY ALL")
_linked("retrieve_with_caps", lambda link: _retrieved(link, ngrams=True), f"{_METHODS} {_CAPPED} GROUP BY ALL", "lineitems")

# Evaluation.
_linked("ground_truth", lambda link: link.truth, "SELECT * FROM truth")
_linked("true_pairs", lambda link: evaluate.true_pairs(link.truth), "SELECT * FROM truth_pairs")


def _reported(link: Linkage) -> DataFrame:
    return evaluate.per_s1_report(link.s1_ids, link.tallies, link.true_counts)


_SUMMARY = """SELECT *, CASE WHEN true_pairs = 0 THEN 0.0 ELSE recovered_pairs / true_pairs END AS pair_recall, CASE WHEN singletons = 0 THEN 0.0 ELSE clean_singletons / singletons END AS clean_singleton_rate,
    CASE WHEN multi_true = 0 THEN 0.0 ELSE multi_recovered / multi_true END AS multi_match_recall, CASE WHEN matched_queries = 0 THEN 0.0 ELSE fully_recovered / matched_queries END AS all_matches_rate FROM (
    SELECT count(*) AS queries, sum(true_count)::BIGINT AS true_pairs, sum(candidate_count)::BIGINT AS candidate_pairs, sum(recovered_count)::BIGINT AS recovered_pairs, avg(candidate_count) AS avg_candidates,
    quantile_cont(candidate_count::DOUBLE, 0.5) AS median_candidates, quantile_cont(candidate_count::DOUBLE, 0.95) AS p95_candidates, max(candidate_count) AS max_candidates, count(*) FILTER (true_count = 0) AS singletons,
    count(*) FILTER (true_count = 0 AND candidate_count = 0) AS clean_singletons, coalesce(sum(true_count) FILTER (true_count >= 2), 0)::BIGINT AS multi_true, coalesce(sum(recovered_count) FILTER (true_count >= 2), 0)::BIGINT AS multi_recovered,
    count(*) FILTER (true_count > 0) AS matched_queries, count(*) FILTER (true_count > 0 AND recovered_count = true_count) AS fully_recovered FROM report)"""
_linked("per_s1_report", _reported, "SELECT * FROM report")
_linked("blocking_summary", lambda link: evaluate.summary(_reported(link)), _SUMMARY)


def _reread(link: Linkage) -> DataFrame:
    """The summary of a report that was written as files and read again."""
    path = fresh(link.spark, "report")
    tsv.write_report(_reported(link), path)
    return evaluate.summary(tsv.read_report(link.spark, path, evaluate.REPORT))


_linked("report_reread", _reread, _SUMMARY, "customers")


def _diagnostics(link: Linkage) -> DataFrame:
    return evaluate.block_diagnostics(link.tallies, link.true_counts)


def _strategies(link: Linkage) -> DataFrame:
    return evaluate.strategy_stats(link.tallies, link.true_counts, link.s1_ids)


_BLOCK_LIST = ", ".join(f"({i + 1}, '{b}')" for i, b in enumerate(blocking.BLOCKS[:7]))
_DIAGNOSTICS_SQL = f"""SELECT block_order::INT AS block_order, block,
    (SELECT count(*) FROM judged WHERE mask & (1 << (block_order - 1)) <> 0) AS candidate_pairs, (SELECT count(DISTINCT source1_entity_id) FROM judged WHERE mask & (1 << (block_order - 1)) <> 0) AS s1_with_candidates,
    (SELECT count(*) FROM judged WHERE mask & (1 << (block_order - 1)) <> 0 AND is_true) AS individual_recovered_true_pairs,
    (SELECT count(*) FROM judged WHERE mask & (1 << (block_order - 1)) <> 0 AND is_true) / (SELECT count(*) FROM truth_pairs) AS individual_recall,
    (SELECT count(*) FROM judged WHERE first_block < block_order) AS cumulative_candidate_pairs, (SELECT count(DISTINCT source1_entity_id) FROM judged WHERE first_block < block_order) AS cumulative_s1_with_candidates,
    (SELECT count(*) FROM judged WHERE first_block < block_order AND is_true) AS cumulative_recovered_true_pairs,
    (SELECT count(*) FROM judged WHERE first_block < block_order AND is_true) / (SELECT count(*) FROM truth_pairs) AS cumulative_recall
    FROM (VALUES {_BLOCK_LIST}) b(block_order, block)"""
_STRATEGY_SQL = """, marked AS (SELECT 'v1' AS strategy, * FROM judged UNION ALL SELECT 'strong', * FROM judged WHERE strong UNION ALL SELECT 'name_and_address', * FROM judged WHERE both_words
    UNION ALL SELECT 'v2', * FROM judged WHERE v2 UNION ALL SELECT 'v3', * FROM judged WHERE v3),
    each AS (SELECT strategy, source1_entity_id, count(*) AS n, count(*) FILTER (is_true) AS r FROM marked GROUP BY ALL)
    SELECT strategy, sum(n)::BIGINT AS candidate_pairs, count(*) AS s1_with_candidates, sum(r)::BIGINT AS recovered_true_pairs,
    count(*) FILTER (r > 0 AND r = (SELECT count(*) FROM truth_pairs x WHERE x.source1_entity_id = each.source1_entity_id)) AS fully_recovered_s1,
    sum(r) / (SELECT count(*) FROM truth_pairs) AS recall, sum(n) / (SELECT count(*) FROM s1) AS candidates_per_s1 FROM each GROUP BY strategy"""
for _kind, _tag in (("documents", ""), ("customers", "_postal")):
    _linked(f"block_diagnostics{_tag}", _diagnostics, _DIAGNOSTICS_SQL, _kind)
    _linked(f"strategy_stats{_tag}", _strategies, _STRATEGY_SQL, _kind)


# Misses, of an index with a tight cap, so that there are some.
def _first() -> Column:
    """The first word of the name; pairs that share it may share nothing indexed."""
    return F.element_at(F.split("name_tokens", " "), 1)


def _miss_report(link: Linkage) -> DataFrame:
    """A missed pair shares no exact form and no indexed word."""
    return near.report(link.views, _first(), link.max_df).withColumns({"exact_name": F.lit(False), "indexed_name_tokens": F.lit("")}).select(*_MISS_COLUMNS)


def _examples(link: Linkage, n: int = 1000) -> DataFrame:
    return misses.miss_examples(misses.near_examples(link.views, _first(), link.max_df, n, link.views_of), n)


_MISSES = """, near AS (SELECT a.entity_id AS source1_entity_id, b.entity_id AS true_entity_id, a.country_key, list_sort(list_intersect(a.name_words, b.name_words)) AS sn, list_sort(list_intersect(a.address_words, b.address_words)) AS sa,
a.name_nfkc AS qn, b.business_name AS tn, a.address_nfkc AS qa, b.business_address AS ta,
(a.name_nfkc <> '' AND a.name_nfkc = b.name_nfkc) OR (a.name_compact <> '' AND a.name_compact = b.name_compact) OR (a.name_core_compact <> '' AND a.name_core_compact = b.name_core_compact) OR (a.address_nfkc <> '' AND a.address_nfkc = b.address_nfkc) OR len(list_intersect(a.postals, b.postals)) > 0 AS exact_match
FROM s1 a JOIN t b ON a.country_key = b.country_key AND a.name_words[1] = b.name_words[1]),
known AS (SELECT DISTINCT rank, country_key, value FROM rare),
missed AS (SELECT *, CASE WHEN len(sn) > 0 AND len(sa) > 0 THEN 'shared_name_and_address_tokens_but_all_suppressed' WHEN len(sn) > 0 THEN 'shared_name_tokens_but_suppressed'
WHEN len(sa) > 0 THEN 'shared_address_tokens_but_suppressed' ELSE 'no_exact_or_indexed_token_evidence' END AS reason FROM near
WHERE NOT exact_match AND NOT EXISTS (SELECT 1 FROM known k WHERE k.country_key = near.country_key AND ((k.rank = 5 AND list_contains(near.sn, k.value)) OR (k.rank = 6 AND list_contains(near.sa, k.value)))))
"""


def _miss_summary(link: Linkage) -> DataFrame:
    counts = materialize(near.counted(link.views, _first(), link.max_df), "counts")
    return misses.miss_summary(counts.filter("reason IS NOT NULL"), counts.filter("reason IS NULL").agg(F.sum("n").alias("total")))


_MISS_COLUMNS = ["source1_entity_id", "true_entity_id", "country", "source1_business_name", "true_business_name", "true_address", "exact_name", "shared_name_tokens", "indexed_name_tokens", "shared_address_tokens", "name_token_overlap_count", "address_token_overlap_count", "reason"]
_linked("miss_reasons", lambda link: near.missed(link.views, _first(), link.max_df), _MISSES + "SELECT source1_entity_id, true_entity_id, reason FROM missed", max_df=TIGHT_DF)
_linked("miss_summary", _miss_summary, _MISSES + "SELECT reason, count(*) AS missed_pairs, count(*) / (SELECT count(*) FROM missed) AS share_of_misses, count(*) / (SELECT count(*) FROM near) AS share_of_all_true_pairs FROM missed GROUP BY reason", max_df=TIGHT_DF)
_linked(
    "miss_report",
    _miss_report,
    _MISSES + """SELECT source1_entity_id, true_entity_id, country_key AS country, qn AS source1_business_name, tn AS true_business_name, ta AS true_address, false AS exact_name, array_to_string(sn, '|') AS shared_name_tokens, '' AS indexed_name_tokens,
    array_to_string(sa, '|') AS shared_address_tokens, len(sn)::INT AS name_token_overlap_count, len(sa)::INT AS address_token_overlap_count, reason FROM missed""",
    max_df=TIGHT_DF,
)
# SQL has no Ratcliff-Obershelp ratio.
_linked("miss_examples", _examples, max_df=TIGHT_DF)


def _similar(link: Linkage) -> DataFrame:
    """Names and addresses of queries against those of the targets that share their address or core name."""
    blocks = ["core_name", "exact_address"]
    keys = meet.record_keys(link.views, blocks, F.col("source") == "S1", texts={"name": "name_nfkc", "address": "address_nfkc"})
    return meet.similarities(keys, blocks, "address", "name")


_linked("name_similarity", _similar, kind="customers")


# Training pairs.
def _split(link: Linkage, train: int = 0, valid: int = 0) -> DataFrame:
    return pairs.split(link.s1_views, ["source1_entity_id"], train, valid)


_BUCKET = "CASE WHEN ('0x' || substr(md5(entity_id), 1, 8))::BIGINT % 10 = 0 THEN 'valid' ELSE 'train' END"
_PAIR_SQL = "q.entity_id AS s1_entity_id, c.source AS candidate_source, c.entity_id AS candidate_entity_id, {label} AS label, q.business_name AS s1_name, q.business_address AS s1_address, q.country AS s1_country, c.business_name AS candidate_name, c.business_address AS candidate_address, c.country AS candidate_country"
_POSITIVE = f"SELECT {_PAIR_SQL.format(label=1)} FROM (SELECT source1_entity_id, unnest(string_split(matched_entity_ids, ',')[1:2]) AS id FROM truth WHERE matched_entity_ids <> '') x JOIN s1 q ON q.entity_id = source1_entity_id JOIN t c ON c.entity_id = id"
_NEGATIVE = f"""SELECT {_PAIR_SQL.format(label=0)} FROM (SELECT DISTINCT source1_entity_id, candidate_entity_id FROM judged WHERE mask & 15 <> 0 AND NOT is_true
QUALIFY row_number() OVER (PARTITION BY source1_entity_id ORDER BY md5(candidate_entity_id), candidate_entity_id) <= 4) x JOIN s1 q ON q.entity_id = x.source1_entity_id JOIN t c ON c.entity_id = x.candidate_entity_id"""
_PAIRS = f"SELECT p.*, {_BUCKET.replace('entity_id', 's1_entity_id')} AS split FROM (({_POSITIVE}) UNION ALL ({_NEGATIVE})) p"


def _training(link: Linkage) -> DataFrame:
    return pairs.training_pairs(_split(link), link.truth, link.targets, order=F.md5("candidate_entity_id"))


def _stored_pairs(link: Linkage) -> DataFrame:
    path = fresh(link.spark, "pairs")
    tsv.write_pairs(_training(link), path)
    return link.spark.read.parquet(path)


_linked("split_bucket", lambda link: _split(link).select("source1_entity_id", "split"), f"SELECT entity_id AS source1_entity_id, {_BUCKET} AS split FROM s1")
_linked("split_first", lambda link: _split(link, 100, 10).select("source1_entity_id", "split"), f"SELECT entity_id AS source1_entity_id, {_BUCKET} AS split FROM s1 QUALIFY row_number() OVER (PARTITION BY split ORDER BY entity_id) <= CASE split WHEN 'valid' THEN 10 ELSE 100 END")
_linked("positive_pairs", lambda link: pairs.positives(_split(link), link.truth, link.targets), _POSITIVE)
_linked("hard_negatives", lambda link: pairs.hard_negatives(_split(link), link.truth, link.targets, order=F.md5("candidate_entity_id")), _NEGATIVE)
_linked("training_pairs", _training, _PAIRS)
_linked("training_pairs_parquet", _stored_pairs, _PAIRS, "customers")

# Profiles.
_FIELDS = tsv.ENTITY_FIELDS
_MISSING = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (trim(coalesce({c}, '')) = '') AS missing_or_empty, round(100.0 * count(*) FILTER (trim(coalesce({c}, '')) = '') / count(*), 4) AS missing_pct, count(*) AS rows FROM raw" for c in _FIELDS)
_COUNTRIES = "SELECT country, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM raw), 4) AS percentage FROM raw WHERE trim(country) <> '' GROUP BY 1"
_HIST = "SELECT '{s}' AS scope, len(list_filter(string_split(matched_entity_ids, ','), lambda x: {c}))::INT AS match_count, count(*) AS count FROM truth GROUP BY 2"
_HISTOGRAM = " UNION ALL ".join(_HIST.format(s=s, c=c) for s, c in (("all", "x <> ''"), ("S2", "starts_with(x, 'S2-')"), ("S3", "starts_with(x, 'S3-')")))
_add("profile_missingness", lambda s, d: profile.missingness(document_records(s, d), _FIELDS), _MISSING)
_add("profile_country", lambda s, d: profile.value_distribution(document_records(s, d), "country", "country"), _COUNTRIES)
_add(
    "profile_lengths",
    lambda s, d: profile.length_stats(document_records(s, d), _FIELDS[1:3]),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS count, round(avg(length({c})), 3) AS mean, round(stddev_pop(length({c})), 3) AS std, min(length({c}))::INT AS min, max(length({c}))::INT AS max FROM raw WHERE {c} <> ''" for c in _FIELDS[1:3]),
)
_add("profile_top_values", lambda s, d: profile.top_values(document_records(s, d), "business_name"), "SELECT business_name AS value, count(*) AS count FROM raw WHERE business_name <> '' GROUP BY 1 ORDER BY count DESC, value LIMIT 20")
_add("profile_events", lambda s, d: profile.value_distribution(table(s, d, "events"), "event_type", "event_type"), "SELECT event_type, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM events), 4) AS percentage FROM events GROUP BY 1")
_linked("match_histogram", lambda link: profile.match_histogram(link.truth), _HISTOGRAM)
_linked("truth_summary", lambda link: profile.truth_summary(link.truth), "SELECT count(*) AS queries, count(*) FILTER (matched_entity_ids = '') AS singletons, round(100.0 * count(*) FILTER (matched_entity_ids = '') / count(*), 4) AS singleton_pct, (SELECT count(*) FROM truth_pairs) AS pairs FROM truth")


def _reports(link: Linkage) -> tuple[str, dict]:
    """Where the profile of the records and their truth is written, and the report."""
    path = fresh(link.spark, "profile")
    report = {"sources": {"all": profile.profile_source(link.records, _FIELDS)}, "ground_truth": profile.profile_truth(link.truth)}
    tsv.write_reports(link.spark, report, path)
    return path, report


def _csv_report(link: Linkage) -> DataFrame:
    """The three delimited reports, read again, as one table."""
    path, _ = _reports(link)
    read = lambda name: link.spark.read.option("header", True).csv(f"{path}/{name}.csv")
    parts = [
        read("country_distribution").select(F.lit("country").alias("report"), F.col("country").alias("key"), F.col("count").cast("long").alias("n")),
        read("missingness").select(F.lit("missing").alias("report"), F.col("column").alias("key"), F.col("missing_or_empty").cast("long").alias("n")),
        read("ground_truth_match_distribution").select(F.lit("matches").alias("report"), F.concat_ws("/", "scope", "match_count").alias("key"), F.col("count").cast("long").alias("n")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _json_report(link: Linkage) -> DataFrame:
    """The missing values in the nested report, read again, and whether the text report names each column."""
    path, _ = _reports(link)
    report = json.loads(tsv.read_text(link.spark, f"{path}/profile.json"))
    lines = tsv.read_text(link.spark, f"{path}/profile.txt").splitlines()
    rows = [(m["column"], m["missing_or_empty"], m["rows"], any(m["column"] in x for x in lines)) for m in report["sources"]["all"]["missingness"]]
    return link.spark.createDataFrame(rows, "column string, missing_or_empty long, rows long, named boolean")


_linked("report_csv", _csv_report, f"""SELECT 'country' AS report, country AS key, count AS n FROM ({_COUNTRIES}) UNION ALL SELECT 'missing', "column", missing_or_empty FROM ({_MISSING})
UNION ALL SELECT 'matches', scope || '/' || match_count, count FROM ({_HISTOGRAM})""", "customers")  # fmt: skip
_linked("report_json", _json_report, f'SELECT "column", missing_or_empty, rows, true AS named FROM ({_MISSING})', "customers")


# Readers and writers of delimited files.
def _odd(link: Linkage) -> DataFrame:
    """Records some of whose names look like missing values or hold quotes and tabs."""
    odd = F.pmod(F.regexp_extract("entity_id", r"(\d+)$", 1).cast("int"), F.lit(10))
    name = F.when(odd == 0, "NA").when(odd == 1, "null").when(odd == 2, F.concat(F.lit('"'), "business_name", F.lit('"'))).when(odd == 3, F.concat("business_name", F.lit("\t!"))).when(odd == 4, "").otherwise(F.col("business_name"))
    return link.records.filter("source = 'S2'").select("entity_id", name.alias("business_name"), "business_address", "country")


_ODD = "regexp_extract(entity_id, '(\\d+)$', 1)::INT % 10"
_ODD_SQL = f"""SELECT 'S2' AS source, entity_id, CASE {_ODD} WHEN 0 THEN '{{na}}' WHEN 1 THEN '{{null}}' WHEN 2 THEN '"' || business_name || '"' WHEN 3 THEN business_name || chr(9) || '!' WHEN 4 THEN '' ELSE business_name END AS business_name,
business_address, country FROM raw WHERE source = 'S2'"""


def _through_files(link: Linkage, na_mode: str) -> DataFrame:
    path = fresh(link.spark, "tsv")
    tsv.write_report(_odd(link), path)
    return tsv.read_entities(link.spark, path, "S2", na_mode)


def _truth_file(link: Linkage) -> DataFrame:
    path = fresh(link.spark, "truth")
    tsv.write_report(link.truth, path)
    return tsv.read_truth(link.spark, path)


_linked("tsv_entities", lambda link: _through_files(link, "literal"), _ODD_SQL.format(na="NA", null="null"), "customers")
_linked("tsv_entities_default_na", lambda link: _through_files(link, "default"), _ODD_SQL.format(na="", null=""), "customers")
_linked("tsv_truth", _truth_file, "SELECT * FROM truth", "customers")
_linked("tsv_truth_ids", lambda link: _truth_file(link).select("source1_entity_id"), "SELECT source1_entity_id FROM truth", "customers")
_linked("first_records", lambda link: tsv.head(link.s1_views.select("source1_entity_id", "business_name"), 50, ["source1_entity_id"]), "SELECT entity_id AS source1_entity_id, business_name FROM s1 ORDER BY entity_id LIMIT 50", "customers")
_linked(
    "truth_of_first_records",
    lambda link: link.truth.join(tsv.head(link.s1_views.select("source1_entity_id"), 50, ["source1_entity_id"]), "source1_entity_id", "left_semi"),
    "SELECT * FROM truth WHERE source1_entity_id IN (SELECT entity_id FROM s1 ORDER BY entity_id LIMIT 50)",
    "customers",
)


# The store of a built index.
def _store(link: Linkage, times: int = 1, targets: DataFrame | None = None) -> IndexStore:
    path = fresh(link.spark, "index")
    for _ in range(times):  # each replaces the one before
        index.build_indexes(link.targets if targets is None else targets, path, enable_ngrams=True)
    return IndexStore(link.spark, path)


_TABLES = sorted(["entities", "metadata", *(f"{b}_index" for b in blocking.BLOCKS), *(f"{b}_frequency" for b in blocking.STRONG)])
_linked("store_tables", lambda link: link.spark.createDataFrame([(n, s > 0) for n, s in _store(link, 2).sizes().items()], "name string, has_bytes boolean"), "SELECT unnest([" + ", ".join(f"'{t}'" for t in _TABLES) + "]) AS name, true AS has_bytes", "customers")
_linked("store_entities", lambda link: _store(link).table("entities").select("source", "entity_id", "name_core_compact", "postal_candidates"), "SELECT source, entity_id, name_core_compact, array_to_string(list_sort(list_distinct(postals)), '|') AS postal_candidates FROM t", "customers")
_linked(
    "store_metadata",
    lambda link: _store(link).table("metadata").filter("key <> 'threads'"),
    f"""SELECT 'source2_rows' AS key, (SELECT count(*) FROM t WHERE source = 'S2')::VARCHAR AS value UNION ALL SELECT 'source3_rows', (SELECT count(*) FROM t WHERE source = 'S3')::VARCHAR
    UNION ALL SELECT 'total_entities', (SELECT count(*) FROM t)::VARCHAR UNION ALL VALUES ('chunk_size', '0'), ('enable_ngrams', 'True'), ('max_name_token_df', '{MAX_DF}'), ('max_address_token_df', '{MAX_DF}'),
    ('normalization_version', '{index.NORMALIZATION_VERSION}'), ('index_version', '{index.INDEX_VERSION}')""",
    "customers",
)
_linked("store_sorted", lambda link: _store(link).unsorted(), "SELECT unnest([" + ", ".join(f"'{b}_index'" for b in blocking.BLOCKS) + "]) AS name, 0::BIGINT AS rows_out_of_order", "customers")


def _bucketed(link: Linkage) -> DataFrame:
    """An index saved twice as a bucketed table with statistics: its rows, and the number of rows that the statistics say."""
    name = f"kindred_{fresh(link.spark, 'bucketed').rsplit('-', 1)[1]}"
    for _ in range(2):
        saved = index.save_bucketed(link.postings["exact_name"], name, 8, fresh(link.spark, "table"))
    known = index.known_rows(link.spark, name)
    return index.keyed(saved).withColumn("table_rows", F.lit(known).cast("long"))


_linked("index_bucketed", _bucketed, f"SELECT {_KEY}, entity_id, (SELECT count(*) FROM exact WHERE rank = 0 AND value <> '') AS table_rows FROM exact WHERE rank = 0 AND value <> ''", "customers")

#: Keys that are looked up in the store: two for each index, the least and the most frequent.
_LOOKUPS = {"exact_name": "exact_name", "compact_name": "compact_name", "core_name": "core_name", "exact_address": "exact_address", "postal": "postal", "rare_name_token": "rare_name_tokens", "rare_address_token": "rare_address_tokens", "name_ngram": "name_ngrams"}
_MANY = {"postal", "rare_name_token", "rare_address_token", "name_ngram"}


def _looked_up(link: Linkage) -> DataFrame:
    """Each lookup of the store with the least key of its index and the most frequent one (the least such), one by one, or
    together where it takes several; the exact ones once more among keys that are not there. Caps hold."""
    store, rows = _store(link, targets=link.views.filter("source <> 'S1'").select(*normalize.ENTITY_COLUMNS)), []  # written once, as the store's
    for block, method in _LOOKUPS.items():
        counts = index.frequency(store.table(f"{block}_index"))
        keys = [r["value"] for order in (["value"], [F.desc("doc_freq"), "value"]) for r in counts.orderBy(*order).take(1)]
        if not keys:  # all of its keys are capped
            continue
        ask = getattr(store, method)
        found = ask("us", [*keys, "", "nothing"]) if block in _MANY else ask("us", keys[0]) | ask("us", keys[1]) | ask("", keys[0]) | ask("us", "nothing")
        rows += [(block, i) for i in found]
    return link.spark.createDataFrame(rows, "block string, entity_id string")


_LOOKUP_SQL = f""", every AS (SELECT * FROM postings UNION ALL SELECT * FROM rare_ngrams), freq AS (SELECT rank, value, count(*) AS n FROM every GROUP BY ALL),
keys AS (SELECT rank, min(value) AS value FROM freq GROUP BY 1 UNION SELECT rank, value FROM freq QUALIFY row_number() OVER (PARTITION BY rank ORDER BY n DESC, value) = 1)
SELECT DISTINCT {_NAMES} AS block, entity_id FROM every JOIN keys USING (rank, value) JOIN freq USING (rank, value) WHERE n <= {_CAP}"""
_linked("store_lookups", _looked_up, _LOOKUP_SQL, "lineitems")
_linked("store_retrieve", lambda link: _store(link).retrieve(link.s1, enable_ngrams=True).select("source1_entity_id", "candidate_entity_id", F.array_join("methods", ",").alias("methods")), f"{_METHODS} {_CAPPED} GROUP BY ALL", "customers")


def _record_by_record(link: Linkage) -> DataFrame:
    """Candidates of the first three queries through the interface for single records."""
    store, rows = _store(link), []
    for r in tsv.head(link.s1_views, 3, ["source1_entity_id"]).collect():
        found = store.retrieve_candidates(r.asDict(), enable_ngrams=True)
        rows += [(r["source1_entity_id"], k, ",".join(sorted(v))) for k, v in found.items()]
    return link.spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, methods string")


_linked("store_retrieve_records", _record_by_record, f"SELECT * FROM ({_METHODS} {_CAPPED} GROUP BY ALL) WHERE source1_entity_id IN (SELECT entity_id FROM s1 ORDER BY entity_id LIMIT 3)", "customers")
