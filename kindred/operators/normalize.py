"""Normalised views of entity records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import text, udfs

#: The columns of the entities table.
ENTITY_COLUMNS = [
    "source", "entity_id", "business_name", "business_address", "country", "country_key", "name_nfkc", "name_compact", "name_core_compact", "name_tokens", "name_latin_aux", "address_nfkc",
    "address_compact", "address_informative_tokens", "address_latin_aux", "address_numbers", "postal_candidates",
]
#: What a query record needs for retrieval.
QUERY_COLUMNS = ["country_key", "name_nfkc", "name_compact", "name_core_compact", "name_tokens", "address_nfkc", "address_informative_tokens", "postal_candidates"]


def _views(df: DataFrame, phonetic: bool) -> DataFrame:
    """Adds every view to records that have ``name_nfkc``, ``address_nfkc``, ``country_key`` and the Latin forms."""
    name, address = F.col("name_nfkc"), F.col("address_nfkc")
    df = df.withColumns({"_nt": text.tokenize(name), "_at": text.tokenize(address)})
    df = df.withColumns({"name_tokens": text.tokens_to_text(F.col("_nt")), "_postal": text.postal_candidates(address, F.col("_at"), F.col("country_key"))})
    core = text.core_text(F.col("name_tokens"))
    return df.withColumns({
        "name_tokens_sorted": text.tokens_to_text(text.sorted_unique(F.col("_nt"))),
        "name_compact": text.compact(name),
        "name_core": core,
        "name_core_compact": F.regexp_replace(core, " ", ""),
        "name_legal_suffixes": text.legal_suffixes(F.col("_nt")),
        "name_phonetic": udfs.phonetic_key(name) if phonetic else F.lit(""),
        "address_tokens": text.tokens_to_text(F.col("_at")),
        "address_tokens_sorted": text.tokens_to_text(text.sorted_unique(F.col("_at"))),
        "address_compact": text.compact(address),
        "address_informative_tokens": text.tokens_to_text(text.informative(F.col("_at"))),
        "postal_candidates": F.array_join("_postal", "|"),
        "address_numbers": F.array_join(text.address_numbers(address, F.col("_postal")), "|"),
    }).drop("_nt", "_at", "_postal")


def normalize(records: DataFrame, include_phonetic: bool = False) -> DataFrame:
    """``records`` (``business_name``, ``business_address`` and, if known, ``country``) with all normalised views. Nulls are
    empty. One Arrow crossing for a record makes the views that need Unicode tables; all others are column expressions."""
    country = text.clean_text(F.col("country")) if "country" in records.columns else F.lit("")
    df = records.withColumns({"name_raw": text.safe_text(F.col("business_name")), "address_raw": text.safe_text(F.col("business_address")), "country_raw": country})
    df = df.withColumn("_u", udfs.unicode_views("name_raw", "address_raw", "country_raw"))
    return _views(df.select("*", "_u.*").drop("_u"), include_phonetic)


def normalize_folded(records: DataFrame, fold: Column | None = None, include_phonetic: bool = False) -> DataFrame:
    """``normalize`` without Python, for texts whose case folding is ``lower`` with ``ß`` as ``ss`` and that are in NFKC
    already, as ASCII and most Latin texts are. The caller vouches for that."""

    def folded(c: str) -> Column:
        return text.squeeze(F.replace(F.lower(text.safe_text(F.col(c))), F.lit("ß"), F.lit("ss")))

    country = text.clean_text(F.col("country")) if "country" in records.columns else F.lit("")
    df = records.withColumns({"name_raw": text.safe_text(F.col("business_name")), "address_raw": text.safe_text(F.col("business_address")), "country_raw": country})
    df = df.withColumns({"name_nfkc": folded("business_name"), "address_nfkc": folded("business_address"), "country_key": F.lower("country_raw")})
    df = df.withColumns({"name_accent_free": F.col("name_nfkc"), "name_latin_aux": F.col("name_nfkc"), "address_latin_aux": F.col("address_nfkc")})
    return _views(df, include_phonetic)


def normalize_record(spark, name: str, address: str = "", country: str = "") -> dict[str, str]:
    """The views of one record. Inner white space of the country collapses too, as it does for single records."""
    row = normalize(spark.createDataFrame([(name, address, " ".join((country or "").split()))], "business_name string, business_address string, country string")).first().asDict()
    return row | {"name_alnum": row["name_compact"]}


def entities(*sources: DataFrame, folded: bool = False) -> DataFrame:
    """The entities table of normalised target records, each with its ``source``."""
    make = normalize_folded if folded else normalize
    out = None
    for s in sources:
        part = make(s).select(*(text.safe_text(F.col(c)).alias(c) for c in ENTITY_COLUMNS))
        out = part if out is None else out.unionByName(part)
    return out


def query_records(s1: DataFrame) -> DataFrame:
    """The columns of normalised query records that retrieval reads, with ``entity_id`` as ``source1_entity_id``."""
    return s1.select(F.col("entity_id").alias("source1_entity_id"), *QUERY_COLUMNS)
