"""Candidate retrieval: one evidence table for all blocks, and the strategies read from it.

Every block emits (query, candidate, block) rows. One aggregation by pair then tells which blocks found it, which found it
first, and how many words it shares, so that no block is materialised or made distinct on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import text
from kindred.operators import index

#: Blocks in the order in which their unions grow.
BLOCKS = ["exact_name", "compact_name", "core_name", "exact_address", "postal", "rare_name_token", "rare_address_token", "name_ngram"]
STRONG = BLOCKS[:5]
#: Document-frequency caps of record-level retrieval; batch blocking has none.
CAPS = {"exact_name": 5000, "compact_name": 5000, "core_name": 3000, "exact_address": 3000, "postal": 5000}
_QUERY = {**index.EXACT, **index.TOKENS, "postal": "postal_candidates", "name_ngram": "name_compact"}
_PAIR = ["source1_entity_id", "candidate_entity_id"]
#: Tasks that a query's candidates are dealt over.
SLOTS = 8


def _asked(s1: DataFrame, block: str) -> DataFrame:
    """The keys that each query record looks up in a block, each once."""
    column = F.col(_QUERY[block])
    s1 = s1.filter(F.col("country_key") != "")
    if block in index.EXACT:
        return s1.filter(column != "").select("source1_entity_id", "country_key", column.alias("value"))
    values = text.char_ngrams(column) if block == "name_ngram" else F.array_distinct(text.split_nonempty(column, r"\|" if block == "postal" else " "))
    return s1.select("source1_entity_id", "country_key", F.explode(values).alias("value"))


def block_rows(s1: DataFrame, postings: DataFrame, block: str, max_df: int | None = None) -> DataFrame:
    """``source1_entity_id``, ``candidate_entity_id`` and ``value`` of one block. ``max_df`` leaves out keys with more rows;
    they are dropped whole."""
    found = index.capped(postings, max_df) if max_df is not None else postings
    return _asked(s1, block).join(found, ["country_key", "value"]).select("source1_entity_id", F.col("entity_id").alias("candidate_entity_id"), "value")


def block_pairs(s1: DataFrame, postings: DataFrame, block: str) -> DataFrame:
    """Different pairs of one block."""
    return block_rows(s1, postings, block).select(*_PAIR).distinct()


def _lists(s1: DataFrame, postings: DataFrame, block: str, max_df: int | None) -> DataFrame:
    """``source1_entity_id``, ``slot`` and ``ids``: the candidates of one block by a hash of theirs. Keys of words and n-grams
    are capped where their index is built, so their candidates come as lists; other keys may have any number of rows, and
    their candidates come one by one."""
    slot = F.pmod(F.xxhash64("entity_id"), F.lit(SLOTS)).cast("int").alias("slot")
    found = index.capped(postings, max_df) if max_df is not None else postings
    if block in index.TOKENS or block == "name_ngram":
        found = found.groupBy("country_key", "value", slot).agg(F.collect_list("entity_id").alias("ids"))
    else:
        found = found.select("country_key", "value", slot, F.array("entity_id").alias("ids"))
    return _asked(s1, block).join(found, ["country_key", "value"]).select("source1_entity_id", "slot", "ids")


def evidence(s1: DataFrame, postings: dict[str, DataFrame], blocks: list[str] | None = None, caps: dict[str, int] | None = None) -> DataFrame:
    """A row for each pair that a block finds: ``mask`` (a bit for each block in the order of ``BLOCKS``), ``first_block``,
    ``name_overlap`` and ``address_overlap`` (shared rare words).

    Postings of words are distinct and so are a record's words, so rows count words without a distinct aggregate. What is
    shuffled to a query are lists of candidates; they are taken apart and counted by pair where they arrive, so the many rows
    of a pair never travel. A query's candidates are dealt over ``SLOTS`` tasks, as some find a large part of all targets."""
    rows = None
    for rank, block in enumerate(BLOCKS):
        if block in postings and (blocks is None or block in blocks):
            part = _lists(s1, postings[block], block, (caps or {}).get(block)).withColumn("rank", F.lit(rank))
            rows = part if rows is None else rows.unionByName(part)
    name, address = BLOCKS.index("rare_name_token"), BLOCKS.index("rare_address_token")
    dealt = rows.repartition("source1_entity_id", "slot").select("source1_entity_id", "slot", "rank", F.explode("ids").alias("candidate_entity_id"))
    found = dealt.groupBy(*_PAIR, "slot").agg(
        F.bit_or(F.expr("shiftleft(1, rank)")).alias("mask"),
        F.min("rank").alias("first_block"),
        F.count_if(F.col("rank") == name).alias("name_overlap"),
        F.count_if(F.col("rank") == address).alias("address_overlap"),
    )
    return found.drop("slot")


def has(block: str) -> Column:
    """Did the block find the pair?"""
    return F.col("mask").bitwiseAND(F.lit(1 << BLOCKS.index(block))) != 0


def is_strong() -> Column:
    return F.col("mask").bitwiseAND(F.lit(sum(1 << BLOCKS.index(b) for b in STRONG))) != 0


def v1() -> Column:
    """Any block."""
    return F.col("mask") != 0


def v2() -> Column:
    """A strong block, or a name word and an address word."""
    return is_strong() | ((F.col("name_overlap") >= 1) & (F.col("address_overlap") >= 1))


def v3() -> Column:
    """A strong block, two name words, two address words, or one of each."""
    return v2() | (F.col("name_overlap") >= 2) | (F.col("address_overlap") >= 2)


def candidates(found: DataFrame, rule: Column) -> DataFrame:
    return found.filter(rule).select(*_PAIR)


def methods(order: list[str] | None = None) -> Column:
    """The names of the blocks that found a pair, in order of the names."""
    names = [sorted(b for i, b in enumerate(BLOCKS) if mask >> i & 1 and b in (order or BLOCKS)) for mask in range(1 << len(BLOCKS))]
    return F.get(F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in names)), F.col("mask"))


def retrieve(s1: DataFrame, postings: dict[str, DataFrame], caps: dict[str, int] | None = None) -> DataFrame:
    """Candidates with the methods that found them, with record-level caps unless others are given."""
    found = evidence(s1, postings, caps=CAPS if caps is None else caps)
    return found.select(*_PAIR, methods().alias("methods"))
