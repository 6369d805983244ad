"""Retrieval for a stream of query records against static indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kindred.operators import blocking, normalize
from kindred.operators.store import IndexStore
from kindred.sources.tsv import ENTITY_FIELDS


def query_stream(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    """Query records from delimited files that appear in ``folder``."""
    schema = ", ".join(f"{f} string" for f in ENTITY_FIELDS)
    return spark.readStream.schema(schema).option("sep", "\t").option("header", True).option("maxFilesPerTrigger", per_trigger).csv(folder)


def retrieve_stream(queries: DataFrame, store: IndexStore, out: str, checkpoint: str, rule=None) -> StreamingQuery:
    """Starts retrieval: each micro-batch of records is normalised, joined with the index tables and appended to ``out`` with
    the methods that found each candidate. Batches are numbered, so a batch that is run again replaces its own rows."""

    def handle(batch: DataFrame, number: int) -> None:
        s1 = normalize.query_records(normalize.normalize(batch))
        postings = {b: store.table(f"{b}_index") for b in blocking.BLOCKS[:7]}
        found = blocking.evidence(s1, postings)
        kept = found.filter(blocking.v3() if rule is None else rule)
        rows = kept.select("source1_entity_id", "candidate_entity_id", blocking.methods().alias("methods"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
