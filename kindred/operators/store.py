"""Record-level retrieval over a built index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from kindred.operators import blocking, index, meet
from kindred.operators.normalize import QUERY_COLUMNS


class IndexStore:
    """The tables that ``build_indexes`` wrote below ``path``. Lookups take one record; ``retrieve`` takes a DataFrame."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __enter__(self) -> IndexStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open."""

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def sizes(self) -> dict[str, int]:
        """The names of all tables, in order, and their bytes."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(conf)
        found = fs.listStatus(top) if fs.exists(top) else []
        return dict(sorted((s.getPath().getName(), fs.getContentSummary(s.getPath()).getLength()) for s in found))

    def tables(self) -> list[str]:
        """The names of all tables, in order."""
        return list(self.sizes())

    def unsorted(self) -> DataFrame:
        """For each index, how many rows come before the one they follow by key, within a file: none, as they are written."""
        out = None
        for name in (t for t in self.tables() if t.endswith("_index")):
            rows = self.table(name).select(F.struct("country_key", "value").alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
            before = F.lag("key").over(Window.partitionBy("file").orderBy("at"))
            part = rows.select((before > F.col("key")).alias("back")).agg(F.count_if("back").alias("rows_out_of_order")).select(F.lit(name).alias("name"), "rows_out_of_order")
            out = part if out is None else out.unionByName(part)
        return out

    def table_exists(self, name: str) -> bool:
        return name in self.tables()

    def lookup_many(self, block: str, country_key: str, values: list[str], max_df: int | None = None) -> set[str]:
        """Ids of records under any of the keys; keys with more than ``max_df`` rows are left out whole. Filters reach the
        scan."""
        values = sorted({v for v in values if v})
        if not values or not country_key:
            return set()
        try:
            postings = self.table(f"{block}_index")
        except AnalysisException:
            return set()
        found = postings.filter((F.col("country_key") == country_key) & F.col("value").isin(values))
        if max_df is not None:
            found = index.capped(found, max_df)
        return {r["entity_id"] for r in found.select("entity_id").distinct().collect()}

    def lookup_single(self, block: str, country_key: str, value: str, max_df: int | None = None) -> set[str]:
        return self.lookup_many(block, country_key, [value], max_df)

    def exact_name(self, country_key: str, name: str) -> set[str]:
        return self.lookup_single("exact_name", country_key, name, blocking.CAPS["exact_name"])

    def compact_name(self, country_key: str, name: str) -> set[str]:
        return self.lookup_single("compact_name", country_key, name, blocking.CAPS["compact_name"])

    def core_name(self, country_key: str, name: str) -> set[str]:
        return self.lookup_single("core_name", country_key, name, blocking.CAPS["core_name"])

    def exact_address(self, country_key: str, address: str) -> set[str]:
        return self.lookup_single("exact_address", country_key, address, blocking.CAPS["exact_address"])

    def postal(self, country_key: str, codes: list[str]) -> set[str]:
        return self.lookup_many("postal", country_key, codes, blocking.CAPS["postal"])

    def rare_name_tokens(self, country_key: str, tokens: list[str]) -> set[str]:
        return self.lookup_many("rare_name_token", country_key, tokens)

    def rare_address_tokens(self, country_key: str, tokens: list[str]) -> set[str]:
        return self.lookup_many("rare_address_token", country_key, tokens)

    def name_ngrams(self, country_key: str, grams: list[str]) -> set[str]:
        return self.lookup_many("name_ngram", country_key, grams) if self.table_exists("name_ngram_index") else set()

    def _postings(self, enable_ngrams: bool) -> dict[str, DataFrame]:
        there = self.tables()
        return {b: self.table(f"{b}_index") for b in blocking.BLOCKS if f"{b}_index" in there and (enable_ngrams or b != "name_ngram")}

    def retrieve(self, s1: DataFrame, enable_ngrams: bool = False) -> DataFrame:
        """Candidates and methods of many normalised records at once: every key of the index is read."""
        return meet.retrieve(s1, self._postings(enable_ngrams), blocking.CAPS)

    def retrieve_candidates(self, record: dict[str, str], enable_ngrams: bool = False) -> dict[str, set[str]]:
        """Candidates of one normalised record, and the methods that found each."""
        row = ("record", *(record.get(c) or "" for c in QUERY_COLUMNS))
        s1 = self.spark.createDataFrame([row], ", ".join(f"{c} string" for c in ["source1_entity_id", *QUERY_COLUMNS]))
        return {r["candidate_entity_id"]: set(r["methods"]) for r in blocking.retrieve(s1, self._postings(enable_ngrams)).collect()}


