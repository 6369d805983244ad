"""What blocks of records take on disk, and that nothing is lost in them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kindred.operators import meet

BLOCK = "rare_address_token"


def _records(rows, keys):
    return [pa.RecordBatch.from_arrays([pa.array([f"r{i}" for i in range(rows)]), keys], ["id", BLOCK])]


def test_blocks_hold_small_numbers():
    """A hash of eight bytes is written once for a block, not for each record that has it."""
    draw = np.random.default_rng(3)
    keys = draw.integers(-(1 << 62), 1 << 62, 5000)[draw.integers(0, 5000, 400_000)]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 400_001, 100), pa.int32()), pa.array(keys))
    for asks in (True, False):
        assert len(meet._block(_records(4000, lists), asks)) < 3 * len(keys)


def test_written_keys_are_small(spark):
    """Also with more different keys than the usual dictionary of Parquet takes."""
    n = 200_000
    words = F.expr(f"transform(sequence(0, 499), i -> concat('w', pmod(xxhash64(id, i), {n})))")
    made = spark.range(4000).coalesce(1).select(F.concat(F.lit("d"), "id").alias("entity_id"), F.lit("us").alias("country_key"), F.array_join(words, " ").alias("address_informative_tokens"))
    keys = meet.record_keys(made, [BLOCK], F.col("entity_id") < "d2")
    held = keys.select(F.sum(F.size(BLOCK))).first()[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(keys.inputFiles()[0]).getParent()
    assert path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength() < 5 * held


def test_pairs_in_blocks_of_many_rows():
    """More records than numbers of two bytes tell apart."""
    n = 70_000
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), pa.array(np.arange(n) // 7))
    held = meet._Held(pa.py_buffer(meet._block(_records(n, lists), False)))
    queries, found = meet._asked(pa.py_buffer(meet._block(_records(n, lists), True)), held)
    assert held.n == n and queries.column("id").to_pylist() == held.ids.to_pylist() == [f"r{i}" for i in range(n)]
    start, end, at = found[BLOCK]
    for i in (0, 6, 7, 65_535, 65_536, 65_540, n - 1):
        assert held.of[BLOCK][2][start[at[i]] : end[at[i]]].tolist() == list(range(i // 7 * 7, i // 7 * 7 + 7))
