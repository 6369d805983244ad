"""Shared helpers: scratch tables, row keys, and Arrow batch plumbing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.scratch import drop_materialized, materialize

__all__ = ["drop_materialized", "few_rows", "materialize", "parts", "row_key", "slices", "table", "unused"]


def unused(columns: list[str], *names: str) -> list[str]:
    """Names for columns of an operator's own, like ``names``, that none of ``columns`` has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        own = f"__kn_{name}"
        while own in taken:
            own += "_"
        out.append(own)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str, text: str) -> Column:
    """64-bit key of a row's id and text. Together with the id it names a row; rows that repeat both share it, and are
    treated alike."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.col(text).isNull())


def parts(n_rows: int, per_part: int) -> int:
    """How many parts of about ``per_part`` rows."""
    return max(1, -(-n_rows // per_part))


def few_rows(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``most`` at most, for functions that turn nested columns into Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            yield batch.slice(i, most)


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose lengths sum to ``most`` at most, one item at least."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
