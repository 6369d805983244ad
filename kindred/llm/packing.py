"""Operator 6, bound-certified best-fit packing of documents into token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kindred.llm.common import materialize, parts
from kindred.llm.tokens import RANKS, VOCAB, encoder

_PIECES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of ``n`` ids: one piece if it fits, else full pieces after a first one
    that takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int, end_id: int, vocab: str, ranks: str, doc_id: str, text: str) -> DataFrame:
    """The pieces of every document: its ids, then ``end_id``."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = to_arrow_type(own.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab, ranks)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode.ids(t.as_py() or "") + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, v in zip(out, (key, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (kind, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=_PIECES)

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins. Items go, longest first, to the fullest bin that has room; a
    bit set of the free capacities finds it in constant time."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, n = 0, 0  # bit c of free: some bin has c tokens left
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if above := free >> size:
            room = size + (above & -above).bit_length() - 1
            bin_ = stacks[room].pop()
            if not stacks[room]:
                free ^= 1 << room
        else:
            bin_, room, n = n, capacity, n + 1
        bins[i], offsets[i] = bin_, capacity - room
        if left := room - size:
            stacks[left].append(bin_)
            free |= 1 << left
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing uses fewer bins: the best of the dual feasible functions that round lengths above ``capacity - k`` up to
    a whole bin and drop those below ``k``, for every k up to half the capacity, and of those that round to multiples of
    ``capacity / (k + 1)``."""
    return bound(np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64), capacity) if len(lengths) else 0


def bound(counts: np.ndarray, capacity: int) -> int:
    """The same, of ``counts[i]`` items of length i."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(counts * sizes)])  # total[i]: tokens in items shorter than i
    number = np.concatenate([[0], np.cumsum(counts)])
    k = np.arange(0, capacity // 2 + 1)
    whole = number[capacity + 1] - number[capacity - k + 1]
    between = total[capacity - k + 1] - total[k]
    best = int((whole + -(-between // capacity)).max())
    for k1 in range(1, 32):
        scaled = sizes * (k1 + 1)
        weight = np.where(scaled % capacity == 0, sizes * k1, scaled // capacity * capacity)  # capacity * k1 fills a bin
        best = max(best, int(-(-int((counts * weight).sum()) // (capacity * k1))))
    return best


def _packed(lengths: np.ndarray, bins: np.ndarray, offsets: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Bins and offsets by best fit, and whether they are new: an earlier assignment that is as good stays."""
    fresh, places, n = best_fit_decreasing(lengths, capacity)
    if (bins >= 0).all() and len(np.unique(bins)) <= n:
        return bins, offsets, False
    return fresh, places, True


def pack(
    docs: DataFrame,
    *,
    capacity: int = 1024,
    end_id: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    vocab: str | None = None,
    ranks: str | None = None,
    per_part: int = 16_384,
    rounds: int | None = None,
    fan_in: int = 8,
) -> DataFrame:
    """Packs all documents into as few sequences of at most ``capacity`` tokens as it can.

    Each partition of about ``per_part`` pieces is packed by best fit decreasing. Dual feasible functions give a lower bound
    of its bins and of those of all pieces. While the total is above its bound, groups of about ``fan_in`` partitions, and
    of about ``fan_in * per_part`` pieces at most, exchange the documents of their unfilled bins (of partitions that meet their own
    bound: of the emptiest bin), which are packed together again; the outcome stands if it saves bins. That ends when one
    group is left, or when a round saves nothing and brings no fewer groups, or after ``rounds`` rounds if that is given.
    Full pieces are sequences of their own and need no packing.

    Returns, a row for each piece, ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and
    ``offset``. A null text is empty: one piece that holds ``end_id`` alone. Ids may be null or repeat: each row is a
    document. Ids may be of any type that has an order. Very long texts are cut into pieces like all others. Ties in length go
    in the order of a hash. Other columns are ignored. An empty table gives no rows. ``certificate`` says how close the
    outcome is to the least that any packing needs.
    """
    vocab, ranks = vocab or public_tokenizers.path(VOCAB), ranks or public_tokenizers.path(RANKS)
    cut_up = materialize(pieces(docs, capacity, end_id, vocab, ranks, doc_id, text), "pieces")
    whole = cut_up.filter(F.col("length") == capacity).withColumns({"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")})
    loose = cut_up.filter(F.col("length") < capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for r in loose.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    n, least = int(counts.sum()), bound(counts, capacity)
    columns = [*_PIECES, "sequence_id", "offset"]
    state = ", ".join(f"{c} {t}" for c, t in [*cut_up.dtypes, *((c, "bigint") for c in ("sequence_id", "offset", "part", "gap"))])
    n_parts = parts(n, per_part)

    # Sequence ids of packed bins are even, 2 * (round * 2^48 + part * 2^24 + bin), so no two rounds or parts clash.
    def packer(turn: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            part = key[0].as_py()
            table = table.sort_by([("length", "descending"), *((c, "ascending") for c in ("ids_crc32", "doc_id", "piece"))])
            lengths, bins, offsets = (np.asarray(table.column(c)).copy() for c in ("length", "sequence_id", "offset"))
            bins, offsets, new = _packed(lengths, bins, offsets, capacity)
            if new:
                bins = 2 * ((turn << 48) + (part << 24) + bins)
            gap = len(np.unique(bins)) - lower_bound(lengths, capacity)
            out = [*(table.column(c) for c in _PIECES), pa.array(bins), pa.array(offsets), *(pa.array(np.full(len(bins), x, np.int64)) for x in (part, gap))]
            return pa.Table.from_arrays(out, names=[*columns, "part", "gap"])

        return run

    blank = F.lit(-1).cast("long")
    start = loose.withColumns({"sequence_id": blank, "offset": blank, "part": F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(n_parts))})
    now = materialize(start.groupBy("part").applyInArrow(packer(0), state), "packed")
    done: list[DataFrame] = []
    turn, stay, groups = 0, 0, n_parts
    bins = now.agg(F.count_distinct("sequence_id")).first()[0]
    while groups > 1 and stay + bins > least and turn != rounds:
        turn += 1
        fill = now.groupBy("part", "sequence_id").agg(F.sum("length").alias("fill"))
        fill = fill.join(fill.groupBy("part").agg(F.min(F.struct("fill", "sequence_id")).alias("last")), "part").select("sequence_id", "fill", (F.col("last.sequence_id") == F.col("sequence_id")).alias("emptiest"))
        marked = materialize(now.join(fill, "sequence_id").withColumn("goes", (F.col("fill") < capacity) & ((F.col("gap") > 0) | F.col("emptiest"))), "fill")
        done.append(marked.filter(~F.col("goes")).select(now.columns))
        going = marked.filter("goes").agg(F.count("*").alias("rows"), F.count_distinct("sequence_id").alias("bins"), F.count_distinct("part").alias("parts")).first()
        stay += bins - going["bins"]
        before, groups = groups, max(parts(going["parts"], fan_in), parts(going["rows"], fan_in * per_part))
        swap = marked.filter("goes").drop("fill", "gap", "emptiest", "goes").withColumns({"part": F.pmod(F.xxhash64("part", "sequence_id", F.lit(turn)) if groups >= going["parts"] else F.xxhash64("part", F.lit(turn)), F.lit(groups))})
        now = materialize(swap.groupBy("part").applyInArrow(packer(turn), state), "packed")
        bins = now.agg(F.count_distinct("sequence_id")).first()[0]
        if bins == going["bins"] and groups >= before:
            break
    out = whole.select(columns)
    for frame in [*done, now]:
        out = out.unionByName(frame.select(out.columns))
    return out


def certificate(packed: DataFrame, capacity: int = 1024) -> tuple[int, int]:
    """How many sequences ``packed`` has, and the lower bound of the dual feasible functions for its pieces; equal numbers
    prove that no packing of these pieces has fewer. The driver gets a count for each length."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return packed.agg(F.count_distinct("sequence_id")).first()[0], bound(counts, capacity) if counts.any() else 0
