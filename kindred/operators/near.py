"""Missed pairs of records that share a word of their names, judged where they are made.

Records are dealt out by country and word and written in blocks in that order, with hashes of what is compared; a block of
queries meets the blocks of targets that may hold the same words. All pairs of two blocks are judged at once in arrays: exact
forms by equal hashes, postal codes and indexed words by looking up the few targets that have them, and whether a pair shares
any word at all by one bit for each of the 64 most frequent words of a group, by lookup where no bit is shared. No pair is
shuffled, and no text but for ``report``. Equality is equality of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import text, udfs
from kindred.operators import index, meet
from kindred.scratch import drop_materialized, fresh, materialize

#: Records and hashes in a block at most (one record may have more; half of them in blocks with texts), and pairs that are judged at once.
ASKED_ROWS, HELD_ROWS, MOST_KEYS, BATCH = 4096, 2048, 1_500_000, 100_000
#: Targets with fewer bits are weak.
WEAK = 12
#: Rows that follow each other with the text of a target: a writer that finds out late that there are too many texts for its
#: dictionary writes all that it holds as one page, and needs its size of memory besides the heap.
RUN = 20
#: Pairs that are put in the order of their targets at once; pairs, words and at most bytes of shared words in a batch of a report.
REPORT_PAIRS, REPORT_ROWS, REPORT_WORDS, REPORT_BYTES = 500_000, 10_000, 200_000, 4 << 20
#: Reasons in order; both records have the word, so that they always share one of their names.
REASONS = ["shared_name_and_address_tokens_but_all_suppressed", "shared_name_tokens_but_suppressed"]
_EXACT = list(index.EXACT)
_TOKENS = list(index.TOKENS)
_TEXTS = ["business_name", "business_address"]
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PAIRS = "source1_entity_id string, true_entity_id string, reason string"
COUNTS = "reason string, n long"
BEST = PAIRS + ", name_similarity double, q_record long, t_record long"
_NAMES = {schema: [x.split()[0] for x in schema.split(", ")] for schema in (PAIRS, COUNTS, BEST)}
_PAIR = {"source1_entity_id": "string", "source1_business_name": "string", "shared_name_tokens": "string", "shared_address_tokens": "string", "name_token_overlap_count": "int", "address_token_overlap_count": "int", "reason": "string"}
_TARGET = {"true_entity_id": "id", "country": "country_key", "true_business_name": "business_name", "true_address": "business_address"}
REPORT = f"{', '.join(f'{c} string' for c in _TARGET)}, pairs array<struct<{', '.join(f'{c} {k}' for c, k in _PAIR.items())}>>"


def record(views: DataFrame) -> Column:
    """A hash of a row: equal rows share it, other rows with the same id do not."""
    return F.xxhash64("source", "entity_id", "name_raw", "address_raw", "country_raw")


def _keys(views: DataFrame, word: Column, texts: bool = False) -> DataFrame:
    """The hashes of each record, of no ``group`` if it has no word. Written once. An exact form that is empty is 0 in a query
    and 1 in a target. With ``texts`` the words themselves are written, and hashed when they are read, and what a report has of
    a target."""
    country, none, asks = F.col("country_key"), F.array().cast("array<bigint>"), F.col("source") == "S1"
    split = lambda c, p: F.array_distinct(text.split_nonempty(F.col(c), p))
    hashed = lambda c: F.coalesce(F.transform(c, lambda v: F.xxhash64(country, v)), none)
    if texts:
        more = [country, *(F.when(~asks, F.col(c)).alias(c) for c in _TEXTS), *(split(c, " ").alias(f"{b}_text") for b, c in index.TOKENS.items())]
    else:
        more = [hashed(split(c, " ")).alias(b) for b, c in index.TOKENS.items()]
    made = views.withColumn("word", word).select(
        asks.alias("asks"), F.col("entity_id").alias("id"), record(views).alias("record"), F.when(F.col("word") != "", F.xxhash64(country, "word")).alias("group"), (country != "").alias("placed"), F.col("name_nfkc").alias("name"),
        *(F.when(F.col(c) != "", F.xxhash64(c)).otherwise(F.when(asks, 0).otherwise(1).cast("long")).alias(b) for b, c in index.EXACT.items()), *more, hashed(split("postal_candidates", r"\|")).alias("postal"),
    )
    made = materialize(made, "near", meet._AS_NUMBERS)
    return made.withColumns({b: hashed(F.col(f"{b}_text")) for b in _TOKENS}) if texts else made


def _capped(views: DataFrame, keys: DataFrame, max_df: int) -> dict[str, np.ndarray]:
    """The words of more targets than ``max_df``, those without a group included; rows that share an id count once."""
    held = keys.filter("placed AND NOT asks")
    if not held.groupBy("id").count().filter("count > 1").isEmpty():
        held = held.groupBy("id").agg(F.lit(False).alias("asks"), *(F.array_distinct(F.flatten(F.collect_list(b))).alias(b) for b in _TOKENS))
    return {b: meet.frequent(held, b, max_df) for b in _TOKENS}


def _vocabulary(keys: DataFrame, max_df: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], dict[str, pa.Array]]:
    """The words that missed pairs may share, as hashes in order, the number of each in the order of texts, and texts in order:
    words of more targets than ``max_df``, as all others are indexed; every word of targets without a country."""
    held = keys.filter("NOT asks")
    again = not held.groupBy("id").count().filter("count > 1").isEmpty()
    capped, number, texts = {}, {}, {}
    for b in _TOKENS:
        rows = held.select("id", "placed", "country_key", F.explode(f"{b}_text").alias("value"))
        counts = (rows.distinct() if again else rows).groupBy("placed", "country_key", "value").count().filter(~F.col("placed") | (F.col("count") > max_df))
        found = counts.select(F.xxhash64("country_key", "value").alias("hash"), "value").toArrow().combine_chunks().sort_by("value")
        hashes = found.column("hash").to_numpy()
        number[b] = np.argsort(hashes, kind="stable")
        capped[b], texts[b] = hashes[number[b]], pa.concat_arrays([pa.array([], pa.string()), *(x.cast(pa.string()) for x in found.column("value").chunks)])
    return capped, number, texts


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(meet._offsets(lengths), pa.int32()), pa.array(values))


def _stepped(values: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """A list in order for each of ``n`` records, written as steps from one to the next."""
    values, begin = values[np.lexsort((values, at))], np.diff(at, prepend=-1) != 0
    return _lists(np.where(begin, values, np.diff(values, prepend=0)), np.bincount(at, minlength=n))


def _summed(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """How many values each list has, and all of them; sums wrap around."""
    lists = lists.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = meet._lengths(lists)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(lists.flatten().to_numpy().view(np.uint64), dtype=np.uint64)))
    return lengths, sums[1:] - np.repeat(sums[meet._offsets(lengths)[:-1]], lengths)


def _split(batch: pa.RecordBatch, capped: dict[str, np.ndarray], order: dict[str, np.ndarray] | None = None) -> pa.RecordBatch:
    """With ``share``, the words of the address that no index has, and ``marks``, all else by which a pair is found. Words over
    the cap are numbers in their order; those of records without a country are hashes. With ``order`` words are numbers in the
    order of texts, and ``named`` has those of the name; words without a number are of no target."""
    placed = batch.column("placed").to_numpy(zero_copy_only=False)
    n, marks, rows, lists_of = batch.num_rows, [], [], {}
    for rank, b in enumerate([*_TOKENS, "postal"]):
        lists = batch.column(b)
        values, row = lists.flatten().to_numpy(), np.repeat(np.arange(n), meet._lengths(lists))
        if b == "postal":
            known = np.ones(len(values), bool)
        else:
            number, over = np.zeros(len(values), np.int64), np.zeros(len(values), bool)
            if len(capped[b]):
                number = np.minimum(np.searchsorted(capped[b], values), len(capped[b]) - 1)
                over = capped[b][number] == values
            known = placed[row] & ~over
            if order:
                lists_of["named" if b == "rare_name_token" else "share"] = _stepped(order[b][number[over]], row[over], n)
            elif b == "rare_address_token":
                lists_of["share"] = _stepped(np.where(placed[row], number, values)[~known], row[~known], n)
        marks.append(values[known] ^ rank)
        rows.append(row[known])
    rows, marks = np.concatenate(rows), np.concatenate(marks)
    by_row = np.argsort(rows, kind="stable")
    texts = ("country_key", *_TEXTS) if order else ()
    out = {c: batch.column(c) for c in ("asks", "id", "record", "group", "name", *_EXACT, *texts)} | lists_of | {"marks": _lists(marks[by_row], np.bincount(rows, minlength=n))}
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _blocks(views: DataFrame, word: Column, max_df: int, texts: bool = False) -> tuple[DataFrame, dict[str, pa.Array]]:
    """``asks``, ``meets`` and ``block``: records in order of their groups; ``meets`` names the blocks of targets. With ``texts``
    blocks have what a report has, and the words that numbers stand for are returned."""
    keys = _keys(views, word, texts)
    capped, order, words = _vocabulary(keys, max_df) if texts else (_capped(views, keys, max_df), None, {})
    lists, more = "array<bigint>", [f"{c} string" for c in ("country_key", *_TEXTS)] + ["named array<bigint>"] if texts else []
    shape = ", ".join(["asks boolean, id string, record bigint, group bigint, name string", *(f"{b} bigint" for b in _EXACT), *more, f"share {lists}, marks {lists}"])
    named = keys.filter("group IS NOT NULL")
    most, most_keys = ({True: ASKED_ROWS // 2, False: HELD_ROWS // 2}, MOST_KEYS // 2) if texts else ({True: ASKED_ROWS, False: HELD_ROWS}, MOST_KEYS)
    n = max(1, min(-(-named.count() // 10_000), 512))
    named = named.drop(*(f"{b}_text" for b in _TOKENS))
    dealt = named.mapInArrow(lambda batches: (_split(b, capped, order) for b in batches), shape).repartition(n, "group").sortWithinPartitions("asks", "group")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ends, held, rows, size = TaskContext.get().partitionId(), [], [], 0, 0

        def out(side: bool) -> pa.RecordBatch:
            nonlocal held, rows, size
            first, last = held[0].column("group")[0].as_py(), held[-1].column("group")[-1].as_py()
            if side:
                meets = [k for k, (a, z) in enumerate(ends) if a <= last and first <= z]
            else:
                meets = [len(ends)]
                ends.append((first, last))
            block = _block(held)
            held, rows, size = [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array([side]), pa.array([[part << 32 | k for k in meets]], pa.list_(pa.int64())), pa.array([block], pa.binary())], ["asks", "meets", "block"])

        now = False
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                for side in (False, True):  # in order: targets come first
                    own = piece.filter(pc.equal(piece.column("asks"), side))
                    if not own.num_rows:
                        continue
                    if side != now and rows:
                        yield out(now)
                    now = side
                    held.append(own)
                    rows += own.num_rows
                    size += sum(len(own.column(c).flatten()) for c in ("share", "marks"))
                    if rows >= most[side] or size >= most_keys:
                        yield out(side)
        if rows:
            yield out(now)

    path = fresh(views.sparkSession, "blocks")
    shape = "asks boolean, meets array<bigint>, block binary"
    dealt.mapInArrow(pack, shape).write.parquet(path)
    drop_materialized(keys)
    return views.sparkSession.read.schema(shape).parquet(path), words


def _block(held: list[pa.RecordBatch]) -> bytes:
    whole, to = pa.Table.from_batches(held).drop_columns(["asks"]).combine_chunks(), pa.BufferOutputStream()
    with pa.ipc.new_stream(to, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(whole)
    return to.getvalue().to_pybytes()


def _unpacked(block: pa.Buffer) -> tuple[pa.Table, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The records, and for ``share`` and ``marks`` how many each has and all, mixed with the group: only records of one group
    have any in common."""
    table = pa.ipc.open_stream(block).read_all()
    group, out = table.column("group").to_numpy().view(np.uint64), {}
    for name in ("share", "marks"):
        if name == "share":
            lengths, values = _summed(table.column(name))
        else:
            lists = table.column(name).combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            values, lengths = lists.flatten().to_numpy().view(np.uint64), meet._lengths(lists)
        out[name] = lengths, (values * _MIX[0] + np.repeat(group * _MIX[1], lengths)).view(np.int64)
    return table, out


def _asked(block: pa.Buffer, held: _Targets) -> tuple[pa.Table, dict[str, tuple]]:
    """The queries and, for ``share`` and ``marks``, where their keys' targets begin and end, and where each query's keys do."""
    table, lists = _unpacked(block)
    out = {}
    for name, (keys, first, _) in held.of.items():
        lengths, own = lists[name]
        if len(keys) and len(own):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            kept = keys[at] == own
            at = at[kept]
            if len(at):
                out[name] = first[at], first[at + 1], meet._offsets(kept)[meet._offsets(lengths)]
    return table, out


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and the number of the range that each is of."""
    lengths = end - start
    of = np.repeat(np.arange(len(start)), lengths)
    return np.arange(len(of)) - np.repeat(meet._offsets(lengths)[:-1] - start, lengths), of


class _Targets:
    """A block of targets: for ``share`` and ``marks`` the different keys and whose they are, and a bit for each of the most
    frequent words of a group."""

    def __init__(self, block: pa.Buffer, weak: int):
        self.table, lists = _unpacked(block)
        self.ids, self.n, self.of = self.table.column("id").combine_chunks(), self.table.num_rows, {}
        for name, (lengths, values) in lists.items():
            order = np.argsort(values, kind="stable")
            values = values[order]
            first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
            self.of[name] = values[first], np.append(first, len(values)), np.repeat(np.arange(self.n, dtype=np.int32), lengths)[order]
        self.group = self.table.column("group").to_numpy()
        _, self.first, rows = self.of["share"]
        lengths = np.diff(self.first)
        group = self.group[rows[self.first[:-1]]]
        order = np.lexsort((-lengths, group))
        sorted_ = group[order]
        begin = np.concatenate(([True], sorted_[1:] != sorted_[:-1])) if len(order) else np.zeros(0, bool)
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(begin, np.arange(len(order)), 0))
        self.bit = np.full(len(order), -1)
        self.bit[order] = np.where(rank < 64, rank, -1)
        bits = np.repeat(self.bit, lengths)
        self.mask = np.zeros(self.n, np.uint64)
        there = np.flatnonzero(bits >= 0)
        np.bitwise_or.at(self.mask, rows[there], np.uint64(1) << bits[there].astype(np.uint64))
        # Few pairs share no bit, and most of these are of targets with few bits: their postings are kept apart.
        self.weak = np.bitwise_count(self.mask) < weak
        kept = self.weak[rows]
        self.weak_first, self.weak_rows = meet._offsets(kept)[self.first], rows[kept]


def _judged(block: pa.Buffer, held: _Targets, batch: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For some queries at a time: the queries of all, the pairs that are missed as two columns of places, whether each shares
    a word of the address, and how many pairs there were."""
    queries, found = _asked(block, held)
    n, group = queries.num_rows, queries.column("group").to_numpy()
    lo, hi = np.searchsorted(held.group, group, "left"), np.searchsorted(held.group, group, "right")
    exact = [(queries.column(b).to_numpy(), held.table.column(b).to_numpy()) for b in _EXACT]
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    (ms, me, mo), (ss, se, so) = found.get("marks", empty), found.get("share", empty)
    key = np.searchsorted(held.first, ss)
    bit = held.bit[key] if len(ss) else np.zeros(0, np.int64)
    mask, there = np.zeros(n, np.uint64), np.flatnonzero(bit >= 0)
    np.bitwise_or.at(mask, np.repeat(np.arange(n), np.diff(so))[there], np.uint64(1) << bit[there].astype(np.uint64))
    at, a = meet._offsets(hi - lo), 0
    while a < n:
        z = max(a + 1, int(np.searchsorted(at, at[a] + batch, "right")) - 1)
        total = int(at[z] - at[a])
        if total:
            j, i = _ranges(lo[a:z], hi[a:z])
            i += a
            place = at[:-1] - at[a] - lo  # of a pair: that of its query and its target

            def places(start: np.ndarray, end: np.ndarray, of: np.ndarray, rows: np.ndarray, place: np.ndarray = place) -> np.ndarray:
                own, k = _ranges(start, end)
                return place[of[k]] + rows[own]

            gone = np.zeros(total, bool)
            for q, t in exact:
                gone |= q[i] == t[j]  # nan equals nothing
            own = np.repeat(np.arange(a, z), np.diff(mo[a : z + 1]))
            gone[places(ms[mo[a] : mo[z]], me[mo[a] : mo[z]], own, held.of["marks"][2])] = True
            shares = mask[i] & held.mask[j] != 0
            unknown = np.flatnonzero(~shares & ~gone)
            if len(unknown):
                weak = held.weak[j[unknown]]
                few, all_ = np.zeros(n, bool), np.zeros(n, bool)
                few[i[unknown[weak]]], all_[i[unknown[~weak]]] = True, True
                k, of = np.arange(so[a], so[z]), np.repeat(np.arange(a, z), np.diff(so[a : z + 1]))
                own = np.flatnonzero(all_[of] & (bit[k] < 0))
                shares[places(ss[k[own]], se[k[own]], of[own], held.of["share"][2])] = True
                own = np.flatnonzero((few & ~all_)[of] & (bit[k] < 0))
                first = key[k[own]]
                shares[places(held.weak_first[first], held.weak_first[first + 1], of[own], held.weak_rows)] = True
            left = np.flatnonzero(~gone)
            yield queries, i[left], j[left], shares[left], total
        a = z


def _met(views: DataFrame, word: Column, max_df: int, each, schema: str, texts: bool = False) -> DataFrame:
    """``each`` gets what ``_judged`` yields, with the targets, for all that a task judges; with ``texts`` the words first."""
    blocks, words = _blocks(views, word, max_df, texts)
    each = partial(each, words) if texts else each
    asked, held = (blocks.filter(F.col("asks") == side).select(F.explode("meets").alias("meets"), F.col("block").alias(name)) for side, name in ((True, "asked"), (False, "held")))

    at_once, weak = BATCH, WEAK

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, targets = None, None
        for batch in batches:
            for q, t in zip(batch.column("asked"), batch.column("held"), strict=True):
                if last is None or not last.equals(t.as_buffer()):
                    last, targets = t.as_buffer(), None
                    targets = _Targets(last, weak)
                for part in _judged(q.as_buffer(), targets, at_once):
                    yield targets, *part

    if texts:  # a pair of blocks is much work for its size: about one block of targets for a task
        n = held.count()
        asked, held = (side.repartition(max(1, min(n, 512)), "meets") for side in (asked, held))
    return asked.join(held, "meets").select("asked", "held").mapInArrow(lambda batches: each(judged(batches)), schema)


def missed(views: DataFrame, word: Column, max_df: int) -> DataFrame:
    """``source1_entity_id``, ``true_entity_id`` and ``reason`` of every pair of a query and a target with the same country and
    ``word``, which is one of the words of their names, that no block would find; a row for each pair of rows."""
    reasons = pa.array(REASONS)

    def each(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for held, queries, i, j, shares, _ in parts:
            if len(i):
                columns = [queries.column("id").combine_chunks().take(pa.array(i)), held.ids.take(pa.array(j)), reasons.take(pa.array(np.where(shares, 0, 1)))]
                yield pa.RecordBatch.from_arrays(columns, _NAMES[PAIRS])

    return _met(views, word, max_df, each, PAIRS)


def counted(views: DataFrame, word: Column, max_df: int) -> DataFrame:
    """``reason`` and ``n``, how many such pairs are missed; without a reason, how many pairs there are. Rows of a reason may be
    several."""

    def each(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        n = [0, 0, 0]
        for _, _, i, _, shares, total in parts:
            own = int(np.count_nonzero(shares))
            n = [n[0] + own, n[1] + len(i) - own, n[2] + total]
        rows = [(r, x) for r, x in zip([*REASONS, None], n, strict=True) if x]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.int64())], _NAMES[COUNTS])

    return _met(views, word, max_df, each, COUNTS)


def _letters(names: list[str]) -> np.ndarray:
    """How often each name has characters of each of 32 kinds."""
    out = np.zeros((len(names), 32), np.uint16)
    for k, name in enumerate(names):
        if name:
            out[k] = np.bincount(np.frombuffer(name.encode("utf-32-le"), np.uint32) % 32, minlength=32)
    return out


def best(views: DataFrame, word: Column, max_df: int, n: int) -> DataFrame:
    """The missed pairs that the first ``n`` by reason, falling similarity of names and ids are among: as many at most for each
    task. A ratio is worked out unless the characters that two names have in common show it to be too small."""

    def each(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple]] = [[], []]
        least = [-1.0, -1.0]
        known: dict[tuple[str, str], float] = {}
        last, letters, names, of = None, None, None, {}

        def shortened(kind: int) -> None:
            found[kind].sort()
            del found[kind][n:]
            if len(found[kind]) == n:
                least[kind] = -found[kind][-1][0]

        for held, queries, i, j, shares, _ in parts:
            if last is not held:
                last, names = held, held.table.column("name").to_pylist()
                letters, ids, records = _letters(names), held.ids.to_pylist(), held.table.column("record").to_numpy()
                lengths = np.array([len(x) for x in names])
            if of.get("queries") is not queries:
                of = {"queries": queries, "names": queries.column("name").to_pylist(), "ids": queries.column("id").to_pylist(), "records": queries.column("record").to_numpy()}
                of["letters"], of["lengths"] = _letters(of["names"]), np.array([len(x) for x in of["names"]])
            for kind in (0, 1):
                if kind and least[0] >= 0:
                    continue
                own = np.flatnonzero(shares == (kind == 0))
                q, t = i[own], j[own]
                both, size = np.minimum(of["letters"][q], letters[t]).sum(axis=1), of["lengths"][q] + lengths[t]
                most = 2.0 * both / np.maximum(size, 1) + 1e-4  # what rounding may add
                order = np.argsort(-most, kind="stable")
                for k in order[most[order] >= least[kind]].tolist():
                    if most[k] < least[kind]:
                        break
                    x, y = of["names"][q[k]], names[t[k]]
                    near = known.get((x, y))
                    if near is None:
                        if len(known) > 200_000:
                            known.clear()
                        near = known[x, y] = udfs.ratio(x, y)
                    if near >= least[kind]:
                        found[kind].append((-near, of["ids"][q[k]], ids[t[k]], int(of["records"][q[k]]), int(records[t[k]])))
                        if len(found[kind]) >= 2 * n:
                            shortened(kind)
                if len(found[kind]) >= n:
                    shortened(kind)
        rows = [(a, b, REASONS[kind], -x, q, t) for kind in (0, 1) for x, a, b, q, t in found[kind]]
        kinds = [*[pa.string()] * 3, pa.float64(), pa.int64(), pa.int64()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES[BEST])

    return _met(views, word, max_df, each, BEST)


class _Shared:
    """What the queries of a block share with one target at a time, in the order of texts."""

    def __init__(self, queries: pa.Table, held: _Targets, name: str, words: pa.Array):
        (n, values), (m, own) = _summed(queries.column(name)), _summed(held.table.column(name))
        self.at, self.values, self.own_at, self.own = meet._offsets(n), values.view(np.int64), meet._offsets(m), own.view(np.int64)
        self.words, self.there, self.lengths = words, np.zeros(len(words), bool), pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        self.codes, self.counts, self.n = [], [], 0

    def most(self, j: int) -> int:
        """Bytes that a query shares with the target at most."""
        return int(self.lengths[self.own[self.own_at[j] : self.own_at[j + 1]]].sum())

    def add(self, j: int, who: np.ndarray) -> None:
        """``who``: some queries, in order."""
        own, a, z = self.own[self.own_at[j] : self.own_at[j + 1]], who[0], who[-1] + 1
        some = len(who) < z - a
        if 4 * len(who) < z - a:
            places, _ = _ranges(self.at[who], self.at[who + 1])
            values, ends, some = self.values[places], meet._offsets(self.at[who + 1] - self.at[who]), False
        else:
            values, ends = self.values[self.at[a] : self.at[z]], self.at[a : z + 1] - self.at[a]
        self.there[own] = True
        hits = np.flatnonzero(self.there[values])
        self.there[own] = False
        codes, counts = values[hits], np.diff(np.searchsorted(hits, ends))
        if some:
            kept = np.zeros(z - a, bool)
            kept[who - a] = True
            codes, counts = codes[np.repeat(kept, counts)], counts[kept]
        self.codes.append(codes)
        self.counts.append(counts)
        self.n += len(codes)

    def out(self) -> tuple[pa.Array, np.ndarray]:
        """The joined words of each pair added, and how many."""
        codes, counts = np.concatenate(self.codes), np.concatenate(self.counts)
        self.codes, self.counts, self.n = [], [], 0
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(meet._offsets(counts), pa.int32()), self.words.take(pa.array(codes))), "|"), counts


def report(views: DataFrame, word: Column, max_df: int) -> DataFrame:
    """The pairs of ``missed`` with the texts of both records and the words they share. Texts of targets lie in the blocks; what
    a task returns has that of a target once for some queries, and so many rows of a target follow each other."""
    run, reasons, most_pairs, most_rows, most_words, most_bytes = RUN, pa.array(REASONS), REPORT_PAIRS, REPORT_ROWS, REPORT_WORDS, REPORT_BYTES

    def rows(held: _Targets, queries: pa.Table, names: _Shared, addresses: _Shared, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(j.astype(meet._numbers(held.n)), kind="stable")
        i, j = i[order], j[order]
        first = np.flatnonzero(np.diff(j, prepend=-1))
        turn = (np.arange(len(j)) - np.repeat(first, np.diff(first, append=len(j)))) // run
        order = np.argsort(turn, kind="stable")
        i, j, turn = i[order], j[order], turn[order]
        first = np.flatnonzero((np.diff(j, prepend=-1) != 0) | (np.diff(turn, prepend=-1) != 0))
        ids, called = (queries.column(c).combine_chunks() for c in ("id", "name"))
        target = {c: held.table.column(own).combine_chunks() for c, own in _TARGET.items()}
        who, whom, size = [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal who, whom, size
            lengths, asked = np.array([len(w) for w in who]), pa.array(np.concatenate(who))
            (name, n_name), (address, n_address) = names.out(), addresses.out()
            pairs = [ids.take(asked), called.take(asked), name, address, pa.array(n_name, pa.int32()), pa.array(n_address, pa.int32()), reasons.take(pa.array(np.where(n_address > 0, 0, 1)))]
            lists = pa.ListArray.from_arrays(pa.array(meet._offsets(lengths), pa.int32()), pa.StructArray.from_arrays(pairs, list(_PAIR)))
            own = pa.array(whom)
            who, whom, size = [], [], 0
            return pa.RecordBatch.from_arrays([*(x.take(own) for x in target.values()), lists], [*target, "pairs"])

        rows_now = 0
        for a, z in zip(first.tolist(), np.append(first[1:], len(j)).tolist(), strict=True):
            k = int(j[a])
            bound = 64 + names.most(k) + addresses.most(k)
            step = max(1, most_bytes // bound)
            for lo in range(a, z, step):
                own = i[lo : min(lo + step, z)]
                names.add(k, own)
                addresses.add(k, own)
                who.append(own)
                whom.append(k)
                size, rows_now = size + len(own) * bound, rows_now + len(own)
                if rows_now >= most_rows or addresses.n >= most_words or size >= most_bytes:
                    yield out()
                    rows_now = 0
        if who:
            yield out()

    def each(words: dict[str, pa.Array], parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        last, found, n = None, [], 0
        for held, queries, i, j, _, _ in parts:
            if last is None or last[0] is not held or last[1] is not queries or n >= most_pairs:
                if found:
                    yield from rows(*last, *map(np.concatenate, zip(*found, strict=True)))
                    found, n = [], 0
                if last is None or last[0] is not held or last[1] is not queries:
                    last = held, queries, _Shared(queries, held, "named", words["rare_name_token"]), _Shared(queries, held, "share", words["rare_address_token"])
                    pa.default_memory_pool().release_unused()
            if len(i):
                found.append((i.astype(np.int32), j.astype(np.int32)))
                n += len(i)
        if found:
            yield from rows(*last, *map(np.concatenate, zip(*found, strict=True)))

    return _met(views, word, max_df, each, REPORT, True).select(*_TARGET, F.inline("pairs"))
