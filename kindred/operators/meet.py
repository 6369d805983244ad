"""Evidence without a shuffle of pairs: every block of queries meets every block of targets.

Each record is packed with hashes of its keys, a column of keys for each block of retrieval, and records are written in blocks
of some ten thousand: the different keys, and for targets whose they are, for queries which a record has, as small numbers and
compressed. A task takes blocks of queries and of targets and counts what each query shares with each target in an array over
the targets; so pairs are made where they are counted or returned, and what is written in between is the keys of the records,
whatever the number of pairs. Equality of keys is equality of 64-bit hashes of country and value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import text, udfs
from kindred.operators import blocking, index
from kindred.scratch import drop_materialized, fresh, materialize

#: Records and keys in a block at most (one record may have more keys; a block of targets has up to three times the keys, as its
#: keys are looked up by every query), and rows in a batch of pairs.
ASKED_ROWS, HELD_ROWS, MOST_KEYS, BATCH = 16_384, 65_536, 2_000_000, 200_000
#: How hashed keys are written: as numbers into a dictionary, for which the usual limit of 131 072 keys is too low.
_AS_NUMBERS = {"parquet.dictionary.page.size": str(16 << 20), "compression": "zstd"}
#: What a query shares with a target is one integer: words of addresses from bit 0, words of names from 20, postal codes from
#: 36, n-grams from 44, a bit for each exact key from 58 on, and from 62 whether the two belong together.
_AT = {"rare_address_token": 0, "rare_name_token": 20, "postal": 36, "name_ngram": 44, "exact_name": 58, "compact_name": 59, "core_name": 60, "exact_address": 61, "truth": 62}
_BITS = {"rare_address_token": 20, "rare_name_token": 16, "postal": 8, "name_ngram": 14}
_FOUND = (1 << 62) - 1
TALLY = "source1_entity_id string, mask int, first_block int, name_overlap long, address_overlap long, is_true boolean, n long"
PAIRS = "source1_entity_id string, candidate_entity_id string"
EVIDENCE = PAIRS + ", mask int, first_block int, name_overlap long, address_overlap long"


def record_keys(records: DataFrame, blocks: list[str], asks: Column, truth: Column | None = None, texts: dict[str, str] | None = None) -> DataFrame:
    """``asks``, ``id`` and the hashed keys of each block of normalised records; ``truth`` is equal for records that belong
    together. Written once; rows of one side that share an id become one, or, where ``texts`` (columns by name) are kept, each
    has the keys of all."""
    none, country = F.array().cast("array<bigint>"), F.col("country_key")

    def keys(block: str) -> Column:
        column = F.col(blocking._QUERY[block])
        if block in index.EXACT:
            return F.when((country != "") & (column != ""), F.array(F.xxhash64(country, column))).otherwise(none)
        values = text.char_ngrams(column) if block == "name_ngram" else F.array_distinct(text.split_nonempty(column, r"\|" if block == "postal" else " "))
        return F.when(country != "", F.transform(values, lambda v: F.xxhash64(country, v))).otherwise(none)

    own = F.array(truth) if truth is not None else none
    made = materialize(records.select(asks.alias("asks"), F.col("entity_id").alias("id"), *(keys(b).alias(b) for b in blocks), own.alias("truth"), *(F.col(c).alias(n) for n, c in (texts or {}).items())), "keys", _AS_NUMBERS)
    if made.groupBy("asks", "id").count().filter("count > 1").isEmpty():
        return made
    merged = made.groupBy("asks", "id").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in [*blocks, "truth"]))
    whole = materialize(made.select("asks", "id", *texts).join(merged, ["asks", "id"]) if texts else merged, "keys", _AS_NUMBERS)
    drop_materialized(made)
    return whole


def stored_keys(s1: DataFrame, postings: dict[str, DataFrame], blocks: list[str]) -> DataFrame:
    """The same of query records (``source1_entity_id``) and of the targets in postings: one shuffle of hashed keys by target."""
    asked = record_keys(s1.withColumnRenamed("source1_entity_id", "entity_id"), blocks, F.lit(True))
    rows = None
    for rank, b in enumerate(blocks):
        part = postings[b].select(F.col("entity_id").alias("id"), F.xxhash64("country_key", "value").alias("key"), F.lit(rank).alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    lists = rows.groupBy("id").agg(*(F.array_distinct(F.collect_list(F.when(F.col("rank") == rank, F.col("key")))).alias(b) for rank, b in enumerate(blocks)))
    held = materialize(lists.select(F.lit(False).alias("asks"), "*", F.array().cast("array<bigint>").alias("truth")), "keys", _AS_NUMBERS)
    return asked.unionByName(held)


def frequent(keys: DataFrame, block: str, cap: int) -> np.ndarray:
    """The keys that more than ``cap`` targets have, in order: one for ``cap`` postings at most."""
    counts = keys.filter(~F.col("asks")).select(F.explode(block).alias("key")).groupBy("key").count()
    return np.sort(counts.filter(F.col("count") > cap).select("key").toArrow().column(0).to_numpy())


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def _without(lists: pa.Array, capped: np.ndarray) -> pa.Array:
    values = lists.flatten().to_numpy()
    keep = capped[np.minimum(np.searchsorted(capped, values), len(capped) - 1)] != values if len(capped) else np.ones(len(values), bool)
    kept = _offsets(keep)[_offsets(_lengths(lists))]
    return pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(values[keep]))


def _numbers(n: int) -> type:
    """Numbers below ``n``."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def _grouped(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values in order, the places of all values in their order, and where each one's places begin and end."""
    values = lists.flatten().to_numpy()
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[first], order, np.append(first, len(values))


def _block(held: list[pa.RecordBatch], asks: bool) -> bytes:
    """One row of lists: each column of records, or of keys: the different ones, and for targets (``rows``) the records of each
    as steps from one to the next, for queries (``codes``) the number of each record's keys among them."""
    whole = pa.Table.from_batches(held).combine_chunks()
    out = {}
    for name in whole.column_names:
        column = whole.column(name).combine_chunks()
        if not pa.types.is_list(column.type):
            out[name] = column
            continue
        keys, order, first = _grouped(column)
        lengths = _lengths(column)
        out[f"{name}/keys"] = pa.array(keys)
        if asks:
            codes = np.empty(len(order), _numbers(len(keys)))
            codes[order] = np.repeat(np.arange(len(keys), dtype=codes.dtype), np.diff(first))
            out[f"{name}/lengths"], out[f"{name}/codes"] = pa.array(lengths.astype(np.uint32)), pa.array(codes)
        else:
            kind = _numbers(whole.num_rows)
            rows = np.repeat(np.arange(whole.num_rows, dtype=kind), lengths)[order]
            out[f"{name}/lengths"], out[f"{name}/rows"] = pa.array(np.diff(first).astype(np.uint32)), pa.array(np.diff(rows, prepend=kind(0)))
    row = pa.table({name: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for name, x in out.items()})
    to = pa.BufferOutputStream()
    with pa.ipc.new_stream(to, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(row)
    return to.getvalue().to_pybytes()


def _unpacked(block: pa.Buffer) -> tuple[pa.Table, dict[str, pa.Array]]:
    """The columns of records, and the others."""
    row = pa.ipc.open_stream(block).read_all()
    lists = {name: row.column(name).chunk(0).flatten() for name in row.column_names}
    return pa.table({n: x for n, x in lists.items() if "/" not in n}), {n: x for n, x in lists.items() if "/" in n}


def _packed(keys: DataFrame, blocks: list[str], caps: dict[str, int], by: str | None = None) -> DataFrame:
    """``asks`` and ``block``: records in blocks, without keys over their cap; a file for each. Those with the same text ``by``
    come one after the other, in one block as a rule."""
    capped = {b: frequent(keys, b, cap) for b, cap in caps.items() if b in blocks}
    names = [*blocks, "truth"]
    texts = [f.name for f in keys.schema if f.name not in ("asks", "id", *names)]
    total = {r["asks"]: r["count"] for r in keys.groupBy("asks").count().collect()}
    most = {True: min(ASKED_ROWS, max(256, -(-total.get(True, 0) // 16))), False: HELD_ROWS}
    most_keys = {True: MOST_KEYS, False: 3 * MOST_KEYS}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = {True: [], False: []}, {True: 0, False: 0}, {True: 0, False: 0}

        def out(side: bool) -> pa.RecordBatch:
            block = _block(held[side], side)
            held[side], rows[side], size[side] = [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array([side]), pa.array([block], pa.binary())], ["asks", "block"])

        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                piece = batch.slice(start, 2048)
                for side in (True, False):
                    part = piece.filter(pc.equal(piece.column("asks"), side))
                    if part.num_rows:
                        lists = [_without(part.column(n), capped.get(n, np.zeros(0, np.int64))) for n in names]
                        held[side].append(pa.RecordBatch.from_arrays([part.column("id"), *lists, *map(part.column, texts)], ["id", *names, *texts]))
                        rows[side] += part.num_rows
                        size[side] += sum(len(x.values) for x in lists)
                        if rows[side] >= most[side] or size[side] >= most_keys[side]:
                            yield out(side)
        for side in (True, False):
            if rows[side]:
                yield out(side)

    spark, path = keys.sparkSession, fresh(keys.sparkSession, "blocks")
    n = max(1, min(-(-sum(total.values()) // (45_000 if by else 20_000)), 512))
    few = keys.repartition(n, by).sortWithinPartitions(by) if by else keys.coalesce(n)
    few.mapInArrow(pack, "asks boolean, block binary").write.option("maxRecordsPerFile", 1).partitionBy("asks").parquet(path)
    return spark.read.schema("block binary, asks boolean").parquet(path)


class _Held:
    """A block of targets: for each column of keys the different ones, and whose they are."""

    def __init__(self, block: pa.Buffer):
        self.table, lists = _unpacked(block)
        self.ids, self.n, self.of = self.table.column("id").combine_chunks(), self.table.num_rows, {}
        for name in (n.removesuffix("/keys") for n in lists if n.endswith("/keys")):
            steps = lists[f"{name}/rows"].to_numpy()
            self.of[name] = lists[f"{name}/keys"].to_numpy(), _offsets(lists[f"{name}/lengths"].to_numpy()), np.cumsum(steps, dtype=steps.dtype)


def _asked(block: pa.Buffer, held: _Held) -> tuple[pa.Table, dict[str, tuple]]:
    """The queries and, for each column, where their keys' targets begin and end, and where each query's keys do."""
    whole, lists = _unpacked(block)
    out = {}
    for name, (keys, first, _) in held.of.items():
        own, codes = lists[f"{name}/keys"].to_numpy(), lists[f"{name}/codes"].to_numpy()
        if len(keys) and len(own):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            there = keys[at] == own
            kept = there[codes]
            at = at[codes[kept]]
            if len(at):
                out[name] = first[at], first[at + 1], _offsets(kept)[_offsets(lists[f"{name}/lengths"].to_numpy())].tolist()
    return whole, out


def _slices(start: np.ndarray, end: np.ndarray, lo: int, hi: int) -> Iterator[slice]:
    return map(slice, start[lo:hi].tolist(), end[lo:hi].tolist())


def _read(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The mask, the first block and the shared words of names and addresses."""
    count = {b: (v >> _AT[b]) & ((1 << n) - 1) for b, n in _BITS.items()}
    mask, first = np.zeros(len(v), np.int32), np.full(len(v), 99, np.int32)
    for rank, b in reversed(list(enumerate(blocking.BLOCKS))):
        there = count[b] > 0 if b in count else (v >> _AT[b]) & 1 > 0
        mask |= there.astype(np.int32) << rank
        first[there] = rank
    return mask, first, count["rare_name_token"], count["rare_address_token"]


def _shared(asked: dict[str, tuple], held: _Held, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query that finds something: its number, the counts of shared address words by target and the targets that
    share anything else. What is shared in all is then in the first of the two arrays."""
    exact = {"exact_name", "compact_name", "core_name", "exact_address", "truth"}
    others = [(b in exact, 1 << _AT[b], held.of[b][2], *x) for b, x in asked.items() if b != "rare_address_token"]
    start, end, at = asked.get("rare_address_token", (np.zeros(0, np.int64), np.zeros(0, np.int64), [0] * (n + 1)))
    rows = held.of["rare_address_token"][2] if "rare_address_token" in held.of else None
    for i in range(n):
        lo, hi = at[i], at[i + 1]
        more = [(one, w, of[s]) for one, w, of, ss, es, o in others if o[i] < o[i + 1] for s in _slices(ss, es, o[i], o[i + 1])]
        if hi > lo or more:
            c = np.bincount(np.concatenate([rows[s] for s in _slices(start, end, lo, hi)]), minlength=held.n) if hi > lo else np.zeros(held.n, np.int64)
            yield i, c, more


def _add(c: np.ndarray, more: list) -> np.ndarray:
    """Adds to the counts what is shared besides address words, and returns the targets that share it."""
    if not more:
        return np.zeros(0, np.int64)
    ids = more[0][2] if len(more) == 1 else np.concatenate([x for _, _, x in more])
    if 8 * len(ids) > len(c):
        mark = np.zeros(len(c), bool)
        mark[ids] = True
        ids = np.flatnonzero(mark)
    elif len(more) > 1:
        ids = np.unique(ids)
    for one, w, x in more:
        c[x] = c[x] | w if one else c[x] + w
    return ids


def _met(keys: DataFrame, blocks: list[str], caps: dict[str, int], each, schema: str, by: str | None = None) -> DataFrame:
    packed = _packed(keys, blocks, caps, by)
    asked, held = (packed.filter(F.col("asks") == side).select(F.col("block").alias(name)) for side, name in ((True, "asked"), (False, "held")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, targets = None, None
        for batch in batches:
            for q, t in zip(batch.column("asked"), batch.column("held"), strict=True):
                if last is None or not last.equals(t.as_buffer()):  # one block of targets meets several of queries in turn
                    last, targets = t.as_buffer(), None
                    targets = _Held(last)
                queries, found = _asked(q.as_buffer(), targets)
                if found:
                    yield from each(queries, found, targets)

    return asked.join(held.hint("shuffle_replicate_nl")).mapInArrow(meet, schema)


def tallies(keys: DataFrame, blocks: list[str], caps: dict[str, int]) -> DataFrame:
    """How many pairs (``n``) of each query have the same ``mask``, ``first_block``, ``is_true``, ``name_overlap`` and
    ``address_overlap``, where 2 stands for two or more words. Rows of a query and a kind of pairs may be several."""
    address = 1 << _AT["rare_address_token"]

    def each(queries: pa.Table, found: dict, targets: _Held) -> Iterator[pa.RecordBatch]:
        ids, who, what, n = queries.column("id").combine_chunks(), [], [], []
        for i, c, more in _shared(found, targets, len(ids)):
            once, any_ = int(np.count_nonzero(c == address)), int(np.count_nonzero(c))
            if more:
                before = c.copy() if any_ else c
                touched = _add(c, more)
                if any_:
                    own = before[touched]
                    once, any_ = once - int(np.count_nonzero(own == address)), any_ - int(np.count_nonzero(own))
                kinds, times = np.unique(c[touched], return_counts=True)
                who += [i] * len(kinds)
                what += kinds.tolist()
                n += times.tolist()
            for v, m in ((address, once), (2 * address, any_ - once)):
                if m:
                    who.append(i)
                    what.append(v)
                    n.append(m)
        v = np.array(what, np.int64)
        keep = np.flatnonzero(v & _FOUND)
        v, who, n = v[keep], np.array(who, np.int64)[keep], np.array(n, np.int64)[keep]
        mask, first, names, words = _read(v)
        names, words = np.minimum(names, 2), np.minimum(words, 2)
        # Counts of words above two fall together.
        kind = np.stack([who, mask, first, names, words, v >> _AT["truth"]])
        if len(v):
            order = np.lexsort(kind)
            kind, n = kind[:, order], n[order]
            begin = np.flatnonzero(np.concatenate(([True], (kind[:, 1:] != kind[:, :-1]).any(axis=0))))
            kind, n = kind[:, begin], np.add.reduceat(n, begin)
            columns = [ids.take(pa.array(kind[0])), pa.array(kind[1], pa.int32()), pa.array(kind[2], pa.int32()), pa.array(kind[3]), pa.array(kind[4]), pa.array(kind[5] > 0), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in TALLY.split(", ")])

    return _met(keys, blocks, caps, each, TALLY)


def pairs(keys: DataFrame, blocks: list[str], caps: dict[str, int], rule: str = "v1", whole: bool = False) -> DataFrame:
    """The pairs that a strategy (``v1``, ``v2``, ``v3``) keeps; ``whole`` for all columns of the evidence."""
    schema = EVIDENCE if whole else PAIRS
    strong = sum(1 << _AT[b] for b in ("exact_name", "compact_name", "core_name", "exact_address")) | ((1 << _BITS["postal"]) - 1) << _AT["postal"]
    name, address = (((1 << _BITS[b]) - 1) << _AT[b] for b in ("rare_name_token", "rare_address_token"))

    def kept(v: np.ndarray) -> np.ndarray:
        if rule == "v1":
            return v & _FOUND != 0
        both = (v & strong != 0) | ((v & name != 0) & (v & address != 0))
        return both if rule == "v2" else both | (v & name >= 2 << _AT["rare_name_token"]) | (v & address >= 2)

    def each(queries: pa.Table, found: dict, targets: _Held) -> Iterator[pa.RecordBatch]:
        ids, who, whom, what, rows = queries.column("id").combine_chunks(), [], [], [], 0

        def out() -> pa.RecordBatch:
            of = np.repeat(np.array([i for i, _ in who], np.int64), [n for _, n in who])
            columns = [ids.take(pa.array(of)), targets.ids.take(pa.array(np.concatenate(whom)))]
            if whole:
                mask, first, names, words = _read(np.concatenate(what))
                columns += [pa.array(mask), pa.array(first), pa.array(names), pa.array(words)]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

        for i, c, more in _shared(found, targets, len(ids)):
            if rule == "v2" and not more:  # address words alone do not do
                continue
            touched = _add(c, more)
            at = touched if rule == "v2" else np.flatnonzero(c)
            v = c[at]
            keep = kept(v)
            at, v = at[keep], v[keep]
            if len(at):
                who.append((i, len(at)))
                whom.append(at)
                what.append(v)
                rows += len(at)
            if rows >= BATCH:
                yield out()
                who, whom, what, rows = [], [], [], 0
        if rows:
            yield out()

    return _met(keys, blocks, caps, each, schema)


def retrieve(s1: DataFrame, postings: dict[str, DataFrame], caps: dict[str, int]) -> DataFrame:
    """What ``blocking.retrieve`` returns, for many queries at once: no pair is shuffled. Keys with more rows than a block's cap
    are left out whole."""
    blocks = [b for b in blocking.BLOCKS if b in postings]
    rare = {b: index.without_frequent(postings[b], caps[b]) if b in caps else postings[b] for b in blocks}
    found = pairs(stored_keys(s1, rare, blocks), blocks, {}, whole=True)
    return found.select("source1_entity_id", "candidate_entity_id", blocking.methods().alias("methods"))


def similarities(keys: DataFrame, blocks: list[str], by: str, other: str) -> DataFrame:
    """The pairs of the blocks, which are of exact keys, and the Ratcliff-Obershelp ratios of two texts, as ``<text>_similarity``.

    Equal texts are compared once: records come in order of the text ``by``, of which each has few, so a pair of such texts
    meets in one task, and there all pairs of records that have it. Pairs of the text ``other`` are remembered."""
    schema = f"{PAIRS}, {other}_similarity double, {by}_similarity double"

    def each(queries: pa.Table, found: dict, targets: _Held) -> Iterator[pa.RecordBatch]:
        ids, known, ready, rows = queries.column("id").combine_chunks(), {}, [], 0
        (x, xs), (y, ys), (a, as_), (b, bs) = ((c.indices.to_numpy(), c.dictionary.to_pylist()) for c in (t.column(n).combine_chunks().dictionary_encode() for n in (by, other) for t in (queries, targets.table)))
        postings = [(targets.of[n][2], *at) for n, at in found.items()]
        row_of, row = [-1], {}

        def compared(who: list, whom: list) -> tuple:
            """For queries with the same text ``by``."""
            of, at = np.repeat(np.array(who), [len(w) for w in whom]), np.concatenate(whom)
            near, back = np.unique(y[at], return_inverse=True)
            if row_of[0] != x[who[0]]:
                row_of[0] = x[who[0]]
                row.clear()
            left = xs[row_of[0]]
            row.update({k: udfs.ratio(left, ys[k]) for k in near.tolist() if k not in row})
            first = np.array([row[k] for k in near.tolist()])[back]
            kinds, back = np.unique(a[of].astype(np.int64) * len(bs) + b[at], return_inverse=True)
            if len(known) > 1_000_000:
                known.clear()
            known.update({k: udfs.ratio(as_[k // len(bs)], bs[k % len(bs)]) for k in kinds.tolist() if k not in known})
            return of, at, np.array([known[k] for k in kinds.tolist()])[back], first

        def out() -> pa.RecordBatch:
            of, at, second, first = map(np.concatenate, zip(*ready, strict=True))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(of)), targets.ids.take(pa.array(at)), pa.array(second), pa.array(first)], [c.split()[0] for c in schema.split(", ")])

        who, whom, n = [], [], 0
        for i in range(len(ids)):
            if who and (x[i] != x[who[0]] or n >= BATCH):
                ready.append(compared(who, whom))
                who, whom, rows, n = [], [], rows + n, 0
                if rows >= BATCH:
                    yield out()
                    ready, rows = [], 0
            own = [of[s] for of, ss, es, o in postings for s in _slices(ss, es, o[i], o[i + 1])]
            if own:
                own = own[0] if len(own) == 1 else np.unique(np.concatenate(own))
                who.append(i)
                whom.append(own)
                n += len(own)
        if who:
            ready.append(compared(who, whom))
        if ready:
            yield out()

    return _met(keys, blocks, {}, each, schema, by)
