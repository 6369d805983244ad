"""Operator 3, exact substring dedup by enhanced suffix arrays over shards of likely repeats."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kindred.llm.common import drop_materialized, few_rows, materialize, row_key, slices, unused

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Starts of windows that are looked at in one go.
CHUNK = 1 << 17
#: Bytes of contexts that make a shard, and windows of it that are sorted in one go.
SHARD, SORTED = 2 << 20, 1 << 20
#: An anchor with more different contexts is not one task's work: its windows are counted by hash instead.
CROWD = 20_000


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, as many as the next power of two from ``n``."""
    size = max(1 << 12, 1 << (n - 1).bit_length())
    if size != n:
        return _powers(size)
    out = []
    for b in (_BASE, _INVERSE):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Hashes:
    """Polynomial hashes modulo 2^64 of all stretches of some bytes."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, first: int, starts: int, window: int, k: int) -> tuple[np.ndarray, ...]:
    """The windows of ``window`` bytes that start at ``first`` and the ``starts - 1`` places after it, in runs that share an
    anchor: the leftmost of the ``k``-byte stretches with the least hash in the window. Equal windows have their anchors at
    equal places. Returns, for each run, the first and last start, the place of the anchor, and hashes of the anchor and of
    all bytes of the run."""
    data = data[first : first + starts + window - 1]
    hashes = Hashes(data)
    at = np.arange(len(data) - k + 1)
    gram = hashes(at, at + k)
    # Hash and place in one number: the least is the leftmost of the least.
    bits = np.uint64(max(1, int(len(at) - 1).bit_length()))
    low = (gram >> bits << bits) | at.astype(np.uint64)
    width, have = window - k + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)[:starts]
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([begin[1:], [starts]]) - 1
    place = place[begin]
    whole = hashes(begin, last + window) ^ ((place - begin).astype(np.uint64) << np.uint64(32) | (last - begin).astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return begin + first, last + first, place + first, gram[place].view(np.int64), whole.view(np.int64)


def repeats(texts: list[bytes], many: np.ndarray, window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """All maximal repeats of ``window`` bytes or more among some contexts: length, and each occurrence as context and
    place.

    ``texts`` are the contexts and ``many`` the windows that start in each. The suffixes at those starts form an enhanced
    suffix array: they are in an order (by hash of the first ``window`` bytes, then by what follows) in which those with a
    common prefix stand together, with the length of the common prefix of neighbours. A scan with a stack yields the
    intervals with a common prefix of ``window`` or more, which are the nodes of the tree of common prefixes; those whose
    occurrences differ in the byte on their left, or start a context, cannot be extended and are reported with all
    occurrences. Suffixes whose whole group has one byte on the left are extended by another start and not sorted further.
    Many windows are taken in turns, by their hash, so that equal ones have the same turn and memory stays bounded.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    turns = max(1, -(-int(many.sum()) // SORTED))
    return [x for turn in range(turns) for x in _repeats(texts, sizes, many, window, turn, turns)]


def _keyed(texts: list[bytes], sizes: np.ndarray, many: np.ndarray, window: int, turn: int, turns: int) -> tuple[np.ndarray, ...]:
    """Context, place, hash and byte on the left (256 and more at a context's start) of the windows whose turn it is."""
    found = []
    for a, b in slices(sizes.tolist(), CHUNK):
        data, n = np.frombuffer(b"".join(texts[a:b]), np.uint8), many[a:b]
        text = np.repeat(np.arange(b - a), n)
        place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        at = (np.cumsum(sizes[a:b]) - sizes[a:b])[text] + place
        key = Hashes(data)(at, at + window)
        mine = key % np.uint64(turns) == turn if turns > 1 else np.ones(len(key), bool)
        left = np.where(place > 0, data[np.maximum(at - 1, 0)].astype(np.int64), 256 + a + text)
        found.append((a + text[mine], place[mine], key[mine], left[mine]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4


def _repeats(texts: list[bytes], sizes: np.ndarray, many: np.ndarray, window: int, turn: int, turns: int) -> list[tuple[int, list[tuple[int, int]]]]:
    text, place, key, left = _keyed(texts, sizes, many, window, turn, turns)
    if not len(key):
        return []
    order = np.argsort(key, kind="stable")
    key, left = key[order], left[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([first, [len(order)]]))
    diverse = np.maximum.reduceat(left, first) != np.minimum.reduceat(left, first)
    out = []
    for s, n in zip(first[(count > 1) & diverse].tolist(), count[(count > 1) & diverse].tolist(), strict=True):
        rest = sorted((texts[text[i]][place[i] + window :], int(left[j]), int(text[i]), int(place[i])) for j, i in enumerate(order[s : s + n].tolist(), s))
        common = [0, *(window + _common(a[0], b[0]) for a, b in zip(rest, rest[1:], strict=False)), 0]
        stack: list[tuple[int, int]] = []  # length of the common prefix and first suffix of each open interval
        for i in range(1, n + 1):
            start = i - 1
            while stack and stack[-1][0] > common[i]:
                length, start = stack.pop()
                inside = rest[start:i]
                if len({x[1] for x in inside}) > 1:
                    out.append((length, [(x[2], x[3]) for x in inside]))
            if common[i] >= window and (not stack or stack[-1][0] < common[i]):
                stack.append((common[i], start))
    return out


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _scan(docs: DataFrame, window: int, k: int, place: str) -> DataFrame:
    """The runs of windows of every document: its key, anchor and context hashes, first start and number of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).fill_null("").cast(pa.large_string())
            offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            every = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            for a, b in slices(np.diff(offset).tolist(), CHUNK):
                # Short documents together: windows that span two of them are left out below.
                data, ends = every[offset[a] : offset[b]], offset[a + 1 : b + 1] - offset[a]
                sizes = np.diff(offset[a : b + 1])
                for first in range(0, max(len(data) - window + 1, 0), CHUNK):
                    starts = min(CHUNK, len(data) - window + 1 - first)
                    found = _split(anchors(data, first, starts, window, k), data, ends, window)
                    begin, last, place, gram, whole = found
                    doc = np.searchsorted(ends, begin, "right")
                    keys = batch.select([0, 1]).take(pa.array(a + doc))
                    yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(gram), pa.array(whole), pa.array(begin - (ends - sizes)[doc]), pa.array((last - begin + 1).astype(np.int32))], names=["did", "rk", "anchor", "context", "start", "n"])

    return docs.mapInArrow(run, f"{place}, anchor long, context long, start long, n int")


def _split(found: tuple[np.ndarray, ...], data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The runs without the windows that span two documents."""
    begin, last, place, gram, whole = found
    doc = np.searchsorted(ends, begin, "right")
    spans = last + window > ends[doc]
    if not spans.any():
        return found
    rows: list[tuple[int, int, int, int]] = []
    for b, z, p, g in zip(begin[spans].tolist(), last[spans].tolist(), place[spans].tolist(), gram[spans].tolist(), strict=True):
        d = int(np.searchsorted(ends, b, "right"))
        while d < len(ends) and b <= z:
            stop = min(z, int(ends[d]) - window)
            if stop >= b:
                rows.append((b, stop, p, g))
            b = max(b, int(ends[d]))
            d += 1
    new = np.array(rows, np.int64).reshape(-1, 4).T
    contexts = _contexts(data, new[0], new[1], new[2], window)
    return tuple(np.concatenate([x[~spans], y]) for x, y in zip((begin, last, place, gram, whole), (*new, contexts), strict=True))


def _contexts(data: np.ndarray, begin: np.ndarray, last: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """The hashes of contexts, as ``anchors`` makes them, for few runs."""
    out = np.empty(len(begin), np.int64)
    for i, (b, z, p) in enumerate(zip(begin.tolist(), last.tolist(), place.tolist(), strict=True)):
        h = Hashes(data[b : z + window])(np.array([0]), np.array([z + window - b]))
        out[i] = (h ^ np.array([(p - b) << 32 | (z - b)], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)[0]
    return out


def covered(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 400, k: int = 128) -> DataFrame:
    """``did``, ``rk`` (hash of id and text) and ``spans``: for each document with repeats, starts and ends of stretches that
    every byte covered by a repeated window lies in, in no order. ``remove_repeats`` says what counts as a repeat.

    Each window of a document belongs to the anchor in it, and windows of one anchor to one context, so equal windows meet
    under equal anchors. Contexts are compared by their hashes first: all windows of one that comes up again are repeats,
    and none of one whose anchor is found nowhere else. The bytes of the others, mostly at the edges of copied passages,
    are dealt by anchor into shards, where suffix arrays find the maximal repeats. Anchors with over ``CROWD`` contexts are
    dealt by the hashes of their windows, which no anchor can crowd.
    """
    own = docs.select(F.col(doc_id).alias("did"), row_key(doc_id, text).alias("rk"), F.col(text).alias("text"))
    place = f"did {own.schema['did'].dataType.simpleString()}, rk long"
    kind = to_arrow_type(own.schema["did"].dataType)
    runs = materialize(_scan(own, window, k, place), "runs")
    kinds = runs.groupBy("anchor", "context").agg(F.count("*").alias("copies"), F.min(F.struct("did", "rk", "start", "n")).alias("place"))
    kinds = materialize(kinds.select("anchor", "context", "copies", "place.*"), "kinds")
    busy = materialize(kinds.groupBy("anchor").agg(F.count("*").alias("contexts"), F.sum("copies").alias("total")).filter("total > 1"), "busy")
    shared = materialize(kinds.join(busy, "anchor").drop("total"), "shared")

    # Contexts that come up again: all of their windows are repeats, wherever they are.
    again = shared.filter("copies > 1").select("anchor", "context")
    whole = runs.join(again, ["anchor", "context"], "left_semi").select("did", "rk", F.col("start").alias("s"), (F.col("start") + F.col("n") + (window - 1)).alias("e"))

    # Contexts to look into: those found once, and a specimen of each that comes up again, which needs no answer.
    wanted = shared.filter("contexts > 1").select("did", "rk", "start", "n", "anchor", "contexts", (F.col("copies") == 1).alias("asks"))
    lists = materialize(wanted.groupBy("did", "rk").agg(F.collect_list(F.struct("start", "n", "anchor", "contexts", "asks")).alias("asked")), "wanted")
    texts = own.join(lists, own["did"].eqNullSafe(lists["did"]) & (own["rk"] == lists["rk"])).select(own["did"], own["rk"], "text", "asked")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(batches):
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for did, rk, text, asked in zip(*(c.to_pylist() for c in part.columns), strict=True):
                raw = _bytes(text)
                for x in asked:
                    row = (did, rk, x["start"], x["n"], x["anchor"], x["asks"], raw[x["start"] : x["start"] + x["n"] + window - 1])
                    if x["contexts"] > CROWD:
                        row = (*row[:4], None, *row[5:])
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                if len(out[0]) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
                    out = ([], [], [], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    names = ["did", "rk", "start", "n", "anchor", "asks", "raw"]
    types = [kind, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
    crowded = busy.filter(f"contexts > {CROWD}").limit(1).count() > 0
    contexts = texts.select("did", "rk", "text", "asked").mapInArrow(extract, f"{place}, start long, n int, anchor long, asks boolean, raw binary")
    if crowded:
        contexts = materialize(contexts, "contexts")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def spans(batch: pa.Table) -> pa.RecordBatch:
            raw, many = batch.column("raw").to_pylist(), np.asarray(batch.column("n")).astype(np.int64)
            asks, start = np.asarray(batch.column("asks")), np.asarray(batch.column("start"))
            best: dict[tuple[int, int], int] = {}
            for length, places in repeats(raw, many, window):
                for p in places:
                    if asks[p[0]]:
                        best[p] = max(best.get(p, 0), length)
            row = np.array([p[0] for p in best], np.int64)
            s = start[row] + np.array([p[1] for p in best], np.int64)
            keys = batch.select(["did", "rk"]).take(pa.array(row)).combine_chunks()
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in keys.columns), pa.array(s), pa.array(s + np.array(list(best.values()), np.int64))], names=["did", "rk", "s", "e"])

        size = 0
        for batch in batches:
            # Rows come in order of their anchors; a shard ends where an anchor does.
            anchor = np.asarray(batch.column("anchor"))
            edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else []
            for i, j in zip(edges, [*edges[1:], len(anchor)], strict=True):
                if held and size > SHARD and held[-1].column("anchor")[-1].as_py() != anchor[i]:
                    yield spans(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(batch.slice(i, j - i))
                size += held[-1].column("raw").nbytes
        if held:
            yield spans(pa.Table.from_batches(held))

    span = f"{place}, s long, e long"
    dealt = contexts.filter("anchor is not null").repartition(F.col("anchor")).sortWithinPartitions("anchor")
    inner = dealt.mapInArrow(shards, span)
    parts = whole.unionAll(inner)
    if crowded:

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 2000):
                    part = batch.slice(i, 2000)
                    many = np.asarray(part.column("n")).astype(np.int64)
                    raw = part.column("raw").to_pylist()
                    size = np.array([len(r) for r in raw], np.int64)
                    row = np.repeat(np.arange(len(many)), many)
                    place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    at = (np.cumsum(size) - size)[row] + place
                    h = Hashes(np.frombuffer(b"".join(raw), np.uint8))(at, at + window)
                    keys = part.select(["did", "rk", "asks"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(np.asarray(part.column("start"))[row] + place), pa.array(h.view(np.int64))], names=["did", "rk", "asks", "s", "h"])

        every = contexts.filter("anchor is null").mapInArrow(windows, f"{place}, asks boolean, s long, h long")
        twice = materialize(every.groupBy("h").count().filter("count > 1").select("h"), "twice")
        parts = parts.unionAll(every.filter("asks").join(twice, "h", "left_semi").select("did", "rk", "s", (F.col("s") + window).alias("e")))
    spans = materialize(parts.groupBy("did", "rk").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    for old in (runs, kinds, busy, shared, lists):
        drop_materialized(old)
    return spans


def repeat_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 400, k: int = 128) -> DataFrame:
    """All maximal repeats of ``window`` bytes or more with all of their occurrences: ``group_id``, ``length``, ``doc_id`` and
    ``start`` (in bytes), a row for each occurrence.

    A repeat is maximal if its occurrences do not all have the same byte on the left, nor all on the right (a text's ends
    are unlike all bytes and each other). Every occurrence lies within one of the runs that ``covered`` finds. Their windows
    are counted by hash and by the byte on the left; those with more than one are where maximal repeats start. What follows
    such a start, up to the end of its run, is a suffix; equal suffixes of a start are one with a count, and a shard sorts
    the different ones of each start and scans their common prefixes with a stack: an interval whose occurrences differ on
    the left is a group. Its occurrences are joined back, so a group may have any number.

    Null and empty texts have no repeats; rows that repeat are repeats of each other, each with its own rows in the result;
    ids may be null and of any type; ties do not arise; an empty table gives no rows; other columns are ignored. Very long
    texts are read whole. Only the bytes that repeat are worked on: some forty bytes are shuffled for each.
    """
    found = covered(docs, doc_id=doc_id, text=text, window=window, k=k)
    own = docs.select(F.col(doc_id).alias("did"), row_key(doc_id, text).alias("rk"), F.col(text).alias("text"))
    kind, arrow = own.schema["did"].dataType.simpleString(), to_arrow_type(own.schema["did"].dataType)
    asked = own.join(found, own["did"].eqNullSafe(found["did"]) & (own["rk"] == found["rk"])).select(own["did"], own["rk"], "text", "spans")
    # Rows that repeat have one key: a number tells them apart.
    asked = materialize(asked.withColumn("rk", F.xxhash64("rk", F.monotonically_increasing_id())), "asked")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            for i in range(batch.num_rows):
                raw = np.frombuffer(_bytes(batch.column(2)[i].as_py()), np.uint8)
                for s, e in union([(x["s"], x["e"]) for x in batch.column(3)[i].as_py()]):
                    for a in range(s, e - window + 1, CHUNK):
                        at = np.arange(a, min(a + CHUNK, e - window + 1))
                        h = Hashes(raw[a : at[-1] + window])(at - a, at - a + window)
                        left = np.where(at > 0, raw[np.maximum(at - 1, 0)].astype(np.int16), -1).astype(np.int16)
                        keys = batch.select([0, 1]).take(pa.array(np.full(len(at), i)))
                        yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(at), pa.array(np.full(len(at), e)), pa.array(h.view(np.int64)), pa.array(left)], names=["did", "rk", "start", "e", "h", "left"])

    every = asked.mapInArrow(windows, f"did {kind}, rk long, start long, e long, h long, left short")
    diverse = every.groupBy("h").agg(F.count("*").alias("n"), F.min("left").alias("low"), F.max("left").alias("high")).filter("n > 1 and (low < high or low = -1)")
    begins = materialize(every.join(materialize(diverse.select("h"), "diverse"), "h", "left_semi"), "begins")
    lists = begins.groupBy("rk").agg(F.collect_list(F.struct("start", "e", "h", "left")).alias("begins"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 16):
            for i in range(batch.num_rows):
                raw, rows = _bytes(batch.column(2)[i].as_py()), batch.column(3)[i].as_py()
                for a, b in slices([x["e"] - x["start"] for x in rows], SHARD):
                    part = rows[a:b]
                    rest = [raw[x["start"] + window : x["e"]] for x in part]
                    ids = [int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little", signed=True) for r in rest]
                    columns = [pa.array([batch.column(0)[i].as_py()] * len(part), arrow), *(pa.array([x[c] for x in part], pa.int64()) for c in ("start", "h", "left")), pa.array(ids, pa.int64()), pa.array(rest, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["did", "start", "h", "left", "kind", "rest"])

    shape = f"did {kind}, start long, h long, left long, kind long, rest binary"
    follow = asked.join(lists, "rk").select("did", "rk", "text", "begins").mapInArrow(suffixes, shape)
    places = materialize(follow.drop("rest"), "places")
    kinds = follow.groupBy("h", "kind").agg(F.count("*").alias("n"), F.collect_set("left").alias("lefts"), F.first("rest").alias("rest"))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def scanned() -> pa.RecordBatch:
            rows = [(held[0][0], length, number, kind) for number, (length, kinds_) in enumerate(_intervals(held, window)) for kind in kinds_]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h", "length", "number", "kind"])

        for batch in few_rows(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield scanned()
                    held.clear()
                held.append(row)
        if held:
            yield scanned()

    nodes = kinds.select("h", "kind", "n", "lefts", "rest").repartition("h").sortWithinPartitions("h").mapInArrow(groups, "h long, length long, number long, kind long")
    return nodes.join(places, ["h", "kind"]).select(F.xxhash64("h", "length", "number").alias("group_id"), "length", F.col("did").alias("doc_id"), "start")


def _intervals(rows: list[tuple], window: int) -> list[tuple[int, set[int]]]:
    """The length of each left-diverse interval of common prefixes, and its suffixes, from the different suffixes of one
    window: window, name, how often, bytes on the left, and what follows the window."""
    rest = sorted(((r[4], r[1], r[3]) for r in rows for _ in range(min(r[2], 2))), key=lambda x: x[:2])
    common = [0, *(window + _common(a[0], b[0]) for a, b in zip(rest, rest[1:], strict=False)), 0]
    out, stack = [], []
    for i in range(1, len(rest) + 1):
        start = i - 1
        while stack and stack[-1][0] > common[i]:
            length, start = stack.pop()
            lefts = {x for r in rest[start:i] for x in r[2]}
            if len(lefts) > 1 or -1 in lefts:
                out.append((length, {r[1] for r in rest[start:i]}))
        if common[i] >= window and (not stack or stack[-1][0] < common[i]):
            stack.append((common[i], start))
    return out


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in ``spans``, in order."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _with_spans(docs: DataFrame, doc_id: str, text: str, window: int, k: int, columns: list[str]) -> DataFrame:
    key, spans = unused(docs.columns, "rk", "spans")
    found = covered(docs, doc_id=doc_id, text=text, window=window, k=k)
    keyed = docs.withColumn(key, row_key(doc_id, text))
    on = (keyed[key] == found["rk"]) & keyed[doc_id].eqNullSafe(found["did"])
    return keyed.join(found, on, "left").select(*(keyed[c] for c in columns), found["spans"].alias(spans))


def repeat_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 400, k: int = 128) -> DataFrame:
    """What ``remove_repeats`` does to every document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs of
    removed bytes) and ``kept_sha256`` (of the bytes that stay), a row for each input row. Null texts are empty; ids may be
    null or repeat, and of any type; rows that repeat are repeats of each other; there are no ties, as all copies go; very
    long texts are scanned in pieces that overlap; an empty table gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows = []
            for t, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw, gone = _bytes(t.as_py()), union([(x["s"], x["e"]) for x in spans or ()])
                kept, at = hashlib.sha256(), 0
                for s, e in gone:
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                rows.append((len(raw), sum(e - s for s, e in gone), len(gone), kept.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return _with_spans(docs, doc_id, text, window, k, [doc_id, text]).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 400, k: int = 128) -> DataFrame:
    """``docs`` without the bytes that a repeated window covers; columns and types stay.

    Texts are bytes of UTF-8. A window is ``window`` bytes of one text; it is repeated if the same bytes start anywhere
    else, in the same text (overlaps count) or another, and all of its copies go. Windows are judged on the texts as they
    come. Where a cut leaves part of a character, that part is dropped from the new text. Null texts stay null; rows that
    repeat are repeats of each other; an empty table stays empty; very long texts are scanned in pieces that overlap.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            out: list[str | None] = []
            for t, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if t is not None and spans:
                    raw, kept, last = _bytes(t), [], 0
                    for s, e in union([(x["s"], x["e"]) for x in spans]):
                        kept.append(raw[last:s])
                        last = e
                    t = b"".join([*kept, raw[last:]]).decode("utf-8", "ignore")
                out.append(t)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return _with_spans(docs, doc_id, text, window, k, docs.columns).mapInArrow(run, docs.schema)


def brute_force(texts: list[str | None], window: int = 400) -> list[tuple[int, int, int, str]]:
    """What ``repeat_report`` returns, without the ids, by counting every window. For tests."""
    raws = [_bytes(t) for t in texts]
    seen = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = union([(i, i + window) for i in range(len(r) - window + 1) if seen[r[i : i + window]] > 1])
        mask = np.ones(len(r), bool)
        for s, e in gone:
            mask[s:e] = False
        kept = bytes(np.frombuffer(r, np.uint8)[mask])
        out.append((len(r), sum(e - s for s, e in gone), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
