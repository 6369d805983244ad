"""Operator 9, benchmark decontamination by suffix arrays over shards of the training texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import materialize, row_key, slices

#: A word is a longest run of these bytes of UTF-8: digits, lower-case letters, and all of non-ASCII characters.
_WORD = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_TABLE = bytes(b if b in _WORD else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
WINDOW = 13


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Suffixes(NamedTuple):
    """The suffixes of all items of a block, as far as they decide a window: each distinct window once."""

    vocab: dict[bytes, int]  # word -> id from 1
    low: np.ndarray  # for each window, the least byte string of ids that begins with it
    high: np.ndarray  # and what no string that begins with it reaches
    width: np.ndarray  # words in the window
    first: np.ndarray  # where the window's items start in `item`; one more entry at the end
    item: np.ndarray  # numbers of items
    place: np.ndarray  # where in the item the window starts
    starts: dict[int, np.ndarray]  # g -> sorted hashes of the first g words of windows, g = min(3, width)


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _gram(ids: np.ndarray, at: np.ndarray, g: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for j in range(g):
        h = (h ^ ids[at + j].astype(np.uint64)) * _MIX[j]
        h ^= h >> np.uint64(29)
    return h


def index(texts: list[str | None], window: int = WINDOW) -> Suffixes:
    """The test suffixes of some items."""
    vocab: dict[bytes, int] = {}
    found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for k, text in enumerate(texts):
        ids = [vocab.setdefault(w, len(vocab) + 1) for w in words(text)]
        w = min(len(ids), window)
        for i in range(len(ids) - w + 1 if w else 0):
            found.setdefault(tuple(ids[i : i + w]), []).append((k, i))
    keys = np.zeros((len(found), window), np.uint32)
    for row, key in zip(keys, found, strict=True):
        row[: len(key)] = key
    width = np.array([len(k) for k in found], np.int64)
    first = np.concatenate([[0], np.cumsum([len(v) for v in found.values()])]).astype(np.int64)
    both = np.array([p for v in found.values() for p in v], np.int64).reshape(-1, 2)
    starts = {}
    for g in (1, 2, 3):
        rows = keys[np.minimum(width, 3) == g]
        if len(rows):
            flat = np.concatenate([rows[:, :3].reshape(-1), np.zeros(3, np.uint32)])
            starts[g] = np.unique(_gram(flat, np.arange(len(rows)) * 3, g))
    ends = np.where(np.arange(window) < width[:, None], keys, np.uint32(0xFFFFFFFF))
    return Suffixes(vocab, _rows(keys), _rows(ends), width, first, both[:, 0].copy(), both[:, 1].copy(), starts)


def _rows(ids: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings in the order of the ids."""
    return np.ascontiguousarray(ids.astype(">u4")).view(f"S{4 * ids.shape[1]}").ravel()


def occurrences(ids: np.ndarray, test: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Where each window of ``test`` occurs in a shard: positions and numbers of windows.

    ``ids`` are the words of the shard's documents, zero for words no item has, with a zero after each document. The suffix
    array holds the suffixes that can begin a window: those whose first words (three, or all of a shorter window) begin
    some window. Every test suffix is then found in it by binary search, at both ends of its range.
    """
    padded = np.concatenate([ids, np.zeros(WINDOW + 3, ids.dtype)])
    at = np.flatnonzero(ids)
    may = np.zeros(len(at), bool)
    for g, known in test.starts.items():
        h = _gram(padded, at, g)
        may |= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    at = at[may]
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    stop = np.flatnonzero(padded == 0)
    run = stop[np.searchsorted(stop, at)] - at  # words up to the next that no item has
    width = test.low.dtype.itemsize // 4
    suffix = np.where(np.arange(width) < run[:, None], padded[at[:, None] + np.arange(width)], 0)
    order = np.argsort(rows := _rows(suffix), kind="stable")
    array, at = rows[order], at[order]
    low = np.searchsorted(array, test.low, "left")
    many = np.searchsorted(array, test.high, "right") - low
    which = np.repeat(np.arange(len(many)), many)
    rank = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    return at[rank], which


def _shards(texts: list[str | None], vocab: dict[bytes, int], most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Documents in shards of about ``most`` characters: first and last document, ids with a zero after each document, and
    where each document's ids start."""
    get = vocab.get
    for a, b in slices([len(t) if t else 0 for t in texts], most):
        found = [words(t) for t in texts[a:b]]
        starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in found])]).astype(np.int64)
        ids = np.zeros(starts[-1], np.int64)
        for w, s in zip(found, starts, strict=False):
            ids[s : s + len(w)] = np.fromiter(map(get, w, repeat(0)), np.int64, len(w))
        yield a, b, ids, starts


def _turns(bench: DataFrame, item_id: str, text: str, block_bytes: int, at_once: int) -> tuple[int, Iterator[list[Broadcast]]]:
    """The benchmark in blocks of about ``block_bytes``, each indexed on the driver and broadcast: how many turns there are,
    and each turn's blocks, ``at_once`` at most. The blocks of a turn are gone when the next one begins. Equal items come
    once."""
    own = bench.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text"))
    total = own.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // block_bytes))

    def made() -> Iterator[list[Broadcast]]:
        for turn in range(0, n, at_once):
            held = []
            for k in range(turn, min(n, turn + at_once)):
                rows = (own.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else own).distinct().collect()
                held.append(bench.sparkSession.sparkContext.broadcast(([r["id"] for r in rows], index([r["text"] for r in rows]))))
            yield held
            for old in held if n > at_once else []:
                old.destroy()

    return -(-n // at_once), made()


def _each(blocks: list[Broadcast]) -> Iterator[tuple[list, Suffixes]]:
    """In a worker: the blocks of a turn, one in memory at a time where there are several."""
    for shared in blocks:
        yield shared.value
        if len(blocks) > 1:
            shared.__dict__.pop("_value", None)  # read again from the worker's file when its turn comes


def merged(flat: list[int]) -> list[int]:
    """Runs, each a start and an end, in order and joined where they meet."""
    out: list[int] = []
    for s, e in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _matched(texts: list[str | None], blocks: list[Broadcast], shard_chars: int) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """Of each text: words, runs of words in copies of windows, and the items those are of."""
    counts: list[int] = []
    spans, items = [[] for _ in texts], [[] for _ in texts]
    for names, test in _each(blocks):
        counts = []
        for a, _, ids, starts in _shards(texts, test.vocab, shard_chars):
            counts += (np.diff(starts) - 1).tolist()
            at, which = occurrences(ids, test) if len(test.width) else (np.empty(0, np.int64),) * 2
            if not len(at):
                continue
            edge = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + test.width[which], -1)
            inside = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8)])
            turn = np.flatnonzero(np.diff(np.concatenate([inside, [0]])))  # starts and ends of hit runs
            doc = np.searchsorted(starts, turn[::2], "right") - 1
            for d, s, e in zip(doc.tolist(), turn[::2].tolist(), turn[1::2].tolist(), strict=True):
                spans[a + d] += [s - int(starts[d]), e - int(starts[d])]
            pair = np.unique((np.searchsorted(starts, at, "right") - 1) * len(test.width) + which)
            for d, w in zip((pair // len(test.width)).tolist(), (pair % len(test.width)).tolist(), strict=True):
                items[a + d] += [names[i] for i in test.item[test.first[w] : test.first[w + 1]]]
    return counts, [merged(x) for x in spans], [sorted({i for i in x if i is not None}) for x in items]


_FOUND = "spans array<long>, items array<string>"


def _found_arrays(spans: list, items: list) -> list[pa.Array]:
    return [pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]


def hits(
    docs: DataFrame,
    bench: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    share: int = 20,
    block_bytes: int = 1 << 20,
    at_once: int = 8,
    shard_chars: int = 1 << 20,
) -> DataFrame:
    """Which words of each document lie in a verbatim copy of a benchmark window.

    A window is 13 consecutive words of an item, or all words of an item with fewer. Returns ``doc_id``, ``n_words``,
    ``n_hit``, ``n_items`` (items with a window in the document), ``items_sha256`` (of their ids, sorted as strings,
    comma-joined), ``contaminated`` (at least a hit, and at least one word in ``share``) and the columns named in ``keep``,
    a row for each input row. Null and empty texts have no words. Items without an id count for the hits but not as items;
    rows that repeat an item count once. Documents may repeat and their ids may be null, and of any type. Very long texts
    are matched whole, as shards of their own. An empty benchmark hits nothing; an empty table of documents gives no rows.

    The benchmark comes to the executors in blocks of about ``block_bytes``, whose index takes some thirty times as much,
    ``at_once`` of them for a pass over the documents, in which a worker holds one at a time. Where one pass is enough,
    nothing is shuffled. Where it is not, each pass writes what it found, a row for each document that it hit, and those
    rows meet the documents at the end.
    """
    keep = keep or []
    names = list(dict.fromkeys([doc_id, text, *keep]))
    own = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)))
    shape = ", ".join(f"c{i} {own.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(names)))
    n_turns, turns = _turns(bench, item_id, item_text, block_bytes, at_once)

    if n_turns == 1:
        blocks = next(turns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, spans, items = _matched(batch.column("c1").to_pylist(), blocks, shard_chars)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), *_found_arrays(spans, items)], names=[*batch.schema.names, "n_words", "spans", "items"])

        judged = own.mapInArrow(run, f"{shape}, n_words long, {_FOUND}")
    else:
        keyed, found = own.withColumn("rk", row_key("c0", "c1")), None
        for blocks in turns:

            def find(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    _, spans, items = _matched(batch.column("c1").to_pylist(), blocks, shard_chars)
                    hit = [i for i, x in enumerate(spans) if x]
                    keys = batch.select(["c0", "rk"]).take(pa.array(hit, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*keys.columns, *_found_arrays([spans[i] for i in hit], [items[i] for i in hit])], names=["did", "rk", "spans", "items"])

            part = keyed.select("c0", "c1", "rk").mapInArrow(find, f"did {own.schema['c0'].dataType.simpleString()}, rk long, {_FOUND}")
            part = materialize(part.dropDuplicates(["did", "rk"]), "found")
            found = part if found is None else found.unionByName(part)
        every = found.groupBy("did", found["rk"].alias("of")).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts = [len(words(t)) for t in batch.column("c1").to_pylist()]
                spans, items = ([x or [] for x in batch.column(c).to_pylist()] for c in ("spans", "items"))
                both = _found_arrays([merged(x) for x in spans], [sorted(x) for x in items])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(counts, pa.int64()), *both], names=[*batch.schema.names[:-2], "n_words", "spans", "items"])

        joined = keyed.join(every, F.col("c0").eqNullSafe(F.col("did")) & (F.col("rk") == F.col("of")), "left").select(*own.columns, "spans", "items")
        judged = joined.mapInArrow(finish, f"{shape}, n_words long, {_FOUND}")

    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda n, x: n + x)
    return judged.withColumn("n_hit", n_hit).select(
        F.col("c0").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        *(F.col(f"c{names.index(c)}").alias(f"__kn_kept_{i}") for i, c in enumerate(keep)),
    )


def remove_contaminated(docs: DataFrame, bench: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that ``hits`` calls contaminated; columns and types stay. The rules for nulls, ties
    and repeats are those of ``hits``."""
    judged = hits(docs, bench, text=text, keep=docs.columns, **options)
    return judged.filter(~F.col("contaminated")).select(*(F.col(f"__kn_kept_{i}").alias(c) for i, c in enumerate(docs.columns)))


def longest_matches(docs: DataFrame, bench: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 1 << 20, at_once: int = 8, shard_chars: int = 1 << 20) -> DataFrame:
    """The maximal verbatim matches of at least a window: ``doc_id``, ``item_id``, ``doc_word``, ``item_word`` (where the
    match starts in each, in words) and ``n_words``. Windows that follow each other in both texts are one match. Documents
    or items without words, empty tables and null texts have none. Items are whole within a block, and so are matches."""
    own, found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), None
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, item_id string, doc_word long, item_word long, n_words long"
    n_turns, turns = _turns(bench, item_id, item_text, block_bytes, at_once)
    for blocks in turns:

        def run(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, texts, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
                for names, test in _each(blocks):
                    for a, _, ids, starts in _shards(texts, test.vocab, shard_chars):
                        at, which = occurrences(ids, test) if len(test.width) else (np.empty(0, np.int64),) * 2
                        many = (test.first[1:] - test.first[:-1])[which]
                        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(test.first[:-1][which], many)
                        p, w = np.repeat(at, many), np.repeat(test.width[which], many)
                        item, q = test.item[k], test.place[k]
                        order = np.lexsort((p, p - q, item))
                        p, w, item, q = p[order], w[order], item[order], q[order]
                        new = np.ones(len(p), bool)
                        new[1:] = (item[1:] != item[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] != p[:-1] + 1)
                        first = np.flatnonzero(new)
                        last = np.concatenate([first[1:], [len(p)]]) - 1 if len(first) else first
                        doc = np.searchsorted(starts, p[first], "right") - 1
                        for f, z, d in zip(first.tolist(), last.tolist(), doc.tolist(), strict=True):
                            rows.append((keys[a + d], names[item[f]], int(p[f] - starts[d]), int(q[f]), int(p[z] + w[z] - p[f])))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.string()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        part = own.mapInArrow(run, schema)
        part = part if n_turns == 1 else materialize(part, "matches")
        found = part if found is None else found.unionByName(part)
    return found


def brute_force(texts: list[str | None], items: list[tuple[object, str | None]], window: int = WINDOW, share: int = 20) -> list[tuple]:
    """What ``hits`` returns, without the ids, by comparing every window with every place. For tests."""
    out = []
    for text in texts:
        ws, hit, ids = words(text), set(), set()
        for key, item in items:
            iw = words(item)
            n = min(len(iw), window)
            for i in range(len(iw) - n + 1 if n else 0):
                for p in range(len(ws) - n + 1):
                    if ws[p : p + n] == iw[i : i + n]:
                        hit |= set(range(p, p + n))
                        ids |= {str(key)} if key is not None else set()
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((len(ws), len(hit), len(ids), digest, bool(hit) and share * len(hit) >= len(ws)))
    return out
