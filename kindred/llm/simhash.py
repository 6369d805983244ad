"""Operator 5, SimHash near-duplicates by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from kindred.llm.common import drop_materialized, materialize, row_key, slices, unused
from kindred.llm.components import connected_components

#: spread[b]: the bits of byte b, each in a byte of its own, so that up to 255 of them add up without a carry.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_LANES = np.array([0, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def shingle_hashes(text: str | None, k: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``k`` words, repeats included; of the whole sequence if it has fewer; none without
    words. A-Z are lower-cased; words are what stands between the six white-space characters of ASCII."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) <= k:
        return [xxh64_intdigest(b" ".join(words), 42)] if words else []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
    return list(map(xxh64_intdigest, [line[s:e] for s, e in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)], repeat(42)))


def fingerprints(texts: list[str | None], k: int, words: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``64 * words`` bits, as rows of uint64, and the number of different shingles of each text. A bit is 1
    if it is set in over half the hashes; further words take bits of the hashes mixed anew."""
    out, sizes = np.zeros((len(texts), words), np.uint64), np.zeros(len(texts), np.int64)
    for a, b in slices([len(t) if t else 0 for t in texts], 1 << 19):
        out[a:b], sizes[a:b] = _prints([shingle_hashes(t, k) for t in texts[a:b]], words)
    return out, sizes


def set_fingerprints(texts: list[str | None], k: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``fingerprints``, but each different shingle counts once, as in the Jaccard similarity; and a hash of each set."""
    out, sizes, keys = np.zeros((len(texts), words), np.uint64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.uint64)
    for a, b in slices([len(t) if t else 0 for t in texts], 1 << 19):
        lists = [sorted(set(shingle_hashes(t, k))) for t in texts[a:b]]
        out[a:b], sizes[a:b] = _prints(lists, words)
        keys[a:b] = [xxh64_intdigest(np.array(x, np.uint64).tobytes(), 42) for x in lists]
    return out, sizes, keys


def _prints(lists: list[list[int]], words: int) -> tuple[np.ndarray, np.ndarray]:
    out, sizes = np.zeros((len(lists), words), np.uint64), np.zeros(len(lists), np.int64)
    if any(lists):
        n = np.array([len(x) for x in lists], np.int64)
        sizes[:] = [len(set(x)) for x in lists]
        h = np.fromiter((x for l in lists for x in l), np.uint64, n.sum())
        # Segments of at most 255 hashes within a text.
        parts = -(-n // 255)
        text = np.repeat(np.arange(len(n)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = (np.cumsum(n) - n)[text] + 255 * nth
        first = np.cumsum(parts) - parts
        some = n > 0
        for w in range(words):
            mixed = h if not w else (h ^ (h >> np.uint64(31))) * _LANES[w]
            mixed = mixed if not w else mixed ^ (mixed >> np.uint64(29))
            byte = mixed.view(np.uint8).reshape(-1, 8)
            bits = np.empty((int(some.sum()), 64), np.int64)
            for i in range(8):
                lanes = np.add.reduceat(_SPREAD[byte[:, i]], starts).view(np.uint8).reshape(-1, 8)
                bits[:, 8 * i : 8 * i + 8] = np.add.reduceat(lanes, first[some], axis=0, dtype=np.int64)
            one = (2 * bits > n[some][:, None]).astype(np.uint8)
            out[some, w] = np.packbits(one, axis=1, bitorder="little").view(np.uint64).ravel()
    return out, sizes


def forest(prints: np.ndarray, boxes: np.ndarray, home: int, radius: int, first_radius: int, gap: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the first ``home`` rows and between them and the others: child, root.

    Two rows link if their fingerprints differ in ``radius`` bits at most and their ``boxes`` (population counts, or sizes)
    by ``gap`` at most, summed over the columns. Rows are sorted by box and compared in square tiles, unless the tiles'
    boxes are further apart than ``gap`` or all their rows are joined already.
    """
    n = len(prints)
    order = np.concatenate([np.lexsort(boxes[:home].T[::-1]), home + np.lexsort(boxes[home:].T[::-1])])
    prints, boxes = prints[order], boxes[order]
    label = np.arange(n)
    edges = [*range(0, home, block), *range(home, n, block), n]
    tiles = [(s, e) for s, e in zip(edges[:-1], edges[1:], strict=True) if e > s]
    low = np.array([boxes[s:e].min(0) for s, e in tiles])
    high = np.array([boxes[s:e].max(0) for s, e in tiles])
    n_home = -(-home // block)
    for i in range(n_home):
        s, e = tiles[i]
        apart = np.maximum(np.maximum(low[i] - high[i:], low[i:] - high[i]), 0).sum(1)
        for j in (np.flatnonzero(apart <= gap) + i).tolist():
            p, q = tiles[j]
            one = label[s]
            if (label[s:e] == one).all() and (label[p:q] == one).all():
                continue
            near = np.bitwise_count(prints[s:e, 0][:, None] ^ prints[None, p:q, 0]) <= first_radius
            x, y = np.nonzero(near)
            x, y = x + s, y + p
            if i == j:
                x, y = x[keep := x < y], y[keep]
            differ = label[x] != label[y]
            x, y = x[differ], y[differ]
            if not len(x):
                continue
            ok = np.abs(boxes[x] - boxes[y]).sum(1) <= gap
            if prints.shape[1] > 1:
                ok &= np.bitwise_count(prints[x] ^ prints[y]).sum(1, dtype=np.int64) <= radius
            label = _union(label, label[x[ok]], label[y[ok]])
    moved = np.flatnonzero(label != np.arange(n))
    return order[moved], order[label[moved]]


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` after joining the sets with roots a[i] and b[i]. Each label is the number of a set's root row."""
    if not len(a):
        return label
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while (u := up.get(v, v)) != v:
            up[v] = up.get(u, u)
            v = u
        return v

    for x, y in pairs.tolist():
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    to = np.arange(len(label))
    for v in list(up):
        to[v] = root(v)
    return to[label]


def tiled_links(rows: DataFrame, words: int, boxes: Callable[[np.ndarray, np.ndarray], np.ndarray], cell: Callable[[np.ndarray], np.ndarray], later: Callable[[int], list[int]], *, radius: int, first_radius: int, gap: int, tile: int = 65_536) -> DataFrame:
    """Forest edges ``a``, ``b`` (keys of rows) of the links among different fingerprints.

    ``rows`` has ``key``, ``w0`` ... and ``size``. ``boxes`` gives a row's box, ``cell`` the number of its cell from its
    box, and ``later`` the cells after a cell, itself not included, whose boxes may be within ``gap``. The rows of a cell,
    in tiles of about ``tile`` rows, meet those of the cells after it in groups of about five tiles at most. The driver gets
    the rows per cell, a table that does not grow with the input.
    """
    names = [f"w{i}" for i in range(words)]

    def boxed(frame: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        prints = np.stack([np.asarray(frame.column(c)).view(np.uint64) for c in names], 1)
        return prints, boxes(prints, np.asarray(frame.column("size")))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, n = np.unique(cell(boxed(batch)[1]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["cell", "n"])

    counts = {r["cell"]: r["n"] for r in rows.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    split = {c: -(-n // tile) for c, n in counts.items()}
    after = {c: [x for x in later(c) if x in counts] for c in counts}
    chunks = {c: max(1, -(-(sum(counts[x] for x in after[c]) + (counts[c] if split[c] > 1 else 0)) // (4 * tile))) for c in counts}
    number = {c: i for i, c in enumerate(sorted(counts))}
    before: dict[int, list[int]] = {c: [] for c in counts}
    for c, xs in after.items():
        for x in xs:
            before[x].append(c)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            prints, box = boxed(batch)
            own, h = cell(box), (prints[:, 0] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            groups, sides, at = [], [], []

            def put(which: np.ndarray, c: int, t: int | np.ndarray, f: int | np.ndarray, side: int) -> None:
                groups.append(np.broadcast_to((number[c] << 44) + (np.asarray(t) << 22) + np.asarray(f), len(which)))
                sides.append(np.full(len(which), side, np.int8))
                at.append(which)

            for c in np.unique(own).tolist():
                i = np.flatnonzero(own == c)
                t = h[i] % split[c]
                for f in range(chunks[c]):
                    put(i, c, t, f, 0)
                for home_tile in range(split[c] - 1):
                    rest = i[t > home_tile]
                    put(rest, c, home_tile, (h[rest] >> 8) % chunks[c], 1)
                for x in before[c]:
                    for home_tile in range(split[x]):
                        put(i, x, home_tile, (h[i] >> 8) % chunks[x], 1)
            pick = np.concatenate(at)
            data = batch.select(["key", *names, "size"]).take(pa.array(pick))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(groups)), pa.array(np.concatenate(sides)), *data.columns], names=["grp", "side", *data.schema.names])

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "key"], ignore_index=True)
        prints = np.stack([frame[c].to_numpy().view(np.uint64) for c in names], 1)
        child, root = forest(prints, boxes(prints, frame["size"].to_numpy()), int((frame["side"] == 0).sum()), radius, first_radius, gap)
        key = frame["key"].to_numpy()
        return pd.DataFrame({"a": key[child], "b": key[root]})

    shape = "".join(f", {c} long" for c in ["key", *names, "size"])
    return rows.select("key", *names, "size").mapInArrow(deal, f"grp long, side byte{shape}").groupBy("grp").applyInPandas(compare, "a long, b long")


def _population(prints: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Population counts of the four quarters of a 64-bit fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(prints[:, 0]).view(np.uint16).reshape(-1, 4)).astype(np.int64)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, a row for each input row.

    The fingerprint is the 64-bit SimHash of the text's ``k``-word shingles; zero for a null or empty text or one without
    words. Fingerprints at ``radius`` bits or fewer link, and ``component_id`` is the smallest id that links reach, a row's
    own included. Equal fingerprints are one, however many rows share them; rows without an id link too but give no
    component its name, so it is null where no row has an id. Ids may be of any type that has an order; rows may repeat;
    very long texts are read whole; an empty table gives no rows; other columns are ignored.

    Different fingerprints are compared exactly, in tiles. A fingerprint's cell is the pair of population counts of its
    halves; cells whose counts differ by more than the radius are never brought together, nor are tiles within a group.
    Each group emits a spanning forest of its links, not the pairs, and components are found on those.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, _ = fingerprints(batch.column(1).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0].view(np.int64))], names=["doc_id", "w0"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(own.mapInArrow(sketch, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, w0 long"), "prints")
    kinds = materialize(rows.groupBy("w0").agg(F.min("doc_id").alias("least")), "kinds")

    def halves(box: np.ndarray) -> np.ndarray:
        return (box[:, 0] + box[:, 1]) * 33 + box[:, 2] + box[:, 3]

    def later(c: int) -> list[int]:
        x, y = divmod(c, 33)
        return [p * 33 + q for p in range(x, min(32, x + radius) + 1) for q in range(max(0, y - radius), min(32, y + radius) + 1) if p * 33 + q > c and p - x + abs(q - y) <= radius]

    different = kinds.select(F.col("w0").alias("key"), "w0", F.lit(0).cast("long").alias("size"))
    links = tiled_links(different, 1, _population, halves, later, radius=radius, first_radius=radius, gap=radius)
    roots = connected_components(links, "a", "b")
    named = kinds.join(roots, kinds["w0"] == roots["node"], "left").select("w0", "least", F.coalesce("root", "w0").alias("root"))
    names = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    answer = materialize(materialize(named, "named").join(names, "root").select("w0", "component_id"), "answer")
    return rows.join(answer, "w0").select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def exact_links(sets: list[np.ndarray], home: int, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, child and root, of the pairs of ``sets`` (arrays of different values) with a Jaccard similarity of
    ``similarity`` or more: those of the first ``home`` sets with the others, or among all if there are no others.

    Only pairs that verified pairs have joined already are left out. A set meets one member of each joined group first,
    then all sets that are still apart from it."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    marked, label = np.zeros(len(values), bool), np.arange(n)
    top, bottom = similarity.numerator, similarity.denominator
    for i in np.flatnonzero(sizes[:home]).tolist():
        j = np.arange(i + 1 if home == n else home, n)
        j = j[(label[j] != label[i]) & (bottom * np.minimum(sizes[i], sizes[j]) >= top * np.maximum(sizes[i], sizes[j]))]
        if not len(j):
            continue
        own = ids[starts[i] : starts[i] + sizes[i]]
        marked[own] = True
        for some in (j[np.unique(label[j], return_index=True)[1]], j):
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            ends = np.cumsum(sizes[some])
            at = np.repeat(starts[some] - ends + sizes[some], sizes[some]) + np.arange(ends[-1])
            shared = np.add.reduceat(marked[ids[at]], ends - sizes[some], dtype=np.int64)
            hit = some[bottom * shared >= top * (sizes[i] + sizes[some] - shared)]
            label = _union(label, np.full(len(hit), label[i]), label[hit])
        marked[own] = False
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def verified_links(suspects: DataFrame, k: int, similarity: Fraction, mass: int = 1 << 21) -> DataFrame:
    """Forest edges ``a``, ``b`` (keys) of the pairs within each ``root`` whose shingle sets have a Jaccard ``similarity`` or
    more. ``suspects`` has ``key``, ``root``, ``size`` (different shingles) and ``text``, a row for each key.

    Groups are bundled to about ``mass`` shingles a task. A group of more is split into tiles of about as many, and each
    two tiles meet in a task of their own, so that no task grows with a group."""
    total = suspects.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tiles = F.ceil(F.col("mass") / mass).cast("long")
    weighed = suspects.groupBy("root").agg(F.sum("size").alias("mass"))
    own = F.when(F.col("tiles") > 1, F.pmod(F.xxhash64("key", F.lit(1)), "tiles")).otherwise(F.pmod(F.xxhash64("root"), F.lit(max(1, -(-total // mass)))))
    met = F.when(F.col("tiles") > 1, F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).otherwise(F.array("tile"))
    dealt = suspects.join(weighed.select("root", tiles.alias("tiles")), "root").withColumn("tile", own).withColumn("met", F.explode(met))
    dealt = dealt.select("key", "root", "text", "tile", F.when(F.col("tiles") > 1, F.col("root")).alias("only"), F.least("tile", "met").alias("low"), F.greatest("tile", "met").alias("high"))

    def verify(where: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, part in frame.sort_values(["root", "tile", "key"]).groupby("root", sort=False):
            key, home = part["key"].to_numpy(), int((part["tile"] == where[1]).sum())
            child, root = exact_links([np.unique(np.array(shingle_hashes(t, k), np.uint64)) for t in part["text"]], home, similarity)
            a.append(key[child])
            b.append(key[root])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return dealt.groupBy("only", "low", "high").applyInPandas(verify, "a long, b long")


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8, bits: int = 256) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the smallest id (ties: by a hash of the text);
    columns and types stay. Null and empty texts, and those without words, are alike, so one of them stays; a null id comes
    after all others; ids may be of any type that has an order. Of rows that repeat, one stays. Very long texts are read
    whole. An empty table gives no rows.

    Rows are near-duplicates if the sets of their ``k``-word shingles have a Jaccard ``similarity`` or more, or if a chain
    of such pairs joins them. Fingerprints of ``bits`` bits over these sets find the rows that may have a partner: the share
    of bits that differ tells the angle between two, and the radius is that of the ``similarity`` plus six times the spread
    of the estimate; the first word alone may be 4.5 times its own spread beyond, so of pairs of just that similarity about
    three in a million are not compared. The larger set has at most ``1 / similarity`` as many shingles, and sizes take the place of population
    counts when tiles are skipped, as counts of fingerprints this far apart say nothing. Within each group that such links
    join, the sets themselves are then compared (``verified_links``), and only those pairs count.
    """
    words = bits // 64
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    radius = int(np.ceil(bits * share + 6 * np.sqrt(bits * share * (1 - share))))
    first = int(np.ceil(64 * share + 4.5 * np.sqrt(64 * share * (1 - share))))
    names = [f"w{i}" for i in range(words)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, sets = set_fingerprints(batch.column(2).to_pylist(), k, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets.view(np.int64)), *(pa.array(found[:, i].copy().view(np.int64)) for i in range(words)), pa.array(sizes)], names=["did", "rk", "key", *names, "size"])

    key, did, mine, nth = unused(docs.columns, "rk", "did", "own", "nth")
    keyed = docs.withColumn(key, row_key(doc_id, text))
    own = keyed.select(F.col(doc_id).alias("did"), F.col(key).alias("rk"), F.col(text).alias("text"))
    rows = materialize(own.mapInArrow(sketch, f"did {own.schema['did'].dataType.simpleString()}, rk long, key long{''.join(f', {c} long' for c in names)}, size long"), "prints")
    firsts = F.min(F.struct(F.col("did").isNull().alias("none"), "did", "rk")).alias("least")
    kinds = materialize(rows.groupBy("key", *names, "size").agg(firsts), "kinds")
    gap = int(np.ceil(1000 * np.log(1 / similarity))) + 1  # the floors of sizes in the allowed ratio are this far apart at most

    def scaled(prints: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(size, 1)) * 1000).astype(np.int64)[:, None]

    links = tiled_links(kinds, words, scaled, lambda box: box[:, 0] // gap, lambda c: [c + 1], radius=radius, first_radius=first, gap=gap)
    maybe = connected_components(links, "a", "b")
    groups = maybe.select(F.col("node").alias("key"), "root").unionAll(maybe.select(F.col("root").alias("key"), "root").distinct())
    asked = kinds.join(groups, "key").select("key", "root", "size", F.col("least.did").alias("of_did"), F.col("least.rk").alias("of_rk"))
    texts = own.join(asked, F.col("did").eqNullSafe(F.col("of_did")) & (F.col("rk") == F.col("of_rk")))
    suspects = materialize(texts.groupBy("key", "root", "size").agg(F.first("text").alias("text")), "suspects")
    roots = connected_components(verified_links(suspects, k, Fraction(str(similarity))), "a", "b")
    drop_materialized(suspects)
    named = kinds.join(roots, kinds["key"] == roots["node"], "left").select("least", F.coalesce("root", "key").alias("root"))
    kept = materialize(named.groupBy("root").agg(F.min("least").alias("least")).select("least.did", "least.rk"), "kept")
    drop_materialized(rows)
    kept = kept.select(F.col("did").alias(did), F.col("rk").alias(mine))
    same = F.col(doc_id).eqNullSafe(F.col(did)) & (F.col(key) == F.col(mine))
    first = F.row_number().over(Window.partitionBy(key, did).orderBy(F.lit(1)))
    return keyed.join(kept, same).withColumn(nth, first).filter(F.col(nth) == 1).select(*docs.columns)
