"""Operator 10, line dedup by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kindred.llm.common import drop_materialized, few_rows, materialize, row_key, slices, unused

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLOCKS = 4
#: Variants that are made in one go.
PIECE = 1 << 17
#: Sets of at most so many rows (of two numbers each) are broadcast for a semi-join; larger ones are joined by a shuffle.
SMALL = 500_000


def _semi(df: DataFrame, small: DataFrame, on: list[str] | Column, n: int) -> DataFrame:
    return df.join(F.broadcast(small) if n <= SMALL else small, on, "left_semi")


def _block_keys(line: Column, n: Column) -> Column:
    """A hash for each way in which another line may differ: for both lengths the shorter of the two may have, and each
    quarter of that length, what stands before the quarter and, counted from the end, after it."""
    keys = []
    for less in (0, 1):
        size = n - less
        for k in range(BLOCKS):
            before, after = F.floor(size * k / BLOCKS), F.floor(size * (k + 1) / BLOCKS)
            keys.append(F.xxhash64(F.lit(2 * k + 1), size, F.substring(line, F.lit(1), before.cast("int")), F.when(size > after, F.substring(line, -(size - after).cast("int"), (size - after).cast("int"))).otherwise("")))
    return F.array(*keys)


def _variants(line: str, matched: list[int], piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the line's deletion variants within the quarters that ``matched`` names (numbers of block keys), and each
    one's role: 0 for a pair of equal lengths, 1 for the longer and 2 for the shorter of a pair. About ``piece`` at a time,
    however long the line is."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)

    def prefixes() -> Iterator[tuple[int, np.ndarray]]:
        """The polynomial hashes of what stands before each character and after the last, by stretches that share an end."""
        so_far = np.uint64(0)
        for s in range(0, n, piece):
            part = c[s : s + piece].astype(np.uint64) + np.uint64(1)
            power = np.full(len(part), _BASE, np.uint64)
            power[0] = pow(int(_BASE), s, 1 << 64)
            sums = np.concatenate([[so_far], part * np.cumprod(power, dtype=np.uint64)])
            sums = np.cumsum(sums, dtype=np.uint64)
            yield s, sums
            so_far = sums[-1]

    def mixed(h: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
        h = (h ^ (np.asarray(salt, np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))).view(np.int64)

    total = np.uint64(0)
    for _, sums in prefixes():
        total = sums[-1]
    for start, sums in prefixes():
        hashes, roles = [], []
        for key in matched:
            less, k = divmod(key, BLOCKS)
            size = n - less
            i = np.arange(max(size * k // BLOCKS, start), min(size * (k + 1) // BLOCKS + less, start + len(sums) - 1))
            h = sums[i - start] + (total - sums[i - start + 1]) * _INVERSE
            hashes.append(mixed(h, 2 * i + 2 if not less else 1))
            roles.append(np.full(len(i), less, np.int8))
        yield np.concatenate(hashes), np.concatenate(roles)
    if any(key < BLOCKS for key in matched):
        yield mixed(np.array([total]), 1), np.full(1, 2, np.int8)


def an_edit_apart(x: str, y: str) -> bool:
    """Are the lines equal, or does one edit turn one into the other? After their common prefix and the edit, nothing may
    differ; the prefix is found by halving, so long lines take little more than their length."""
    x, y = sorted((x, y), key=len)
    if len(y) - len(x) > 1:
        return False
    low, high = 0, len(x)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x[low:mid] == y[low:mid] else (low, mid - 1)
    return x[low + (len(x) == len(y)) :] == y[low + 1 :]


def decide(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 1) -> tuple[DataFrame, DataFrame]:
    """The lines that stay and the near-duplicates that go: two tables of ``did``, ``rk`` (a hash of id and text) and
    ``no`` (number of the line). Of equal lines only the first is in either.

    A line is what stands between line feeds. A line goes if an earlier one, by id, then number, then ``rk``, equals it, or
    if both have ``min_chars`` characters and one edit (a character inserted, dropped or replaced) turns one into the other,
    whether or not the earlier one stays. Lines of white space only are in neither table and always stay. Null texts have
    no lines; null ids come after all others, and ids may be of any type that has an order. Rows that repeat both id and
    text are one document. Very long texts and lines are read whole, but their variants are made in pieces. Empty tables
    have no lines; other columns are ignored. ``min_chars`` is one, so lines of a character are an edit apart; raise it to
    leave short lines, such as list marks, to equality.

    Equal lines meet in an aggregation. Two different lines within an edit agree on all but a quarter: each line emits
    hashes of what stands around each quarter, and only lines whose hash comes up again emit the hashes of their deletion
    variants in that quarter. Variants meet by hash, the earliest line of each is found, and the edit distance of every
    such pair is verified. No pairs are made but one for each line and variant that matched.
    """
    own = docs.select(F.col(doc_id).alias("did"), row_key(doc_id, text).alias("rk"), F.col(text).alias("text"))
    lines = own.select("did", "rk", F.posexplode(F.split("text", "\n")).alias("no", "line")).filter(F.col("line").rlike(r"\S"))
    n = F.char_length("line")
    place = F.struct(F.col("did").isNull().alias("none"), "did", "no", "rk")
    keys = F.when(n >= min_chars, _block_keys(F.col("line"), n))
    hashed = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), F.struct(place.alias("place"), keys.alias("keys")).alias("f"))
    firsts = materialize(hashed.groupBy("h1", "h2").agg(F.min("f").alias("f")).select(F.col("f.place").alias("place"), F.col("f.keys").alias("keys")), "firsts")

    exploded = firsts.filter("keys is not null").select("place", F.posexplode("keys").alias("which", "key"))
    again = materialize(exploded.groupBy("key").count().filter("count > 1").select("key"), "again")
    matched = _semi(exploded, again, ["key"], again.count()).groupBy("place").agg(F.collect_list("which").alias("which"))
    matched = materialize(matched.select("place.did", "place.rk", "place.no", "which"), "matched")
    rows = materialize(matched.select("did", "rk").distinct(), "rows")
    same = own["did"].eqNullSafe(rows["did"]) & (own["rk"] == rows["rk"])
    texts = _semi(own, rows, same, rows.count())
    asked = matched.groupBy("did", "rk").agg(F.collect_list(F.struct("no", "which")).alias("asked"))
    found = texts.alias("t").join(asked.alias("a"), F.col("t.did").eqNullSafe(F.col("a.did")) & (F.col("t.rk") == F.col("a.rk"))).select("t.did", "t.rk", "t.text", "a.asked")

    kind, arrow = own.schema["did"].dataType.simpleString(), to_arrow_type(own.schema["did"].dataType)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for did, rk, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = text.split("\n")
                for x in asked:
                    for column, v in zip(out, (did, rk, x["no"], parts[x["no"]], x["which"]), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (arrow, pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32())), strict=True)], names=["did", "rk", "no", "line", "which"])

    survivors = materialize(found.mapInArrow(pick, f"did {kind}, rk long, no int, line string, which array<int>").dropDuplicates(["did", "rk", "no"]), "survivors")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, which = batch.column("line").to_pylist(), batch.column("which").to_pylist()
            for a, b in slices([len(t) * (1 + len(w) // BLOCKS) for t, w in zip(lines, which, strict=True)], PIECE):
                found = [(i, *x) for i in range(a, b) for x in _variants(lines[i], which[i])] if b - a > 1 else ((a, *x) for x in _variants(lines[a], which[a]))
                for part in [found] if b - a > 1 else ([x] for x in found):
                    rows = pa.array(np.repeat([i for i, _, _ in part], [len(h) for _, h, _ in part]), pa.int64())
                    ids = batch.select(["did", "rk", "no"]).take(rows)
                    yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(np.concatenate([h for _, h, _ in part])), pa.array(np.concatenate([r for _, _, r in part]))], names=["did", "rk", "no", "v", "role"])

    variants = survivors.mapInArrow(emit, f"did {kind}, rk long, no int, v long, role byte")
    shared = materialize(variants.groupBy("v").count().filter("count > 1").select("v"), "shared")
    place = F.struct(F.col("did").isNull().alias("none"), "did", "no", "rk")
    members = materialize(_semi(variants, shared, ["v"], shared.count()).select("v", "role", place.alias("place")), "members")
    # The earliest of each role; a longer line's partner is the shorter one, and the other way round.
    least = materialize(members.groupBy("v", F.when(F.col("role") == 0, 0).when(F.col("role") == 1, 2).otherwise(1).alias("of")).agg(F.min("place").alias("partner")), "least")
    pairs = members.join(least, (members["v"] == least["v"]) & (members["role"] == least["of"])).filter("partner < place").select("place", "partner").distinct()
    lines_of = survivors.select(place.alias("p"), "line")
    checked = pairs.join(lines_of.select(F.col("p").alias("place"), F.col("line").alias("x")), "place").join(lines_of.select(F.col("p").alias("partner"), F.col("line").alias("y")), "partner")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            same = [an_edit_apart(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["place"]).filter(pa.array(same, pa.bool_()))

    checked = checked.select("place", "x", "y")
    near = materialize(checked.mapInArrow(verified, checked.select("place").schema).distinct(), "near")
    for old in (again, matched, rows, shared, members, least, survivors):
        drop_materialized(old)
    parts = ["place.did", "place.rk", "place.no"]
    return firsts.join(near, "place", "left_anti").select(*parts), near.select(*parts)


def dedup_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 1) -> DataFrame:
    """What line dedup does to every document: ``doc_id``, ``n_lines``, ``n_equal`` (lines that equal an earlier one),
    ``n_near`` (that are an edit away from one), ``kept_lines`` (numbers of the lines that stay, blank ones not counted), a
    row for each input row. See ``decide`` for the rules. Null texts have no lines. Other columns are ignored."""
    kept, near = decide(docs, doc_id=doc_id, text=text, min_chars=min_chars)
    both = kept.withColumn("near", F.lit(False)).unionAll(near.withColumn("near", F.lit(True)))
    lists = both.groupBy("did", "rk").agg(F.array_sort(F.collect_list(F.when(~F.col("near"), F.col("no")))).alias("kept_lines"), F.count_if("near").alias("n_near"))
    parts = F.split(F.col(text), "\n")
    own = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), F.when(F.col(text).isNotNull(), F.size(parts)).otherwise(0).cast("long").alias("n_lines"), F.when(F.col(text).isNotNull(), F.size(F.filter(parts, lambda x: x.rlike(r"\S")))).otherwise(0).alias("full"))
    joined = own.join(lists, (own["key"] == lists["rk"]) & own["doc_id"].eqNullSafe(lists["did"]), "left")
    n_near = F.coalesce("n_near", F.lit(0).cast("long"))
    none = F.array().cast("array<int>")
    return joined.select("doc_id", "n_lines", (F.col("full") - F.coalesce(F.size("kept_lines"), F.lit(0)) - n_near).cast("long").alias("n_equal"), n_near.alias("n_near"), F.coalesce("kept_lines", none).alias("kept_lines"))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", min_chars: int = 1) -> DataFrame:
    """``docs`` with the texts that line dedup leaves, and ``n_chars``, if there is such a column, set to their lengths. A
    row for each input row, with its columns and types; a text of which no line stays is empty, a null one stays null. See
    ``decide`` for the rules."""
    key, stay = unused(docs.columns, "rk", "kept")
    kept, near = decide(docs, doc_id=doc_id, text=text, min_chars=min_chars)
    lists = kept.groupBy("did", "rk").agg(F.collect_list("no").alias(stay))
    keyed = docs.withColumn(key, row_key(doc_id, text))
    joined = keyed.join(lists, (keyed[key] == lists["rk"]) & keyed[doc_id].eqNullSafe(lists["did"]), "left").select(*(keyed[c] for c in docs.columns), lists[stay])
    at = docs.columns.index(text)
    size_at = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            out: list[str | None] = []
            for t, kept in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if t is not None:
                    stay = set(kept or ())
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i in stay or not _full(x))
                out.append(t)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(out, pa.string())
            if size_at is not None:
                columns[size_at] = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(rebuild, docs.schema)


_BLANK = " \t\n\x0b\f\r"


def _full(line: str) -> bool:
    """Does the line have anything but white space of ASCII, as ``\\S`` has it in Java?"""
    return bool(line.strip(_BLANK))


def brute_force(rows: list[tuple[int, str | None]], min_chars: int = 1) -> list[list[int]]:
    """The numbers of the lines that stay, for each row of different ids, by comparing all lines. For tests."""

    def near(x: str, y: str) -> bool:
        if x == y:
            return True
        if min(len(x), len(y)) < min_chars or abs(len(x) - len(y)) > 1:
            return False
        x, y = sorted((x, y), key=len)
        i = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), len(x))
        return x[i + (len(x) == len(y)) :] == y[i + 1 :]

    seen: list[str] = []
    stay: dict[int, list[int]] = {}
    for key, text in sorted(rows):
        stay[key] = []
        for i, line in enumerate(text.split("\n") if text is not None else []):
            if _full(line):
                if not any(near(line, s) for s in seen):
                    stay[key].append(i)
                seen.append(line)
    return [stay[key] for key, _ in rows]
