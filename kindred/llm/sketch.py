"""Operator 8, document fingerprints by threshold-scaled sketches. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import drop_materialized, materialize, unused

_LEAST = -(1 << 63)


def word_hashes(text: Column) -> Column:
    """XXH64 of each word; words are what stands between the six white-space characters of ASCII."""
    return F.transform(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: str, k: int) -> Column:
    """Hashes of the runs of ``k`` words in a column of word hashes; one hash of all words where there are fewer."""
    w = F.col(words)
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
    return F.when(F.size(w) >= k, runs).otherwise(F.array(F.xxhash64(w)))


def sketch(hashes: str, scale: int) -> Column:
    """The different hashes among the lowest ``1 / scale`` of all 64-bit values, in order. A document with none, as one of a
    few words may be, keeps its smallest hash, so that no sketch is empty; that hash is in no larger document's sketch."""
    h = F.col(hashes)
    low = F.filter(h, lambda x: x < F.lit(_LEAST + (1 << 64) // scale))
    return F.array_sort(F.array_distinct(F.when(F.size(low) > 0, low).otherwise(F.array(F.array_min(h)))))


def with_sketch(df: DataFrame, text: str, out: str, *, k: int = 5, scale: int = 4) -> DataFrame:
    """``df`` with a column ``out``, the sketch of ``text`` (null: empty) over its ``k``-word shingles."""
    w, h = unused(df.columns, "words", "runs")
    stepped = df.withColumn(w, word_hashes(F.coalesce(F.col(text), F.lit("")))).withColumn(h, shingle_hashes(w, k))
    return stepped.withColumn(out, sketch(h, scale)).drop(w, h)


def encode(sketched: Column) -> Column:
    """A sketch as a string, 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(sketched, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def merge(a: Column, b: Column, scale: int = 4) -> Column:
    """The sketch of two documents together. A smallest hash above the threshold goes once there are others below it."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda x: x < F.lit(_LEAST + (1 << 64) // scale))
    return F.array_sort(F.when(F.size(low) > 0, low).otherwise(F.array(F.array_min(both))))


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller sketch that the other holds: an estimate of how much of the shorter document is in the
    longer, however unequal they are. Between 0 and 1; 1 for equal sketches."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared hashes among all of two sketches: an estimate of the documents' resemblance."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _following(kinds: DataFrame, per_part: int) -> DataFrame:
    """``kinds`` (keys ``k1`` and ``k2``, and ``id``) with the keys ``x1`` and ``x2`` of the next by descending id, nulls
    last, then by key; after the last comes the first.

    Keys are dealt over ranges of about ``per_part`` rows by id and key, so ties do not gather, and a window orders each
    range. The first of each range follows the last of the range before it: one row for each range, in a window of their
    own."""
    order = [F.col("id").desc_nulls_last(), F.col("k1"), F.col("k2")]
    ranged = kinds.repartitionByRange(max(1, -(-kinds.count() // per_part)), *order).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    inside = Window.partitionBy("part").orderBy(*order)
    key = F.struct("k1", "k2")
    led = materialize(ranged.withColumns({"next": F.lead(key).over(inside), "first": F.lag("k1").over(inside).isNull()}), "led")
    heads, over = led.filter("first").select("part", key.alias("head")), Window.orderBy("part")  # a row for each range
    wrapped = F.coalesce(F.lead("head").over(over), F.first("head").over(over))
    after = heads.select("part", wrapped.alias("after"))
    out = led.join(after, "part").withColumn("next", F.coalesce("next", "after"))
    out = materialize(out.select(*kinds.columns, F.col("next.k1").alias("x1"), F.col("next.k2").alias("x2")), "following")
    for old in (ranged, led):
        drop_materialized(old)
    return out


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, scale: int = 4, per_part: int = 200_000, copies: int = 1024) -> DataFrame:
    """Fingerprints of every whole text and of its edited text: the last half of its characters (rounded down) replaced by
    the first as many, or all, of the next document by descending id; after the last comes the first.

    Returns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` (the sketches, 16 digits a
    hash), ``near_edited`` and ``near_next`` (containment of the fingerprint and that of the edited text and of the next
    document), a row for each input row. A null text is empty; texts without words have one sketch in common. Ids are of any
    type that has an order; null ids come last; rows with one id go in the order of a hash of their texts, and of rows equal
    in both each is followed by another, the last by the next document; a lone row is its own next. Very long texts are read
    whole, in one expression. An empty table gives no rows. Other columns are ignored. Sketches merge (``merge``).

    The order is found on keys alone (``_following``). Then texts, each once however many rows hold it, meet the keys that
    they follow, and what an edit needs of them meets the texts before: whole texts are shuffled once, the part that is
    put in place of a half once more. Rows that repeat are worked out in lots of ``copies``.
    """
    raw = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    own = raw.withColumns({"k1": F.xxhash64("t", "id", F.col("id").isNull()), "k2": F.xxhash64(F.lit(7), F.col("id").isNull(), "id", "t")})
    kinds = materialize(own.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.count("*").alias("n"), F.max(F.char_length("t")).alias("size")), "kinds")
    follow = _following(kinds, per_part)
    drop_materialized(kinds)
    # The last of equal rows is followed by the next document, the others by one of their own.
    lots = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 2) / copies)), lambda i: F.struct(F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.least(F.lit(copies).cast("long"), F.col("n") - 1 - i * copies).alias("times")))
    last = F.array(F.struct("x1", "x2", F.lit(1).cast("long").alias("times")))
    follow = follow.select("k1", "k2", "id", "size", F.inline(F.when(F.col("n") > 1, F.concat(last, lots)).otherwise(last)))

    texts = own.groupBy("k1", "k2").agg(F.first("t").alias("t"))
    ahead = follow.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), "id", "size", "times", F.col("x1").alias("k1"), F.col("x2").alias("k2"))
    nexts = with_sketch(texts.join(ahead, ["k1", "k2"]), "t", "next_s", k=k, scale=scale)
    nexts = nexts.select(F.col("o1").alias("k1"), F.col("o2").alias("k2"), "id", "size", "times", F.expr("left(t, size div 2)").alias("head"), "next_s")
    pairs = with_sketch(texts.join(nexts, ["k1", "k2"]), "t", "s", k=k, scale=scale)
    edited = F.expr("concat(left(t, size - size div 2), head)")
    done = with_sketch(pairs.select("id", F.col("size").cast("long").alias("n_chars"), edited.alias("e"), "s", "next_s", "times"), "e", "es", k=k, scale=scale)
    done = done.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("e", 256).alias("edited_sha256"), encode(F.col("s")).alias("fingerprint"), encode(F.col("es")).alias("edited_fingerprint"), containment(F.col("s"), F.col("es")).alias("near_edited"), containment(F.col("s"), F.col("next_s")).alias("near_next"), "times")
    return done.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times", "col")
