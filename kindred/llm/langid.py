"""Operator 2, language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import slices

UNKNOWN = "und"
ORDERS = (1, 2, 3)
#: Characters that are looked at in one go.
PIECE = 1 << 18
#: Log probabilities that are looked up in one go.
LOOKUPS = 1 << 20
#: As many languages as a threshold table for a broadcast may have.
FEW_LANGS = 10_000


@cache
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    found = [c for c in range(0x110000) if chr(c).isalpha()]
    table[found] = found
    return table


def _hashed(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Buckets of the runs of ``n`` codes."""
    h = np.full(len(codes) - n + 1, n, np.uint32)
    for j in range(n):
        h = (h ^ codes[j : len(codes) - n + 1 + j]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)


def grams(texts: list[str], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hashed n-grams of the lower-cased texts, runs of other characters than letters as one space, in pieces of bounded
    size: number of the first text, number of each gram's text from there (in order), and its bucket. A long text comes in
    several pieces that carry the last codes of the piece before along, so it has the grams it would have in one."""
    for a, b in slices([len(t) for t in texts], PIECE):
        low = [t.lower() for t in texts[a:b]]
        carry = np.empty(0, np.uint32)
        for cut in range(0, max(map(len, low)) or 1, PIECE):
            part = low if b - a > 1 else [low[0][cut : cut + PIECE]]
            if b - a > 1 and cut:
                break
            codes = _letters()[np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)]
            doc = np.repeat(np.arange(len(part)), [len(t) for t in part])
            codes, doc = np.concatenate([carry, codes]), np.concatenate([np.zeros(len(carry), doc.dtype), doc])
            space = codes == 32
            use = ~space
            use[1:] |= ~space[:-1] | (doc[1:] != doc[:-1])
            use[:1] = True
            use[: len(carry)] = True
            codes, doc = codes[use], doc[use]
            for n in ORDERS:
                if len(codes) < n:
                    continue
                h = _hashed(codes, n, bits)
                same = doc[n - 1 :] == doc[: len(h)]
                same[: max(len(carry) - n + 1, 0)] = False  # those ended in the piece before
                if n == 1:  # a lone space says nothing
                    same &= codes != 32
                yield a, doc[: len(h)][same], h[same]
            carry = codes[max(len(codes) - max(ORDERS) + 1, 0) :]


class Model(NamedTuple):
    langs: list[str]
    prior: np.ndarray  # log probability of each language
    weight: np.ndarray  # (buckets, languages) log probability of a bucket in a language
    bits: int


def quotas(counts: list[int], most: int) -> list[float]:
    """The share of each count to take, so that ``most`` are taken in all and small ones are taken whole before large ones."""
    out, left = [0.0] * len(counts), float(most)
    for k, i in enumerate(sorted(range(len(counts)), key=counts.__getitem__)):
        take = min(counts[i], left / (len(counts) - k))
        out[i], left = take / counts[i], left - take
    return out


def train(docs: DataFrame, *, text: str, lang: str, bits: int = 16, alpha: float = 0.1, max_docs: int = 10_000) -> Model:
    """Learns from rows with a text and a language; equal texts of a language count once for the n-grams, every row counts
    for how frequent its language is.

    ``max_docs`` bounds the rows that are used: where there are more, each language has a share of them, small languages
    first, and a hash of the text picks about so many, the text with the least hash always. So a language of which there is
    a row is learned, and one of which nothing was learned is no answer. Empty tables give a model without languages."""
    spark = docs.sparkSession
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("at", F.pmod("h", F.lit(1 << 30)))
    seen = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.01).alias("kinds"), F.min("at").alias("least")).collect()
    seen = sorted(seen, key=lambda r: r["lang"])
    if not seen:
        return Model([], np.empty(0), np.empty((1 << bits, 0), np.float32), bits)
    shares = quotas([max(r["kinds"], 1) for r in seen], max_docs)
    # Shares are taken a little under 1 only where there are too many, so that all of a small language are taken.
    below = [(r["lang"], max(int((1 << 30) * s), r["least"] + 1) if s < 1 else 1 << 30) for r, s in zip(seen, shares, strict=True)]
    if sum(r["kinds"] for r in seen) > max_docs:
        limits = spark.createDataFrame(below, "lang string, below long")
        rows = rows.join(F.broadcast(limits) if len(below) <= FEW_LANGS else limits, "lang").filter(F.col("at") < F.col("below"))
    sample = rows.dropDuplicates(["lang", "h"]).select("text", "lang")
    langs = [r["lang"] for r in seen]
    number = {r: i for i, r in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate([k for k, _ in held] or [np.empty(0, np.int64)]), return_inverse=True)
            return key, np.bincount(at, np.concatenate([n for _, n in held] or [np.empty(0)]), len(key)).astype(np.int64)

        for batch in batches:
            which = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, doc, bucket in grams(batch.column(0).to_pylist(), bits):
                held.append(np.unique(which[a + doc] << bits | bucket, return_counts=True))
                if len(held) > 32:
                    held[:] = [summed()]
        key, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array([key.astype("<i8").tobytes()], pa.binary()), pa.array([n.astype("<i8").tobytes()], pa.binary())], names=["key", "n"])

    # The sample is bounded, so a few tasks count it, and the driver gets the counts that are not zero.
    counts = np.zeros(len(langs) << bits, np.float64)
    for r in sample.repartition(4).mapInArrow(run, "key binary, n binary").toLocalIterator():
        counts[np.frombuffer(r["key"], "<i8")] += np.frombuffer(r["n"], "<i8")
    counts = counts.reshape(len(langs), 1 << bits)
    known = np.flatnonzero(counts.any(1))
    if not len(known):
        return Model([], np.empty(0), np.empty((1 << bits, 0), np.float32), bits)
    counts, docs_of = counts[known], np.array([seen[i]["n"] for i in known], float)
    weight = np.log(counts + alpha) - np.log(counts.sum(1, keepdims=True) + alpha * (1 << bits))
    prior = np.log(docs_of + 1) - np.log((docs_of + 1).sum())
    return Model([langs[i] for i in known], prior, np.ascontiguousarray(weight.T.astype(np.float32)), bits)


def score(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability; ``und`` and zero for texts without a letter. The
    log probabilities of ``LOOKUPS`` n-grams and languages at most are held at a time, however many languages there are."""
    if not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total = np.zeros((len(texts), len(model.langs)))
    letters = np.zeros(len(texts), bool)
    step = max(1, LOOKUPS // len(model.langs))
    for a, doc, bucket in grams(texts, model.bits):
        for s in range(0, len(doc), step):
            d = doc[s : s + step]
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            total[a + d[first]] += np.add.reduceat(model.weight[bucket[s : s + step]], first, dtype=np.float64)
            letters[a + d[first]] = True
    total += model.prior
    best = total.argmax(1)
    sure = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    return [model.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters, strict=True)], np.where(letters, sure, 0.0)


def held_out(doc_id: str) -> Column:
    """Is the row kept out of the training? By the CRC-32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", bits: int = 16, max_docs: int = 10_000) -> DataFrame:
    """Predicts the language of every whole text with a model of the rows that are not held out.

    Returns ``doc_id``, ``held_out``, ``lang_pred`` (a learned language, or ``und`` for a null text or one without a letter)
    and ``score`` (posterior probability, zero for ``und``), a row for each input row. The prediction sees the text alone.
    Ids may be of any type, null or repeated; null texts are empty; rows with a null language are predicted but not learned
    from. Very long texts are read in pieces and have the n-grams of the whole. Ties go to the first language in order of
    their names; rows that repeat get the same answer; with nothing to learn from all are ``und``; an empty table gives no
    rows; other columns are ignored. The log-probability matrix, ``2**bits`` rows by the learned languages (``max_docs`` at
    most), is broadcast. No shuffle of documents but the bounded training sample.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(train(own.filter(~F.col("held_out")), text="text", lang="lang", bits=bits, max_docs=max_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, sure = score([t or "" for t in batch.column(2).to_pylist()], model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
