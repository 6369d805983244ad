"""Operator 4, a quality classifier with hierarchical empirical-Bayes site priors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import materialize, slices, unused

#: Length of the character n-grams, and bits of their hash.
ORDER, BITS = 5, 20
#: Characters that are looked at in one go.
PIECE = 1 << 18
_SPACE = re.compile(r"\s")
#: The two faults that labels name, each with evidence of its own.
FAULTS = ("low", "toxic")


def _buckets(codes: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram that starts at each place."""
    h = np.full(len(codes) - ORDER + 1, ORDER, np.uint32)
    for j in range(ORDER):
        h = (h ^ codes[j : len(h) + j]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def present(texts: list[str], told: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of texts and the different buckets that the n-grams of each fall in, in order, some texts at a time. Texts are
    lower-cased, with a space at either end. ``told`` marks the buckets to look at. A long text is read in pieces that share
    ``ORDER - 1`` characters, and its buckets are made distinct over all of them."""
    for a, b in slices([len(t) for t in texts], PIECE):
        if b - a == 1:
            whole, found = f" {texts[a].lower()} ", np.empty(0, np.int64)
            for cut in range(0, max(len(whole) - ORDER + 1, 0), PIECE):
                bucket = _buckets(_codes(whole[cut : cut + PIECE + ORDER - 1]))
                found = np.union1d(found, bucket if told is None else bucket[told[bucket]])
            yield np.full(len(found), a), found
            continue
        low = [f" {t.lower()} " for t in texts[a:b]]
        codes = _codes("".join(low))
        doc = np.repeat(np.arange(b - a), [len(t) for t in low])
        if len(codes) < ORDER:
            continue
        bucket, first = _buckets(codes), doc[: len(doc) - ORDER + 1]
        use = first == doc[ORDER - 1 :]
        if told is not None:
            use &= told[bucket]
        pair = np.unique(first[use] << BITS | bucket[use])
        yield a + (pair >> BITS), pair & ((1 << BITS) - 1)


def _repeats(text: str) -> float:
    """The share of words that equal the word before."""
    at, n, same, last = 0, 0, 0, None
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        if words:
            same += sum(map(eq, words, words[1:])) + (words[0] == last)
            n, last = n + len(words), words[-1]
        at = end
    return same / n if n else 0.0


class Evidence(NamedTuple):
    """What n-grams say; the few that say anything."""

    bucket: np.ndarray  # in order
    weight: np.ndarray  # (faults, those buckets) evidence of each n-gram that is in a text


class Model(NamedTuple):
    weights: Evidence
    betas: np.ndarray  # of the logit that a text is clean, over `features`


#: How many standard errors to take off; training chooses by the loss on texts that the weights have not seen.
MARGINS = (2.0, 3.0, 4.5)


def _weights(present: np.ndarray, absent: np.ndarray, z: float) -> np.ndarray:
    """Log odds that a text with the bucket is faulty, less ``z`` standard errors: of the many n-grams only those count that
    are often seen and mostly in faulty texts."""
    a, b = present + 0.5, absent + 0.5
    return np.maximum(np.log(a / b) - z * np.sqrt(1 / a + 1 / b), 0).astype(np.float32)


def features(texts: list[str], evidence: Evidence) -> np.ndarray:
    """One, then for each fault the evidence of the different n-grams that are present, their sum on a log scale and the
    most of one, and last the share of repeated words and the length, on log scales, for each text. Long texts gather weak
    evidence by chance, which their length makes up for."""
    faults = len(evidence.weight)
    out = np.zeros((len(texts), 3 + 2 * faults))
    out[:, 0] = 1
    told = np.zeros(1 << BITS, bool)
    told[evidence.bucket] = True
    for d, bucket in present(texts, told):
        k = np.searchsorted(evidence.bucket, bucket)
        for f, w in enumerate(evidence.weight):
            np.add.at(out[:, 1 + f], d, w[k])
            np.maximum.at(out[:, 1 + faults + f], d, w[k])
    out[:, 1 : 1 + faults] = np.log1p(out[:, 1 : 1 + faults])
    out[:, -2] = np.log1p(50 * np.array([_repeats(t) for t in texts]))
    out[:, -1] = np.log1p([len(t) for t in texts])
    return out


def _logit_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, quality: str = "quality", toxic: str = "toxic", max_labels: int = 12_000) -> Model | None:
    """Learns from labelled documents what speaks for low quality and for toxicity, and how much either counts.

    ``max_labels`` bounds the labels that are used: where there are more, a hash of the id picks about so many. The ids
    picked are broadcast, so the documents are not shuffled. Weights of n-grams for the regression come from the other half
    of the sample, those that the model keeps from all of it. None if the labels do not have both kinds.
    """
    whole = labels.filter(F.col(quality).isNotNull() & F.col(toxic).isNotNull() & F.col(doc_id).isNotNull())
    whole = whole.groupBy(F.col(doc_id).cast("string").alias("key")).agg((F.min(quality) < 1).alias("low"), (F.max(toxic) > 0).alias("toxic"))
    n = whole.count()
    if n > max_labels:
        whole = whole.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * max_labels / n))
    picked = F.broadcast(materialize(whole, "labels"))
    own = docs.select(F.col(doc_id).cast("string").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(picked, "key")
    own = own.withColumn("print", F.xxhash64("text")).dropDuplicates(["print"])  # copies would count as many witnesses
    own = materialize(own.select("text", "low", "toxic", (F.pmod(F.xxhash64("text"), F.lit(2))).cast("int").alias("half")).repartition(4), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Buckets by half and by kind: 0 clean, 1 low, 2 toxic, 3 both; the last column counts the texts.
        found = np.zeros((8, (1 << BITS) + 1), np.int32)
        for batch in batches:
            texts, low, toxic, half = (c.to_pylist() for c in batch.columns)
            kind = 4 * np.array(half, np.int64) + np.array(low, np.int64) + 2 * np.array(toxic, np.int64)
            np.add.at(found[:, -1], kind, 1)
            for d, bucket in present(texts):
                np.add.at(found, (kind[d], bucket), 1)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i8").tobytes()], pa.binary()), pa.array([found.ravel()[at].astype("<i4").tobytes()], pa.binary())], names=["at", "n"])

    total = np.zeros((8, (1 << BITS) + 1))
    for r in own.mapInArrow(count, "at binary, n binary").toLocalIterator():
        total.ravel()[np.frombuffer(r["at"], "<i8")] += np.frombuffer(r["n"], "<i4")
    if not total[[0, 4], -1].sum() or not total[[1, 2, 3, 5, 6, 7], -1].sum():
        return None

    def learned(rows: list[int], z: float) -> Evidence:
        out = []
        for bit in (1, 2):
            bad, good = total[[r for r in rows if r & bit]].sum(0), total[[r for r in rows if not r & bit]].sum(0)
            out.append(_weights(bad[:-1], good[:-1], z))
        some = np.flatnonzero(np.any(out, axis=0))
        return Evidence(some, np.stack([w[some] for w in out]))

    halves = own.sparkSession.sparkContext.broadcast([[learned(rows, z) for z in MARGINS] for rows in (list(range(4, 8)), list(range(4)))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, low, toxic, half = (c.to_pylist() for c in batch.columns)
            for h in (0, 1):
                at = [i for i, x in enumerate(half) if x == h]
                rows = np.hstack([features([texts[i] for i in at], w) for w in halves.value[h]])
                clean = [not (low[i] or toxic[i]) for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(rows.tolist(), pa.list_(pa.float64())), pa.array(clean, pa.bool_())], names=["x", "y"])

    found = own.mapInArrow(measure, "x array<double>, y boolean").collect()  # as many rows as the sample, a few numbers each
    x, y = np.array([r["x"] for r in found]), np.array([r["y"] for r in found], float)
    halves.unpersist()
    tried = []
    for z, own_x in zip(MARGINS, np.split(x, len(MARGINS), axis=1), strict=True):
        betas = _logit_fit(own_x, y)
        tried.append((np.logaddexp(0, np.where(y > 0, -1, 1) * (own_x @ betas)).sum(), z, betas))
    _, z, betas = min(tried, key=lambda t: t[:2])
    return Model(learned(list(range(8)), z), betas)


def with_evidence(docs: DataFrame, model: Model | None, text: str, out: str) -> DataFrame:
    """``docs`` with a column ``out``: the logit, from the text alone, that a document is clean. Zero without a model."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logit = features([t or "" for t in batch.column(at).to_pylist()], shared.value.weights) @ shared.value.betas
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(logit, -30, 30), pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(0.0)).schema)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def site_priors(scored: DataFrame, host: str, path: str, logit: str) -> DataFrame:
    """``host``, ``path`` and ``shift``: how far a site moves the logit of its documents.

    The posterior probabilities of all documents are averaged by path, host and over all. A host's mean is shrunk toward the
    global one, a path's toward its host's, as if each had that many more documents of the mean above it; that number is
    estimated from how much the means of hosts, and of paths within hosts, vary beyond chance. Sums are combined before each
    shuffle, so a host with a third of the rows does no harm.
    """
    p = 1 / (1 + F.exp(-F.col(logit)))
    paths = materialize(scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n"), F.sum(p).alias("s")), "paths")
    hosts = paths.groupBy(F.col("host").alias("on")).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    every = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("k"), F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn"), 2)).alias("q")).first()
    mean = every["s"] / every["n"] if every["n"] else 0.5

    def strength(n: float | None, k: int, q: float | None, base: float) -> float:
        """Rows that the prior is worth, by moments: within variance over variance between groups."""
        within = max(base * (1 - base), 1e-6)
        between = max(((q or 0) - (n or 0) * base**2 - (k - 1) * within) / n, 0) if n else 0
        return float(min(max(within / between if between else 1e6, 10.0), 1e6))

    m_host = strength(every["n"], every["k"], every["q"], mean)
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("on"))).select("host", "path", "n", "s", ((F.col("hs") + m_host * mean) / (F.col("hn") + m_host)).alias("ph"))
    spread = both.agg(F.count("*").alias("k"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("ph"), 2)).alias("q")).first()
    within = max(mean * (1 - mean), 1e-6)
    between = max(((spread["q"] or 0) - spread["k"] * within) / every["n"], 0) if every["n"] else 0
    m_path = float(min(max(within / between if between else 1e6, 10.0), 1e6))
    post = (F.col("s") + m_path * F.col("ph")) / (F.col("n") + m_path)
    return both.select("host", "path", (_logit(post) - _logit(F.lit(mean))).alias("shift"))


def _judged(scored: DataFrame, priors: DataFrame, host: str, path: str, logit: str, most: float) -> DataFrame:
    """``scored`` with the combined log odds, in place of ``logit``."""
    h, p, shift = unused(scored.columns, "host", "path", "shift")
    shifts = materialize(priors.select(F.col("host").alias(h), F.col("path").alias(p), F.col("shift").alias(shift)), "priors")
    joined = scored.join(shifts, F.col(host).eqNullSafe(F.col(h)) & F.col(path).eqNullSafe(F.col(p)), "left")
    moved = F.least(F.greatest(F.coalesce(shift, F.lit(0.0)), F.lit(-most)), F.lit(most))
    return joined.withColumn(logit, F.col(logit) + moved).drop(h, p, shift)


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", max_labels: int = 12_000, threshold: float = 0.5, most: float = 1.0) -> DataFrame:
    """Scores every document: the logit of its own text that it is clean (of quality and not toxic), moved by the shrunk
    posterior of its host and path, by ``most`` either way at most, so that no site outweighs clear evidence.

    Returns ``doc_id``, ``evidence`` (the text's own logit), ``score`` (probability that it is clean, with the site's prior)
    and ``keep`` (``score`` reaches ``threshold``), a row for each input row. Null texts are empty. A null host or path is a
    site of its own; labels without an id or with a null value are ignored, and of several labels of one id the worst
    counts. Without labels of both kinds all evidence is zero and every document stays. Repeated rows get equal scores. A
    score of just ``threshold`` is kept. Very long texts are read in pieces and have the n-grams of the whole. Ids may be of
    any type; labels meet them as strings. An empty table gives no rows; other columns are ignored.
    The text is read once and not shuffled; sites are joined on scores alone.
    """
    model = train(docs, labels, doc_id=doc_id, text=text, max_labels=max_labels)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("text"))
    scored = materialize(with_evidence(own, model, "text", "evidence").drop("text"), "scored").withColumn("logit", F.col("evidence"))
    judged = _judged(scored, site_priors(scored, "host", "path", "logit"), "host", "path", "logit", most)
    score = 1 / (1 + F.exp(-F.col("logit")))
    return judged.select("doc_id", "evidence", score.alias("score"), (score >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", max_labels: int = 12_000, threshold: float = 0.5, most: float = 1.0) -> DataFrame:
    """``docs`` without those that ``classify`` would not keep, by the same rules; columns and types stay. Texts are scored
    twice, once for the sites' posteriors and once with them, rather than written out or shuffled."""
    model = train(docs, labels, doc_id=doc_id, text=text, max_labels=max_labels)
    first = with_evidence(docs.select(F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("text")), model, "text", "logit").drop("text")
    priors = site_priors(first, "host", "path", "logit")
    (logit,) = unused(docs.columns, "logit")
    judged = _judged(with_evidence(docs, model, text, logit), priors, host, path, logit, most)
    return judged.filter(1 / (1 + F.exp(-F.col(logit))) >= threshold).select(*docs.columns)
