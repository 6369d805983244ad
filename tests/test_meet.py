"""Blocks of queries that meet blocks of targets find what the evidence over postings finds, and shuffle no pairs."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import blocking, evaluate, index, meet, normalize
from kindred.plans import catalog

BLOCKS = blocking.BLOCKS[:7]


@pytest.fixture(scope="module")
def views(spark):
    draw = random.Random(5)
    word = lambda n: f"w{int(draw.random() ** 2 * n)}"
    rows = [(f"S{i % 3 + 1}", f"S{i % 3 + 1}-{i}", " ".join(word(9) for _ in range(i % 4)), " ".join(["main", *(word(40) for _ in range(i % 7)), "tx", str(10000 + i % 5)]), ["US", "India", ""][i % 8 % 3]) for i in range(400)]
    rows += [("S2", "S2-1", "w1 w2", "w3 tx 10001", "US"), *rows[:6]]  # ids that come up again
    return normalize.normalize_folded(spark.createDataFrame(rows, "source string, entity_id string, business_name string, business_address string, country string")).cache()


@pytest.fixture
def small(monkeypatch):
    """Several blocks and batches."""
    for name, n in (("HELD_ROWS", 50), ("MOST_KEYS", 300), ("BATCH", 100)):
        monkeypatch.setattr(meet, name, n)


def _found(views, cap):
    s1, targets = normalize.query_records(views.filter("source = 'S1'")).distinct(), views.filter("source <> 'S1'")
    return blocking.evidence(s1, index.all_postings(targets, cap, cap))


def _keys(views):
    return meet.record_keys(views, BLOCKS, F.col("source") == "S1", F.xxhash64("name_nfkc"))


@pytest.mark.parametrize("cap", [3, 30, 1000])
def test_evidence(views, small, cap):
    want, caps = _found(views, cap).cache(), dict.fromkeys(index.TOKENS, cap)
    got = meet.pairs(_keys(views), BLOCKS, caps, whole=True)
    assert want.count() > 0 and sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    for rule in ("v1", "v2", "v3"):
        kept = blocking.candidates(want, getattr(blocking, rule)())
        assert sorted(map(tuple, meet.pairs(_keys(views), BLOCKS, caps, rule).collect())) == sorted(map(tuple, kept.collect()))


def test_tallies(views, small):
    caps = dict.fromkeys(index.TOKENS, 30)
    own = views.select("source", "entity_id", F.xxhash64("name_nfkc").alias("n")).distinct()
    q, t = own.filter("source = 'S1'"), own.filter("source <> 'S1'")
    true = q.select(F.col("entity_id").alias("source1_entity_id"), "n").join(t.select(F.col("entity_id").alias("true_entity_id"), "n"), "n").drop("n").distinct()
    found, ids = _found(views, 30).cache(), q.select(F.col("entity_id").alias("source1_entity_id")).distinct()
    tallies = meet.tallies(_keys(views), BLOCKS, caps).cache()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(evaluate.block_diagnostics(tallies, true)) == rows(evaluate.block_diagnostics(found, true))
    assert rows(evaluate.strategy_stats(tallies, true, ids)) == rows(evaluate.strategy_stats(found, true, ids))
    assert rows(evaluate.per_s1_report(ids, tallies, true)) == rows(evaluate.per_s1_report(ids, found, true))


@pytest.mark.parametrize("name", ["evidence", "candidates_v1", "candidates_v2", "candidates_v3", "retrieve_with_methods", "block_rare_address_token"])
def test_no_pair_is_shuffled(spark, tmp_path, name):
    rows = [(i, f"one two three four five w{i % 7} w{i % 5}", "en", "s", 9) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES[name](spark, str(tmp_path))
    assert found.count() > 0
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_missed_pairs_are_not_shuffled(spark, tmp_path):
    rows = [(i, f"one two three four five w{i % 7} w{i % 5}", "en", "s", 9) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["miss_reasons"](spark, str(tmp_path))
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
