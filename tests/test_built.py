"""What a store is built from: the same postings as of all_postings, and what a cap leaves out is never shuffled."""

import pytest
from pyspark.sql import functions as F

from kindred.operators import index, meet, normalize

COLUMNS = "source string, entity_id string, business_name string, business_address string, country string"


def _targets(spark, rows):
    return normalize.entities(spark.createDataFrame(rows, COLUMNS), folded=True)


def _shuffled(spark):
    """Rows that all stages so far have written for a shuffle."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_frequent_grams_are_not_shuffled(spark, tmp_path):
    n = 1500
    targets = _targets(spark, [("S2", f"S2-{i}", "international widgets and more pvt ltd", f"{i} oak street", "India") for i in range(n)]).cache()
    grams = index.gram_postings(targets).count()
    before = _shuffled(spark)
    index.build_indexes(targets, str(tmp_path / "idx"), enable_ngrams=True)
    assert grams > 50 * n and _shuffled(spark) - before < 20 * n
    assert spark.read.parquet(str(tmp_path / "idx/name_ngram_index")).isEmpty()


@pytest.mark.parametrize("cap", [0, 3, 1000])
@pytest.mark.parametrize("more", [[], [("S3", "S2-1", "w1 w7 w8", "w3 tx 10009", "US"), ("S2", "S2-1", "w1 w2", "w3 w4", "India"), ("S2", "S2-2", "w2", "w9", "US")]])
@pytest.mark.parametrize("few", [0, 200_000])
def test_postings_of_a_store(spark, monkeypatch, cap, more, few):
    monkeypatch.setattr(index, "FEW_KEYS", few)
    rows = [("S2", f"S2-{i}", f"w{i % 5} w{i % 7} w{i % 5}", f"w{i % 9} w{i} tx {10000 + i % 6}", ["US", "India", ""][i % 8 % 3]) for i in range(60)]
    targets = _targets(spark, rows + more).cache()
    want, got = (make(targets, cap, cap, True, cap) for make in (index.all_postings, index.written_postings))
    assert list(want) == list(got)
    for name in want:
        assert sorted(map(tuple, got[name].select(*want[name].columns).collect())) == sorted(map(tuple, want[name].collect())), name


def test_keys_with_a_cap(spark):
    """Keys over the cap of retrieval are left out whole, one at the cap is kept."""
    postings = spark.createDataFrame([("us", v, f"t{i}") for v, n in (("a", 3), ("b", 2)) for i in range(n)], "country_key string, value string, entity_id string")
    s1 = spark.createDataFrame([(f"q{v}", "us", v) for v in "ab"], "source1_entity_id string, country_key string, name_nfkc string")
    found = meet.retrieve(s1, {"exact_name": postings}, {"exact_name": 2}).select("source1_entity_id", "candidate_entity_id", F.array_join("methods", ","))
    assert sorted(map(tuple, found.collect())) == [("qb", "t0", "exact_name"), ("qb", "t1", "exact_name")]
