"""What large groups of records with equal texts must not cost, with the results that they must have."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kindred.operators import blocking, evaluate, index, meet, normalize, profile
from kindred.plans import catalog
from kindred.plans.fixture import Linkage

rows = lambda df: sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("customers"))
    spark.createDataFrame([(i, i % 2, ["AUTO", "MACHINERY"][i // 9 % 2]) for i in range(300)], "c_custkey long, c_nationkey long, c_mktsegment string").coalesce(1).write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame([(0, "PERU"), (1, "FRANCE")], "n_nationkey long, n_name string").write.parquet(f"{path}/nation.parquet")
    return path


def test_truth_needs_no_views_and_joins_lists(spark, customers):
    link = Linkage(spark, customers, "customers")
    truth = link.truth
    assert "saved" not in link.__dict__
    plan = truth._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("collect_list(id")  # the list of a key is made below its join
    histogram = profile.match_histogram(truth)._jdf.queryExecution().optimizedPlan().toString()
    assert histogram.index("Generate") < histogram.rindex("Aggregate [matched_entity_ids")
    assert link.records.rdd.getNumPartitions() > 1


def test_truth_lists(spark):
    q = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 3), ("d", None)], "source1_entity_id string, k long")
    t = spark.createDataFrame([("x", 1), ("z", 2), ("y", 2), ("z", 2)], "id string, k long")
    truth = evaluate.truth_lists(q, t, "k")
    assert rows(truth) == [("a", "x,y,z,z"), ("b", "y,z,z"), ("c", ""), ("d", "")]
    assert rows(profile.match_histogram(truth, ())) == [("all", 0, 2), ("all", 3, 1), ("all", 4, 1)]
    assert rows(profile.truth_summary(truth)) == [(4, 2, 50.0, 7)]
    assert rows(profile.truth_summary(truth.filter(F.lit(False)))) == [(0, 0, 0.0, None)]


def test_similar_pairs_are_compared_once_for_a_pair_of_texts(spark, customers, monkeypatch):
    monkeypatch.setattr(meet, "BATCH", 500)
    link = Linkage(spark, customers, "customers")
    near = blocking.candidates(blocking.evidence(link.s1, link.postings, ["core_name", "exact_address"]), blocking.v1())
    q, t = (own.select(F.col("entity_id").alias(i), F.col("name_nfkc").alias(f"n{i}"), F.col("address_nfkc").alias(f"a{i}")) for own, i in ((link.saved.filter("source = 'S1'"), "source1_entity_id"), (link.targets, "candidate_entity_id")))
    both = near.join(q, "source1_entity_id").join(t, "candidate_entity_id").collect()
    ratio = lambda a, b: round(SequenceMatcher(None, a, b).ratio(), 4)
    want = sorted((r["source1_entity_id"], r["candidate_entity_id"], ratio(r["nsource1_entity_id"], r["ncandidate_entity_id"]), ratio(r["asource1_entity_id"], r["acandidate_entity_id"])) for r in both)
    found = catalog.QUERIES["name_similarity"](spark, customers)
    assert want and rows(found) == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_similarities_of_records_that_share_an_id(spark):
    made = [("S1", "S1-1", "a b", "x 1"), ("S1", "S1-1", "c d", "x 2"), ("S1", "S1-2", "e", ""), ("S2", "S2-1", "a b", "x 2"), ("S2", "S2-1", "q r", "x 9"), ("S2", "S2-2", "e", "z")]
    views = normalize.normalize_folded(spark.createDataFrame([(*r, "US") for r in made], "source string, entity_id string, business_name string, business_address string, country string"))
    keys = meet.record_keys(views, ["core_name", "exact_address"], F.col("source") == "S1", texts={"name": "name_nfkc", "address": "address_nfkc"})
    ratio = lambda a, b: round(SequenceMatcher(None, a, b).ratio(), 4)
    want = [(q[1], t[1], ratio(q[2], t[2]), ratio(q[3], t[3]) if q[3] else 0.0) for q in made[:3] for t in made[3:] if (q[1] == "S1-1") == (t[1] == "S2-1")]
    assert rows(meet.similarities(keys, ["core_name", "exact_address"], "address", "name")) == sorted(want)


@pytest.mark.parametrize("caps", [{}, {"core_name": 15, "postal": 3}])
def test_retrieval_by_meeting(spark, customers, caps):
    link = Linkage(spark, customers, "customers")
    postings = link.postings | {"name_ngram": index.ngram_postings(link.targets, 40)}
    want = rows(blocking.retrieve(link.s1, postings, caps))
    found = meet.retrieve(link.s1, postings, caps)
    assert want and rows(found) == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_line_items_of_one_file_are_dealt_out(spark, tmp_path):
    made = spark.createDataFrame([(i, 1, "A", "F", 5.0) for i in range(40)], "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double")
    made.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    records = Linkage(spark, str(tmp_path), "lineitems").records.filter("source <> 'S1'")
    assert records.count() == 40 and records.rdd.getNumPartitions() > 4
