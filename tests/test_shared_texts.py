"""Words and n-grams of a store are made once for a text that many records share, and are those of all postings."""

import pytest

from kindred.operators import index, normalize
from kindred.plans.fixture import Linkage

rows = lambda df: sorted(map(tuple, df.collect()), key=str)
COLUMNS = "source string, entity_id string, business_name string, business_address string, country string"


@pytest.mark.parametrize("more", [[], [("S2", "S2-1", "w1 w2", "w3 w4", "US"), ("S3", "S2-1", "w9", "w5", "US"), ("S2", "S2-2", "w2", "w9", "India")]])
def test_postings(spark, more):
    made = [("S2", f"S2-{i}", f"w{i % 5} w{i % 3}", f"w{i % 4} tx", ["US", "India", ""][i % 8 % 3]) for i in range(400)]
    targets = normalize.entities(spark.createDataFrame(made + more, COLUMNS), folded=True).cache()
    names = ("rare_name_token", "rare_address_token", "name_ngram")
    got = index.postings_by_text(targets, "name_compact", index.text.char_ngrams(index.F.col("name_compact")), 40, not more)
    assert got is not None and rows(got) == rows(index.ngram_postings(targets, 40).select(*got.columns))
    for cap in (0, 40, 1000):
        want, own = (make(targets, cap, cap, True, cap) for make in (index.all_postings, index.written_postings))
        for name in names:
            assert rows(own[name].select(*want[name].columns)) == rows(want[name])


def test_line_items_are_normalised_by_text(spark, tmp_path):
    made = [(i, i % 7 + 1, "AR"[i % 2], "F", float(i % 51)) for i in range(500)] + [(1, 1, None, "F", None)]
    spark.createDataFrame(made, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    link = Linkage(spark, str(tmp_path), "lineitems")
    want = normalize.normalize_folded(link.records)
    assert link.views.count() == link.records.count() and rows(link.views.select(*want.columns)) == rows(want)
    assert "regexp" not in link.views._jdf.queryExecution().optimizedPlan().toString().lower()
